"""Wrapper induction: alignment against plain recursion, content by its varying slots."""

import functools
import random

from retentia.llm import html_extract


def plain_match(a, b):
    """Simple tree matching as it is defined, without any table kept."""

    @functools.cache
    def best(i, j):
        if i == len(a) or j == len(b):
            return 0
        out = max(best(i + 1, j), best(i, j + 1))
        if a[i].sign == b[j].sign:
            w = 1 + len(a[i].texts & b[j].texts) + plain_match(a[i].children, b[j].children)
            out = max(out, w + best(i + 1, j + 1))
        return out

    return best(0, 0)


def made_page(rng, depth=3):
    out = ""
    for _ in range(rng.randint(0, 5)):
        tag, name = rng.choice(["div", "section", "p"]), rng.choice(["", " class=a", " class=b"])
        if tag == "p" or not depth:
            out += f"<p{name}>{rng.choice('uvwxyz')}</p>"
        else:
            out += f"<{tag}{name}>{made_page(rng, depth - 1)}</{tag}>"
    return out


def test_matching_equals_plain_recursion():
    rng = random.Random(5)
    for _ in range(150):
        a, b = (html_extract.slots(html_extract.parse(made_page(rng)))[0] for _ in "ab")
        pairs = []
        score = html_extract.match(a, b, pairs)
        assert score == plain_match(a, b)
        # the pairs are worth the score
        assert score == sum(1 + len(p.texts & q.texts) for p, q in pairs)
        assert len({id(p) for p, _ in pairs}) == len({id(q) for _, q in pairs}) == len(pairs)


def test_long_lists_far_off_the_diagonal():
    """180 blocks shared by lists of 300 and 180 different blocks are all found."""
    long = [f"<div class=c{k}>x{k}</div>" for k in range(300)]
    a = html_extract.slots(html_extract.parse("".join(long)))[0]
    b = html_extract.slots(html_extract.parse("".join(long[120:])))[0]
    pairs = []
    assert html_extract.match(a, b, pairs) == 2 * len(pairs) == 360


def test_deep_pages():
    deep = "<div>" * 20_000
    page = f"{deep}<article><nav><a>menu x</a></nav><p>deep <b>down</b></article>"
    assert html_extract.main_text(page) == "deep down"
    a, b = (html_extract.slots(html_extract.parse(page))[0] for _ in "ab")
    assert html_extract.match(a, b, []) > 20_000
    # end tags without a start, and inline elements that never end
    assert html_extract.main_text("</i>" * 20_000 + "<b>" * 20_000 + "x") == "x"


def test_text_numbers_follow_from_parts():
    a = html_extract.annotate(html_extract.parse("<p>one <b>two</b>\n three</p>"))
    b = html_extract.annotate(html_extract.parse("<p>one two <script>x</script>three</p>"))
    c = html_extract.annotate(html_extract.parse("<p>one two thre</p>"))
    assert (a.text, a.size) == (b.text, b.size) and a.text != c.text
    assert a.text == int.from_bytes(b"one two three", "big") % html_extract.PRIME and a.size == 13


def test_classes_by_whole_tokens():
    get = html_extract.main_text
    assert get("<div class='layout has-sidebar'><article>a b</article></div>") == "a b"
    assert get("<div class='sidebar'><article>a b</article></div>") == "a b"
    assert get("<div class='content no-comments'>a b</div>") == "a b"
    inside = "<section class='discussion'>d</section><p class='notice'>n</p>" \
             "<div class='widget-spec'>w</div><h1 class='entry-header'>h</h1>"
    assert get(f"<article>{inside}</article>") == "d\nn\nw\nh"
    assert get("<article><p>Market <span class='share'>share</span> rose</p></article>") == \
        "Market share rose"
    assert get("<article><p>Press <button>OK</button> now</p><button>Send</button></article>") == \
        "Press OK now"
    for name in ("comments", "post-comments", "comments-area", "site-footer", "ad-box", "nav-bar"):
        assert get(f"<article>a</article><div class='{name}'><article>b</article></div>") == "a", name
        assert get(f"<article>a<div class='{name}'>b</div></article>") == "a", name


def wrapped(k, body, side=""):
    return f"<html><body><div class=q1><p>Our pages</p><p>Log in</p></div><div class=q2>" \
           f"<div class=q3>{body}</div><div class=q4>{side}</div></div>" \
           f"<div class=q5>All rights</div></body></html>"


def test_wrapper_alone_finds_the_text(spark):
    """Hosts without article, main or telling classes: the slot with the varying text is it."""
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    rows, want = [], {}
    for host in range(5):
        for k in range(host + 5):
            parts = [" ".join(rng.choices(words, k=25)) for _ in range(rng.randint(2, 6))]
            body = f"<h2>Title {host} {k}</h2><div class=z{host}>" + "".join(
                f"<p>{x}</p>" for x in parts) + "<p>Print this page</p></div>"
            n = len(rows)
            rows.append((n, f"http://h{host}/{k}", wrapped(k, body, f"<p>seen {k} times</p>")))
            want[n] = "\n".join([f"Title {host} {k}", *parts])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.main_texts(pages).collect()} == want


def test_few_pages_have_no_wrapper(spark):
    rows = [(k, "http://h/", wrapped(k, f"<p>story {k}</p>")) for k in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_texts(pages).collect()}
    assert got[1] == "Our pages\nLog in\nstory 1\nAll rights"
