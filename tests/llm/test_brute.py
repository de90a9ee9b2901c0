"""Operators that SQL cannot express, against brute force on small tables."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from retentia.llm import (
    decontaminate, html_extract, lm_score, mixing, near_join, pii, quality_rules, toxicity,
)
from retentia.llm.common import connected, hash_words, load
from retentia.llm.queries import QUERIES
from tests.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def texts(spark):
    rows = load(spark, SMALL, "documents").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


def sets_of(texts):
    out = {}
    for i, t in texts.items():
        w = WORD.findall(t)
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_classes(sets, threshold=0.8):
    ids, links, root = sorted(sets), collections.Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * len(sets[a] | sets[b]) - 1e-12:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (find(i), links[i]) for i in ids}


def test_near_copies(spark, texts):
    got = {r.doc_id: (r.class_id, r.n_links) for r in QUERIES["op4_near_copies"](spark, SMALL).collect()}
    assert got == brute_classes(sets_of(texts))


def test_near_copies_in_blocks(spark):
    """A large group of near copies, cut into many blocks in both steps."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    texts = {}
    for i in range(60):
        t = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 5)):
            t[k] = f"x{i}_{k}"
        texts[i] = " ".join(t)
    texts |= {100 + i: " ".join(f"y{i}_{k}" for k in range(40)) for i in range(10)}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    join = near_join.Join(block=7, block_shingles=900)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_join.classes(docs, join).collect()}
    assert got == brute_classes(sets_of(texts))


def test_pruning_keeps_what_may_reach_the_threshold():
    join = near_join.Join()
    need = near_join.least_matches(join)
    for k, m in zip(join.looks, need):
        # the chance that a pair at the threshold shows fewer matches is tiny
        miss = sum(math.comb(k, i) * 0.8**i * 0.2 ** (k - i) for i in range(m))
        assert miss < 1e-5
    assert need[-1] > 0.5 * join.looks[-1]


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 102), (101, 102), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in connected(df).collect()}
    assert got == {k: 0 for k in range(51)} | {k: 100 for k in (100, 101, 102)}


def test_leaks(spark, texts):
    items = {r.item_id: r.text for r in load(spark, SMALL, "benchmark").collect()}
    flat = {i: " ".join(t.split()) for i, t in texts.items()}
    want = {(d, i) for d, t in flat.items() for i, x in items.items() if " ".join(x.split()) in t}
    got = QUERIES["op2_benchmark_leaks"](spark, SMALL).collect()
    assert want and want == {(r.doc_id, r.item_id) for r in got}


def test_search_finds_all_above_the_threshold():
    """Pruning by block maxima against scores of every window and item."""
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(80)]
    items = [(k, " ".join(rng.choice(words, 20)), " ".join(rng.choice(words, 6))) for k in range(40)]
    search = decontaminate.Search(threshold=0.4, question=0, answer=0, block=4, shortest_window=8)
    index = decontaminate.Index(items, search)
    texts = pa.array([" ".join(rng.choice(words, n)) for n in (3, 60, 400)] + [items[5][1], ""])
    index.weigh(*decontaminate.passage_counts(texts, index))
    codes, bounds = index.codes(texts)
    weight = np.zeros((40, len(index.terms)))
    weight[index.post_items, index.post_terms] = index.impacts
    want = collections.defaultdict(float)
    for text, a, b in zip(*decontaminate.windows(bounds, index.span)):
        inside = np.unique(codes[a:b][codes[a:b] >= 0])
        for item, s in enumerate(weight[:, inside].sum(1)):
            if s >= 0.4 - 1e-6:
                want[text, item] = max(want[text, item], s)
    got = {(t, i): s for t, i, s, *_ in decontaminate.retrieve(texts, index)}
    assert set(got) == set(want) and len(got) > 20
    assert max(abs(got[k] - want[k]) for k in got) < 1e-5


def test_leaks_do_not_depend_on_shards(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(words, rng.integers(5, 60)))) for k in range(60)]
    docs = [(k, " ".join([*rng.choice(words, 50), *items[k % 60][1].split()[: 4 + k % 50]]))
            for k in range(90)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [
        sorted((r.doc_id, r.item_id, round(r.score, 5)) for r in decontaminate.hits(
            docs, bench, decontaminate.Search(shard_words=n)).collect())
        for n in (300, 50_000)]
    assert got[0] == got[1] and len(got[0]) > 10


def test_windows_hold_every_stretch():
    for n in range(0, 60):
        _, starts, ends = decontaminate.windows(np.array([0, n]), 8)
        assert all(any(s <= k and k + 8 <= e for s, e in zip(starts, ends)) for k in range(n - 7))


def test_lm(spark, texts):
    """Every document against the counts of all others, token by token."""
    models = lm_score.Models()
    good = {r.doc_id for r in load(spark, SMALL, "labels").collect() if r.quality == 1}
    words = {i: WORD.findall(x) for i, x in texts.items()}
    total = collections.Counter(w for x in words.values() for w in x)
    known = sorted(total)
    order = dict(zip(known, hash_words(pa.array(known)).view(np.int64)))
    classes = set(sorted(known, key=lambda w: (-total[w], order[w]))[: models.classes])
    size, rest = len(classes) + 1, len(known) - len(classes)
    of = {i: [w if w in classes else None for w in x] for i, x in words.items()}

    def counted(ids):
        c = collections.Counter()
        for i in ids:
            for before, now, w in zip(["<"] + of[i], of[i], words[i]):
                c.update([("pair", before, now), ("before", before), ("class", now), "all",
                          ("word", w)])
        return c

    everyone, target = counted(words), counted(i for i in words if i in good)

    def loss(i, c):
        out = 0
        for before, now, w in zip(["<"] + of[i], of[i], words[i]):
            share = lambda x, y: c[x] / c[y] if c[y] else 0.0
            two, one, floor = models.weights
            p = (two * share(("pair", before, now), ("before", before))
                 + one * share(("class", now), "all") + floor / size)
            if now is None:
                p *= (1 - models.floor) * share(("word", w), ("class", None)) + models.floor / rest
            out -= math.log(p)
        return out

    def without(c, own):
        c = c.copy()
        c.subtract(own)
        return c

    got = {r.doc_id: r for r in QUERIES["op5_lm_score"](spark, SMALL).collect()}
    assert len(got) == len(words)
    some = [i for i in sorted(words) if words[i]][::5]
    assert {i in good for i in some} == {True, False}
    for i in some:
        own, n = counted([i]), len(words[i])
        b = loss(i, without(everyone, own)) / n
        t = loss(i, without(target, own) if i in good else target) / n
        assert got[i].n_tokens == n
        assert got[i].background_loss == pytest.approx(b, abs=1e-9)
        assert got[i].target_loss == pytest.approx(t, abs=1e-9)
        assert got[i].score == pytest.approx(t - b, abs=1e-9)


def test_lm_tells_wording_apart(spark):
    """Documents of one topic score below those of another that is spelt alike."""
    topics = ["stone river bridge water", "nesto verir gebrid retaw"]
    rng, rows = np.random.default_rng(5), []
    for i in range(200):
        own, shared = topics[i % 2].split(), "the of and to in".split()
        rows.append((i, " ".join(rng.choice(own + shared, 60))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm_score.scored(docs, docs.where("doc_id % 2 = 0 AND doc_id < 50").select("doc_id"))
    score = {r.doc_id: r.score for r in got.collect()}
    assert max(score[i] for i in range(50, 200, 2)) < min(score[i] for i in range(51, 200, 2))


def test_lm_sees_the_order_of_rare_words(spark, monkeypatch):
    """Pairs of words count for every word of the vocabulary, over blocks of a few rows."""
    monkeypatch.setattr(lm_score, "BLOCK", 5 * lm_score.ROW)
    common = " ".join(f"c{k}" for k in range(255))
    word = [f"w{k}" for k in range(800)]
    rare = [[word[(7 * i + j) % 800] for j in range(40)] for i in range(300)]
    rows = [(i, f"{common} {' '.join(x)}") for i, x in enumerate(rare)]
    rows += [(300 + i, f"{common} {' '.join(reversed(rare[i]))}") for i in range(0, 300, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm_score.scored(docs, docs.where("doc_id < 300 AND doc_id % 10 <> 0").select("doc_id"))
    score = {r.doc_id: r.score for r in got.collect()}
    assert all(score[i] + 0.001 < score[300 + i] for i in range(0, 300, 10))


def test_lm_marks_move_no_text(spark):
    docs = spark.range(0, 20_000, 1, 3).selectExpr(
        "nullif(id % 9000, 17) AS doc_id", "concat('text of row ', id) AS text")
    ids = spark.range(100).selectExpr("CAST(id * 7 AS BIGINT) AS doc_id").unionByName(
        spark.createDataFrame([(7,), (None,), (17,), (99_999,)], "doc_id long"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        rows = lm_score.marked_rows(docs, ids)
        # the only exchange is that of the marks
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert [x for x in re.findall(r"Exchange (.*)", plan) if "_block" not in x] == []
        assert len(re.findall(r"Exchange", plan)) == 1 and "Bucketed: true" in plan
        got = rows.collect()
    finally:
        spark.conf.set(key, before)
    target = {i * 7 for i in range(100)} - {17}
    assert len(got) == len({r._row for r in got}) == 20_000
    assert all(r._target == (r.doc_id in target) for r in got)
    assert sum(r._target for r in got) == 3 * sum(i < 2000 for i in target) + 2 * sum(
        2000 <= i for i in target)
    assert {r._text for r in got} == {f"text of row {i}" for i in range(20_000)}


def test_lm_without_hot_table(spark, texts):
    docs, labels = load(spark, SMALL, "documents"), load(spark, SMALL, "labels")
    cold = lm_score.Models(hot_share=2.0)
    got = {r.doc_id: r.score for r in lm_score.scored(docs, labels, cold).collect()}
    want = {r.doc_id: r.score for r in lm_score.scored(docs, labels).collect()}
    assert max(abs(got[k] - want[k]) for k in want if want[k] is not None) < 1e-9


def test_binomial_bound():
    for n, limit in ((90, 0.05), (400, 0.02)):
        for k in range(0, 12):
            tail = sum(math.comb(n, i) * limit**i * (1 - limit) ** (n - i) for i in range(k + 1))
            assert quality_rules.upper_bound_holds(k, n, limit, 0.01) == (
                k < n * limit and tail <= 0.01)


def test_quality_limit(spark):
    """Good documents are kept up to the limit in every stratum."""
    rows = QUERIES["op3_quality_rules"](spark, "/root/testdata/sf0.01").where("not base_failed")
    labels = load(spark, "/root/testdata/sf0.01", "labels").where("quality = 1")
    good = rows.join(labels, "doc_id").selectExpr("stratum", "int(not kept) AS lost").groupBy(
        "stratum").agg({"lost": "avg"}).collect()
    # the limit holds for the rate behind the sample: 0.05, and what chance adds to it
    assert good and all(r[1] <= 0.08 for r in good), good
    every = rows.join(labels, "doc_id")
    assert every.where("not kept").count() <= 0.05 * every.count()


def test_mix_meets_targets(spark):
    rows = QUERIES["op6_mix_sources"](spark, SMALL).collect()
    again = QUERIES["op6_mix_sources"](spark, SMALL).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    taken, target = collections.Counter(), {}
    for r in rows:
        assert r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += r["size"]
    # plain water-filling
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    budget, free, want = 1.5 * sum(sizes.values()), set(sizes), {}
    while True:
        level = (budget - sum(want.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        want |= {s: 2 * sizes[s] for s in over}
        free -= over
    want |= {s: level * weight[s] for s in free}
    assert all(target[s] == pytest.approx(want[s]) for s in sizes)


def test_surrogates_are_distinct_and_keep_formats():
    conf = pii.Surrogates()
    for kind, values in {
        "ip": [f"10.0.{a}.{b}" for a in range(20) for b in range(20)],
        "phone": [f"+1{k:010d}" for k in range(500)],
        "email": [f"a{k}@b{k % 3}.com" for k in range(300)],
        "secret": [f"{k:032x}" for k in range(300)],
        "name": [f"{g} {s}" for g in ("Anna", "Peter") for s in ("Lee", "Roy", "Ng", "Oz")],
    }.items():
        got = {pii.surrogate(conf, kind, v) for v in values}
        assert len(got) == len(values) and not got & set(values)
    card = pii.surrogate(conf, "card", "4111111111111111")
    assert card[0] == "4" and pii._luhn(card) == 0
    assert pii._iban_ok(pii.surrogate(conf, "iban", "GB82WEST12345698765432"))
    text = "Mrs. Ada King met Anna Lee at +1 (017) 555-7713; Anna Lee: 10.1.2.3, id 1234567890123456."
    new = pii.replace(text)
    assert new.startswith("Mrs. ") and new.endswith(", id 1234567890123456.")
    names = re.findall(r"met (\w+ \w+) at|; (\w+ \w+):", new)
    assert names[0][0] == names[1][1] and names[0][0].split()[0] in pii.GIVEN["f", "latin"]
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4};", new)


def test_cards_and_ibans_with_more_behind_them():
    for kind, value, behind in [
        ("card", "4111 1111 1111 1111", " 12/27"), ("card", "4111111111111111", " 123"),
        ("card", "4111-1111-1111-1111", "-12 a"), ("card", "378282246310005", " 1234."),
        ("card", "5500 0000 0000 0004", " 123 12/27"), ("card", "4222222222222", " 12 123"),
        ("iban", "AT611904300234573201", " BIC"), ("iban", "BE68539007547034", " BIC GEBABEBB"),
        ("iban", "ES91 2100 0418 4502 0005 1332", " BIC"), ("iban", "DE89370400440532013000", " BIC X"),
        ("iban", "AT61 1904 3002 3457 3201", " RZOOAT2L"), ("iban", "NO9386011117947", " BIC"),
    ]:
        text = f"pay {value}{behind}"
        assert [(k, text[a:b]) for k, a, b in pii.entities(text)] == [(kind, value)], text
        new = pii.replace(text)
        assert value not in new and new.endswith(behind) and len(new) == len(text)
    # two digits behind a card can hold the check by chance; the issuer's length goes first
    by_chance = next(f"{k:02d}" for k in range(100) if pii._luhn(f"4111111111111111{k:02d}") == 0)
    assert pii.entities(f"4111111111111111 {by_chance}") == [("card", 0, 16)]
    assert pii.entities("4111 1111 1111 1112 12/27") == []


def test_collisions_are_keyed_anew(spark):
    """One letter has 25 surrogates, so 40 addresses that differ by their ending must collide."""
    conf = pii.Surrogates()
    mails = [f"a@b.{x}{y}" for x in "cdefghij" for y in "klmno"]
    assert len({pii.surrogate(conf, "email", v) for v in mails}) < len(mails)
    known = spark.createDataFrame([("email", v) for v in mails], "kind string, value string")
    lost = {r.value: r.attempt for r in pii.collisions(known, conf).collect()}
    assert lost
    got = {pii.surrogate(conf, "email", v, lost.get(v, 0)) for v in mails}
    assert len(got) == len(mails) and not got & set(mails)
    text = " ".join(mails)
    docs = spark.createDataFrame([(1, text), (2, mails[0])], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.with_surrogates(docs).collect()}
    assert len(set(out[1].split())) == len(mails) and out[2] == out[1].split()[0]
    joined = pii.with_surrogates(docs, pii.Surrogates(most_shared=0))
    assert {r.doc_id: r.text for r in joined.collect()} == out


def test_html_template_of_a_host(spark):
    rows = []
    for k in range(8):
        body = f"<div><p>Join our club today</p></div><article><h1>T{k}</h1><p>Only here: story {k}</p>" \
               f"<p class=x>Read more at our site</p><p>end {k} of it</p></article>"
        rows.append((k, f"http://h/{k}", f"<html><title>T{k}</title><body>{body}</body></html>"))
    copies = [(100 + k, f"http://c/{k}", rows[0][2]) for k in range(8)]
    pages = spark.createDataFrame(rows + copies, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_texts(pages).collect()}
    assert got[3] == "T3\nOnly here: story 3\nend 3 of it"
    # copies of one page do not make a template
    assert got[103] == "T0\nOnly here: story 0\nRead more at our site\nend 0 of it"


def test_html_constant_node_in_a_run(spark):
    """A constant plain paragraph, list item or div beside varying ones of its kind is template."""
    rows = []
    for k in range(8):
        more = "".join(f"<p>more {k} {i}</p>" for i in range(k % 3))
        body = f"<h1>T{k}</h1><p>story {k}</p><p>Get our letter</p>{more}<p>end {k}</p><p>(c) us</p>" \
               f"<ul><li>item {k}</li><li>Print this</li></ul><div>box {k}</div><div>All rights</div>"
        page = f"<html><title>T{k}</title><body><article>{body}</article></body></html>"
        rows.append((k, f"http://h/{k}", page))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html_extract.main_texts(pages).collect():
        k = r.page_id
        more = [f"more {k} {i}" for i in range(k % 3)]
        assert r.text.split("\n") == [
            f"T{k}", f"story {k}", *more, f"end {k}", f"item {k}", f"box {k}"]


def test_html_host_of_one_title(spark):
    """Pages that share the site's title have a template; copies with titles of their own do not
    make one."""
    def page(title, k):
        return f"<html><title>{title}</title><body><article><p>story {k}</p><p>Read more at our site</p>" \
               "</article></body></html>"

    rows = [(k, f"http://h/{k}", page("Our site", k)) for k in range(6)]
    rows += [(100 + k, f"http://c/{k}", page(f"Title {k}", 0)) for k in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_texts(pages).collect()}
    assert [got[k] for k in range(6)] == [f"story {k}" for k in range(6)]
    assert {got[100 + k] for k in range(6)} == {"story 0\nRead more at our site"}


def test_html_attributes_by_exact_name():
    links = ['href="/hidden-gems"', 'title="the hidden valley"', 'data-hidden="false"',
             'href="/page?id=related"', 'href=/a?class=ad', 'data-x="a" alt=\'role="menu"\'']
    for a in links:
        assert html_extract.main_text(f"<article><p>one <a {a}>two</a> end</p></article>") == "one two end"
    for a in ("hidden", 'HIDDEN=""', "class=ad", 'aria-hidden = "true"', 'style="display: none"'):
        assert html_extract.main_text(f"<article><p>one <a {a}>two</a> end</p></article>") == "one\nend"


def test_html_keeps_what_an_id_names_and_all_parts():
    text = html_extract.main_text(
        '<article><h2 id="related-work">R</h2><section id="discussion"><p id=search>d</section>'
        '<div id="comments">c</div><div class="share">s</div></article>')
    assert text == "R\nd"
    for tag in ("article", "div class=content"):
        end = tag.split()[0]
        page = f"<body><{tag}><p>first part</{end}><{tag}><p>second</{end}><div><{tag}>x</{end}></div>"
        assert html_extract.main_text(page) == "first part\nsecond"
    formula = "<math><mi>x</mi><mo>=</mo><mn>2</mn></math>"
    assert html_extract.main_text(f"<article><p>let {formula} hold</article>") == "let x=2 hold"


def test_tree_matching():
    a = html_extract.slots(html_extract.parse("<div><p>1<p>2<ul><li>a<li>b</ul></div>"))[0]
    b = html_extract.slots(html_extract.parse("<h1>x</h1><div><p>3<p>4<p>5<b>i</b></div>"))[0]
    pairs = []
    assert html_extract.match(a, b, pairs) == 2
    assert {x.sign for x, _ in pairs} == {"div", "p"}


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op10_toxicity"](spark, sf).where("held_out").join(
        load(spark, sf, "labels"), "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    good = [r.score for r in rows if not r.toxic]
    bad = [r.score for r in rows if r.toxic]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.75


def test_sample_is_not_lowered():
    assert toxicity.Model().per_label >= 4000


def test_unseen_misspellings():
    words = ["idiot", "moron", "stupid", "pathetic"]
    rng = np.random.default_rng(0)
    plain = ["house", "river", "garden", "window", "yellow", "paper", "market", "summer"]
    samples, labels = [], []
    for k in range(200):
        w = list(rng.choice(plain, 30))
        if k % 2:
            w[3], w[9] = rng.choice(words, 2)
        samples.append(" ".join(w))
        labels.append(k % 2)
    made = list(toxicity.bags(pa.array(samples)))
    score = toxicity.scorer(*toxicity.train(made, labels, toxicity.Model(epochs=60)))
    plain_text = list(rng.choice(plain, 28))
    bad, good = score(pa.array([
        " ".join([*plain_text, "idiiot", "stupidd", "moronn", "patheticc"]), " ".join([*plain_text, "rivver", "gardden"])
    ])).to_pylist()
    assert bad > 0.5 > good


def test_repeated_labelled_ids_send_one_bag(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(1, "bad bad idiot")] * 40 + [(2, "fine day")] * 3 + [(3, "calm sea")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, label int")
    seen = []
    plain = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda b, y, *rest: seen.append(list(y)) or plain(b, y, *rest))
    toxicity.fit(docs, labels)
    assert sorted(seen[0]) == [0, 0, 1]


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = load(spark, SMALL, "documents")
    columns = docs.columns
    for k, (_, fn) in enumerate(corpus_pipeline.STAGES):
        out = fn(spark, docs, SMALL)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        docs = out.persist()
        assert docs.count()
