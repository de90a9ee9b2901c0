"""Main text of web pages by wrapper induction over the pages of a host.

Every page becomes a tree of nodes (tag, class and id) with texts. Per host one page is the
pivot: a page with the most nodes, the least digest on ties. Simple tree matching aligns every
page of the host with the pivot: a matched pair of nodes counts one plus the best order-preserving
matching of its children, plus one for each text they share. Runs of children with one signature
(list items, paragraphs) are aligned as one, which keeps alignments small and pages of different
length alike; counted are the single nodes of the aligned runs. The alignment is exact for lists
and trees of any length and depth: rows of its table are made anew from every root-th one, so its
memory grows with the root of the shorter way. Counting over all pages of the host how often a slot
of the wrapper is filled and how often with each text tells constant nodes (template) from varying
ones (content): a slot may hold constant nodes beside varying ones. Pages that say the same outside
their clutter count once, whatever their titles, so copies of an article do not make it template.
The wrapper of a host is its constant texts by slot, and the slot its content lies in: the deepest
container that holds the given share of all varying text. Hosts with too few different pages have
none, and their pages are told by structure alone.

On a page, constant nodes and subtrees that are navigation, headers, footers, sidebars, adverts,
notices, forms, comments or code by tag, role, class or id are left out. A class or id is judged by
its whole tokens: "comments", "site-footer" and "ad-box" name clutter, "has-sidebar", "no-comments"
and "widget-spec" do not. Inside an article only containers are judged so, and adverts anywhere; an
element that holds the page's only article is never clutter by its class. The text is what is left
of the article (or main) and its siblings of the same kind; without such elements, of the content
slot of the wrapper with the headings before it; without a wrapper, of what is named as content, or
of the whole body: character references decoded, white space inside a block turned into one space,
blocks joined by line breaks in page order.

A null page is empty and gives an empty string; a null or broken URL belongs to the host ''.
Unclosed and misnested tags are repaired, a page that is cut off is read to its end, elements may
be nested as deeply as they like. Repeated rows and ids are extracted row by row; empty tables give
no rows; other columns are ignored.
"""

import hashlib
import html
import math
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import functions as F, types as T

from retentia.llm.common import as_strings, bounded_batches
from retentia.sources.staging import stage


@dataclass(frozen=True)
class Wrapper:
    #: Pages of different texts that fill a slot before it can be template.
    least_pages: int = 4
    #: Share of those pages that have one text in the slot.
    constant: float = 0.8
    #: Share of a host's varying text that its content slot holds. Above a half, so that the slots
    #: that hold so much lie in one another and the deepest is one.
    content: float = 0.8


# Elements by their role in HTML.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object".split())
INLINE = frozenset(
    "a abbr b bdi bdo cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr br big label "
    # formulas are words of their paragraph
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup "
    "msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction menclose "
    "semantics annotation annotation-xml".split())
CLUTTER = frozenset(
    "nav header footer aside form button select dialog menu script style noscript template "
    "textarea head svg iframe object canvas audio video fieldset annotation annotation-xml".split())
CLOSED_BY = {
    "p": frozenset(
        "p div ul ol dl table section article aside header footer nav form h1 h2 h3 h4 h5 h6 "
        "blockquote pre hr main figure address fieldset".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody"]),
    "th": frozenset(["td", "th", "tr", "tbody"]), "option": frozenset(["option"]),
}
CLUTTER_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert dialog menu menubar".split())
CLUTTER_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header footer masthead sidebar aside ad ads "
    "adv advert advertisement advertising banner sponsor sponsored promo promotion notice notices "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments reply replies "
    "respond disqus discussion widget pagination pager toolbar search skip hidden".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that can be the article by their class or id.
NAMED = frozenset("div section td".split())
#: Elements whose class or id tells clutter inside an article, too.
CONTAINERS = frozenset("div ul ol dl table".split())
#: Class words that tell clutter in any element of an article.
ADVERT_WORDS = frozenset("ad ads adv advert advertisement advertising sponsor sponsored".split())
MAIN_WORDS = frozenset("article post entry content story main body text".split())
#: Class words that say where or what kind of a box something is.
PLACE_WORDS = frozenset(
    "box area list block section wrapper wrap container bar site page top bottom left right inner "
    "outer primary secondary links items panel slot unit".split())
#: First words of class tokens that say how a page is laid out.
LAYOUT_WORDS = frozenset("has no not non with without is".split())
#: Elements whose own text is a sentence; a button in it is a word.
SENTENCES = frozenset("p li td th dd dt h1 h2 h3 h4 h5 h6 blockquote figcaption caption".split())
#: Elements that can hold the content of a host.
HOLDERS = frozenset("div section td body center span font main article".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
SPACES = re.compile(r"[\x09-\x0D\x20]+")
_WORD = re.compile(r"[a-z]+")

#: Texts are compared by their bytes as one number modulo a prime, so that the number of a node
#: follows from those of its children.
PRIME = 2**63 - 25


@lru_cache(1 << 16)
def judge(token):
    """(names clutter, names an advert, names the content) of one class or id."""
    words = _WORD.findall(token.replace("_", " "))
    told = [w for w in words if w in CLUTTER_WORDS]
    if not words or words[0] in LAYOUT_WORDS:
        return False, False, any(w in MAIN_WORDS for w in words)
    clutter = bool(told) and (
        words[-1] in CLUTTER_WORDS
        or words[0] in CLUTTER_WORDS and all(w in CLUTTER_WORDS or w in PLACE_WORDS for w in words))
    return clutter, clutter and bool(ADVERT_WORDS.intersection(words)), (
        not told and any(w in MAIN_WORDS for w in words))


class Node:
    """An element. inside: below an article; marked: clutter by its class or id; text: the number
    of its text; size: the bytes of it; block: whether it holds blocks."""

    __slots__ = (
        "tag", "sign", "children", "clutter", "marked", "named", "inside", "text", "size", "block")

    def __init__(self, tag, attributes="", inside=False):
        self.tag, self.children, self.inside = tag, [], inside
        self.sign, self.clutter, self.marked, self.named = tag, tag in CLUTTER, False, False
        if not attributes:
            return
        found = {}
        for name, value in ATTRIBUTE.findall(attributes):
            # the first of two attributes of one name holds
            found.setdefault(name.lower(), value.strip("\"'").lower())
        names = found.get("class", "")
        if names:
            self.sign = f"{tag}.{names}"
        self.clutter = (
            self.clutter
            or found.get("role") in CLUTTER_ROLES
            or "hidden" in found
            or found.get("aria-hidden") == "true"
            or "display:none" in found.get("style", "").replace(" ", "")
        )
        of_class = [judge(t) for t in names.split()]
        judged = of_class + [judge(t) for t in found.get("id", "").split()]
        self.named = tag in NAMED and any(main for _, _, main in judged)
        if tag in ("html", "body", "article", "main"):
            return
        if inside and tag not in CONTAINERS or tag in HEADINGS:
            self.marked = any(advert for _, advert, _ in of_class)
        else:
            self.marked = any(clutter for clutter, _, _ in judged)


def parse(page):
    """The tree of a page; children are nodes and strings."""
    root = Node("#")
    stack, at, raw = [root], 0, None
    depth = {}

    def close(k):
        for n in stack[k:]:
            depth[n.tag] -= 1
        del stack[k:]

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if depth.get(tag):
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in CLOSERS:
            for k in range(len(stack) - 1, 0, -1):
                # what an open inline element hides ends with its paragraph
                if tag in CLOSED_BY.get(stack[k].tag, ()):
                    close(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        attributes = m.group(3) or ""
        above = stack[-1]
        inside = above.inside or above.named or above.tag in ("article", "main")
        node = Node(tag, attributes, inside)
        above.children.append(node)
        if tag in RAW:
            raw = re.compile(rf"</{tag}\s*>?", re.I).search(page, at)
            # raw text is never content; without an end tag it goes on to the end
            at = raw.end() if raw else len(page)
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            depth[tag] = depth.get(tag, 0) + 1
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


CLOSERS = frozenset().union(*CLOSED_BY.values())


def clean(text):
    return SPACES.sub(" ", html.unescape(text)).strip(" ")


class Slot:
    """A run of nodes of one signature: their texts, the children of all of them as slots."""

    __slots__ = ("sign", "texts", "children", "path", "depth", "nodes")

    def __init__(self, sign, path, depth):
        self.sign, self.path, self.depth = sign, path, depth
        self.texts, self.children, self.nodes = set(), [], []


def _settle(order):
    """Decide what is clutter by its class: nothing that holds the only article of a page."""
    holds, free = set(), False
    above = {}
    for n in order:
        out = n.clutter or n.marked or above.get(id(n), False)
        free = free or n.tag in ("article", "main") and not out
        words = n.tag in SENTENCES and any(isinstance(c, str) and c.strip() for c in n.children)
        for c in n.children:
            if not isinstance(c, str):
                if out:
                    above[id(c)] = True
                if words and c.tag == "button" and not c.marked:
                    # read as any other inline element
                    c.tag, c.clutter = "span", False
    if not free:
        for n in reversed(order):
            if n.tag in ("article", "main") or any(id(c) in holds for c in n.children):
                if not n.clutter:
                    holds.add(id(n))
    for n in order:
        n.clutter = n.clutter or n.marked and id(n) not in holds


def annotate(root):
    """Give every node its text as the wrapper compares it, and whether it holds blocks."""
    order = [root]
    for n in order:
        order += [c for c in n.children if not isinstance(c, str)]
    _settle(order)
    for n in reversed(order):
        code = size = 0
        n.block = False
        for c in n.children:
            if isinstance(c, str):
                raw = clean(c).encode("utf-8", "replace")
                more, length = int.from_bytes(raw, "big") % PRIME, len(raw)
            else:
                n.block = n.block or c.block or c.tag not in INLINE
                if c.tag in RAW or c.clutter:
                    continue
                more, length = c.text, c.size
            if not length:
                continue
            if size:
                # a space between two parts
                code = ((code * 256 + 32) * pow(256, length, PRIME) + more) % PRIME
                size += length + 1
            else:
                code, size = more, length
        n.text, n.size = code, size
    return root


@lru_cache(1 << 16)
def _sign_code(sign):
    return hash_text(sign)


def _below(path, sign):
    return hash((path, _sign_code(sign)))


def slots(node):
    """The slots below a node and the texts of its children: neighbours of one signature run
    together. Only nodes that blocks() asks for are slots."""
    top = Slot("", 0, 0)
    top.nodes = [annotate(node)]
    held = [top]
    for slot in held:
        for c in (c for n in slot.nodes for c in n.children):
            if isinstance(c, str) or c.tag in RAW or c.clutter or c.tag in INLINE and not c.block:
                continue
            if not slot.children or slot.children[-1].sign != c.sign:
                slot.children.append(Slot(c.sign, _below(slot.path, c.sign), slot.depth + 1))
            slot.children[-1].nodes.append(c)
        for c in slot.children:
            c.texts = {n.text for n in c.nodes if n.size}
        held += slot.children
    return top.children, set().union(*(c.texts for c in top.children))


class _Table:
    """The table of best matchings of two lists of slots, row by row."""

    def __init__(self, x, y, worth):
        self.x, self.y, self.worth = x, y, worth
        self.signs, self.texts = {}, {}
        for j, q in enumerate(y):
            self.signs.setdefault(q.sign, []).append(j)
            for t in q.texts:
                self.texts.setdefault((q.sign, t), []).append(j)
        self.first = [0] * (len(y) + 1)

    def next(self, p, above):
        js = self.signs.get(p.sign)
        if js is None:
            return above
        # of several runs of one signature the one with the same texts is the same
        shared = {}
        for t in p.texts:
            for j in self.texts.get((p.sign, t), ()):
                shared[j] = shared.get(j, 0) + 1
        row, inner = above[:], p.children
        for j in js:
            gain = above[j] + 1 + shared.get(j, 0)
            if inner and self.y[j].children:
                gain += self.worth[id(inner), id(self.y[j].children)]
            if gain > row[j + 1]:
                row[j + 1] = gain
        return list(accumulate(row, max))

    def best(self):
        row = self.first
        for p in self.x:
            row = self.next(p, row)
        return row[-1]

    def chosen(self):
        """The matched pairs: every root-th row is kept, the others are made anew behind it."""
        step = math.isqrt(len(self.x)) + 1
        kept, row = [self.first], self.first
        for i, p in enumerate(self.x, 1):
            row = self.next(p, row)
            if i % step == 0:
                kept.append(row)
        j = len(self.y)
        for k in reversed(range(len(kept))):
            part, rows = self.x[k * step : (k + 1) * step], [kept[k]]
            for p in part:
                rows.append(self.next(p, rows[-1]))
            for i in range(len(part), 0, -1):
                here, above = rows[i], rows[i - 1]
                while j and here[j] != above[j]:
                    j -= 1
                    if here[j] != here[j + 1]:
                        yield part[i - 1], self.y[j]
                        break


def match(a, b, pairs):
    """Simple tree matching of two lists of slots; appends the matched (pivot, page) slots."""
    # the lists that can meet, from the top; then their scores, from the leaves
    lists = [(a, b)]
    for x, y in lists:
        of = {}
        for q in y:
            if q.children:
                of.setdefault(q.sign, []).append(q)
        for p in x:
            if p.children:
                lists += [(p.children, q.children) for q in of.get(p.sign, ())]
    worth = {}
    for x, y in reversed(lists):
        worth[id(x), id(y)] = _Table(x, y, worth).best()
    todo = [(a, b)]
    while todo:
        for p, q in _Table(*todo.pop(), worth).chosen():
            pairs.append((p, q))
            if p.children and q.children:
                todo.append((p.children, q.children))
    return worth[id(a), id(b)]


def hash_text(text):
    code = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest()
    return int.from_bytes(code, "little", signed=True)


def _filled(path, text):
    """A slot with a text, as one number: a hash of numbers is the same in every task."""
    return hash((path, text))


_ALIGNED = "host string, slot long, text long, page long, size long, depth int"


def _aligned(batches):
    """(host, slot, slot with a text, page, bytes, depth) for every node aligned with the pivot; a
    slot that is filled has one row without a text besides, with the bytes of all its texts and
    its depth if it can hold the content. Pages go by the number of their text."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    for batch in batches:
        out, pivot, tree = [], None, None
        for host, page, of in zip(
            batch.column("host").to_pylist(), as_strings(batch.column("html")).to_pylist(),
            as_strings(batch.column("pivot")).to_pylist(),
        ):
            if pivot != (host, of):
                pivot, tree = (host, of), slots(parse(of))[0]
            root = parse(page)
            pairs, texts, filled = [], {}, {}
            match(tree, slots(root)[0], pairs)
            for _, b in pairs:
                if b.texts:
                    holder = any(n.block and n.tag in HOLDERS for n in b.nodes)
                    size, depth = filled.get(b.path, (0, 0))
                    filled[b.path] = (
                        size + sum(n.size for n in b.nodes), b.depth if holder else depth)
                    texts.update(((b.path, n.text), n.size) for n in b.nodes if n.size)
            # the slot itself counts the pages that fill it
            out += [(host, p, None, root.text, s, d) for p, (s, d) in filled.items()]
            out += [(host, p, _filled(p, t), root.text, s, 0) for (p, t), s in texts.items()]
        cols = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds)],
            names=["host", "slot", "text", "page", "size", "depth"])


def host_of(url):
    """The host of a URL column; '' if there is none."""
    name = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(name)


def wrappers(pages, conf=Wrapper()):
    """host, the hashes of its constant texts (template) and its content slot, for hosts with enough
    pages.

    pages: host, html.
    """
    size = F.regexp_count("html", F.lit("<[a-zA-Z]"))
    digest = F.xxhash64("html")
    # one page per host, by a maximum that combines before the shuffle
    pivots = pages.groupBy("host").agg(
        F.count("*").alias("n"), F.max(F.struct(size.alias("s"), digest.alias("d"))).alias("p"))
    pivots = stage(pivots.where(F.col("n") >= conf.least_pages).select("host", "p.d"), "html-pivots")
    chosen = pages.select("host", "html", digest.alias("d")).join(pivots, ["host", "d"])
    # equal pages of a host share the digest: one is enough
    chosen = stage(chosen.groupBy("host").agg(F.first("html").alias("pivot")), "html-pivot-pages")
    # a host with many pages is split by the join, as its pivot is one row
    pairs = pages.join(chosen, "host").select("host", "html", "pivot")
    aligned = pairs.mapInArrow(_aligned, _ALIGNED)
    # a text and a page are numbers of their content, so their sizes are equal where they are
    counted = stage(
        aligned.groupBy("host", "slot", "text", "page").agg(
            F.max("size").alias("size"), F.max("depth").alias("depth"))
        .groupBy("host", "slot", "text")
        .agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.max("depth").alias("depth"))
        .where(F.col("n") >= conf.least_pages), "html-counts")
    filled = counted.where("text is null").select(
        "host", "slot", F.col("n").alias("filled"), F.col("size").alias("all"), "depth")
    constant = counted.where("text is not null").select("host", "slot", "text", "n", "size").join(
        filled.select("host", "slot", "filled"), ["host", "slot"]).where(
        F.col("n") >= conf.constant * F.col("filled"))
    # a page that fills a slot has few nodes in it, so a host's template is about a page's size
    templates = constant.groupBy("host").agg(F.collect_set("text").alias("template"))
    fixed = constant.groupBy("host", "slot").agg(F.sum("size").alias("fixed"))
    varying = filled.join(fixed, ["host", "slot"], "left").select(
        "host", "slot", "depth", (F.col("all") - F.coalesce("fixed", F.lit(0))).alias("varying"))
    most = varying.groupBy("host").agg(F.max("varying").alias("most"))
    holders = varying.join(most, "host").where(
        (F.col("depth") > 0) & (F.col("varying") > 0)
        & (F.col("varying") >= conf.content * F.col("most")))
    content = holders.groupBy("host").agg(
        F.max(F.struct("depth", "varying", "slot"))["slot"].alias("content"))
    return stage(templates.join(content, "host", "full"), "html-wrappers")


def _find_main(root, content=None):
    """The nodes that hold the article and their paths: article, main, the content slot of the
    wrapper with the headings before it, what is named so, or all.

    An article in several parts is several siblings, all of which are kept in page order.
    """
    articles, mains, named, slot = [], [], [], []
    todo = [(root, 0, root)]
    while todo:
        n, path, of = todo.pop()
        if n.tag == "article" and not n.inside:
            articles.append((n, path, of))
        elif n.tag == "main":
            mains.append((n, path, of))
        elif n.named:
            named.append((n, path, of))
        if path == content and content is not None:
            slot.append((n, path, of))
        below = [c for c in n.children if not isinstance(c, str) and not c.clutter]
        todo += [(c, _below(path, c.sign), n) for c in reversed(below)]
    for found in (articles, mains, slot, named):
        if found is slot and slot:
            return _with_headings(slot)
        # teasers of other articles are short beside the article and lie elsewhere
        sizes = [n.size for n, _, _ in found]
        if any(sizes):
            parent = found[sizes.index(max(sizes))][2]
            return [(n, at) for n, at, of in found if of is parent]
    return [(root, 0)]


def _with_headings(slot):
    """The nodes of a content slot with the headings that stand before the first of them."""
    (first, path, of), before = slot[0], []
    for c in of.children:
        if c is first:
            break
        if not isinstance(c, str) and c.tag in HEADINGS and not c.clutter:
            before.append((c, None))
    return before + [(n, at) for n, at, _ in slot]


def blocks(node, path=0, template=frozenset()):
    """Texts of the blocks of a subtree in page order, without clutter and template."""
    out, held = [], []

    def close():
        text = clean("".join(held))
        held.clear()
        if text:
            out.append(text)

    todo = [(iter(node.children), path, True)]
    while todo:
        children, path, closes = todo[-1]
        for c in children:
            if isinstance(c, str):
                held.append(c)
            elif c.tag == "br":
                held.append(" ")
            elif c.tag in RAW or c.clutter:
                close()
            elif c.tag in INLINE and not c.block:
                # no slots lie below
                todo.append((iter(c.children), path, False))
                break
            else:
                close()
                at = _below(path, c.sign)
                if not template or _filled(at, c.text) not in template:
                    todo.append((iter(c.children), at, True))
                    break
        else:
            todo.pop()
            if closes:
                close()
    return out


def main_text(page, template=frozenset(), content=None):
    found = _find_main(annotate(parse(page)), content)
    return "\n".join(t for node, path in found for t in blocks(node, path, template))


@F.arrow_udf(T.StringType())
def extract(pages: pa.Array, templates: pa.Array, contents: pa.Array) -> pa.Array:
    out = [
        main_text(page, frozenset(template or ()), content)
        for page, template, content in zip(
            as_strings(pages).to_pylist(), templates.to_pylist(), contents.to_pylist())
    ]
    return pa.array(out, pa.string())


def main_texts(pages, conf=Wrapper()):
    """page_id, url, text and n_chars of every page."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(
        F.col("`page_id`").alias("page_id"), F.col("`url`").alias("url"),
        F.coalesce(F.col("`html`"), F.lit("")).alias("html"),
        host_of(F.col("`url`")).alias("host"))
    found = wrappers(rows.select("host", "html"), conf)
    out = rows.join(found, "host", "left").select(
        "page_id", "url", extract("html", "template", "content").alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
