"""Benchmark decontamination: BM25 retrieval of test items for every training passage.

The test items form an inverted index of normalized words (lower case, outer punctuation off)
with BM25 impacts, each divided by what the item scores against itself, so that a passage that
holds a whole item scores 1 whatever its length. A word's rarity is counted over the passages of
the whole corpus: a benchmark is too small to tell common words. Items lie in blocks, and every
word keeps its largest impact in each block. A training text is cut into overlapping windows, long
enough that every item fits into one; the windows are the queries.

Block-max WAND, over all windows of a batch at once: the words of a window are ordered by their
largest impact, and the pivot is the word at which the running sum of these reaches the threshold.
Words before it cannot reach it together, so only the postings from the pivot on are walked, which
are those of the window's rarest words; blocks they do not name are never looked at. The sum of
block maxima then bounds every score in a block, so blocks whose bound stays below the threshold
are skipped and only the others are scored in full. All (window, item) pairs at or above the threshold go to verification: the item's
question and its answer must both be found in the window, by the share of their word trigrams.

The index is built in shards of at most `Search.shard_words` words, and each shard is broadcast by
itself, so what is broadcast is bounded; a larger benchmark means more passes over the texts. The
length of the windows and the mean length of an item are those of the whole benchmark, so the hits
do not depend on how it is cut.

Null and empty texts match nothing, items without words are not indexed, repeated rows and ids
are reported row by row (equal rows once), empty tables give no rows.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from retentia.llm.common import as_strings, bounded_batches, split_words

PUNCTUATION = ".,;:!?\"'()[]{}<>|*#%&$«»“”„‘’…-–—_/\\`"


@dataclass(frozen=True)
class Search:
    k1: float = 1.2
    b: float = 0.75
    #: Least score of a retrieved item, as a share of its score against itself.
    threshold: float = 0.5
    #: Least shares of question and answer trigrams that must be found.
    question: float = 0.5
    answer: float = 0.5
    block: int = 16
    shortest_window: int = 64
    shard_words: int = 50_000


def normal_words(array):
    """Normalized words of each text, in one array, and the bounds of each text's words."""
    words, bounds = split_words(pc.utf8_lower(as_strings(array)))
    bare = pc.utf8_trim(words, characters=PUNCTUATION)
    full = pc.greater(pc.binary_length(bare), 0)
    seen = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    return bare.filter(full), seen[bounds]


def split_item(text):
    """(question, answer) of an item that comes as one text: its last sentence is the answer.

    A single sentence is cut at three quarters of its words.
    """
    words = text.split()
    ends = [k + 1 for k, w in enumerate(words[:-1]) if w[-1] in ".?!:"]
    cut = ends[-1] if ends else max(1, len(words) * 3 // 4)
    return " ".join(words[:cut]), " ".join(words[cut:])


class Index:
    """Postings of one shard of items: words, impacts by item, maxima by block."""

    def __init__(self, items, search, extent=None):
        """items: (item_id, question, answer); extent: longest and mean number of words of all
        items of the benchmark, of these if not given. `weigh` completes the index."""
        self.search = search
        self.ids = [i for i, _, _ in items]
        parts = []
        for side in (1, 2):
            words, bounds = normal_words(pa.array([x[side] or "" for x in items], pa.string()))
            words = words.to_pylist()
            parts.append([words[a:b] for a, b in zip(bounds[:-1], bounds[1:])])
        texts = [q + a for q, a in zip(*parts)]
        self.terms = sorted({w for t in texts for w in t})
        code = {w: k for k, w in enumerate(self.terms)}
        self.words = [np.array([code[w] for w in t], np.int64) for t in texts]
        cuts = [len(q) for q in parts[0]]
        self.grams = [
            (_grams(t[:c]), _grams(t[c:])) for t, c in zip(self.words, cuts)
        ]
        lengths = [len(t) for t in texts]
        longest, self.mean = extent or (max(lengths), sum(lengths) / len(lengths))
        self.span = max(search.shortest_window, longest)

    def weigh(self, counts, passages):
        """Impacts and block maxima, from the passages that each word occurs in and all passages.

        A word that occurs in no passage counts as occurring in none, which is the rarest.
        """
        search, n = self.search, len(self.words)
        lengths = np.array([len(t) for t in self.words], float)
        idf = np.log1p((passages - counts + 0.5) / (counts + 0.5))
        rows, cols, impacts = [], [], []
        for k, t in enumerate(self.words):
            used, tf = np.unique(t, return_counts=True)
            gain = idf[used] * tf * (search.k1 + 1) / (
                tf + search.k1 * (1 - search.b + search.b * lengths[k] / max(self.mean, 1e-9)))
            rows.append(used)
            cols.append(np.full(len(used), k))
            impacts.append(gain / gain.sum())
        rows, cols, impacts = (np.concatenate(x) for x in (rows, cols, impacts))
        # postings by block of items
        order = np.lexsort((rows, cols // search.block))
        self.post_terms, self.post_items = rows[order], cols[order]
        self.impacts = impacts[order].astype(np.float32)
        self.blocks = -(-n // search.block)
        self.starts = np.searchsorted(self.post_items // search.block, np.arange(self.blocks + 1))
        # block maxima of each word, as postings by (word, block)
        keys = self.post_terms * self.blocks + self.post_items // search.block
        order = np.argsort(keys, kind="stable")
        self.block_keys, first = np.unique(keys[order], return_index=True)
        self.block_max = np.maximum.reduceat(self.impacts[order], first) if len(first) else (
            self.impacts)
        self.term_starts = np.searchsorted(
            self.block_keys, np.arange(len(self.terms) + 1) * self.blocks)
        self.top = np.zeros(len(self.terms))
        np.maximum.at(self.top, self.post_terms, self.impacts)
        return self

    def codes(self, array):
        """Codes of the normalized words of texts (-1: not in the index), and their bounds."""
        words, bounds = normal_words(array)
        codes = pc.index_in(words, pa.array(self.terms, words.type))
        return pc.fill_null(codes, -1).to_numpy(zero_copy_only=False).astype(np.int64), bounds

    def scores(self, terms, firsts, block):
        """Scores of the items of a block against sets of words, which begin at `firsts`."""
        size = self.search.block
        a, b = self.starts[block], self.starts[block + 1]
        dense = np.zeros((len(self.terms), size), np.float32)
        dense[self.post_terms[a:b], self.post_items[a:b] - block * size] = self.impacts[a:b]
        return np.add.reduceat(dense[terms], firsts, axis=0)


def _grams(codes):
    """Word trigrams as a set of tuples; shorter texts are one gram."""
    n = min(3, len(codes))
    return {tuple(codes[k : k + n].tolist()) for k in range(len(codes) - n + 1)} if n else set()


def _share(wanted, codes):
    """Share of the wanted grams found in a window of word codes."""
    if not wanted:
        return 1.0
    n = len(next(iter(wanted)))
    have = {tuple(codes[k : k + n].tolist()) for k in range(len(codes) - n + 1)}
    return len(wanted & have) / len(wanted)


def windows(bounds, span):
    """Bounds of windows of 2 * span words, one beginning at every span words of each text."""
    sizes = np.diff(bounds)
    # the last stretch of a text belongs to the window before it
    n = np.maximum(-(-sizes // span) - 1, (sizes > 0).astype(np.int64))
    text = np.repeat(np.arange(len(sizes)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = bounds[text] + place * span
    return text, starts, np.minimum(starts + 2 * span, bounds[text + 1])


def _ranges(starts, ends):
    """All positions of the ranges, and which range each belongs to."""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def passage_counts(array, index):
    """In how many stretches of `span` words each word of the index occurs, and all stretches."""
    codes, bounds = index.codes(array)
    sizes = np.diff(bounds)
    n = -(-sizes // index.span)
    place = np.arange(len(codes)) - np.repeat(bounds[:-1], sizes)
    stretch = place // index.span + np.repeat(np.cumsum(n) - n, sizes)
    known = codes >= 0
    pairs = np.unique(stretch[known] * len(index.terms) + codes[known])
    return np.bincount(pairs % len(index.terms), minlength=len(index.terms)), int(n.sum())


def weighed(docs, index):
    """The index with the rarity of its words counted over all passages of the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        total, passages = 0, 0
        for batch in batches:
            counts, n = passage_counts(batch.column("_text"), shared.value)
            total, passages = total + counts, passages + n
        counts = np.append(total if passages else np.zeros(len(shared.value.terms), int), passages)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(counts[at])], names=["term", "n"])

    # one row per word of the shard at most, however many documents there are
    rows = docs.select(F.col("`text`").alias("_text")).mapInArrow(run, "term long, n long")
    got = rows.groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(index.terms) + 1)
    counts[got.term.to_numpy(np.int64)] = got.n.to_numpy(float)
    return index.weigh(counts[:-1], counts[-1])


def retrieve(array, index):
    """(text, item, score, question share, answer share) of all verified hits of an array."""
    search = index.search
    codes, bounds = index.codes(array)
    text, starts, ends = windows(bounds, index.span)
    least = search.threshold - 1e-6
    # the distinct words of each window
    known = np.concatenate(([0], np.cumsum(codes >= 0)))
    window, at = _ranges(known[starts], known[ends])
    pairs = np.unique(window * len(index.terms) + codes[codes >= 0][at])
    window, terms = np.divmod(pairs, max(len(index.terms), 1))
    firsts = np.searchsorted(window, np.arange(len(starts) + 1))
    found = {}
    of_window, of_block = live_blocks(index, window, terms, firsts, least)
    for block in np.unique(of_block):
        live = of_window[of_block == block]
        _, at = _ranges(firsts[live], firsts[live + 1])
        sizes = firsts[live + 1] - firsts[live]
        scores = index.scores(terms[at], np.cumsum(sizes) - sizes, block)
        for x, k in zip(*np.nonzero(scores >= least)):
            item, w = int(block) * search.block + int(k), live[x]
            question, answer = index.grams[item]
            inside = codes[starts[w] : ends[w]]
            q, a = _share(question, inside), _share(answer, inside)
            if q >= search.question and a >= search.answer:
                hit = (float(scores[x, k]), q, a)
                key = (int(text[w]), item)
                found[key] = max(found.get(key, hit), hit)
    return [(t, index.ids[i], *hit) for (t, i), hit in sorted(found.items())]


def live_blocks(index, window, terms, firsts, least, most=4_000_000):
    """(window, block) where the sum of block maxima reaches the threshold, by window.

    window, terms: distinct words of the windows, which begin at `firsts`. Bounds are summed for
    so many candidates at a time that they need at most `most` numbers.
    """
    # sums of rounded numbers may come out a little lower than the score
    least = least - 1e-5
    order = np.lexsort((index.top[terms], window))
    sums = np.concatenate(([0.0], np.cumsum(index.top[terms][order])))
    # from the pivot on: the running sum within the window reaches the threshold
    walked = order[sums[1:] - sums[firsts[window[order]]] >= least]
    owner, at = _ranges(index.term_starts[terms[walked]], index.term_starts[terms[walked] + 1])
    named = np.unique(window[walked][owner] * index.blocks + index.block_keys[at] % index.blocks)
    of_window, of_block = np.divmod(named, max(index.blocks, 1))
    sizes = firsts[of_window + 1] - firsts[of_window]
    part = np.cumsum(sizes) // most
    keep = np.zeros(len(named), bool)
    for k in np.unique(part):
        some = np.flatnonzero(part == k)
        w = of_window[some]
        owner, at = _ranges(firsts[w], firsts[w + 1])
        keys = terms[at] * index.blocks + of_block[some][owner]
        place = np.minimum(np.searchsorted(index.block_keys, keys), len(index.block_keys) - 1)
        gain = np.where(index.block_keys[place] == keys, index.block_max[place], 0.0)
        keep[some] = np.bincount(owner, weights=gain, minlength=len(some)) >= least
    return of_window[keep], of_block[keep]


def _lengths(batches):
    """Number of normalized words of each item that is not blank."""
    for batch in batches:
        sides = [as_strings(batch.column(c)) for c in ("question", "answer")]
        pairs = [
            (q or "", a) if a is not None else split_item(q or "")
            for q, a in zip(*(x.to_pylist() for x in sides))]
        pairs = [p for p in pairs if p[0].strip() or p[1].strip()]
        sizes = sum(
            np.diff(normal_words(pa.array([p[k] for p in pairs], pa.string()))[1]) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], names=["n"])


def shards(benchmark, search=Search()):
    """Indexes over the items, each of a bounded number of words; they stream to the driver."""
    columns = [F.col("`item_id`").alias("item_id")]
    if {"question", "answer"} <= set(benchmark.columns):
        columns += [F.col("`question`").alias("question"), F.col("`answer`").alias("answer")]
    else:
        columns += [F.col("`text`").alias("question"), F.lit(None).cast("string").alias("answer")]
    items = benchmark.select(*columns)
    extent = items.select("question", "answer").mapInArrow(_lengths, "n long").agg(
        F.max("n"), F.avg("n")).first()
    held, size = [], 0
    for r in items.orderBy("item_id").toLocalIterator():
        question, answer = r.question or "", r.answer
        if answer is None:
            question, answer = split_item(question)
        if not (question.strip() or answer.strip()):
            continue
        held.append((r.item_id, question, answer))
        size += len(question.split()) + len(answer.split())
        if size >= search.shard_words:
            yield Index(held, search, tuple(extent))
            held, size = [], 0
    if held:
        yield Index(held, search, tuple(extent))


def hits(docs, benchmark, search=Search(), keys=("doc_id",)):
    """One row per (document row, item) that is verified: keys, item_id, score, shares."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kinds = dict(docs.dtypes)
    item = dict(benchmark.dtypes)["item_id"]
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    schema += f", item_id {item}, score double, question_share double, answer_share double"
    rows = docs.select(*[F.col(f"`{k}`") for k in keys], F.col("`text`").alias("_text"))
    out = None
    for index in shards(benchmark, search):
        index = weighed(docs, index)
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                got = retrieve(batch.column("_text"), shared.value)
                at = pa.array([t for t, *_ in got], pa.int64())
                cols = [batch.column(k).take(at) for k in keys]
                ids = pa.array([i for _, i, *_ in got], _arrow(item))
                rest = [pa.array([g[k] for g in got], pa.float64()) for k in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays(
                    [*cols, ids, *rest],
                    names=[*keys, "item_id", "score", "question_share", "answer_share"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.distinct()


def _arrow(kind):
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _clean(text, shared):
    """Whether a text column holds no item of a shared index."""

    @F.arrow_udf("boolean")
    def is_clean(texts: pa.Array) -> pa.Array:
        out = np.ones(len(texts), bool)
        out[[t for t, *_ in retrieve(texts, shared.value)]] = False
        return pa.array(out)

    return is_clean(text)


def without_leaks(docs, benchmark, search=Search()):
    """The documents, all columns, that hold no item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    clean = F.lit(True)
    for index in shards(benchmark, search):
        index = weighed(docs, index)
        clean = clean & _clean(F.col("`text`"), spark.sparkContext.broadcast(index))
    return docs.where(clean)
