"""Ranked lexical search: exact top documents by sparse inner products, over ball trees.

The score of a document for an item is the inner product of the item's integer term weights and the
document's integer term values (see `searched`). Documents are gathered, as they are read, into
trees of a bounded number of documents. A node of a tree is a ball: the centroid of its documents'
vectors and the radius around it. No document of a ball scores more than

    weights . centroid + |weights| * radius,

so the search opens the balls of a tree best first and ends when the best bound left is below the
worst score kept. Centroids are rounded before the radius is measured, and radius and bound are
rounded upwards, so rounding never prunes a document that belongs to the result; balls whose bound
equals the worst score are pruned only if all their ids come after the worst id kept. Leaves are
scored in 64-bit integers.

Where the work is: one pass over the texts keeps, of each document, its length and those terms that
may occur in an item (a filter of bits of fixed size, built by Spark, decides; terms that slip
through are in no item and score nothing). Document counts come from one aggregate. Trees are built
in the tasks that read these vectors and stored. The items, as a stated query set in blocks, meet
every tree; a first round over a few trees gives each item a score that its tenth document reaches,
so later trees start with a bound and send few rows.

Terms are known by 64-bit hashes: two of a million terms agree with a chance of 3e-8.

Null and empty texts have no terms: such documents count for nothing and are never returned, such
items have no rows. Very long texts are split like others; one never spans two trees. Equal scores
go by ascending doc_id, null ids last; rows that repeat an id are documents of their own, and items
that repeat an id are ranked one by one. No documents or no items give no rows. Only doc_id,
item_id and text are read, so further columns may have any name.
"""

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window, functions as F

from retentia.llm.common import (
    as_strings, bounded_batches, hash_words, split_words, with_rows, word_codes,
)
from retentia.sources.staging import stage

TOP = 10
FILTER_BITS = 1 << 23
TREE_DOCS, TREE_ENTRIES = 4096, 1 << 20
LEAF = 128
BLOCK_ITEMS = 256
SEED_TREES = 4
BLOCKS_HELD = 16  # blocks of items whose best scores a task carries from tree to tree
LAST = np.iinfo(np.int64).max  # stands for a null id, which comes last

# bytes of terms: digits and letters, these in lower case, and all that is not ASCII
_TERM_BYTES = np.full(256, 0x20, np.uint8)
_TERM_BYTES[0x80:] = np.arange(0x80, 0x100)
for _first, _last, _to in ((0x30, 0x39, 0x30), (0x41, 0x5A, 0x61), (0x61, 0x7A, 0x61)):
    _TERM_BYTES[_first : _last + 1] = np.arange(_to, _to + _last - _first + 1)


def text_terms(array):
    """All terms of an array of texts in order, and the bounds of each text's terms (n + 1)."""
    array = as_strings(array).cast(pa.string())
    _, offsets, data = array.buffers()
    plain = _TERM_BYTES[np.frombuffer(data or b"", np.uint8)]
    return split_words(pa.Array.from_buffers(
        pa.string(), len(array), [None, offsets, pa.py_buffer(plain)], offset=array.offset))


def counted_terms(array, known=None):
    """Of each text: its number of terms, and hash and count of its distinct terms as lists.

    known: bits by hash; terms whose bit is not set are counted in the length only.
    """
    words, bounds = text_terms(array)
    codes, distinct = word_codes(words)
    hashes = hash_words(distinct).astype(np.uint64)
    rows = np.repeat(np.arange(len(array)), np.diff(bounds))
    if known is not None and len(hashes):
        held = known[(hashes % np.uint64(FILTER_BITS)).astype(np.int64)][codes]
        codes, rows = codes[held], rows[held]
    pairs, counts = np.unique(rows * max(1, len(hashes)) + codes, return_counts=True)
    ends = np.searchsorted(pairs, np.arange(len(array) + 1) * max(1, len(hashes)))
    offsets = pa.array(ends, pa.int32())
    terms = hashes[pairs % max(1, len(hashes))].view(np.int64) if len(pairs) else pairs
    return (
        pa.array(np.diff(bounds), pa.int64()),
        pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int64())),
        pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
    )


def _counted(df, id_col, known=None):
    """(id, n, terms, counts) of each row; known: packed bits of the filter."""

    def run(batches):
        bits = None if known is None else np.unpackbits(
            np.frombuffer(known, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            n, terms, counts = counted_terms(batch.column(1), bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), n, terms, counts], ["id", "n", "terms", "counts"])

    return df.select(F.col(id_col).cast("long").alias("id"), "text").mapInArrow(
        run, "id long, n long, terms array<long>, counts array<long>")


def term_filter(terms):
    """Packed bits of the hashes in a column `term`; the size is fixed."""
    at = F.col("term").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    rows = terms.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    size = 32768 // 8
    out = bytearray(FILTER_BITS // 8)
    for r in rows:
        out[(r.bucket - 1) * size : r.bucket * size] = r.bits
    return bytes(out)


# --- trees ---


def _entries(indptr, rows):
    """Positions of the entries of some rows, and the bounds of each row among them."""
    lengths = indptr[rows + 1] - indptr[rows]
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    return np.arange(bounds[-1]) + np.repeat(indptr[rows] - bounds[:-1], lengths), bounds


def _per_row(values, bounds):
    return np.add.reduceat(values, bounds[:-1]) if len(bounds) > 1 else np.zeros(0)


def build_tree(ids, indptr, terms, values):
    """A ball tree over sparse rows that all have entries; arrays of one row of the trees table.

    Rows are reordered so that each node is a range of them. A node splits at the median along the
    line through two far rows; balls of one point do not split.
    """
    vocabulary, cols = np.unique(terms, return_inverse=True)
    width, order, nodes, centres = len(vocabulary), np.arange(len(ids)), [], []
    squares = np.add.reduceat(values.astype(float) ** 2, indptr[:-1])
    dense = np.zeros(width)
    todo = [(0, len(ids), -1)]
    while todo:
        low, high, parent = todo.pop()
        rows = order[low:high]
        at, bounds = _entries(indptr, rows)
        c, v = cols[at], values[at].astype(float)
        centre = (np.bincount(c, v, width) / len(rows)).astype(np.float32)
        exact = centre.astype(float)
        norm = float(exact @ exact)
        apart = squares[rows] - 2 * _per_row(exact[c] * v, bounds) + norm
        # differences of large squares: allow for their rounding before the root
        radius = np.sqrt(np.maximum(apart, 0) + 1e-11 * (squares[rows] + norm)).max()
        me = len(nodes)
        nodes.append([low, high, 0, 0, np.nextafter(radius, np.inf), ids[rows].min()])
        held = np.flatnonzero(centre)
        centres.append((held, centre[held]))
        if parent >= 0:
            nodes[parent][2 if nodes[parent][2] == 0 else 3] = me
        if len(rows) <= LEAF or radius <= 1e-5 * np.sqrt(norm):
            continue

        def products(row):
            """Of the row with every row of the node."""
            one = slice(indptr[row], indptr[row + 1])
            dense[cols[one]] = values[one]
            out = _per_row(dense[c] * v, bounds)
            dense[cols[one]] = 0
            return out

        first = rows[apart.argmax()]
        from_first = products(first)
        second = rows[(squares[rows] - 2 * from_first).argmax()]
        line = np.argsort(from_first - products(second), kind="stable")
        order[low:high] = rows[line]
        middle = (low + high) // 2
        todo += [(middle, high, me), (low, middle, me)]
    at, bounds = _entries(indptr, order)
    low, high, left, right, radius, least = zip(*nodes)
    return {
        "vocabulary": vocabulary, "ids": ids[order], "bounds": bounds, "cols": cols[at],
        "vals": values[at], "low": low, "high": high, "left": left, "right": right,
        "radius": radius, "least": least,
        "c_bounds": np.concatenate(([0], np.cumsum([len(h) for h, _ in centres]))),
        "c_cols": np.concatenate([h for h, _ in centres]),
        "c_vals": np.concatenate([v for _, v in centres]),
    }


_TREE = {
    "vocabulary": pa.int64(), "ids": pa.int64(), "bounds": pa.int32(), "cols": pa.int32(),
    "vals": pa.int32(), "low": pa.int32(), "high": pa.int32(), "left": pa.int32(),
    "right": pa.int32(), "radius": pa.float64(), "least": pa.int64(), "c_bounds": pa.int32(),
    "c_cols": pa.int32(), "c_vals": pa.float32(),
}
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.float32(): "float"}
_TREE_SCHEMA = ", ".join(f"{k} array<{_SQL[v]}>" for k, v in _TREE.items())


def term_values(counts, lengths, n_docs, n_terms):
    """Value of a term in a document: saturating in its count, less in longer documents."""
    m = 100 - 75 + (75 * lengths * n_docs) // max(1, n_terms)
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


def trees(vectors, n_docs, n_terms):
    """Rows of trees over the documents that have a term; each holds a bounded number of them."""

    def grown(parts):
        ids, lengths, terms, counts, sizes = (np.concatenate(x) for x in zip(*parts))
        values = term_values(counts, np.repeat(lengths, sizes), n_docs, n_terms)
        tree = build_tree(ids, np.concatenate(([0], np.cumsum(sizes))), terms, values)
        return pa.RecordBatch.from_arrays(
            [pa.array([np.asarray(tree[k])], pa.list_(kind)) for k, kind in _TREE.items()], list(_TREE))

    def run(batches):
        parts, docs, entries = [], 0, 0
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("terms")), 0))
            at = 0
            while at < batch.num_rows:
                sizes = pc.list_value_length(batch.column("terms").slice(at)).to_numpy()
                room = int(np.searchsorted(np.cumsum(sizes), TREE_ENTRIES - entries, "right"))
                take = max(1, min(room, TREE_DOCS - docs, len(sizes)))
                some = batch.slice(at, take)
                parts.append((
                    pc.fill_null(some.column("id"), LAST).to_numpy(), some.column("n").to_numpy(),
                    some.column("terms").flatten().to_numpy(),
                    some.column("counts").flatten().to_numpy(), sizes[:take]))
                docs, entries, at = docs + take, entries + int(sizes[:take].sum()), at + take
                if docs >= TREE_DOCS or entries >= TREE_ENTRIES or at < batch.num_rows:
                    yield grown(parts)
                    parts, docs, entries = [], 0, 0
        if parts:
            yield grown(parts)

    return vectors.mapInArrow(run, _TREE_SCHEMA)


# --- search ---


class Kept:
    """The best documents of one item so far: scores and ids, best first, and a score that the
    last of the result is known to reach."""

    def __init__(self, floor, top):
        self.floor, self.top = floor, top
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.fresh = np.zeros(0, bool)  # what the tree at hand has brought

    def worst(self):
        """(score, id) that a document must come before; an id of null's rank excludes nothing."""
        if len(self.scores) == self.top and self.scores[-1] >= self.floor:
            return int(self.scores[-1]), int(self.ids[-1])
        return max(1, self.floor), None

    def offer(self, scores, ids):
        score, last = self.worst()
        ok = scores >= score
        if last is not None:
            ok &= (scores > score) | (ids < last)
        if ok.any():
            scores = np.concatenate((self.scores, scores[ok]))
            ids = np.concatenate((self.ids, ids[ok]))
            fresh = np.concatenate((self.fresh, np.ones(ok.sum(), bool)))
            best = np.lexsort((ids, -scores))[: self.top]
            self.scores, self.ids, self.fresh = scores[best], ids[best], fresh[best]


class Tree:
    """One row of the trees table, ready for search."""

    def __init__(self, row):
        self.__dict__.update(row)
        self.dense = np.zeros(len(self.vocabulary), np.int64)
        self.centres = np.zeros((len(self.low), len(self.vocabulary)), np.float32)
        node = np.repeat(np.arange(len(self.low)), np.diff(self.c_bounds))
        self.centres[node, self.c_cols] = self.c_vals
        self.opened = 0

    def search(self, terms, weights, kept):
        """Offer the documents of the tree to what is kept for one item."""
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        here = self.vocabulary[at] == terms
        at, w = at[here], weights[here]
        if not len(at):
            return
        wide = w.astype(float)
        bounds = self.centres[:, at].astype(float) @ wide + np.sqrt(wide @ wide) * self.radius
        bounds = bounds * (1 + 1e-9) + 1  # upwards, past the rounding of the sums
        self.dense[at] = w
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            score, last = kept.worst()
            if -bound < score:
                break
            if last is not None and np.floor(-bound) <= score and self.least[node] > last:
                continue
            if self.left[node]:
                for child in (self.left[node], self.right[node]):
                    heapq.heappush(heap, (-bounds[child], child))
            else:
                self._score(node, kept)
        self.dense[at] = 0

    def _score(self, node, kept):
        self.opened += 1
        low, high = self.low[node], self.high[node]
        first, end = self.bounds[low], self.bounds[high]
        part = self.dense[self.cols[first:end]] * self.vals[first:end]
        kept.offer(np.add.reduceat(part, self.bounds[low:high] - first), self.ids[low:high])


def _search_rows(top):
    """Function over batches of (tree, block) rows that yields the documents kept."""

    def run(batches):
        carried, tree, key = {}, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                lists = {k: batch.column(k)[i].values.to_numpy() for k in _TREE}
                me = (lists["ids"].tobytes(), lists["vocabulary"].tobytes())
                if me != key:
                    tree, key = Tree(lists), me
                block = batch.column("block")[i].as_py()
                if block not in carried:
                    if len(carried) >= BLOCKS_HELD:
                        carried.pop(next(iter(carried)))
                    floors = batch.column("floors")[i].values.to_numpy()
                    carried[block] = [Kept(int(f), top) for f in floors]
                ends = np.cumsum([0, *batch.column("sizes")[i].values.to_pylist()])
                terms = batch.column("q_terms")[i].values.to_numpy()
                weights = batch.column("q_weights")[i].values.to_numpy()
                items = batch.column("items")[i].values.to_numpy()
                out = []
                for j, kept in enumerate(carried[block]):
                    part = slice(ends[j], ends[j + 1])
                    kept.fresh[:] = False
                    tree.search(terms[part], weights[part], kept)
                    out += [
                        (items[j], None if d == LAST else d, s)
                        for d, s in zip(kept.ids[kept.fresh].tolist(), kept.scores[kept.fresh].tolist())
                    ]
                item, doc, score = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in (item, doc, score)],
                    ["item", "doc_id", "score"])

    return run


def item_terms(items):
    """(item, item_id, term, times) of each item; `item` numbers the rows."""
    numbered = with_rows(items, [F.col("item_id").cast("long").alias("item_id"), "text"])
    ids = numbered.select(F.col("_row").alias("item"), "item_id")
    terms = _counted(numbered, "_row").select(
        F.col("id").alias("item"), F.inline(F.arrays_zip("terms", "counts")))
    return ids, terms.toDF("item", "term", "times")


def term_weights(vectors, n_docs):
    """Weight of each term that a document holds: more for terms of fewer documents."""
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").count()
    ratio = (F.lit(2.0 * n_docs + 2) / (2.0 * F.col("count") + 1)).cast("double")
    return held.select("term", F.floor(1000 * F.ln(ratio)).cast("long").alias("weight"))


def item_blocks(weighted, n_items):
    """Rows of up to about BLOCK_ITEMS items each, from (item, term, weight, floor)."""
    one = weighted.groupBy("item").agg(
        F.max("floor").alias("floor"), F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("q"))
    block = F.pmod(F.xxhash64("item"), F.lit(max(1, -(-n_items // BLOCK_ITEMS)))).alias("block")
    rows = one.groupBy(block).agg(F.sort_array(F.collect_list(F.struct("item", "floor", "q"))).alias("r"))
    sizes = F.transform("r", lambda x: F.size(x.q))
    flat = F.flatten(F.col("r.q"))
    return rows.select(
        "block", F.col("r.item").alias("items"), F.col("r.floor").alias("floors"), sizes.alias("sizes"),
        flat["term"].alias("q_terms"), flat["weight"].alias("q_weights"))


def _best(found, top):
    """The first rows per item: highest score, then least id, null ids last."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def searched(docs, items, top=TOP):
    """(item_id, rank, doc_id, score): for each item its best documents with a score above 0.

    With n_docs documents that have terms, n_terms terms in all, n terms in a document, df
    documents that hold a term and tf of it in a document, an item's occurrence of a term adds
    floor(1000 ln((2 n_docs + 2) / (2 df + 1))) * (10^9 tf div (1000 tf + 8 m)),
    m = 25 + 75 n n_docs div n_terms.
    """
    bounded_batches(docs.sparkSession)
    ids, terms = item_terms(items)
    terms = stage(terms, "item-terms")
    known = term_filter(terms.select("term").distinct())
    vectors = stage(_counted(docs, "doc_id", known), "vectors")
    n_docs, n_terms = vectors.agg(
        F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = term_weights(vectors, n_docs)
    weighted = stage(
        terms.join(weights, "term").select(
            "item", "term", (F.col("weight") * F.col("times")).alias("weight")).where("weight > 0"),
        "weights")
    n_items = ids.count()
    grown = stage(trees(vectors, n_docs, n_terms), "trees")

    def search(some, floors):
        blocks = item_blocks(weighted.join(floors, "item", "left").select(
            "item", "term", "weight", F.coalesce("floor", F.lit(1)).alias("floor")), n_items)
        # items are a stated query set: every block of them meets every tree
        pairs = some.crossJoin(blocks)
        return pairs.mapInArrow(_search_rows(top), "item long, doc_id long, score long")

    nothing = weighted.select("item", F.lit(1).cast("long").alias("floor")).limit(0)
    seeds = _best(search(grown.limit(SEED_TREES), nothing), top)
    floors = stage(
        seeds.where(F.col("rank") == top).select("item", F.col("score").alias("floor")), "floors")
    found = _best(search(grown, floors), top)
    return found.join(ids, "item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
