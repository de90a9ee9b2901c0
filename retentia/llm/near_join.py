"""Jaccard join of documents on word shingles with Bayesian pruning of candidates.

1. Each text becomes a set of hashed five-word shingles and a signature of 128 MinHash values
   (16 bits of each). Texts with equal sets are one member from here on, whatever their number.
2. Bands of four values find candidates; at the threshold of 0.8 a pair meets in no band with a
   chance of 5e-8.
3. Candidates are compared value by value in steps; a pair is dropped once the posterior
   probability that its similarity reaches the threshold falls below a tolerance. Pairs that
   already hang together through others need no comparison. What survives links members to groups.
4. In each group every pair is verified exactly on its shingle sets; pairs at or above the
   threshold are the links, and connected links make the classes.

Large buckets and groups are cut into blocks, and each pair of blocks is a piece of work of its
own, so no task holds a whole group and no pair is put out as a row: a piece of work returns link
counts and a spanning forest.

Texts of one to four words are one shingle; texts without words are linked to nothing and are
classes of their own. Null and repeated ids are kept row by row; class ids are the least id of a
class. Columns besides doc_id and text are ignored. Empty tables give no rows.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from retentia.llm.common import bounded_batches, connected, mix, shingle_sets, with_rows
from retentia.sources.staging import stage


@dataclass(frozen=True)
class Join:
    threshold: float = 0.8
    hashes: int = 128
    per_band: int = 4
    #: Values compared before each look at the posterior.
    looks: tuple = (16, 32, 64, 128)
    tolerance: float = 1e-6
    #: Members of a bucket, and shingles of a group, in one block.
    block: int = 512
    block_shingles: int = 1 << 20
    seed: int = 5


def _multipliers(join):
    rng = np.random.default_rng(join.seed)
    odd = rng.integers(0, 1 << 32, (2, join.hashes), dtype=np.uint64) | np.uint64(1)
    return odd.astype(np.uint32)


def signature(values, join, multipliers):
    """MinHash of a set of 64-bit hashes, 16 bits of each value."""
    a, b = multipliers
    low = (values >> np.uint64(32)).astype(np.uint32)
    best = np.full(join.hashes, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 1024):  # the products of one step stay in cache
        best = np.minimum(best, ((low[k : k + 1024, None] ^ b) * a).min(0))
    return (mix(best.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def _digest(values):
    """128 bits that stand for a whole set."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _sign(join):
    def run(batches):
        multipliers = _multipliers(join)
        for batch in batches:
            n, digests, signatures = [], [], []
            for s in shingle_sets(batch.column("text")):
                n.append(len(s))
                digests.append(_digest(s))
                signatures.append(signature(s, join, multipliers).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("doc_id"), pa.array(n, pa.int64()),
                 pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
                names=["_row", "doc_id", "n", "digest", "signature"])

    return run


def signed(rows, join=Join()):
    """_row, doc_id, n (distinct shingles), digest and signature of every row; staged."""
    kind = dict(rows.dtypes)["doc_id"]
    out = rows.select("_row", "doc_id", "text").mapInArrow(
        _sign(join), f"_row long, doc_id {kind}, n long, digest binary, signature binary")
    return stage(out, "near-signed")


def least_matches(join):
    """For each look: the fewest matching values that keep a pair.

    With a uniform prior on the similarity s, m matches among k values give a Beta posterior;
    its weight above the threshold is summed on a fine grid.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    above = grid >= join.threshold
    need = []
    for k in join.looks:
        for m in range(k + 1):
            logs = m * np.log(grid) + (k - m) * np.log1p(-grid)
            weights = np.exp(logs - logs.max())
            if weights[above].sum() / weights.sum() >= join.tolerance:
                need.append(m)
                break
    return need


def alive(a, b, join, need):
    """Which pairs of signatures survive all looks; dropped pairs are not compared further."""
    left, done, matches = np.arange(len(a)), 0, np.zeros(len(a), np.int64)
    for k, m in zip(join.looks, need):
        matches = matches + (a[left, done:k] == b[left, done:k]).sum(1)
        keep = matches >= m
        left, matches, done = left[keep], matches[keep], k
    return left


class Forest:
    """Groups of small numbers that were joined; labels as an array for vector tests."""

    def __init__(self, n):
        self.label = np.arange(n)

    def join(self, x, y):
        a, b = self.label[x], self.label[y]
        if a != b:
            self.label[self.label == max(a, b)] = min(a, b)

    def stars(self, members):
        """Edges that hang each member to the least member of its group.

        Many pieces of work see parts of one group; stars around the least member repeat, so
        little is left of them when equal edges are put together.
        """
        least = np.full(len(members), np.iinfo(np.int64).max)
        np.minimum.at(least, self.label, members)
        centre = least[self.label]
        away = centre != members
        return centre[away], members[away]


def _pieces(df, key, size, limit):
    """Cut groups of a key into blocks and repeat each row for every pair of blocks it is in.

    size: the column that says how many blocks a group needs beyond one, as size / limit. Adds
    _i and _j, the pair of blocks, and _own, the row's block.
    """
    blocks = F.greatest(F.ceil(F.col(size) / F.lit(limit)), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("member", F.lit(1)), F.col("_blocks")).cast("int")
    df = df.withColumn("_blocks", blocks).withColumn("_own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    df = df.select("*", other)
    return df.select(
        *[c for c in df.columns if c not in ("_other", "_blocks")],
        F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"),
    )


def _groups(batches, keys):
    """Stream runs of equal keys out of sorted batches: lists of columns as numpy or Arrow."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None and held.num_rows:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        change = np.zeros(table.num_rows, bool)
        for k in keys:
            v = table.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = np.concatenate(([0], np.flatnonzero(change)))
        held = table.slice(cuts[-1])
        yield table.slice(0, cuts[-1]).combine_chunks(), cuts
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.array([0, held.num_rows])


def _array(table, name):
    return np.ascontiguousarray(table.column(name).to_numpy())


def _matrix(table, name, kind):
    column = table.column(name).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(table.num_rows, -1)


def _prune(join):
    """Buckets of signatures -> edges of a spanning forest of the pairs that survive."""

    def run(batches):
        need = least_matches(join)
        for table, cuts in _groups(batches, ["key", "_i", "_j"]):
            if not table.num_rows:
                continue
            members, own = _array(table, "member"), _array(table, "_own")
            signatures = _matrix(table, "signature", np.uint16)
            sizes = np.diff(cuts)
            group = np.repeat(np.arange(len(sizes)), sizes)
            cross = _array(table, "_i") != _array(table, "_j")
            forest = Forest(table.num_rows)
            position = np.arange(table.num_rows)
            for step in range(1, int(sizes.max(initial=1))):
                x = position[:-step][group[step:] == group[:-step]]
                if not len(x):
                    break
                y = x + step
                # pairs inside a block meet in the block's own piece of work
                x, y = (v[~cross[x] | (own[x] != own[y])] for v in (x, y))
                apart = forest.label[x] != forest.label[y]
                x, y = x[apart], y[apart]
                for k in alive(signatures[x], signatures[y], join, need):
                    forest.join(x[k], y[k])
            a, b = forest.stars(members)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def candidate_edges(members, join=Join()):
    """Edges between members (member, signature) that Bayesian pruning leaves; staged."""
    width = 2 * join.per_band
    bands = join.hashes // join.per_band
    keys = F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda i: F.xxhash64(i, F.substring(F.col("signature"), i * width + 1, F.lit(width))),
    )).alias("key")
    banded = members.select("member", keys)
    shared = banded.groupBy("key").agg(F.count("*").alias("_size")).where("_size > 1")
    # staged, so that a bucket with many members can be split in the join
    shared = stage(shared, "near-buckets")
    hits = banded.join(shared, "key").join(members.select("member", "signature"), "member")
    pieces = _pieces(hits, "key", "_size", join.block)
    parts = _parts(members.sparkSession)
    pieces = pieces.repartition(parts, "key", "_i", "_j").sortWithinPartitions("key", "_i", "_j")
    pieces = pieces.select("member", "signature", "key", "_i", "_j", "_own")
    edges = pieces.mapInArrow(_prune(join), "a long, b long")
    return stage(edges.distinct(), "near-candidates")


def _parts(spark):
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def shared_counts(sets):
    """Sizes of all pairwise intersections of a list of sorted sets, as a matrix."""
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.concatenate(([True], values[1:] != values[:-1]))
    word = np.cumsum(fresh) - 1
    often = np.bincount(word) > 1
    keep = often[word]
    word, owner = (np.cumsum(often) - 1)[word[keep]], owner[keep]
    out, width = np.zeros((len(sets), len(sets)), np.float64), 4096
    for k in range(0, int(often.sum()), width):
        lo, hi = np.searchsorted(word, [k, k + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[owner[lo:hi], word[lo:hi] - k] = 1
        out += dense @ dense.T
    return out.astype(np.int64)


def _verify(join):
    """Groups of sets -> link counts per member and a spanning forest of the exact links."""
    at_least = int(round(join.threshold * 10_000))

    def run(batches):
        for table, cuts in _groups(batches, ["root", "_i", "_j"]):
            rows = []
            if table.num_rows:
                member, own = _array(table, "member"), _array(table, "_own")
                copies = _array(table, "copies")
                i, j = _array(table, "_i"), _array(table, "_j")
                sets = list(shingle_sets(table.column("text")))
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a < 2:
                    continue
                group = sets[a:b]
                both = shared_counts(group)
                size = np.array([len(s) for s in group])
                union = size[:, None] + size[None, :] - both
                link = both * 10_000 >= at_least * union
                np.fill_diagonal(link, False)
                if i[a] != j[a]:
                    link &= own[a:b][:, None] != own[a:b][None, :]
                degree = link @ copies[a:b]
                forest = Forest(b - a)
                for x, y in zip(*np.nonzero(np.triu(link))):
                    forest.join(x, y)
                rows += [(x, y, 0) for x, y in zip(*forest.stars(member[a:b]))]
                rows += [(member[a + x], member[a + x], degree[x]) for x in np.flatnonzero(degree)]
            got = np.array(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in got], names=["a", "b", "links"])

    return run


def joined(rows, join=Join()):
    """Classes of staged rows (_row, doc_id, text).

    Returns (signed rows, members): one member per distinct set with member (its least row),
    digest, copies, root (least member of its class), class_id and links to other members' rows.
    """
    bounded_batches(rows.sparkSession)
    marked = signed(rows, join)
    members = stage(
        marked.where("n > 0").groupBy("digest").agg(
            F.min("_row").alias("member"), F.count("*").alias("copies"), F.min("n").alias("n"),
            F.first("signature").alias("signature"), F.min("doc_id").alias("least_id")),
        "near-members",
    )
    roots = connected(candidate_edges(members, join), "near-groups")
    # bring the texts of grouped members, each once per pair of blocks of its group
    grouped = members.select("member", "copies", "n").join(
        roots.select(F.col("node").alias("member"), "root"), "member")
    grouped = stage(grouped, "near-grouped")
    size = grouped.groupBy("root").agg(
        F.greatest(F.sum("n") / F.lit(join.block_shingles), F.count("*") / F.lit(join.block))
        .alias("_size"))
    texts = rows.select(F.col("_row").alias("member"), "text")
    work = texts.join(grouped.join(stage(size, "near-sizes"), "root"), "member")
    pieces = _pieces(work, "root", "_size", 1)
    parts = _parts(rows.sparkSession)
    pieces = pieces.repartition(parts, "root", "_i", "_j").sortWithinPartitions("root", "_i", "_j")
    pieces = pieces.select("member", "text", "copies", "root", "_i", "_j", "_own")
    found = stage(pieces.mapInArrow(_verify(join), "a long, b long, links long"), "near-links")
    classes = connected(found.where("a <> b"), "near-classes")
    degree = found.where("a = b").groupBy(F.col("a").alias("member")).agg(
        F.sum("links").alias("links"))
    members = members.drop("signature", "n").join(
        classes.select(F.col("node").alias("member"), "root"), "member", "left"
    ).join(degree, "member", "left").select(
        "member", "digest", "copies", "least_id", F.coalesce("root", "member").alias("root"),
        F.coalesce("links", F.lit(0)).alias("links"))
    members = stage(members, "near-linked")
    ids = members.groupBy("root").agg(F.min("least_id").alias("class_id"))
    return marked, stage(members.join(ids, "root"), "near-classed")


def classes(docs, join=Join()):
    """doc_id, class_id and n_links (rows of other documents at or above the threshold)."""
    rows = with_rows(docs, [F.col("`doc_id`").alias("doc_id"), F.col("`text`").alias("text")])
    marked, members = joined(rows, join)
    out = marked.select("doc_id", "digest", "n").join(
        members.select("digest", "copies", "class_id", "links"), "digest", "left")
    alone = F.col("n") == 0
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("copies") - 1 + F.col("links")).cast("long")
        .alias("n_links"),
    )


def without_copies(docs, join=Join()):
    """The documents, all columns, with one of each class left: its first row."""
    # the names the join needs, beside the documents' own columns as one struct
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = with_rows(docs, [own]).select(
        "_row", "_doc", F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text"))
    marked, members = joined(rows, join)
    first = members.where("member = root").select(F.col("member").alias("_row"))
    keep = first.unionByName(marked.where("n = 0").select("_row"))
    return rows.join(keep, "_row", "left_semi").select("_doc.*")
