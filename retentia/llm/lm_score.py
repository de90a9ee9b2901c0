"""Cross-entropy difference: how much better a target model predicts a text than a background one.

Both models are bigram models over words and share one vocabulary, every word of the corpus. The
probability of a word after the word before it is that of the pair, interpolated with the word alone
and a uniform floor; before the first word is a context of its own. No word and no pair is left out.
The target model counts the documents of the target domain, the background model all documents.
Each document is scored by the counts of the others (leave one out): its own are taken off the
background model, and off the target model if it belongs to the target. A token's loss is minus the
log probability of a word; a document's score is the mean over its tokens of target loss less
background loss. Lower is closer to the target.

Counts are exact and cover all documents; vocabulary and pairs grow with the corpus and are nowhere
held as a whole. Texts are staged in blocks of bounded size and do not move. A block sends the
sorted 64-bit hashes of its distinct words and pairs with its counts, cut into ranges of hashes. A
task sums one range over all blocks and sends each block the sums of its own hashes, in their order.
So a hash travels once per block, however many documents or tokens hold it, and one very common word
or pair is no hot key. The block then finds its words and pairs again and scores its documents.

Null and empty texts, and texts of white space, have no tokens and a null score. A text longer than
a block is a block of its own. Repeated rows are scored row by row, each against all others; a null
doc_id is no target. Target ids may repeat, be null or unknown. Without target documents the target
model is its floor. Extra columns are ignored. Empty tables give no rows.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T

from retentia.llm.common import (
    as_strings, bounded_batches, hash_words, mix, split_words, word_codes,
)
from retentia.sources.staging import stage, stage_buckets

#: Bytes of text of a block, and what a row counts for beside its text.
BLOCK, ROW = 4 << 20, 1 << 10
#: Bytes of text for which there is one range of hashes at least.
RANGE = 32 << 20
#: The context of a first word.
START = np.uint64(0x5BD1E995A7F3C60D)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Counts of a word (all, target, and both as a context) and of a pair (all, target).
OF_WORD, OF_PAIR = 4, 2
SENT = "part int, block long, words binary, pairs binary"
SUMS = SENT + ", vocabulary long, tokens long, marked long"


@dataclass(frozen=True)
class Models:
    #: Words that are classes of their own. None: every word, so that pairs of classes are pairs of
    #: words; there is no other setting.
    classes: None = None
    #: Weights of bigram, word and uniform floor.
    weights: tuple = (0.8, 0.19, 0.01)
    #: Share of documents from which a word is broadcast. No word is, whatever the share.
    hot_share: float = 0.001


def _batch(columns, names):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _tokens(rows):
    """Text number and code of every word, and the hashes by code."""
    words, bounds = split_words(as_strings(rows.column("_text")))
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if not len(doc):
        return doc, doc, np.zeros(0, np.uint64)
    codes, distinct = word_codes(words)
    return doc, codes.astype(np.int64), hash_words(distinct)


def _marks(rows):
    return rows.column("_target").to_numpy(zero_copy_only=False).astype(bool)


def _blocks(batches):
    """Rows with their block: those of a task in turn, until a block has its bytes."""
    full = 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False)
        ends = full + np.cumsum(sizes.astype(np.int64) + ROW)
        starts = np.concatenate(([full], ends[:-1])) if len(ends) else ends
        full = int(ends[-1]) if len(ends) else full
        rows = batch.column("_row").to_numpy(zero_copy_only=False)
        # the upper bits of a row are its task
        block = pa.array((rows >> 33 << 33) + starts // BLOCK)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, block], names=[*batch.schema.names, "_block"])


def marked_rows(docs, target_ids):
    """_row, doc_id, _text, _block and the mark _target of every document.

    Texts are staged where they lie, in buckets of blocks of rows, and only the numbers of the
    target's rows travel to them: the join on the block moves no text, whatever its size.
    """
    # staged, so that the planner knows how many ids there are
    ids = stage(target_ids.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct(),
                "lm-targets")
    numbered = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col("`doc_id`").alias("doc_id"),
        F.col("`text`").cast("string").alias("_text"))
    # staged, so that row numbers stay the same
    rows = stage_buckets(
        numbered.mapInArrow(_blocks, T.StructType(
            [*numbered.schema.fields, T.StructField("_block", T.LongType())])),
        "_block", "lm-rows")
    targets = stage(
        rows.select("_row", "_block", "doc_id").join(ids, F.col("doc_id") == F.col("_id"))
        .groupBy("_block").agg(F.collect_list("_row").alias("_targets")),
        "lm-marks")
    # hashed, as a merge would sort the texts
    return rows.join(targets.hint("shuffle_hash"), "_block", "left").select(
        "_row", "doc_id", "_text", "_block",
        F.coalesce(F.array_contains("_targets", F.col("_row")), F.lit(False)).alias("_target"))


@dataclass(frozen=True)
class Block:
    """Tokens of a block's documents by the positions of their words and pairs among the sorted hashes."""

    words: np.ndarray
    pairs: np.ndarray
    doc: np.ndarray
    word: np.ndarray
    before: np.ndarray
    pair: np.ndarray


def _word_pairs(rows):
    doc, codes, hashes = _tokens(rows)
    words, at = np.unique(np.concatenate([[START], hashes]), return_inverse=True)
    word = at[1:][codes]
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    before = np.roll(word, 1)
    before[first] = at[0]
    with np.errstate(over="ignore"):
        pairs, pair = np.unique(mix(words[before] * _STEP + words[word]), return_inverse=True)
    return Block(words, pairs, doc, word, before, pair)


def _planes(columns):
    """Columns of whole numbers, compressed: first all lowest bytes, as the upper ones are mostly 0."""
    raw = b"".join(
        np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes()
        for c in columns)
    return len(columns[0]).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _columns(data, kinds):
    """The columns that _planes packed."""
    sizes, n = [np.dtype(k).itemsize for k in kinds], int.from_bytes(data[:8], "little")
    raw, out, at = pa.decompress(data[8:], n * sum(sizes), "zstd", asbytes=True), [], 0
    raw = np.frombuffer(raw, np.uint8)
    for kind, size in zip(kinds, sizes):
        plane = raw[at:at + n * size].reshape(size, n)
        out.append(np.ascontiguousarray(plane.T).view(kind).reshape(n))
        at += n * size
    return out


def _packed(keys, counts):
    return _planes([np.diff(keys, prepend=np.uint64(0)), *(c.astype(np.uint32) for c in counts)])


def _unpacked(data, counts):
    gaps, *found = _columns(data, [np.uint64] + [np.uint32] * counts)
    return [np.cumsum(gaps, dtype=np.uint64), *found]


def _edges(keys, ranges):
    """Bounds of the ranges in sorted keys."""
    width = (1 << 64) // ranges + 1
    inner = np.array([i * width for i in range(1, ranges)], np.uint64)
    return [0, *np.searchsorted(keys, inner).tolist(), len(keys)]


def _send(ranges):
    """Rows of a block -> its hashes and counts by range."""

    def run(rows):
        b, marks = _word_pairs(rows), _marks(rows)
        of_target = marks[b.doc]
        width = len(b.words)
        words = [np.bincount(x, minlength=width) for x in (
            b.word, b.word[of_target], b.before, b.before[of_target])]
        pairs = [np.bincount(x, minlength=len(b.pairs)) for x in (b.pair, b.pair[of_target])]
        block = rows.column("_block")[0].as_py()
        out = []
        at, to = _edges(b.words, ranges), _edges(b.pairs, ranges)
        for i in range(ranges):
            w, p = slice(at[i], at[i + 1]), slice(to[i], to[i + 1])
            if w.start < w.stop or p.start < p.stop:
                out.append((i, block, _packed(b.words[w], [c[w] for c in words]),
                            _packed(b.pairs[p], [c[p] for c in pairs])))
        names = ["part", "block", "words", "pairs"]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def _summed(sent, counts):
    """For each block the sums of its keys over all blocks, packed; and the keys with their sums."""
    parts = [_unpacked(data, counts) for data in sent]
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    # bincount adds whole numbers below 2 ** 53 exactly
    sums = [np.bincount(at, np.concatenate([p[c + 1] for p in parts]), len(keys)).astype(np.int64)
            for c in range(counts)]
    bounds = np.cumsum([0, *(len(p[0]) for p in parts)])
    return [_planes([s[at[a:b]] for s in sums]) for a, b in zip(bounds[:-1], bounds[1:])], sums


def _sum_ranges(batches):
    """What blocks sent -> the sums of their own keys. A task has whole ranges."""
    held = {}
    for batch in batches:
        for row in batch.to_pylist():
            held.setdefault(row["part"], []).append((row["block"], row["words"], row["pairs"]))
    for part in list(held):
        blocks, words, pairs = zip(*held.pop(part))
        words, (n, t, _, _) = _summed(words, OF_WORD)
        pairs, _ = _summed(pairs, OF_PAIR)
        totals = [int((n > 0).sum()), int(n.sum()), int(t.sum())]
        for i, row in enumerate(zip(blocks, words, pairs)):
            yield _batch(
                [np.array([part], np.int32), np.array([row[0]], np.int64), [row[1]], [row[2]],
                 *([x if i == 0 else 0] for x in totals)],
                ["part", "block", "words", "pairs", "vocabulary", "tokens", "marked"])


def _share(a, b):
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def _own(doc, key, size):
    """How often the key of each token occurs in its document."""
    _, at, n = np.unique(doc * size + key, return_inverse=True, return_counts=True)
    return n[at]


def _score(models, vocabulary, totals):
    """Rows of a block and the sums of its keys -> losses of its documents."""
    two, one, floor = models.weights

    def run(rows, sums):
        b, marks = _word_pairs(rows), _marks(rows)
        sums = sums.sort_by("part")
        tokens = np.bincount(b.doc, minlength=len(marks))

        def joined(name, counts):
            parts = [_columns(x.as_py(), [np.int64] * counts) for x in sums.column(name)]
            return [np.concatenate(c) for c in zip(*parts)]

        words, pairs = joined("words", OF_WORD), joined("pairs", OF_PAIR)
        own_pair, own_word = _own(b.doc, b.pair, len(b.pairs)), _own(b.doc, b.word, len(b.words))
        own_before = _own(b.doc, b.before, len(b.words))
        losses = []
        for i, own in enumerate((np.ones(len(b.doc), bool), marks[b.doc])):
            p = (
                two * _share(pairs[i][b.pair] - own_pair * own,
                             words[2 + i][b.before] - own_before * own)
                + one * _share(words[i][b.word] - own_word * own, totals[i] - tokens[b.doc] * own)
                + floor / (vocabulary + 1))
            # bincount gives whole numbers where nothing is counted
            losses.append(np.bincount(b.doc, -np.log(p), len(marks)).astype(float))
        mean = [pa.array(x / np.maximum(tokens, 1), mask=tokens == 0) for x in losses]
        return pa.table(
            [rows.column("doc_id"), pa.array(tokens.astype(np.int64)), mean[1], mean[0],
             pc.subtract(mean[1], mean[0])],
            names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return run


def scored(docs, target_ids, models=Models()):
    """doc_id, n_tokens, target_loss, background_loss and score of every document.

    target_ids: one column doc_id, the documents of the target domain.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = marked_rows(docs, target_ids)
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE))
    sent = rows.groupBy("_block").applyInArrow(_send(ranges), SENT)
    sums = stage(
        sent.repartitionById(ranges, F.col("part")).mapInArrow(_sum_ranges, SUMS), "lm-sums")
    total = sums.agg(F.sum("vocabulary"), F.sum("tokens"), F.sum("marked")).first()
    vocabulary, *totals = (x or 0 for x in total)
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType)] + [
        T.StructField(name, kind) for name, kind in (
            ("n_tokens", T.LongType()), ("target_loss", T.DoubleType()),
            ("background_loss", T.DoubleType()), ("score", T.DoubleType()))])
    found = sums.select(F.col("block").alias("_block"), "part", "words", "pairs")
    return rows.groupBy("_block").cogroup(found.groupBy("_block")).applyInArrow(
        _score(models, vocabulary, totals), schema)
