"""What several operators share: words, hashes of words, shingles, staged rows."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T

from retentia.sources.staging import stage

#: A word is a run of anything but these, everywhere in this package.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
SHINGLE = 5
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def load(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark, size=4 << 20):
    """Arrow batches end at so many bytes, so that long texts do not add up in a worker."""
    spark.conf.set(BATCH_BYTES, str(size))


def column(df, name, kind=None):
    """A column by its exact name, as nulls of the kind if it is not there."""
    if name in df.columns:
        return F.col(f"`{name}`")
    return F.lit(None).cast(kind or "string")


def n_words(text):
    """Words of a text column; 0 for null."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")
    bare = F.trim(bare)
    gaps = F.length(bare) - F.length(F.translate(bare, " ", ""))
    return F.when(bare == "", 0).otherwise(gaps + 1).cast("long")


def with_rows(df, columns):
    """The columns with a row number `_row`, staged, so that it stays the same if tasks rerun."""
    return stage(df.select(*columns, F.monotonically_increasing_id().alias("_row")), "rows")


def mix(x):
    """Scramble 64-bit numbers (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX_1
    x ^= x >> np.uint64(27)
    x *= _MIX_2
    x ^= x >> np.uint64(31)
    return x


def as_strings(array):
    """A string array without nulls (null: empty)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not (pa.types.is_string(array.type) or pa.types.is_large_string(array.type)):
        array = array.cast(pa.string())
    return pc.fill_null(array, "")


def split_words(array):
    """All words of a string array in order, and the bounds of each text's words (n + 1)."""
    lists = pc.ascii_split_whitespace(as_strings(array))
    words = lists.flatten()
    starts = np.asarray(lists.offsets, dtype=np.int64)
    starts = starts - starts[0]
    full = pc.greater(pc.binary_length(words), 0)
    seen = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    return words.filter(full), seen[starts]


def word_codes(words):
    """Dictionary codes of an array of words, and the distinct words."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def hash_words(distinct):
    """64-bit hashes of an array of distinct words."""
    values = distinct.to_numpy(zero_copy_only=False)
    return pd.util.hash_array(values, categorize=False) if len(values) else np.zeros(0, np.uint64)


def windows(hashes, size=SHINGLE):
    """Hash of the window of so many words that begins at each position."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    n, out = len(hashes) - size + 1, np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * _STEP + mix(hashes[i : i + n])
    return mix(out)


def shingle_sets(array, size=SHINGLE):
    """For each text its sorted distinct shingle hashes.

    A text of one to four words is one shingle of all its words; without words there is none.
    """
    words, bounds = split_words(array)
    codes, distinct = word_codes(words)
    hashes = hash_words(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    whole = windows(hashes, size)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= size:
            yield np.unique(whole[a : b - size + 1])
        elif b > a:
            yield windows(hashes[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


def struct_of(**kinds):
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


def connected(edges, label="links"):
    """Connected components of edges (a, b): one row (node, root) per node, root the least node.

    Each round takes the least root among a node and its neighbours and then jumps to the root's
    root; rounds are staged. Roots only fall, so the sum of them tells when nothing changes.
    """
    both = stage(
        edges.select("a", "b").where("a <> b")
        .unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b"))
        .distinct(),
        label,
    )
    roots = stage(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.col("node"), F.min("b")).alias("root")), label)
    total = None
    while True:
        now = roots.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return roots
        total = now
        near = both.join(roots, both.b == roots.node).groupBy("a").agg(F.min("root").alias("near"))
        met = roots.join(near, roots.node == near.a).select(
            "node", F.least("root", "near").alias("root"))
        met = stage(met, label)
        far = met.select(F.col("node").alias("root"), F.col("root").alias("far"))
        roots = stage(met.join(far, "root").select("node", F.col("far").alias("root")), label)
