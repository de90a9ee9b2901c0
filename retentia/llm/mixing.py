"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Every source has a weight and a cap of `max_epochs` times its size. The budget is shared by
weight; a source above its cap is clamped and what it leaves goes to the others by weight, until
none is above. A source that gets r epochs gives each document floor(r) whole copies, and the
fractional epoch goes to documents in the order of a seeded hash until the source's target is
spent; the document where that happens gives only the words that are left, so each source meets
its rounded target to the word.

A null text has size 0, a null source is a source of its own and sorts last, repeated rows are
documents of their own, an empty table gives no rows. Columns with clashing names are ignored.
"""

from dataclasses import dataclass

from pyspark.sql import Window, functions as F

from retentia.llm.common import n_words, with_rows
from retentia.sources.staging import stage


@dataclass(frozen=True)
class Mix:
    weights: tuple = (5, 2, 1)
    budget: float = 1.5
    max_epochs: float = 2.0
    seed: str = "mix-1"
    #: Hash ranges per source; only the range where the target is met is put in order.
    ranges: int = 4096


def water_level(sources, budget):
    """The level L with sum(min(cap, L * weight)) = budget, by redistributing the excess.

    Each round clamps the sources above their cap and shares what is left among the others. The
    rounds only sum over the table of sources; null if every source is at its cap.
    """
    level = 0.0
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        held, free = sources.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))),
        ).first()
        if not free:
            return None
        raised = max(budget - held, 0.0) / float(free)
        if raised <= level:
            return level
        level = raised


def targets(sizes, mix=Mix()):
    """One row per source of (source, size): source, source_size, target."""
    sums = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # binary order is the order of code points; one row per source, so one task orders them
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(w) for w in mix.weights])
    table = sums.withColumn(
        "weight", F.element_at(weights, (place % len(mix.weights) + 1).cast("int"))
    )
    table = stage(
        table.withColumn("cap", F.lit(mix.max_epochs) * F.col("source_size")), "mix-sources"
    )
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(table, mix.budget * total)
    share = F.col("cap") if level is None else F.least("cap", F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", share.cast("double").alias("target"))


def mixed(docs, mix=Mix(), keep=()):
    """Per document: doc_id, source, size, source_size, target, taken, and the kept columns."""
    sizes = stage(
        docs.select(
            *keep,
            F.col("`doc_id`").alias("doc_id"),
            F.col("`source`").alias("source"),
            n_words(F.col("`text`")).alias("size"),
        ),
        "mix-sizes",
    )
    # planned once, and small beside the documents, so the planner picks the join by its size
    goals = stage(targets(sizes, mix), "mix-targets").select(
        F.col("source").alias("_source"), "source_size", "target"
    )
    rows = sizes.join(goals, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    key = F.xxhash64(F.lit(mix.seed), "doc_id", "size")
    rows = rows.select(
        "*",
        key.alias("_key"),
        F.pmod(F.shiftrightunsigned(key, 20), F.lit(mix.ranges)).alias("_range"),
        F.least(
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
            .otherwise(0),
            F.lit(int(mix.max_epochs)),
        ).cast("long").alias("_whole"),
    ).withColumn(
        "_extra", F.round("target").cast("long") - F.col("_whole") * F.col("source_size")
    )
    # words before each hash range of a source; at most `ranges` rows of a source meet in a window
    in_range = rows.groupBy("source", "_range").agg(
        F.sum("size").alias("_words"), F.max("_extra").alias("_extra")
    )
    order = Window.partitionBy("source").orderBy("_range")
    before = F.coalesce(
        F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    cut = (
        in_range.withColumn("_before", before)
        .where("_before < _extra and _extra <= _before + _words")
        .select(
            F.col("source").alias("_source"),
            F.col("_range").alias("_cut"),
            (F.col("_extra") - F.col("_before")).alias("_left"),
        )
    )
    cut = stage(cut, "mix-cuts")
    rows = rows.join(cut, F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = rows.where("_range = _cut")
    within = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size")
    used = F.coalesce(
        F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - used))
    inside = inside.withColumn("_more", part)
    outside = rows.where("_cut is null or _range <> _cut").withColumn(
        "_more", F.when(F.col("_range") < F.col("_cut"), F.col("size")).otherwise(0)
    )
    return inside.unionByName(outside).select(
        *keep, "doc_id", "source", "size", "source_size", "target",
        (F.col("_whole") * F.col("size") + F.col("_more")).cast("long").alias("taken"),
    )


def sampled(docs, mix=Mix()):
    """The mix itself: all columns of each document once per repetition it is taken for.

    `repetition` counts from 1 and `words` says how many words of the repetition are taken: all
    of them, but for the one document of a source where its target is met.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = with_rows(docs, [own])
    named = rows.select("_row", "_doc.doc_id", "_doc.source", "_doc.text")
    took = mixed(named, mix, keep=("_row",)).where("taken > 0").select("_row", "size", "taken")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    out = rows.join(took, "_row").select(
        "_doc", "size", "taken", F.explode(F.sequence(F.lit(1), times)).alias("repetition"))
    words = F.least(F.col("size"), F.col("taken") - (F.col("repetition") - 1) * F.col("size"))
    return out.select("_doc.*", "repetition", words.alias("words"))
