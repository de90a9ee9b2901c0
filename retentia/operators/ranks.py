"""Row numbers, ranks, running sums and exact quantiles over a whole table.

A window without PARTITION BY moves every row to one task. Here the rows are range-partitioned
and sorted by the full order (value, then a unique tie-break), staged once with their position,
and shifted by the row count and sums of the ranges before them. Heavy ties are no problem: the
tie-break is part of the range key, so a value held by a third of all rows spans several ranges.
Only one summary row per range (at most the number of shuffle partitions) is ever gathered.
"""

from pyspark.sql import Window as W, functions as F

from retentia.session import in_parallel
from retentia.sources.staging import stage

POS_BITS = 33  # row position inside a partition, as monotonically_increasing_id lays it out


def global_order(df, order, sums=(), label="ordered"):
    """Number the rows of df from 1 in the given total order.

    order: columns or sort expressions; the last must make the order unique.
    sums:  columns for which an inclusive running sum `run_<name>` is added.
    Adds `rn`, `n` (row count) and keeps `_range`, `_at` for with_rank.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    staged = stage(ranged.withColumn("_at", F.monotonically_increasing_id()), label).withColumn(
        "_range", F.shiftright("_at", POS_BITS)
    )
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        staged.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_sum_{c}") for c in sums])
        .select(
            F.col("_range"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_skip"),
            F.sum("_rows").over(W.partitionBy()).alias("n"),
            *[
                F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_base_{c}")
                for c in sums
            ],
        )
    )
    first = F.shiftleft(F.col("_range"), POS_BITS)
    out = staged.join(F.broadcast(offsets), "_range").withColumn(
        "rn", F.col("_at") - first + F.col("_skip") + 1
    )
    if sums:
        within = W.partitionBy("_range").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
        out = out.withColumns(
            {f"run_{c}": F.sum(c).over(within) + F.col(f"_base_{c}") for c in sums}
        )
    return out.drop("_skip", *[f"_base_{c}" for c in sums])


def with_rank(ordered, value_cols, name="rank"):
    """Add the rank with gaps (rows strictly before + 1) to a frame made by global_order.

    Rows of equal value form one run, which may span ranges. Each range knows where the run of
    its last value starts; a range that continues the run takes the start over from there.
    """
    val = F.struct(*value_cols)
    marked = ordered.withColumn(
        "_start", F.min("rn").over(W.partitionBy("_range", *value_cols))
    )
    edges = marked.groupBy("_range").agg(
        F.min_by(val, "_at").alias("_first"),
        F.max_by(F.struct(val.alias("v"), "_start"), "_at").alias("_last"),
    )
    runs = edges.groupBy(F.col("_last.v").alias("_v")).agg(
        F.min("_last._start").alias("_run_start")
    )
    carry = edges.join(runs, F.col("_first").eqNullSafe(F.col("_v"))).select(
        "_range", "_first", "_run_start"
    )
    return (
        marked.join(F.broadcast(carry), "_range", "left")
        .withColumn(
            name,
            F.when(val.eqNullSafe(F.col("_first")), F.least("_start", "_run_start")).otherwise(
                F.col("_start")
            ),
        )
        .drop("_start", "_first", "_run_start")
    )


def ntile_of(rn, n, k):
    """NTILE(k) from a row number: the first n % k buckets hold one row more."""
    k = F.lit(k)
    q = F.floor(n / k).cast("bigint")
    r = n % k
    wide = r * (q + 1)
    small = F.floor((rn - 1) / (q + 1)) + 1
    rest = r + F.floor((rn - 1 - wide) / F.greatest(q, F.lit(1))) + 1
    return F.when(rn <= wide, small).otherwise(rest).cast("int")


def tile_ends(df, value, tie, tile):
    """The last row of every tile as a scalar: array of (v, t, tile), in order.

    Only value and tie-break are sorted; the array has one entry per tile.
    """
    ordered = global_order(df.select(value, tie), [value, tie], label=f"tiles-{value}")
    rn, n = F.col("rn"), F.col("n")
    last = (rn == n) | (tile(rn, n) < tile(rn + 1, n))
    end = F.struct(F.col(value).alias("v"), F.col(tie).alias("t"), tile(rn, n).alias("tile"))
    return ordered.where(last).agg(F.sort_array(F.collect_list(end)).alias("ends")).scalar()


def with_tiles(df, values, tie, tile):
    """Add one tile number per entry of `values` (new name -> value column).

    tile(rn, n) gives the tile of a row number under the order (value, tie) of the whole table.
    The sorts see two columns each and run side by side; the rows of df themselves are not moved,
    each is compared with the few tile ends.
    """
    tasks = [lambda v=v: tile_ends(df, v, tie, tile) for v in values.values()]
    ends = dict(zip(values, in_parallel(tasks)))
    out = df.withColumns({f"_ends_{name}": e for name, e in ends.items()})

    def number(name, value):
        here = F.struct(F.col(value).alias("v"), F.col(tie).alias("t"))
        ahead = F.filter(
            F.col(f"_ends_{name}"), lambda e: F.struct(e["v"].alias("v"), e["t"].alias("t")) >= here
        )
        return F.get(ahead, F.lit(0))["tile"]

    numbered = out.withColumns({name: number(name, value) for name, value in values.items()})
    return numbered.drop(*[f"_ends_{name}" for name in values])


def with_ntile(df, values, tie, k):
    """Add NTILE(k) OVER (ORDER BY value, tie) over the whole table, per entry of `values`."""
    return with_tiles(df, values, tie, lambda rn, n: ntile_of(rn, n, k))


def value_counts(df, cols, by=()):
    """(by, variable, value, c): distinct numeric values with their counts, nulls left out."""
    pairs = [
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value"))
        for c in cols
    ]
    return (
        df.select(*by, F.explode(F.array(*pairs)).alias("p"))
        .select(*by, "p.variable", "p.value")
        .where(F.col("value").isNotNull())
        .groupBy(*by, "variable", "value")
        .agg(F.count(F.lit(1)).alias("c"))
    )


def exact_quantiles(df, cols, probs, by=()):
    """Linear-interpolation quantiles per group and column, without gathering a group anywhere.

    Returns (by, variable, n, q) where q is an array in the order of probs. Equal values are
    merged first; their counts are then summed along the global order of the values.
    """
    keys = [*by, "variable"]
    ordered = global_order(value_counts(df, cols, by), [*keys, "value"], sums=["c"])
    groups = ordered.groupBy(*keys).agg(
        F.sum("c").alias("total"), F.min(F.col("run_c") - F.col("c")).alias("base")
    )
    # one row per group and column, so the counted values do not move
    placed = ordered.drop("n").join(F.broadcast(groups), keys).withColumns(
        {
            "lo_at": F.col("run_c") - F.col("c") - F.col("base"),  # zero-based, inclusive
            "hi_at": F.col("run_c") - F.col("base") - 1,
        }
    )
    spot = [(F.col("total") - 1).cast("double") * F.lit(float(p)) for p in probs]
    picks = []
    for i, s in enumerate(spot):
        for side, at in (("lo", F.floor(s)), ("hi", F.ceil(s))):
            here = at.between(F.col("lo_at"), F.col("hi_at"))
            picks.append(F.max(F.when(here, F.col("value"))).alias(f"{side}_{i}"))
    at_probs = placed.groupBy(*keys).agg(F.max("total").alias("total"), *picks)
    lerp = []
    for i, s in enumerate(spot):
        lo, hi = F.col(f"lo_{i}"), F.col(f"hi_{i}")
        lerp.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (s - F.floor(s))))
    return at_probs.select(*keys, F.col("total").alias("n"), F.array(*lerp).alias("q"))


def by_variable(quantiles):
    """All quantile arrays as one scalar: a map keyed by variable, read with [name][i].

    The map has one entry per asked column, so it stays small whatever the table holds.
    """
    entry = F.struct("variable", "q")
    return quantiles.agg(F.map_from_entries(F.collect_list(entry)).alias("m")).scalar()


def edge_bin(value, edges):
    """Right-closed bin number (from 1) among distinct quantile edges, lowest edge included.

    `edges` is an array column of ascending edges. Equal edges are merged by counting only those
    that differ from the one before.
    """
    distinct = F.array_distinct(edges)
    below = F.size(F.filter(distinct, lambda e: e < value.cast("double")))
    return F.greatest(below, F.lit(1))
