"""Global orders, ranks and quantiles against pandas, with ties that span several ranges."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retentia.operators.ranks import (
    by_variable,
    edge_bin,
    exact_quantiles,
    global_order,
    ntile_of,
    with_ntile,
    with_rank,
)


def skewed(n=600, seed=3):
    """A third of the rows share one value; the rest are spread, some repeated."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        value = 50 if i % 3 == 0 else rnd.choice([1, 2, 3, rnd.randint(0, 200)])
        rows.append((f"id{rnd.random():.12f}", value, rnd.randint(1, 9)))
    return pd.DataFrame(rows, columns=["id", "value", "amount"])


@pytest.fixture(scope="module")
def data():
    return skewed()


@pytest.mark.parametrize("ascending", [True, False])
def test_row_numbers_and_running_sums(many_ranges, data, ascending):
    order = [F.col("value") if ascending else F.desc("value"), F.col("id")]
    got = global_order(many_ranges.createDataFrame(data), order, sums=["amount"])
    assert got.select("_range").distinct().count() > 3
    got = got.toPandas().sort_values("rn")
    want = data.sort_values(["value", "id"], ascending=[ascending, True]).reset_index(drop=True)
    assert list(got.rn) == list(range(1, len(data) + 1))
    assert list(got.id) == list(want.id)
    assert list(got.run_amount) == list(want.amount.cumsum())
    assert set(got.n) == {len(data)}


def test_hot_value_spans_ranges_and_keeps_one_rank(many_ranges, data):
    ordered = global_order(many_ranges.createDataFrame(data), [F.desc("value"), F.col("id")])
    spans = ordered.where("value = 50").select("_range").distinct().count()
    assert spans > 1
    got = with_rank(ordered, ["value"]).toPandas()
    want = data.set_index("id").value.rank(method="min", ascending=False).astype(int)
    assert dict(zip(got.id, got["rank"])) == want.to_dict()


def test_one_value_only(many_ranges):
    df = many_ranges.range(100).select(F.lit(7).alias("value"), F.col("id"))
    got = with_rank(global_order(df, ["value", "id"]), ["value"]).toPandas()
    assert set(got["rank"]) == {1}
    assert sorted(got.rn) == list(range(1, 101))


def test_nulls_first_and_empty(many_ranges):
    df = many_ranges.createDataFrame([(None, 1), (5, 2), (None, 3)], "value int, id int")
    got = with_rank(global_order(df, ["value", "id"]), ["value"]).orderBy("id").collect()
    assert [r["rank"] for r in got] == [1, 3, 1]
    assert global_order(df.limit(0), ["value", "id"]).count() == 0


@pytest.mark.parametrize("n", [1, 3, 7, 10, 13, 100, 143])
@pytest.mark.parametrize("k", [5, 10])
def test_ntile_formula(spark, n, k):
    df = spark.range(1, n + 1).select(ntile_of(F.col("id"), F.lit(n), k).alias("t"), "id")
    got = [r.t for r in df.orderBy("id").collect()]
    q, r = divmod(n, k)
    want = [i + 1 for i in range(k) for _ in range(q + (i < r))]
    assert got == want


def test_ntile_with_ties(many_ranges, data):
    got = with_ntile(many_ranges.createDataFrame(data), {"t": "value"}, "id", 5).toPandas()
    order = data.sort_values(["value", "id"]).id.tolist()
    assert got.groupby("t").size().tolist() == [120] * 5
    assert set(got[got.t == 1].id) == set(order[:120])


def test_ntile_of_fewer_rows_than_tiles(many_ranges):
    df = many_ranges.createDataFrame([(5, "b"), (5, "a"), (None, "c")], "value int, id string")
    got = with_ntile(df, {"t": "value"}, "id", 10).orderBy("id").collect()
    assert [r.t for r in got] == [2, 3, 1]


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_match_numpy(many_ranges, seed):
    data = skewed(401, seed)
    probs = [i / 10 for i in range(11)]
    q = exact_quantiles(many_ranges.createDataFrame(data), ["value", "amount"], probs)
    got = {r.variable: list(r.q) for r in q.collect()}
    for c in ("value", "amount"):
        assert np.allclose(got[c], np.quantile(data[c], probs))


def test_quantiles_per_group_skip_nulls(many_ranges):
    rows = [("a", 1.0), ("a", 3.0), ("a", None), ("b", 5.0)]
    df = many_ranges.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.n, r.q[0]) for r in exact_quantiles(df, ["x"], [0.5], by=["g"]).collect()}
    assert got == {"a": (2, 2.0), "b": (1, 5.0)}


def test_edge_bins_follow_qcut(many_ranges, data):
    df = many_ranges.createDataFrame(data)
    edges = by_variable(exact_quantiles(df, ["value"], [i / 10 for i in range(11)]))
    got = df.withColumn("e", edges["value"]).select("id", edge_bin(F.col("value"), F.col("e")).alias("b"))
    want = pd.qcut(data.value, 10, labels=False, duplicates="drop") + 1
    got = got.toPandas().set_index("id").b
    assert got.loc[data.id].tolist() == want.tolist()


def test_all_equal_values_share_one_bin(spark):
    df = spark.range(20).select(F.lit(4.0).alias("x"))
    edges = by_variable(exact_quantiles(df, ["x"], [0.0, 0.5, 1.0]))
    bins = df.withColumn("e", edges["x"]).select(edge_bin(F.col("x"), F.col("e")).alias("b"))
    assert [r.b for r in bins.distinct().collect()] == [1]
