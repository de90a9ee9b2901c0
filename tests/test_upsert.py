"""Updates of a stored table by key: versions, untouched files, errors, other sessions."""

import pytest
from pyspark.sql import functions as F

from retentia.operators import rules
from retentia.sources import upsert


@pytest.fixture
def stored(spark, tmp_path):
    root = str(tmp_path / "table")
    df = spark.range(0, 1000, 1, 20).select(
        "id", (F.col("id") % 2).cast("int").alias("half"), (F.col("id") * 10).cast("int").alias("v"),
        F.lit("keep").alias("note"))
    upsert.create(df, root, ["half"])
    return root


def updates(spark, pairs):
    return spark.createDataFrame(pairs, "id long, v int")


def values(spark, root):
    return {r.id: (r.half, r.v, r.note) for r in upsert.read(spark, root).collect()}


def test_ten_updates_keep_most_files(spark, stored):
    want = values(spark, stored)
    assert len(want) == 1000
    before = {r.file for r in upsert._files(spark, stored).collect()}
    for i in range(10):
        rewritten, kept = upsert.upsert(spark, stored, updates(spark, [(i, -i), (i + 20, 5)]), "id", ["half"])
        assert rewritten <= 2 and rewritten + kept >= len(before) - 20
        want[i] = (i % 2, -i, "keep")
        want[i + 20] = (i % 2, 5, "keep")
    assert values(spark.newSession(), stored) == want
    after = {r.file for r in upsert._files(spark, stored).collect()}
    assert len(before & after) >= 0.9 * len(before)
    assert upsert.vacuum(spark, stored) > 0
    assert values(spark, stored) == want


def test_null_values_and_no_updates(spark, stored):
    upsert.upsert(spark, stored, updates(spark, [(3, None)]), "id", ["half"])
    assert values(spark, stored)[3] == (1, None, "keep")
    rewritten, _ = upsert.upsert(spark, stored, updates(spark, []), "id", ["half"])
    assert rewritten == 0


def test_errors_change_nothing(spark, stored):
    want = values(spark, stored)
    with pytest.raises(upsert.UnknownKeys):
        upsert.upsert(spark, stored, updates(spark, [(1, 2), (5000, 1)]), "id", ["half"])
    with pytest.raises(upsert.RepeatedKeys):
        upsert.upsert(spark, stored, updates(spark, [(1, 2), (1, 3)]), "id", ["half"])
    with pytest.raises(upsert.RepeatedKeys):
        upsert.upsert(spark, stored, updates(spark, [(None, 2)]), "id", ["half"])
    assert values(spark, stored) == want
    with pytest.raises(FileNotFoundError):
        upsert.read(spark, stored + "-none")


def test_scores_of_the_star(spark, small, tmp_path):
    root = str(tmp_path / "fact")
    fact = small.star.fact_subscription
    upsert.create(fact, root, ["churn_flag"])
    one = small.wide.orderBy("customer_id").limit(1).select("customer_id", F.lit(99).alias("churn_score"))
    rewritten, _ = rules.store_churn_scores(small.star, root, one)
    assert rewritten == 1
    got = upsert.read(spark, root)
    assert sorted(got.columns) == sorted(fact.columns)
    assert dict(got.dtypes) == dict(fact.dtypes)
    changed = got.select(*fact.columns).exceptAll(fact).collect()
    assert [r.churn_score for r in changed] in ([99], [])
    assert got.count() == fact.count()
    with pytest.raises(rules.UnknownCustomers):
        rules.store_churn_scores(small.star, root, one.withColumn("customer_id", F.lit("nobody")))
