"""Trees as tables, prefix scores, encoded folds, the model store and the value comparison."""

import threading

import duckdb
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from retentia.operators.models import churn, ltv, prep, store, trees, upsell
from retentia.operators.models.prep import CHURN, LTV, Sizes, encoded_folds, with_folds
from retentia.session import in_parallel

SMALL = Sizes(
    forest_trees=4, forest_depth=3, boost_rounds=4, boost_depth=2, addon_trees=3, addon_depth=2,
    folds=2, restarts=1)


def gbt(rounds):
    return churn.GBTClassifier(
        labelCol=churn.LABEL, seed=7, maxIter=rounds, maxDepth=3, stepSize=0.1)


@pytest.fixture(scope="module")
def rows(small):
    return churn.split_frames(small.wide)[0]


@pytest.fixture(scope="module")
def boosted(rows):
    return churn.fit_pipeline(rows, gbt(5))


def gap(a, b):
    both = a.join(b.withColumnRenamed("score", "other"), "customer_id")
    return both.agg(F.max(F.abs(F.col("score") - F.col("other"))), F.count("*")).first()


def test_walk_equals_models(rows, small, boosted):
    n = rows.count()
    forest = churn.fit_pipeline(
        rows.withColumn("weight", F.lit(1.0)), churn.candidates(SMALL, n)["Random Forest"])
    for model in (boosted, forest):
        encoded = model.transform(rows)
        own = churn.churn_probability(model, rows, "customer_id")
        assert gap(trees.walk_scores(model, encoded, "customer_id"), own) == (pytest.approx(0, abs=1e-9), n)
    for name in ("Random Forest", "Gradient Boosting"):
        value, test = ltv.fit_final(small.wide, name, SMALL)
        own = value.transform(test).select("customer_id", F.col("prediction").alias("score"))
        got = trees.walk_scores(value, value.transform(test), "customer_id")
        assert gap(got, own)[0] == pytest.approx(0, abs=1e-6)


def test_duckdb_scores_the_nodes(rows, boosted, tmp_path):
    trees.node_table(boosted).write.parquet(str(tmp_path / "nodes"))
    encoded = boosted.transform(rows).select(
        "customer_id", vector_to_array("features").alias("x"),
        vector_to_array("probability")[1].alias("p"))
    encoded.write.parquet(str(tmp_path / "rows"))
    far, n = duckdb.sql(f"""
        WITH RECURSIVE nodes AS (SELECT * FROM '{tmp_path}/nodes/*.parquet'),
        rows AS (SELECT * FROM '{tmp_path}/rows/*.parquet'),
        walk AS (
          SELECT customer_id, x, tree, node FROM rows, (SELECT tree, node FROM nodes WHERE node = 0)
          UNION ALL
          SELECT customer_id, x, w.tree,
                 CASE WHEN x[n.feature + 1] <= n.threshold THEN n."left" ELSE n."right" END
          FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node
          WHERE n.feature IS NOT NULL
        ), scores AS (
          SELECT customer_id, 1 / (1 + exp(-2 * sum(n.weight * n.value))) AS s
          FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node
          WHERE n.feature IS NULL GROUP BY customer_id
        ) SELECT max(abs(s - p)), count(*) FROM scores JOIN rows USING (customer_id)""").fetchall()[0]
    assert far < 1e-9 and n == rows.count()


def test_prefix_is_the_shorter_fit(rows, boosted):
    encoded = boosted.transform(rows)
    scores = trees.prefix_scores(trees.node_table(boosted), 3, encoded, [2, 5], "customer_id")
    for rounds in (2, 5):
        one = churn.churn_probability(churn.fit_pipeline(rows, gbt(rounds)), rows, "customer_id")
        part = scores.where(F.col("rounds") == rounds).drop("rounds")
        assert gap(part, one)[0] == pytest.approx(0, abs=1e-12)


def test_encoded_folds_hold_every_row(rows):
    folded = with_folds(rows, churn.LABEL, 3)
    folds, n = encoded_folds(folded, CHURN, churn.LABEL, 3)
    assert n == rows.count()
    for f in folds:
        assert f.train.count() + f.held.count() == n
        assert [r.fold for r in f.held.select("fold").distinct().collect()] == [f.fold]
        weights = f.train.groupBy(churn.LABEL).agg(F.sum("weight").alias("w")).collect()
        assert weights[0].w == pytest.approx(weights[1].w)


def test_store_fits_once(spark, rows, monkeypatch, tmp_path):
    monkeypatch.setattr(store, "shared_dir", lambda _: str(tmp_path))
    fits = []

    def fit(*args):
        fits.append(1)
        return churn.fit_pipeline(*args)

    one = store.fit_once(rows, gbt(2), CHURN, fit)
    again = store.fit_once(rows.repartition(5), gbt(2), CHURN, fit)
    assert len(fits) == 1
    pair = [churn.churn_probability(m, rows, "customer_id") for m in (one, again)]
    assert gap(*pair)[0] == 0
    store.fit_once(rows, gbt(3), CHURN, fit)  # another parameter
    store.fit_once(rows.where("tenure_months > 2"), gbt(2), CHURN, fit)  # other rows
    store.fit_once(rows, gbt(2), LTV, fit)  # other features
    assert len(fits) == 4


def test_tuning_is_kept_and_goes_on(rows, monkeypatch, tmp_path):
    monkeypatch.setattr(store, "shared_dir", lambda _: str(tmp_path))
    grid = {"maxIter": [1, 3], "maxDepth": [2], "stepSize": [0.1, 0.2]}
    one = churn.tune(rows, grid, folds=2)
    assert len(one.points) == 4 and all(0 <= s <= 1 for s in one.scores)
    monkeypatch.setattr(trees, "node_table", None)  # nothing is fitted again
    assert churn.tune(rows, grid, folds=2).scores == one.scores


def test_value_comparison_and_winner(small):
    table = ltv.run_ltv(small.wide, SMALL)
    got = {r.model: r for r in table.collect()}
    assert set(got) == {"Linear Regression", "Random Forest", "Gradient Boosting"}
    best = max(got.values(), key=lambda r: r.r2_mean)
    assert [r.model for r in got.values() if r.is_winner] == [best.model]
    assert best.test_rmse >= best.test_mae > 0
    assert [r.test_r2 for r in got.values() if not r.is_winner] == [None, None]


def test_service_metrics_read_encoded_folds(small):
    got = {r.service: r for r in upsell.service_metrics(small.wide, SMALL).collect()}
    assert all(0 <= r.cv_roc_auc_mean <= 1 for r in got.values())


def test_eligibility_fits_nothing(spark, monkeypatch):
    monkeypatch.setattr(upsell, "_forest", None)
    rows = [("a", "Yes", "No"), ("b", "No", "No internet service"), ("c", "No internet service", None)]
    df = spark.createDataFrame(rows, "customer_id string, tech_support string, streaming_tv string")
    got = upsell.eligibility(df, ["tech_support", "streaming_tv"]).collect()
    assert [tuple(r) for r in got] == [("tech_support", 2, 50.0), ("streaming_tv", 1, 0.0)]


def test_parallel_tasks_have_their_own_properties(spark):
    together = threading.Barrier(4)

    def task(i):
        spark.sparkContext.setLocalProperty("retentia.task", str(i))
        together.wait(60)
        return spark.sparkContext.getLocalProperty("retentia.task")

    assert in_parallel([lambda i=i: task(i) for i in range(4)], 4) == ["0", "1", "2", "3"]


def test_walk_scores_are_not_walked_in_sql(rows, boosted, monkeypatch):
    monkeypatch.setattr(trees, "STRIP", 3)
    encoded = boosted.transform(rows)
    got = trees.walk_scores(boosted, encoded, "customer_id")
    assert "lambda" not in got._jdf.queryExecution().analyzed().toString()
    own = churn.churn_probability(boosted, rows, "customer_id")
    assert gap(got, own) == (pytest.approx(0, abs=1e-9), rows.count())


def test_fewer_fits_at_once_the_more_rows(spark, small, monkeypatch):
    slots = max(4, min(32, spark.sparkContext.defaultParallelism))
    assert prep.fit_width(spark, 0) == prep.fit_width(spark, 60_000) == slots
    assert prep.fit_width(spark, 10_000_000) == 2
    held, most, lock = [], [], threading.Lock()
    forest = upsell._forest

    class Counted:
        def __init__(self, sizes):
            self.own = forest(sizes)

        def fit(self, rows):
            with lock:
                held.append(1)
                most.append(len(held))
            try:
                return self.own.fit(rows)
            finally:
                with lock:
                    held.pop()

    monkeypatch.setattr(upsell, "_forest", Counted)
    monkeypatch.setattr(prep, "ROWS_PER_TASK", 10)
    upsell.service_metrics(small.wide, SMALL, ["tech_support", "streaming_tv"])
    assert max(most) <= 2
