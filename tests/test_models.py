"""Models by their properties, evaluation by brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from retentia.operators.models import churn, evaluate, explain, ltv, segment, upsell
from retentia.operators.models.prep import (
    CHURN,
    CHURN_EXTENDED,
    LTV,
    UPSELL,
    Features,
    Sizes,
    category_levels,
    encoding_stages,
    slot_names,
    slot_places,
    stratified_position,
    training_folds,
    with_folds,
    with_split,
)
from retentia.operators.regress import logistic_regression

TINY = Sizes(
    forest_trees=5, forest_depth=3, boost_rounds=3, addon_trees=4, addon_depth=3, folds=2, restarts=1
)


@pytest.fixture(scope="module")
def scores(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(300):
        label = int(rnd.random() < 0.4)
        score = 0.5 if i % 3 == 0 else round(min(1.0, max(0.0, rnd.gauss(0.4 + 0.2 * label, 0.2))), 2)
        rows.append((f"c{i:03d}", label, score))
    return spark.createDataFrame(rows, "customer_id string, label int, score double"), rows


def brute_auc(rows):
    pos = [s for _, y, s in rows if y]
    neg = [s for _, y, s in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)


def test_auc_counts_pairs(many_ranges, scores):
    df, rows = scores
    assert evaluate.auc(df).first().auc == pytest.approx(brute_auc(rows))
    halves = df.withColumn("g", F.substring("customer_id", 4, 1).cast("int") % 2)
    got = {r.g: r.auc for r in evaluate.auc(halves, by=["g"]).collect()}
    for g in (0, 1):
        assert got[g] == pytest.approx(brute_auc([r for r in rows if int(r[0][3]) % 2 == g]))
    assert evaluate.auc(df.where("label = 1")).first().auc is None


def test_curve_ends_at_one(many_ranges, scores):
    df, rows = scores
    last = evaluate.curve_points(df).orderBy("threshold").first()
    assert (last.false_positive_rate, last.true_positive_rate) == (1.0, 1.0)
    assert last.true_positives == sum(r[1] for r in rows)


def test_threshold_grid(scores):
    df, rows = scores
    assert len(evaluate.THRESHOLD_GRID) == 40
    best = evaluate.best_threshold(df).first()
    cost = lambda t: sum(200 * (y and s < t) + 30 * (not y and s >= t) for _, y, s in rows)
    costs = [(cost(t), t) for t in evaluate.THRESHOLD_GRID]
    assert (best.min_total_cost, best.optimal_threshold) == min(costs)
    assert best.cost_at_default == cost(0.5)


def test_reliability_bins_follow_inner_edges(many_ranges, scores):
    df, rows = scores
    s = np.array([r[2] for r in rows])
    inner = np.quantile(s, [i / 10 for i in range(1, 10)])
    want = np.bincount(np.searchsorted(inner, s), minlength=10)
    got = {r.bin: r.rows for r in evaluate.reliability_table(df).collect()}
    assert got == {i + 1: int(c) for i, c in enumerate(want) if c}


def test_split_and_folds_are_stratified_and_repeatable(small):
    rows = small.wide.select("customer_id", "churn_flag")
    a = {r.customer_id: r.is_train for r in with_split(rows, "churn_flag").collect()}
    b = {r.customer_id: r.is_train for r in with_split(rows, "churn_flag").collect()}
    assert a == b and len(a) == rows.count()
    folds = with_folds(rows, "churn_flag", 5).groupBy("churn_flag", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in folds if r.churn_flag == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    placed = stratified_position(rows, "churn_flag")
    assert placed.groupBy("churn_flag").agg(F.max("_pos") == F.max("_label_n")).first()[1]


def test_balanced_weights(small):
    folded = with_folds(small.wide.select("customer_id", "churn_flag"), "churn_flag", 3)
    frames, n = training_folds(folded, "churn_flag", 3)
    assert n == small.wide.count()
    sums = frames[0].groupBy("churn_flag").agg(F.sum("weight")).collect()
    assert sums[0][1] == pytest.approx(sums[1][1])


def test_encoding_drops_first_level_and_zeros_unseen(spark):
    train = spark.createDataFrame(
        [(1.0, "a", "it's"), (2.0, "b", "it's"), (3.0, "c", "it's")], "x double, k string, one string"
    )
    feats = Features(("x",), ("k", "one"))
    levels = category_levels(train, feats)
    assert levels == {"k": ["a", "b", "c"]}
    assert slot_names(levels, feats) == ["x", "k_c", "k_b"]
    model = Pipeline(stages=encoding_stages(levels, feats)).fit(train)
    new = spark.createDataFrame(
        [(2.0, "a", "?"), (2.0, "b", "?"), (2.0, "c", "?"), (2.0, "zzz", "?"), (2.0, None, "?")],
        train.schema,
    )
    got = model.transform(new).select(vector_to_array("features")).collect()
    assert [list(r[0]) for r in got] == [
        [0, 0, 0], [0, 0, 1], [0, 1, 0], [0, 0, 0], [0, 0, 0],
    ]


def test_many_levels_and_a_level_in_one_fold_only(spark):
    many = spark.range(3000).select(F.col("id").cast("string").alias("k"), F.lit(1.0).alias("x"))
    assert len(category_levels(many, Features(("x",), ("k",)))["k"]) == 3000
    rows = [(f"c{k}", float(k % 7), "rare" if k == 5 else "ab"[k % 2], int(k % 3 == 0)) for k in range(90)]
    df = spark.createDataFrame(rows, "customer_id string, x double, k string, churn_flag int")
    grid = {"maxIter": [2], "maxDepth": [1, 2], "stepSize": [0.1]}
    tuned = churn.tune(df, grid, Features(("x",), ("k",)), folds=3)
    assert len(tuned.scores) == 2 and all(0 <= s <= 1 for s in tuned.scores)


def test_vendor_fields_are_no_features():
    for feats in (CHURN, CHURN_EXTENDED):
        assert not {"churn_score", "cltv", "churn_flag"} & set(feats.columns)
    assert "cltv" not in LTV.columns and "addon_service_count" not in UPSELL.columns


@pytest.fixture(scope="module")
def fitted(small):
    train, test = churn.split_frames(small.wide)
    return train, test, churn.fit_pipeline(train, churn.boosted(TINY))


def test_same_seed_same_scores(fitted):
    train, test, model = fitted
    again = churn.fit_pipeline(train, churn.boosted(TINY))
    a = churn.churn_probability(model, test, "customer_id").orderBy("customer_id").collect()
    b = churn.churn_probability(again, test, "customer_id").orderBy("customer_id").collect()
    assert a == b and all(0 <= r.score <= 1 for r in a)


def test_cross_validation_table(small):
    out = churn.cross_validate(small.wide, TINY).collect()
    assert {r.model for r in out} == {"Logistic Regression", "Random Forest", "Gradient Boosting"}
    assert max(r.roc_auc_mean for r in out) > 0.6


def test_unused_feature_has_no_permutation_loss(small, fitted):
    train, test, model = fitted
    names = churn.encoded_names(train)
    weights = dict(zip(names, model.stages[-1].featureImportances.toArray()))
    out = {r.feature: r for r in explain.permutation_importance(model, test, repeats=2).collect()}
    assert set(out) == set(CHURN.columns)
    idle = [c for c in CHURN.columns if not any(w for n, w in weights.items() if n.startswith(c))]
    assert idle and all(out[c].importance_mean == 0 for c in idle)


def test_permuted_vectors_score_as_permuted_rows(small, fitted):
    _, test, model = fitted
    got = explain.permutation_scores(model, test, repeats=2)
    rows = test.withColumns({c: F.col(c).cast("double") for c in CHURN.numeric})
    mixed = explain.shuffled(explain.numbered(rows), rows, CHURN, 1)
    for place, name in ((0, "tenure_months"), (len(CHURN.numeric), "contract_type")):
        one = mixed.withColumn(name, F.col(f"d_{name}"))
        want = churn.churn_probability(model, one, churn.LABEL)
        same = got.where(F.col("variant") == len(CHURN.columns) + place).drop("variant")
        assert sorted(want.collect()) == sorted(same.collect()) or not same.count()
    # unchanged rows are scored once, and nothing is scored for features without a split
    weights = model.stages[-1].featureImportances.toArray()
    used = sum(any(weights[i] > 0 for i in at) for at in slot_places(model, CHURN).values())
    assert got.where("variant = -1").count() == test.count()
    assert got.count() == test.count() * (1 + 2 * used)


def test_shuffle_keeps_the_values(many_ranges, small):
    feats = Features(("tenure_months",), ("gender",))
    rows = small.wide.select("customer_id", "tenure_months", "gender")
    mixed = explain.shuffled(explain.numbered(rows), rows, feats, 0).collect()
    assert sorted(r.tenure_months for r in mixed) == sorted(r.d_tenure_months for r in mixed)
    assert any(r.tenure_months != r.d_tenure_months for r in mixed)


def test_local_explanation_rows(small, fitted):
    _, test, model = fitted
    one = test.orderBy("customer_id").limit(1)
    out = explain.local_explanations(model, one, small.wide).collect()
    assert [r.feature for r in out] != [] and len(out) == len(CHURN.columns)
    shifts = [abs(r.probability_shift_if_typical) for r in out]
    assert shifts == sorted(shifts, reverse=True)


def test_value_model_and_batch_scores(small, fitted):
    train, test, model = fitted
    value, held = ltv.fit_final(small.wide, sizes=TINY)
    m = ltv.regression_metrics(value.transform(held)).first()
    assert m.rmse >= m.mae > 0
    out = churn.score_subscribers(small.wide, model, value)
    assert out.count() == small.wide.count()
    bad = out.where(
        (F.abs(F.col("churn_probability") + F.col("renewal_probability") - 1) > 1e-12)
        | (F.col("flag_for_outreach") != (F.col("churn_probability") >= 0.10))
    )
    assert bad.count() == 0


def test_churn_queries_fit_no_value_model(small, monkeypatch):
    from checks import queries_models as q

    def no_fit(*args, **more):
        raise AssertionError("no value model is needed")

    monkeypatch.setattr(q, "_FITTED", {})
    monkeypatch.setattr(q.store, "fit_once", lambda *args: "churn model")
    monkeypatch.setattr(q.ltv, "fit_final", no_fit)
    train, test, model = q.churn_fitted(small)
    assert model == "churn model" and train.count() + test.count() == small.wide.count()
    monkeypatch.setattr(q.ltv, "fit_final", lambda *args, **more: ("value model", None))
    assert q.both_fitted(small) == ("churn model", "value model")


def test_segments_cover_everyone(small):
    labelled, _ = segment.assign_clusters(small.wide, 3, TINY)
    profile = segment.tag_clusters(segment.profile_clusters(labelled)).collect()
    assert sum(r.n_customers for r in profile) == small.wide.count()
    tags = ", ".join(r.descriptive_tags for r in profile)
    assert "Highest CLTV" in tags and "Lowest churn risk" in tags


def test_best_service_breaks_ties_by_name(spark):
    rows = [("a", "s2", 0.5), ("a", "s1", 0.5), ("a", "s3", 0.1), ("b", "s3", 0.9)]
    df = spark.createDataFrame(rows, "customer_id string, service string, fit_probability double")
    out = {r.customer_id: r.recommended_service for r in upsell.best_service(df).collect()}
    assert out == {"a": "s1", "b": "s3"}


def test_recommendations_skip_holders_and_churned(small):
    model = upsell.fit_service(small.wide, "tech_support", TINY)
    out = upsell.score_services(small.wide, {"tech_support": model}, active_only=True)
    want = small.wide.where("tech_support = 'No' and churn_flag = 0")
    assert out.count() == want.count()


def test_addon_models_are_stored(small, monkeypatch, tmp_path):
    fits, fit = [], upsell.fit_pipeline

    def counted(*args):
        fits.append(args)
        return fit(*args)

    monkeypatch.setattr(upsell, "fit_pipeline", counted)
    monkeypatch.setattr(upsell.store, "shared_dir", lambda spark: str(tmp_path))  # an empty store
    sizes, services = Sizes(addon_trees=3, addon_depth=2, seed=7), ["tech_support", "online_backup"]
    for _ in range(2):
        models = upsell.fit_services(small.wide, sizes, services)
    assert list(models) == services and len(fits) == 2


def test_logit_against_newton_steps(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(200):
        a, b = rnd.gauss(0, 1), rnd.gauss(3, 2)
        rows.append((a, b, int(rnd.random() < 1 / (1 + math.exp(-(0.3 + a - 0.4 * b))))))
    df = spark.createDataFrame(rows, "a double, b double, churn_flag int")
    got = logistic_regression(df, ["a", "b"], standardize=True).collect()
    x = np.array([r[:2] for r in rows])
    x = (x - x.mean(0)) / x.std(0)
    x = np.column_stack([np.ones(len(x)), x])
    y = np.array([r[2] for r in rows])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        info = x.T @ (x * (p * (1 - p))[:, None])
        beta = beta + np.linalg.solve(info, x.T @ (y - p))
    se = np.sqrt(np.diag(np.linalg.inv(info)))
    null = y.mean()
    ll = (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()
    ll0 = (y * np.log(null) + (1 - y) * np.log(1 - null)).sum()
    assert [r.coefficient for r in got] == pytest.approx(list(beta), rel=1e-4)
    assert [r.std_error for r in got] == pytest.approx(list(se), rel=1e-4)
    assert got[0].mcfadden_r2 == pytest.approx(1 - ll / ll0, rel=1e-4)


def test_tuning_queries_use_the_whole_grid(spark, monkeypatch):
    """Both queries share one tuning of all 27 points; the comparison has the default sizes."""
    from checks import queries_models as Q
    from checks.queries import QUERIES
    from retentia.operators.models.prep import Sizes
    from tests.conftest import SMALL

    calls = []

    def tune(train, grid=churn.GRID, *args, **kwargs):
        points = [dict(zip(grid, v)) for v in churn.product(*grid.values())]
        calls.append(churn.Tuned(points, [0.5] * len(points), None))
        return calls[-1]

    def run_churn(wide, sizes=Sizes(), grid=churn.GRID, tuned=None):
        assert sizes == Sizes() and tuned is calls[0]
        return wide

    monkeypatch.setattr(Q, "_FITTED", {})
    monkeypatch.setattr(Q.churn, "tune", tune)
    monkeypatch.setattr(Q.jobs, "run_churn", run_churn)
    assert QUERIES["m3_tuning_grid"](spark, SMALL).count() == 27
    QUERIES["m12_churn_pipeline"](spark, SMALL)
    assert len(calls) == 1


def test_segmentation_takes_the_judged_models(small, monkeypatch):
    monkeypatch.setattr(segment, "fit_kmeans", None)  # both sizes were fitted for the table
    rows = segment.run_segmentation(small.wide, [4, 5], TINY).collect()
    assert sum(r.choice == "business" for r in rows) == 5
    assert sum(r.n_customers for r in rows) == 2 * small.wide.count()


@pytest.mark.parametrize("most_runs", [1, 24])
def test_silhouette_sums_travel_packed(spark, monkeypatch, most_runs):
    """Equal, single and tiny-distance points over many small blocks, strips and parts."""
    for name, value in (("BLOCK", 8), ("STRIP", (3, 5)), ("PART", 4), ("MOST_RUNS", most_runs)):
        monkeypatch.setattr(segment, name, value)
    rnd = random.Random(4)
    rows = []
    for i in range(90):
        x = [rnd.gauss(0, 1), rnd.gauss(50, 3)]
        labels = [int(x[0] > 0), min(2, int(x[1]) // 3 % 3), 0 if i else 1]
        rows += [(x, labels)] * rnd.choice([1, 1, 3])
    rows.append(([rows[0][0][0] + 1e-7, rows[0][0][1]], rows[0][1]))
    rows = [(i, x, labels) for i, (x, labels) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id int, x array<double>, labels array<int>")
    x = np.array([r[1] for r in rows])
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = {r.k: r.silhouette for r in segment.euclidean_silhouettes(df).collect()}
    for k in range(3):
        of = np.array([r[2][k] for r in rows])
        want = []
        for i in range(len(rows)):
            mates = (of == of[i]).sum() - 1
            near = far[i, of == of[i]].sum() / mates if mates else None
            other = min(far[i, of == c].mean() for c in set(of) - {of[i]})
            want.append((other - near) / max(near, other) if mates else 0.0)
        assert got[k] == pytest.approx(np.mean(want), abs=1e-7)
    points = df.groupBy("x", "labels").count().withColumnRenamed("count", "n")
    per = segment._block_sums(points, [2, 3, 2])
    # one row per point comes from the packed parts of its block, none per point and pair
    assert per.count() == points.count()
    assert "FlatMapGroupsInArrow" in per._jdf.queryExecution().executedPlan().toString()
