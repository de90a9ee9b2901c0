"""Churn classifiers: comparison, tuning, final model, importances and batch scoring."""

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from retentia.functions.columns import ladder
from retentia.operators.models import store, trees
from retentia.operators.models.evaluate import auc, confusion, quality_columns
from retentia.operators.models.prep import (
    CHURN,
    CHURN_EXTENDED,
    Sizes,
    category_levels,
    encoded_folds,
    encoding_stages,
    fit_width,
    slot_names,
    with_folds,
    with_split,
)
from retentia.session import in_parallel
from retentia.sources.staging import stage

LABEL = "churn_flag"
OUTREACH_THRESHOLD = 0.10


def boosted(sizes):
    return GBTClassifier(
        labelCol=LABEL,
        maxIter=sizes.boost_rounds,
        maxDepth=sizes.boost_depth,
        stepSize=sizes.boost_step,
        seed=sizes.seed,
    )


def candidates(sizes, rows):
    """The three compared classifiers; the first two weigh both classes alike."""
    return {
        "Logistic Regression": LogisticRegression(
            labelCol=LABEL,
            weightCol="weight",
            maxIter=2000,
            regParam=1.0 / max(rows, 1),
            standardization=False,
        ),
        "Random Forest": RandomForestClassifier(
            labelCol=LABEL,
            weightCol="weight",
            numTrees=sizes.forest_trees,
            maxDepth=sizes.forest_depth,
            seed=sizes.seed,
        ),
        "Gradient Boosting": boosted(sizes),
    }


def fit_pipeline(train, estimator, features=CHURN):
    """Encoding fitted on the training rows only, then the estimator."""
    stages = [*encoding_stages(category_levels(train, features), features), estimator]
    return Pipeline(stages=stages).fit(train)


def churn_probability(model, df, *keep):
    """Kept columns plus `score`, the probability of the positive label."""
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias("score"))


def fold_table(scored, label, groups):
    """AUC, precision, recall and F1 per group and fold of held-out scores, then their means."""
    by = [*groups, "fold"]
    precision, recall, f1 = quality_columns()
    per = confusion(scored, label, by=by).select(
        *by, precision.alias("precision"), recall.alias("recall"), f1.alias("f1")
    )
    per = per.join(auc(scored, label, "score", by=by), by)
    return per.groupBy(*groups).agg(
        F.round(F.avg("auc"), 4).alias("roc_auc_mean"),
        F.round(F.stddev_pop("auc"), 4).alias("roc_auc_std"),
        F.round(F.avg("precision"), 4).alias("precision_mean"),
        F.round(F.avg("recall"), 4).alias("recall_mean"),
        F.round(F.avg("f1"), 4).alias("f1_mean"),
    )


def held_out_scores(folds, fits, label):
    """Staged held-out scores of fits {(name, fold): model}, with the name as `model`."""
    parts = [
        churn_probability(m, folds[f].held, label, "fold").withColumn("model", F.lit(name))
        for (name, f), m in fits.items()
    ]
    return stage(reduce(lambda a, b: a.unionByName(b), parts), "held-out")


def cross_validate(df, sizes=Sizes(), features=CHURN, names=None):
    """Stratified k-fold comparison.

    Every fold is encoded once; the models of all folds are fitted as concurrent Spark jobs over
    these vectors. The held-out scores of all of them form one staged table, and every metric comes
    from that table at once.
    """
    keep = [*features.columns, LABEL, "customer_id"]
    folded = with_folds(df.select(*keep), LABEL, sizes.folds)
    folds, rows = encoded_folds(folded, features, LABEL, sizes.folds)
    names = names or list(candidates(sizes, rows))
    jobs = [(n, f) for n in names for f in range(sizes.folds)]
    models = in_parallel(
        [lambda n=n, f=f: candidates(sizes, rows)[n].fit(folds[f].train) for n, f in jobs],
        fit_width(df.sparkSession, rows),
    )
    return fold_table(held_out_scores(folds, dict(zip(jobs, models)), LABEL), LABEL, ["model"])


def compare_feature_sets(df, sizes=Sizes()):
    """Boosted trees with the base features against base plus cohort and revenue rate."""
    parts = []
    for name, feats in (("base", CHURN), ("extended", CHURN_EXTENDED)):
        table = cross_validate(df, sizes, feats, ["Gradient Boosting"])
        parts.append(
            table.select(F.lit(name).alias("feature_set"), "roc_auc_mean", "roc_auc_std", "f1_mean")
        )
    return parts[0].unionByName(parts[1])


# --- fixed values: tuning grid of the boosted trees ---
GRID = {"maxIter": [100, 150, 200], "maxDepth": [2, 3, 4], "stepSize": [0.05, 0.1, 0.2]}


@dataclass
class Tuned:
    """Mean AUC per grid point in the order of `points`, and the best point fitted on all rows."""

    points: list
    scores: list
    bestModel: PipelineModel


def tune(train, grid=GRID, features=CHURN, folds=3, seed=42, parallelism=None):
    """Grid search by cross-validated AUC.

    Boosting adds trees one by one, so the first n trees of a long fit are the fit of n rounds:
    each (depth, step, fold) is fitted once with the most rounds, and its held-out rows are scored
    with every number of rounds of the grid. Every fold is encoded once, with the levels of its own
    training rows, so a level that occurs in the held-out rows alone is no error.
    """
    points = _points(grid)
    scores = _tuning_scores(train, grid, points, features, folds, seed, parallelism)
    best = points[scores.index(max(scores))]
    final = GBTClassifier(labelCol=LABEL, seed=seed, **best)
    return Tuned(points, scores, store.fit_once(train, final, features, fit_pipeline))


def _points(grid):
    names = list(grid)
    return [dict(zip(names, values)) for values in product(*grid.values())]


def _tuning_scores(train, grid, points, features, folds, seed, parallelism):
    """Mean AUC of each point; the table of them is kept in the model store."""
    key = store.model_key(
        train, GBTClassifier(labelCol=LABEL, seed=seed), features, grid=grid, folds=folds)
    schema = "rounds int, maxDepth int, stepSize double, m double"
    spark = train.sparkSession
    rows = store.kept(
        spark, key,
        lambda: _tuning_means(train, grid, features, folds, seed, parallelism, key),
        lambda table, path: table.write.parquet(path),
        lambda path: spark.read.schema(schema).parquet(path).collect())
    means = {(r.rounds, r.maxDepth, r.stepSize): r.m for r in rows}
    return [means[p["maxIter"], p["maxDepth"], float(p["stepSize"])] for p in points]


def _tuning_means(train, grid, features, folds, seed, parallelism, key):
    """Mean AUC by rounds, depth and step.

    The nodes of each fit are kept in the store as it ends, so a tuning that was stopped goes on
    from there.
    """
    rounds, spark = sorted(grid["maxIter"]), train.sparkSession
    folded = with_folds(train.select(*features.columns, LABEL, "customer_id"), LABEL, folds)
    encoded, rows = encoded_folds(folded, features, LABEL, folds, balanced=False)

    def nodes(depth, step, fold):
        gbt = GBTClassifier(
            labelCol=LABEL, seed=seed, maxIter=rounds[-1], maxDepth=depth, stepSize=step)
        return store.kept(
            spark, f"{key}-{depth}-{step}-{fold}",
            lambda: trees.node_table(gbt.fit(encoded[fold].train)),
            lambda table, path: table.coalesce(1).write.parquet(path), spark.read.parquet)

    jobs = list(product(grid["maxDepth"], grid["stepSize"], range(folds)))
    tables = in_parallel(
        [lambda j=j: nodes(*j) for j in jobs], parallelism or fit_width(spark, rows))
    held_out = [
        trees.prefix_scores(table, depth, encoded[fold].held, rounds, LABEL, "fold")
        .withColumns({"maxDepth": F.lit(depth), "stepSize": F.lit(float(step))})
        for (depth, step, fold), table in zip(jobs, tables)
    ]
    scored = stage(reduce(lambda a, b: a.unionByName(b), held_out), "tuning")
    point = ["rounds", "maxDepth", "stepSize"]
    per = auc(scored, LABEL, "score", by=[*point, "fold"])
    return per.groupBy(*point).agg(F.avg("auc").alias("m"))


def tuning_table(spark, tuned):
    """Mean AUC per grid point, best first."""
    rows = [
        (p["maxIter"], p["maxDepth"], float(p["stepSize"]), round(float(score), 4))
        for p, score in zip(tuned.points, tuned.scores)
    ]
    schema = "rounds int, depth int, step double, roc_auc_mean double"
    return spark.createDataFrame(rows, schema).orderBy(F.desc("roc_auc_mean"), "rounds", "depth", "step")


def split_frames(df, features=CHURN, extra=()):
    """Training and held-out rows of the stratified 80/20 split."""
    keep = list(dict.fromkeys([*features.columns, LABEL, "customer_id", *extra]))
    parts = with_split(df.select(*keep), LABEL)
    return (
        parts.where("is_train").drop("is_train"),
        parts.where(~F.col("is_train")).drop("is_train"),
    )


def feature_importance(spark, model, names):
    """Built-in importance per encoded feature, largest first."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(n, round(float(v), 4)) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def encoded_names(train, features=CHURN):
    return slot_names(category_levels(train, features), features)


def cancellation_band(p):
    return ladder(p, [(0.35, "High Risk"), (0.20, "Moderate Risk")], "Low Risk")


def score_subscribers(df, churn_model, ltv_model, threshold=OUTREACH_THRESHOLD):
    """Churn and renewal probability, band, outreach flag and predicted value for every row."""
    scored = churn_probability(churn_model, df, *df.columns)
    valued = ltv_model.transform(scored)
    return valued.select(
        "customer_id",
        F.col("score").alias("churn_probability"),
        (1 - F.col("score")).alias("renewal_probability"),
        cancellation_band(F.col("score")).alias("risk_band"),
        (F.col("score") >= threshold).alias("flag_for_outreach"),
        F.col("prediction").alias("predicted_cltv"),
    )
