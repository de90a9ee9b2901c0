"""Evaluation of a scored table: label 0/1 and a score in [0, 1]."""

from pyspark.sql import functions as F

from retentia.functions.columns import mean, rounded
from retentia.operators.ranks import by_variable, exact_quantiles, global_order


def score_counts(df, label="label", score="score", by=()):
    """Positives and negatives per distinct score."""
    return df.groupBy(*by, score).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum(1 - F.col(label).cast("long")).alias("neg"),
    )


def auc(df, label="label", score="score", by=()):
    """Area under the ROC curve per group, by the rank sum over distinct scores (ties count half).

    Null where a group holds one class only.
    """
    counts = score_counts(df, label, score, by)
    ordered = global_order(counts, [*by, score], sums=["neg"], label="auc")
    p, n = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    below = F.min(F.col("run_neg") - F.col("neg")).cast("double")
    won = F.sum(F.col("pos") * (F.col("run_neg") - F.col("neg") / 2))
    area = F.try_divide(won - below * p, p * n).alias("auc")
    return ordered.groupBy(*by).agg(area) if by else ordered.agg(area)


def confusion(df, label="label", score="score", threshold=0.5, by=()):
    """Counts of the four outcomes at a threshold, per group."""
    yes, hit = F.col(label) == 1, F.col(score) >= threshold
    return df.groupBy(*by).agg(
        F.count_if(yes & hit).alias("tp"),
        F.count_if(~yes & hit).alias("fp"),
        F.count_if(yes & ~hit).alias("fn"),
        F.count_if(~yes & ~hit).alias("tn"),
    )


def quality_columns():
    """Precision, recall and F1 from the counts of `confusion`; 0 where undefined."""
    tp = F.col("tp").cast("double")
    precision = F.coalesce(F.try_divide(tp, tp + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp, tp + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + F.col("fp") + F.col("fn")), F.lit(0.0))
    return precision, recall, f1


def test_metrics(df, label="label", score="score", threshold=0.5):
    """AUC, precision, recall, F1 and the confusion matrix, in one row."""
    precision, recall, f1 = quality_columns()
    return (
        confusion(df, label, score, threshold)
        .withColumn("auc", auc(df, label, score).scalar())
        .select(
            rounded(F.col("auc"), 4).alias("roc_auc"),
            rounded(precision, 4).alias("precision"),
            rounded(recall, 4).alias("recall"),
            rounded(f1, 4).alias("f1"),
            "tp",
            "fp",
            "fn",
            "tn",
        )
    )


def curve_points(df, label="label", score="score"):
    """ROC and precision-recall points, one per distinct score used as threshold."""
    counts = score_counts(df, label, score)
    ordered = global_order(counts, [F.desc(score)], sums=["pos", "neg"], label="curve")
    totals = counts.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n")).alias("t"))
    tp, fp = F.col("run_pos").cast("double"), F.col("run_neg").cast("double")
    return ordered.withColumn("_t", totals.scalar()).select(
        F.col(score).alias("threshold"),
        F.col("run_pos").alias("true_positives"),
        F.col("run_neg").alias("false_positives"),
        rounded(F.try_divide(fp, F.col("_t.n").cast("double")), 6).alias("false_positive_rate"),
        rounded(F.try_divide(tp, F.col("_t.p").cast("double")), 6).alias("true_positive_rate"),
        rounded(F.try_divide(tp, tp + fp), 6).alias("precision"),
    )


THRESHOLD_GRID = [i / 100 for i in range(10, 90, 2)]


def threshold_costs(df, label="label", score="score", miss_cost=200, contact_cost=30):
    """Cost of every threshold of the grid, from one pass: missed churners and idle contacts."""
    yes = F.col(label) == 1
    counts = df.agg(
        *[F.count_if(yes & (F.col(score) < t)).alias(f"fn{i}") for i, t in enumerate(THRESHOLD_GRID)],
        *[F.count_if(~yes & (F.col(score) >= t)).alias(f"fp{i}") for i, t in enumerate(THRESHOLD_GRID)],
    )
    rows = [
        F.struct(
            F.lit(t).alias("threshold"),
            F.col(f"fn{i}").alias("false_negatives"),
            F.col(f"fp{i}").alias("false_positives"),
            (F.col(f"fn{i}") * miss_cost + F.col(f"fp{i}") * contact_cost).alias("total_cost"),
        )
        for i, t in enumerate(THRESHOLD_GRID)
    ]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def best_threshold(df, label="label", score="score", miss_cost=200, contact_cost=30):
    """The first cheapest threshold, next to the cost at the default of one half."""
    costs = threshold_costs(df, label, score, miss_cost, contact_cost)
    return costs.agg(
        F.min_by("threshold", F.struct("total_cost", "threshold")).alias("optimal_threshold"),
        F.min("total_cost").alias("min_total_cost"),
        F.min_by(
            "total_cost", F.struct(F.abs(F.col("threshold") - 0.5), F.col("threshold"))
        ).alias("cost_at_default"),
    )


def reliability_table(df, label="label", score="score", bins=10):
    """Mean score against observed rate per quantile bin; bins end at the inner edges."""
    edges = by_variable(exact_quantiles(df, [score], [i / bins for i in range(1, bins)]))
    bin_no = F.size(F.filter(F.col("_e"), lambda e: e < F.col(score))) + 1
    per = (
        df.withColumn("_e", edges[score])
        .groupBy(bin_no.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            rounded(F.avg(score), 3).alias("mean_predicted_probability"),
            rounded(mean(label), 3).alias("actual_churn_rate"),
        )
    )
    gap = F.abs(F.col("mean_predicted_probability") - F.col("actual_churn_rate"))
    return per.withColumn("abs_gap", rounded(gap, 3))


def notable_rows(df, id_col="customer_id", score="score"):
    """Ids of the highest, the lowest and the most undecided score; ties go to the smaller id."""
    picks = df.agg(
        F.min_by(id_col, F.struct(-F.col(score), F.col(id_col))).alias("highest"),
        F.min_by(id_col, F.struct(F.col(score), F.col(id_col))).alias("lowest"),
        F.min_by(id_col, F.struct(F.abs(F.col(score) - 0.5), F.col(id_col))).alias("borderline"),
    )
    return picks.unpivot([], ["highest", "lowest", "borderline"], "pick", id_col)


OVERFIT_GAP = 0.05


def overfit_report(train_scored, test_scored, label="label", score="score"):
    """In-sample against held-out AUC, with a warning flag for a wide gap."""
    one = auc(train_scored, label, score).withColumnRenamed("auc", "train_auc")
    return one.withColumn("test_auc", auc(test_scored, label, score).scalar()).withColumns(
        {
            "gap": F.col("train_auc") - F.col("test_auc"),
            "overfit_warning": F.col("train_auc") - F.col("test_auc") > OVERFIT_GAP,
        }
    )
