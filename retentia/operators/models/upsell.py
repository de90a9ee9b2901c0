"""Which add-on to offer next: a propensity model per service, best service per customer."""

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from retentia.functions.columns import rounded
from retentia.operators.features import eligible_for
from retentia.operators.models import store
from retentia.operators.models.churn import churn_probability, fit_pipeline
from retentia.operators.models.evaluate import auc
from retentia.operators.models.prep import (
    UPSELL,
    Sizes,
    encoded_folds,
    fit_width,
    with_balanced_weight,
    with_folds,
)
from retentia.schema import ADDONS, NO_INTERNET
from retentia.session import in_parallel
from retentia.sources.staging import stage

TARGET = "holds_service"


def _forest(sizes):
    return RandomForestClassifier(
        labelCol=TARGET,
        weightCol="weight",
        numTrees=sizes.addon_trees,
        maxDepth=sizes.addon_depth,
        seed=sizes.seed,
    )


def training_rows(df, service):
    """Eligible customers with the target; add-on counts stay out, they contain the target."""
    return eligible_for(df, service).select(
        "customer_id", *UPSELL.columns, (F.col(service) == "Yes").cast("int").alias(TARGET)
    )


def fit_service(df, service, sizes=Sizes()):
    rows = with_balanced_weight(training_rows(df, service), TARGET)
    return store.fit_once(rows, _forest(sizes), UPSELL, fit_pipeline)


def fit_services(df, sizes=Sizes(), services=ADDONS):
    """The final model of each service, stored or loaded; fits over many rows run fewer at once."""
    models = in_parallel(
        [lambda s=s: fit_service(df, s, sizes) for s in services],
        fit_width(df.sparkSession, df.count()),
    )
    return dict(zip(services, models))


def eligibility(df, services=ADDONS):
    """Eligible customers and adoption rate per service, from one aggregate and without a fit."""
    counts = [
        F.struct(
            F.lit(s).alias("service"),
            F.count_if(F.col(s) != NO_INTERNET).alias("n"),
            F.count_if(F.col(s) == "Yes").alias("held"),
        )
        for s in services
    ]
    rate = F.try_divide(100.0 * F.col("held"), F.col("n").cast("double"))
    return df.agg(F.array(*counts).alias("r")).select(F.inline("r")).select(
        "service",
        F.col("n").alias("n_eligible_customers"),
        F.round(rate, 2).alias("current_adoption_rate_pct"),
    )


def service_metrics(df, sizes=Sizes(), services=ADDONS):
    """Eligible customers, adoption rate and cross-validated AUC per service.

    Held-out scores of all services and folds form one staged table.
    """
    k, encoded, rows = sizes.folds, {}, 0
    for service in services:
        folded = with_folds(training_rows(df, service), TARGET, k)
        encoded[service], n = encoded_folds(folded, UPSELL, TARGET, k)
        rows = max(rows, n)
    jobs = [(s, f) for s in services for f in range(sizes.folds)]
    models = in_parallel(
        [lambda s=s, f=f: _forest(sizes).fit(encoded[s][f].train) for s, f in jobs],
        fit_width(df.sparkSession, rows),
    )
    parts = [
        churn_probability(m, encoded[s][f].held, TARGET, "fold").withColumn("service", F.lit(s))
        for (s, f), m in zip(jobs, models)
    ]
    scored = stage(reduce(lambda a, b: a.unionByName(b), parts), "held-out")
    areas = auc(scored, TARGET, "score", by=["service", "fold"])
    return eligibility(df, services).join(
        areas.groupBy("service").agg(
            F.round(F.avg("auc"), 4).alias("cv_roc_auc_mean"),
            F.round(F.stddev_pop("auc"), 4).alias("cv_roc_auc_std"),
        ),
        "service",
    )


def non_adopters(df, service, active_only=False):
    rows = df.where(F.col(service) == "No")
    return rows.where(F.col("churn_flag") == 0) if active_only else rows


def score_services(df, models, active_only=False):
    """(customer_id, service, fit_probability) for every service a customer could still take."""
    parts = [
        churn_probability(model, non_adopters(df, service, active_only), "customer_id").select(
            "customer_id",
            F.lit(service).alias("service"),
            rounded(F.col("score"), 4).alias("fit_probability"),
        )
        for service, model in models.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def best_service(scores):
    """One service per customer: the highest fit, the first name on a tie."""
    order = F.struct(-F.col("fit_probability"), F.col("service"))
    return scores.groupBy("customer_id").agg(
        F.min_by("service", order).alias("recommended_service"),
        F.max("fit_probability").alias("fit_probability"),
    )


def service_distribution(best):
    return best.groupBy("recommended_service").agg(F.count(F.lit(1)).alias("customers"))


def most_confident(best, n=10):
    return best.orderBy(F.desc("fit_probability"), "customer_id").limit(n)
