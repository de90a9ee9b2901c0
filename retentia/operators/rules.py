"""Health score, call list and score updates."""

from pyspark.sql import functions as F

from retentia.functions.columns import ladder, mean, one_of, pct, rounded
from retentia.operators.kpis import whole
from retentia.operators.star import star_view
from retentia.schema import CONTRACT_POINTS, CONTRACT_POINTS_OTHER
from retentia.sources import upsert

# The weights 0.40, 0.25, 0.20 and 0.15 and the divisors 72 and 6 become whole numbers when the
# score is counted in 720ths; tiers are then decided without rounding error.
UNIT = 720


def health_units(score, tenure, addons, contract):
    points = one_of(contract, CONTRACT_POINTS, CONTRACT_POINTS_OTHER)
    return (
        (100 - score) * 288
        + F.least(F.lit(18000), tenure * 250)
        + F.least(F.lit(14400), addons * 2400)
        + points * 108
    )


def health_tier(units):
    return ladder(units, [(70 * UNIT, "Healthy"), (45 * UNIT, "Watch")], "At Risk")


def with_health(df):
    """Add customer_health_score (one digit) and health_tier (from the exact score)."""
    units = health_units(
        F.col("churn_score"),
        F.col("tenure_months"),
        F.col("addon_service_count"),
        F.col("contract_type"),
    )
    return df.withColumns(
        {
            "customer_health_score": rounded(units.cast("double") / UNIT, 1),
            "health_tier": health_tier(units),
        }
    )


HEALTH_COLUMNS = [
    "customer_id",
    "contract_type",
    "tenure_months",
    "monthly_charges",
    "cltv",
    "churn_score",
    "addon_service_count",
    "churn_flag",
    "customer_health_score",
    "health_tier",
]


def health_facts(star):
    """Health per fact row; only the plan is joined."""
    return with_health(star_view(star, "contract_type"))


def customer_health(star):
    """Always-fresh view: a lazy frame over the stored star."""
    ids = star.dim_customer.select("customer_key", "customer_id")
    return health_facts(star).join(ids, "customer_key").select(*HEALTH_COLUMNS)


def register_health_view(star, name="vw_customer_health_score"):
    customer_health(star).createOrReplaceTempView(name)
    return name


def lowest_health(star, n=10):
    """The n lowest scores; ids are looked up for those rows only (keys follow ids)."""
    worst = health_facts(star).orderBy("customer_health_score", "customer_key").limit(n)
    return (
        worst.join(star.dim_customer.select("customer_key", "customer_id"), "customer_key")
        .select("customer_id", "contract_type", "tenure_months", "cltv", "customer_health_score")
        .orderBy("customer_health_score", "customer_id")
    )


def above_average_at_risk(star):
    """At-risk customers whose value exceeds the mean value of all customers."""
    average = star.fact_subscription.agg(mean("cltv").alias("m")).scalar()
    return customer_health(star).where((F.col("health_tier") == "At Risk") & (F.col("cltv") > average)).orderBy(
        F.desc("cltv"), "customer_id"
    )


def health_tier_outcomes(star):
    per = health_facts(star).groupBy("health_tier").agg(
        F.count(F.lit(1)).alias("n_customers"),
        pct(F.sum("churn_flag"), F.count(F.lit(1))).alias("churn_rate_pct"),
        rounded(mean("cltv"), 2).alias("avg_cltv"),
    )
    return per.withColumn(
        "pct_of_base", pct(F.col("n_customers"), F.sum("n_customers").over(whole()))
    )


def health_score_agreement(star):
    """Correlation with the inverse vendor score, next to the mean vendor score per tier."""
    health = health_facts(star)
    r = health.agg(
        rounded(F.corr("customer_health_score", 100 - F.col("churn_score")), 3).alias("r")
    ).scalar()
    return (
        health.groupBy("health_tier")
        .agg(rounded(mean("churn_score"), 1).alias("avg_churn_score"))
        .withColumn("correlation", r)
    )


def high_risk_customers(star, threshold=70, contract=None):
    """Active customers at or above a score, most valuable first, with their health tier."""
    rows = customer_health(star).where(
        (F.col("churn_score") >= threshold) & (F.col("churn_flag") == 0)
    )
    if contract is not None:
        rows = rows.where(F.col("contract_type") == contract)
    return rows.select(
        "customer_id",
        "contract_type",
        "churn_score",
        "cltv",
        "monthly_charges",
        "tenure_months",
        "health_tier",
    ).orderBy(F.desc("cltv"), F.desc("churn_score"), "customer_id")


def join_health(star, fact_columns=("churn_score", "cltv")):
    """Fact rows joined to the health view by the natural key."""
    facts = star_view(star, "customer_id").select("customer_id", *fact_columns)
    return facts.join(
        customer_health(star).select("customer_id", "customer_health_score", "health_tier"),
        "customer_id",
    )


class UnknownCustomers(ValueError):
    pass


class InvalidUpdates(ValueError):
    pass


def checked_updates(star, updates):
    """(customer_key, churn_score) of updates (customer_id, churn_score).

    Ids missing from the customer dimension, ids that come twice and scores that are null or
    outside 0 to 100 are errors.
    """
    bad = updates.agg(
        F.count_if(~F.coalesce(F.col("churn_score").between(0, 100), F.lit(False))).alias("scores"),
        (F.count(F.lit(1)) - F.count_distinct("customer_id")).alias("repeated"),
    ).first()
    if bad.scores or bad.repeated:
        raise InvalidUpdates(
            f"{bad.scores} scores outside 0 to 100, {bad.repeated} repeated customer ids"
        )
    known = updates.join(
        star.dim_customer.select("customer_id", "customer_key"), "customer_id", "left"
    )
    unknown = known.where(F.col("customer_key").isNull()).select("customer_id")
    n = unknown.count()
    if n:
        some = [r.customer_id for r in unknown.limit(20).collect()]
        raise UnknownCustomers(f"{n} unknown customers, among them {some}")
    return known.select("customer_key", "churn_score")


def update_churn_scores(star, updates):
    """New fact with the scores of `updates` applied; nothing is stored (see `checked_updates`)."""
    new = checked_updates(star, updates).withColumnRenamed("churn_score", "_new")
    fact = star.fact_subscription
    return (
        fact.join(new, "customer_key", "left")
        .withColumn("churn_score", F.coalesce("_new", "churn_score").cast("int"))
        .select(*fact.columns)
    )


def store_churn_scores(star, root, updates):
    """Apply `updates` to the fact stored in a folder, rewriting only the files that hold them.

    Returns the numbers of rewritten and of kept files.
    """
    spark = updates.sparkSession
    return upsert.upsert(spark, root, checked_updates(star, updates), "customer_key", ["churn_flag"])
