"""Headline KPIs, rankings and cuts on the star schema."""

from pyspark.sql import Window as W, functions as F

from retentia.functions.columns import (
    churn_rate,
    churned,
    customers,
    mean,
    pct,
    rfm_label,
    rounded,
    total,
)
from retentia.operators.ranks import global_order, with_ntile
from retentia.operators.star import star_view

def whole():
    """The window over all rows; used on aggregates of a few rows only."""
    return W.partitionBy()


def _lost(col="monthly_charges"):
    return F.coalesce(F.sum(F.when(F.col("churn_flag") == 1, F.col(col))), F.lit(0)).cast("double")


def kpi_summary(star):
    """One row of headline figures. Dimension keys are checked at load, so no join is needed."""
    return star.fact_subscription.agg(
        customers().alias("total_customers"),
        churned().alias("churned_customers"),
        churn_rate().alias("churn_rate_pct"),
        total("total_charges").alias("total_billed_revenue"),
        total("monthly_charges").alias("current_mrr"),
        _lost().alias("mrr_at_risk_from_churned"),
        rounded(mean("cltv"), 2).alias("avg_cltv"),
        rounded(mean("tenure_months"), 2).alias("avg_tenure_months"),
    )


def headline_kpis(df):
    """The record shared by all pages; an empty table gives a rate of 0."""
    n, lost = customers(), F.coalesce(churned(), F.lit(0))
    return df.agg(
        n.alias("total_customers"),
        lost.alias("churned_customers"),
        (n - lost).alias("retained_customers"),
        F.coalesce(churn_rate(), F.lit(0.0)).alias("churn_rate_pct"),
        F.coalesce(total("total_charges"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(total("monthly_charges"), F.lit(0.0)).alias("current_mrr"),
        _lost().alias("mrr_at_risk"),
        rounded(mean("cltv"), 2).alias("avg_cltv"),
    )


def _risk_rank():
    return F.rank().over(W.orderBy(F.desc("churn_rate_pct"))).cast("bigint")


def _revenue_share():
    return pct(F.col("total_revenue"), F.sum("total_revenue").over(whole()))


def kpi_by_contract(star):
    """Contracts against the mean of the contract rates and against the rate of all customers."""
    per = star_view(star, "contract_type").groupBy("contract_type").agg(
        customers().alias("customers"),
        churned().alias("churned"),
        churn_rate().alias("churn_rate_pct"),
        rounded(mean("monthly_charges"), 2).alias("avg_monthly_charges"),
        total("total_charges").alias("total_revenue"),
    )
    segment_mean = F.avg("churn_rate_pct").over(whole())
    overall = pct(F.sum("churned").over(whole()), F.sum("customers").over(whole()))
    return per.select(
        "*",
        rounded(segment_mean, 2).alias("company_avg_churn_rate_pct"),
        rounded(F.col("churn_rate_pct") - segment_mean, 2).alias("churn_rate_vs_company_avg"),
        overall.alias("overall_churn_rate_pct"),
        _revenue_share().alias("pct_of_total_revenue"),
        _risk_rank().alias("churn_risk_rank"),
    ).orderBy("churn_risk_rank", "contract_type")


def kpi_cohort_progression(star):
    """Churn and revenue along the tenure cohorts, with the change from the cohort before."""
    per = star_view(star, "tenure_cohort_label", "sort_order").groupBy(
        "tenure_cohort_label", "sort_order"
    ).agg(
        customers().alias("customers"),
        churned().alias("churned"),
        churn_rate().alias("churn_rate_pct"),
        total("total_charges").alias("total_revenue"),
        F.sum("total_charges").alias("_revenue"),
    )
    along = W.orderBy("sort_order")
    before = F.lag("churn_rate_pct").over(along)
    running = F.sum("_revenue").over(along.rowsBetween(W.unboundedPreceding, W.currentRow))
    return (
        per.withColumns(
            {
                "prior_cohort_churn_rate": before,
                "churn_rate_change": rounded(F.col("churn_rate_pct") - before, 2),
                "cumulative_revenue_through_cohort": running.cast("double"),
            }
        )
        .orderBy("sort_order")
        .drop("_revenue", "sort_order")
    )


def top_churned_by_value(star, n=5):
    """The n churned customers of highest lifetime value per contract.

    Customer keys follow customer ids, so they break ties the same way, and names are looked up
    for the few rows that are left. The rank filter keeps n rows per contract in each task before
    the shuffle.
    """
    lost = star_view(star, "contract_type").where(F.col("churn_flag") == 1)
    place = F.row_number().over(
        W.partitionBy("contract_type").orderBy(F.desc("cltv"), "customer_key")
    )
    best = lost.withColumn("cltv_rank_within_contract", place).where(
        F.col("cltv_rank_within_contract") <= n
    )
    return (
        best.join(star.dim_customer.select("customer_key", "customer_id"), "customer_key")
        .join(star.dim_churn_reason, "churn_reason_key")
        .select(
            "customer_id",
            "contract_type",
            "cltv",
            "monthly_charges",
            "tenure_months",
            "churn_reason",
            "cltv_rank_within_contract",
        )
        .orderBy("contract_type", "cltv_rank_within_contract")
    )


RFM_VALUES = {
    "recency_quintile": "recency_tenure_months",
    "frequency_quintile": "frequency_addon_breadth",
    "monetary_quintile": "monetary_total_charges",
}


def rfm_ntiles(df, tie="customer_key", k=5):
    """The three quintile columns."""
    return with_ntile(df, RFM_VALUES, tie, k)


def _rfm_total():
    return sum((F.col(c) for c in RFM_VALUES), F.lit(0)).cast("int")


def rfm_facts(star, k=5):
    """Quintiles, total and segment per fact row, before any name is joined."""
    base = star.fact_subscription.select("customer_key", "churn_flag", *RFM_VALUES.values())
    return (
        rfm_ntiles(base, "customer_key", k)
        .withColumn("rfm_proxy_score", _rfm_total())
        .withColumn("rfm_segment", rfm_label(F.col("rfm_proxy_score")))
    )


def rfm_scores(star, k=5):
    ids = star.dim_customer.select("customer_key", "customer_id")
    return rfm_facts(star, k).join(ids, "customer_key").select(
        "customer_id", *RFM_VALUES, "rfm_proxy_score", "churn_flag", "rfm_segment"
    )


def rfm_distribution(star, k=5):
    """Customers and churn rate per total score."""
    return (
        rfm_facts(star, k)
        .groupBy(F.col("rfm_proxy_score").alias("rfm_score"))
        .agg(customers().alias("customers"), churn_rate().alias("churn_rate_pct"))
        .orderBy(F.desc("rfm_score"))
    )


def city_churn_rank(star, min_n=30, limit=15):
    """Cities with enough customers, worst churn first.

    Only cities ahead of a city count for its rank, so the rank is taken after the limit.
    """
    per = (
        star_view(star, "city")
        .groupBy("city")
        .agg(
            customers().alias("customers"),
            churned().alias("churned"),
            churn_rate().alias("churn_rate_pct"),
            total("total_charges").alias("total_revenue"),
        )
        .where(F.col("customers") >= min_n)
    )
    worst = per.orderBy(F.desc("churn_rate_pct"), "city").limit(limit)
    return worst.withColumn("churn_rank", _risk_rank()).orderBy("churn_rank", "city")


def kpi_by_payment(star):
    per = star_view(star, "payment_method").groupBy("payment_method").agg(
        customers().alias("customers"),
        churned().alias("churned"),
        churn_rate().alias("churn_rate_pct"),
        rounded(mean("tenure_months"), 2).alias("avg_tenure_months"),
        total("total_charges").alias("total_revenue"),
    )
    return per.select(
        "*",
        _revenue_share().alias("pct_of_total_revenue"),
        _risk_rank().alias("churn_risk_rank"),
    ).orderBy("churn_risk_rank", "payment_method")


def with_score_decile(df, tie="customer_key", k=10):
    return with_ntile(df, {"churn_score_decile": "churn_score"}, tie, k)


def score_deciles(star, k=10):
    """Calibration of the vendor score: outcome per NTILE of the score.

    Customer keys follow customer ids, so they break ties the same way.
    """
    base = star.fact_subscription.select(
        "customer_key", "churn_score", "churn_flag", "cltv", "monthly_charges"
    )
    return (
        with_score_decile(base, k=k)
        .groupBy("churn_score_decile")
        .agg(
            customers().alias("customers"),
            churned().alias("actual_churned"),
            churn_rate().alias("actual_churn_rate_pct"),
            rounded(mean("churn_score"), 1).alias("avg_churn_score"),
            rounded(mean("cltv"), 2).alias("avg_cltv"),
            total("monthly_charges").alias("total_monthly_revenue"),
        )
        .orderBy(F.desc("churn_score_decile"))
    )


def addon_tier_funnel(star):
    """Customers at each add-on count or above, and the churn change from the tier below."""
    per = star.fact_subscription.groupBy("addon_service_count").agg(
        customers().alias("customers"),
        churned().alias("churned"),
        churn_rate().alias("churn_rate_pct"),
        rounded(mean("monthly_charges"), 2).alias("avg_monthly_charges"),
    )
    down = W.orderBy(F.desc("addon_service_count")).rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    before = F.lag("churn_rate_pct").over(W.orderBy("addon_service_count"))
    return per.select(
        "*",
        F.sum("customers").over(down).alias("cumulative_customers_at_this_tier_or_above"),
        before.alias("prior_tier_churn_rate"),
        rounded(F.col("churn_rate_pct") - before, 2).alias("churn_rate_delta"),
    ).orderBy("addon_service_count")


def reason_pareto(star, cut=80):
    """Churn reasons by size with their running share; ties follow the reason's name."""
    per = (
        star_view(star, "churn_reason")
        .where(F.col("churn_flag") == 1)
        .groupBy("churn_reason")
        .agg(
            customers().alias("churned_customers"),
            total("monthly_charges").alias("lost_monthly_revenue"),
        )
    )
    n = F.col("churned_customers")
    down = W.orderBy(F.desc("churned_customers"), "churn_reason").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    share = per.select(
        "*",
        pct(n, F.sum(n).over(whole())).alias("pct_of_churn"),
        pct(F.sum(n).over(down), F.sum(n).over(whole())).alias("cumulative_pct_of_churn"),
    )
    core = F.col("cumulative_pct_of_churn") <= cut
    return share.withColumn(
        "pareto_bucket",
        F.when(core, F.lit(f"Core {cut}% driver")).otherwise(F.lit("Long tail")),
    ).orderBy(F.desc("churned_customers"), "churn_reason")


def with_precomputed_scores(star):
    """The fact with decile, quintiles, total score and segment stored as columns."""
    fact = with_score_decile(star.fact_subscription)
    fact = rfm_ntiles(fact)
    return fact.withColumnsRenamed({c: f"rfm_{c}" for c in RFM_VALUES}).withColumns(
        {
            "rfm_total_score": sum((F.col(f"rfm_{c}") for c in RFM_VALUES), F.lit(0)).cast("int"),
        }
    ).withColumn("rfm_segment", rfm_label(F.col("rfm_total_score")))


def first_share_of_revenue(df, percents=(10, 20, 50), tie="customer_id"):
    """Revenue share of the top floor(n * p / 100) customers by lifetime value."""
    ordered = global_order(
        df.select(tie, "cltv", "total_charges"), [F.desc("cltv"), tie], label="concentration"
    )
    picked = ordered.agg(
        F.max("n").alias("n"),
        F.sum("total_charges").alias("all"),
        *[
            F.sum(
                F.when(
                    F.col("rn") <= F.floor(F.col("n") * p / 100), F.col("total_charges")
                ).otherwise(0)
            ).alias(f"p{p}")
            for p in percents
        ],
    )
    rows = [
        F.struct(
            F.lit(p).cast("bigint").alias("top_pct"),
            F.floor(F.col("n") * p / 100).cast("bigint").alias("row_count"),
            pct(F.col(f"p{p}").cast("double"), F.col("all")).alias("revenue_share_pct"),
        )
        for p in percents
    ]
    return picked.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


