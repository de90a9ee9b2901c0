"""Registry of reusable measures, evaluated in a filter context and at any grain.

A filter context is a dict column -> allowed values, so that a measure that ignores the plan
(`share of all plans`) can drop just the plan filters.
"""

from pyspark.sql import Window as W, functions as F

from retentia.functions.columns import (
    as_dollars,
    as_millions,
    as_percent,
    kpi_color,
    ladder,
    mean,
    one_of,
    rfm_label,
    rounded,
)
from retentia.operators.kpis import RFM_VALUES, with_score_decile
from retentia.operators.ranks import by_variable, exact_quantiles, global_order, with_rank
from retentia.operators.star import star_view
from retentia.schema import CONTRACT_POINTS, CONTRACT_POINTS_OTHER, SERVICE_PLAN_COLUMNS

DIGITS = 6
PLAN_COLUMNS = {*SERVICE_PLAN_COLUMNS, "contract_based_risk_tier"}


def _n(distinct, cond=None):
    """Customers in context. The load enforces one fact row per customer, so counting rows is
    the distinct count; distinct=True counts keys for frames that skipped the load checks."""
    if distinct:
        return F.count_distinct(F.col("customer_key") if cond is None else F.when(cond, F.col("customer_key")))
    return F.count(F.lit(1)) if cond is None else F.count_if(cond)


def _ratio(a, b):
    """a / b, 0 when b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _lost():
    return F.col("churn_flag") == 1


def _mrr_at_risk():
    return F.coalesce(
        F.sum(F.when(_lost(), F.col("monthly_charges"))).cast("double"), F.lit(0.0)
    )


def _single_contract():
    """The contract in context, null when several are visible."""
    c = "contract_type"
    return F.when(F.min(c) == F.max(c), F.min(c))


def _health_parts():
    return {
        "churn_risk": 100 - mean("churn_score"),
        "tenure": F.least(F.lit(100.0), mean("tenure_months") * 100 / 72),
        "addon": F.least(F.lit(100.0), mean("addon_service_count") * 100 / 6),
        "contract": one_of(_single_contract(), CONTRACT_POINTS, CONTRACT_POINTS_OTHER),
    }


def _health_score():
    p = _health_parts()
    return rounded(
        0.40 * p["churn_risk"] + 0.25 * p["tenure"] + 0.20 * p["addon"] + 0.15 * p["contract"],
        DIGITS,
    )


def _r(c):
    return rounded(c, DIGITS)


# name -> aggregate Column, given whether customers are counted by key
MEASURES = {
    "total_customers": lambda d: _n(d),
    "churned_customers": lambda d: _n(d, _lost()),
    "retained_customers": lambda d: _n(d, F.col("churn_flag") == 0),
    "churn_rate": lambda d: _r(_ratio(_n(d, _lost()), _n(d))),
    "retention_rate": lambda d: _r(1 - _ratio(_n(d, _lost()), _n(d))),
    "total_billed_revenue": lambda d: F.sum("total_charges").cast("double"),
    "current_mrr": lambda d: F.sum("monthly_charges").cast("double"),
    "mrr_at_risk": lambda d: _mrr_at_risk(),
    "avg_cltv": lambda d: _r(mean("cltv")),
    "avg_tenure_months": lambda d: _r(mean("tenure_months")),
    "avg_monthly_charges": lambda d: _r(mean("monthly_charges")),
    "avg_addon_services": lambda d: _r(mean("addon_service_count")),
    "revenue_per_customer": lambda d: _r(_ratio(F.sum("total_charges"), _n(d))),
    "revenue_at_risk_pct": lambda d: _r(_ratio(_mrr_at_risk(), F.sum("monthly_charges"))),
    "avg_revenue_per_tenure_month": lambda d: _r(mean("avg_revenue_per_tenure_month")),
    "health_churn_risk_component": lambda d: _r(_health_parts()["churn_risk"]),
    "health_tenure_component": lambda d: _r(_health_parts()["tenure"]),
    "health_addon_component": lambda d: _r(_health_parts()["addon"]),
    "health_contract_component": lambda d: _health_parts()["contract"],
    "customer_health_score": lambda d: _health_score(),
    "health_tier": lambda d: ladder(_health_score(), [(70, "Healthy"), (45, "Watch")], "At Risk"),
    "avg_churn_score": lambda d: _r(mean("churn_score")),
    "calibration_gap": lambda d: _r(
        F.abs(mean("churn_score") / 100 - _ratio(_n(d, _lost()), _n(d)))
    ),
    "churn_rate_formatted": lambda d: as_percent(_ratio(_n(d, _lost()), _n(d))),
    "total_billed_revenue_formatted": lambda d: as_millions(F.sum("total_charges")),
    "mrr_at_risk_formatted": lambda d: as_dollars(_mrr_at_risk()),
    "churn_rate_kpi_color": lambda d: kpi_color(100 * _ratio(_n(d, _lost()), _n(d))),
}
# measures that look beyond the plan in context
ALL_PLANS = {"pct_of_total_revenue"}


def in_context(df, where):
    for column, allowed in (where or {}).items():
        df = df.where(F.col(column).isin(list(allowed)))
    return df


def evaluate(df, measures, by=(), where=None, distinct=False):
    """One row per group of `by` with the named measures."""
    by = list(by)
    plain = [MEASURES[m](distinct).alias(m) for m in measures if m not in ALL_PLANS]
    shares = [m for m in measures if m in ALL_PLANS]
    if shares:
        plain.append(F.sum("total_charges").cast("double").alias("_revenue"))
    scoped = in_context(df, where)
    out = scoped.groupBy(*by).agg(*plain) if by else scoped.agg(*plain)
    if shares:
        outer = [c for c in by if c not in PLAN_COLUMNS]
        context = {c: v for c, v in (where or {}).items() if c not in PLAN_COLUMNS}
        everything = F.sum("total_charges").cast("double").alias("_all")
        base = in_context(df, context)
        if outer:
            keys = [F.col(c).alias(f"_{c}") for c in outer]
            wider = base.groupBy(*keys).agg(everything)
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in outer]
            out = out.join(wider, same).drop(*[f"_{c}" for c in outer])
        else:
            out = out.withColumn("_all", base.agg(everything).scalar())
        out = out.withColumn(
            "pct_of_total_revenue", _r(_ratio(F.col("_revenue"), F.col("_all")))
        ).drop("_revenue", "_all")
    return out.select(*by, *measures)


SEGMENT_BY = [
    "contract_type",
    "internet_service",
    "payment_method",
    "tenure_cohort_label",
    "gender",
    "senior_citizen",
]
CHARTED = [
    "churn_rate",
    "avg_cltv",
    "total_billed_revenue",
    "avg_tenure_months",
    "customer_health_score",
]


def segment_metrics(star, dims=SEGMENT_BY, metrics=CHARTED):
    """Every metric for every value of every dimension, in one pass over the fact."""
    view = star_view(star, *dict.fromkeys([*dims, "contract_type"]))
    pairs = [
        F.struct(F.lit(d).alias("segment_by"), F.col(d).cast("string").alias("segment"))
        for d in dims
    ]
    tall = view.withColumn("_p", F.explode(F.array(*pairs))).select("*", "_p.*").drop("_p")
    return evaluate(tall, metrics, ["segment_by", "segment"])


# --- value concentration and ranks -----------------------------------------------------------


def top_share(star, pct=20):
    """Revenue share of the customers whose value rank is within the top pct, ties included.

    Equal values share a rank, so counts per value are enough; no row is sorted.
    """
    per_value = star.fact_subscription.groupBy("cltv").agg(
        F.count(F.lit(1)).alias("c"), F.sum("total_charges").alias("revenue")
    )
    ordered = global_order(per_value, [F.desc("cltv")], sums=["c"], label="top-share")
    n = per_value.agg(F.sum("c").alias("n")).scalar()
    inside = F.col("run_c") - F.col("c") + 1 <= F.ceil(n * pct / 100)
    return ordered.agg(
        _r(
            F.try_divide(
                F.sum(F.when(inside, F.col("revenue")).otherwise(0)).cast("double"),
                F.sum("revenue").cast("double"),
            )
        ).alias("revenue_share"),
        F.sum(F.when(inside, F.col("c")).otherwise(0)).alias("customers"),
    )


def value_rank(star, within=None):
    """Rank of each customer by lifetime value, over all or inside one plan attribute."""
    keys = [within] if within else []
    base = star_view(star, *keys).select("customer_key", *keys, "cltv")
    ordered = global_order(base, [*keys, F.desc("cltv"), "customer_key"], label="value-rank")
    ranked = with_rank(ordered, [*keys, "cltv"], "cltv_rank")
    if within:
        starts = ordered.groupBy(within).agg(F.min("rn").alias("_first"))
        ranked = ranked.join(F.broadcast(starts), within).withColumn(
            "cltv_rank", F.col("cltv_rank") - F.col("_first") + 1
        )
    ids = star.dim_customer.select("customer_key", "customer_id")
    return ranked.join(ids, "customer_key").select("customer_id", *keys, "cltv", "cltv_rank")


def contract_risk_rank(star):
    rates = evaluate(star_view(star, "contract_type"), ["churn_rate"], ["contract_type"])
    return rates.withColumn(
        "churn_risk_rank", F.rank().over(W.orderBy(F.desc("churn_rate"))).cast("bigint")
    )


# --- along the tenure cohorts ----------------------------------------------------------------


def _per_cohort(star):
    return star_view(star, "tenure_cohort_label", "sort_order").groupBy(
        "tenure_cohort_label", "sort_order"
    ).agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("churn_flag").alias("churned"),
        F.sum("total_charges").alias("revenue"),
    )


def cohort_change(star):
    """Rate of the cohort numbered one lower; a missing cohort gives null, not the one before."""
    per = _per_cohort(star).select(
        "tenure_cohort_label",
        "sort_order",
        _r(_ratio(F.col("churned"), F.col("customers"))).alias("churn_rate"),
    )
    prior = per.select(
        (F.col("sort_order") + 1).alias("sort_order"), F.col("churn_rate").alias("prior_churn_rate")
    )
    return per.join(prior, "sort_order", "left").withColumn(
        "churn_rate_change", _r(F.col("churn_rate") - F.col("prior_churn_rate"))
    )


def cohort_cumulative(star):
    along = W.orderBy("sort_order").rangeBetween(W.unboundedPreceding, W.currentRow)
    return _per_cohort(star).select(
        "tenure_cohort_label",
        "sort_order",
        F.sum("revenue").over(along).cast("double").alias("cumulative_revenue"),
        F.sum("customers").over(along).alias("cumulative_customers"),
    )


def rolling_cohort_rate(star, width=3):
    """Churn rate pooled over the cohort and the width - 1 before it."""
    span = W.orderBy("sort_order").rangeBetween(1 - width, W.currentRow)
    return _per_cohort(star).select(
        "tenure_cohort_label",
        "sort_order",
        _r(_ratio(F.sum("churned").over(span), F.sum("customers").over(span))).alias(
            "rolling_churn_rate"
        ),
    )


# --- scores ----------------------------------------------------------------------------------

CUTS = [0.2, 0.4, 0.6, 0.8]


def rfm_by_percentile(star):
    """Quintiles by percentile thresholds; a value on a threshold belongs to the upper one."""
    base = star.fact_subscription.select("customer_key", *RFM_VALUES.values())
    cuts = by_variable(exact_quantiles(base, list(RFM_VALUES.values()), CUTS))
    at = lambda value: sum(
        (F.col(value).cast("double") >= F.col("_q")[value][i]).cast("int") for i in range(len(CUTS))
    )
    scored = base.withColumn("_q", cuts).select(
        "customer_key", *[(at(v) + 1).alias(name) for name, v in RFM_VALUES.items()]
    )
    ids = star.dim_customer.select("customer_key", "customer_id")
    scored = scored.join(ids, "customer_key").drop("customer_key")
    return scored.withColumn(
        "rfm_proxy_score", sum((F.col(c) for c in RFM_VALUES), F.lit(0)).cast("int")
    ).withColumn("rfm_segment", rfm_label(F.col("rfm_proxy_score")))


HEALTH_MEASURES = [
    "health_churn_risk_component",
    "health_tenure_component",
    "health_addon_component",
    "health_contract_component",
    "customer_health_score",
    "health_tier",
]


def aggregate_health(star, by=("contract_type",)):
    """Components from group averages; not the mean of the customers' scores."""
    view = star_view(star, *dict.fromkeys([*by, "contract_type"]))
    return evaluate(view, HEALTH_MEASURES, by)


def calibration_gap(star):
    base = star.fact_subscription.select("customer_key", "churn_score", "churn_flag")
    names = ["avg_churn_score", "churn_rate", "calibration_gap"]
    return evaluate(with_score_decile(base), names, ["churn_score_decile"])


# --- matrices and drill-through --------------------------------------------------------------


def churn_matrix(star, rows, cols, values):
    """Churn percentage per cell; `values` fixes the columns, so no extra pass looks for them."""
    rate = rounded(100 * mean("churn_flag"), 2)
    return star_view(star, rows, cols).groupBy(rows).pivot(cols, values).agg(rate)


def drill_through(star, cell, columns=("customer_id",)):
    """The fact rows behind one aggregate cell, given as column -> value."""
    view = star_view(star, *dict.fromkeys([*cell, *columns]))
    for column, value in cell.items():
        view = view.where(F.col(column).eqNullSafe(F.lit(value)))
    return view
