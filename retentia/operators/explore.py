"""Breakdowns, distributions and profiles of the wide table."""

from pyspark.sql import Window as W, functions as F

from retentia.functions.columns import (
    churn_rate,
    churned,
    customers,
    mean,
    mean_where,
    payment_group,
    pct,
    rounded,
    total,
)
from retentia.operators.features import cohort_order, eligible_for  # noqa: F401
from retentia.operators.kpis import first_share_of_revenue, whole
from retentia.operators.ranks import (
    by_variable,
    edge_bin,
    exact_quantiles,
    global_order,
)
from retentia.schema import ADDONS, CONTRACTS, INTERNET, NO_INTERNET


def tall(df, cols, keep, name="dimension", value="value"):
    """(name, value, keep...) with one row per listed column, so many breakdowns share a scan."""
    pairs = [
        F.struct(F.lit(c).alias(name), F.col(c).cast("string").alias(value)) for c in cols
    ]
    return df.select(*keep, F.explode(F.array(*pairs)).alias("_p")).select(
        *keep, f"_p.{name}", f"_p.{value}"
    )


def overview_metrics(df):
    lost = F.col("churn_flag") == 1
    median = by_variable(exact_quantiles(df, ["tenure_months"], [0.5]))["tenure_months"][0]
    n = customers()
    row = df.agg(
        n.alias("total_customers"),
        churned().alias("churned_customers"),
        (n - churned()).alias("retained_customers"),
        churn_rate().alias("overall_churn_rate_pct"),
        total("total_charges").alias("total_billed_revenue"),
        total("monthly_charges").alias("monthly_recurring_revenue"),
        rounded(mean("monthly_charges"), 2).alias("avg_monthly_charges"),
        rounded(mean("tenure_months"), 2).alias("avg_tenure_months"),
        rounded(mean("cltv"), 2).alias("avg_cltv"),
        rounded(mean_where(lost, "cltv"), 2).alias("avg_cltv_churned"),
        rounded(mean_where(~lost, "cltv"), 2).alias("avg_cltv_retained"),
        F.sum(F.when(lost, F.col("monthly_charges")).otherwise(0))
        .cast("double")
        .alias("revenue_at_risk_from_churned_monthly"),
    )
    return row.withColumn("median_tenure_months", rounded(median, 2))


def _breakdown_columns():
    return [
        customers().alias("customers"),
        churned().alias("churned"),
        rounded(mean("monthly_charges"), 2).alias("avg_monthly_charges"),
        rounded(mean("tenure_months"), 2).alias("avg_tenure"),
        rounded(mean("cltv"), 2).alias("avg_cltv"),
        total("total_charges").alias("total_revenue"),
        churn_rate().alias("churn_rate_pct"),
    ]


def churn_by_categorical(df, col):
    """One breakdown, worst churn first; rows with a null category are left out."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(*_breakdown_columns())
        .orderBy(F.desc("churn_rate_pct"), col)
    )


BREAKDOWNS = [
    "payment_method",
    "tenure_cohort",
    "contract_type",
    "internet_service",
    "gender",
    "senior_citizen",
    "has_partner",
    "has_dependents",
]
_MEASURED = ["churn_flag", "monthly_charges", "tenure_months", "cltv", "total_charges"]


def breakdowns(df, cols=BREAKDOWNS):
    """The same breakdown for many columns in one scan."""
    return (
        tall(df, cols, _MEASURED)
        .where(F.col("value").isNotNull())
        .groupBy("dimension", "value")
        .agg(*_breakdown_columns())
    )


def top_cities(df, n=10, min_customers=5):
    """Top cities by revenue and by churn rate as (ranking, position, ...) rows."""
    per = (
        df.groupBy("city")
        .agg(
            customers().alias("customers"),
            churned().alias("churned"),
            total("total_charges").alias("total_revenue"),
            churn_rate().alias("churn_rate_pct"),
        )
        .where(F.col("customers") >= min_customers)
    )
    parts = []
    for ranking, by in (("revenue", "total_revenue"), ("churn_rate", "churn_rate_pct")):
        order = [F.desc(by), F.col("city")]
        best = per.orderBy(*order).limit(n)  # n rows are left for the window below
        parts.append(
            best.withColumns(
                {
                    "ranking": F.lit(ranking),
                    "position": F.row_number().over(W.orderBy(*order)).cast("bigint"),
                }
            )
        )
    return parts[0].unionByName(parts[1])


def addon_analysis(df):
    return (
        df.groupBy("addon_service_count")
        .agg(
            customers().alias("customers"),
            churned().alias("churned"),
            rounded(mean("monthly_charges"), 2).alias("avg_monthly_charges"),
            churn_rate().alias("churn_rate_pct"),
        )
        .orderBy("addon_service_count")
    )


def churn_reason_breakdown(df):
    per = (
        df.where(F.col("churn_flag") == 1)
        .groupBy("churn_reason")
        .agg(
            customers().alias("customers"),
            rounded(mean("monthly_charges"), 2).alias("avg_monthly_charges"),
            rounded(mean("tenure_months"), 2).alias("avg_tenure"),
            total("monthly_charges").alias("lost_monthly_revenue"),
        )
    )
    share = pct(F.col("customers"), F.sum("customers").over(whole()))
    return per.withColumn("pct_of_churn", share).orderBy(F.desc("customers"), "churn_reason")


def quantile_bins(df, value, k, name):
    """Add the bin of each value among its k-quantile edges; equal edges are merged."""
    edges = by_variable(exact_quantiles(df, [value], [i / k for i in range(k + 1)]))
    binned = df.withColumn("_edges", edges[value]).withColumn(
        name, edge_bin(F.col(value), F.col("_edges"))
    )
    return binned.drop("_edges")


def score_bins(df, k=10):
    """Vendor score by quantile edges, so equal scores always share a bin."""
    return (
        quantile_bins(df, "churn_score", k, "churn_score_decile")
        .groupBy("churn_score_decile")
        .agg(
            customers().alias("customers"),
            churned().alias("actual_churned"),
            rounded(mean("churn_score"), 1).alias("avg_churn_score"),
            rounded(mean("cltv"), 2).alias("avg_cltv"),
            total("monthly_charges").alias("total_monthly_revenue"),
            churn_rate().alias("actual_churn_rate_pct"),
        )
        .orderBy(F.desc("churn_score_decile"))
    )


CORRELATED = [
    "tenure_months",
    "monthly_charges",
    "total_charges",
    "churn_score",
    "cltv",
    "addon_service_count",
    "avg_revenue_per_tenure_month",
    "churn_flag",
]


def correlation_matrix(df, cols=CORRELATED):
    """Pearson correlations in long form; each pair is computed once, in one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    num = lambda c: F.col(c).cast("double")
    row = df.agg(
        *[rounded(F.corr(num(a), num(b)), 3).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    )
    cells = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("r"))
        for i, pair in enumerate(pairs)
        for a, b in (pair, pair[::-1])
    ]
    cells += [
        F.struct(F.lit(c).alias("x"), F.lit(c).alias("y"), F.lit(1.0).alias("r")) for c in cols
    ]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


# --- fixed values: names of the funnel stages ---
FUNNEL = {
    "total_customers": lambda: F.lit(True),
    "has_phone_service": lambda: F.col("phone_service_bool"),
    "has_internet_service": lambda: F.col("has_internet"),
    "has_phone_and_internet": lambda: F.col("has_phone_and_internet"),
    "has_1plus_addon_services": lambda: F.col("addon_service_count") >= 1,
    "has_3plus_addon_services": lambda: F.col("addon_service_count") >= 3,
    "full_addon_bundle_all6": lambda: F.col("addon_service_count") == 6,
}


def service_funnel(df):
    counts = df.agg(*[F.count_if(cond()).alias(stage) for stage, cond in FUNNEL.items()])
    rows = [
        F.struct(
            F.lit(i).cast("bigint").alias("step"),
            F.lit(stage).alias("stage"),
            F.col(stage).alias("customers"),
            pct(F.col(stage), F.col("total_customers")).alias("pct"),
        )
        for i, stage in enumerate(FUNNEL)
    ]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def revenue_concentration(df, percents=(10, 20, 50)):
    return first_share_of_revenue(df, percents)


def revenue_curve(df):
    """Cumulative share of customers and of revenue, most valuable customers first."""
    base = df.select("customer_id", "cltv", "total_charges")
    ordered = global_order(
        base, [F.desc("cltv"), F.col("customer_id")], sums=["total_charges"], label="curve"
    )
    revenue = base.agg(F.sum("total_charges").alias("t")).scalar()
    return ordered.select(
        "customer_id",
        "cltv",
        rounded(100 * F.col("run_total_charges").cast("double") / revenue.cast("double"), 4).alias(
            "cum_revenue_pct"
        ),
        rounded(100 * F.col("rn").cast("double") / F.col("n"), 4).alias("cum_customer_pct"),
    )


def status_split(df):
    status = F.when(F.col("churn_flag") == 1, F.lit("Churned")).otherwise(F.lit("Retained"))
    return df.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("count"))


def cohort_revenue(df):
    """Cumulative revenue along the cohorts in their fixed order."""
    per = (
        df.where(F.col("tenure_cohort").isNotNull())
        .groupBy("tenure_cohort")
        .agg(F.sum("total_charges").alias("revenue"))
        .withColumn("sort_order", cohort_order(F.col("tenure_cohort")))
    )
    along = W.orderBy("sort_order").rowsBetween(W.unboundedPreceding, W.currentRow)
    return per.select(
        "tenure_cohort",
        "sort_order",
        F.sum("revenue").over(along).cast("double").alias("cumulative_revenue"),
    )


def internet_contract_matrix(df):
    """Churn percentage by internet service (rows) and contract (columns), in risk order."""
    cells = df.groupBy("internet_service").pivot("contract_type", CONTRACTS).agg(
        rounded(100 * mean("churn_flag"), 2)
    )
    place = F.array_position(F.array(*map(F.lit, INTERNET)), F.col("internet_service"))
    return cells.withColumn("row_order", place).orderBy("row_order")


def plan_combinations(df, min_customers=20):
    return (
        df.groupBy("contract_type", "internet_service", "payment_method")
        .agg(
            customers().alias("customers"),
            churn_rate().alias("churn_rate"),
            rounded(mean("monthly_charges"), 2).alias("avg_monthly"),
        )
        .where(F.col("customers") >= min_customers)
        .orderBy(F.desc("churn_rate"), "contract_type", "internet_service", "payment_method")
    )


def addon_adoption(df):
    """Share of eligible customers holding each add-on."""
    rows = tall(df, ADDONS, [], "service", "holds").where(F.col("holds") != NO_INTERNET)
    return (
        rows.groupBy("service")
        .agg(
            F.count(F.lit(1)).alias("eligible"),
            pct(F.count_if(F.col("holds") == "Yes"), F.count(F.lit(1))).alias("adoption_rate_pct"),
        )
        .orderBy("adoption_rate_pct", "service")
    )


def eligible_summary(df):
    """Eligible rows per add-on with their mean value."""
    rows = tall(df, ADDONS, ["cltv"], "service", "holds").where(F.col("holds") != NO_INTERNET)
    return rows.groupBy("service").agg(
        F.count(F.lit(1)).alias("eligible"), rounded(mean("cltv"), 2).alias("avg_cltv")
    )


def city_stats(df):
    return df.groupBy("city").agg(
        customers().alias("customers"),
        churned().alias("churned"),
        total("total_charges").alias("total_revenue"),
        rounded(mean("cltv"), 2).alias("avg_cltv"),
        rounded(mean("latitude"), 6).alias("latitude"),
        rounded(mean("longitude"), 6).alias("longitude"),
        churn_rate().alias("churn_rate_pct"),
    )


# --- fixed values: keyword groups of the stated reasons ---
REASON_GROUPS = {"competitor": "(?i)competitor", "service": "(?i)attitude|support|network|speed"}


def top_reasons(df, n=8):
    """Share of churned customers per stated reason, largest first."""
    per = (
        df.where(F.col("churn_flag") == 1)
        .groupBy("churn_reason")
        .agg(F.count(F.lit(1)).alias("customers"))
        .withColumn("share_pct", pct(F.col("customers"), F.sum("customers").over(whole())))
    )
    return per.orderBy(F.desc("customers"), "churn_reason").limit(n)


def reason_groups(df, groups=REASON_GROUPS):
    """Share of churned customers whose reason falls in each keyword group."""
    hit = lambda p: F.coalesce(F.col("churn_reason").rlike(p), F.lit(False))
    row = df.where(F.col("churn_flag") == 1).agg(
        *[pct(F.count_if(hit(p)), F.count(F.lit(1))).alias(g) for g, p in groups.items()]
    )
    return row.unpivot([], list(groups), "reason_group", "share_pct")


# --- fixed values: factor, column, group of higher risk, group of lower risk ---
RISK_FACTORS = [
    ("Month-to-month contract", "contract_type", "Month-to-month", "Two year"),
    ("Tenure under 12 months", "tenure_cohort", "0-12 mo", "61-72 mo"),
    ("Fiber optic internet", "internet_service", "Fiber optic", "No"),
    ("Electronic check payment", "payment_group", "Electronic check", "Automatic"),
    ("No dependents", "has_dependents", "No", "Yes"),
]


def risk_profile(df, factors=RISK_FACTORS):
    """Churn rate of the high and the low group of each factor, and their gap; one pass."""
    df = df.withColumn("payment_group", payment_group(F.col("payment_method")))
    rate = lambda c, v: rounded(100 * mean(F.when(F.col(c) == v, F.col("churn_flag"))), 2)
    row = df.agg(
        *[rate(c, hi).alias(f"hi{i}") for i, (_, c, hi, _) in enumerate(factors)],
        *[rate(c, lo).alias(f"lo{i}") for i, (_, c, _, lo) in enumerate(factors)],
    )
    rows = [
        F.struct(
            F.lit(name).alias("factor"),
            F.lit(hi).alias("high_risk_group"),
            F.col(f"hi{i}").alias("high_risk_rate"),
            F.lit(lo).alias("low_risk_group"),
            F.col(f"lo{i}").alias("low_risk_rate"),
            rounded(F.col(f"hi{i}") - F.col(f"lo{i}"), 2).alias("risk_gap_pct_points"),
        )
        for i, (name, _, hi, lo) in enumerate(factors)
    ]
    out = row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.orderBy(F.desc("risk_gap_pct_points"), "factor")


def five_numbers(df, cols, by="churn_flag"):
    """Minimum, quartiles and maximum of each column per group."""
    q = exact_quantiles(df, cols, [0.0, 0.25, 0.5, 0.75, 1.0], by=[by])
    names = ["minimum", "q1", "median", "q3", "maximum"]
    return q.select(
        by, "variable", "n", *[rounded(F.col("q")[i], 2).alias(x) for i, x in enumerate(names)]
    )
