"""Filters behind the search pages."""

from pyspark.sql import functions as F

from retentia.functions.columns import churn_rate, customers, mean, rfm_label, rounded
from retentia.operators.explore import city_stats
from retentia.operators.kpis import RFM_VALUES
from retentia.operators.ranks import with_tiles
from retentia.operators.substring import holding

RESULT_COLUMNS = [
    "customer_id",
    "contract_type",
    "internet_service",
    "payment_method",
    "tenure_months",
    "monthly_charges",
    "total_charges",
    "cltv",
    "churn_score",
    "churn_label",
]
PAGE_ROWS = 15


def _holds(column, term):
    """Case-insensitive literal substring."""
    return F.lower(F.col(column)).contains(term.lower())


def search_subscribers(
    df, term=None, status=None, contracts=None, internet=None, payment=None, tenure=None, charges=None,
    index=None,
):
    """Filters that are not given let everything pass. status is 'churned' or 'retained'.

    index: a `substring.Index` of customer_id; without one the term is tested on every row.
    """
    if term:
        df = holding(df, "customer_id", index, term) if index else df.where(_holds("customer_id", term))
    if status:
        df = df.where(F.col("churn_flag") == (1 if status == "churned" else 0))
    for column, allowed in (
        ("contract_type", contracts),
        ("internet_service", internet),
        ("payment_method", payment),
    ):
        if allowed is not None:
            df = df.where(F.col(column).isin(list(allowed)))
    for column, bounds in (("tenure_months", tenure), ("monthly_charges", charges)):
        if bounds is not None:
            df = df.where(F.col(column).between(*bounds))
    return df


def page(df, cols=RESULT_COLUMNS, n=PAGE_ROWS, number=1):
    """One page of results in id order, pages counted from 1."""
    rows = df.select(*cols).orderBy("customer_id")
    return rows.offset((number - 1) * n).limit(n)


def page_after(df, last_id=None, cols=RESULT_COLUMNS, n=PAGE_ROWS):
    """The page that follows a customer id (None: the first one), in id order.

    The filter reaches the scan and each task keeps n rows, so any page costs as much as the first.
    """
    rows = df if last_id is None else df.where(F.col("customer_id") > last_id)
    return rows.select(*cols).orderBy("customer_id").limit(n)


COMPARED = ["tenure_months", "monthly_charges", "cltv", "addon_service_count"]


def versus_average(df, ids):
    """The chosen customers' figures next to the average of all customers."""
    average = df.agg(F.struct(*[rounded(mean(c), 2).alias(c) for c in COMPARED]).alias("a")).scalar()
    chosen = df.where(F.col("customer_id").isin(list(ids))).select("customer_id", *COMPARED)
    rows = [
        F.struct(
            F.lit(c).alias("metric"),
            F.col(c).cast("double").alias("customer_value"),
            F.col("_a").getField(c).alias("average_value"),
        )
        for c in COMPARED
    ]
    return (
        chosen.withColumn("_a", average)
        .select("customer_id", F.explode(F.array(*rows)).alias("r"))
        .select("customer_id", "r.*")
    )


def search_cities(df, min_n=30, rate=(0.0, 100.0), term=None, index=None):
    """index: a `substring.Index` of city, so that only customers of the found cities are read."""
    if term and index:
        df, term = holding(df, "city", index, term), None
    found = city_stats(df).where(
        (F.col("customers") >= min_n) & F.col("churn_rate_pct").between(*rate)
    )
    if term:
        found = found.where(_holds("city", term))
    return found.select(
        "city", "customers", "churn_rate_pct", "total_revenue", "avg_cltv"
    ).orderBy(F.desc("total_revenue"), "city")


def filter_plans(df, contracts=None, internet=None, payment=None, addons=None):
    """addons maps a service to the wanted value; services left out may hold any."""
    df = search_subscribers(df, contracts=contracts, internet=internet, payment=payment)
    for service, value in (addons or {}).items():
        df = df.where(F.col(service) == value)
    return df


def search_plans(df, **filters):
    return filter_plans(df, **filters).agg(
        customers().alias("customers"),
        churn_rate().alias("churn_rate_pct"),
        rounded(mean("monthly_charges"), 2).alias("avg_monthly_charges"),
    )


def restrict(df, contracts, internet):
    """Global page filter; nothing selected means nothing returned."""
    return search_subscribers(df, contracts=contracts, internet=internet)


def segment_profile(df, col="segment"):
    return (
        df.groupBy(col)
        .agg(
            customers().alias("customers"),
            rounded(mean("tenure_months"), 2).alias("avg_tenure"),
            rounded(mean("cltv"), 2).alias("avg_cltv"),
            churn_rate().alias("churn_rate"),
        )
        .orderBy(F.desc("churn_rate"), col)
    )


def segment_members(df, value, col="segment"):
    return df.where(F.col(col) == value).select(
        "customer_id",
        "contract_type",
        "tenure_months",
        "monthly_charges",
        "cltv",
        "churn_score",
        "churn_label",
    )


def rank_bin(rn, n, k):
    """Equal-width bin of a row number: smallest i with rn <= 1 + (n - 1) * i / k."""
    i = F.ceil((rn - 1) * k / F.greatest(n - 1, F.lit(1)))
    return F.greatest(i, F.lit(1)).cast("int")


def rfm_by_rank(df, k=5, tie="customer_id"):
    """Quintiles of the row number, ties in id order; edges differ from NTILE by about a row."""
    df = with_tiles(df, RFM_VALUES, tie, lambda rn, n: rank_bin(rn, n, k))
    score = sum((F.col(c) for c in RFM_VALUES), F.lit(0)).cast("int")
    return df.withColumn("rfm_score", score).withColumn("segment", rfm_label(F.col("rfm_score")))
