"""Dimensions, fact and key checks of the star schema."""

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, Window as W, functions as F

from retentia.operators.features import cohort_order
from retentia.operators.ranks import global_order
from retentia.schema import ADDONS, SERVICE_PLAN_COLUMNS

FACT_KEYS = [
    "customer_key",
    "geography_key",
    "plan_key",
    "payment_method_key",
    "tenure_cohort_key",
    "churn_reason_key",
]
FACT_MEASURES = [
    "tenure_months",
    "monthly_charges",
    "total_charges",
    "is_new_customer_imputed_charges",
    "churn_flag",
    "churn_score",
    "cltv",
    "addon_service_count",
    "avg_revenue_per_tenure_month",
    "recency_tenure_months",
    "frequency_addon_breadth",
    "monetary_total_charges",
]


@dataclass
class Star:
    dim_customer: DataFrame
    dim_geography: DataFrame
    dim_plan: DataFrame
    dim_payment_method: DataFrame
    dim_tenure_cohort: DataFrame
    dim_churn_reason: DataFrame
    fact_subscription: DataFrame

    def tables(self):
        return {f.name: getattr(self, f.name) for f in fields(self)}


def first_per_key(df, key, rest):
    """One row per key with the smallest combination of the other columns.

    Equal rows are hashed together first, as a minimum of structs sorts what it reads. The planner
    merges a plain distinct into the minimum; the filter on the count keeps it from that.
    """
    few = df.groupBy(*key, *rest).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0")
    return few.groupBy(*key).agg(F.min(F.struct(*rest)).alias("r")).select(*key, "r.*")


def number_rows(df, key, name):
    """Dense key 1..n in the order of the natural key, for dimensions of any size."""
    ordered = global_order(df, key, label=name)
    return ordered.select(F.col("rn").alias(name), *df.columns)


def build_dim_customer(wide):
    rest = ["gender", "senior_citizen", "has_partner", "has_dependents"]
    src = wide.select(
        "customer_id",
        "gender",
        *[F.col(f"{c}_bool").alias(c) for c in rest[1:]],
    )
    # the load starts with the check that ids are unique
    return number_rows(src, ["customer_id"], "customer_key")


def build_dim_geography(wide):
    rest = ["country", "state", "latitude", "longitude"]
    dim = first_per_key(wide, ["city", "zip_code"], rest)
    dim = dim.select("country", "state", "city", "zip_code", "latitude", "longitude")
    return number_rows(dim, ["city", "zip_code"], "geography_key")


def plan_columns(wide):
    return wide.withColumns(
        {
            "phone_service": F.col("phone_service_bool"),
            "paperless_billing": F.col("paperless_billing_bool"),
        }
    )


def build_dim_plan(wide):
    dim = plan_columns(wide).select(*SERVICE_PLAN_COLUMNS, "contract_based_risk_tier")
    dim = first_per_key(dim, SERVICE_PLAN_COLUMNS, ["contract_based_risk_tier"])
    return number_rows(dim, SERVICE_PLAN_COLUMNS, "plan_key")


def build_dim_payment_method(wide):
    dim = wide.select("payment_method").distinct()
    return number_rows(dim, ["payment_method"], "payment_method_key")


def build_dim_tenure_cohort(wide):
    label = F.col("tenure_cohort").alias("tenure_cohort_label")
    dim = (
        wide.select(label)
        .where(F.col("tenure_cohort").isNotNull())
        .distinct()
        .withColumn("sort_order", cohort_order(F.col("tenure_cohort_label")))
    )
    # at most one row per defined cohort
    key = F.row_number().over(W.orderBy("sort_order")).cast("bigint")
    return dim.select(key.alias("tenure_cohort_key"), "*")


def build_dim_churn_reason(wide):
    dim = wide.select("churn_reason").distinct()
    return number_rows(dim, ["churn_reason"], "churn_reason_key")


DIMENSIONS = {
    "dim_customer": build_dim_customer,
    "dim_geography": build_dim_geography,
    "dim_plan": build_dim_plan,
    "dim_payment_method": build_dim_payment_method,
    "dim_tenure_cohort": build_dim_tenure_cohort,
    "dim_churn_reason": build_dim_churn_reason,
}


def build_fact_subscription(wide, dims):
    """Six left joins. No broadcast hints: the planner sees the real size of each dimension.

    The grain is one row per customer, so the dense customer key also numbers the facts.
    """
    cohort = dims["dim_tenure_cohort"].select(
        "tenure_cohort_key", F.col("tenure_cohort_label").alias("tenure_cohort")
    )
    return (
        plan_columns(wide)
        .join(dims["dim_customer"].select("customer_key", "customer_id"), "customer_id", "left")
        .join(
            dims["dim_geography"].select("geography_key", "city", "zip_code"),
            ["city", "zip_code"],
            "left",
        )
        .join(
            dims["dim_plan"].select("plan_key", *SERVICE_PLAN_COLUMNS),
            SERVICE_PLAN_COLUMNS,
            "left",
        )
        .join(dims["dim_payment_method"], "payment_method", "left")
        .join(cohort, "tenure_cohort", "left")
        .join(dims["dim_churn_reason"], "churn_reason", "left")
        .select(
            F.col("customer_key").alias("subscription_fact_key"), *FACT_KEYS, *FACT_MEASURES
        )
    )


def foreign_key_report(fact):
    """Null count per foreign key, one row each."""
    counts = fact.agg(*[F.count_if(F.col(k).isNull()).alias(k) for k in FACT_KEYS])
    return counts.unpivot([], FACT_KEYS, "foreign_key", "null_count").withColumn(
        "resolved", F.col("null_count") == 0
    )


def orphan_report(star):
    """Fact rows whose key is missing from its dimension, counted per foreign key."""
    parts = []
    for dim, key in zip(list(star.tables())[:6], FACT_KEYS):
        missing = star.fact_subscription.join(getattr(star, dim), key, "left_anti")
        parts.append(
            missing.agg(F.count(F.lit(1)).alias("orphans")).select(
                F.lit(key).alias("foreign_key"), "orphans"
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class UnresolvedKeys(ValueError):
    pass


def require_resolved_keys(fact, wide=None, show=20):
    """Abort the load when a foreign key is null; the message names some offending ids."""
    bad = {r.foreign_key: r.null_count for r in foreign_key_report(fact).collect() if not r.resolved}
    if not bad:
        return
    ids = []
    if wide is not None and "tenure_cohort_key" in bad:
        rows = wide.where(F.col("tenure_cohort").isNull()).select("customer_id")
        ids = [r.customer_id for r in rows.orderBy("customer_id").limit(show).collect()]
    raise UnresolvedKeys(
        f"unresolved foreign keys, with their rows: {bad}; first rows without a cohort: {ids}"
    )


# which dimension owns a column, for star_view
_OWNERS = {
    "customer_id": "dim_customer",
    "gender": "dim_customer",
    "senior_citizen": "dim_customer",
    "has_partner": "dim_customer",
    "has_dependents": "dim_customer",
    **{c: "dim_geography" for c in ("country", "state", "city", "zip_code", "latitude", "longitude")},
    **{c: "dim_plan" for c in (*SERVICE_PLAN_COLUMNS, *ADDONS, "contract_based_risk_tier")},
    "payment_method": "dim_payment_method",
    "tenure_cohort_label": "dim_tenure_cohort",
    "sort_order": "dim_tenure_cohort",
    "churn_reason": "dim_churn_reason",
}
_DIM_KEYS = {
    "dim_customer": "customer_key",
    "dim_geography": "geography_key",
    "dim_plan": "plan_key",
    "dim_payment_method": "payment_method_key",
    "dim_tenure_cohort": "tenure_cohort_key",
    "dim_churn_reason": "churn_reason_key",
}


def star_view(star, *columns):
    """The fact joined to just the dimensions that own the asked columns."""
    wanted = {}
    for c in columns:
        wanted.setdefault(_OWNERS[c], []).append(c)
    out = star.fact_subscription
    for dim, cols in wanted.items():
        key = _DIM_KEYS[dim]
        out = out.join(getattr(star, dim).select(key, *dict.fromkeys(cols)), key)
    return out
