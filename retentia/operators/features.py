"""Derived columns of the wide subscriber table. All are row-level expressions."""

from functools import reduce

from pyspark.sql import functions as F

from retentia.functions.columns import one_of, rounded
from retentia.schema import ADDONS, COHORTS, MONEY, NO_INTERNET, RISK_TIERS


def tenure_cohort(months):
    """Right-closed bins; a tenure below 0 or above the last bound has no cohort."""
    out = F.when(months < 0, F.lit(None).cast("string"))
    for label, (upper, _) in COHORTS.items():
        out = out.when(months <= upper, F.lit(label))
    return out


def cohort_order(label):
    return one_of(label, {name: order for name, (_, order) in COHORTS.items()})


def add_tenure_cohort(df):
    return df.withColumn("tenure_cohort", tenure_cohort(F.col("tenure_months")))


def add_addon_count(df):
    took = [F.coalesce((F.col(c) == "Yes").cast("int"), F.lit(0)) for c in ADDONS]
    return df.withColumn("addon_service_count", reduce(lambda a, b: a + b, took))


def add_service_flags(df):
    online = F.col("internet_service") != "No"
    return df.withColumns(
        {
            "has_internet": online,
            "has_phone_and_internet": F.col("phone_service_bool") & online,
            "is_streaming_bundle": (F.col("streaming_tv") == "Yes")
            & (F.col("streaming_movies") == "Yes"),
        }
    )


def add_rfm_proxies(df):
    return df.withColumns(
        {
            "monetary_total_charges": F.col("total_charges"),
            "monetary_monthly_run_rate": F.col("monthly_charges"),
            "frequency_addon_breadth": F.col("addon_service_count"),
            "recency_tenure_months": F.col("tenure_months"),
        }
    )


def add_revenue_per_tenure_month(df):
    per_month = F.col("total_charges").cast("double") / F.nullif(
        F.col("tenure_months").cast("double"), F.lit(0.0)
    )
    value = F.when(F.col("tenure_months") > 0, rounded(per_month, 2)).otherwise(
        F.col("monthly_charges").cast("double")
    )
    return df.withColumn("avg_revenue_per_tenure_month", value.cast(MONEY))


def add_contract_risk_tier(df):
    return df.withColumn("contract_based_risk_tier", one_of(F.col("contract_type"), RISK_TIERS))


def add_scope_flag(df):
    """True on every row when the whole table lies in one state; computed, not assumed."""
    one = F.coalesce(F.min("state") == F.max("state"), F.lit(False))
    states = df.agg(one.alias("single")).scalar()
    return df.withColumn("is_single_state_dataset", states)


def run_features(clean):
    return (
        clean.transform(add_tenure_cohort)
        .transform(add_addon_count)
        .transform(add_service_flags)
        .transform(add_rfm_proxies)
        .transform(add_revenue_per_tenure_month)
        .transform(add_contract_risk_tier)
        .transform(add_scope_flag)
    )


def eligible_for(df, service):
    """Rows that could hold the add-on, i.e. that have internet service."""
    return df.where(F.col(service) != NO_INTERNET)


def add_contract_dummies(df):
    return df.withColumns(
        {
            "contract_two_year": (F.col("contract_type") == "Two year").cast("int"),
            "contract_one_year": (F.col("contract_type") == "One year").cast("int"),
        }
    )
