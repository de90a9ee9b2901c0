"""What-if tables: move a share of one group to the behaviour of another."""

from functools import reduce

from pyspark.sql import functions as F

from retentia.functions.columns import mean, rounded, rounded_even


def migrate(df, source, target, percents, gain="protected"):
    """One row per percentage, from a single aggregate over the table.

    source, target: conditions of the two groups.
    gain: 'protected' values avoided churn at the source's mean charge; 'extra' values each moved
    customer at the difference of the mean charges.
    """
    when = lambda cond, c: mean(F.when(cond, F.col(c)))
    row = df.agg(
        F.count_if(source).alias("n"),
        when(source, "churn_flag").alias("rate_from"),
        when(target, "churn_flag").alias("rate_to"),
        when(source, "monthly_charges").alias("charge_from"),
        when(target, "monthly_charges").alias("charge_to"),
    )
    moved = lambda p: F.floor(F.col("n") * p / 100).cast("bigint")
    avoided = lambda p: moved(p) * (F.col("rate_from") - F.col("rate_to"))
    value = {
        "protected": lambda p: avoided(p) * F.col("charge_from"),
        "extra": lambda p: moved(p) * (F.col("charge_to") - F.col("charge_from")),
    }[gain]
    rows = [
        F.struct(
            F.lit(p).cast("bigint").alias("rate_pct"),
            F.col("n").alias("group_customers"),
            rounded(100 * F.col("rate_from"), 2).alias("from_churn_rate_pct"),
            rounded(100 * F.col("rate_to"), 2).alias("to_churn_rate_pct"),
            moved(p).alias("customers_moved"),
            rounded_even(avoided(p), 0).alias("est_fewer_churns_per_year"),
            rounded_even(value(p), 2).alias("est_mrr"),
        )
        for p in percents
    ]
    return row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def contract_migration(df, percents=(10, 20, 30)):
    contract = F.col("contract_type")
    return migrate(df, contract == "Month-to-month", contract == "One year", percents)


def payment_migration(df, percents=(20, 30, 50)):
    method = F.col("payment_method")
    automatic = method.isin("Bank transfer (automatic)", "Credit card (automatic)")
    return migrate(df, method == "Electronic check", automatic, percents)


def addon_upgrade(df, percents=(10, 20, 30)):
    count = F.col("addon_service_count")
    return migrate(df, count.isin(1, 2), count >= 3, percents, gain="extra")


def all_scenarios(df):
    parts = {
        "contract_migration": contract_migration(df),
        "payment_method_migration": payment_migration(df),
        "addon_bundle_upgrade": addon_upgrade(df),
    }
    named = [
        part.select(F.lit(name).alias("scenario"), "*") for name, part in parts.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), named)
