"""The raw subscriber table, derived from order-entry tables for checks and benchmarks.

Every customer with at least one order becomes a subscriber: order history gives tenure,
charges and churn, line items give the add-ons, and the customer key gives the demographics.
"""

from decimal import Decimal

from pyspark.sql import functions as F

from retentia.functions.columns import one_of, rounded
from retentia.schema import (
    ADDONS,
    CHURN_REASONS,
    EXPECTED_COLUMNS,
    MONEY,
    NO_INTERNET,
    RAW_SCHEMA,
)

SEGMENT_CONTRACT = {
    "AUTOMOBILE": "Month-to-month",
    "BUILDING": "Month-to-month",
    "FURNITURE": "One year",
    "HOUSEHOLD": "One year",
    "MACHINERY": "Two year",
}
PRIORITY_PAYMENT = {
    1: "Electronic check",
    2: "Mailed check",
    3: "Bank transfer (automatic)",
    4: "Credit card (automatic)",
    5: "Electronic check",
}
ADDON_MIN_ITEMS = 7


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_history(spark, sf_dir):
    """One row per ordering customer.

    Line items meet only the customer of their order, and amounts, days and codes never meet line
    items, so the join by order moves two narrow columns a side. Both aggregates by customer
    combine on the map side, so a customer with a large share of the orders is no hot group.
    """
    orders = table(spark, sf_dir, "orders").where(F.col("o_custkey").isNotNull())
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_partkey") % 6).cast("tinyint").alias("i")
    )
    items = (
        lines.join(
            orders.select("o_orderkey", F.col("o_custkey").alias("i_custkey")),
            F.col("l_orderkey") == F.col("o_orderkey"),
        )
        .groupBy("i_custkey")
        .agg(*[F.count_if(F.col("i") == i).alias(f"n{i}") for i in range(6)])
    )
    history = (
        orders.select(
            "o_custkey",
            F.col("o_orderdate").cast("date").alias("day"),
            F.col("o_totalprice").cast(MONEY).alias("price"),
            latest_code().alias("code"),
        )
        .groupBy("o_custkey")
        .agg(
            F.min("day").alias("first_day"),
            F.max("day").alias("last_day"),
            F.sum("price").alias("spend"),
            F.max("code").alias("code"),
        )
    )
    return (
        history.join(items, F.col("o_custkey") == F.col("i_custkey"), "left")
        .drop("i_custkey")
        .withColumns({f"n{i}": F.coalesce(f"n{i}", F.lit(0)) for i in range(6)})
        .withColumn("latest", (F.col("code") % 100).cast("int"))
    )


def latest_code():
    """Day, order key, priority digit and status digit as one number.

    Its maximum per customer carries priority and status of the latest order (ties on a day go
    to the larger key), and a plain maximum keeps the aggregate hash-based, without a sort.
    """
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    status = one_of(F.col("o_orderstatus"), {"F": 0, "O": 1}, 2)
    digits = F.substring("o_orderpriority", 1, 1).cast("int") * 10 + status
    ranked = day.cast("decimal(6,0)") * F.lit(Decimal(10**19)) + F.col(
        "o_orderkey"
    ).cast("decimal(19,0)")
    return (ranked * F.lit(Decimal(100)) + digits.cast("decimal(2,0)")).cast(
        "decimal(38,0)"
    )


def raw_subscribers(spark, sf_dir):
    """The 33 raw columns, one row per customer.

    A customer without orders is new: tenure 0, no amount, not churned.
    """
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    horizon = (
        table(spark, sf_dir, "orders")
        .agg(F.max(F.col("o_orderdate").cast("date")).alias("hz"))
        .scalar()
    )
    base = (
        customer.join(
            customer_history(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey"), "left"
        )
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumns(
            {
                "k": F.col("c_custkey"),
                "gap": F.coalesce(F.datediff(horizon, "last_day"), F.lit(0)),
                "tenure": F.coalesce(
                    F.least(F.lit(72), (F.datediff("last_day", "first_day") / 30).cast("int")),
                    F.lit(0),
                ),
                "prio": F.coalesce(F.floor(F.col("latest") / 10).cast("int"), F.lit(1)),
                "spend": F.coalesce("spend", F.lit(0).cast(MONEY)),
            }
        )
        .withColumn("churned", F.col("gap") > 240)
    )
    yes = lambda cond: F.when(cond, F.lit("Yes")).otherwise(F.lit("No"))
    k = F.col("k")
    internet = one_of(F.col("c_nationkey") % 3, {0: "DSL", 1: "Fiber optic"}, "No")
    phone = yes(k % 10 != 0)
    lat = (F.lit(30) + F.col("c_nationkey") * 0.25 + (k % 4) * 0.01).cast("decimal(9,6)")
    lon = (F.lit(-100) - F.col("c_nationkey") * 0.5).cast("decimal(9,6)")
    reason_no = (F.col("prio") - 1) * 4 + F.col("latest") % 10 + (k % 2).cast("int")
    monthly = F.col("spend").cast("double") / F.greatest("tenure", F.lit(1)) / 100
    addon = lambda i: (
        F.when(internet == "No", F.lit(NO_INTERNET)).otherwise(
            yes(F.col(f"n{i}") >= ADDON_MIN_ITEMS)
        )
    )
    values = {
        "CustomerID": F.col("c_name"),
        "Count": F.lit(1),
        "Country": F.lit("United States"),
        "State": F.col("r_name"),
        "City": F.col("n_name"),
        "Zip Code": (F.lit(10000) + F.col("c_nationkey") * 100 + k % 4).cast("string"),
        "Lat Long": F.concat_ws(", ", lat.cast("string"), lon.cast("string")),
        "Latitude": lat,
        "Longitude": lon,
        "Gender": F.when(k % 2 == 0, F.lit("Male")).otherwise(F.lit("Female")),
        "Senior Citizen": yes(k % 6 == 0),
        "Partner": yes(k % 4 < 2),
        "Dependents": yes(k % 3 == 0),
        "Tenure Months": F.col("tenure"),
        "Phone Service": phone,
        "Multiple Lines": F.when(phone == "No", F.lit("No phone service")).otherwise(
            yes(k % 7 < 3)
        ),
        "Internet Service": internet,
        "Online Security": addon(0),
        "Online Backup": addon(1),
        "Device Protection": addon(2),
        "Tech Support": addon(3),
        "Streaming TV": addon(4),
        "Streaming Movies": addon(5),
        "Contract": one_of(F.col("c_mktsegment"), SEGMENT_CONTRACT),
        "Paperless Billing": yes(k % 5 < 3),
        "Payment Method": one_of(F.col("prio"), PRIORITY_PAYMENT),
        "Monthly Charges": rounded(monthly, 2).cast(MONEY),
        "Total Charges": F.when(F.col("tenure") == 0, F.lit(" ")).otherwise(
            F.col("spend").cast("string")
        ),
        "Churn Label": yes(F.col("churned")),
        "Churn Value": F.col("churned").cast("int"),
        "Churn Score": F.greatest(
            F.lit(0),
            F.least(
                F.lit(100),
                (F.col("gap") / 4).cast("int") + ((k * 37) % 41).cast("int") - 20,
            ),
        ),
        "CLTV": F.lit(2000) + F.floor(F.abs("c_acctbal")),
        "Churn Reason": F.when(
            F.col("churned"), F.element_at(F.array(*map(F.lit, CHURN_REASONS)), reason_no + 1)
        ),
    }
    return base.select(*[values[c].cast(RAW_SCHEMA[c].dataType).alias(c) for c in EXPECTED_COLUMNS])


def cross_reference(raw):
    """Second source for the cross checks: some ids, charges and labels disagree."""
    number = F.substring(F.col("CustomerID"), -9, 9).cast("bigint")
    charge = F.col("Monthly Charges").cast("double")
    return raw.select(
        F.when(number % 101 == 0, F.concat("CustomerID", F.lit("-X")))
        .otherwise(F.col("CustomerID"))
        .alias("customerID"),
        F.when(number % 53 == 0, charge + 0.5).otherwise(charge).alias("MonthlyCharges"),
        F.when(number % 71 == 0, F.lit("No")).otherwise(F.col("Churn Label")).alias("Churn"),
    )
