"""Readers and writers of the stored tables."""

from functools import reduce

from pyspark.sql import functions as F

from retentia.functions.columns import churn_rate, churned, customers
from retentia.operators.features import cohort_order
from retentia.operators.star import Star
from retentia.schema import CROSS_SCHEMA, RAW_SCHEMA

STAR_TABLES = list(Star.__dataclass_fields__)


def load_primary(spark, path, fmt="parquet"):
    """Raw subscriber table with its declared schema (Parquet, or CSV with a header)."""
    reader = spark.read.schema(RAW_SCHEMA)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)


def load_cross_reference(spark, path):
    """The compared columns of the CSV, found by header name and cast to their declared types."""
    text = spark.read.option("header", True).csv(path)
    return text.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in CROSS_SCHEMA])


def load_wide(spark, path):
    """Processed wide table, with the order of the tenure cohorts restored."""
    wide = spark.read.parquet(path)
    return wide.withColumn("sort_order", cohort_order(F.col("tenure_cohort")))


def load_predictions(spark, path):
    return spark.read.parquet(path)


def write_table(df, path):
    df.write.mode("overwrite").parquet(path)


def write_fact(fact, path):
    """Partitioned by churn flag, in files of score ranges, so that filters on them skip files."""
    (
        fact.repartitionByRange("churn_flag", "churn_score", "customer_key")
        .sortWithinPartitions("churn_flag", "churn_score")
        .write.mode("overwrite")
        .partitionBy("churn_flag")
        .parquet(path)
    )


def write_star(star, root):
    for name, df in star.tables().items():
        (write_fact if name == "fact_subscription" else write_table)(df, f"{root}/{name}")


def load_star(spark, root):
    frames = {name: spark.read.parquet(f"{root}/{name}") for name in STAR_TABLES}
    fact = frames["fact_subscription"]
    frames["fact_subscription"] = fact.withColumn("churn_flag", F.col("churn_flag").cast("int"))
    return Star(**frames)


def register_star(star):
    """The seven tables as views under their names, for spark.sql."""
    for name, df in star.tables().items():
        df.createOrReplaceTempView(name)


def write_star_jdbc(star, url, batch_rows=500, **options):
    """Re-runnable load to a relational store: dimensions first, rows replaced, tables kept."""
    for name, df in star.tables().items():
        writer = df.write.format("jdbc").option("url", url).option("dbtable", name)
        writer = writer.option("truncate", True).option("batchsize", batch_rows)
        for key, value in options.items():
            writer = writer.option(key, value)
        writer.mode("overwrite").save()


def export_csv(df, path):
    df.write.mode("overwrite").option("header", True).csv(path)


def export_star_csv(star, root):
    for name, df in star.tables().items():
        export_csv(df, f"{root}/{name}")


def export_report(sections, root):
    """One JSON file set per report section."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{root}/{name}")


def table_counts(tables):
    """Row count per table, as one UNION ALL."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def load_check(fact):
    """What the stored fact says after a load: rows, churn and revenue at risk."""
    lost = F.when(F.col("churn_flag") == 1, F.col("monthly_charges"))
    return fact.agg(
        customers().alias("total_customers"),
        churned().alias("churned_customers"),
        churn_rate().alias("churn_rate_pct"),
        F.coalesce(F.sum(lost), F.lit(0)).cast("double").alias("monthly_revenue_at_risk"),
    )
