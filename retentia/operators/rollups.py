"""Stored rollups and their refresh."""

from pyspark.sql import functions as F

from retentia.functions.columns import churn_rate, churned, customers, mean, rounded, total
from retentia.operators.star import star_view
from retentia.sources.staging import current, new_version, publish


def tenure_cohort_rollup(star):
    return star_view(star, "tenure_cohort_label", "sort_order").groupBy(
        "tenure_cohort_label", "sort_order"
    ).agg(
        customers().alias("customers"),
        churned().alias("churned"),
        churn_rate().alias("churn_rate_pct"),
        rounded(mean("monthly_charges"), 2).alias("avg_monthly_charges"),
        total("total_charges").alias("total_revenue"),
        rounded(mean("cltv"), 2).alias("avg_cltv"),
    )


def geography_rollup(star):
    """Per (city, state); coordinates are means over customers."""
    return star_view(star, "city", "state", "latitude", "longitude").groupBy("city", "state").agg(
        customers().alias("customers"),
        churned().alias("churned"),
        churn_rate().alias("churn_rate_pct"),
        total("total_charges").alias("total_revenue"),
        rounded(mean("latitude"), 6).alias("latitude"),
        rounded(mean("longitude"), 6).alias("longitude"),
    )


ROLLUPS = {
    "mv_tenure_cohort_rollup": tenure_cohort_rollup,
    "mv_geography_rollup": geography_rollup,
}


def refresh_rollups(star, root):
    """Write all rollups to a new version folder, then make that version the current one.

    Readers keep the version before until the new one is complete; older ones are removed.
    """
    spark = star.fact_subscription.sparkSession
    version = new_version()
    for name, build in ROLLUPS.items():
        build(star).write.parquet(f"{root}/version={version}/{name}")
    publish(spark, root, version, keep=2)
    return open_rollups(spark, root)


def open_rollups(spark, root):
    """The current version of the rollups, also registered as views; works in any session."""
    where = current(spark, root)
    if where is None:
        raise FileNotFoundError(f"no rollups were published in {root}")
    views = {name: spark.read.parquet(f"{where}/{name}") for name in ROLLUPS}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return views


def rollup_counts(views):
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("view"), "row_count")
        for name, df in views.items()
    ]
    return parts[0].unionByName(parts[1])
