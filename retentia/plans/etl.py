"""From the raw table to the stored star schema."""

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from retentia.operators.clean import run_cleaning
from retentia.operators.features import run_features
from retentia.operators.quality import (
    compare_fields,
    require_constraints,
    require_unique_ids,
    run_validation,
)
from retentia.operators.star import (
    DIMENSIONS,
    Star,
    build_fact_subscription,
    require_resolved_keys,
)
from retentia.session import in_parallel
from retentia.sources.fixtures import cross_reference, raw_subscribers
from retentia.sources.staging import current, new_path, new_version, publish, remove
from retentia.sources.tables import (
    load_primary,
    load_star,
    load_wide,
    table_counts,
    write_fact,
    write_table,
)


KEY_REPORT = (
    "primary_row_count long, cross_ref_row_count long, primary_unique_ids long, "
    "cross_ref_unique_ids long, ids_only_in_primary long, ids_only_in_cross_ref long, "
    "ids_match_exactly boolean"
)


@dataclass
class Warehouse:
    """The stored tables of one load."""

    root: str
    raw: DataFrame
    cross: DataFrame
    wide: DataFrame
    star: Star
    raw_path: str = None


def build_star(spark, wide, root):
    """Dimensions are written side by side and read back before the fact is joined to them."""

    def write(name):
        def run():
            write_table(DIMENSIONS[name](wide), f"{root}/{name}")
            return spark.read.parquet(f"{root}/{name}")

        return run

    dims = dict(zip(DIMENSIONS, in_parallel([write(name) for name in DIMENSIONS])))
    write_fact(build_fact_subscription(wide, dims), f"{root}/fact_subscription")
    star = load_star(spark, root)
    require_resolved_keys(star.fact_subscription, wide)
    require_constraints(star)
    return star


def ingest_report(raw, cross):
    """Key and field comparison of the two sources, in one row; ids must be unique."""
    checked = require_unique_ids(raw, cross)  # the row that the comparison of keys gave
    keys = raw.sparkSession.createDataFrame([checked], KEY_REPORT).withColumn("one", F.lit(1))
    agreed = compare_fields(raw, cross).withColumn("one", F.lit(1))
    return keys.join(agreed, "one").drop("one")


def run_etl(spark, raw, cross, root):
    """Check ids, clean, derive, write the wide table once, then the star from it.

    Everything goes to a new version folder. Only when the key and constraint gates have passed
    does it become the current load; if one raises, the folder is removed and the load before
    stays as it was.
    """
    require_unique_ids(raw, cross)
    version = new_version()
    folder = f"{root}/version={version}"
    try:
        write_table(run_features(run_cleaning(raw)), f"{folder}/wide")
        wide = load_wide(spark, f"{folder}/wide")
        star = build_star(spark, wide, folder)
    except Exception:
        remove(spark, folder)
        raise
    publish(spark, root, version, keep=2)
    return Warehouse(folder, raw, cross, wide, star)


def open_warehouse(spark, root, raw=None, cross=None):
    """The current load of a folder, from any session."""
    folder = current(spark, root)
    if folder is None:
        raise FileNotFoundError(f"no load was published in {root}")
    return Warehouse(folder, raw, cross, load_wide(spark, f"{folder}/wide"), load_star(spark, folder))


def etl_summary(warehouse):
    """Row count per written table."""
    return table_counts({"wide": warehouse.wide, **warehouse.star.tables()})


def etl_report(warehouse):
    """Validation findings of the raw table next to the row counts of the load."""
    counts = etl_summary(warehouse).select(
        F.lit("row_count").alias("check"),
        F.col("table_name").alias("subject"),
        F.col("row_count").cast("double").alias("value"),
    )
    return run_validation(warehouse.raw).unionByName(counts)


def load_from_orders(spark, sf_dir, root):
    """Land the raw subscribers derived from the order tables, then run the ETL on them."""
    write_table(raw_subscribers(spark, sf_dir), f"{root}/raw")
    raw = load_primary(spark, f"{root}/raw")
    loaded = run_etl(spark, raw, cross_reference(raw), root)
    return replace(loaded, raw_path=f"{root}/raw")


_OPEN = {}


def warehouse(spark, sf_dir):
    """The load of one input folder, made once per application in the shared folder."""
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _OPEN:
        _OPEN[key] = load_from_orders(spark, sf_dir, new_path(spark, "warehouse"))
    return _OPEN[key]
