"""Registry of the checked queries: name -> (Spark callable, reference SQL or None)."""

from pyspark.sql import functions as F, types as T

from checks.oracle import over_base
from retentia.plans.etl import warehouse

QUERIES = {}
ORACLES = {}


def plain_types(df):
    """Decimals as double and integers as bigint, so both engines return the same types."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType) or isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name, select=None, *ctes):
    """Register a function of the warehouse under a name, with its reference SQL."""

    def wrap(fn):
        def run(spark, sf_dir):
            return plain_types(fn(warehouse(spark, sf_dir)))

        QUERIES[name] = run
        if select:
            ORACLES[name] = over_base(select, *ctes)
        return fn

    return wrap
