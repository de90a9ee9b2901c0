"""Session settings the jobs are written for."""

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def build(app_name="retentia", **extra):
    """A session with the settings above; master and sizes come from the submit command."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def build_local(cores="*", shuffle_partitions=8, memory="8g", **extra):
    return build(
        **{
            "spark.master": f"local[{cores}]",
            "spark.sql.shuffle.partitions": str(shuffle_partitions),
            "spark.driver.memory": memory,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            **extra,
        }
    )


def in_parallel(tasks, width=None):
    """Run independent Spark jobs from driver threads, results in order.

    Without a width, as many at once as the cluster has slots, from 4 to 32. Each task has its own
    copy of the local properties: in a shared one, the id of the running query that one thread sets
    is cleared by another.
    """
    session = SparkSession.active()
    width = width or max(4, min(32, session.sparkContext.defaultParallelism))
    wrapped = [inheritable_thread_target(session)(task) for task in tasks]
    with ThreadPool(min(width, len(tasks))) as pool:
        return pool.map(lambda task: task(), wrapped, chunksize=1)
