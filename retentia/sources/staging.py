"""Tables staged in the shared folder, to cut lineage and to be read more than once.

A staged table is plain Parquet under the folder named by ``spark.checkpoint.dir``, so it
outlives any executor. Hadoop removes it when the driver's JVM ends.
"""

import tempfile
import time
import uuid

CHECKPOINT_DIR = "spark.checkpoint.dir"
_LOCAL_DIRS = {}


def shared_dir(spark) -> str:
    """The cluster's shared folder; a temporary one only where none is set in local mode."""
    where = spark.conf.get(CHECKPOINT_DIR, None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="retentia-")
        where = _LOCAL_DIRS[app]
    elif where.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_DIR} is a local folder, which other machines do not see")
    return where.rstrip("/")


def _file_system(spark, path):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def remove(spark, path):
    """Remove a folder if it is there."""
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def new_version() -> str:
    """A version name; later names sort after earlier ones."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def publish(spark, root, version, keep=1):
    """Make a version the current one of a folder and remove those before the last `keep`.

    The pointer is an empty file that is created at once, so readers see the old version or the
    new one, in any session.
    """
    fs, marker = _file_system(spark, f"{root}/_current/{version}")
    fs.create(marker, True).close()
    for old in _versions(spark, root)[:-keep]:
        remove(spark, f"{root}/_current/{old}")
        remove(spark, f"{root}/version={old}")


def _versions(spark, root):
    fs, folder = _file_system(spark, f"{root}/_current")
    return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []


def current(spark, root):
    """The folder of the current version, None if nothing was published."""
    versions = _versions(spark, root)
    return f"{root}/version={versions[-1]}" if versions else None


def new_path(spark, label) -> str:
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/retentia/{app}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(
        hadoop_path
    )
    return path


def stage(df, label="table", by=()):
    """Write df once, in folders by the given columns, and return a frame that reads it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_buckets(df, column, label="table"):
    """Like `stage`, in buckets of a column, so that a join on it alone does not move these rows.

    Buckets are known to the catalog only, so the table is named there while its frame is made.
    """
    spark = df.sparkSession
    name = f"retentia_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, column).option("path", new_path(spark, label)).saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the folder stays
    return rows
