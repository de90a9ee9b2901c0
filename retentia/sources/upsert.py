"""A stored table whose rows are updated by key, copy-on-write by file.

A version is a manifest: the list of the Parquet files that make up the table. An update rewrites
only the files that hold a changed key; the new manifest names these and, by reference, all others.
Readers take the current manifest, so they see a version as a whole, from any session.

    root/data/load=<version>/<partition columns>/part-*.parquet
    root/manifests/version=<version>/part-*.parquet
"""

from pyspark.sql import functions as F

from retentia.sources.staging import current, new_version, publish, remove

MANIFEST = "file string, load string"


class UnknownKeys(ValueError):
    pass


class RepeatedKeys(ValueError):
    pass


def _files(spark, root):
    """Files of the current version with the load that wrote each; a file name per row."""
    where = current(spark, f"{root}/manifests")
    if where is None:
        raise FileNotFoundError(f"nothing is stored in {root}")
    return spark.read.schema(MANIFEST).parquet(where)


def _open(spark, root, names):
    """The rows of some files, with the file of each row as `_file`."""
    table = spark.read.option("basePath", f"{root}/data").parquet(*names)
    return table.withColumn("_file", F.col("_metadata.file_path")).drop("load")


def _write_data(df, root, version, by):
    folder = f"{root}/data/load={version}"
    df.write.partitionBy(*by).parquet(folder)
    written = df.sparkSession.read.parquet(folder).select("_metadata.file_path")
    return [r.file_path for r in written.distinct().collect()]  # no column is read for this


def _publish(spark, root, version, rows):
    folder = f"{root}/manifests/version={version}"
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(folder)
    publish(spark, f"{root}/manifests", version, keep=2)


def create(df, root, by=()):
    """Store a table as the current version of a folder, in folders by the given columns."""
    spark, version = df.sparkSession, new_version()
    names = _write_data(df, root, version, by)
    _publish(spark, root, version, [(name, version) for name in names])


def read(spark, root):
    """The current version."""
    names = [r.file for r in _files(spark, root).collect()]
    return _open(spark, root, names).drop("_file")


def upsert(spark, root, updates, key, by=()):
    """Set the further columns of `updates` in the rows of its keys; one new version.

    Keys are unique in both tables and all of `updates` have to be stored; otherwise nothing is
    changed. Returns the numbers of rewritten and of kept files.

    The first pass reads the key column alone and finds the files that hold a changed key; the
    second reads and writes these files. File names go through the driver, as for any scan.
    """
    held = {r.file: r.load for r in _files(spark, root).collect()}
    table = _open(spark, root, list(held))
    changed = [c for c in updates.columns if c != key]
    found = table.select(key, "_file").join(updates.select(key), key)
    per = found.groupBy("_file").agg(F.count(F.lit(1)).alias("rows")).collect()
    counts = updates.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys")).first()
    if counts.rows != counts["keys"]:
        raise RepeatedKeys(f"{counts.rows - counts['keys']} keys are repeated or null")
    stored = sum(r.rows for r in per)
    if stored != counts.rows:
        raise UnknownKeys(f"{counts.rows - stored} of {counts.rows} keys are not stored")
    touched = {r["_file"] for r in per}
    if not touched:
        return 0, len(held)
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in changed], F.lit(True).alias("_hit"))
    rows = _open(spark, root, sorted(touched)).drop("_file").join(new, key, "left")
    types = dict(table.dtypes)
    rows = rows.select(*[
        F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).cast(types[c]).alias(c)
        if c in changed else F.col(c)
        for c in table.columns if c != "_file"
    ])
    version = new_version()
    names = _write_data(rows, root, version, by)
    rest = [(name, load) for name, load in held.items() if name not in touched]
    _publish(spark, root, version, rest + [(name, version) for name in names])
    return len(touched), len(rest)


def vacuum(spark, root):
    """Remove loads that no file of the current version comes from; for times without readers."""
    used = {r.load for r in _files(spark, root).select("load").distinct().collect()}
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/data")
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = 0
    for status in fs.listStatus(fs_path):
        name = status.getPath().getName()
        if name.startswith("load=") and name.removeprefix("load=") not in used:
            remove(spark, f"{root}/data/{name}")
            gone += 1
    return gone
