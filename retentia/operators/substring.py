"""Substring search by a stored trigram index instead of a scan.

The index of a column holds a posting (trigram, value) for every trigram of every distinct value,
lower-cased; two marks behind a value let a trigram begin at each of its characters. Postings are
range-partitioned and sorted by both columns, so a trigram that nearly all values share is spread
over many files, and a look-up reads only the row groups of its trigram. Beside them lies the
number of values by trigram. A search reads the counts of the term's trigrams, walks the postings
of the rarest one and tests their values exactly; a term of one or two characters is the beginning
of trigrams, which is a range of the postings.

An index is a version in a folder: a new one becomes current as a whole, in any session. Null
values are not found by any term. Empty terms are refused, as they hold everywhere.

    root/version=<version>/postings/part-*.parquet
    root/version=<version>/counts/part-*.parquet
"""

from pyspark.sql import functions as F

from retentia.sources.staging import current, new_version, publish

WIDTH = 3
_MARKS = "\0" * (WIDTH - 1)
#: Found values that become a filter of the scan; more of them are a join.
MOST_LISTED = 1000


def trigrams(text):
    """Distinct trigrams of a text column; an empty text has none."""
    low = F.lower(text)
    padded = F.concat(low, F.lit(_MARKS))
    every = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))),
        lambda i: F.substring(padded, i, F.lit(WIDTH)))
    return F.array_distinct(F.filter(every, lambda g: ~g.startswith("\0")))


def build(df, column, root):
    """Index a column of df in a folder; becomes the folder's current version when it is whole."""
    spark = df.sparkSession
    version = new_version()
    where = f"{root}/version={version}"
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    postings = values.select(F.explode(trigrams(F.col("value"))).alias("gram"), "value")
    postings.repartitionByRange("gram", "value").sortWithinPartitions("gram", "value").write.parquet(
        f"{where}/postings")
    counts = spark.read.parquet(f"{where}/postings").groupBy("gram").agg(F.count("*").alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{where}/counts")
    publish(spark, root, version)


class Index:
    """The current version of an index."""

    def __init__(self, spark, root):
        where = current(spark, root)
        if where is None:
            raise FileNotFoundError(f"no index is stored in {root}")
        self.postings = spark.read.parquet(f"{where}/postings")
        self.counts = spark.read.parquet(f"{where}/counts")

    def rarest(self, term):
        """The term's trigram with the fewest values; None if one of them does not occur."""
        wanted = {term[k : k + WIDTH] for k in range(len(term) - WIDTH + 1)}
        # one row per trigram of the term at most
        rows = self.counts.where(F.col("gram").isin(sorted(wanted))).collect()
        return min(rows, key=lambda r: (r.n, r.gram)).gram if len(rows) == len(wanted) else None

    def candidates(self, term):
        """Postings that the exact test has to read."""
        if len(term) < WIDTH:
            return self.postings.where(F.col("gram").startswith(term))
        rarest = self.rarest(term)
        return self.postings.where(F.lit(False) if rarest is None else F.col("gram") == rarest)

    def matches(self, term):
        """The values that hold a term, whatever their case, each once."""
        term = term.lower()
        if not term:
            raise ValueError("an empty term holds everywhere")
        found = self.candidates(term).where(F.lower("value").contains(term)).select("value")
        # a value has a trigram once, but may have several with one beginning
        return found.distinct() if len(term) < WIDTH else found


def holding(df, column, index, term):
    """The rows of df whose column holds a term, by the index of that column.

    A few found values become a filter that reaches the scan of df, more of them a semi-join.
    """
    found = index.matches(term)
    few = [r.value for r in found.limit(MOST_LISTED + 1).collect()]
    if len(few) <= MOST_LISTED:
        return df.where(F.col(column).isin(few))
    return df.join(found.withColumnRenamed("value", column), column, "left_semi").select(df.columns)
