"""How five filters interact, for every order of them, by incremental retraction streaming.

All files of the documents are processed as micro-batches of a stream that ends when all are read.
A document is a mask of the filters it fails, and reports are sums over counts of masks per part.
Four filters need the document alone. The fifth, E (the text is that of a smaller id), needs all
documents: keyed state holds, for each text, the least id so far and what was counted for it. When
a smaller id arrives, the earlier mask is retracted from its part's counter and counted again with
E.

The state is a table in the shared folder, not executor memory: each micro-batch appends the rows
that are the least of their text, and reads those of the batches before. What a batch settles and
how it changes the counters go to folders named by the batch, so a batch that is run again replaces
what it wrote. Rows of equal text, part, labels and id are counted first, then the least id of each
(text, part, labels) is found, both with a combine before the shuffle: a text that a third of all
rows hold comes down to a few rows from each task. Texts are told apart by their SHA-256.

Null texts are empty. Null sources are the part ''. A null id fails E never and makes no other fail
it. Rows that repeat an id are no copies of each other (neither id is smaller), so all rows of the
least id pass E. Labels that repeat an id count as 1 if any does; ids without a label count as 0.
Very long texts are read whole by Spark expressions. Further columns are not read, whatever their
names. No documents give no rows.
"""

from itertools import permutations

from pyspark.sql import Window, functions as F

from retentia.llm.common import SPACE, column
from retentia.sources.staging import new_path

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
BIT = {letter: 1 << i for i, letter in enumerate(FILTERS)}
COPY = BIT["E"]
ROUNDS = 4
COUNTER = "part string, mask int, quality int, toxic int, n long"
#: Rows of a batch: n rows of the least id, more rows of greater ids; old: brought from the state.
SETTLED = (
    "key binary, part string, quality int, toxic int, mask int, id long, n long, more long, "
    "old boolean, least long")


def own_mask():
    """Bits of the filters A to D, from columns text, words (number), distinct and capitals."""
    fails = {
        "A": F.col("words") < 200,
        "B": 100 * F.col("distinct") < 50 * F.col("words"),
        "C": 100 * F.col("capitals").cast("long") > 2 * F.length("text"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }
    return sum((F.when(f, BIT[k]).otherwise(0) for k, f in fails.items()), F.lit(0))


def flags(labels):
    """One row per labelled id: whether it is good and whether it is toxic, as 0 or 1."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        one("quality").alias("quality"), one("toxic").alias("toxic"))


def facts(docs, labels):
    """Key of the text, id, part, own mask and labels of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(column(docs, "source").cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
        F.array_remove(F.split(text, f"[{SPACE}]+"), "").alias("list"),
    ).select(
        "id", "part", "text",
        F.size("list").alias("words"),
        F.size(F.array_distinct("list")).alias("distinct"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).alias("capitals"),
    ).select("id", "part", F.unhex(F.sha2("text", 256)).alias("key"), own_mask().alias("mask"))
    return rows.join(flags(labels), "id", "left").select(
        "key", "id", "part", "mask",
        F.coalesce("quality", F.lit(0)).alias("quality"),
        F.coalesce("toxic", F.lit(0)).alias("toxic"),
    )


def combined(rows):
    """Facts of a batch by text, part and labels: rows of the least id, and rows above it.

    Rows without id have a null id; all of them count as n.
    """
    by = ["key", "part", "quality", "toxic"]
    equal = rows.groupBy(*by, "id").agg(F.min("mask").alias("mask"), F.count("*").alias("n"))
    known = F.col("id").isNotNull()
    return equal.groupBy(*by, known.alias("known")).agg(
        F.min("mask").alias("mask"), F.min(F.struct("id", "n")).alias("first"),
        F.sum("n").alias("total"),
    ).select(
        *by, "mask", "first.id", "first.n", (F.col("total") - F.col("first.n")).alias("more"))


def settled(batch, state):
    """Rows of a batch, and those rows of the state that they turn into copies, with the least id
    of their text."""
    old = state.select("key", "part", "quality", "toxic", "mask", "id", "n", F.lit(0).alias("more"))
    both = batch.withColumn("old", F.lit(False)).unionByName(old.withColumn("old", F.lit(True)))
    text = Window.partitionBy("key")
    was = F.min(F.when(F.col("old"), F.col("id"))).over(text)
    rows = both.withColumns({"least": F.min("id").over(text), "was": was})
    retracted = F.col("old") & (F.col("id") == F.col("was")) & (F.col("least") < F.col("id"))
    return rows.where(~F.col("old") | retracted).drop("was")


def state_rows(rows):
    """Of settled rows those that stand for the least id of their text."""
    return rows.where("NOT old AND id = least")


def changes(rows):
    """Changes of the counters by settled rows."""
    mask, copy = F.col("mask"), F.col("mask").bitwiseOR(F.lit(COPY))
    change = lambda bits, n: F.struct(bits.alias("mask"), n.alias("n"))
    passes = F.coalesce(F.col("id") == F.col("least"), F.lit(True))
    new = F.array(
        change(F.when(passes, mask).otherwise(copy), F.col("n")), change(copy, F.col("more")))
    back = F.array(change(mask, -F.col("n")), change(copy, F.col("n")))
    tall = rows.select(
        "part", "quality", "toxic", F.inline(F.when(F.col("old"), back).otherwise(new)))
    return tall.groupBy("part", "mask", "quality", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")


def mask_counts(spark, path, labels, rounds=ROUNDS, root=None):
    """Documents per part, mask and labels, as the sum of all changes that the stream wrote.

    path: Parquet files of documents. rounds: micro-batches; each reads the labels and the state
    once more. A stream that was stopped goes on from where it was if it is given the same root.
    """
    root, path = root or new_path(spark, "audit"), path.rstrip("/")
    sample = spark.read.parquet(path)
    docs = (
        spark.readStream.schema(sample.schema)
        .option("maxFilesPerTrigger", -(-max(1, len(sample.inputFiles())) // rounds))
        .parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern the path may be a file or a folder
    )

    def write(batch, number):
        session = batch.sparkSession
        earlier = session.read.schema(f"{SETTLED}, batch long").parquet(f"{root}/settled")
        state = state_rows(earlier.where(F.col("batch") < number))
        folder = f"{root}/settled/batch={number}"
        settled(combined(facts(batch, labels)), state).write.mode("overwrite").parquet(folder)
        changed = changes(session.read.schema(SETTLED).parquet(folder))
        changed.write.mode("overwrite").parquet(f"{root}/changes/batch={number}")

    for name, schema in (("settled", SETTLED), ("changes", COUNTER)):
        nothing = spark.createDataFrame([], schema)
        nothing.write.mode("overwrite").parquet(f"{root}/{name}/batch=-1")
    stream = (
        docs.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )
    stream.awaitTermination()
    written = spark.read.schema(COUNTER).parquet(f"{root}/changes")
    return written.groupBy("part", "mask", "quality", "toxic").agg(F.sum("n").alias("n"))


def _steps():
    """Every (order, step) with the bit of its filter and the bits of those before it."""
    out = []
    for order in ORDERS:
        earlier = 0
        for step, letter in enumerate(order, 1):
            out.append((order, step, BIT[letter], earlier))
            earlier |= BIT[letter]
    return out


def report(counts):
    """What each filter does at each place of each order, per part, from counts of masks."""
    per = counts.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("quality")).alias("good"),
        F.sum(F.col("n") * F.col("toxic")).alias("bad"),
    )
    steps = ", ".join(f"struct('{o}', {s}, {b}, {e})" for o, s, b, e in _steps())
    tall = per.select("*", F.expr(f"inline(array({steps})) AS (filter_order, step, bit, earlier)"))
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("earlier")) != 0
    here, n = fails & ~gone, F.col("n")
    # a document goes at the first of its failed filters: in 120 / (filters failed) orders at each
    share = F.floor(len(ORDERS) / F.greatest(F.bit_count("mask"), F.lit(1))).cast("long")
    add = lambda when, x: F.coalesce(F.sum(F.when(when, x)), F.lit(0)).cast("long")
    return tall.groupBy("part", "filter_order", "step").agg(
        add(~fails & ~gone, n).alias("kept"),
        add(here, n).alias("removed"),
        add(fails & gone, n).alias("redundant"),
        add(F.col("mask") == F.col("bit"), n).alias("unique_fails"),
        add(here, F.col("good")).alias("good_lost"),
        add(here, F.col("bad")).alias("toxic_lost"),
        add(fails, n * share).alias("shapley"),
    )


def audit(spark, path, labels, rounds=ROUNDS, root=None):
    """The report over all files of a documents table."""
    return report(mask_counts(spark, path, labels, rounds, root))
