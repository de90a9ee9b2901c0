"""Features, folds and class weights shared by the models."""

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    OneHotEncoder,
    OneHotEncoderModel,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.sql import DataFrame, functions as F

from retentia.operators.ranks import global_order
from retentia.schema import ADDONS
from retentia.session import in_parallel
from retentia.sources.staging import stage


@dataclass(frozen=True)
class Features:
    numeric: tuple
    categorical: tuple

    @property
    def columns(self):
        return [*self.numeric, *self.categorical]

    def plus(self, numeric=(), categorical=()):
        return Features((*self.numeric, *numeric), (*self.categorical, *categorical))


# the vendor's own score and lifetime value stay out of the churn features
CHURN = Features(
    ("tenure_months", "monthly_charges", "total_charges", "addon_service_count"),
    (
        "contract_type",
        "internet_service",
        "payment_method",
        "gender",
        "senior_citizen",
        "has_partner",
        "has_dependents",
        "paperless_billing",
        "multiple_lines",
        *ADDONS,
    ),
)
CHURN_EXTENDED = CHURN.plus(["avg_revenue_per_tenure_month"], ["tenure_cohort"])
LTV = Features(
    CHURN.numeric,
    ("contract_type", "internet_service", "payment_method", "senior_citizen", "has_dependents"),
)
# addon_service_count would leak the target of an add-on model
UPSELL = Features(
    ("tenure_months", "monthly_charges"),
    ("contract_type", "internet_service", "has_dependents", "senior_citizen"),
)


@dataclass(frozen=True)
class Sizes:
    """Model sizes; the defaults are the published ones."""

    forest_trees: int = 200
    forest_depth: int = 8
    boost_rounds: int = 150
    boost_depth: int = 3
    boost_step: float = 0.1
    addon_trees: int = 150
    addon_depth: int = 6
    folds: int = 5
    restarts: int = 10
    seed: int = 42


def category_levels(train, features):
    """Sorted levels per categorical column, for columns with more than one level.

    A level is a slot of the feature vector and a name in reports, so the driver gets them all.
    """
    cats = features.categorical
    row = train.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in cats]).first()
    return {c: list(row[c]) for c in cats if len(row[c]) > 1}


def encoding_stages(levels, features):
    """Pipeline stages: scaled numerics and dummies without the first level of each category.

    The indexer sorts levels from last to first, so the encoder's dropped last index is the first
    level. A level not seen in training gets the number after that and is moved to it, which
    gives it zeros everywhere.
    """
    cats = list(levels)
    known = ", ".join(
        f"LEAST({c}_number, {len(ls) - 1}D) AS {c}_index" for c, ls in levels.items()
    )
    stages = []
    if cats:
        stages += [
            StringIndexer(
                inputCols=cats,
                outputCols=[f"{c}_number" for c in cats],
                stringOrderType="alphabetDesc",
                handleInvalid="keep",
            ),
            SQLTransformer(statement=f"SELECT *, {known} FROM __THIS__"),
            OneHotEncoder(
                inputCols=[f"{c}_index" for c in cats],
                outputCols=[f"{c}_dummies" for c in cats],
                dropLast=True,
            ),
        ]
    return stages + [
        VectorAssembler(inputCols=list(features.numeric), outputCol="numeric_raw"),
        StandardScaler(
            inputCol="numeric_raw", outputCol="numeric_scaled", withMean=True, withStd=True
        ),
        VectorAssembler(
            inputCols=["numeric_scaled", *[f"{c}_dummies" for c in cats]], outputCol="features"
        ),
    ]


def slot_names(levels, features):
    """Name of each position of the features vector made by encoding_stages."""
    names = list(features.numeric)
    for c, ls in levels.items():
        names += [f"{c}_{level}" for level in sorted(ls, reverse=True)[:-1]]
    return names


def slot_places(model, features):
    """Positions of each feature in the vector of a fitted pipeline; a single level has none."""
    sizes = {}
    for step in model.stages:
        if isinstance(step, OneHotEncoderModel):
            sizes = dict(zip(step.getInputCols(), step.categorySizes))
    places, at = {}, 0
    for c in features.columns:
        width = 1 if c in features.numeric else sizes.get(f"{c}_index", 1) - 1
        places[c] = list(range(at, at + width))
        at += width
    return places


def stratified_position(df, label, id_col="customer_id"):
    """Add `_pos` (1..n inside each label, in hash order of the id) and `_label_n`.

    Without a label (None) all rows are one stratum. The rows are staged in that order, so later
    passes read the same split whatever is lost.
    """
    by = [] if label is None else [label]
    hashed = df.withColumn("_h", F.md5(F.col(id_col).cast("string")))
    ordered = global_order(hashed, [*by, "_h", id_col], label="strata")
    if by:
        starts = ordered.groupBy(label).agg(
            F.min("rn").alias("_first"), F.count(F.lit(1)).alias("_label_n")
        )
        # one row per label, so the rows themselves do not move
        placed = ordered.join(F.broadcast(starts), label)
    else:
        placed = ordered.withColumns({"_first": F.lit(1), "_label_n": F.col("n")})
    return placed.withColumn("_pos", F.col("rn") - F.col("_first") + 1).drop(
        "rn", "n", "_at", "_range", "_first", "_h"
    )


def with_split(df, label, id_col="customer_id", train_pct=80):
    """Add the boolean `is_train`; each label keeps its share on both sides.

    Staged in one folder per side, as fitting reads its rows many times.
    """
    placed = stratified_position(df, label, id_col)
    cut = F.floor(F.col("_label_n") * train_pct / 100)
    split = placed.withColumn("is_train", F.col("_pos") <= cut).drop("_pos", "_label_n")
    return stage(split, "split", ["is_train"])


def with_folds(df, label, k, id_col="customer_id"):
    """Add `fold` in 0..k-1, dealt out in turn inside each label; staged in one folder per fold."""
    placed = stratified_position(df, label, id_col)
    fold = ((F.col("_pos") - 1) % k).cast("int")
    return stage(placed.withColumn("fold", fold).drop("_pos", "_label_n"), "folds", ["fold"])


def balanced_weight(counts, label):
    """n / (2 * n_label) from label counts, so both labels weigh the same in total."""
    whole = sum(counts.values())
    weight = F.lit(1.0)
    for value, count in counts.items():
        weight = F.when(F.col(label) == value, whole / (2 * count)).otherwise(weight)
    return weight


def with_balanced_weight(df, label, name="weight"):
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("c")).collect()
    return df.withColumn(name, balanced_weight({r[label]: r["c"] for r in rows}, label))


def training_folds(folded, label, k, name="weight"):
    """The k training frames (all folds but one) with balanced weights, from one count."""
    rows = folded.groupBy("fold", label).agg(F.count(F.lit(1)).alias("c")).collect()
    frames = []
    for fold in range(k):
        counts = {}
        for r in rows:
            if r.fold != fold:
                counts[r[label]] = counts.get(r[label], 0) + r.c
        frames.append(
            folded.where(F.col("fold") != fold).withColumn(name, balanced_weight(counts, label))
        )
    return frames, sum(r.c for r in rows)


#: Rows of encoded vectors that one task of a fit reads at least.
ROWS_PER_TASK = 50_000


def fit_width(spark, rows):
    """How many fits over so many rows run at once.

    Small fits are one task each and fill the slots together. A fit of many rows fills them alone,
    and each keeps its own copy of its rows (a forest a number per tree and row as well), so fewer
    run at once the more rows there are: the copies held do not grow past what one or two fits need.
    """
    slots = max(4, min(32, spark.sparkContext.defaultParallelism))
    return max(2, -(-slots // max(1, rows // ROWS_PER_TASK)))


@dataclass(frozen=True)
class EncodedFold:
    """One fold with all its rows as vectors, encoded by the levels of its training rows."""

    fold: int
    train: DataFrame
    held: DataFrame


def encoded_folds(folded, features, label, k, balanced=True):
    """One staged vector table per fold, with label, weight, fold and id, which all fits read.

    The encoding of a fold is found once, on its training rows; each table is written in as many
    parts as its rows need, so that small folds are one task and large ones stay spread out.
    """
    frames, rows = training_folds(folded, label, k) if balanced else (
        [folded.where(F.col("fold") != f).withColumn("weight", F.lit(1.0)) for f in range(k)],
        folded.count())

    def encode(fold):
        train = frames[fold]
        levels = category_levels(train, features)
        prep = Pipeline(stages=encoding_stages(levels, features)).fit(train)
        every = train.unionByName(
            folded.where(F.col("fold") == fold).withColumn("weight", F.lit(1.0)))
        vectors = prep.transform(every).select(
            label, "weight", "features", "fold", (F.col("fold") == fold).alias("held"))
        return stage(vectors.coalesce(max(1, rows // ROWS_PER_TASK)), "encoded", ["held"])

    tables = in_parallel([lambda f=f: encode(f) for f in range(k)])
    return [
        EncodedFold(f, t.where("NOT held").drop("held"), t.where("held").drop("held"))
        for f, t in enumerate(tables)
    ], rows
