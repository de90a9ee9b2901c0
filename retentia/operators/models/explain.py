"""Permutation importance and local explanations, scored for all variants at once."""

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from retentia.operators.models.churn import LABEL, churn_probability
from retentia.operators.models.evaluate import auc
from retentia.operators.models.prep import CHURN, Features, slot_places
from retentia.operators.ranks import global_order
from retentia.session import in_parallel
from retentia.sources.staging import stage


def _typed(df, features):
    """Numerics as double, so that a replaced value fits the column."""
    return df.withColumns({c: F.col(c).cast("double") for c in features.numeric})


def _variant(name, columns, feature, replacement):
    return F.struct(
        F.lit(name).alias("feature"),
        *[
            (replacement if c == feature else F.col(c)).alias(c) for c in columns
        ],
    )


def numbered(df, id_col="customer_id"):
    """Rows numbered in one hash order; staged once for all repeats."""
    return global_order(
        df.withColumn("_h", F.md5(F.col(id_col))), ["_h", id_col], label="permute"
    ).drop("_h", "n", "_at", "_range")


def shuffled(base, df, features, repeat, id_col="customer_id"):
    """Numbered rows beside the values of the row at that place in another hash order."""
    salted = df.select(
        F.md5(F.concat(id_col, F.lit(f"/{repeat}"))).alias("_h"),
        id_col,
        *[F.col(c).alias(f"d_{c}") for c in features.columns],
    )
    donor = global_order(salted, ["_h", id_col], label="donor").select(
        "rn", *[f"d_{c}" for c in features.columns]
    )
    return base.join(donor, "rn").drop("rn")


VECTOR = Features(("x",), ())


def encoded_rows(model, df, features=CHURN):
    """Label and feature vector of each row as an array, encoded once and staged."""
    rows = _typed(df.select("customer_id", LABEL, *features.columns), features)
    for step in model.stages[:-1]:
        rows = step.transform(rows)
    return stage(rows.select("customer_id", LABEL, vector_to_array("features").alias("x")), "encoded")


def _moved(model):
    """Positions of the vector that can change a score: those some tree splits on, otherwise all."""
    last = model.stages[-1]
    if not hasattr(last, "featureImportances"):
        return range(last.numFeatures)
    return [i for i, weight in enumerate(last.featureImportances.toArray()) if weight > 0]


def permutation_scores(model, df, features=CHURN, repeats=10):
    """(variant, label, score) for each feature permuted in each repeat.

    Variant -1 is the unchanged row; the others are the repeat times the number of features plus
    the feature's place. A feature that changes no score (a single level, or no split on it) has no
    rows. Rows are encoded once: a feature fills its own slots of the vector, so permuting it
    permutes these slots.
    """
    encoded = encoded_rows(model, df, features)
    base, moved = numbered(encoded), set(_moved(model))
    slots = [moved.intersection(at) for at in slot_places(model, features).values()]
    mixed = in_parallel(
        [lambda r=r: shuffled(base, encoded, VECTOR, r) for r in range(repeats)])

    def variant(number, taken):
        x = F.transform("x", lambda v, i: F.when(i.isin(*taken), F.get("d_x", i)).otherwise(v))
        return F.struct(
            F.lit(number).alias("variant"), array_to_vector(x if taken else F.col("x")).alias("features"))

    def tall(repeat):
        numbers = range(repeat * len(slots), (repeat + 1) * len(slots))
        variants = [variant(n, taken) for n, taken in zip(numbers, slots) if taken]
        if repeat == 0:
            variants.append(variant(-1, ()))
        return mixed[repeat].select(LABEL, F.inline(F.array(*variants))) if variants else None

    rows = [part for part in map(tall, range(repeats)) if part is not None]
    return churn_probability(
        model.stages[-1], reduce(lambda a, b: a.unionByName(b), rows), "variant", LABEL)


def permutation_importance(model, df, features=CHURN, repeats=10):
    """Mean and deviation of the AUC lost when a feature is permuted, largest first."""
    areas = auc(permutation_scores(model, df, features, repeats), LABEL, "score", by=["variant"])
    areas = stage(areas, "areas")  # a row per variant, read twice
    names = df.sparkSession.createDataFrame(
        list(enumerate(features.columns)), "place int, feature string")
    base = areas.where("variant = -1").select(F.col("auc").alias("base"))
    permuted = areas.where("variant >= 0").select(
        (F.col("variant") % len(features.columns)).alias("place"), "auc")
    # without rows of its own, a feature has the area of the unchanged rows
    drop = F.col("base") - F.coalesce("auc", "base")
    return (
        names.join(permuted, "place", "left")
        .crossJoin(base)
        .groupBy("feature")
        .agg(
            F.round(F.avg(drop), 5).alias("importance_mean"),
            F.round(F.stddev_pop(drop), 5).alias("importance_std"),
        )
        .orderBy(F.desc("importance_mean"), "feature")
    )


def typical_values(df, features=CHURN):
    """Mean of each numeric, most common value (smallest on ties) of each categorical."""
    row = df.agg(
        *[F.avg(c).alias(c) for c in features.numeric],
        *[F.mode(c, True).alias(c) for c in features.categorical],
    ).first()
    return {c: float(row[c]) if c in features.numeric else row[c] for c in features.columns}


def local_explanations(model, rows, reference, features=CHURN):
    """Shift of each row's churn probability when one feature takes its typical value."""
    typical = typical_values(reference, features)
    base = _typed(rows.select("customer_id", *features.columns), features)
    cols = features.columns
    variants = [_variant(f, cols, f, F.lit(typical[f])) for f in cols]
    variants.append(_variant("", cols, None, None))
    own = F.create_map(
        *[x for f in cols for x in (F.lit(f), F.col(f).cast("string"))]
    )
    tall = base.select(
        "customer_id", own.alias("own"), F.explode(F.array(*variants)).alias("v")
    ).select("customer_id", F.col("own")[F.col("v.feature")].alias("customer_value"), "v.*")
    scored = churn_probability(model, tall, "customer_id", "feature", "customer_value")
    unchanged = scored.where(F.col("feature") == "").select(
        "customer_id", F.col("score").alias("base_probability")
    )
    named = F.create_map(*[x for f in cols for x in (F.lit(f), F.lit(str(typical[f])))])
    shift = F.round(F.col("score") - F.col("base_probability"), 4)
    return (
        scored.where(F.col("feature") != "")
        .join(unchanged, "customer_id")
        .select(
            "customer_id",
            "feature",
            "customer_value",
            named[F.col("feature")].alias("typical_value"),
            F.round("base_probability", 4).alias("predicted_churn_probability"),
            shift.alias("probability_shift_if_typical"),
        )
        .orderBy("customer_id", F.desc(F.abs("probability_shift_if_typical")), "feature")
    )
