"""Checks of the raw table, of two sources against each other, and of the stored star.

Each check is one distributed aggregate and returns a small frame; the `require_*` functions
run it and raise.
"""

from functools import reduce

from pyspark.sql import functions as F

from retentia.functions.columns import pct, rounded
from retentia.operators.ranks import by_variable, exact_quantiles
from retentia.schema import DOMAINS, EXPECTED_COLUMNS, SERVICE_PLAN_COLUMNS


class DuplicateIds(ValueError):
    pass


class UnexpectedCount(ValueError):
    pass


def _rows(parts):
    return reduce(lambda a, b: a.unionByName(b), parts)


def _long(one_row, names, key, value):
    return one_row.unpivot([], names, key, value)


# --- two sources -------------------------------------------------------------------------


def compare_keys(primary, cross, key="CustomerID", cross_key="customerID"):
    """Row counts, distinct ids and the difference of the id sets, in one row.

    Ids of both sides are counted in one grouping, however often they repeat. A null id has no
    partner on the other side.
    """
    side = lambda df, c, a, b: df.select(F.col(c).alias("id"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    both = (
        side(primary, key, 1, 0)
        .unionByName(side(cross, cross_key, 0, 1))
        .groupBy("id")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )
    in_a, in_b = F.col("a") > 0, F.col("b") > 0
    alone = F.col("id").isNull() | (in_a != in_b)
    return both.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("primary_row_count"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("cross_ref_row_count"),
        F.count_if(in_a).alias("primary_unique_ids"),
        F.count_if(in_b).alias("cross_ref_unique_ids"),
        F.count_if(in_a & alone).alias("ids_only_in_primary"),
        F.count_if(in_b & alone).alias("ids_only_in_cross_ref"),
        (F.count_if(alone) == 0).alias("ids_match_exactly"),
    )


def require_unique_ids(primary, cross=None):
    """A repeated id is an error; differing id sets are only reported."""
    cross = primary.select(F.col("CustomerID").alias("customerID")) if cross is None else cross
    r = compare_keys(primary, cross).first()
    if r.primary_unique_ids != r.primary_row_count:
        raise DuplicateIds(f"primary: {r.primary_row_count - r.primary_unique_ids} repeated ids")
    if r.cross_ref_unique_ids != r.cross_ref_row_count:
        raise DuplicateIds(
            f"cross reference: {r.cross_ref_row_count - r.cross_ref_unique_ids} repeated ids"
        )
    return r


def compare_fields(primary, cross, tolerance=0.01):
    """Charge and label disagreements on the ids both sources have."""
    both = primary.select(
        F.col("CustomerID").alias("id"),
        F.col("Monthly Charges").cast("double").alias("a_charge"),
        F.col("Churn Label").alias("a_label"),
    ).join(
        cross.select(
            F.col("customerID").alias("id"),
            F.col("MonthlyCharges").alias("b_charge"),
            F.col("Churn").alias("b_label"),
        ),
        "id",
    )
    return both.agg(
        F.count(F.lit(1)).alias("compared_rows"),
        F.count_if(F.abs(F.col("a_charge") - F.col("b_charge")) > tolerance).alias(
            "monthly_charges_mismatches"
        ),
        F.count_if(~F.coalesce(F.col("a_label") == F.col("b_label"), F.lit(False))).alias(
            "churn_label_mismatches"
        ),
    )


# --- one raw table -----------------------------------------------------------------------


def schema_report(df):
    """(kind, column_name, filled) for each missing or unexpected column.

    filled: rows with a value, so an unexpected column that is empty is told from one that holds
    data; 0 for a missing one.
    """
    rows = [("missing", c) for c in EXPECTED_COLUMNS if c not in df.columns]
    rows += [("unexpected", c) for c in df.columns if c not in EXPECTED_COLUMNS]
    entries = [
        F.struct(
            F.lit(kind).alias("kind"),
            F.lit(c).alias("column_name"),
            (F.count(F.col(f"`{c}`")) if kind == "unexpected" else F.lit(0).cast("long"))
            .alias("filled"),
        )
        for kind, c in rows
    ]
    found = F.array(*entries).cast("array<struct<kind:string,column_name:string,filled:long>>")
    # an aggregate even where nothing is counted, so the report is one row of findings
    return df.agg(F.count(F.lit(1)), found.alias("found")).select(
        F.explode("found").alias("e")
    ).select("e.*")


def null_report(df):
    """Columns holding nulls, with count and percentage."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    return (
        counts.unpivot(["_n"], df.columns, "column_name", "null_count")
        .where(F.col("null_count") > 0)
        .select("column_name", "null_count", pct(F.col("null_count"), F.col("_n")).alias("null_pct"))
    )


def duplicate_report(df, key="CustomerID"):
    """Rows after the first of each full row and of each key.

    Full rows are compared by their own values: the second grouping folds the per-row counts
    into per-key counts, so the table is shuffled once on the row and once on the key.
    """
    per_row = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    per_key = per_row.groupBy(key).agg(
        F.sum("_c").alias("_rows"), F.sum(F.col("_c") - 1).alias("_same")
    )
    return per_key.agg(
        F.coalesce(F.sum("_same"), F.lit(0)).alias("full_row_duplicates"),
        F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("key_duplicates"),
    )


def domain_report(df, domains=None):
    """(column_name, value, rows) for values outside the allowed set; nulls pass."""
    domains = {c: v for c, v in (domains or DOMAINS).items() if c in df.columns}
    if not domains:
        return df.sparkSession.createDataFrame([], "column_name string, value string, rows long")
    pairs = [
        F.when(
            F.col(c).isNotNull() & ~F.col(c).isin(allowed),
            F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")),
        )
        for c, allowed in domains.items()
    ]
    return (
        df.select(F.explode(F.array_compact(F.array(*pairs))).alias("p"))
        .groupBy("p.column_name", "p.value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def _blank_amount():
    return F.coalesce(F.trim("Total Charges"), F.lit("")) == ""


def blank_total_charges(df):
    """Rows without an amount: text that is empty, blank or null."""
    return df.where(_blank_amount()).select(
        "CustomerID", "Tenure Months", "Monthly Charges", "Total Charges"
    )


def require_blank_count(df, expected):
    """The documented number of blank amounts must be the actual one."""
    actual = blank_total_charges(df).count()
    if actual != expected:
        raise UnexpectedCount(f"{actual} blank total charges, {expected} documented")
    return actual


RANGE_RULES = {
    "negative_monthly_charges": lambda: F.col("Monthly Charges") < 0,
    "negative_tenure": lambda: F.col("Tenure Months") < 0,
    "churn_score_out_of_0_100_range": lambda: ~F.col("Churn Score").between(0, 100),
    "negative_cltv": lambda: F.col("CLTV") < 0,
}


def range_report(df):
    """Range rules broken by at least one row."""
    hits = df.agg(*[F.count_if(rule()).alias(name) for name, rule in RANGE_RULES.items()])
    return _long(hits, list(RANGE_RULES), "rule", "rows").where(F.col("rows") > 0)


def _label_mismatch():
    expected = F.when(F.col("Churn Label") == "Yes", 1).when(F.col("Churn Label") == "No", 0)
    return ~F.coalesce(F.col("Churn Value") == expected, F.lit(False))


def label_report(df):
    """Rows whose numeric churn value does not follow from the label; a null label counts."""
    return df.agg(F.count_if(_label_mismatch()).alias("churn_value_label_mismatches"))


def run_validation(df):
    """Every check of the raw table as (check, subject, value) rows.

    All counting checks share one pass; only duplicates and domains need a pass of their own.
    """
    metrics = [
        ("row_count", "table", F.count(F.lit(1)), True),
        *[("nulls", c, F.count_if(F.col(c).isNull()), False) for c in df.columns],
        *[("range", name, F.count_if(rule()), False) for name, rule in RANGE_RULES.items()],
        ("consistency", "churn value vs label", F.count_if(_label_mismatch()), True),
        ("blank_total_charges", "Total Charges", F.count_if(_blank_amount()), True),
    ]
    counted = df.agg(*[m[2].alias(f"m{i}") for i, m in enumerate(metrics)])
    entries = [
        F.struct(
            F.lit(check).alias("check"),
            F.lit(subject).alias("subject"),
            F.col(f"m{i}").cast("double").alias("value"),
            F.lit(always).alias("always"),
        )
        for i, (check, subject, _, always) in enumerate(metrics)
    ]
    single = (
        counted.select(F.explode(F.array(*entries)).alias("e"))
        .select("e.*")
        .where(F.col("always") | (F.col("value") > 0))
        .drop("always")
    )
    row = lambda src, check, subject, value: src.select(
        F.lit(check).alias("check"),
        subject.cast("string").alias("subject"),
        value.cast("double").alias("value"),
    )
    width = df.sparkSession.range(1).select(F.lit(len(df.columns)).alias("w"))
    dup = duplicate_report(df).unpivot(
        [], ["full_row_duplicates", "key_duplicates"], "kind", "rows"
    )
    return _rows(
        [
            single,
            row(width, "column_count", F.lit("table"), F.col("w")),
            row(schema_report(df), "schema", F.concat_ws(" ", "kind", "column_name"), F.lit(1)),
            row(dup, "duplicates", F.col("kind"), F.col("rows")),
            row(
                domain_report(df), "domain", F.concat_ws("=", "column_name", "value"), F.col("rows")
            ),
        ]
    )


# --- constraints of the stored star ------------------------------------------------------

FACT_RULES = {
    "tenure_months not null": lambda: F.col("tenure_months").isNull(),
    "monthly_charges not null": lambda: F.col("monthly_charges").isNull(),
    "total_charges not null": lambda: F.col("total_charges").isNull(),
    "cltv not null": lambda: F.col("cltv").isNull(),
    "tenure_months >= 0": lambda: F.col("tenure_months") < 0,
    "monthly_charges >= 0": lambda: F.col("monthly_charges") < 0,
    "total_charges >= 0": lambda: F.col("total_charges") < 0,
    "churn_flag in (0, 1)": lambda: ~F.coalesce(F.col("churn_flag").isin(0, 1), F.lit(False)),
    "churn_score between 0 and 100": lambda: ~F.coalesce(
        F.col("churn_score").between(0, 100), F.lit(False)
    ),
}
UNIQUE_RULES = {
    "fact_subscription": ["customer_key"],
    "dim_customer": ["customer_id"],
    "dim_geography": ["city", "zip_code"],
    "dim_plan": SERVICE_PLAN_COLUMNS,
    "dim_payment_method": ["payment_method"],
    "dim_tenure_cohort": ["tenure_cohort_label"],
    "dim_churn_reason": ["churn_reason"],
}


def constraint_report(star):
    """(table_name, rule, violations) for NOT NULL, CHECK and UNIQUE rules of the warehouse."""
    fact = star.fact_subscription
    checks = fact.agg(*[F.count_if(rule()).alias(name) for name, rule in FACT_RULES.items()])
    parts = [
        _long(checks, list(FACT_RULES), "rule", "violations").select(
            F.lit("fact_subscription").alias("table_name"), "rule", "violations"
        )
    ]
    for table, key in UNIQUE_RULES.items():
        groups = star.tables()[table].groupBy(*key).agg(F.count(F.lit(1)).alias("c"))
        parts.append(
            groups.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("violations")).select(
                F.lit(table).alias("table_name"),
                F.lit(f"unique ({', '.join(key)})").alias("rule"),
                "violations",
            )
        )
    return _rows(parts)


class BrokenConstraints(ValueError):
    pass


def require_constraints(star):
    bad = constraint_report(star).where(F.col("violations") > 0).collect()
    if bad:
        raise BrokenConstraints([tuple(r) for r in bad])


# --- shape of the numbers ----------------------------------------------------------------


def iqr_outliers(df, cols):
    """Quartiles, fences and the rows outside them, per numeric column."""
    quartiles = by_variable(exact_quantiles(df, cols, [0.25, 0.75]))

    def fences(c):
        q1, q3 = F.col("q")[c][0], F.col("q")[c][1]
        return q1, q3, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)

    def outside(c):
        _, _, lo, hi = fences(c)
        value = F.col(c).cast("double")
        return (value < lo) | (value > hi)

    hits = (
        df.select(*cols, quartiles.alias("q"))
        .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(outside(c)).alias(c) for c in cols])
        .withColumn("q", quartiles)
    )
    rows = []
    for c in cols:
        q1, q3, lo, hi = fences(c)
        rows.append(
            F.struct(
                F.lit(c).alias("field"),
                rounded(q1, 2).alias("q1"),
                rounded(q3, 2).alias("q3"),
                rounded(q3 - q1, 2).alias("iqr"),
                rounded(lo, 2).alias("lower_fence"),
                rounded(hi, 2).alias("upper_fence"),
                F.col(c).alias("n_outliers"),
                pct(F.col(c), F.col("n")).alias("pct_outliers"),
            )
        )
    return hits.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def geography_key_safety(wide):
    """Most distinct coordinates found under one (city, zip); 1 and 1 make the key safe."""
    pairs = wide.groupBy("city", "zip_code", "latitude", "longitude").agg(F.lit(1).alias("one"))
    per_key = pairs.groupBy("city", "zip_code").agg(
        F.count_distinct("latitude").alias("lat"), F.count_distinct("longitude").alias("lon")
    )
    return per_key.agg(
        F.max("lat").alias("max_latitudes"),
        F.max("lon").alias("max_longitudes"),
        ((F.max("lat") == 1) & (F.max("lon") == 1)).alias("key_is_safe"),
    )
