"""Cleaning, features, quality checks and star schema on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from retentia.operators import clean, features, quality, star as S
from retentia.plans import etl
from retentia.schema import ACTIVE_REASON, EXPECTED_COLUMNS, RAW_SCHEMA
from retentia.sources import staging, tables

BASE = dict(
    zip(
        EXPECTED_COLUMNS,
        [
            "A", 1, "US", "S", "C", "10001", "1, 2", 1, 2, "Male", "No", "No", "No", 5, "Yes", "No",
            "DSL", "Yes", "No", "No", "No", "No", "No", "One year", "Yes", "Mailed check", 10, "50",
            "No", 0, 20, 3000, None,
        ],
    )
)


def raw(spark, *changes):
    from decimal import Decimal

    rows = []
    for i, change in enumerate(changes):
        row = {**BASE, "CustomerID": f"id{i:03d}", **change}
        for c in ("Latitude", "Longitude", "Monthly Charges"):
            row[c] = None if row[c] is None else Decimal(str(row[c]))
        rows.append(tuple(row[c] for c in EXPECTED_COLUMNS))
    return spark.createDataFrame(rows, RAW_SCHEMA)


def test_total_charges_rule(spark):
    df = raw(
        spark,
        {"Tenure Months": 0, "Total Charges": ""},
        {"Tenure Months": 0, "Total Charges": None},
        {"Tenure Months": 0, "Total Charges": " "},
        {"Tenure Months": 0, "Total Charges": "7.5"},
        {"Tenure Months": 4, "Total Charges": " "},
        {"Tenure Months": 4, "Total Charges": "abc"},
    )
    out = clean.fix_total_charges(clean.standardize_columns(df)).orderBy("customer_id").collect()
    assert [None if r.total_charges is None else float(r.total_charges) for r in out] == [
        10.0, 10.0, 10.0, 7.5, None, None,
    ]
    assert [r.is_new_customer_imputed_charges for r in out] == [True] * 3 + [False] * 3
    assert [r.total_charges_raw for r in out] == ["", None, " ", "7.5", " ", "abc"]


def test_cohort_bounds(spark):
    df = raw(spark, *[{"Tenure Months": t} for t in (-1, 0, 12, 13, 60, 61, 72, 73)])
    out = features.add_tenure_cohort(clean.standardize_columns(df)).orderBy("customer_id")
    assert [r.tenure_cohort for r in out.collect()] == [
        None, "0-12 mo", "0-12 mo", "13-24 mo", "49-60 mo", "61-72 mo", "61-72 mo", None,
    ]


def test_flags_and_constant_column(spark):
    df = clean.standardize_columns(raw(spark, {"Partner": "maybe"}, {"Count": 2}))
    flags = clean.add_binary_flags(df).orderBy("customer_id").collect()
    assert [r.has_partner_bool for r in flags] == [None, False]
    kept = clean.drop_redundant_columns(df).columns
    assert "row_count_flag" in kept and "lat_long_raw" not in kept
    one = clean.run_cleaning(raw(spark, {}))
    assert "row_count_flag" not in one.columns
    assert one.first().churn_reason == ACTIVE_REASON


def test_zero_tenure_revenue(spark):
    df = features.run_features(
        clean.run_cleaning(raw(spark, {"Tenure Months": 0, "Total Charges": " "}, {}))
    )
    got = [float(r.avg_revenue_per_tenure_month) for r in df.orderBy("customer_id").collect()]
    assert got == [10.0, 10.0]


def test_duplicates(spark):
    df = raw(spark, {}, {"CustomerID": "id000"}, {"CustomerID": "id000", "CLTV": 1}, {})
    r = quality.duplicate_report(df).first()
    assert (r.full_row_duplicates, r.key_duplicates) == (1, 2)
    with pytest.raises(quality.DuplicateIds):
        quality.require_unique_ids(df)
    r = quality.duplicate_report(df.limit(0)).first()
    assert (r.full_row_duplicates, r.key_duplicates) == (0, 0)


def test_domains_labels_ranges_blanks(spark):
    df = raw(
        spark,
        {"Gender": "X"},
        {"Gender": None, "Churn Label": None},
        {"Churn Label": "Yes", "Churn Value": 0, "Churn Score": 101},
        {"Monthly Charges": -1, "Tenure Months": -2, "Total Charges": " "},
    )
    assert [tuple(r) for r in quality.domain_report(df).collect()] == [("Gender", "X", 1)]
    assert quality.label_report(df).first()[0] == 2
    assert {r.rule: r.rows for r in quality.range_report(df).collect()} == {
        "negative_monthly_charges": 1,
        "negative_tenure": 1,
        "churn_score_out_of_0_100_range": 1,
    }
    assert quality.require_blank_count(df, 1) == 1
    with pytest.raises(quality.UnexpectedCount):
        quality.require_blank_count(df, 11)
    report = {(r.check, r.subject): r.value for r in quality.run_validation(df).collect()}
    assert report[("row_count", "table")] == 4
    assert report[("domain", "Gender=X")] == 1
    assert report[("nulls", "Gender")] == 1
    missing = quality.schema_report(df.drop("CLTV").withColumn("extra", F.lit(1)))
    assert {tuple(r) for r in missing.collect()} == {("missing", "CLTV", 0), ("unexpected", "extra", 4)}


def test_source_comparison(spark):
    a = raw(spark, {}, {}, {"Churn Label": "Yes", "Churn Value": 1})
    b = spark.createDataFrame(
        [("id000", 10.0, "No"), ("id001", 10.02, "No"), ("zzz", 1.0, "No")],
        "customerID string, MonthlyCharges double, Churn string",
    )
    k = quality.compare_keys(a, b).first()
    assert (k.ids_only_in_primary, k.ids_only_in_cross_ref, k.ids_match_exactly) == (1, 1, False)
    f = quality.compare_fields(a, b).first()
    assert (f.compared_rows, f.monthly_charges_mismatches, f.churn_label_mismatches) == (2, 1, 0)


def load(spark, *changes, root=None):
    df = raw(spark, *changes)
    cross = df.select(
        F.col("CustomerID").alias("customerID"),
        F.col("Monthly Charges").cast("double").alias("MonthlyCharges"),
        F.col("Churn Label").alias("Churn"),
    )
    return etl.run_etl(spark, df, cross, root or staging.new_path(spark, "test"))


def test_star_keys_and_counts(spark):
    w = load(spark, {}, {"City": "D", "State": "S2"}, {"City": "C", "State": "S"}, {"Contract": "Two year"})
    counts = {r.table_name: r.row_count for r in etl.etl_summary(w).collect()}
    assert counts["dim_customer"] == 4
    assert counts["dim_geography"] == 2
    assert counts["dim_plan"] == 2
    assert counts["fact_subscription"] == 4
    keys = [r.customer_key for r in w.star.dim_customer.orderBy("customer_id").collect()]
    assert keys == [1, 2, 3, 4]
    quality.require_constraints(w.star)
    assert S.orphan_report(w.star).where("orphans > 0").count() == 0
    report = {r.subject: r.value for r in etl.etl_report(w).collect()}
    assert report["fact_subscription"] == 4


def test_null_cohort_aborts_and_names_ids(spark):
    with pytest.raises(S.UnresolvedKeys, match="id001"):
        load(spark, {}, {"Tenure Months": 73})


def test_a_failed_load_leaves_the_one_before(spark):
    root = staging.new_path(spark, "gated")
    good = load(spark, {}, {}, root=root)
    n = good.star.fact_subscription.count()
    with pytest.raises(S.UnresolvedKeys):
        load(spark, {}, {"Tenure Months": 73}, root=root)
    with pytest.raises(quality.BrokenConstraints, match="churn_score"):
        load(spark, {}, {"Churn Score": 900}, root=root)
    kept = etl.open_warehouse(spark, root)
    assert kept.root == good.root and kept.star.fact_subscription.count() == n
    again = load(spark, {}, {}, {}, root=root)
    assert etl.open_warehouse(spark.newSession(), root).root == again.root


def test_views_of_the_star(spark):
    tables.register_star(load(spark, {}, {}).star)
    assert spark.sql("SELECT count(*) FROM fact_subscription JOIN dim_plan USING (plan_key)").first()[0] == 2


def test_local_folders_are_refused_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: "file:///tmp/x")

        class sparkContext:
            master, applicationId = "spark://m:7077", "app"

    with pytest.raises(ValueError, match="local folder"):
        staging.shared_dir(Cluster)


def test_orphans_are_found(spark):
    w = load(spark, {}, {})
    w.star.dim_plan = w.star.dim_plan.limit(0)
    found = {r.foreign_key: r.orphans for r in S.orphan_report(w.star).collect()}
    assert found["plan_key"] == 2 and found["customer_key"] == 0


def test_geography_key_unsafe(spark):
    df = clean.run_cleaning(raw(spark, {}, {"Latitude": 9}))
    r = quality.geography_key_safety(df).first()
    assert (r.max_latitudes, r.key_is_safe) == (2, False)


def test_csv_sources(spark):
    df = raw(spark, {}, {"Total Charges": " "})
    path = staging.new_path(spark, "csv")
    tables.export_csv(df, path)
    back = tables.load_primary(spark, path, "csv")
    assert back.schema == df.schema and back.count() == 2


def test_pushdown_and_pruning(spark, small):
    from retentia.operators import kpis, rules

    text = rules.high_risk_customers(small.star)._jdf.queryExecution().toString()
    assert "churn_flag" in text and "PartitionFilters: [isnotnull(churn_flag" in text
    assert "GreaterThanOrEqual(churn_score,70)" in text
    wide = kpis.headline_kpis(small.wide)._jdf.queryExecution().toString()
    scan = [x for x in wide.splitlines() if "ReadSchema" in x][-1]
    assert "customer_id" not in scan.split("ReadSchema")[1]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_joins_narrow_columns(spark, tmp_path):
    """the load's join by order moves keys and line items only."""
    from datetime import datetime
    from decimal import Decimal

    from retentia.sources.fixtures import customer_history

    order = lambda key, who, day, price, prio="1-URGENT": (
        key, who, "F", price, datetime(2020, 1, day), prio
    )
    spark.createDataFrame(
        [
            order(1, 7, 1, 10.005),
            order(2, 7, 3, 1.25, "3-MEDIUM"),
            order(2, 7, 3, 1.25, "3-MEDIUM"),  # comes twice, so its items count twice
            order(3, 8, 2, 5.0),  # no items
            order(None, 9, 2, 5.0),
            order(4, None, 2, 5.0),
        ],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp, o_orderpriority string",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    items = [(1, 0), (1, 6), (1, 5), (2, 5), (2, None), (2, -1), (None, 1), (4, 1), (9, 1)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long").write.parquet(
        f"{tmp_path}/lineitem.parquet"
    )
    out = customer_history(spark, str(tmp_path))
    got = {
        r.o_custkey: (r.first_day.day, r.last_day.day, r.spend, r.latest, *[r[f"n{i}"] for i in range(6)])
        for r in out.collect()
    }
    assert got == {
        7: (1, 3, Decimal("12.51"), 30, 2, 0, 0, 0, 0, 3),
        8: (2, 2, Decimal("5.00"), 10, 0, 0, 0, 0, 0, 0),
        9: (2, 2, Decimal("5.00"), None, 0, 0, 0, 0, 0, 0),
    }
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan_of(out)


def test_first_per_key_hashes_before_it_sorts(spark):
    """dimensions do not sort all rows of the wide table."""
    df = spark.createDataFrame(
        [("a", "y", 2), ("a", "y", 2), ("a", "x", 9), ("b", None, 1), (None, "z", 1)],
        "k string, v string, w int",
    )
    out = S.first_per_key(df, ["k"], ["v", "w"])
    assert {tuple(r) for r in out.collect()} == {("a", "x", 9), ("b", None, 1), (None, "z", 1)}
    assert "HashAggregate(keys=[k" in plan_of(out)


def test_keys_are_compared_in_one_grouping(spark):
    """no join of all ids; null ids stay without a partner."""
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,), (None,)], "CustomerID string")
    b = spark.createDataFrame([("x",), ("z",), ("z",), (None,)], "customerID string")
    out = quality.compare_keys(a, b)
    assert tuple(out.first()) == (5, 4, 3, 3, 2, 2, False)
    assert tuple(quality.compare_keys(a.limit(0), b.limit(0)).first()) == (0, 0, 0, 0, 0, 0, True)
    assert tuple(quality.compare_keys(b, b, "customerID").first())[4:] == (1, 1, False)
    assert "Join" not in plan_of(out)
