"""Sources, cleaning, quality and star queries."""

from pyspark.sql import functions as F

from checks.oracle import avg, big, dbl, pct, rd
from checks.registry import query
from retentia.operators import clean, features, quality, star as S
from retentia.plans import etl
from retentia.schema import ADDONS, EXPECTED_COLUMNS, RAW_TO_CLEAN, SERVICE_PLAN_COLUMNS
from retentia.sources import staging, tables

_RAW_SQL = ", ".join(
    f'{dbl(c) if c in ("latitude", "longitude", "monthly_charges") else big(c) if c in ("row_count_flag", "tenure_months", "churn_flag", "churn_score", "cltv") else c} AS "{r}"'
    for r, c in RAW_TO_CLEAN.items()
)


@query("s1_primary_source", f"SELECT {_RAW_SQL} FROM raw")
def _(w):
    return tables.load_primary(w.raw.sparkSession, w.raw_path)


@query(
    "s2_cross_reference_source",
    'SELECT id AS "customerID", charge AS "MonthlyCharges", label AS "Churn" FROM cross_ref',
)
def _(w):
    spark = w.raw.sparkSession
    path = staging.new_path(spark, "cross-csv")
    tables.export_csv(w.cross, path)
    return tables.load_cross_reference(spark, path)


_KEYS_SQL = """SELECT (SELECT COUNT(*) FROM raw) AS primary_row_count,
  (SELECT COUNT(*) FROM cross_ref) AS cross_ref_row_count,
  (SELECT COUNT(DISTINCT customer_id) FROM raw) AS primary_unique_ids,
  (SELECT COUNT(DISTINCT id) FROM cross_ref) AS cross_ref_unique_ids,
  (SELECT COUNT(DISTINCT customer_id) FROM raw WHERE customer_id NOT IN (SELECT id FROM cross_ref))
    AS ids_only_in_primary,
  (SELECT COUNT(DISTINCT id) FROM cross_ref WHERE id NOT IN (SELECT customer_id FROM raw))
    AS ids_only_in_cross_ref"""


@query(
    "q1_compare_keys",
    "SELECT *, ids_only_in_primary + ids_only_in_cross_ref = 0 AS ids_match_exactly"
    f" FROM ({_KEYS_SQL})",
)
def _(w):
    return quality.compare_keys(w.raw, w.cross)


@query(
    "s3_ingest",
    """SELECT k.*, ids_only_in_primary + ids_only_in_cross_ref = 0 AS ids_match_exactly, f.*
    FROM ("""
    + _KEYS_SQL
    + """) k, (SELECT COUNT(*) AS compared_rows,
      COUNT(*) FILTER (WHERE ABS(CAST(monthly_charges AS DOUBLE) - charge) > 0.01)
        AS monthly_charges_mismatches,
      COUNT(*) FILTER (WHERE churn_label IS DISTINCT FROM label) AS churn_label_mismatches
    FROM raw JOIN cross_ref ON customer_id = id) f""",
)
def _(w):
    return etl.ingest_report(w.raw, w.cross)


@query(
    "q3_compare_fields",
    """SELECT COUNT(*) AS compared_rows,
      COUNT(*) FILTER (WHERE ABS(CAST(monthly_charges AS DOUBLE) - charge) > 0.01)
        AS monthly_charges_mismatches,
      COUNT(*) FILTER (WHERE churn_label IS DISTINCT FROM label) AS churn_label_mismatches
    FROM raw JOIN cross_ref ON customer_id = id""",
)
def _(w):
    return quality.compare_fields(w.raw, w.cross)


@query(
    "q2_unique_id_gate",
    "SELECT *, ids_only_in_primary + ids_only_in_cross_ref = 0 AS ids_match_exactly"
    f" FROM ({_KEYS_SQL})",
)
def _(w):
    found = quality.require_unique_ids(w.raw, w.cross)
    return w.raw.sparkSession.createDataFrame([found])


@query(
    "q4_schema_report",
    """SELECT 'missing' AS kind, 'CLTV' AS column_name, CAST(0 AS BIGINT) AS filled
    UNION ALL SELECT 'unexpected', 'Lifetime Value', COUNT(cltv) FROM raw""",
)
def _(w):
    wide = w.raw.withColumnRenamed("CLTV", "Lifetime Value")
    return quality.schema_report(wide)


_NULLS = " UNION ALL ".join(
    f"SELECT '{r}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count,"
    f" COUNT(*) AS n FROM raw"
    for r, c in RAW_TO_CLEAN.items()
)


@query(
    "q5_null_report",
    f"SELECT column_name, null_count, {pct('null_count', 'n')} AS null_pct FROM nulls"
    " WHERE null_count > 0",
    f"nulls AS ({_NULLS})",
)
def _(w):
    return quality.null_report(w.raw)


@query(
    "q6_duplicate_report",
    """SELECT 2 * COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM r2)) AS full_row_duplicates,
      2 * COUNT(*) - COUNT(DISTINCT customer_id) AS key_duplicates FROM raw""",
    "r2 AS (SELECT * FROM raw UNION ALL SELECT * REPLACE (churn_score % 7 AS churn_score) FROM raw)",
)
def _(w):
    again = w.raw.withColumn("Churn Score", F.col("Churn Score") % 7)
    return quality.duplicate_report(w.raw.unionByName(again))


@query(
    "q7_domain_report",
    """SELECT 'Contract' AS column_name, UPPER(contract_type) AS value, COUNT(*) AS rows FROM raw
    WHERE contract_type <> 'One year' GROUP BY ALL
    UNION ALL SELECT 'Gender', 'Unknown', COUNT(*) FROM raw WHERE gender = 'Female' AND cltv > 5000""",
)
def _(w):
    dirty = w.raw.withColumn(
        "Contract",
        F.when(F.col("Contract") != "One year", F.upper("Contract")).otherwise(F.col("Contract")),
    ).withColumn(
        "Gender",
        F.when((F.col("Gender") == "Female") & (F.col("CLTV") > 5000), F.lit("Unknown")).otherwise(
            F.col("Gender")
        ),
    )
    return quality.domain_report(dirty)


@query(
    "q8_blank_total_charges",
    f"""SELECT customer_id AS "CustomerID", tenure_months AS "Tenure Months",
    {dbl('monthly_charges')} AS "Monthly Charges", total_charges AS "Total Charges"
    FROM raw WHERE TRIM(total_charges) = ''""",
)
def _(w):
    return quality.blank_total_charges(w.raw)


@query(
    "q9_range_report",
    """SELECT 'negative_tenure' AS rule, COUNT(*) FILTER (WHERE tenure_months < 30) AS rows FROM raw
    UNION ALL SELECT 'churn_score_out_of_0_100_range', COUNT(*) FILTER (WHERE churn_score > 60)
    FROM raw""",
)
def _(w):
    shifted = w.raw.withColumn("Tenure Months", F.col("Tenure Months") - 30).withColumn(
        "Churn Score", F.col("Churn Score") + 40
    )
    return quality.range_report(shifted)


@query(
    "q10_label_report",
    """SELECT COUNT(*) FILTER (WHERE CASE r.label WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END
      IS DISTINCT FROM churn_flag) AS churn_value_label_mismatches
    FROM (SELECT churn_flag, CASE WHEN payment_method = 'Mailed check' THEN NULL
      WHEN cltv > 9000 THEN 'No' ELSE churn_label END AS label FROM raw) r""",
)
def _(w):
    wrong = w.raw.withColumn(
        "Churn Label",
        F.when(F.col("Payment Method") == "Mailed check", F.lit(None))
        .when(F.col("CLTV") > 9000, F.lit("No"))
        .otherwise(F.col("Churn Label")),
    )
    return quality.label_report(wrong)


_CONSTRAINTS = " UNION ALL ".join(
    [
        f"SELECT 'fact_subscription' AS table_name, '{r}' AS rule,"
        f" COUNT(*) FILTER (WHERE {c}) AS violations FROM wide"
        for r, c in {
            "tenure_months not null": "tenure_months IS NULL",
            "monthly_charges not null": "monthly_charges IS NULL",
            "total_charges not null": "total_charges IS NULL",
            "cltv not null": "cltv IS NULL",
            "tenure_months >= 0": "tenure_months < 0",
            "monthly_charges >= 0": "monthly_charges < 0",
            "total_charges >= 0": "total_charges < 0",
            "churn_flag in (0, 1)": "churn_flag NOT IN (0, 1)",
            "churn_score between 0 and 100": "churn_score NOT BETWEEN 0 AND 100",
        }.items()
    ]
    + [
        f"SELECT '{t}', 'unique ({k})', COUNT(*) - COUNT(DISTINCT {e}) FROM {src}"
        for t, k, e, src in [
            ("fact_subscription", "customer_key", "customer_id", "wide"),
            ("dim_customer", "customer_id", "customer_id", "wide"),
            ("dim_geography", "city, zip_code", "g", "(SELECT DISTINCT city || zip_code g FROM wide)"),
            (
                "dim_plan",
                ", ".join(SERVICE_PLAN_COLUMNS),
                f"({', '.join(SERVICE_PLAN_COLUMNS)})",
                f"(SELECT DISTINCT {', '.join(SERVICE_PLAN_COLUMNS)}, contract_based_risk_tier FROM wide)",
            ),
            ("dim_payment_method", "payment_method", "p", "(SELECT DISTINCT payment_method p FROM wide)"),
            ("dim_tenure_cohort", "tenure_cohort_label", "t", "(SELECT DISTINCT tenure_cohort t FROM wide)"),
            ("dim_churn_reason", "churn_reason", "c", "(SELECT DISTINCT churn_reason c FROM wide)"),
        ]
    ]
)


@query("q11_constraint_report", _CONSTRAINTS)
def _(w):
    return quality.constraint_report(w.star)


@query(
    "q12_foreign_keys",
    """SELECT k AS foreign_key, CAST(0 AS BIGINT) AS null_count, TRUE AS resolved,
      CAST(0 AS BIGINT) AS orphans
    FROM (VALUES ('customer_key'), ('geography_key'), ('plan_key'), ('payment_method_key'),
      ('tenure_cohort_key'), ('churn_reason_key')) t(k)""",
)
def _(w):
    nulls = S.foreign_key_report(w.star.fact_subscription)
    return nulls.join(S.orphan_report(w.star), "foreign_key")


@query(
    "q13_validation_report",
    f"""SELECT 'row_count' AS "check", 'table' AS subject, CAST(COUNT(*) AS DOUBLE) AS value FROM raw
    UNION ALL SELECT 'column_count', 'table', {float(len(EXPECTED_COLUMNS))}::DOUBLE
    UNION ALL SELECT 'nulls', column_name, CAST(null_count AS DOUBLE) FROM nulls WHERE null_count > 0
    UNION ALL SELECT 'consistency', 'churn value vs label', 0e0
    UNION ALL SELECT 'blank_total_charges', 'Total Charges',
      CAST(COUNT(*) FILTER (WHERE TRIM(total_charges) = '') AS DOUBLE) FROM raw
    UNION ALL SELECT 'duplicates', 'full_row_duplicates',
      CAST((SELECT COUNT(*) FROM raw) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM raw)) AS DOUBLE)
    UNION ALL SELECT 'duplicates', 'key_duplicates',
      CAST(COUNT(*) - COUNT(DISTINCT customer_id) AS DOUBLE) FROM raw""",
    f"nulls AS ({_NULLS})",
)
def _(w):
    return quality.run_validation(w.raw)


_IQR = ["tenure_months", "monthly_charges", "total_charges", "cltv", "churn_score"]


@query(
    "q14_iqr_outliers",
    f"""SELECT field, {rd('q1')} AS q1, {rd('q3')} AS q3, {rd('q3 - q1')} AS iqr,
      {rd('q1 - 1.5 * (q3 - q1)')} AS lower_fence, {rd('q3 + 1.5 * (q3 - q1)')} AS upper_fence,
      COUNT(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_outliers,
      {pct('COUNT(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1))', 'COUNT(*)')}
        AS pct_outliers
    FROM long JOIN (SELECT field AS qf, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3
      FROM long GROUP BY field) ON field = qf GROUP BY field, q1, q3""",
    "long AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS DOUBLE) AS v FROM wide" for c in _IQR)
    + ")",
)
def _(w):
    return quality.iqr_outliers(w.wide, _IQR)


@query(
    "q15_documented_blanks",
    "SELECT COUNT(*) FILTER (WHERE TRIM(total_charges) = '') AS blank_total_charges FROM raw",
)
def _(w):
    # a subscriber in the first month has no total yet; that is what the documented number counts
    expected = w.raw.where(F.col("Tenure Months") == 0).count()
    n = quality.require_blank_count(w.raw, expected)
    return w.raw.sparkSession.createDataFrame([(n,)], "blank_total_charges long")


@query(
    "q16_geography_key_safety",
    """SELECT MAX(a) AS max_latitudes, MAX(o) AS max_longitudes, MAX(a) = 1 AND MAX(o) = 1
      AS key_is_safe FROM (SELECT city, zip_code, COUNT(DISTINCT latitude) AS a,
      COUNT(DISTINCT longitude) AS o FROM wide GROUP BY ALL)""",
)
def _(w):
    return quality.geography_key_safety(w.wide)


# --- cleaning and features -----------------------------------------------------------------

_CLEAN_RAW = ", ".join(
    f"{dbl(c) if c in ('latitude', 'longitude', 'monthly_charges') else big(c) if c in ('row_count_flag', 'tenure_months', 'churn_flag', 'churn_score', 'cltv') else c} AS {c}"
    for c in RAW_TO_CLEAN.values()
)


_CLEAN_SELECT = f"SELECT {_CLEAN_RAW} FROM raw"


@query("p1_standard_names", f"SELECT {_CLEAN_RAW} FROM raw")
def _(w):
    return clean.standardize_columns(w.raw)


@query(
    "p2_total_charges",
    f"""SELECT customer_id, total_charges_raw, {dbl('total_charges')} AS total_charges,
    is_new_customer_imputed_charges FROM clean""",
)
def _(w):
    return clean.fix_total_charges(clean.standardize_columns(w.raw)).select(
        "customer_id", "total_charges_raw", "total_charges", "is_new_customer_imputed_charges"
    )


@query("p3_churn_reason", "SELECT customer_id, churn_reason FROM clean")
def _(w):
    named = clean.standardize_columns(w.raw)
    return clean.fix_churn_reason(named).select("customer_id", "churn_reason")


_BOOLS = [
    f"{c}_bool"
    for c in (
        "senior_citizen",
        "has_partner",
        "has_dependents",
        "phone_service",
        "paperless_billing",
        "churn_label",
    )
]


@query("p4_binary_flags", f"SELECT customer_id, {', '.join(_BOOLS)} FROM clean")
def _(w):
    return clean.add_binary_flags(clean.standardize_columns(w.raw)).select("customer_id", *_BOOLS)


@query("p5_drop_redundant", f"SELECT * EXCLUDE (row_count_flag, lat_long_raw) FROM ({_CLEAN_SELECT})")
def _(w):
    return clean.drop_redundant_columns(clean.standardize_columns(w.raw))


_MONEY = (
    "latitude",
    "longitude",
    "monthly_charges",
    "total_charges",
    "monetary_total_charges",
    "monetary_monthly_run_rate",
    "avg_revenue_per_tenure_month",
)
_INTS = (
    "tenure_months",
    "churn_flag",
    "churn_score",
    "cltv",
    "addon_service_count",
    "frequency_addon_breadth",
    "recency_tenure_months",
)
_SWAP = "REPLACE (" + ", ".join(
    [f"{dbl(c)} AS {c}" for c in _MONEY] + [f"{big(c)} AS {c}" for c in _INTS]
) + ")"
_SWAP_CLEAN = "REPLACE (" + ", ".join(
    [f"{dbl(c)} AS {c}" for c in _MONEY[:4]] + [f"{big(c)} AS {c}" for c in _INTS[:4]]
) + ")"


@query(
    "p6_cleaning",
    f"SELECT * EXCLUDE (row_count_flag, lat_long_raw) {_SWAP_CLEAN} FROM clean",
)
def _(w):
    return clean.run_cleaning(w.raw)


@query("p14_features", f"SELECT * EXCLUDE (sort_order) {_SWAP} FROM wide")
def _(w):
    return features.run_features(clean.run_cleaning(w.raw))


@query("s4_wide_table", f"SELECT * {_SWAP} FROM wide")
def _(w):
    return tables.load_wide(w.raw.sparkSession, f"{w.root}/wide")


def _cleaned(w):
    return clean.add_binary_flags(
        clean.fix_total_charges(clean.standardize_columns(w.raw))
    )


@query("p7_tenure_cohort", "SELECT customer_id, tenure_months, tenure_cohort FROM wide")
def _(w):
    return features.add_tenure_cohort(_cleaned(w)).select(
        "customer_id", "tenure_months", "tenure_cohort"
    )


@query("p8_addon_count", "SELECT customer_id, addon_service_count FROM wide")
def _(w):
    return features.add_addon_count(_cleaned(w)).select("customer_id", "addon_service_count")


@query(
    "p9_service_flags",
    "SELECT customer_id, has_internet, has_phone_and_internet, is_streaming_bundle FROM wide",
)
def _(w):
    return features.add_service_flags(_cleaned(w)).select(
        "customer_id", "has_internet", "has_phone_and_internet", "is_streaming_bundle"
    )


@query(
    "p10_rfm_proxies",
    f"""SELECT customer_id, {dbl('total_charges')} AS monetary_total_charges,
    {dbl('monthly_charges')} AS monetary_monthly_run_rate, frequency_addon_breadth,
    recency_tenure_months FROM wide""",
)
def _(w):
    return features.add_rfm_proxies(features.add_addon_count(_cleaned(w))).select(
        "customer_id",
        "monetary_total_charges",
        "monetary_monthly_run_rate",
        "frequency_addon_breadth",
        "recency_tenure_months",
    )


@query(
    "p11_revenue_per_tenure_month",
    f"SELECT customer_id, {dbl('avg_revenue_per_tenure_month')} AS avg_revenue_per_tenure_month FROM wide",
)
def _(w):
    return features.add_revenue_per_tenure_month(_cleaned(w)).select(
        "customer_id", "avg_revenue_per_tenure_month"
    )


@query("p12_contract_risk_tier", "SELECT customer_id, contract_based_risk_tier FROM wide")
def _(w):
    return features.add_contract_risk_tier(_cleaned(w)).select(
        "customer_id", "contract_based_risk_tier"
    )


@query("p13_scope_flag", "SELECT customer_id, is_single_state_dataset FROM wide")
def _(w):
    return features.add_scope_flag(_cleaned(w)).select("customer_id", "is_single_state_dataset")


@query(
    "p15_contract_dummies",
    """SELECT customer_id, CAST(CASE WHEN contract_type = 'Two year' THEN 1 ELSE 0 END AS BIGINT)
    AS contract_two_year, CAST(CASE WHEN contract_type = 'One year' THEN 1 ELSE 0 END AS BIGINT)
    AS contract_one_year FROM wide""",
)
def _(w):
    return features.add_contract_dummies(w.wide).select(
        "customer_id", "contract_two_year", "contract_one_year"
    )


@query(
    "p16_payment_group",
    """SELECT customer_id, CASE WHEN payment_method ILIKE '%automatic%' THEN 'Automatic'
    ELSE payment_method END AS payment_group FROM wide""",
)
def _(w):
    from retentia.functions.columns import payment_group

    return w.wide.select(
        "customer_id", payment_group(F.col("payment_method")).alias("payment_group")
    )


@query(
    "p17_risk_band",
    f"""SELECT city, rate AS churn_rate_pct, CASE WHEN rate >= 35 THEN 'High Risk'
      WHEN rate >= 20 THEN 'Moderate Risk' ELSE 'Healthy' END AS risk_band,
      CASE WHEN rate >= 35 THEN '#D62728' WHEN rate >= 20 THEN '#FF7F0E' ELSE '#2CA02C' END AS kpi_color
    FROM (SELECT city, {pct('SUM(churn_flag)', 'COUNT(*)')} AS rate FROM wide GROUP BY city)""",
)
def _(w):
    from retentia.functions.columns import churn_rate, kpi_color, risk_band

    rates = w.wide.groupBy("city").agg(churn_rate().alias("churn_rate_pct"))
    rate = F.col("churn_rate_pct")
    return rates.select(
        "city", rate, risk_band(rate).alias("risk_band"), kpi_color(rate).alias("kpi_color")
    )


@query(
    "p18_display_formats",
    """SELECT contract_type, printf('%.1f%%', 100e0 * SUM(churn_flag) / COUNT(*)) AS churn_rate,
      '$' || format('{:,}', CAST(ROUND(SUM(CASE WHEN churn_flag = 1 THEN monthly_charges ELSE 0 END), 0)
        AS BIGINT)) AS mrr_at_risk,
      '$' || format('{:,}', CAST(ROUND(CAST(SUM(total_charges) AS DOUBLE) / 1e6, 0) AS BIGINT)) || 'M'
        AS billed_revenue
    FROM wide GROUP BY contract_type""",
)
def _(w):
    from retentia.functions.columns import as_dollars, as_millions, as_percent

    lost = F.sum(F.when(F.col("churn_flag") == 1, F.col("monthly_charges")).otherwise(0))
    return w.wide.groupBy("contract_type").agg(
        as_percent(F.sum("churn_flag") / F.count(F.lit(1))).alias("churn_rate"),
        as_dollars(lost).alias("mrr_at_risk"),
        as_millions(F.sum("total_charges")).alias("billed_revenue"),
    )


@query(
    "p19_eligible_rows",
    " UNION ALL ".join(
        f"SELECT '{c}' AS service, COUNT(*) AS eligible, {avg('cltv')} AS avg_cltv FROM wide"
        f" WHERE {c} <> 'No internet service'"
        for c in ADDONS
    ),
)
def _(w):
    from retentia.operators.explore import eligible_summary

    return eligible_summary(w.wide)


# --- star ----------------------------------------------------------------------------------


@query(
    "d1_dim_customer",
    """SELECT ROW_NUMBER() OVER (ORDER BY customer_id) AS customer_key, customer_id, gender,
    senior_citizen_bool AS senior_citizen, has_partner_bool AS has_partner,
    has_dependents_bool AS has_dependents FROM wide""",
)
def _(w):
    return S.build_dim_customer(w.wide)


@query(
    "d2_dim_geography",
    f"""SELECT ROW_NUMBER() OVER (ORDER BY city, zip_code) AS geography_key, country, state, city,
    zip_code, {dbl('latitude')} AS latitude, {dbl('longitude')} AS longitude FROM
    (SELECT DISTINCT country, state, city, zip_code, latitude, longitude FROM wide)""",
)
def _(w):
    return S.build_dim_geography(w.wide)


_PLAN = (
    "contract_type, internet_service, phone_service_bool, multiple_lines, online_security,"
    " online_backup, device_protection, tech_support, streaming_tv, streaming_movies,"
    " paperless_billing_bool"
)
_PLAN_NAMES = _PLAN.replace("phone_service_bool", "phone_service_bool AS phone_service").replace(
    "paperless_billing_bool", "paperless_billing_bool AS paperless_billing"
)


@query(
    "d3_dim_plan",
    f"""SELECT ROW_NUMBER() OVER (ORDER BY {_PLAN}) AS plan_key, {_PLAN_NAMES},
    contract_based_risk_tier FROM (SELECT DISTINCT {_PLAN}, contract_based_risk_tier FROM wide)""",
)
def _(w):
    return S.build_dim_plan(w.wide)


@query(
    "d4_dim_payment_method",
    """SELECT ROW_NUMBER() OVER (ORDER BY payment_method) AS payment_method_key, payment_method
    FROM (SELECT DISTINCT payment_method FROM wide)""",
)
def _(w):
    return S.build_dim_payment_method(w.wide)


@query(
    "d5_dim_tenure_cohort",
    """SELECT ROW_NUMBER() OVER (ORDER BY sort_order) AS tenure_cohort_key,
    tenure_cohort AS tenure_cohort_label, sort_order
    FROM (SELECT DISTINCT tenure_cohort, sort_order FROM wide WHERE tenure_cohort IS NOT NULL)""",
)
def _(w):
    return S.build_dim_tenure_cohort(w.wide)


@query(
    "d6_dim_churn_reason",
    """SELECT ROW_NUMBER() OVER (ORDER BY churn_reason) AS churn_reason_key, churn_reason
    FROM (SELECT DISTINCT churn_reason FROM wide)""",
)
def _(w):
    return S.build_dim_churn_reason(w.wide)


@query(
    "d7_fact_subscription",
    f"""SELECT customer_key AS subscription_fact_key, customer_key,
      DENSE_RANK() OVER (ORDER BY city, zip_code) AS geography_key,
      DENSE_RANK() OVER (ORDER BY {_PLAN}) AS plan_key,
      DENSE_RANK() OVER (ORDER BY payment_method) AS payment_method_key,
      DENSE_RANK() OVER (ORDER BY sort_order) AS tenure_cohort_key,
      DENSE_RANK() OVER (ORDER BY churn_reason) AS churn_reason_key,
      tenure_months, {dbl('monthly_charges')} AS monthly_charges, {dbl('total_charges')} AS total_charges,
      is_new_customer_imputed_charges, {big('churn_flag')} AS churn_flag, {big('churn_score')} AS churn_score,
      cltv, addon_service_count, {dbl('avg_revenue_per_tenure_month')} AS avg_revenue_per_tenure_month,
      recency_tenure_months, frequency_addon_breadth,
      {dbl('total_charges')} AS monetary_total_charges
    FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY customer_id) AS customer_key FROM wide)""",
)
def _(w):
    dims = {k: v for k, v in w.star.tables().items() if k.startswith("dim_")}
    return S.build_fact_subscription(w.wide, dims)


_COUNTS = """SELECT 'dim_customer' AS table_name, COUNT(DISTINCT customer_id) AS row_count FROM wide
  UNION ALL SELECT 'dim_geography', COUNT(DISTINCT (city, zip_code)) FROM wide
  UNION ALL SELECT 'dim_plan', COUNT(*) FROM (SELECT DISTINCT """ + _PLAN + """ FROM wide)
  UNION ALL SELECT 'dim_payment_method', COUNT(DISTINCT payment_method) FROM wide
  UNION ALL SELECT 'dim_tenure_cohort', COUNT(DISTINCT tenure_cohort) FROM wide
  UNION ALL SELECT 'dim_churn_reason', COUNT(DISTINCT churn_reason) FROM wide
  UNION ALL SELECT 'fact_subscription', COUNT(*) FROM wide"""


@query("d8_etl", _COUNTS + " UNION ALL SELECT 'wide', COUNT(*) FROM wide")
def _(w):
    spark = w.raw.sparkSession
    root = staging.new_path(spark, "etl")
    return etl.etl_summary(etl.run_etl(spark, w.raw, w.cross, root))


@query("s10_table_counts", _COUNTS)
def _(w):
    return tables.table_counts(w.star.tables())


@query(
    "s9_load_check",
    f"""SELECT COUNT(*) AS total_customers, {big('SUM(churn_flag)')} AS churned_customers,
    {pct('SUM(churn_flag)', 'COUNT(*)')} AS churn_rate_pct,
    {dbl('SUM(CASE WHEN churn_flag = 1 THEN monthly_charges ELSE 0 END)')} AS monthly_revenue_at_risk
    FROM wide""",
)
def _(w):
    return tables.load_check(w.star.fact_subscription)


@query("s6_write_star", _COUNTS)
def _(w):
    spark = w.raw.sparkSession
    root = staging.new_path(spark, "star")
    tables.write_star(w.star, root)
    tables.write_star(w.star, root)
    return tables.table_counts(tables.load_star(spark, root).tables())


@query("s7_write_wide", f"SELECT * {_SWAP} FROM wide")
def _(w):
    path = staging.new_path(w.raw.sparkSession, "wide")
    tables.write_table(w.wide, path)
    return w.raw.sparkSession.read.parquet(path)


@query(
    "s11_csv_export",
    """SELECT CAST(ROW_NUMBER() OVER (ORDER BY city, zip_code) AS VARCHAR) AS geography_key, country,
    state, city, zip_code, CAST(latitude AS VARCHAR) AS latitude, CAST(longitude AS VARCHAR) AS longitude
    FROM (SELECT DISTINCT country, state, city, zip_code, latitude, longitude FROM wide)""",
)
def _(w):
    spark = w.raw.sparkSession
    path = staging.new_path(spark, "csv")
    tables.export_csv(w.star.dim_geography, path)
    return spark.read.option("header", True).csv(path)


@query(
    "s12_json_report",
    "SELECT *, ids_only_in_primary + ids_only_in_cross_ref = 0 AS ids_match_exactly"
    f" FROM ({_KEYS_SQL})",
)
def _(w):
    spark = w.raw.sparkSession
    root = staging.new_path(spark, "json")
    tables.export_report({"keys": quality.compare_keys(w.raw, w.cross)}, root)
    return spark.read.json(f"{root}/keys")


@query("s13_star_csv_export", _COUNTS)
def _(w):
    spark = w.raw.sparkSession
    root = staging.new_path(spark, "bi")
    tables.export_star_csv(w.star, root)
    names = w.star.tables()
    return tables.table_counts(
        {n: spark.read.option("header", True).csv(f"{root}/{n}") for n in names}
    )
