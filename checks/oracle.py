"""SQL for the reference results: DuckDB dialect, on the order-entry views.

`BASE` derives the raw and the wide subscriber table; a query only adds its own SELECT.
"""

from retentia.schema import CHURN_REASONS, COHORTS


def rd(expr, digits=2):
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def rd_even(expr, digits):
    """Half to even, as the what-if tables round."""
    return f"ROUND_EVEN(CAST(CAST({expr} AS DECIMAL(38,10)) AS DOUBLE), {digits})"


def pct(num, den, digits=2):
    return rd(f"100e0 * ({num}) / NULLIF({den}, 0)", digits)


def mean(expr):
    return f"(CAST(SUM({expr}) AS DOUBLE) / NULLIF(COUNT({expr}), 0))"


def avg(expr, digits=2):
    return rd(mean(expr), digits)


def big(expr):
    return f"CAST({expr} AS BIGINT)"


def dbl(expr):
    return f"CAST({expr} AS DOUBLE)"


N = "COUNT(*)"
CHURNED = "CAST(SUM(churn_flag) AS BIGINT)"
RATE = pct("SUM(churn_flag)", "COUNT(*)")

_REASONS = "[" + ", ".join("'" + r.replace("'", "''") + "'" for r in CHURN_REASONS) + "]"
_COHORT = "CASE WHEN tenure_months < 0 THEN NULL " + " ".join(
    f"WHEN tenure_months <= {hi} THEN '{label}'" for label, (hi, _) in COHORTS.items()
) + " END"
SORT_ORDER = "CASE tenure_cohort " + " ".join(
    f"WHEN '{label}' THEN {n}" for label, (_, n) in COHORTS.items()
) + " END"


def _yes(cond):
    return f"CASE WHEN {cond} THEN 'Yes' ELSE 'No' END"


def _addon(i):
    return (
        f"CASE WHEN nk % 3 = 2 THEN 'No internet service' "
        f"WHEN COALESCE(a{i}, 0) >= 7 THEN 'Yes' ELSE 'No' END"
    )


def _flag(c):
    return f"CASE {c} WHEN 'Yes' THEN TRUE WHEN 'No' THEN FALSE END AS {c}_bool"


BASE = f"""
WITH per_customer AS (
  SELECT o_custkey AS pk, MIN(CAST(o_orderdate AS DATE)) AS first_d,
         MAX(CAST(o_orderdate AS DATE)) AS last_d,
         SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS spend
  FROM orders GROUP BY o_custkey),
latest AS (
  SELECT o_custkey AS lk, o_orderpriority, o_orderstatus FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey
             ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS p FROM orders) WHERE p = 1),
items AS (
  SELECT o_custkey AS ik,
    {', '.join(f'COUNT(*) FILTER (WHERE l_partkey % 6 = {i}) AS a{i}' for i in range(6))}
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey),
seed AS (
  SELECT c_custkey AS k, c_nationkey AS nk, c_name, c_acctbal, c_mktsegment, n_name, r_name,
    COALESCE(spend, 0) AS spend, o_orderpriority, o_orderstatus, a0, a1, a2, a3, a4, a5,
    COALESCE(LEAST(72, (last_d - first_d) // 30), 0) AS tenure,
    COALESCE((SELECT MAX(CAST(o_orderdate AS DATE)) FROM orders) - last_d, 0) AS gap
  FROM customer LEFT JOIN per_customer ON c_custkey = pk LEFT JOIN latest ON c_custkey = lk
  LEFT JOIN items ON c_custkey = ik
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
raw AS (
  SELECT c_name AS customer_id, 1 AS row_count_flag, 'United States' AS country,
    r_name AS state, n_name AS city, CAST(10000 + nk * 100 + k % 4 AS VARCHAR) AS zip_code,
    CAST(CAST(30 + nk * 0.25 + (k % 4) * 0.01 AS DECIMAL(9,6)) AS VARCHAR) || ', ' ||
      CAST(CAST(-100 - nk * 0.5 AS DECIMAL(9,6)) AS VARCHAR) AS lat_long_raw,
    CAST(30 + nk * 0.25 + (k % 4) * 0.01 AS DECIMAL(9,6)) AS latitude,
    CAST(-100 - nk * 0.5 AS DECIMAL(9,6)) AS longitude,
    CASE WHEN k % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
    {_yes('k % 6 = 0')} AS senior_citizen, {_yes('k % 4 < 2')} AS has_partner,
    {_yes('k % 3 = 0')} AS has_dependents, CAST(tenure AS BIGINT) AS tenure_months,
    {_yes('k % 10 <> 0')} AS phone_service,
    CASE WHEN k % 10 = 0 THEN 'No phone service' WHEN k % 7 < 3 THEN 'Yes' ELSE 'No' END
      AS multiple_lines,
    CASE nk % 3 WHEN 0 THEN 'DSL' WHEN 1 THEN 'Fiber optic' ELSE 'No' END AS internet_service,
    {_addon(0)} AS online_security, {_addon(1)} AS online_backup, {_addon(2)} AS device_protection,
    {_addon(3)} AS tech_support, {_addon(4)} AS streaming_tv, {_addon(5)} AS streaming_movies,
    CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'Month-to-month'
         WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'One year'
         WHEN c_mktsegment = 'MACHINERY' THEN 'Two year' END AS contract_type,
    {_yes('k % 5 < 3')} AS paperless_billing,
    CASE o_orderpriority[1] WHEN '2' THEN 'Mailed check' WHEN '3' THEN 'Bank transfer (automatic)'
         WHEN '4' THEN 'Credit card (automatic)' ELSE 'Electronic check' END AS payment_method,
    CAST({rd('CAST(spend AS DOUBLE) / GREATEST(tenure, 1) / 100')} AS DECIMAL(18,2))
      AS monthly_charges,
    CASE WHEN tenure = 0 THEN ' ' ELSE CAST(spend AS VARCHAR) END AS total_charges,
    {_yes('gap > 240')} AS churn_label, CASE WHEN gap > 240 THEN 1 ELSE 0 END AS churn_flag,
    GREATEST(0, LEAST(100, gap // 4 + (k * 37) % 41 - 20)) AS churn_score,
    CAST(2000 + FLOOR(ABS(c_acctbal)) AS BIGINT) AS cltv,
    CASE WHEN gap > 240 THEN ({_REASONS})[CAST(
      (CAST(o_orderpriority[1] AS INT) - 1) * 4
      + CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END + k % 2 + 1 AS INT)] END
      AS churn_reason
  FROM seed),
cross_ref AS (
  SELECT CASE WHEN num % 101 = 0 THEN customer_id || '-X' ELSE customer_id END AS id,
    CASE WHEN num % 53 = 0 THEN CAST(monthly_charges AS DOUBLE) + 0.5
         ELSE CAST(monthly_charges AS DOUBLE) END AS charge,
    CASE WHEN num % 71 = 0 THEN 'No' ELSE churn_label END AS label
  FROM (SELECT *, CAST(RIGHT(customer_id, 9) AS BIGINT) AS num FROM raw)),
clean AS (
  SELECT * REPLACE (
      CASE WHEN TRY_CAST(TRIM(total_charges) AS DECIMAL(18,2)) IS NULL AND tenure_months = 0
        THEN monthly_charges ELSE TRY_CAST(TRIM(total_charges) AS DECIMAL(18,2)) END AS total_charges,
      COALESCE(churn_reason, 'Not Applicable - Active Customer') AS churn_reason),
    total_charges AS total_charges_raw,
    TRY_CAST(TRIM(total_charges) AS DECIMAL(18,2)) IS NULL AND tenure_months = 0
      AS is_new_customer_imputed_charges,
    {', '.join(_flag(c) for c in ('senior_citizen', 'has_partner', 'has_dependents', 'phone_service', 'paperless_billing', 'churn_label'))}
  FROM raw),
wide0 AS (
  SELECT * EXCLUDE (row_count_flag, lat_long_raw), {_COHORT} AS tenure_cohort,
    CAST({' + '.join(f"CASE WHEN {c} = 'Yes' THEN 1 ELSE 0 END" for c in ('online_security', 'online_backup', 'device_protection', 'tech_support', 'streaming_tv', 'streaming_movies'))} AS BIGINT)
      AS addon_service_count,
    internet_service <> 'No' AS has_internet,
    phone_service_bool AND internet_service <> 'No' AS has_phone_and_internet,
    streaming_tv = 'Yes' AND streaming_movies = 'Yes' AS is_streaming_bundle,
    total_charges AS monetary_total_charges, monthly_charges AS monetary_monthly_run_rate,
    tenure_months AS recency_tenure_months,
    CASE WHEN tenure_months > 0
      THEN CAST({rd('CAST(total_charges AS DOUBLE) / NULLIF(tenure_months, 0)')} AS DECIMAL(18,2))
      ELSE monthly_charges END AS avg_revenue_per_tenure_month,
    CASE contract_type WHEN 'Month-to-month' THEN 'High' WHEN 'One year' THEN 'Medium'
      WHEN 'Two year' THEN 'Low' END AS contract_based_risk_tier,
    (SELECT COUNT(DISTINCT state) = 1 FROM raw) AS is_single_state_dataset
  FROM clean),
wide AS (
  SELECT *, addon_service_count AS frequency_addon_breadth,
    CAST({SORT_ORDER} AS BIGINT) AS sort_order FROM wide0)
"""


def over_base(select, *ctes):
    """BASE, then further CTEs given as 'name AS (...)', then the SELECT."""
    more = "".join(f",\n{c}" for c in ctes)
    return f"{BASE}{more}\n{select}"
