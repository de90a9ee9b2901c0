"""KPI, health, rollup and call-list queries."""

from pyspark.sql import functions as F

from checks.oracle import CHURNED, N, RATE, avg, big, dbl, pct, rd
from checks.registry import query
from retentia.operators import kpis, rollups, rules
from retentia.sources import upsert
from retentia.sources.staging import new_path

LOST = "SUM(CASE WHEN churn_flag = 1 THEN monthly_charges ELSE 0 END)"


@query(
    "k1_executive_summary",
    f"""SELECT {N} AS total_customers, {CHURNED} AS churned_customers, {RATE} AS churn_rate_pct,
    {dbl('SUM(total_charges)')} AS total_billed_revenue, {dbl('SUM(monthly_charges)')} AS current_mrr,
    {dbl(LOST)} AS mrr_at_risk_from_churned, {avg('cltv')} AS avg_cltv,
    {avg('tenure_months')} AS avg_tenure_months FROM wide""",
)
def _(w):
    return kpis.kpi_summary(w.star)


@query(
    "k2_contract_kpis",
    f"""SELECT *, {rd('AVG(churn_rate_pct) OVER ()')} AS company_avg_churn_rate_pct,
    {rd('churn_rate_pct - AVG(churn_rate_pct) OVER ()')} AS churn_rate_vs_company_avg,
    {pct('SUM(churned) OVER ()', 'SUM(customers) OVER ()')} AS overall_churn_rate_pct,
    {pct('total_revenue', 'SUM(total_revenue) OVER ()')} AS pct_of_total_revenue,
    RANK() OVER (ORDER BY churn_rate_pct DESC) AS churn_risk_rank FROM (
      SELECT contract_type, {N} AS customers, {CHURNED} AS churned, {RATE} AS churn_rate_pct,
      {avg('monthly_charges')} AS avg_monthly_charges, {dbl('SUM(total_charges)')} AS total_revenue
      FROM wide GROUP BY contract_type)""",
)
def _(w):
    return kpis.kpi_by_contract(w.star)


_COHORT_KPI = f"""SELECT tenure_cohort AS tenure_cohort_label, sort_order, {N} AS customers,
      {CHURNED} AS churned, {RATE} AS churn_rate_pct, SUM(total_charges) AS revenue
      FROM wide GROUP BY tenure_cohort, sort_order"""


@query(
    "k3_cohort_progression",
    f"""SELECT tenure_cohort_label, customers, churned, churn_rate_pct,
    {dbl('revenue')} AS total_revenue,
    LAG(churn_rate_pct) OVER (ORDER BY sort_order) AS prior_cohort_churn_rate,
    {rd('churn_rate_pct - LAG(churn_rate_pct) OVER (ORDER BY sort_order)')} AS churn_rate_change,
    {dbl('SUM(revenue) OVER (ORDER BY sort_order ROWS UNBOUNDED PRECEDING)')}
      AS cumulative_revenue_through_cohort FROM ({_COHORT_KPI})""",
)
def _(w):
    return kpis.kpi_cohort_progression(w.star)


def _top(n):
    return f"""SELECT customer_id, contract_type, cltv, {dbl('monthly_charges')} AS monthly_charges,
    tenure_months, churn_reason, r AS cltv_rank_within_contract FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY contract_type ORDER BY cltv DESC, customer_id) AS r
      FROM wide WHERE churn_flag = 1) WHERE r <= {n}"""


@query("k4_top_churned_by_value", _top(5))
def _(w):
    return kpis.top_churned_by_value(w.star)


@query("k4b_top3_churned_by_value", _top(3))
def _(w):
    return kpis.top_churned_by_value(w.star, 3)


RFM = """rfm AS (SELECT *, recency_quintile + frequency_quintile + monetary_quintile AS score FROM (
  SELECT *, NTILE(5) OVER (ORDER BY recency_tenure_months, customer_id) AS recency_quintile,
    NTILE(5) OVER (ORDER BY frequency_addon_breadth, customer_id) AS frequency_quintile,
    NTILE(5) OVER (ORDER BY monetary_total_charges, customer_id) AS monetary_quintile FROM wide))"""
SEGMENT = """CASE WHEN score >= 13 THEN 'Champion' WHEN score >= 10 THEN 'Loyal'
  WHEN score >= 7 THEN 'Steady' WHEN score >= 4 THEN 'At Risk' ELSE 'Critical / New' END"""


@query(
    "k5_rfm_scores",
    f"""SELECT customer_id, recency_quintile, frequency_quintile, monetary_quintile,
    score AS rfm_proxy_score, {big('churn_flag')} AS churn_flag, {SEGMENT} AS rfm_segment FROM rfm""",
    RFM,
)
def _(w):
    return kpis.rfm_scores(w.star)


@query(
    "k5b_rfm_distribution",
    f"SELECT score AS rfm_score, {N} AS customers, {RATE} AS churn_rate_pct FROM rfm GROUP BY score",
    RFM,
)
def _(w):
    return kpis.rfm_distribution(w.star)


def _cities(min_n, limit):
    return f"""SELECT * FROM (SELECT *, RANK() OVER (ORDER BY churn_rate_pct DESC) AS churn_rank FROM (
      SELECT city, {N} AS customers, {CHURNED} AS churned, {RATE} AS churn_rate_pct,
      {dbl('SUM(total_charges)')} AS total_revenue FROM wide GROUP BY city
      HAVING COUNT(*) >= {min_n})) ORDER BY churn_rank, city LIMIT {limit}"""


@query("k6_city_churn_rank", _cities(30, 15))
def _(w):
    return kpis.city_churn_rank(w.star)


@query("k6b_city_churn_rank_min60", _cities(60, 15))
def _(w):
    return kpis.city_churn_rank(w.star, min_n=60)


@query(
    "k7_payment_kpis",
    f"""SELECT *, {pct('total_revenue', 'SUM(total_revenue) OVER ()')} AS pct_of_total_revenue,
    RANK() OVER (ORDER BY churn_rate_pct DESC) AS churn_risk_rank FROM (
      SELECT payment_method, {N} AS customers, {CHURNED} AS churned, {RATE} AS churn_rate_pct,
      {avg('tenure_months')} AS avg_tenure_months, {dbl('SUM(total_charges)')} AS total_revenue
      FROM wide GROUP BY payment_method)""",
)
def _(w):
    return kpis.kpi_by_payment(w.star)


DECILES = """deciles AS (SELECT *, NTILE(10) OVER (ORDER BY churn_score, customer_id)
  AS churn_score_decile FROM wide)"""


@query(
    "k8_score_deciles",
    f"""SELECT churn_score_decile, {N} AS customers, {CHURNED} AS actual_churned,
    {RATE} AS actual_churn_rate_pct, {avg('churn_score', 1)} AS avg_churn_score,
    {avg('cltv')} AS avg_cltv, {dbl('SUM(monthly_charges)')} AS total_monthly_revenue
    FROM deciles GROUP BY churn_score_decile""",
    DECILES,
)
def _(w):
    return kpis.score_deciles(w.star)


@query(
    "k9_addon_funnel",
    f"""SELECT *, {big('SUM(customers) OVER (ORDER BY addon_service_count DESC ROWS UNBOUNDED PRECEDING)')}
      AS cumulative_customers_at_this_tier_or_above,
    LAG(churn_rate_pct) OVER (ORDER BY addon_service_count) AS prior_tier_churn_rate,
    {rd('churn_rate_pct - LAG(churn_rate_pct) OVER (ORDER BY addon_service_count)')} AS churn_rate_delta
    FROM (SELECT addon_service_count, {N} AS customers, {CHURNED} AS churned, {RATE} AS churn_rate_pct,
      {avg('monthly_charges')} AS avg_monthly_charges FROM wide GROUP BY addon_service_count)""",
)
def _(w):
    return kpis.addon_tier_funnel(w.star)


@query(
    "k10_reason_pareto",
    f"""SELECT *, CASE WHEN cumulative_pct_of_churn <= 80 THEN 'Core 80% driver' ELSE 'Long tail' END
      AS pareto_bucket FROM (SELECT *,
      {pct('churned_customers', 'SUM(churned_customers) OVER ()')} AS pct_of_churn,
      {pct('SUM(churned_customers) OVER (ORDER BY churned_customers DESC, churn_reason ROWS UNBOUNDED PRECEDING)', 'SUM(churned_customers) OVER ()')}
        AS cumulative_pct_of_churn
      FROM (SELECT churn_reason, {N} AS churned_customers, {dbl('SUM(monthly_charges)')}
        AS lost_monthly_revenue FROM wide WHERE churn_flag = 1 GROUP BY churn_reason))""",
)
def _(w):
    return kpis.reason_pareto(w.star)


@query(
    "k11_headline_kpis",
    f"""SELECT {N} AS total_customers, {CHURNED} AS churned_customers,
    {big('COUNT(*) - SUM(churn_flag)')} AS retained_customers, {RATE} AS churn_rate_pct,
    {dbl('SUM(total_charges)')} AS total_revenue, {dbl('SUM(monthly_charges)')} AS current_mrr,
    {dbl(LOST)} AS mrr_at_risk, {avg('cltv')} AS avg_cltv FROM wide""",
)
def _(w):
    return kpis.headline_kpis(w.wide)


HEALTH = f"""health AS (SELECT *, {rd('units / 720e0', 1)} AS customer_health_score,
  CASE WHEN units >= 50400 THEN 'Healthy' WHEN units >= 32400 THEN 'Watch' ELSE 'At Risk' END
    AS health_tier FROM (
  SELECT *, (100 - churn_score) * 288 + LEAST(18000, tenure_months * 250)
    + LEAST(14400, addon_service_count * 2400)
    + CASE contract_type WHEN 'Two year' THEN 100 WHEN 'One year' THEN 60 ELSE 20 END * 108 AS units
  FROM wide))"""
_HEALTH_COLS = f"""customer_id, contract_type, tenure_months, {dbl('monthly_charges')} AS monthly_charges,
  cltv, {big('churn_score')} AS churn_score, addon_service_count, {big('churn_flag')} AS churn_flag,
  customer_health_score, health_tier"""


@query("v1_customer_health", f"SELECT {_HEALTH_COLS} FROM health", HEALTH)
def _(w):
    return w.raw.sparkSession.table(rules.register_health_view(w.star))


@query(
    "v2_lowest_health",
    """SELECT customer_id, contract_type, tenure_months, cltv, customer_health_score FROM health
    ORDER BY customer_health_score, customer_id LIMIT 10""",
    HEALTH,
)
def _(w):
    return rules.lowest_health(w.star)


@query(
    "v3_health_tier_outcomes",
    f"""SELECT *, {pct('n_customers', 'SUM(n_customers) OVER ()')} AS pct_of_base FROM (
    SELECT health_tier, {N} AS n_customers, {RATE} AS churn_rate_pct, {avg('cltv')} AS avg_cltv
    FROM health GROUP BY health_tier)""",
    HEALTH,
)
def _(w):
    return rules.health_tier_outcomes(w.star)


@query(
    "v4_health_score_agreement",
    f"""SELECT health_tier, {avg('churn_score', 1)} AS avg_churn_score,
    (SELECT {rd('CORR(customer_health_score, 100 - churn_score)', 3)} FROM health) AS correlation
    FROM health GROUP BY health_tier""",
    HEALTH,
)
def _(w):
    return rules.health_score_agreement(w.star)


@query(
    "j1_star_join",
    f"""SELECT customer_id, contract_type, city, payment_method, tenure_cohort AS tenure_cohort_label,
    churn_reason, cltv, {big('churn_flag')} AS churn_flag FROM wide""",
)
def _(w):
    cols = ["customer_id", "contract_type", "city", "payment_method", "tenure_cohort_label"]
    cols.append("churn_reason")
    from retentia.operators.star import star_view

    return star_view(w.star, *cols).select(*cols, "cltv", "churn_flag")


@query(
    "j2_view_join",
    f"""SELECT customer_id, {big('churn_score')} AS churn_score, cltv, customer_health_score,
    health_tier FROM health""",
    HEALTH,
)
def _(w):
    return rules.join_health(w.star)


@query(
    "j3_above_average_at_risk",
    f"""SELECT {_HEALTH_COLS} FROM health WHERE health_tier = 'At Risk'
    AND cltv > (SELECT AVG(cltv) FROM health)""",
    HEALTH,
)
def _(w):
    return rules.above_average_at_risk(w.star)


_MV1 = f"""SELECT tenure_cohort AS tenure_cohort_label, sort_order, {N} AS customers,
  {CHURNED} AS churned, {RATE} AS churn_rate_pct, {avg('monthly_charges')} AS avg_monthly_charges,
  {dbl('SUM(total_charges)')} AS total_revenue, {avg('cltv')} AS avg_cltv
  FROM wide GROUP BY tenure_cohort, sort_order"""
_MV2 = f"""SELECT city, state, {N} AS customers, {CHURNED} AS churned, {RATE} AS churn_rate_pct,
  {dbl('SUM(total_charges)')} AS total_revenue, {avg('latitude', 6)} AS latitude,
  {avg('longitude', 6)} AS longitude FROM wide GROUP BY city, state"""


@query("mv1_tenure_cohort_rollup", _MV1)
def _(w):
    views = rollups.refresh_rollups(w.star, new_path(w.raw.sparkSession, "rollups"))
    return views["mv_tenure_cohort_rollup"]


@query("mv2_geography_rollup", _MV2)
def _(w):
    views = rollups.refresh_rollups(w.star, new_path(w.raw.sparkSession, "rollups"))
    return views["mv_geography_rollup"]


@query(
    "mv3_refresh_rollups",
    """SELECT 'mv_tenure_cohort_rollup' AS view, COUNT(DISTINCT tenure_cohort) AS row_count FROM wide
    UNION ALL SELECT 'mv_geography_rollup', COUNT(DISTINCT (city, state)) FROM wide""",
)
def _(w):
    views = rollups.refresh_rollups(w.star, new_path(w.raw.sparkSession, "rollups"))
    return rollups.rollup_counts(views)


def _call_list(extra):
    return f"""SELECT customer_id, contract_type, {big('churn_score')} AS churn_score, cltv,
    {dbl('monthly_charges')} AS monthly_charges, tenure_months, health_tier FROM health
    WHERE churn_flag = 0 {extra}"""


@query("fn1_high_risk_customers", _call_list("AND churn_score >= 70"), HEALTH)
def _(w):
    return rules.high_risk_customers(w.star)


@query(
    "fn1b_high_risk_month_to_month",
    _call_list("AND churn_score >= 40 AND contract_type = 'Month-to-month'"),
    HEALTH,
)
def _(w):
    return rules.high_risk_customers(w.star, 40, "Month-to-month")


@query(
    "fn2_update_churn_scores",
    f"""SELECT ROW_NUMBER() OVER (ORDER BY customer_id) AS customer_key,
    {big("CASE WHEN contract_type = 'One year' THEN 100 - churn_score ELSE churn_score END")}
      AS churn_score FROM wide""",
)
def _(w):
    new = w.wide.where(F.col("contract_type") == "One year").select(
        "customer_id", (100 - F.col("churn_score")).alias("churn_score")
    )
    return rules.update_churn_scores(w.star, new).select("customer_key", "churn_score")


_UPDATED = f"""SELECT ROW_NUMBER() OVER (ORDER BY customer_id) AS customer_key,
    {big("CASE WHEN contract_type = 'One year' THEN 100 - churn_score ELSE churn_score END")}
      AS churn_score FROM wide"""


@query("fn2b_stored_scores", _UPDATED)
def _(w):
    """The same update stored: files without a changed row enter the new version by reference."""
    spark, root = w.raw.sparkSession, new_path(w.raw.sparkSession, "stored-fact")
    upsert.create(w.star.fact_subscription, root, ["churn_flag"])
    new = w.wide.where(F.col("contract_type") == "One year").select(
        "customer_id", (100 - F.col("churn_score")).alias("churn_score"))
    rules.store_churn_scores(w.star, root, new)
    return upsert.read(spark, root).select("customer_key", "churn_score")


@query(
    "x12_precomputed_scores",
    f"""SELECT ROW_NUMBER() OVER (ORDER BY customer_id) AS customer_key, churn_score_decile,
    recency_quintile AS rfm_recency_quintile, frequency_quintile AS rfm_frequency_quintile,
    monetary_quintile AS rfm_monetary_quintile, score AS rfm_total_score, {SEGMENT} AS rfm_segment
    FROM rfm JOIN (SELECT customer_id AS dk, churn_score_decile FROM deciles) ON customer_id = dk""",
    RFM,
    DECILES,
)
def _(w):
    return kpis.with_precomputed_scores(w.star).select(
        "customer_key",
        "churn_score_decile",
        "rfm_recency_quintile",
        "rfm_frequency_quintile",
        "rfm_monetary_quintile",
        "rfm_total_score",
        "rfm_segment",
    )
