"""Measure, exploration and search queries."""

from pyspark.sql import functions as F

from checks.oracle import CHURNED, N, RATE, avg, big, dbl, mean, pct, rd
from checks.queries_kpi import DECILES, LOST, SEGMENT
from checks.registry import query
from retentia.operators import explore as E, measures as M, search as P, substring
from retentia.operators.kpis import rfm_scores
from retentia.operators.star import star_view
from retentia.schema import ADDONS, COHORTS, CONTRACTS
from retentia.sources.staging import new_path

_CHURN_RATIO = rd("CAST(SUM(churn_flag) AS DOUBLE) / COUNT(*)", 6)
_KEEP = rd("1 - CAST(SUM(churn_flag) AS DOUBLE) / COUNT(*)", 6)

# --- measures ------------------------------------------------------------------------------


@query(
    "x1_customer_measures",
    f"""SELECT contract_type, gender, COUNT(DISTINCT customer_id) AS total_customers,
    COUNT(DISTINCT CASE WHEN churn_flag = 1 THEN customer_id END) AS churned_customers,
    COUNT(DISTINCT CASE WHEN churn_flag = 0 THEN customer_id END) AS retained_customers,
    {_CHURN_RATIO} AS churn_rate, {_KEEP} AS retention_rate FROM wide GROUP BY contract_type, gender""",
)
def _(w):
    names = [
        "total_customers",
        "churned_customers",
        "retained_customers",
        "churn_rate",
        "retention_rate",
    ]
    view = star_view(w.star, "contract_type", "gender")
    return M.evaluate(view, names, ["contract_type", "gender"], distinct=True)


@query(
    "x2_value_measures",
    f"""SELECT payment_method, {dbl('SUM(total_charges)')} AS total_billed_revenue,
    {dbl('SUM(monthly_charges)')} AS current_mrr, {dbl(LOST)} AS mrr_at_risk,
    {avg('cltv', 6)} AS avg_cltv, {avg('tenure_months', 6)} AS avg_tenure_months,
    {avg('monthly_charges', 6)} AS avg_monthly_charges,
    {avg('addon_service_count', 6)} AS avg_addon_services FROM wide GROUP BY payment_method""",
)
def _(w):
    names = [
        "total_billed_revenue",
        "current_mrr",
        "mrr_at_risk",
        "avg_cltv",
        "avg_tenure_months",
        "avg_monthly_charges",
        "avg_addon_services",
    ]
    return M.evaluate(star_view(w.star, "payment_method"), names, ["payment_method"])


@query(
    "x3_ratio_measures",
    f"""SELECT contract_type, gender, {rd('CAST(SUM(total_charges) AS DOUBLE) / COUNT(*)', 6)}
      AS revenue_per_customer,
    {rd(f'CAST({LOST} AS DOUBLE) / CAST(SUM(monthly_charges) AS DOUBLE)', 6)} AS revenue_at_risk_pct,
    {avg('avg_revenue_per_tenure_month', 6)} AS avg_revenue_per_tenure_month,
    {rd('CAST(SUM(total_charges) AS DOUBLE) / ANY_VALUE(everything)', 6)} AS pct_of_total_revenue
    FROM (SELECT gender AS g, CAST(SUM(total_charges) AS DOUBLE) AS everything FROM wide
      WHERE senior_citizen = 'No' GROUP BY gender) JOIN wide ON g = gender
    WHERE contract_type IN ('One year', 'Two year') AND senior_citizen = 'No'
    GROUP BY contract_type, gender""",
)
def _(w):
    names = [
        "revenue_per_customer",
        "revenue_at_risk_pct",
        "avg_revenue_per_tenure_month",
        "pct_of_total_revenue",
    ]
    view = star_view(w.star, "contract_type", "gender", "senior_citizen")
    where = {"contract_type": ["One year", "Two year"], "senior_citizen": [False]}
    return M.evaluate(view, names, ["contract_type", "gender"], where)


@query(
    "x4_top_value_share",
    f"""SELECT {rd('CAST(SUM(CASE WHEN r <= cut THEN total_charges ELSE 0 END) AS DOUBLE) / CAST(SUM(total_charges) AS DOUBLE)', 6)}
      AS revenue_share, COUNT(*) FILTER (WHERE r <= cut) AS customers FROM (
      SELECT total_charges, RANK() OVER (ORDER BY cltv DESC) AS r,
        CEIL(COUNT(*) OVER () * 20 / 100) AS cut FROM wide)""",
)
def _(w):
    return M.top_share(w.star, 20)


_COHORT = """per AS (SELECT tenure_cohort AS tenure_cohort_label, sort_order, COUNT(*) AS n,
  SUM(churn_flag) AS c, SUM(total_charges) AS rev FROM wide GROUP BY tenure_cohort, sort_order)"""


@query(
    "x5_cohort_change",
    f"""SELECT *, {rd('churn_rate - prior_churn_rate', 6)} AS churn_rate_change FROM (
    SELECT a.tenure_cohort_label, a.sort_order, {rd('CAST(a.c AS DOUBLE) / a.n', 6)} AS churn_rate,
      {rd('CAST(b.c AS DOUBLE) / b.n', 6)} AS prior_churn_rate
    FROM per a LEFT JOIN per b ON b.sort_order = a.sort_order - 1)""",
    _COHORT,
)
def _(w):
    return M.cohort_change(w.star)


@query(
    "x6_cohort_cumulative",
    f"""SELECT tenure_cohort_label, sort_order,
    {dbl('SUM(rev) OVER (ORDER BY sort_order)')} AS cumulative_revenue,
    {big('SUM(n) OVER (ORDER BY sort_order)')} AS cumulative_customers FROM per""",
    _COHORT,
)
def _(w):
    return M.cohort_cumulative(w.star)


@query("x7_value_rank", "SELECT customer_id, cltv, RANK() OVER (ORDER BY cltv DESC) AS cltv_rank FROM wide")
def _(w):
    return M.value_rank(w.star)


@query(
    "x7b_value_rank_in_contract",
    """SELECT customer_id, contract_type, cltv,
    RANK() OVER (PARTITION BY contract_type ORDER BY cltv DESC) AS cltv_rank FROM wide""",
)
def _(w):
    return M.value_rank(w.star, "contract_type")


@query(
    "x7c_contract_risk_rank",
    f"""SELECT *, RANK() OVER (ORDER BY churn_rate DESC) AS churn_risk_rank FROM
    (SELECT contract_type, {_CHURN_RATIO} AS churn_rate FROM wide GROUP BY contract_type)""",
)
def _(w):
    return M.contract_risk_rank(w.star)


@query(
    "x8_rolling_cohort_rate",
    f"""SELECT a.tenure_cohort_label, a.sort_order,
    {rd('CAST(SUM(b.c) AS DOUBLE) / SUM(b.n)', 6)} AS rolling_churn_rate
    FROM per a JOIN per b ON b.sort_order BETWEEN a.sort_order - 2 AND a.sort_order
    GROUP BY a.tenure_cohort_label, a.sort_order""",
    _COHORT,
)
def _(w):
    return M.rolling_cohort_rate(w.star)


def _quintile(v):
    steps = " + ".join(
        f"CASE WHEN CAST({v} AS DOUBLE) >= (SELECT quantile_cont(CAST({v} AS DOUBLE), {p}) FROM wide)"
        " THEN 1 ELSE 0 END"
        for p in (0.2, 0.4, 0.6, 0.8)
    )
    return f"CAST(1 + {steps} AS BIGINT)"


@query(
    "x9_rfm_by_percentile",
    f"""SELECT customer_id, recency_quintile, frequency_quintile, monetary_quintile,
    score AS rfm_proxy_score, {SEGMENT} AS rfm_segment FROM (
      SELECT *, recency_quintile + frequency_quintile + monetary_quintile AS score FROM (
      SELECT customer_id, {_quintile('recency_tenure_months')} AS recency_quintile,
      {_quintile('frequency_addon_breadth')} AS frequency_quintile,
      {_quintile('monetary_total_charges')} AS monetary_quintile FROM wide))""",
)
def _(w):
    return M.rfm_by_percentile(w.star)


_PARTS = f"""SELECT *, CASE WHEN customer_health_score >= 70 THEN 'Healthy'
  WHEN customer_health_score >= 45 THEN 'Watch' ELSE 'At Risk' END AS health_tier FROM (
  SELECT contract_type, {rd(f"100 - {mean('churn_score')}", 6)} AS health_churn_risk_component,
  {rd(f"LEAST(100, {mean('tenure_months')} * 100 / 72)", 6)} AS health_tenure_component,
  {rd(f"LEAST(100, {mean('addon_service_count')} * 100 / 6)", 6)} AS health_addon_component,
  CAST(CASE contract_type WHEN 'Two year' THEN 100 WHEN 'One year' THEN 60 ELSE 20 END AS BIGINT)
    AS health_contract_component,
  {rd(f"0.40e0 * (100 - {mean('churn_score')}) + 0.25e0 * LEAST(100, {mean('tenure_months')} * 100 / 72) + 0.20e0 * LEAST(100, {mean('addon_service_count')} * 100 / 6) + 0.15e0 * CASE contract_type WHEN 'Two year' THEN 100 WHEN 'One year' THEN 60 ELSE 20 END", 6)}
    AS customer_health_score FROM wide GROUP BY contract_type)"""


@query("x10_aggregate_health", _PARTS)
def _(w):
    return M.aggregate_health(w.star)


@query(
    "x11_calibration_gap",
    f"""SELECT churn_score_decile, {avg('churn_score', 6)} AS avg_churn_score,
    {_CHURN_RATIO} AS churn_rate,
    {rd(f"ABS({mean('churn_score')} / 100 - CAST(SUM(churn_flag) AS DOUBLE) / COUNT(*))", 6)}
      AS calibration_gap FROM deciles GROUP BY churn_score_decile""",
    DECILES,
)
def _(w):
    return M.calibration_gap(w.star)


_SEG = " UNION ALL ".join(
    f"SELECT '{d}' AS segment_by, CAST({e} AS VARCHAR) AS segment, * FROM wide"
    for d, e in {
        "contract_type": "contract_type",
        "internet_service": "internet_service",
        "payment_method": "payment_method",
        "tenure_cohort_label": "tenure_cohort",
        "gender": "gender",
        "senior_citizen": "senior_citizen_bool",
    }.items()
)
_CP = "CASE WHEN MIN(contract_type) = MAX(contract_type) THEN CASE MIN(contract_type) WHEN 'Two year' THEN 100 WHEN 'One year' THEN 60 ELSE 20 END ELSE 20 END"


@query(
    "x13_segment_metrics",
    f"""SELECT segment_by, segment, {_CHURN_RATIO} AS churn_rate, {avg('cltv', 6)} AS avg_cltv,
    {dbl('SUM(total_charges)')} AS total_billed_revenue, {avg('tenure_months', 6)} AS avg_tenure_months,
    {rd(f"0.40e0 * (100 - {mean('churn_score')}) + 0.25e0 * LEAST(100, {mean('tenure_months')} * 100 / 72) + 0.20e0 * LEAST(100, {mean('addon_service_count')} * 100 / 6) + 0.15e0 * {_CP}", 6)}
      AS customer_health_score FROM seg GROUP BY segment_by, segment""",
    f"seg AS ({_SEG})",
)
def _(w):
    return M.segment_metrics(w.star)


def _pivot(values, col):
    return ", ".join(
        f"""{rd(f"100 * {mean(f"CASE WHEN {col} = '{v}' THEN churn_flag END")}")} AS "{v}" """
        for v in values
    )


@query(
    "x14_contract_cohort_matrix",
    f"SELECT contract_type, {_pivot(COHORTS, 'tenure_cohort')} FROM wide GROUP BY contract_type",
)
def _(w):
    return M.churn_matrix(w.star, "contract_type", "tenure_cohort_label", list(COHORTS))


@query(
    "x14b_internet_contract_matrix",
    f"SELECT internet_service, {_pivot(CONTRACTS, 'contract_type')} FROM wide GROUP BY internet_service",
)
def _(w):
    return M.churn_matrix(w.star, "internet_service", "contract_type", CONTRACTS)


@query(
    "x15_drill_through",
    f"""SELECT customer_id, cltv, {dbl('monthly_charges')} AS monthly_charges, tenure_months FROM wide
    WHERE contract_type = 'Month-to-month' AND tenure_cohort = '61-72 mo' AND gender = 'Male'""",
)
def _(w):
    cell = {"contract_type": "Month-to-month", "tenure_cohort_label": "61-72 mo", "gender": "Male"}
    rows = M.drill_through(w.star, cell)
    return rows.select("customer_id", "cltv", "monthly_charges", "tenure_months")


@query(
    "x16_formatted_cards",
    """SELECT contract_type, printf('%.1f%%', 100e0 * SUM(churn_flag) / COUNT(*)) AS churn_rate_formatted,
      '$' || format('{:,}', CAST(ROUND(CAST(SUM(total_charges) AS DOUBLE) / 1e6, 0) AS BIGINT)) || 'M'
        AS total_billed_revenue_formatted,
      '$' || format('{:,}', CAST(ROUND(SUM(CASE WHEN churn_flag = 1 THEN monthly_charges ELSE 0 END), 0)
        AS BIGINT)) AS mrr_at_risk_formatted,
      CASE WHEN 100e0 * SUM(churn_flag) / COUNT(*) >= 35 THEN '#D62728'
        WHEN 100e0 * SUM(churn_flag) / COUNT(*) >= 20 THEN '#FF7F0E' ELSE '#2CA02C' END
        AS churn_rate_kpi_color FROM wide GROUP BY contract_type""",
)
def _(w):
    names = [
        "churn_rate_formatted",
        "total_billed_revenue_formatted",
        "mrr_at_risk_formatted",
        "churn_rate_kpi_color",
    ]
    return M.evaluate(star_view(w.star, "contract_type"), names, ["contract_type"])


# --- exploration ---------------------------------------------------------------------------


@query(
    "e1_overview_metrics",
    f"""SELECT {N} AS total_customers, {CHURNED} AS churned_customers,
    {big('COUNT(*) - SUM(churn_flag)')} AS retained_customers, {RATE} AS overall_churn_rate_pct,
    {dbl('SUM(total_charges)')} AS total_billed_revenue,
    {dbl('SUM(monthly_charges)')} AS monthly_recurring_revenue,
    {avg('monthly_charges')} AS avg_monthly_charges, {avg('tenure_months')} AS avg_tenure_months,
    {rd('MEDIAN(tenure_months)')} AS median_tenure_months, {avg('cltv')} AS avg_cltv,
    {avg('CASE WHEN churn_flag = 1 THEN cltv END')} AS avg_cltv_churned,
    {avg('CASE WHEN churn_flag = 0 THEN cltv END')} AS avg_cltv_retained,
    {dbl(LOST)} AS revenue_at_risk_from_churned_monthly FROM wide""",
)
def _(w):
    return E.overview_metrics(w.wide)


_BREAKDOWN = f"""{N} AS customers, {CHURNED} AS churned, {avg('monthly_charges')} AS avg_monthly_charges,
  {avg('tenure_months')} AS avg_tenure, {avg('cltv')} AS avg_cltv,
  {dbl('SUM(total_charges)')} AS total_revenue, {RATE} AS churn_rate_pct"""


@query(
    "e2_churn_by_multiple_lines",
    f"SELECT multiple_lines, {_BREAKDOWN} FROM wide GROUP BY multiple_lines",
)
def _(w):
    return E.churn_by_categorical(w.wide, "multiple_lines")


@query(
    "e3_breakdowns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS dimension, {c} AS value, {_BREAKDOWN} FROM wide GROUP BY {c}"
        for c in E.BREAKDOWNS
    ),
)
def _(w):
    return E.breakdowns(w.wide)


def _top_cities(ranking, by):
    return f"""SELECT *, '{ranking}' AS ranking, ROW_NUMBER() OVER (ORDER BY {by} DESC, city) AS position
    FROM per QUALIFY position <= 10"""


@query(
    "e4_top_cities",
    f"{_top_cities('revenue', 'total_revenue')} UNION ALL {_top_cities('churn_rate', 'churn_rate_pct')}",
    f"""per AS (SELECT city, {N} AS customers, {CHURNED} AS churned,
    {dbl('SUM(total_charges)')} AS total_revenue, {RATE} AS churn_rate_pct FROM wide GROUP BY city
    HAVING COUNT(*) >= 5)""",
)
def _(w):
    return E.top_cities(w.wide)


@query(
    "e5_addon_analysis",
    f"""SELECT addon_service_count, {N} AS customers, {CHURNED} AS churned,
    {avg('monthly_charges')} AS avg_monthly_charges, {RATE} AS churn_rate_pct
    FROM wide GROUP BY addon_service_count""",
)
def _(w):
    return E.addon_analysis(w.wide)


@query(
    "e6_churn_reasons",
    f"""SELECT *, {pct('customers', 'SUM(customers) OVER ()')} AS pct_of_churn FROM (
    SELECT churn_reason, {N} AS customers, {avg('monthly_charges')} AS avg_monthly_charges,
    {avg('tenure_months')} AS avg_tenure, {dbl('SUM(monthly_charges)')} AS lost_monthly_revenue
    FROM wide WHERE churn_flag = 1 GROUP BY churn_reason)""",
)
def _(w):
    return E.churn_reason_breakdown(w.wide)


_EDGES = "[" + ", ".join(str(i / 10) for i in range(11)) + "]"


@query(
    "e7_score_bins",
    f"""SELECT churn_score_decile, {N} AS customers, {CHURNED} AS actual_churned,
    {avg('churn_score', 1)} AS avg_churn_score, {avg('cltv')} AS avg_cltv,
    {dbl('SUM(monthly_charges)')} AS total_monthly_revenue, {RATE} AS actual_churn_rate_pct FROM (
      SELECT *, GREATEST(1, (SELECT COUNT(*) FROM edges WHERE e < churn_score)) AS churn_score_decile
      FROM wide) GROUP BY churn_score_decile""",
    f"""edges AS (SELECT DISTINCT UNNEST(quantile_cont(CAST(churn_score AS DOUBLE), {_EDGES})) AS e
    FROM wide)""",
)
def _(w):
    return E.score_bins(w.wide)


@query(
    "e8_correlations",
    " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, {rd(f'CORR(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))', 3)} AS r"
        " FROM wide"
        for a in E.CORRELATED
        for b in E.CORRELATED
    ),
)
def _(w):
    return E.correlation_matrix(w.wide)


_FUNNEL = {
    "total_customers": "TRUE",
    "has_phone_service": "phone_service_bool",
    "has_internet_service": "has_internet",
    "has_phone_and_internet": "has_phone_and_internet",
    "has_1plus_addon_services": "addon_service_count >= 1",
    "has_3plus_addon_services": "addon_service_count >= 3",
    "full_addon_bundle_all6": "addon_service_count = 6",
}


@query(
    "e9_service_funnel",
    " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS step, '{s}' AS stage, COUNT(*) FILTER (WHERE {c}) AS customers,"
        f" {pct(f'COUNT(*) FILTER (WHERE {c})', 'COUNT(*)')} AS pct FROM wide"
        for i, (s, c) in enumerate(_FUNNEL.items())
    ),
)
def _(w):
    return E.service_funnel(w.wide)


@query(
    "e10_revenue_concentration",
    " UNION ALL ".join(
        f"""SELECT CAST({p} AS BIGINT) AS top_pct, COUNT(*) FILTER (WHERE r <= n * {p} // 100) AS row_count,
        {pct(f'CAST(SUM(CASE WHEN r <= n * {p} // 100 THEN total_charges ELSE 0 END) AS DOUBLE)', 'CAST(SUM(total_charges) AS DOUBLE)')}
          AS revenue_share_pct FROM (SELECT total_charges, COUNT(*) OVER () AS n,
          ROW_NUMBER() OVER (ORDER BY cltv DESC, customer_id) AS r FROM wide)"""
        for p in (10, 20, 50)
    ),
)
def _(w):
    return E.revenue_concentration(w.wide)


@query(
    "e11_revenue_curve",
    f"""SELECT customer_id, cltv,
    {rd('100 * CAST(SUM(total_charges) OVER (ORDER BY cltv DESC, customer_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(SUM(total_charges) OVER () AS DOUBLE)', 4)}
      AS cum_revenue_pct,
    {rd('100 * CAST(ROW_NUMBER() OVER (ORDER BY cltv DESC, customer_id) AS DOUBLE) / COUNT(*) OVER ()', 4)}
      AS cum_customer_pct FROM wide""",
)
def _(w):
    return E.revenue_curve(w.wide)


@query(
    "e14_status_split",
    """SELECT CASE WHEN churn_flag = 1 THEN 'Churned' ELSE 'Retained' END AS status, COUNT(*) AS count
    FROM wide GROUP BY churn_flag""",
)
def _(w):
    return E.status_split(w.wide)


@query(
    "e15_cohort_revenue",
    f"""SELECT tenure_cohort_label AS tenure_cohort, sort_order,
    {dbl('SUM(rev) OVER (ORDER BY sort_order)')} AS cumulative_revenue FROM per""",
    _COHORT,
)
def _(w):
    return E.cohort_revenue(w.wide)


@query(
    "e16_internet_contract_matrix",
    f"""SELECT internet_service, {_pivot(CONTRACTS, 'contract_type')},
    CAST(CASE internet_service WHEN 'Fiber optic' THEN 1 WHEN 'DSL' THEN 2 ELSE 3 END AS BIGINT) AS row_order
    FROM wide GROUP BY internet_service""",
)
def _(w):
    return E.internet_contract_matrix(w.wide)


@query(
    "e17_plan_combinations",
    f"""SELECT contract_type, internet_service, payment_method, {N} AS customers, {RATE} AS churn_rate,
    {avg('monthly_charges')} AS avg_monthly FROM wide
    GROUP BY contract_type, internet_service, payment_method HAVING COUNT(*) >= 20""",
)
def _(w):
    return E.plan_combinations(w.wide)


@query(
    "e18_addon_adoption",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS service, COUNT(*) AS eligible,
        {pct(f"COUNT(*) FILTER (WHERE {c} = 'Yes')", 'COUNT(*)')} AS adoption_rate_pct FROM wide
        WHERE {c} <> 'No internet service'"""
        for c in ADDONS
    ),
)
def _(w):
    return E.addon_adoption(w.wide)


_CITY = f"""city_stats AS (SELECT city, {N} AS customers, {CHURNED} AS churned,
  {dbl('SUM(total_charges)')} AS total_revenue, {avg('cltv')} AS avg_cltv,
  {avg('latitude', 6)} AS latitude, {avg('longitude', 6)} AS longitude, {RATE} AS churn_rate_pct
  FROM wide GROUP BY city)"""


@query("e19_city_stats", "SELECT * FROM city_stats", _CITY)
def _(w):
    return E.city_stats(w.wide)


@query(
    "e20_top_reasons",
    f"""SELECT *, {pct('customers', 'SUM(customers) OVER ()')} AS share_pct FROM (
    SELECT churn_reason, {N} AS customers FROM wide WHERE churn_flag = 1 GROUP BY churn_reason)
    ORDER BY customers DESC, churn_reason LIMIT 8""",
)
def _(w):
    return E.top_reasons(w.wide)


@query(
    "e20b_reason_groups",
    " UNION ALL ".join(
        f"""SELECT '{g}' AS reason_group,
        {pct(f"COUNT(*) FILTER (WHERE regexp_matches(churn_reason, '{p}', 'i'))", 'COUNT(*)')} AS share_pct
        FROM wide WHERE churn_flag = 1"""
        for g, p in (("competitor", "competitor"), ("service", "attitude|support|network|speed"))
    ),
)
def _(w):
    return E.reason_groups(w.wide)


_GROUPED = """grouped AS (SELECT *, CASE WHEN payment_method ILIKE '%automatic%' THEN 'Automatic'
  ELSE payment_method END AS payment_group FROM wide)"""


@query(
    "e21_risk_profile",
    " UNION ALL ".join(
        f"""SELECT *, {rd('high_risk_rate - low_risk_rate')} AS risk_gap_pct_points FROM (
        SELECT '{f}' AS factor, '{hi}' AS high_risk_group,
        {rd(f"100 * {mean(f"CASE WHEN {c} = '{hi}' THEN churn_flag END")}")} AS high_risk_rate,
        '{lo}' AS low_risk_group,
        {rd(f"100 * {mean(f"CASE WHEN {c} = '{lo}' THEN churn_flag END")}")} AS low_risk_rate FROM grouped)"""
        for f, c, hi, lo in E.RISK_FACTORS
    ),
    _GROUPED,
)
def _(w):
    return E.risk_profile(w.wide)


_BOX = ["tenure_months", "monthly_charges", "cltv"]


@query(
    "e22_five_numbers",
    " UNION ALL ".join(
        f"""SELECT {big('churn_flag')} AS churn_flag, '{c}' AS variable, COUNT(*) AS n,
        """
        + ", ".join(
            f"{rd(f'quantile_cont(CAST({c} AS DOUBLE), {p})')} AS {x}"
            for p, x in (
                (0.0, "minimum"),
                (0.25, "q1"),
                (0.5, "median"),
                (0.75, "q3"),
                (1.0, "maximum"),
            )
        )
        + " FROM wide GROUP BY churn_flag"
        for c in _BOX
    ),
)
def _(w):
    return E.five_numbers(w.wide, _BOX)


# --- search --------------------------------------------------------------------------------

_RESULT = f"""customer_id, contract_type, internet_service, payment_method, tenure_months,
  {dbl('monthly_charges')} AS monthly_charges, {dbl('total_charges')} AS total_charges, cltv,
  {big('churn_score')} AS churn_score, churn_label"""


@query(
    "f1_search_subscribers",
    f"""SELECT {_RESULT} FROM wide WHERE customer_id ILIKE '%r#0000%7%' AND churn_flag = 0
    AND contract_type IN ('Month-to-month', 'Two year') AND internet_service IN ('DSL', 'No')
    AND tenure_months BETWEEN 10 AND 70 AND customer_id LIKE '%7%'""",
)
def _(w):
    found = P.search_subscribers(
        w.wide,
        term="R#0000",
        status="retained",
        contracts=["Month-to-month", "Two year"],
        internet=["DSL", "No"],
        tenure=(10, 70),
    )
    return P.search_subscribers(found, term="7").select(*P.RESULT_COLUMNS)


def _index(df, column):
    root = new_path(df.sparkSession, f"trigrams-{column}")
    substring.build(df, column, root)
    return substring.Index(df.sparkSession, root)


@query(
    "f1c_search_by_index",
    f"""SELECT {_RESULT} FROM wide WHERE customer_id ILIKE '%r#00000%37%' AND customer_id ILIKE '%37%'
    AND contract_type IN ('Month-to-month', 'Two year') AND tenure_months BETWEEN 10 AND 70""",
)
def _(w):
    ids = _index(w.wide, "customer_id")
    found = P.search_subscribers(
        w.wide, term="R#00000", contracts=["Month-to-month", "Two year"], tenure=(10, 70), index=ids)
    return P.search_subscribers(found, term="37", index=ids).select(*P.RESULT_COLUMNS)


@query("f2_page", f"SELECT {_RESULT} FROM wide ORDER BY customer_id LIMIT 15 OFFSET 30")
def _(w):
    return P.page(w.wide, number=3)


@query("f2b_page_after", f"""SELECT {_RESULT} FROM wide WHERE customer_id > 'Customer#000000042'
    ORDER BY customer_id LIMIT 15""")
def _(w):
    return P.page_after(w.wide, "Customer#000000042")


_METRICS = ["tenure_months", "monthly_charges", "cltv", "addon_service_count"]


@query(
    "f3_versus_average",
    " UNION ALL ".join(
        f"""SELECT customer_id, '{c}' AS metric, CAST({c} AS DOUBLE) AS customer_value,
        (SELECT {avg(c)} FROM wide) AS average_value FROM wide
        WHERE customer_id IN ('Customer#000000001', 'Customer#000000010', 'Customer#000000042')"""
        for c in _METRICS
    ),
)
def _(w):
    return P.versus_average(
        w.wide, ["Customer#000000001", "Customer#000000010", "Customer#000000042"]
    )


@query(
    "f4_search_cities",
    """SELECT city, customers, churn_rate_pct, total_revenue, avg_cltv FROM city_stats
    WHERE customers >= 30 AND churn_rate_pct BETWEEN 20 AND 45 AND city ILIKE '%nation_1%'""",
    _CITY,
)
def _(w):
    return P.search_cities(w.wide, rate=(20.0, 45.0), term="nation_1")


@query(
    "f4b_cities_by_index",
    """SELECT city, customers, churn_rate_pct, total_revenue, avg_cltv FROM city_stats
    WHERE customers >= 5 AND city ILIKE '%tion_1%'""",
    _CITY,
)
def _(w):
    return P.search_cities(w.wide, min_n=5, term="TION_1", index=_index(w.wide, "city"))


@query(
    "f5_search_plans",
    f"""SELECT {N} AS customers, {RATE} AS churn_rate_pct, {avg('monthly_charges')} AS avg_monthly_charges
    FROM wide WHERE contract_type IN ('Month-to-month', 'One year') AND internet_service IN ('DSL')
    AND online_security = 'Yes' AND streaming_tv = 'No'""",
)
def _(w):
    return P.search_plans(
        w.wide,
        contracts=["Month-to-month", "One year"],
        internet=["DSL"],
        addons={"online_security": "Yes", "streaming_tv": "No"},
    )


_SEGMENTED = f"""segmented AS (SELECT *, {SEGMENT} AS segment FROM rfm)"""


@query(
    "f6_segment_profile",
    f"""SELECT segment, {N} AS customers, {avg('tenure_months')} AS avg_tenure, {avg('cltv')} AS avg_cltv,
    {RATE} AS churn_rate FROM segmented GROUP BY segment""",
    """rfm AS (SELECT *, recency_quintile + frequency_quintile + monetary_quintile AS score FROM (
  SELECT *, NTILE(5) OVER (ORDER BY recency_tenure_months, customer_id) AS recency_quintile,
    NTILE(5) OVER (ORDER BY frequency_addon_breadth, customer_id) AS frequency_quintile,
    NTILE(5) OVER (ORDER BY monetary_total_charges, customer_id) AS monetary_quintile FROM wide))""",
    _SEGMENTED,
)
def _(w):
    segments = rfm_scores(w.star).select("customer_id", F.col("rfm_segment").alias("segment"))
    return P.segment_profile(w.wide.join(segments, "customer_id"))


@query(
    "f6b_segment_members",
    f"""SELECT customer_id, contract_type, tenure_months, {dbl('monthly_charges')} AS monthly_charges,
    cltv, {big('churn_score')} AS churn_score, churn_label FROM wide WHERE payment_method = 'Mailed check'""",
)
def _(w):
    return P.segment_members(w.wide, "Mailed check", "payment_method")


@query(
    "f7_restrict",
    f"""SELECT {_RESULT} FROM wide WHERE contract_type IN ('One year') AND internet_service IN ('No', 'DSL')""",
)
def _(w):
    return P.restrict(w.wide, ["One year"], ["No", "DSL"]).select(*P.RESULT_COLUMNS)


def _bin(v):
    r = f"(ROW_NUMBER() OVER (ORDER BY {v}, customer_id) - 1)"
    return f"CAST(GREATEST(1, CEIL(CAST({r} * 5 AS DOUBLE) / (COUNT(*) OVER () - 1))) AS BIGINT)"


@query(
    "f8_rfm_by_rank",
    f"""SELECT customer_id, recency_quintile, frequency_quintile, monetary_quintile, score AS rfm_score,
    {SEGMENT} AS segment FROM (SELECT *, recency_quintile + frequency_quintile + monetary_quintile AS score
    FROM (SELECT customer_id, {_bin('recency_tenure_months')} AS recency_quintile,
      {_bin('frequency_addon_breadth')} AS frequency_quintile,
      {_bin('monetary_total_charges')} AS monetary_quintile FROM wide))""",
)
def _(w):
    base = w.wide.select(
        "customer_id",
        "recency_tenure_months",
        "frequency_addon_breadth",
        "monetary_total_charges",
    )
    return P.rfm_by_rank(base).select(
        "customer_id",
        "recency_quintile",
        "frequency_quintile",
        "monetary_quintile",
        "rfm_score",
        "segment",
    )
