"""Hypothesis tests, regressions, what-if tables and report jobs."""

from pyspark.sql import functions as F

from checks.oracle import N, RATE, big, mean, rd, rd_even
from checks.registry import query
from retentia.functions.columns import Z95
from retentia.operators import hypothesis as H, regress as R, scenarios as B
from retentia.plans import reports
from retentia.schema import CATEGORICAL_VARS, NUMERIC_VARS
from retentia.sources.staging import new_path

_TALL = " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {c} AS level, churn_label FROM wide" for c in CATEGORICAL_VARS
)
CHI = f"""cells AS (SELECT variable, level, l.label, COUNT(*) FILTER (WHERE churn_label = l.label) AS o
    FROM ({_TALL}) t, (VALUES ('Yes'), ('No')) l(label) GROUP BY variable, level, l.label),
  marg AS (SELECT *, SUM(o) OVER (PARTITION BY variable, level) AS rt,
    SUM(o) OVER (PARTITION BY variable, label) AS ct, SUM(o) OVER (PARTITION BY variable) AS n FROM cells),
  expd AS (SELECT *, CAST(rt AS DOUBLE) * CAST(ct AS DOUBLE) / CAST(n AS DOUBLE) AS e FROM marg),
  dofs AS (SELECT variable AS dv, COUNT(DISTINCT level) - 1 AS dof FROM cells GROUP BY variable),
  chi AS (SELECT variable, dof, ANY_VALUE(n) AS n,
    SUM(POWER(ABS(o - e) - CASE WHEN dof = 1 THEN LEAST(0.5, ABS(o - e)) ELSE 0 END, 2) / e) AS chi2
    FROM expd JOIN dofs ON variable = dv GROUP BY variable, dof),
  chiv AS (SELECT *, SQRT(chi2 / CAST(n AS DOUBLE) / LEAST(dof, 1)) AS v FROM chi)"""


def _effect(x, a, b, c):
    return (
        f"CASE WHEN {x} < {a} THEN 'negligible' WHEN {x} < {b} THEN 'small'"
        f" WHEN {x} < {c} THEN 'medium' ELSE 'large' END"
    )


@query("t1_chi_square", f"SELECT variable, {rd('chi2', 3)} AS chi2, {big('dof')} AS dof FROM chiv", CHI)
def _(w):
    stats = H.chi_square_stats(w.wide)
    return stats.select("variable", H.rounded(F.col("chi2"), 3).alias("chi2"), "dof")


@query("t3_cramers_v", f"SELECT variable, {rd('v', 4)} AS cramers_v FROM chiv", CHI)
def _(w):
    stats = H.chi_square_stats(w.wide)
    return stats.select("variable", H.rounded(F.col("cramers_v"), 4).alias("cramers_v"))


@query(
    "t6_chi_square_effects",
    f"""SELECT variable, {rd('chi2')} AS chi2, {big('dof')} AS dof, {rd('v', 4)} AS cramers_v,
    {_effect('v', 0.1, 0.2, 0.4)} AS effect_size FROM chiv""",
    CHI,
)
def _(w):
    return H.chi_square_effects(w.wide)


WELCH = "mom AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS variable,
    {mean(f'CASE WHEN churn_flag = 1 THEN {c} END')} AS ma,
    {mean(f'CASE WHEN churn_flag = 0 THEN {c} END')} AS mb,
    VAR_SAMP(CASE WHEN churn_flag = 1 THEN CAST({c} AS DOUBLE) END) AS va,
    VAR_SAMP(CASE WHEN churn_flag = 0 THEN CAST({c} AS DOUBLE) END) AS vb,
    CAST(COUNT(CASE WHEN churn_flag = 1 THEN {c} END) AS DOUBLE) AS na,
    CAST(COUNT(CASE WHEN churn_flag = 0 THEN {c} END) AS DOUBLE) AS nb FROM wide"""
    for c in NUMERIC_VARS
) + """), tst AS (SELECT *, ma - mb AS diff, SQRT(va / na + vb / nb) AS se,
  (ma - mb) / SQRT(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS d FROM mom)"""


@query(
    "t2_welch_t",
    f"""SELECT variable, {rd('ma')} AS mean_churned, {rd('mb')} AS mean_retained,
    {rd('diff / se', 3)} AS t_stat,
    {rd('POWER(va / na + vb / nb, 2) / (POWER(va / na, 2) / (na - 1) + POWER(vb / nb, 2) / (nb - 1))', 2)}
      AS dof FROM tst""",
    WELCH,
)
def _(w):
    return H.two_group_stats(w.wide).select(
        "variable",
        H.rounded(F.col("m_a"), 2).alias("mean_churned"),
        H.rounded(F.col("m_b"), 2).alias("mean_retained"),
        H.rounded(F.col("t_stat"), 3).alias("t_stat"),
        H.rounded(F.col("dof"), 2).alias("dof"),
    )


@query("t4_cohens_d", f"SELECT variable, {rd('d', 3)} AS cohens_d FROM tst", WELCH)
def _(w):
    return H.two_group_stats(w.wide).select(
        "variable", H.rounded(F.col("cohens_d"), 3).alias("cohens_d")
    )


@query(
    "t7_ttest_effects",
    f"""SELECT variable, {rd('ma')} AS mean_churned, {rd('mb')} AS mean_retained,
    {rd('diff')} AS mean_difference, {rd('diff - 1.96e0 * se')} AS ci_low,
    {rd('diff + 1.96e0 * se')} AS ci_high, {rd('diff / se', 3)} AS t_stat, {rd('d', 3)} AS cohens_d,
    {_effect('ABS(d)', 0.2, 0.5, 0.8)} AS effect_size FROM tst""",
    WELCH,
)
def _(w):
    return H.ttest_effects(w.wide)


_P = "(CAST(SUM(churn_flag) AS DOUBLE) / COUNT(*))"
_Z2 = f"{Z95 * Z95!r}::DOUBLE"
_SCALE = f"(1 + {_Z2} / COUNT(*))"
_CENTRE = f"(({_P} + {_Z2} / (2 * COUNT(*))) / {_SCALE})"
_SPREAD = (
    f"({Z95!r}::DOUBLE * SQRT({_P} * (1 - {_P}) / COUNT(*) + {_Z2} / (4e0 * COUNT(*) * COUNT(*)))"
    f" / {_SCALE})"
)
LOW, HIGH = rd(f"{_CENTRE} - {_SPREAD}", 4), rd(f"{_CENTRE} + {_SPREAD}", 4)


@query(
    "t5_wilson_overall",
    f"""SELECT {N} AS n, {RATE} AS churn_rate_pct, {LOW} AS wilson_low, {HIGH} AS wilson_high FROM wide""",
)
def _(w):
    return H.overall_rate_interval(w.wide)


@query(
    "t9_wilson_by_group",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS group_variable, {c} AS level, {N} AS n, {RATE} AS churn_rate_pct,
        {rd(f'100 * {LOW}')} AS wilson_low_pct, {rd(f'100 * {HIGH}')} AS wilson_high_pct
        FROM wide GROUP BY {c}"""
        for c in ("contract_type", "internet_service")
    ),
)
def _(w):
    return H.rate_interval_by_group(w.wide)


def _anova(g, v, digits=4):
    return f"""SELECT '{g}' AS group_variable, '{v}' AS value_variable,
    {rd('(SUM(n * (m - gm) * (m - gm)) / (COUNT(*) - 1)) / (SUM(n * vp) / (SUM(n) - COUNT(*)))')} AS f_stat,
    {rd('SUM(n * (m - gm) * (m - gm)) / (SUM(n * (m - gm) * (m - gm)) + SUM(n * vp))', digits)} AS eta_squared
    FROM (SELECT COUNT(*) AS n, AVG(CAST({v} AS DOUBLE)) AS m, VAR_POP(CAST({v} AS DOUBLE)) AS vp,
      (SELECT AVG(CAST({v} AS DOUBLE)) FROM wide) AS gm FROM wide GROUP BY {g})"""


@query("t8_anova", " UNION ALL ".join(_anova(g, v) for g, v in H.ANOVAS))
def _(w):
    return H.anova_effects(w.wide)


@query(
    "t10b_test_statistics",
    f"""SELECT 'chi2' AS family, variable, {rd('chi2', 2)} AS statistic, {rd('v', 3)} AS effect FROM chiv
    UNION ALL SELECT 't', variable, {rd('diff / se', 2)}, {rd('d', 3)} FROM tst
    UNION ALL SELECT 'F', value_variable || ' by ' || group_variable, f_stat, eta_squared
    FROM ({" UNION ALL ".join(_anova(g, v, 3) for g, v in H.ANOVAS)})""",
    CHI,
    WELCH,
)
def _(w):
    """The suite without its p-values, which SQL has no function for."""
    cols = [
        H.rounded(F.col(c), n).cast("double").alias(c) for c, n in (("statistic", 2), ("effect", 3))
    ]
    return H.suite_rows(w.wide).select("family", "variable", *cols)


@query("t10_test_suite")
def _(w):
    return H.suite_rows(w.wide)


@query(
    "e13_ranked_effects",
    f"""SELECT 'categorical' AS kind, variable, {rd('v', 4)} AS effect FROM chiv
    UNION ALL SELECT 'numeric_pct_difference', variable, {rd('100 * diff / mb', 1)} FROM tst""",
    CHI,
    WELCH,
)
def _(w):
    return H.ranked_effects(w.wide)


_COV = """m AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n, AVG(x1) AS m1, AVG(x2) AS m2, AVG(y) AS my,
    VAR_POP(x1) * COUNT(*) AS s11, VAR_POP(x2) * COUNT(*) AS s22, COVAR_POP(x1, x2) * COUNT(*) AS s12,
    COVAR_POP(x1, y) * COUNT(*) AS s1y, COVAR_POP(x2, y) * COUNT(*) AS s2y, VAR_POP(y) * COUNT(*) AS syy
    FROM (SELECT CAST(tenure_months AS DOUBLE) AS x1, CAST(monthly_charges AS DOUBLE) AS x2,
      CAST(total_charges AS DOUBLE) AS y FROM wide)),
  b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1,
    (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM m),
  f AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, 1 - (syy - b1 * s1y - b2 * s2y) / syy AS r2,
    (syy - b1 * s1y - b2 * s2y) / (n - 3) AS s2 FROM b)"""


def _term(name, coef, var):
    t = f"({coef}) / SQRT({var})"
    return f"""SELECT '{name}' AS feature, {rd(coef, 2)} AS coefficient, {rd(f'SQRT({var})', 2)} AS std_error,
    {rd(t, 2)} AS t_stat, {rd('r2', 4)} AS r_squared,
    {rd('1 - (1 - r2) * (n - 1) / (n - 3)', 4)} AS adj_r_squared, {big('n')} AS n_obs FROM f"""


_DET = "(s11 * s22 - s12 * s12)"


@query(
    "t11_ols",
    " UNION ALL ".join(
        [
            _term(
                "Intercept",
                "b0",
                f"s2 * (1 / n + (m1 * m1 * s22 + m2 * m2 * s11 - 2 * m1 * m2 * s12) / {_DET})",
            ),
            _term("tenure_months", "b1", f"s2 * s22 / {_DET}"),
            _term("monthly_charges", "b2", f"s2 * s11 / {_DET}"),
        ]
    ),
    _COV,
)
def _(w):
    table = R.ols_regression(w.wide, R.OLS_FEATURES, "total_charges")
    two = [H.rounded(F.col(c), 2).alias(c) for c in ("coefficient", "std_error", "t_stat")]
    four = [H.rounded(F.col(c), 4).alias(c) for c in ("r_squared", "adj_r_squared")]
    return table.select("feature", *two, *four, "n_obs")


@query("t12_logistic")
def _(w):
    return R.logistic_regression(R.add_contract_dummies(w.wide), R.LOGIT_FEATURES)


@query(
    "t12b_logit_optimum",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS model, {big(k)} AS coefficients, COUNT(*) AS n_obs, TRUE AS stationary,
        TRUE AS errors_agree FROM wide"""
        for name, k in (("standardized", len(R.LOGIT_FEATURES) + 1), ("raw_units", len(R.LOGIT_BUSINESS) + 1))
    ),
)
def _(w):
    """The slope of the likelihood vanishes at both fits, and their errors are those of its curvature."""
    df, parts = R.add_contract_dummies(w.wide), []
    for name, features, scaled in (
        ("standardized", R.LOGIT_FEATURES, True), ("raw_units", R.LOGIT_BUSINESS, False)
    ):
        table = R.logistic_optimum(df, features, standardize=scaled)
        off = F.abs(F.col("std_error") / F.col("std_error_fisher") - 1)
        parts.append(table.agg(
            F.lit(name).alias("model"), F.count("*").alias("coefficients"),
            F.max("n_obs").alias("n_obs"),
            F.every(F.abs(F.col("mean_gradient")) < 1e-4).alias("stationary"),
            F.every(off < 1e-3).alias("errors_agree")))
    return parts[0].unionByName(parts[1])


@query("t13_logistic_raw_units")
def _(w):
    df = R.add_contract_dummies(w.wide)
    return R.logistic_regression(df, R.LOGIT_BUSINESS, standardize=False)


@query("t14_regression_suite")
def _(w):
    return R.suite_coefficients(w.wide)


@query(
    "t15_ols_agreement",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS feature, {rd(b, 4)} AS coefficient, {rd(b, 4)} AS other,
        0e0 AS relative_difference FROM f"""
        for name, b in (("Intercept", "b0"), ("tenure_months", "b1"), ("monthly_charges", "b2"))
    ),
    _COV,
)
def _(w):
    table = R.ols_agreement(w.wide, R.OLS_FEATURES, "total_charges")
    cols = ("coefficient", "other", "relative_difference")
    return table.select(
        "feature", *[H.rounded(F.col(c), 4).cast("double").alias(c) for c in cols])


@query(
    "t16_residual_histogram",
    f"""SELECT bin, COUNT(*) AS rows, {rd('MIN(e)', 1)} AS smallest, {rd('MAX(e)', 1)} AS largest FROM (
    SELECT e, {big('LEAST(40, FLOOR((e - lo) / ((hi - lo) / 40)) + 1)')} AS bin FROM (
    SELECT e, MIN(e) OVER () AS lo, MAX(e) OVER () AS hi FROM (
    SELECT CAST(total_charges AS DOUBLE) - b0 - b1 * CAST(tenure_months AS DOUBLE)
      - b2 * CAST(monthly_charges AS DOUBLE) AS e FROM wide, f))) GROUP BY bin""",
    _COV,
)
def _(w):
    bins = R.residual_histogram(w.wide, R.OLS_FEATURES, "total_charges")
    ends = [H.rounded(F.col(c), 1).alias(c) for c in ("smallest", "largest")]
    return bins.select("bin", "rows", *ends)


def _scenario(source, target, percents, extra=False):
    moved = "(n * p // 100)"
    gain = f"{moved} * (ct - cf)" if extra else f"{moved} * (rf - rt) * cf"
    return f"""SELECT {big('p')} AS rate_pct, n AS group_customers, {rd('100 * rf')} AS from_churn_rate_pct,
    {rd('100 * rt')} AS to_churn_rate_pct, {big(moved)} AS customers_moved,
    {rd_even(f'{moved} * (rf - rt)', 0)} AS est_fewer_churns_per_year, {rd_even(gain, 2)} AS est_mrr FROM (
      SELECT COUNT(*) FILTER (WHERE {source}) AS n,
      {mean(f'CASE WHEN {source} THEN churn_flag END')} AS rf,
      {mean(f'CASE WHEN {target} THEN churn_flag END')} AS rt,
      {mean(f'CASE WHEN {source} THEN monthly_charges END')} AS cf,
      {mean(f'CASE WHEN {target} THEN monthly_charges END')} AS ct FROM wide),
    (VALUES {', '.join(f'({p})' for p in percents)}) v(p)"""


_B1 = _scenario("contract_type = 'Month-to-month'", "contract_type = 'One year'", (10, 20, 30))
_B2 = _scenario(
    "payment_method = 'Electronic check'", "payment_method LIKE '%(automatic)'", (20, 30, 50)
)
_B3 = _scenario("addon_service_count IN (1, 2)", "addon_service_count >= 3", (10, 20, 30), True)


@query("b1_contract_migration", _B1)
def _(w):
    return B.contract_migration(w.wide)


@query("b2_payment_migration", _B2)
def _(w):
    return B.payment_migration(w.wide)


@query("b3_addon_upgrade", _B3)
def _(w):
    return B.addon_upgrade(w.wide)


@query(
    "b4_all_scenarios",
    " UNION ALL ".join(
        f"SELECT '{name}' AS scenario, * FROM ({sql})"
        for name, sql in (
            ("contract_migration", _B1),
            ("payment_method_migration", _B2),
            ("addon_bundle_upgrade", _B3),
        )
    ),
)
def _(w):
    return B.all_scenarios(w.wide)


@query("e12_full_eda")
def _(w):
    return reports.write_eda_report(w.wide, new_path(w.raw.sparkSession, "eda"))
