"""Hypothesis tests with effect sizes. Each family of tests is one aggregate over the table.

Statistics and effect sizes are columns; p-values are appended to the finished report.
"""

from pyspark.sql import functions as F

from retentia.functions.columns import mean_where, pct, rounded, wilson_bounds
from retentia.functions.tails import chi2_tail, f_tail, t_two_sided, with_p_values
from retentia.operators.explore import tall
from retentia.schema import CATEGORICAL_VARS, NUMERIC_VARS


def _label(value, cuts):
    """negligible / small / medium / large by three rising cuts."""
    small, medium, large = cuts
    return (
        F.when(value < small, F.lit("negligible"))
        .when(value < medium, F.lit("small"))
        .when(value < large, F.lit("medium"))
        .when(value.isNotNull(), F.lit("large"))
    )


def chi_square_stats(df, cols=CATEGORICAL_VARS, label="churn_label", positive="Yes"):
    """Independence of each column from the label: n, chi2, dof, Cramer's V (unrounded).

    The 2x2 table gets the continuity correction. Level counts are aggregated once; totals come
    back through a join on the variable's name, so a column of many levels stays distributed.
    """
    levels = (
        tall(df, cols, [label], "variable", "level")
        .where(F.col("level").isNotNull() & F.col(label).isNotNull())
        .groupBy("variable", "level")
        .agg(
            F.count_if(F.col(label) == positive).alias("pos"),
            F.count_if(F.col(label) != positive).alias("neg"),
        )
    )
    totals = levels.groupBy("variable").agg(
        F.sum("pos").alias("all_pos"),
        F.sum("neg").alias("all_neg"),
        F.count(F.lit(1)).alias("r"),
    )
    n = (F.col("all_pos") + F.col("all_neg")).cast("double")
    outcomes = (F.col("all_pos") > 0).cast("long") + (F.col("all_neg") > 0).cast("long")
    joined = levels.join(totals, "variable").withColumns(
        {"n": n, "k": outcomes, "dof": (F.col("r") - 1) * (outcomes - 1)}
    )

    def cell(observed, column_total):
        expected = (F.col("pos") + F.col("neg")) * F.col(column_total) / F.col("n")
        gap = F.abs(F.col(observed) - expected)
        gap = F.when(F.col("dof") == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        return F.coalesce(F.try_divide(gap * gap, expected), F.lit(0.0))

    out = joined.groupBy("variable").agg(
        F.first("n").cast("long").alias("n"),
        F.sum(cell("pos", "all_pos") + cell("neg", "all_neg")).alias("chi2"),
        F.first("dof").alias("dof"),
        F.least(F.first("r") - 1, F.first("k") - 1).alias("_m"),
    )
    v = F.sqrt(F.try_divide(F.col("chi2") / F.col("n"), F.col("_m").cast("double")))
    return out.withColumn("cramers_v", v).drop("_m")


def chi_square_effects(df, cols=CATEGORICAL_VARS):
    """Rounded statistic, effect size and its label; no p-value."""
    return chi_square_stats(df, cols).select(
        "variable",
        rounded(F.col("chi2"), 2).alias("chi2"),
        "dof",
        rounded(F.col("cramers_v"), 4).alias("cramers_v"),
        _label(F.col("cramers_v"), (0.1, 0.2, 0.4)).alias("effect_size"),
    )


def chi_square_tests(df, cols=CATEGORICAL_VARS):
    stats = chi_square_stats(df, cols).withColumn(
        "effect_size", _label(F.col("cramers_v"), (0.1, 0.2, 0.4))
    )
    return with_p_values(stats, chi2_tail, "chi2", "dof")


def two_group_stats(df, cols=NUMERIC_VARS):
    """Churned against retained per column: moments, Welch t and dof, Cohen's d (unrounded)."""
    lost = F.col("churn_flag") == 1
    aggs = []
    for c in cols:
        for side, cond in (("a", lost), ("b", ~lost)):
            value = F.when(cond, F.col(c).cast("double"))
            aggs += [
                F.count(value).alias(f"n_{side}_{c}"),
                mean_where(cond, c).alias(f"m_{side}_{c}"),
                F.var_samp(value).alias(f"v_{side}_{c}"),
            ]
    row = df.agg(*aggs)
    moments = [
        F.struct(
            F.lit(c).alias("variable"),
            *[F.col(f"{s}_{side}_{c}").alias(f"{s}_{side}") for s in "nmv" for side in "ab"],
        )
        for c in cols
    ]
    long = row.select(F.explode(F.array(*moments)).alias("r")).select("r.*")
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    ea, eb = F.try_divide(F.col("v_a"), na), F.try_divide(F.col("v_b"), nb)
    pooled = F.sqrt(
        F.try_divide((na - 1) * F.col("v_a") + (nb - 1) * F.col("v_b"), na + nb - 2)
    )
    diff = F.col("m_a") - F.col("m_b")
    dof = F.try_divide(
        (ea + eb) * (ea + eb),
        F.try_divide(ea * ea, na - 1) + F.try_divide(eb * eb, nb - 1),
    )
    return long.withColumns(
        {
            "mean_difference": diff,
            "se": F.sqrt(ea + eb),
            "t_stat": F.try_divide(diff, F.sqrt(ea + eb)),
            "dof": dof,
            "cohens_d": F.try_divide(diff, pooled),
        }
    )


def ttest_effects(df, cols=NUMERIC_VARS):
    """Rounded test, interval and effect size; no p-value."""
    s = two_group_stats(df, cols)
    diff, margin = F.col("mean_difference"), 1.96 * F.col("se")
    return s.select(
        "variable",
        rounded(F.col("m_a"), 2).alias("mean_churned"),
        rounded(F.col("m_b"), 2).alias("mean_retained"),
        rounded(diff, 2).alias("mean_difference"),
        rounded(diff - margin, 2).alias("ci_low"),
        rounded(diff + margin, 2).alias("ci_high"),
        rounded(F.col("t_stat"), 3).alias("t_stat"),
        rounded(F.col("cohens_d"), 3).alias("cohens_d"),
        _label(F.abs(F.col("cohens_d")), (0.2, 0.5, 0.8)).alias("effect_size"),
    )


def ttests(df, cols=NUMERIC_VARS):
    stats = two_group_stats(df, cols).withColumn(
        "effect_size", _label(F.abs(F.col("cohens_d")), (0.2, 0.5, 0.8))
    )
    return with_p_values(stats, t_two_sided, "t_stat", "dof")


ANOVAS = [
    ("contract_type", "monthly_charges"),
    ("internet_service", "cltv"),
    ("payment_method", "tenure_months"),
]


def anova_stats(df, pairs=ANOVAS):
    """One-way F and eta squared per (group, value) pair; rows with a null side are left out."""
    cells = [
        F.struct(
            F.lit(g).alias("group_variable"),
            F.lit(v).alias("value_variable"),
            F.col(g).cast("string").alias("grp"),
            F.col(v).cast("double").alias("val"),
        )
        for g, v in pairs
    ]
    keys = ["group_variable", "value_variable"]
    per = (
        df.select(F.explode(F.array(*cells)).alias("c"))
        .select("c.*")
        .where(F.col("grp").isNotNull() & F.col("val").isNotNull())
        .groupBy(*keys, "grp")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("val").alias("m"),
            F.coalesce(F.var_pop("val"), F.lit(0.0)).alias("v"),
        )
    )
    grand = per.groupBy(*keys).agg(
        F.sum("n").alias("total"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"),
    )
    gap = F.col("m") - F.col("grand")
    sums = (
        per.join(grand, keys)
        .groupBy(*keys)
        .agg(
            F.sum(F.col("n") * gap * gap).alias("ssb"),
            F.sum(F.col("n") * F.col("v")).alias("ssw"),
            (F.count(F.lit(1)) - 1).alias("d1"),
            (F.first("total") - F.count(F.lit(1))).alias("d2"),
        )
    )
    between = F.try_divide(F.col("ssb"), F.col("d1").cast("double"))
    inside = F.try_divide(F.col("ssw"), F.col("d2").cast("double"))
    return sums.select(
        *keys,
        "d1",
        "d2",
        F.try_divide(between, inside).alias("f_stat"),
        F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")).alias("eta_squared"),
    )


def anova_effects(df, pairs=ANOVAS):
    return anova_stats(df, pairs).select(
        "group_variable",
        "value_variable",
        rounded(F.col("f_stat"), 2).alias("f_stat"),
        rounded(F.col("eta_squared"), 4).alias("eta_squared"),
    )


def anovas(df, pairs=ANOVAS):
    return with_p_values(anova_stats(df, pairs), f_tail, "f_stat", "d1", "d2")


def _interval(low_high):
    return [
        rounded(100 * c, 2).alias(name)
        for c, name in zip(low_high, ("wilson_low_pct", "wilson_high_pct"))
    ]


def overall_rate_interval(df):
    k, n = F.sum("churn_flag"), F.count(F.lit(1))
    low, high = wilson_bounds(k, n)
    return df.agg(
        n.alias("n"), pct(k, n).alias("churn_rate_pct"), low.alias("wilson_low"), high.alias("wilson_high")
    )


def rate_interval_by_group(df, cols=("contract_type", "internet_service")):
    """Wilson interval of the churn rate for every level of the columns, in one pass."""
    k, n = F.sum("churn_flag"), F.count(F.lit(1))
    return (
        tall(df, list(cols), ["churn_flag"], "group_variable", "level")
        .where(F.col("level").isNotNull())
        .groupBy("group_variable", "level")
        .agg(n.alias("n"), pct(k, n).alias("churn_rate_pct"), *_interval(wilson_bounds(k, n)))
    )


def run_all_tests(df):
    """The whole suite as report sections."""
    return {
        "chi_square_tests": chi_square_tests(df),
        "t_tests": ttests(df),
        "anovas": anovas(df),
        "churn_rate_ci_overall": overall_rate_interval(df),
        "churn_rate_ci_by_group": rate_interval_by_group(df),
    }


def suite_rows(df):
    """Chi-square, t and F tests in one table: family, variable, statistic, effect, p-value."""
    shape = lambda src, family, variable, stat, effect: src.select(
        F.lit(family).alias("family"),
        variable.alias("variable"),
        stat.alias("statistic"),
        effect.alias("effect"),
        "p_value",
        "significant_at_05",
    )
    pair = F.concat_ws(" by ", "value_variable", "group_variable")
    return (
        shape(chi_square_tests(df), "chi2", F.col("variable"), F.col("chi2"), F.col("cramers_v"))
        .unionByName(shape(ttests(df), "t", F.col("variable"), F.col("t_stat"), F.col("cohens_d")))
        .unionByName(shape(anovas(df), "F", pair, F.col("f_stat"), F.col("eta_squared")))
    )


def ranked_effects(df):
    """Categoricals by Cramer's V and numerics by relative mean difference, largest first."""
    cat = chi_square_stats(df).select(
        F.lit("categorical").alias("kind"),
        "variable",
        rounded(F.col("cramers_v"), 4).alias("effect"),
    )
    change = F.try_divide(100 * (F.col("m_a") - F.col("m_b")), F.col("m_b"))
    num = two_group_stats(df).select(
        F.lit("numeric_pct_difference").alias("kind"),
        "variable",
        rounded(change, 1).alias("effect"),
    )
    return cat.unionByName(num).orderBy("kind", F.desc(F.abs("effect")), "variable")

