"""Edge cases of KPIs, rules, measures, search, statistics and scenarios."""

import math

import pytest
from pyspark.sql import functions as F

from retentia.functions import tails
from retentia.functions.columns import risk_band, rounded
from retentia.operators import explore, hypothesis, kpis, measures, rollups, rules, scenarios, search
from retentia.operators.ranks import exact_quantiles
from retentia.operators.regress import (
    add_contract_dummies,
    logistic_regression,
    ols_agreement,
    residual_histogram,
)
from retentia.operators.star import star_view
from retentia.sources.staging import new_path


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- invariants on the loaded star -----------------------------------------------------------


def test_last_running_total_is_the_grand_total(small):
    total = kpis.kpi_summary(small.star).first()
    last = kpis.kpi_cohort_progression(small.star).collect()[-1]
    assert last.cumulative_revenue_through_cohort == pytest.approx(total.total_billed_revenue)
    along = measures.cohort_cumulative(small.star).orderBy(F.desc("sort_order")).first()
    assert along.cumulative_customers == total.total_customers
    tail = kpis.reason_pareto(small.star).collect()[-1]
    assert tail.cumulative_pct_of_churn == pytest.approx(100.0)
    assert kpis.addon_tier_funnel(small.star).first()[5] == total.total_customers


def test_top_churned_uses_group_limit(small):
    plan = kpis.top_churned_by_value(small.star, 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_no_single_partition_window_over_rows(small):
    """Row-level orders must not fall back to a window without PARTITION BY."""
    for df in (
        kpis.rfm_scores(small.star),
        measures.value_rank(small.star),
        explore.revenue_curve(small.wide),
    ):
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        for line, below in zip(lines, lines[1:]):
            if "Exchange SinglePartition" in line:
                assert "HashAggregate" in below, below


def test_health_score_thresholds(spark):
    # 288*(100-s) + 250*t + 2400*a + 108*c, in 720ths
    cases = [(100, 72, 6, "Two year"), (25, 0, 0, "Two year"), (0, 0, 2, "Month-to-month")]
    df = spark.createDataFrame(
        cases, "churn_score int, tenure_months int, addon_service_count int, contract_type string"
    )
    out = rules.with_health(df).collect()
    assert [(r.customer_health_score, r.health_tier) for r in out] == [
        (60.0, "Watch"),
        (45.0, "Watch"),
        (49.7, "Watch"),
    ]
    tiers = spark.createDataFrame([(50400,), (50399,), (32400,), (32399,)], "u int")
    got = [r[0] for r in tiers.select(rules.health_tier(F.col("u"))).collect()]
    assert got == ["Healthy", "Watch", "Watch", "At Risk"]


def test_unrounded_score_decides_the_tier(spark):
    units = 50371  # 69.96 rounds to 70.0
    row = spark.range(1).select(
        rounded(F.lit(units).cast("double") / 720, 1).alias("s"), rules.health_tier(F.lit(units)).alias("t")
    )
    assert rows(row) == [(70.0, "Watch")]


def test_empty_tables(spark, small):
    none = small.wide.limit(0)
    r = kpis.headline_kpis(none).first()
    assert (r.total_customers, r.churn_rate_pct, r.mrr_at_risk) == (0, 0.0, 0.0)
    m = measures.evaluate(none.withColumn("customer_key", F.lit(1)), ["churn_rate"]).first()
    assert m.churn_rate == 0.0
    assert explore.breakdowns(none).count() == 0


def test_score_updates(small, spark):
    some = small.star.dim_customer.select("customer_id").orderBy("customer_id").limit(1)
    new = some.withColumn("churn_score", F.lit(99))
    fact = rules.update_churn_scores(small.star, new)
    assert fact.count() == small.star.fact_subscription.count()
    assert fact.where("customer_key = 1").first().churn_score == 99
    with pytest.raises(rules.UnknownCustomers, match="nobody"):
        rules.update_churn_scores(
            small.star, spark.createDataFrame([("nobody", 1)], "customer_id string, churn_score int")
        )


@pytest.mark.parametrize("scores", [[50, 60], [900], [-1], [None]])
def test_bad_score_updates_change_nothing(small, spark, scores):
    one = small.star.dim_customer.orderBy("customer_id").first().customer_id
    new = spark.createDataFrame([(one, s) for s in scores], "customer_id string, churn_score int")
    with pytest.raises(rules.InvalidUpdates):
        rules.update_churn_scores(small.star, new)


def test_rollup_refresh_keeps_old_version_readable(spark, small):
    root = new_path(spark, "rollup-test")
    first = rollups.refresh_rollups(small.star, root)["mv_geography_rollup"]
    n = first.count()
    second = rollups.refresh_rollups(small.star, root)["mv_geography_rollup"]
    assert first.count() == n == second.count()
    assert rollups.open_rollups(spark.newSession(), root)["mv_geography_rollup"].count() == n


def test_distinct_and_counted_measures_agree(small):
    view = star_view(small.star, "contract_type")
    names = ["total_customers", "churned_customers", "churn_rate"]
    a = measures.evaluate(view, names, ["contract_type"]).orderBy("contract_type")
    b = measures.evaluate(view, names, ["contract_type"], distinct=True).orderBy("contract_type")
    assert rows(a) == rows(b)


def test_plan_share_ignores_plan_filters(small):
    view = star_view(small.star, "contract_type")
    part = measures.evaluate(
        view, ["pct_of_total_revenue"], where={"contract_type": ["One year"]}
    ).first()[0]
    whole = measures.evaluate(view, ["total_billed_revenue"]).first()[0]
    one = measures.evaluate(
        view, ["total_billed_revenue"], where={"contract_type": ["One year"]}
    ).first()[0]
    assert part == pytest.approx(one / whole, abs=1e-6)


def test_all_measures_evaluate(small):
    view = star_view(small.star, "contract_type", "gender")
    names = [*measures.MEASURES, *measures.ALL_PLANS]
    out = measures.evaluate(view, names, ["contract_type", "gender"])
    assert out.count() == 6 and out.columns[2:] == names


def test_missing_cohort_gives_null_prior(small):
    star = small.star
    gap = star.fact_subscription.join(
        star.dim_tenure_cohort.where("sort_order <> 4").select("tenure_cohort_key"),
        "tenure_cohort_key",
        "left_semi",
    )
    from dataclasses import replace

    out = {r.sort_order: r.prior_churn_rate for r in measures.cohort_change(replace(star, fact_subscription=gap)).collect()}
    assert 4 not in out and out[5] is None and out[6] is not None


def test_concentration_takes_exactly_floor_rows(small):
    n = small.wide.count()
    for r in explore.revenue_concentration(small.wide).collect():
        assert r.row_count == n * r.top_pct // 100


def test_search_is_literal_and_empty_selection_is_empty(small):
    assert search.search_subscribers(small.wide, term="customer#").count() == small.wide.count()
    assert search.search_subscribers(small.wide, term="C.stomer").count() == 0
    assert search.restrict(small.wide, [], ["DSL"]).count() == 0
    pages = [r.customer_id for p in (1, 2) for r in search.page(small.wide, number=p).collect()]
    assert len(pages) == 30 and pages == sorted(pages)


def test_rank_bins_match_qcut(spark):
    import pandas as pd

    n = 7043
    got = spark.range(1, n + 1).select(
        search.rank_bin(F.col("id"), F.lit(n), 5).alias("b"), "id"
    ).toPandas().sort_values("id")
    want = pd.qcut(pd.Series(range(1, n + 1)), 5, labels=False) + 1
    assert got.b.tolist() == want.tolist()
    one = spark.range(1, 2).select(search.rank_bin(F.col("id"), F.lit(1), 5))
    assert rows(one) == [(1,)]


def test_risk_band_has_no_band_for_null(spark):
    df = spark.createDataFrame([(35.0,), (34.99,), (20.0,), (19.9,), (None,)], "r double")
    assert [r[0] for r in df.select(risk_band(F.col("r"))).collect()] == [
        "High Risk", "Moderate Risk", "Moderate Risk", "Healthy", None,
    ]


# --- statistics --------------------------------------------------------------------------------


def labelled(spark, table):
    """Rows for a contingency table given as level -> (yes, no)."""
    out = []
    for level, (yes, no) in table.items():
        out += [(level, "Yes", 1)] * yes + [(level, "No", 0)] * no
    return spark.createDataFrame(out, "v string, churn_label string, churn_flag int")


def test_two_by_two_gets_the_correction(spark):
    r = hypothesis.chi_square_stats(labelled(spark, {"a": (10, 20), "b": (30, 5)}), ["v"]).first()
    e = [[30 * 40 / 65, 30 * 25 / 65], [35 * 40 / 65, 35 * 25 / 65]]
    o = [[10, 20], [30, 5]]
    want = sum((abs(o[i][j] - e[i][j]) - 0.5) ** 2 / e[i][j] for i in (0, 1) for j in (0, 1))
    assert r.chi2 == pytest.approx(want) and r.dof == 1


def test_three_by_two_has_none(spark):
    table = {"a": (10, 20), "b": (30, 5), "c": (7, 7)}
    r = hypothesis.chi_square_stats(labelled(spark, table), ["v"]).first()
    rt, ct, n = {k: sum(v) for k, v in table.items()}, (47, 32), 79
    want = sum(
        (table[k][j] - rt[k] * ct[j] / n) ** 2 / (rt[k] * ct[j] / n) for k in table for j in (0, 1)
    )
    assert r.chi2 == pytest.approx(want) and r.dof == 2
    assert r.cramers_v == pytest.approx(math.sqrt(want / n))


def test_small_gaps_are_not_overcorrected(spark):
    r = hypothesis.chi_square_stats(labelled(spark, {"a": (5, 5), "b": (5, 6)}), ["v"]).first()
    assert r.chi2 == pytest.approx(0.0, abs=1e-12)


def test_degenerate_groups(spark):
    one = labelled(spark, {"a": (3, 0)})
    r = hypothesis.chi_square_stats(one, ["v"]).first()
    assert (r.chi2, r.dof, r.cramers_v) == (0.0, 0, None)
    df = spark.createDataFrame([(1, 5.0), (0, 5.0), (0, 5.0)], "churn_flag int, x double")
    t = hypothesis.two_group_stats(df, ["x"]).first()
    assert t.t_stat is None and t.cohens_d is None
    a = hypothesis.anova_stats(
        spark.createDataFrame([("g", 1.0), ("g", 2.0)], "g string, x double"), [("g", "x")]
    ).first()
    assert a.f_stat is None


def test_anova_drops_nulls(spark):
    data = [("a", 1.0), ("a", 2.0), ("b", 4.0), ("b", 6.0), (None, 99.0), ("b", None)]
    r = hypothesis.anova_stats(spark.createDataFrame(data, "g string, x double"), [("g", "x")]).first()
    # means 1.5 and 5, grand 3.25: between 12.25, within 0.5 + 2
    assert r.f_stat == pytest.approx(12.25 / (2.5 / 2)) and r.eta_squared == pytest.approx(12.25 / 14.75)


@pytest.mark.parametrize(
    "got, want",
    [
        (tails.normal_two_sided(1.959963984540054), 0.05),
        (tails.chi2_tail(3.841458820694124, 1), 0.05),
        (tails.chi2_tail(18.307038053275146, 10), 0.05),
        (tails.t_two_sided(2.2281388519649385, 10), 0.05),
        (tails.t_two_sided(1.9599642, 5_000_000), 0.05),
        (tails.t_two_sided(10, 1e5) / tails.normal_two_sided(10), 1.0258082),
        (tails.t_two_sided(10, 1_000_001) / tails.normal_two_sided(10), 1.0025528),
        (tails.t_two_sided(10, 1e9) / tails.normal_two_sided(10), 1.0000025),
        (tails.f_tail(4.102821015303865, 2, 10), 0.05),
        (tails.f_tail(2.9957322735539909, 1e-9 + 2, 1e12), 0.05),
        (tails.chi2_tail(0.0, 3), 1.0),
    ],
)
def test_tails(got, want):
    assert got == pytest.approx(want, rel=1e-6)


def test_tails_do_not_underflow_early():
    assert 0 < tails.normal_two_sided(20) < 1e-80
    assert 0 < tails.chi2_tail(500, 2) < 1e-100


def test_wilson_known_value(spark):
    df = spark.createDataFrame([(1,)] * 8 + [(0,)] * 2, "churn_flag int")
    r = hypothesis.overall_rate_interval(df).first()
    assert (r.wilson_low, r.wilson_high) == (0.4902, 0.9433)


def test_p_values_in_suite(small):
    out = hypothesis.suite_rows(small.wide).collect()
    assert len(out) == 14 + 7 + 3
    assert all(0 <= r.p_value <= 1 for r in out if r.p_value is not None)


def test_regressions(small):
    gaps = ols_agreement(small.wide, ["tenure_months", "monthly_charges"], "total_charges").collect()
    assert all(r.relative_difference < 1e-6 for r in gaps)
    df = add_contract_dummies(small.wide)
    cols = ["tenure_months", "cltv"]
    std = {r.feature: r for r in logistic_regression(df, cols).collect()}
    raw = {r.feature: r for r in logistic_regression(df, cols, standardize=False).collect()}
    # the Wald statistic of a slope does not depend on the unit
    assert std["cltv"].z_stat == pytest.approx(raw["cltv"].z_stat, rel=1e-3)
    bins = residual_histogram(small.wide, ["tenure_months"], "total_charges")
    assert bins.agg(F.sum("rows")).first()[0] == small.wide.count()


def test_scenarios_floor_and_empty_groups(spark):
    df = spark.createDataFrame(
        [("Month-to-month", i % 2, 10.0) for i in range(15)] + [("One year", 0, 20.0)],
        "contract_type string, churn_flag int, monthly_charges double",
    )
    out = scenarios.contract_migration(df).collect()
    assert [r.customers_moved for r in out] == [1, 3, 4]
    none = scenarios.contract_migration(df.where("contract_type = 'One year'")).collect()
    assert [r.customers_moved for r in none] == [0, 0, 0] and none[0].est_mrr is None


def test_five_numbers_of_one_row(spark):
    df = spark.createDataFrame([(1, 3.0)], "churn_flag int, x double")
    r = explore.five_numbers(df, ["x"]).first()
    assert (r.minimum, r.median, r.maximum) == (3.0, 3.0, 3.0)
    assert exact_quantiles(df.limit(0), ["x"], [0.5]).count() == 0
