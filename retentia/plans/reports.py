"""Report jobs: several result frames written as one JSON file set per section."""

from functools import reduce

from pyspark.sql import functions as F

from retentia.operators import explore, hypothesis
from retentia.sources.tables import export_report


def eda_sections(wide):
    return {
        "overview": explore.overview_metrics(wide),
        "breakdowns": explore.breakdowns(wide),
        "addon_analysis": explore.addon_analysis(wide),
        "churn_reason_breakdown": explore.churn_reason_breakdown(wide),
        "churn_score_decile_analysis": explore.score_bins(wide),
        "top_cities": explore.top_cities(wide),
        "correlation_matrix": explore.correlation_matrix(wide),
        "service_adoption_funnel": explore.service_funnel(wide),
        "revenue_concentration": explore.revenue_concentration(wide),
        "chi_square_vs_churn": hypothesis.chi_square_tests(wide),
        "ttest_vs_churn": hypothesis.ttests(wide),
    }


def write_eda_report(wide, root):
    """Write every section and return the number of rows each one holds."""
    sections = eda_sections(wide)
    export_report(sections, root)
    spark = wide.sparkSession
    counts = [
        spark.read.json(f"{root}/{name}")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit(name).alias("section"), "rows")
        for name in sections
    ]
    return reduce(lambda a, b: a.unionByName(b), counts)
