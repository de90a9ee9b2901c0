"""Small column expressions shared by the operators."""

from pyspark.sql import Column, functions as F

Z95 = 1.959963984540054  # 0.975 quantile of the standard normal


def rounded(c, digits) -> Column:
    """Round half up on the decimal value, so 1.005 gives 1.01 whatever its binary form."""
    return F.round(c.cast("decimal(38,10)"), digits).cast("double")


def rounded_even(c, digits) -> Column:
    """Round half to even on the decimal value."""
    return F.bround(c.cast("decimal(38,10)"), digits).cast("double")


def pct(num, den, digits=2) -> Column:
    """100 * num / den; null for an empty group."""
    return rounded(F.try_divide(F.lit(100.0) * num, den.cast("double")), digits)


def mean(c) -> Column:
    """Mean through an exact sum, so the result does not depend on the order of addition."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))


def mean_where(cond, c) -> Column:
    return mean(F.when(cond, F.col(c)))


def total(c) -> Column:
    return F.sum(F.col(c)).cast("double")


def churned() -> Column:
    return F.sum("churn_flag").cast("bigint")


def customers() -> Column:
    return F.count(F.lit(1))


def churn_rate() -> Column:
    return pct(F.sum("churn_flag"), customers())


def ladder(value, steps, default) -> Column:
    """First label whose threshold the value reaches; steps run from high to low."""
    out = None
    for bound, label in steps:
        hit = value >= F.lit(bound)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default))


def one_of(source, mapping, default=None) -> Column:
    """Value mapping as a CASE expression."""
    out = None
    for key, val in mapping.items():
        hit = source == F.lit(key)
        out = F.when(hit, F.lit(val)) if out is None else out.when(hit, F.lit(val))
    return out if default is None else out.otherwise(F.lit(default))


def rfm_label(score) -> Column:
    return ladder(
        score,
        [(13, "Champion"), (10, "Loyal"), (7, "Steady"), (4, "At Risk")],
        "Critical / New",
    )


def risk_band(rate_pct) -> Column:
    """Band of a churn rate in percent; a null rate has no band."""
    return F.when(
        rate_pct.isNotNull(),
        ladder(rate_pct, [(35, "High Risk"), (20, "Moderate Risk")], "Healthy"),
    )


def kpi_color(rate_pct) -> Column:
    return F.when(
        rate_pct.isNotNull(), ladder(rate_pct, [(35, "#D62728"), (20, "#FF7F0E")], "#2CA02C")
    )


def as_percent(ratio) -> Column:
    """0.2654 -> '26.5%'."""
    return F.concat(F.format_number(F.lit(100.0) * ratio, 1), F.lit("%"))


def as_dollars(amount) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount.cast("double"), 0))


def as_millions(amount) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount.cast("double") / 1e6, 0), F.lit("M"))


def payment_group(method) -> Column:
    return F.when(F.lower(method).contains("automatic"), F.lit("Automatic")).otherwise(method)


def wilson_bounds(successes, n, z=Z95):
    """Low and high end of the Wilson score interval, as proportions rounded to 4 digits."""
    k, n = successes.cast("double"), n.cast("double")
    p = k / n
    z2 = z * z
    scale = 1 + F.lit(z2) / n
    centre = (p + F.lit(z2) / (2 * n)) / scale
    spread = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z2) / (4 * n * n)) / scale
    return rounded(centre - spread, 4), rounded(centre + spread, 4)
