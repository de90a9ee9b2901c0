"""Linear and logistic regression with classical inference, on Spark ML."""

import math
from functools import reduce
from operator import add

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import functions as F

from retentia.functions.tails import normal_two_sided, t_two_sided
from retentia.operators.features import add_contract_dummies

Z = 1.96


def _assembled(df, features, target):
    """Rows with all values present, as (label, features)."""
    num = [F.col(c).cast("double").alias(c) for c in features]
    rows = df.select(*num, F.col(target).cast("double").alias("label")).dropna()
    return VectorAssembler(inputCols=features, outputCol="features").transform(rows)


def _standardized(df, features):
    """Mean 0 and population standard deviation 1; a constant column is only centred."""
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in features],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in features],
    ).first()
    return df.withColumns(
        {
            c: (F.col(c).cast("double") - float(row[f"m_{c}"] or 0.0))
            / float(row[f"s_{c}"] or 1.0)
            for c in features
        }
    )


def fit_ols(df, features, target):
    fit = LinearRegression(solver="normal", regParam=0.0, standardization=False)
    data = _assembled(df, features, target)
    return fit.fit(data), data


OLS_SCHEMA = (
    "feature string, coefficient double, std_error double, t_stat double, p_value double,"
    " ci_low double, ci_high double, significant_at_05 boolean, n_obs long, r_squared double,"
    " adj_r_squared double"
)


def ols_regression(df, features, target):
    """Coefficient table (intercept first) with standard errors, t, p, 95% interval and R2."""
    model, _ = fit_ols(df, features, target)
    s = model.summary
    n, k = s.numInstances, len(features)
    coef = [float(b) for b in (model.intercept, *model.coefficients)]
    errors = s.coefficientStandardErrors
    se = [float(e) for e in (errors[-1], *errors[:-1])]
    rows = []
    for name, b, e in zip(["Intercept", *features], coef, se):
        t = b / e if e else None
        p = t_two_sided(t, n - k - 1)
        rows.append(
            (name, b, e, t, p, b - Z * e, b + Z * e, p is not None and p < 0.05,
             n, s.r2, s.r2adj)
        )
    return df.sparkSession.createDataFrame(rows, OLS_SCHEMA)


LOGIT_SCHEMA = (
    "feature string, coefficient double, std_error double, z_stat double, p_value double,"
    " odds_ratio double, odds_ratio_low double, odds_ratio_high double, significant_at_05 boolean,"
    " n_obs long, mcfadden_r2 double"
)


def fit_logistic(df, features, target, standardize=True):
    data = _standardized(df, features) if standardize else df
    glr = GeneralizedLinearRegression(
        family="binomial", link="logit", regParam=0.0, maxIter=100, tol=1e-8
    )
    return glr.fit(_assembled(data, features, target))


def _exp(x):
    return math.exp(x) if x < 700 else float("inf")


def logistic_regression(df, features, target="churn_flag", standardize=True):
    """Wald table of a maximum-likelihood logit; odds ratios per standard deviation or per unit.

    The normal equations of each step are k x k sums, so no row-by-row weight matrix exists.
    """
    model = fit_logistic(df, features, target, standardize)
    s = model.summary
    coef = [float(b) for b in (model.intercept, *model.coefficients)]
    errors = s.coefficientStandardErrors
    se = [float(e) for e in (errors[-1], *errors[:-1])]
    fit = 1 - s.deviance / s.nullDeviance if s.nullDeviance else None
    rows = []
    for name, b, e in zip(["Intercept", *features], coef, se):
        z = b / e
        p = normal_two_sided(z)
        rows.append(
            (name, b, e, z, p, _exp(b), _exp(b - Z * e), _exp(b + Z * e),
             p < 0.05, s.numInstances, fit)
        )
    return df.sparkSession.createDataFrame(rows, LOGIT_SCHEMA)


OPTIMUM_SCHEMA = (
    "feature string, coefficient double, mean_gradient double, std_error double,"
    " std_error_fisher double, n_obs long"
)


def logistic_optimum(df, features, target="churn_flag", standardize=True):
    """Proof of a logit fit: slope of the likelihood and errors at the fitted coefficients.

    One aggregate over the rows gives the score vector, which vanishes at the maximum, and the
    Fisher information, whose inverse holds the squared standard errors. Both are k x k sums.
    """
    table = logistic_regression(df, features, target, standardize)
    fit = {r.feature: r for r in table.collect()}
    names = ["Intercept", *features]
    data = _standardized(df, features) if standardize else df
    cols = [F.col(f"`{c}`").cast("double").alias(c) for c in features]
    rows = data.select(*cols, F.col(target).cast("double").alias("_y")).dropna()
    x = [F.lit(1.0), *map(F.col, features)]
    eta = reduce(add, [F.lit(fit[n].coefficient) * v for n, v in zip(names, x)])
    rows = rows.withColumn("_p", 1 / (1 + F.exp(-eta)))
    miss, spread = F.col("_y") - F.col("_p"), F.col("_p") * (1 - F.col("_p"))
    k = len(names)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(miss * v).alias(f"u{i}") for i, v in enumerate(x)],
        *[F.sum(spread * x[i] * x[j]).alias(f"i{i}_{j}") for i, j in upper],
    ).first()
    fisher = np.zeros((k, k))
    for i, j in upper:
        fisher[i, j] = fisher[j, i] = sums[f"i{i}_{j}"]
    errors = np.sqrt(np.diag(np.linalg.inv(fisher)))
    out = [
        (n, fit[n].coefficient, sums[f"u{i}"] / sums.n, fit[n].std_error, float(errors[i]), sums.n)
        for i, n in enumerate(names)
    ]
    return df.sparkSession.createDataFrame(out, OPTIMUM_SCHEMA)


OLS_FEATURES = ["tenure_months", "monthly_charges"]
LOGIT_FEATURES = [
    "tenure_months",
    "monthly_charges",
    "addon_service_count",
    "churn_score",
    "contract_two_year",
    "contract_one_year",
]
LOGIT_BUSINESS = [f for f in LOGIT_FEATURES if f != "churn_score"]


def regression_suite(df):
    """Charges by linear regression, churn by logit with and without the vendor score."""
    df = add_contract_dummies(df)
    return {
        "ols_total_charges": ols_regression(df, OLS_FEATURES, "total_charges"),
        "logit_with_vendor_score": logistic_regression(df, LOGIT_FEATURES),
        "logit_business_fields": logistic_regression(df, LOGIT_BUSINESS),
    }


def suite_coefficients(df):
    parts = [
        section.select(F.lit(name).alias("model"), "feature", "coefficient", "std_error", "p_value")
        for name, section in regression_suite(df).items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def independent_ols(df, features, target):
    """The same fit by iteratively reweighted least squares, for cross-checking."""
    glr = GeneralizedLinearRegression(family="gaussian", link="identity", regParam=0.0)
    model = glr.fit(_assembled(df, features, target))
    rows = [("Intercept", model.intercept), *zip(features, map(float, model.coefficients))]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double")


def ols_agreement(df, features, target):
    """Difference of the two fits per coefficient, relative to its size."""
    a = ols_regression(df, features, target).select("feature", "coefficient")
    b = independent_ols(df, features, target).withColumnRenamed("coefficient", "other")
    gap = F.abs(F.col("coefficient") - F.col("other")) / F.greatest(
        F.lit(1.0), F.abs("coefficient")
    )
    return a.join(b, "feature").withColumn("relative_difference", gap)


def residuals(df, features, target):
    """Fitted values and residuals, one row per input row."""
    model, data = fit_ols(df, features, target)
    return model.transform(data).select(
        "label",
        F.col("prediction").alias("fitted"),
        (F.col("label") - F.col("prediction")).alias("residual"),
    )


def residual_histogram(df, features, target, bins=40):
    """Equal-width bins over the range of the residuals; the last bin includes the maximum."""
    res = residuals(df, features, target).select("residual")
    span = res.agg(F.struct(F.min("residual").alias("lo"), F.max("residual").alias("hi"))).scalar()
    wide = res.withColumn("s", span).select(
        "residual", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi")
    )
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(
        F.lit(bins), F.floor(F.try_divide(F.col("residual") - F.col("lo"), width)) + 1
    )
    return wide.groupBy(F.coalesce(at, F.lit(1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("residual").alias("smallest"),
        F.max("residual").alias("largest"),
    )
