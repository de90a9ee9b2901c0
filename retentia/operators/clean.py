"""Cleaning of the raw subscriber table."""

from pyspark.sql import functions as F

from retentia.schema import ACTIVE_REASON, MONEY, RAW_TO_CLEAN, YES_NO_COLUMNS


def standardize_columns(df):
    return df.withColumnsRenamed(RAW_TO_CLEAN)


def fix_total_charges(df):
    """Text to number. Only a new customer (tenure 0) without an amount gets the monthly charge."""
    number = F.trim("total_charges").try_cast(MONEY)
    imputed = number.isNull() & (F.col("tenure_months") == 0)
    return df.withColumns(
        {
            "total_charges_raw": F.col("total_charges"),
            "is_new_customer_imputed_charges": F.coalesce(imputed, F.lit(False)),
            "total_charges": F.when(imputed, F.col("monthly_charges").cast(MONEY)).otherwise(
                number
            ),
        }
    )


def fix_churn_reason(df):
    return df.fillna({"churn_reason": ACTIVE_REASON})


def add_binary_flags(df):
    """`<column>_bool` beside each Yes/No column; any other value gives null."""
    flag = lambda c: F.when(F.col(c) == "Yes", True).when(F.col(c) == "No", False)
    return df.withColumns({f"{c}_bool": flag(c) for c in YES_NO_COLUMNS})


def row_count_flag_is_constant(df):
    """True when row_count_flag is 1 on every row: one aggregate over one column."""
    row = df.agg(
        F.bool_and(F.coalesce(F.col("row_count_flag") == 1, F.lit(False))).alias("ok")
    ).first()
    return row.ok is None or row.ok


def drop_redundant_columns(df):
    dropped = ["lat_long_raw"]
    if row_count_flag_is_constant(df):
        dropped.append("row_count_flag")
    return df.drop(*dropped)


def run_cleaning(raw):
    return (
        raw.transform(standardize_columns)
        .transform(fix_total_charges)
        .transform(fix_churn_reason)
        .transform(add_binary_flags)
        .transform(drop_redundant_columns)
    )
