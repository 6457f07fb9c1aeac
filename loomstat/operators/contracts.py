"""Checks of columns, counts, keys and calendars, as reusable operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """The data don't hold what an operator needs."""


def assert_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def assert_rowcount(df: DataFrame, expected: int) -> DataFrame:
    n = df.count()
    if n != expected:
        raise ContractError(f"{n} rows instead of {expected}")
    return df


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    if not duplicate_keys(df, *keys).isEmpty():
        raise ContractError(f"repeated keys: {', '.join(keys)}")
    return df


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def fd_violations(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """Keys with more than one value of a column that should follow from them."""
    return df.groupBy(determinant).agg(F.countDistinct(dependent).alias("n_values")).where("n_values > 1")


def calendar(df: DataFrame, start: str, end: str) -> DataFrame:
    """Every month from start to end ('yyyy-MM') as year_month."""
    months = f"explode(sequence(to_date('{start}-01'), to_date('{end}-01'), interval 1 month))"
    return df.sparkSession.range(1).select(F.expr(months).alias("m")).select(F.date_format("m", "yyyy-MM").alias("year_month"))


def calendar_gaps(df: DataFrame, start: str, end: str) -> DataFrame:
    """Months that are missing from, or too many in, the year_month column: both anti joins."""
    have, want = df.select("year_month").distinct(), calendar(df, start, end)
    missing = want.join(have, "year_month", "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(have.join(want, "year_month", "left_anti").withColumn("problem", F.lit("unexpected")))


def panel_cells(df: DataFrame, panel: str, value: str) -> DataFrame:
    """(panel, n_cells, n_valid): how many cells each panel has, and how many are finite."""
    ok = F.col(value).isNotNull() & ~F.isnan(value)
    return df.groupBy(panel).agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(ok).alias("n_valid"))


def complete_panels(df: DataFrame, panel: str, value: str, cells: int) -> DataFrame:
    """Panels in which all of the given number of cells are present and finite."""
    return panel_cells(df, panel, value).where((F.col("n_cells") == cells) & (F.col("n_valid") == cells))


def require_share(valid: int, total: int, share: float) -> None:
    """Fail unless enough replicates are valid."""
    if valid < share * total:
        raise ContractError(f"{valid} of {total} are valid; {share:.0%} are required")
