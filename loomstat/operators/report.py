"""Tables and series for publication, as frames; drawing isn't this engine's work."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.text import interval_text, p_text


def interval_table(df: DataFrame, keys: list[str], estimate: str, lower: str, upper: str) -> DataFrame:
    """Estimates with six places and their interval as text."""
    return df.select(*keys, F.format_string("%.6f", estimate).alias("estimate_text"), interval_text(F.col(lower), F.col(upper)).alias("ci_text"))


def month_text(month: str) -> Column:
    """'Sep 2022' from '2022-09'."""
    return F.date_format(F.to_date(F.concat(F.col(month), F.lit("-01"))), "MMM yyyy")


def equal_runs(df: DataFrame, order: str, value: str) -> DataFrame:
    """Runs of equal values of a step series: first and last place, value, length. A series is one calendar."""
    w = Window.orderBy(order)
    changed = F.when(F.col(value) == F.lag(value).over(w), 0).otherwise(1)
    runs = df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.first(value).alias("value"), F.count(F.lit(1)).alias("length"))


def trajectory(stance: DataFrame, intervals: DataFrame, dimension: str = "q1") -> DataFrame:
    """Points and bands of both parties' monthly means, ready to draw."""
    points = stance.where(F.col("dimension") == dimension)
    return points.join(intervals.where(F.col("dimension") == dimension), ["year_month", "party", "dimension"], "left").orderBy("party", "year_month")


#: How a column of a table is written.
FORMATS = {
    "text": lambda c: F.initcap(F.replace(c[0].cast("string"), F.lit("_"), F.lit(" "))),
    "plain": lambda c: c[0].cast("string"),
    "int": lambda c: F.format_string("%d", c[0].cast("bigint")),
    "number": lambda c: F.format_string("%.6f", c[0].cast("double")),
    "percent": lambda c: F.format_string("%.3f", 100 * c[0].cast("double")),
    "p": lambda c: p_text(c[0]),
    "interval": lambda c: interval_text(c[0], c[1]),
    "list": lambda c: F.array_join(c[0].cast("array<string>"), ", "),
    "yes": lambda c: F.when(c[0], F.lit("Yes")).otherwise(F.lit("No")),
}


@dataclass(frozen=True)
class Table:
    """A table to be published: its title and notes, and for each column a label, how it is written, and out of which columns."""

    title: str
    columns: tuple[tuple[str, str, str], ...]
    notes: tuple[str, ...] = ()

    def formatted(self, df: DataFrame) -> DataFrame:
        """Every cell as text; a missing value is empty."""
        cells = [(label, FORMATS[how]([F.col(c) for c in source.split()]), source.split()) for label, how, source in self.columns]
        return df.select(*[F.when(F.greatest(*[F.col(s).isNull().cast("int") for s in [*source, source[0]]]) == 0, c).otherwise(F.lit("")).alias(label) for label, c, source in cells])

    def blueprint(self, df: DataFrame) -> dict:
        """Title, header, rows and notes, for a document; a table has few rows."""
        rows = self.formatted(df).collect()
        return {"title": self.title, "header": [label for label, _, _ in self.columns], "rows": [list(r) for r in rows], "notes": list(self.notes)}
