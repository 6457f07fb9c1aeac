"""Rank-based trend tests over series of months.

A series is a frame (series, t, y) with t = 0, 1, ..; it has a row for each
month of a calendar, so that its pairs are few. Series are independent groups:
any number of them runs in parallel.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.dist import chi2_tail, normal_quantile, normal_two_sided
from loomstat.session import by_group


def as_series(df: DataFrame, name: str, value: str, month: str = "year_month") -> DataFrame:
    """(series, t, year_month, y) of a monthly column."""
    order = Window.partitionBy("series").orderBy("year_month")
    rows = df.select(F.lit(name).alias("series"), F.col(month).alias("year_month"), F.col(value).cast("double").alias("y"))
    return rows.withColumn("t", F.row_number().over(order) - 1)


def pairs(series: DataFrame) -> DataFrame:
    """All pairs of months of a series, with their slope: an equi-join on the series with t ordered."""
    a, b = series.select("series", F.col("t").alias("i"), F.col("y").alias("y_i")), series.select("series", F.col("t").alias("j"), F.col("y").alias("y_j"))
    return a.join(b, "series").where("i < j").withColumn("slope", (F.col("y_j") - F.col("y_i")) / (F.col("j") - F.col("i")))


def mann_kendall(series: DataFrame) -> DataFrame:
    """S, its variance corrected for ties, Z and tau of each series."""
    s = pairs(series).groupBy("series").agg(F.sum(F.signum(F.col("y_j") - F.col("y_i"))).cast("bigint").alias("S"), F.count(F.lit(1)).alias("n_pairs"))
    ties = series.groupBy("series", "y").agg(F.count(F.lit(1)).alias("k")).groupBy("series").agg(F.sum("k").alias("n"), F.sum(F.expr("k * (k - 1) * (2 * k + 5)")).alias("tied"))
    z = F.expr("case when S > 0 then (S - 1) / sqrt(variance) when S < 0 then (S + 1) / sqrt(variance) else 0.0 end")
    return s.join(ties, "series").withColumn("variance", F.expr("(n * (n - 1) * (2 * n + 5) - tied) / 18.0")).withColumns({"Z": z, "tau": F.col("S") / F.col("n_pairs")}).drop("tied")


def sen_slope(series: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Median slope with its rank-order interval; ranks round half to even."""
    z = normal_quantile(alpha / 2)
    slopes = pairs(series).groupBy("series").agg(F.array_sort(F.collect_list("slope")).alias("slopes"), F.median("slope").alias("sen_slope"), F.count(F.lit(1)).alias("N"))
    both = slopes.join(mann_kendall(series).select("series", "variance"), "series")
    upper = F.least(F.bround((F.col("N") - z * F.sqrt("variance")) / 2).cast("int"), F.col("N").cast("int") - 1)
    lower = F.greatest(F.bround((F.col("N") + z * F.sqrt("variance")) / 2).cast("int") - 1, F.lit(0))
    return both.select("series", "sen_slope", F.element_at("slopes", lower + 1).alias("ci_lower"), F.element_at("slopes", upper + 1).alias("ci_upper"), "N")


def s_decomposition(series: DataFrame, breaks: list[int]) -> DataFrame:
    """S of pairs within one regime and across regimes; ``breaks`` are first months of regimes."""
    regime = sum((F.when(F.col("t") >= b, 1).otherwise(0) for b in breaks), F.lit(0))
    r = series.select("series", "t", regime.alias("r"))
    p = pairs(series).join(r.select("series", F.col("t").alias("i"), F.col("r").alias("ri")), ["series", "i"]).join(r.select("series", F.col("t").alias("j"), F.col("r").alias("rj")), ["series", "j"])
    sign = F.signum(F.col("y_j") - F.col("y_i"))
    category = F.when(F.col("ri") == F.col("rj"), F.lit("within_regime")).otherwise(F.lit("between_regimes"))
    return p.groupBy("series", category.alias("pair_category")).agg(F.count_if(sign > 0).alias("positive"), F.count_if(sign < 0).alias("negative"), F.count_if(sign == 0).alias("ties"), F.count(F.lit(1)).alias("pairs"), F.sum(sign).cast("bigint").alias("s_contribution"))


def paired_contrast(first: DataFrame, second: DataFrame) -> DataFrame:
    """Median of the differences of two series' slopes over the same pairs, beside the difference of medians."""
    a, b = pairs(first).select("i", "j", F.col("slope").alias("a")), pairs(second).select("i", "j", F.col("slope").alias("b"))
    return a.join(b, ["i", "j"]).agg(F.median(F.col("a") - F.col("b")).alias("paired_contrast"), (F.median("a") - F.median("b")).alias("difference_of_medians"), F.count(F.lit(1)).alias("n_pairs"))


def autocorrelation(series: DataFrame, lags: int = 6) -> DataFrame:
    """Biased autocorrelation at lags 1.., with the cumulative Bartlett band."""
    c = series.withColumn("a", F.col("y") - F.avg("y").over(Window.partitionBy("series"))).select("series", "t", "a")
    moments = c.groupBy("series").agg(F.sum(F.col("a") * F.col("a")).alias("v"), F.count(F.lit(1)).alias("n"))
    shifted = c.select("series", F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"), (F.col("t") - F.col("lag")).alias("t"), F.col("a").alias("b"))
    rho = c.join(shifted, ["series", "t"]).groupBy("series", "lag").agg(F.sum(F.col("a") * F.col("b")).alias("s")).join(moments, "series").withColumn("acf", F.col("s") / F.col("v"))
    before = Window.partitionBy("series").orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    band = 1.96 * F.sqrt((1 + 2 * F.coalesce(F.sum(F.col("acf") * F.col("acf")).over(before), F.lit(0.0))) / F.col("n"))
    return rho.withColumn("band", band).withColumn("outside", F.abs("acf") > F.col("band")).select("series", "lag", "n", "acf", "band", "outside")


def ljung_box(series: DataFrame, lags: int) -> DataFrame:
    """Q up to a lag; its p-value is chi2_tail(Q, lag - model_df)."""
    return autocorrelation(series, lags).groupBy("series").agg((F.max(F.col("n") * (F.col("n") + 2)) * F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag")))).alias("Q"))


def quasi_differences(series: DataFrame, phi: float) -> DataFrame:
    """(series, t, starts, q): y less phi times the month before; after a gap the errors start again, scaled by sqrt(1 - phi^2)."""
    w = Window.partitionBy("series").orderBy("t")
    starts = F.coalesce(F.col("t") - F.lag("t").over(w) > 1, F.lit(True))
    q = F.when(F.col("starts"), F.col("y") * math.sqrt(1 - phi * phi)).otherwise(F.col("y") - phi * F.col("before"))
    return series.withColumns({"starts": starts, "before": F.lag("y").over(w)}).withColumn("q", q).select("series", "t", "starts", "q")


def average_ranks(series: DataFrame) -> DataFrame:
    """(series, t, y, rank): ranks by value, ties at the mean of their places."""
    rank = F.rank().over(Window.partitionBy("series").orderBy("y"))
    ties = F.count(F.lit(1)).over(Window.partitionBy("series", "y"))
    return series.where("y is not null").select("series", "t", "y", (rank + (ties - 1) / 2).alias("rank"))


def contrast_identity(first: DataFrame, second: DataFrame, gap: DataFrame) -> DataFrame:
    """(n_pairs, largest_difference) between differences of two series' slopes and the slopes of their gap, over the same pairs."""
    of = lambda s, n: pairs(s).select("i", "j", F.col("slope").alias(n))
    both = of(first, "a").join(of(second, "b"), ["i", "j"]).join(of(gap, "g"), ["i", "j"])
    return both.agg(F.count(F.lit(1)).alias("n_pairs"), F.max(F.abs(F.col("a") - F.col("b") - F.col("g"))).alias("largest_difference"))


def acf(y: np.ndarray, lags: int) -> np.ndarray:
    a = y - y.mean()
    v = float(a @ a)
    return np.array([float(a[k:] @ a[:-k]) / v if v else 0.0 for k in range(1, lags + 1)])


def pacf(y: np.ndarray, lags: int) -> np.ndarray:
    """Partial autocorrelation: last coefficient of each Yule-Walker system on the biased autocorrelation."""
    r = np.concatenate(([1.0], acf(y, lags)))
    return np.array([np.linalg.solve(r[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))], r[1 : k + 1])[-1] for k in range(1, lags + 1)])


def ljung_box_p(y: np.ndarray, lag: int, model_df: int = 0) -> tuple[float, float]:
    n, r = len(y), acf(y, lag)
    q = n * (n + 2) * float(sum(r[k - 1] ** 2 / (n - k) for k in range(1, lag + 1)))
    return q, chi2_tail(q, lag - model_df)


def hamed_rao(y: np.ndarray, lag: int, alpha: float = 0.05) -> dict[str, float]:
    """Mann-Kendall test whose variance is corrected for the significant autocorrelation of detrended ranks."""
    n = len(y)
    d = np.sign(np.subtract.outer(y, y)).T[np.triu_indices(n, 1)]
    s = float(d.sum())
    _, k = np.unique(y, return_counts=True)
    variance = (n * (n - 1) * (2 * n + 5) - float((k * (k - 1) * (2 * k + 5)).sum())) / 18
    i, j = np.triu_indices(n, 1)
    slope = float(np.median((y[j] - y[i]) / (j - i)))
    rest = y - slope * np.arange(n)
    ranks = pd.Series(rest).rank().to_numpy()
    rho = acf(ranks, min(lag, n - 1))
    bound = -normal_quantile(alpha / 2) / math.sqrt(n)
    sum_ = sum((n - m) * (n - m - 1) * (n - m - 2) * r for m, r in enumerate(rho, 1) if abs(r) > bound)
    factor = 1 + 2 * sum_ / (n * (n - 1) * (n - 2))
    corrected = variance * factor
    z = 0.0 if s == 0 or corrected <= 0 else (s - math.copysign(1, s)) / math.sqrt(corrected)
    return {"S": s, "variance": variance, "factor": factor, "Z": z, "p_value": normal_two_sided(z), "tau": s / (n * (n - 1) / 2), "sen_slope": slope}


def hamed_rao_tests(series: DataFrame, lag: int = 2, lags: dict[str, int] | None = None) -> DataFrame:
    """The corrected test for each series, at its own lag if ``lags`` names it; a series is one small group."""
    schema = "series string, n int, S double, variance double, factor double, Z double, p_value double, tau double, sen_slope double, trend string"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("t")["y"].to_numpy(float)
        out = hamed_rao(y, (lags or {}).get(pdf["series"].iloc[0], lag))
        trend = "no trend" if out["p_value"] >= 0.05 else "increasing" if out["S"] > 0 else "decreasing"
        return pd.DataFrame([{"series": pdf["series"].iloc[0], "n": len(y), **out, "trend": trend}])

    return by_group(series.where("y is not null"), ["series"], one, schema)


def partial_autocorrelations(series: DataFrame, lags: int = 6) -> DataFrame:
    """(series, lag, pacf, band) by the Durbin-Levinson recursion over the biased autocorrelation, unrolled into columns."""
    rho = autocorrelation(series, lags)
    wide = rho.groupBy("series").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("lag") == k, F.col("acf"))).alias(f"r{k}") for k in range(1, lags + 1)])
    for k in range(1, lags + 1):
        over = F.col(f"r{k}") - sum((F.col(f"p{k - 1}_{j}") * F.col(f"r{k - j}") for j in range(1, k)), F.lit(0.0))
        under = F.lit(1.0) - sum((F.col(f"p{k - 1}_{j}") * F.col(f"r{j}") for j in range(1, k)), F.lit(0.0))
        wide = wide.withColumn(f"p{k}_{k}", F.try_divide(over, under))
        wide = wide.withColumns({f"p{k}_{j}": F.col(f"p{k - 1}_{j}") - F.col(f"p{k}_{k}") * F.col(f"p{k - 1}_{k - j}") for j in range(1, k)}) if k > 1 else wide
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"p{k}_{k}").alias("pacf")) for k in range(1, lags + 1)])
    return wide.select("series", (1.96 / F.sqrt("n")).alias("band"), F.inline(rows)).select("series", "lag", "pacf", "band")
