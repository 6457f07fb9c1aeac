"""Agreement of raters and validation of scores, from moments."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.dist import student_two_sided
from loomstat.operators.measure import group_quartiles
from loomstat.operators.resample import drawn

_MOMENTS = dict(n="count(x)", mx="avg(x)", my="avg(y)", vx="var_pop(x)", vy="var_pop(y)", cxy="covar_pop(x, y)")


def both_scored(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")


def inter_rater(df: DataFrame, x: str, y: str, within: float = 15) -> DataFrame:
    """Agreement on missing, pairs, r, MAE, RMSE, bias, share within a distance, and Lin's concordance."""
    na = df.agg(F.avg((F.col(x).isNull() == F.col(y).isNull()).cast("int")).alias("na_agreement"))
    d = F.col("x") - F.col("y")
    m = both_scored(df, x, y).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.corr("x", "y").alias("r"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias"), F.avg((F.abs(d) <= within).cast("int")).alias("within"),
        (2 * F.covar_pop("x", "y") / (F.var_pop("x") + F.var_pop("y") + F.pow(F.avg("x") - F.avg("y"), 2))).alias("ccc"),
    )
    return na.crossJoin(m)  # a row by a row


def icc_single(long: DataFrame, item: str, rater: str, value: str) -> DataFrame:
    """Two-way, absolute agreement, single rater, over items that all raters scored."""
    k = long.select(rater).distinct().agg(F.count(F.lit(1)).alias("k"))  # one row
    full = long.where(F.col(value).isNotNull()).select(F.col(item).alias("item"), F.col(rater).alias("rater"), F.col(value).cast("double").alias("v"))
    items = full.groupBy("item").agg(F.count(F.lit(1)).alias("m"), F.avg("v").alias("im"), F.sum(F.col("v") * F.col("v")).alias("ss")).join(F.broadcast(k), F.col("m") == F.col("k"))
    used = full.join(items.select("item"), "item", "left_semi")
    raters = used.groupBy("rater").agg(F.avg("v").alias("rm"))
    total = items.agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k"), F.avg("im").alias("g"), F.var_pop("im").alias("vi"), F.sum("ss").alias("ss"))
    both = total.crossJoin(raters.agg(F.var_pop("rm").alias("vr")))  # a row by a row
    out = both.withColumn("msr", F.expr("n * k * vi / (n - 1)")).withColumn("msc", F.expr("n * k * vr / (k - 1)"))
    out = out.withColumn("mse", F.expr("(ss - n * k * g * g - n * k * vi - n * k * vr) / ((n - 1) * (k - 1))"))
    return out.select("n", "k", F.expr("(msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n)").alias("icc"))


def within_item_sd(long: DataFrame, item: str, value: str) -> DataFrame:
    """Mean over items of the population standard deviation of their repeats."""
    return long.groupBy(item).agg(F.stddev_pop(value).alias("sd")).agg(F.count(F.lit(1)).alias("n_items"), F.avg("sd").alias("within_item_sd"))


def pairwise_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation of every two columns, from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    ok = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    aggs = [x for i, (a, b) in enumerate(pairs) for x in (F.corr(a, b).alias(f"r{i}"), F.count_if(ok(a, b)).alias(f"n{i}"))]
    rows = F.array(*[F.struct(F.lit(a).alias("dimension_1"), F.lit(b).alias("dimension_2"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("pearson_r")) for i, (a, b) in enumerate(pairs)])
    return df.agg(*aggs).select(F.explode(rows).alias("x")).select("x.*")


def correlation_p(r: float, n: int) -> float:
    return 0.0 if abs(r) >= 1 else student_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def ttest_moments(df: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """Student's and Welch's t and degrees of freedom of two groups."""
    of = lambda f, g: f(F.when(F.col(group) == g, F.col(value)))
    m = df.agg(*[of(f, g).alias(f"{n}{s}") for f, n in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v")) for g, s in ((a, "1"), (b, "2"))])
    pooled = "((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)"
    return m.select("n1", "n2", "m1", "m2", F.expr(f"(m1 - m2) / sqrt({pooled} * (1.0 / n1 + 1.0 / n2))").alias("t_student"), F.expr("(m1 - m2) / sqrt(v1 / n1 + v2 / n2)").alias("t_welch"), F.expr("pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1))").alias("df_welch"))


def scale_usage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Range, mean, deviation and missing share of each score."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "dimension", "x")
    return long.groupBy("dimension").agg(F.min("x").alias("lowest"), F.max("x").alias("highest"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.avg(F.isnull("x").cast("int")).alias("na_rate"))


def spread_by_group(df: DataFrame, group: str, value: str, minimum: int = 5) -> DataFrame:
    """Count, mean and deviation of groups with enough rows."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).where(F.col("n_rows") >= minimum)


def exact_agreement(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Share of common keys on which two runs agree exactly, by column; null agrees with null."""
    both = a.alias("a").join(b.alias("b"), key)
    rows = both.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")).cast("int")).alias(c) for c in columns])
    return rows.unpivot("n", columns, "dimension", "agreement")


def describe(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles by group."""
    rows = df.select(group, F.col(value).cast("double").alias("x"))
    moments = rows.groupBy(group).agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("lowest"), F.max("x").alias("highest"))
    return moments.join(group_quartiles(rows, [group], "x"), group).select(group, "n", "mean", "sd", "lowest", "q25", "median", "q75", "highest")


def shares(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value, null included, and their share of all."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))  # a row for each value


def artifact_checks(df: DataFrame, text: str, score: str, token: str) -> DataFrame:
    """Mean score of texts with and without the token, and the correlation of score and length."""
    masked = F.contains(F.col(text), F.lit(token))
    return df.agg(
        F.count(F.when(masked, F.col(score))).alias("n_masked"), F.count(F.when(~masked, F.col(score))).alias("n_unmasked"),
        F.avg(F.when(masked, F.col(score))).alias("mean_masked"), F.avg(F.when(~masked, F.col(score))).alias("mean_unmasked"), F.corr(score, F.length(text)).alias("length_correlation"),
    )


def agreement_bootstrap(df: DataFrame, cluster: str, x: str, y: str, replicates: int) -> DataFrame:
    """(statistic, n_replicates, mean, ci_lower, ci_upper) of the bias and the mean absolute difference, drawing clusters whole."""
    rows = df.select(cluster, (F.col(x) - F.col(y)).cast("double").alias("d"))
    each = drawn(rows, cluster, ["d"], replicates).groupBy("replicate").agg(F.expr("sum(c * d) / sum(c)").alias("bias"), F.expr("sum(c * abs(d)) / sum(c)").alias("mae"))
    long = each.unpivot(["replicate"], ["bias", "mae"], "statistic", "v")
    p = F.percentile("v", F.array(F.lit(0.025), F.lit(0.975)))
    return long.groupBy("statistic").agg(F.count("v").alias("n_replicates"), F.avg("v").alias("mean"), p[0].alias("ci_lower"), p[1].alias("ci_upper"))


def with_p(tests: DataFrame) -> DataFrame:
    """The single row of ``ttest_moments`` with two-sided p-values."""
    r = tests.first()
    return tests.withColumns({"p_student": F.lit(student_two_sided(r["t_student"], r["n1"] + r["n2"] - 2)), "p_welch": F.lit(student_two_sided(r["t_welch"], r["df_welch"]))})
