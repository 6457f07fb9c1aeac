"""The measurement inputs that the queries share, from the star schema: a line item is a scored sentence of its order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstat.operators import measure as M
from loomstat.operators import trend as T
from loomstat.session import cut, read_table


def scored(spark: SparkSession, root: str) -> DataFrame:
    """(article, row_no, party, year_month, q1..q4) of every line item."""
    items, orders = read_table(spark, root, "lineitem"), read_table(spark, root, "orders")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        F.col("l_orderkey").alias("article"),
        F.col("l_linenumber").alias("row_no"),
        F.when(F.col("l_linestatus") == "O", F.lit("republican")).when(F.col("l_linestatus") == "F", F.lit("democrat")).alias("party"),
        F.date_format("o_orderdate", "yyyy-MM").alias("year_month"),
        F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("q1"),
        (F.col("l_discount") * 100).alias("q2"),
        F.when(F.col("l_tax") > 0, F.col("l_tax") * 1000).alias("q3"),
        (F.col("l_extendedprice") / 1000).alias("q4"),
    )


def rollup(spark: SparkSession, root: str) -> DataFrame:
    return M.article_party_rollup(scored(spark, root))


def long(spark: SparkSession, root: str) -> DataFrame:
    return M.unpivot_dimensions(rollup(spark, root))


def written_long(spark: SparkSession, root: str) -> DataFrame:
    """The same, for operators that read it more than once."""
    return M.unpivot_dimensions(cut(rollup(spark, root)))


def stance(spark: SparkSession, root: str) -> DataFrame:
    return M.monthly_stance(written_long(spark, root))


def gap(spark: SparkSession, root: str) -> DataFrame:
    """Gaps without the interquartile range, which the series don't need."""
    means = long(spark, root).groupBy("year_month", "party", "dimension").agg(M.weighted_mean().alias("mean"), F.count("score").alias("n_articles"))
    return M.monthly_polarization(means)


def series(spark: SparkSession, root: str, name: str = "gap") -> DataFrame:
    """Gap, or a party's mean, of q1 by month."""
    column = {"gap": "polarization", "rep": "rep_mean", "dem": "dem_mean"}[name]
    return cut(T.as_series(gap(spark, root).where("dimension = 'q1'").withColumn("v", F.round(column, 9)), name, "v"))


def reporting_series(spark: SparkSession, root: str) -> DataFrame:
    """The gap, both parties' means and the index, by month: one stance for all four."""
    s = cut(stance(spark, root))
    gaps = M.monthly_polarization(s).where("dimension = 'q1'")
    made = [T.as_series(gaps.withColumn("v", F.round(c, 9)), name, "v") for name, c in (("gap", "polarization"), ("rep", "rep_mean"), ("dem", "dem_mean"))]
    made.append(T.as_series(M.composite_index(s).withColumn("v", F.round("index_value", 9)), "index", "v"))
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return cut(out)


def panel(spark: SparkSession, root: str) -> DataFrame:
    """(t, year_month, polarization, rep, dem): the gap of q1 with both parties' dispersion."""
    wide = M.composite_index(stance(spark, root))
    t = (F.row_number().over(Window.orderBy("year_month")) - 1).alias("t")  # one calendar
    return cut(wide.select(t, "year_month", F.round("polarization", 9).alias("polarization"), F.round("rep_raw_iqr", 9).alias("rep"), F.round("dem_raw_iqr", 9).alias("dem")))


#: The same inputs as common table expressions.
SQL = """
scored AS (SELECT l_orderkey AS article, l_linenumber AS row_no, CASE l_linestatus WHEN 'O' THEN 'republican' WHEN 'F' THEN 'democrat' END AS party, strftime(o_orderdate, '%Y-%m') AS year_month,
  CASE WHEN l_quantity <= 45 THEN l_quantity END AS q1, l_discount * 100 AS q2, CASE WHEN l_tax > 0 THEN l_tax * 1000 END AS q3, l_extendedprice / 1000 AS q4 FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
rollup AS (SELECT article, party, min(year_month) AS year_month, ln(1 + count(*)) AS weight, avg(q1) AS q1_score, nullif(count(q1), 0) AS q1_n, avg(q2) AS q2_score, nullif(count(q2), 0) AS q2_n, avg(q3) AS q3_score, nullif(count(q3), 0) AS q3_n, avg(q4) AS q4_score, nullif(count(q4), 0) AS q4_n
  FROM scored WHERE article IS NOT NULL AND party IS NOT NULL GROUP BY article, party),
long AS (SELECT article, party, year_month, weight, 'q1' AS dimension, q1_score AS score FROM rollup UNION ALL SELECT article, party, year_month, weight, 'q2', q2_score FROM rollup UNION ALL SELECT article, party, year_month, weight, 'q3', q3_score FROM rollup UNION ALL SELECT article, party, year_month, weight, 'q4', q4_score FROM rollup),
stance AS (SELECT year_month, party, dimension, sum(weight * score) FILTER (score IS NOT NULL) / sum(weight) FILTER (score IS NOT NULL) AS mean, CASE WHEN count(score) >= 4 THEN quantile_cont(score, 0.75) - quantile_cont(score, 0.25) END AS raw_iqr, count(score) AS n_articles FROM long GROUP BY year_month, party, dimension),
gap AS (SELECT year_month, dimension, max(mean) FILTER (party = 'republican') AS rep_mean, max(mean) FILTER (party = 'democrat') AS dem_mean, max(n_articles) FILTER (party = 'republican') AS rep_n, max(n_articles) FILTER (party = 'democrat') AS dem_n FROM stance GROUP BY year_month, dimension),
wide AS (SELECT year_month, max(mean) FILTER (party = 'republican') AS rep_mean, max(mean) FILTER (party = 'democrat') AS dem_mean, max(raw_iqr) FILTER (party = 'republican') AS rep_raw_iqr, max(raw_iqr) FILTER (party = 'democrat') AS dem_raw_iqr, max(n_articles) FILTER (party = 'republican') AS rep_n_articles, max(n_articles) FILTER (party = 'democrat') AS dem_n_articles FROM stance WHERE dimension = 'q1' GROUP BY year_month),
scales AS (SELECT (SELECT max(abs(rep_mean - dem_mean)) FROM wide) AS max_pol_used, (SELECT median(i) FROM (SELECT rep_raw_iqr AS i FROM wide UNION ALL SELECT dem_raw_iqr FROM wide)) AS k_used),
idx AS (SELECT *, rep_mean - dem_mean AS polarization, abs(rep_mean - dem_mean) / max_pol_used AS P, k_used / (k_used + rep_raw_iqr) AS C_R, k_used / (k_used + dem_raw_iqr) AS C_D FROM wide, scales),
series AS (SELECT 'gap' AS series, year_month, row_number() OVER (ORDER BY year_month) - 1 AS t, round(rep_mean - dem_mean, 9) AS y FROM gap WHERE dimension = 'q1'),
prs AS (SELECT a.t AS i, b.t AS j, a.y AS y_i, b.y AS y_j, (b.y - a.y) / (b.t - a.t) AS slope FROM series a JOIN series b ON a.t < b.t),
panel AS (SELECT row_number() OVER (ORDER BY year_month) - 1 AS t, year_month, round(polarization, 9) AS polarization, round(rep_raw_iqr, 9) AS rep, round(dem_raw_iqr, 9) AS dem FROM idx)
"""
