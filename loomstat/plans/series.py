"""Queries of trends, change points, regression and dominance over monthly series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstat.functions.dist import normal_quantile
from loomstat.functions.text import child_seed, p_text, search_seed
from loomstat.operators import changepoint as P
from loomstat.operators import dominance as D
from loomstat.operators import measure as M
from loomstat.operators import regress as G
from loomstat.operators import resample as B
from loomstat.operators import trend as T
from loomstat.plans import inputs as I
from loomstat.plans.measurement import r6, replicates
from loomstat.session import cut

#: Onsets of the fixed mean-shift model in the queries.
ONSETS = [21, 48]


def pairwise_slopes(spark: SparkSession, root: str) -> DataFrame:
    return T.pairs(I.series(spark, root)).select("i", "j", *r6("slope"))


def sen_slope_ci(spark: SparkSession, root: str) -> DataFrame:
    return T.sen_slope(I.series(spark, root)).select("series", "N", *r6("sen_slope", "ci_lower", "ci_upper"))


def mann_kendall_s(spark: SparkSession, root: str) -> DataFrame:
    return T.mann_kendall(I.series(spark, root)).select("series", "S", "n", "n_pairs", F.round(F.col("variance").cast("double"), 6).alias("variance"), *r6("Z", "tau"))


def s_decomposition(spark: SparkSession, root: str) -> DataFrame:
    return T.s_decomposition(I.series(spark, root), [o - 1 for o in ONSETS]).drop("series")


def paired_slope_contrast(spark: SparkSession, root: str) -> DataFrame:
    return T.paired_contrast(I.series(spark, root, "rep"), I.series(spark, root, "dem")).select("n_pairs", *r6("paired_contrast", "difference_of_medians"))


def contrast_identity(spark: SparkSession, root: str) -> DataFrame:
    """That the parties' slopes differ by the slope of their gap."""
    s = I.reporting_series(spark, root)
    of = lambda n: s.where(F.col("series") == n)
    return T.contrast_identity(of("rep"), of("dem"), of("gap")).select("n_pairs", *r6("largest_difference"))


def quasi_differences(spark: SparkSession, root: str) -> DataFrame:
    """The gap without every seventh month, quasi-differenced."""
    return T.quasi_differences(I.series(spark, root).where("t % 7 <> 3"), 0.4).select("series", "t", "starts", *r6("q"))


def average_ranks(spark: SparkSession, root: str) -> DataFrame:
    """Ranks of the gap in whole points, with ties."""
    return T.average_ranks(I.series(spark, root).withColumn("y", F.bround("y"))).select("series", "t", *r6("y", "rank"))


def child_seeds(spark: SparkSession, root: str) -> DataFrame:
    """Seeds of named streams, whole and in 31 bits."""
    names = [f"stream_{i}" for i in range(20)]
    return spark.createDataFrame([(n, f"{child_seed(42, n):032x}", search_seed(42, n)) for n in names], "stream string, seed string, small_seed bigint")


def acf_bartlett(spark: SparkSession, root: str) -> DataFrame:
    return T.autocorrelation(I.series(spark, root)).select("lag", "n", *r6("acf", "band"), "outside")


def ljung_box_stat(spark: SparkSession, root: str) -> DataFrame:
    return T.ljung_box(I.series(spark, root), 8).select("series", *r6("Q"))


def regime_means_shifts(spark: SparkSession, root: str) -> DataFrame:
    return P.regime_means(I.series(spark, root), ONSETS).select("regime", "start_month", "end_month", "duration", *r6("regime_mean", "shift"))


def shift_model_bic_ar0(spark: SparkSession, root: str) -> DataFrame:
    return P.shift_model_ar0(I.series(spark, root), ONSETS).select("n", *r6("s2", "loglik", "joint_bic"))


def _dominance_panel(spark: SparkSession, root: str) -> DataFrame:
    return cut(I.gap(spark, root).groupBy("year_month").pivot("dimension", list(M.DIMENSIONS)).agg(F.first("polarization")))


def general_dominance(spark: SparkSession, root: str) -> DataFrame:
    return D.general_dominance_sql(_dominance_panel(spark, root), "q1", ("q2", "q3", "q4")).select("predictor", "n", *r6("contribution", "share", "correlation", "full_r2"))


def gap_regression_ar0(spark: SparkSession, root: str) -> DataFrame:
    p = I.panel(spark, root)
    return G.ols_ar0(p, "rep").unionByName(G.ols_ar0(p, "dem")).select("outcome", *r6("intercept", "polarization_slope", "time_slope"))


def leave_one_out_slope(spark: SparkSession, root: str) -> DataFrame:
    p = I.panel(spark, root)
    each = p.select(F.col("t").alias("omitted")).crossJoin(p).where("t <> omitted")  # months by months
    return each.groupBy("omitted").agg(F.regr_slope("rep", "polarization").alias("rep_slope"), F.regr_slope("dem", "polarization").alias("dem_slope")).select("omitted", *r6("rep_slope", "dem_slope"))


#: Lags of the reporting series.
LAGS = {"gap": 2, "rep": 2, "dem": 2, "index": 3}


def hamed_rao_test(spark: SparkSession, root: str) -> DataFrame:
    made = T.hamed_rao_tests(I.reporting_series(spark, root), lags=LAGS)
    return made.select("series", "n", F.col("S").cast("bigint").alias("S"), *r6("variance", "factor", "Z", "tau", "sen_slope"), "trend")


def trend_p_values(spark: SparkSession, root: str) -> DataFrame:
    """P-values of the same tests, as text."""
    return T.hamed_rao_tests(I.reporting_series(spark, root), lags=LAGS).select("series", "p_value", p_text(F.col("p_value")).alias("p_text"))


def partial_autocorrelation(spark: SparkSession, root: str) -> DataFrame:
    return T.partial_autocorrelations(I.series(spark, root)).select("series", "lag", *r6("pacf", "band"))


def cluster_bootstrap(spark: SparkSession, root: str) -> DataFrame:
    return B.cluster_bootstrap(I.long(spark, root), 5000)


def _values(series: DataFrame, name: str) -> list[float]:
    """The series of one calendar, for the search's own enumeration."""
    return [r["y"] for r in series.where((F.col("series") == name) & F.col("y").isNotNull()).orderBy("t").collect()]


def _months(series: DataFrame, name: str) -> list[str]:
    return [r["year_month"] for r in series.where((F.col("series") == name) & F.col("y").isNotNull()).orderBy("t").collect()]


def changepoint_search(spark: SparkSession, root: str) -> DataFrame:
    """The best configurations of the gap and of the index for regimes of at least 3, 4, 5 and 6 months."""
    s = I.reporting_series(spark, root)
    return P.search(spark, _values(s, "gap"), "gap").unionByName(P.search(spark, _values(s, "index"), "index"))


def changepoint_winners(spark: SparkSession, root: str) -> DataFrame:
    return P.winners(changepoint_search(spark, root)).select("series", "min_duration", "ar_order", "n_breakpoints", "onsets", *r6("loglik", "raw_bic", "objective"))


def trend_break_comparison(spark: SparkSession, root: str) -> DataFrame:
    return P.compare_classes(spark, _values(I.series(spark, root), "gap"), "gap")


def winner_refit(spark: SparkSession, root: str) -> DataFrame:
    """The best configuration of the gap fitted to its months: structural mean, innovations, regimes."""
    s = I.series(spark, root)
    best = P.winners(P.search(spark, _values(s, "gap"), "gap", durations=(6,))).first()
    return spark.createDataFrame(P.fitted_series(np.array(_values(s, "gap")), _months(s, "gap"), tuple(best["onsets"]), best["ar_order"]))


def breakpoint_coefficients(spark: SparkSession, root: str) -> DataFrame:
    """Coefficients of fixed onsets with a trend, with their conditional errors, at each order."""
    y = np.array(_values(I.series(spark, root), "gap"))
    return spark.createDataFrame(pd.concat([P.coefficient_table(y, tuple(ONSETS), p, True).assign(ar_order=p) for p in (0, 1, 2)]))


def endpoint_contrasts(spark: SparkSession, root: str) -> DataFrame:
    """Fitted last month minus first of these models, and checks of their innovations."""
    y = np.array(_values(I.series(spark, root), "gap"))
    return spark.createDataFrame(pd.DataFrame([{"ar_order": p, **P.endpoint_contrast(y, tuple(ONSETS), p, True), **P.diagnostics(y, tuple(ONSETS), p)} for p in (0, 1, 2)]))


#: Sets of onsets that are compared as they are.
CANDIDATES = {"none": [], "one": [48], "two": [21, 48], "three": [12, 21, 48], "four": [12, 21, 48, 60]}


def candidate_models(spark: SparkSession, root: str) -> DataFrame:
    models = spark.createDataFrame(list(CANDIDATES.items()), "model string, onsets array<int>")
    return P.candidate_models(I.series(spark, root), models).select("model", F.col("n").cast("bigint").alias("n"), "n_breakpoints", *r6("bic", "objective", "delta_bic", "delta_objective"))


def complete_panel(spark: SparkSession, root: str) -> DataFrame:
    """The panel's months in which both parties have a dispersion; errors start again after a gap."""
    return I.panel(spark, root).dropna()


def observed_fits(spark: SparkSession, root: str, orders: tuple[int, ...] = (0, 1)) -> list[tuple[int, dict, int]]:
    """(order, fit, months) of the observed panel."""
    panel = complete_panel(spark, root).toPandas().sort_values("t")  # one row a month
    y, x = G.panel_arrays(panel)
    return [(k, G.bivariate(y, x, k, panel["t"].to_numpy()), len(y)) for k in orders]


def bivariate_ar1(spark: SparkSession, root: str) -> DataFrame:
    ((_, f, n),) = observed_fits(spark, root, (1,))
    return spark.createDataFrame(G.coefficient_rows(f, n, ("republican", "democrat"), ("intercept", "polarization", "time")))


def regression_table_ar0(spark: SparkSession, root: str) -> DataFrame:
    return G.table_ar0(I.panel(spark, root)).select("outcome", "term", *r6("estimate", "standard_error", "t"), F.col("df").cast("bigint").alias("df"))


def residual_checks(spark: SparkSession, root: str) -> DataFrame:
    """Autocorrelation of both outcomes' innovations at order 1, and their correlation."""
    ((_, f, _),) = observed_fits(spark, root, (1,))
    return spark.createDataFrame(G.residual_diagnostics(f))


def influence(spark: SparkSession, root: str) -> DataFrame:
    """Refits without each month at the order with the smaller BIC."""
    return G.leave_one_out(complete_panel(spark, root), min(observed_fits(spark, root), key=lambda f: f[1]["bic"])[0])


#: Replicates of the production bootstrap.
REPLICATES = 5000


def replicate_regressions(spark: SparkSession, root: str) -> DataFrame:
    """Refits of every replicate that has all months of the observed panel."""
    months = complete_panel(spark, root).select("year_month")
    return G.replicate_regressions(B.replicate_panels(I.long(spark, root), "q1", REPLICATES).join(F.broadcast(months), "year_month", "left_semi"))  # a row a month


def replicate_effects(spark: SparkSession, root: str) -> DataFrame:
    """Effects over all replicates by order, and what the decision rule says of them."""
    made = cut(G.effects_summary(replicate_regressions(spark, root), REPLICATES, ["ar_order"]))
    names = F.create_map(F.lit("rep_polarization"), F.lit("republican"), F.lit("dem_polarization"), F.lit("democrat"))
    parts = [G.decision(made.where(F.col("ar_order") == k).select(names[F.col("effect")].alias("outcome"), F.col("mean").alias("estimate"), "ci_upper")).withColumn("ar_order", F.lit(k)) for k in (0, 1)]
    return made.join(parts[0].unionByName(parts[1]).select("ar_order", "supported", "same_sign"), "ar_order")


def _given_panels(spark: SparkSession, root: str) -> DataFrame:
    """Panels (replicate, t, polarization, rep, dem) of q1 out of the table of replicates, each month with both parties."""
    rows = replicates(spark, root).where("dimension = 'q1'")
    of = lambda c, p: F.max(F.when(F.col("party") == p, F.col(c)))
    wide = rows.groupBy("replicate", "year_month").agg((of("mean", "republican") - of("mean", "democrat")).alias("polarization"), of("raw_iqr", "republican").alias("rep"), of("raw_iqr", "democrat").alias("dem")).dropna()
    months = F.months_between(F.to_date(F.concat("year_month", F.lit("-01"))), F.lit("2020-01-01").cast("date"))
    return wide.withColumn("t", months.cast("int"))


def replicate_slope_summary(spark: SparkSession, root: str) -> DataFrame:
    """Slopes of both dispersions on the gap in every given replicate with 12 months or more, summarised."""
    panels = _given_panels(spark, root)
    enough = F.count(F.lit(1)).over(Window.partitionBy("replicate"))
    panels = panels.withColumn("n", enough).where("n >= 12")
    fits = G.ols_ar0(panels, "rep", ("replicate",)).unionByName(G.ols_ar0(panels, "dem", ("replicate",)))
    made = G.effects_summary(fits, 0, ["outcome"], ("polarization_slope",))
    return made.select("outcome", "n_valid", *r6("mean", "standard_error", "ci_lower", "ci_upper", "probability_negative"))


def _measurement_panels(spark: SparkSession, root: str, n: int) -> np.ndarray:
    """(panels, months, dimensions): the gaps of every replicate of the cluster bootstrap that has all of them."""
    wide = B.replicate_gaps(I.long(spark, root), n).toPandas().sort_values(["replicate", "year_month"])  # a row a month and replicate
    values = wide[list(M.DIMENSIONS)].to_numpy(float).reshape(-1, wide["year_month"].nunique(), len(M.DIMENSIONS))
    return values[np.isfinite(values).all(axis=(1, 2))]


def _dominance_draws(spark: SparkSession, root: str) -> DataFrame:
    rows = _dominance_panel(spark, root).orderBy("year_month").toPandas()  # one row a month
    observed = rows[list(M.DIMENSIONS)].to_numpy(float)[None]
    return D.stationary_bootstrap(spark, np.concatenate([observed, _measurement_panels(spark, root, REPLICATES)]))


def stationary_bootstrap(spark: SparkSession, root: str) -> DataFrame:
    return D.dominance_summary(_dominance_draws(spark, root))


def dominance_contrasts(spark: SparkSession, root: str) -> DataFrame:
    """Both contrasts with their joint band, by block length and layer."""
    return D.simultaneous_contrasts(_dominance_draws(spark, root))


def dominance_ranking(spark: SparkSession, root: str) -> DataFrame:
    found = D.ranking(D.general_dominance_sql(_dominance_panel(spark, root), "q1", ("q2", "q3", "q4")))
    return found.select("predictor", "place", *r6("contribution", "share_of_r2"))


_W = "WITH" + I.SQL
_Z = normal_quantile(0.025)
_REGIME = " + ".join(["1", *(f"CAST(t + 1 >= {o} AS INT)" for o in ONSETS)])
_STEP0 = " + ".join(f"CAST({{0}} + 1 >= {o} AS INT)" for o in ONSETS)
_MK = f"{_W}, s AS (SELECT CAST(sum(sign(y_j - y_i)) AS BIGINT) AS S, count(*) AS n_pairs FROM prs), ti AS (SELECT sum(k) AS n, sum(k * (k - 1) * (2 * k + 5)) AS tied FROM (SELECT count(*) AS k FROM series GROUP BY y)), mk AS (SELECT S, n_pairs, CAST(n AS BIGINT) AS n, CAST((n * (n - 1) * (2 * n + 5) - tied) / 18.0 AS DOUBLE) AS variance FROM s, ti)"
_ACF = f"{_W}, c AS (SELECT t, y - avg(y) OVER () AS a FROM series), v AS (SELECT sum(a * a) AS v, count(*) AS n FROM c), rho AS (SELECT CAST(lag AS INTEGER) AS lag, sum(x.a * z.a) / max(v) AS acf, max(n) AS n FROM (SELECT unnest(range(1, 9)) AS lag), c x, c z, v WHERE z.t = x.t + lag GROUP BY lag), band AS (SELECT *, 1.96 * sqrt((1 + 2 * coalesce(sum(acf * acf) OVER (ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) AS band FROM rho)"
_DOM_TWO = "((y{0} * y{0} + y{1} * y{1} - 2 * y{0} * y{1} * r{0}{1}) / (1 - r{0}{1} * r{0}{1}))"
ORACLE = {
    "pairwise_slopes": f"{_W} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(slope, 6) AS slope FROM prs",
    "mann_kendall_s": f"{_MK} SELECT 'gap' AS series, S, n, n_pairs, round(variance, 6) AS variance, round(CASE WHEN S > 0 THEN (S - 1) / sqrt(variance) WHEN S < 0 THEN (S + 1) / sqrt(variance) ELSE 0 END, 6) AS Z, round(S / n_pairs, 6) AS tau FROM mk",
    "sen_slope_ci": f"{_MK}, o AS (SELECT slope, row_number() OVER (ORDER BY slope) - 1 AS k FROM prs), b AS (SELECT n_pairs AS N, least(CAST(round_even((n_pairs - {_Z!r} * sqrt(variance)) / 2, 0) AS BIGINT), n_pairs - 1) AS up, greatest(CAST(round_even((n_pairs + {_Z!r} * sqrt(variance)) / 2, 0) AS BIGINT) - 1, 0) AS lo FROM mk) SELECT 'gap' AS series, N, (SELECT round(median(slope), 6) FROM prs) AS sen_slope, (SELECT round(slope, 6) FROM o WHERE k = lo) AS ci_lower, (SELECT round(slope, 6) FROM o WHERE k = up) AS ci_upper FROM b",
    "s_decomposition": f"{_W}, p AS (SELECT sign(y_j - y_i) AS s, CASE WHEN ({_STEP0.format('i')}) = ({_STEP0.format('j')}) THEN 'within_regime' ELSE 'between_regimes' END AS pair_category FROM prs) SELECT pair_category, count(*) FILTER (s > 0) AS positive, count(*) FILTER (s < 0) AS negative, count(*) FILTER (s = 0) AS ties, count(*) AS pairs, CAST(sum(s) AS BIGINT) AS s_contribution FROM p GROUP BY 1",
    "paired_slope_contrast": f"{_W}, r AS (SELECT row_number() OVER (ORDER BY year_month) - 1 AS t, round(rep_mean, 9) AS a, round(dem_mean, 9) AS b FROM gap WHERE dimension = 'q1'), d AS (SELECT (y.a - x.a) / (y.t - x.t) AS a, (y.b - x.b) / (y.t - x.t) AS b FROM r x JOIN r y ON x.t < y.t) SELECT count(*) AS n_pairs, round(median(a - b), 6) AS paired_contrast, round(median(a) - median(b), 6) AS difference_of_medians FROM d",
    "acf_bartlett": f"{_ACF} SELECT lag, n, round(acf, 6) AS acf, round(band, 6) AS band, abs(acf) > band AS outside FROM band WHERE lag <= 6",
    "ljung_box_stat": f"{_ACF} SELECT 'gap' AS series, round(max(n * (n + 2)) * sum(acf * acf / (n - lag)), 6) AS Q FROM rho",
    "regime_means_shifts": f"{_W}, r AS (SELECT {_REGIME} AS regime, min(year_month) AS start_month, max(year_month) AS end_month, count(*) AS duration, avg(y) AS m FROM series GROUP BY 1) SELECT CAST(regime AS INTEGER) AS regime, start_month, end_month, duration, round(m, 6) AS regime_mean, round(m - lag(m) OVER (ORDER BY regime), 6) AS shift FROM r",
    "shift_model_bic_ar0": f"{_W}, e AS (SELECT y - avg(y) OVER (PARTITION BY {_REGIME}) AS e FROM series), m AS (SELECT count(*) AS n, avg(e * e) AS s2 FROM e), l AS (SELECT *, -n / 2.0 * (ln(2 * pi() * s2) + 1) AS loglik FROM m) SELECT n, round(s2, 6) AS s2, round(loglik, 6) AS loglik, round(-2 * loglik + {2 * len(ONSETS) + 2} * ln(n), 6) AS joint_bic FROM l",
    "general_dominance": f"{_W}, w AS (SELECT year_month, " + ", ".join(f"max(rep_mean - dem_mean) FILTER (dimension = '{q}') AS {q}" for q in M.DIMENSIONS) + " FROM gap GROUP BY 1), r AS (SELECT corr(q1, q2) AS y0, corr(q1, q3) AS y1, corr(q1, q4) AS y2, corr(q2, q3) AS r01, corr(q2, q4) AS r02, corr(q3, q4) AS r12, count(*) AS n FROM w), "
    + f"t AS (SELECT *, {_DOM_TWO.format(0, 1)} AS d01, {_DOM_TWO.format(0, 2)} AS d02, {_DOM_TWO.format(1, 2)} AS d12, (y0 * y0 * (1 - r12 * r12) + y1 * y1 * (1 - r02 * r02) + y2 * y2 * (1 - r01 * r01) + 2 * y0 * y1 * (r02 * r12 - r01) + 2 * y0 * y2 * (r01 * r12 - r02) + 2 * y1 * y2 * (r01 * r02 - r12)) / (1 + 2 * r01 * r02 * r12 - r01 * r01 - r02 * r02 - r12 * r12) AS f FROM r), "
    + "g AS (SELECT 'q2' AS predictor, n, (y0 * y0 + (d01 - y1 * y1 + d02 - y2 * y2) / 2 + f - d12) / 3 AS c, y0 AS k, f FROM t UNION ALL SELECT 'q3', n, (y1 * y1 + (d01 - y0 * y0 + d12 - y2 * y2) / 2 + f - d02) / 3, y1, f FROM t UNION ALL SELECT 'q4', n, (y2 * y2 + (d02 - y0 * y0 + d12 - y1 * y1) / 2 + f - d01) / 3, y2, f FROM t) SELECT predictor, n, round(c, 6) AS contribution, round(c / f, 6) AS share, round(k, 6) AS correlation, round(f, 6) AS full_r2 FROM g",
    "gap_regression_ar0": f"{_W}, m AS (SELECT 'rep' AS outcome, avg(rep) AS b, covar_pop(polarization, polarization) AS pp, covar_pop(t, t) AS tt, covar_pop(polarization, t) AS pt, covar_pop(polarization, rep) AS py, covar_pop(t, rep) AS ty FROM panel UNION ALL SELECT 'dem', avg(dem), covar_pop(polarization, polarization), covar_pop(t, t), covar_pop(polarization, t), covar_pop(polarization, dem), covar_pop(t, dem) FROM panel) SELECT outcome, round(b, 6) AS intercept, round((py * tt - ty * pt) / (pp * tt - pt * pt), 6) AS polarization_slope, round((ty * pp - py * pt) / (pp * tt - pt * pt), 6) AS time_slope FROM m",
    "leave_one_out_slope": f"{_W} SELECT CAST(o.t AS INTEGER) AS omitted, round(regr_slope(p.rep, p.polarization), 6) AS rep_slope, round(regr_slope(p.dem, p.polarization), 6) AS dem_slope FROM panel o JOIN panel p ON o.t <> p.t GROUP BY 1",
}
_FOUR = (
    f"{_W}, four0 AS (SELECT * FROM series UNION ALL SELECT 'rep', year_month, row_number() OVER (ORDER BY year_month) - 1, round(rep_mean, 9) FROM gap WHERE dimension = 'q1' UNION ALL SELECT 'dem', year_month, row_number() OVER (ORDER BY year_month) - 1, round(dem_mean, 9) FROM gap WHERE dimension = 'q1' UNION ALL SELECT 'index', year_month, row_number() OVER (ORDER BY year_month) - 1, round(100 * cbrt(P * C_R * C_D), 9) FROM idx), four AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY year_month) - 1 AS t, y FROM four0 WHERE y IS NOT NULL), "
    "fp AS (SELECT a.series, a.t AS i, b.t AS j, a.y AS y_i, b.y AS y_j, (b.y - a.y) / (b.t - a.t) AS slope FROM four a JOIN four b ON a.series = b.series AND a.t < b.t), "
    "fs AS (SELECT series, CAST(sum(sign(y_j - y_i)) AS BIGINT) AS S, count(*) AS n_pairs, median(slope) AS sen_slope FROM fp GROUP BY 1), "
    "ft AS (SELECT series, CAST(sum(k) AS BIGINT) AS n, sum(k * (k - 1) * (2 * k + 5)) AS tied FROM (SELECT series, y, count(*) AS k FROM four GROUP BY 1, 2) GROUP BY 1), "
    "fv AS (SELECT *, CAST((n * (n - 1) * (2 * n + 5) - tied) / 18.0 AS DOUBLE) AS variance FROM fs JOIN ft USING (series)), "
    "fr0 AS (SELECT f.series, t, y - sen_slope * t AS rest FROM four f JOIN fs USING (series)), "
    "fr AS (SELECT series, t, rank() OVER (PARTITION BY series ORDER BY rest) + (count(*) OVER (PARTITION BY series, rest) - 1) / 2.0 AS r FROM fr0), "
    "fc AS (SELECT series, t, r - avg(r) OVER (PARTITION BY series) AS a FROM fr), "
    "fm AS (SELECT series, sum(a * a) AS v, count(*) AS n FROM fc GROUP BY 1), "
    "fa AS (SELECT x.series, z.t - x.t AS lag, sum(x.a * z.a) / max(v) AS rho, max(n) AS n FROM fc x JOIN fc z ON x.series = z.series AND z.t > x.t AND z.t <= x.t + CASE x.series WHEN 'index' THEN 3 ELSE 2 END JOIN fm ON fm.series = x.series GROUP BY 1, 2), "
    f"ff AS (SELECT series, 1 + 2 * coalesce(sum((n - lag) * (n - lag - 1) * (n - lag - 2) * rho) FILTER (abs(rho) > {-_Z!r} / sqrt(n)), 0) / max(n * (n - 1) * (n - 2)) AS factor FROM fa GROUP BY 1), "
    "fz AS (SELECT *, CASE WHEN S = 0 OR variance * factor <= 0 THEN 0 ELSE (S - sign(S)) / sqrt(variance * factor) END AS Z FROM fv JOIN ff USING (series))"
)
ORACLE["hamed_rao_test"] = f"{_FOUR} SELECT series, CAST(n AS INTEGER) AS n, S, round(variance, 6) AS variance, round(factor, 6) AS factor, round(Z, 6) AS Z, round(S / n_pairs, 6) AS tau, round(sen_slope, 6) AS sen_slope, CASE WHEN abs(Z) <= {-_Z!r} THEN 'no trend' WHEN S > 0 THEN 'increasing' ELSE 'decreasing' END AS trend FROM fz"


ORACLE["contrast_identity"] = f"{_W}, r AS (SELECT row_number() OVER (ORDER BY year_month) - 1 AS t, round(rep_mean, 9) AS a, round(dem_mean, 9) AS b, round(rep_mean - dem_mean, 9) AS g FROM gap WHERE dimension = 'q1'), d AS (SELECT abs((y.a - x.a) / (y.t - x.t) - (y.b - x.b) / (y.t - x.t) - (y.g - x.g) / (y.t - x.t)) AS d FROM r x JOIN r y ON x.t < y.t) SELECT count(*) AS n_pairs, round(max(d), 6) AS largest_difference FROM d"
ORACLE["quasi_differences"] = f"{_W}, k AS (SELECT *, lag(t) OVER (ORDER BY t) AS p, lag(y) OVER (ORDER BY t) AS py FROM series WHERE t % 7 <> 3) SELECT series, CAST(t AS INTEGER) AS t, coalesce(t - p > 1, true) AS starts, round(CASE WHEN coalesce(t - p > 1, true) THEN y * sqrt(1 - 0.4 * 0.4) ELSE y - 0.4 * py END, 6) AS q FROM k"
ORACLE["average_ranks"] = f"{_W}, k AS (SELECT series, t, round_even(y, 0) AS y FROM series WHERE y IS NOT NULL) SELECT series, CAST(t AS INTEGER) AS t, y, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS rank FROM k"
ORACLE["child_seeds"] = "WITH n AS (SELECT 'stream_' || i AS stream FROM range(20) t(i)), h AS (SELECT stream, left(sha256('loomstat-seed-1|42|' || stream), 32) AS seed FROM n) SELECT stream, seed, CAST(CAST('0x' || left(seed, 16) AS UBIGINT)::UHUGEINT * 18446744073709551616::UHUGEINT % 2147483646 + CAST('0x' || right(seed, 16) AS UBIGINT) % 2147483646 AS BIGINT) % 2147483646 + 1 AS small_seed FROM h"


def _pacf_sql(lags: int) -> str:
    sql = f"{_ACF}, l0 AS (SELECT max(n) AS n, " + ", ".join(f"max(acf) FILTER (lag = {k}) AS r{k}" for k in range(1, lags + 1)) + " FROM rho)"
    for k in range(1, lags + 1):
        over = f"r{k}" + "".join(f" - p{k - 1}_{j} * r{k - j}" for j in range(1, k))
        under = "1" + "".join(f" - p{k - 1}_{j} * r{j}" for j in range(1, k))
        sql += f", h{k} AS (SELECT *, ({over}) / ({under}) AS p{k}_{k} FROM l{k - 1}), l{k} AS (SELECT *" + "".join(f", p{k - 1}_{j} - p{k}_{k} * p{k - 1}_{k - j} AS p{k}_{j}" for j in range(1, k)) + f" FROM h{k})"
    return sql + " " + " UNION ALL ".join(f"SELECT 'gap' AS series, CAST({k} AS INTEGER) AS lag, round(p{k}_{k}, 6) AS pacf, round(1.96 / sqrt(n), 6) AS band FROM l{lags}" for k in range(1, lags + 1))


ORACLE["partial_autocorrelation"] = _pacf_sql(6)
_MODELS = " UNION ALL ".join(f"SELECT '{m}' AS model, {o or '[]::INTEGER[]'} AS onsets" for m, o in CANDIDATES.items())
ORACLE["candidate_models"] = f"{_W}, mods AS ({_MODELS}), e AS (SELECT model, len(onsets) AS m, len(list_filter(onsets, lambda o: o <= t + 1)) AS regime, y FROM series, mods), r AS (SELECT model, m, regime, var_pop(y) * count(y) AS rss, count(y) AS n FROM e GROUP BY 1, 2, 3), f AS (SELECT model, max(m) AS m, sum(rss) AS rss, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1), b AS (SELECT *, n * (ln(2 * pi() * rss / n) + 1) + (m + 2) * ln(n) AS bic FROM f), o AS (SELECT *, bic + m * ln(n) AS objective FROM b) SELECT model, n, CAST(m AS INTEGER) AS n_breakpoints, round(bic, 6) AS bic, round(objective, 6) AS objective, round(bic - min(bic) OVER (), 6) AS delta_bic, round(objective - min(objective) OVER (), 6) AS delta_objective FROM o"
_TERMS = (("intercept", "b0", "1.0"), ("polarization", "(py * tt - ty * pt) / det", "tt / det"), ("time", "(ty * pp - py * pt) / det", "pp / det"))
ORACLE["regression_table_ar0"] = f"{_W}, m0 AS (" + " UNION ALL ".join(f"SELECT '{o}' AS outcome, avg({o}) AS b0, covar_pop(polarization, polarization) AS pp, covar_pop(t, t) AS tt, covar_pop(polarization, t) AS pt, covar_pop(polarization, {o}) AS py, covar_pop(t, {o}) AS ty, var_pop({o}) AS yy, count(*) AS n FROM panel" for o in ("rep", "dem")) + "), m AS (SELECT *, pp * tt - pt * pt AS det FROM m0), v AS (SELECT *, yy - (py * tt - ty * pt) / det * py - (ty * pp - py * pt) / det * ty AS s2 FROM m), c AS (" + " UNION ALL ".join(f"SELECT outcome, '{t}' AS term, {b} AS b, sqrt(s2 * {i} / n) AS se, n FROM v" for t, b, i in _TERMS) + ") SELECT outcome, term, round(b, 6) AS estimate, round(se, 6) AS standard_error, round(b / se, 6) AS t, n - 3 AS df FROM c"
ORACLE["dominance_ranking"] = ORACLE["general_dominance"].rpartition(" SELECT predictor")[0] + " SELECT predictor, CAST(row_number() OVER (ORDER BY c DESC, predictor) AS INTEGER) AS place, round(c, 6) AS contribution, round(c / sum(c) OVER (), 6) AS share_of_r2 FROM g"
ORACLE["replicate_slope_summary"] = (
    "WITH reps AS (SELECT year_month, party, replicate, max(mean) AS m, max(raw_iqr) AS q FROM monthly_stance WHERE dimension = 'q1' GROUP BY ALL), c AS (SELECT year_month, party, replicate, CASE WHEN isnan(m) THEN NULL ELSE m END AS m, CASE WHEN isnan(q) THEN NULL ELSE q END AS q FROM reps), "
    "w AS (SELECT replicate, year_month, max(m) FILTER (party = 'republican') - max(m) FILTER (party = 'democrat') AS p, max(q) FILTER (party = 'republican') AS rep, max(q) FILTER (party = 'democrat') AS dem, (CAST(left(year_month, 4) AS INT) - 2020) * 12 + CAST(right(year_month, 2) AS INT) - 1 AS t FROM c GROUP BY 1, 2), "
    "k AS (SELECT * FROM w WHERE p IS NOT NULL AND rep IS NOT NULL AND dem IS NOT NULL AND replicate IS NOT NULL AND year_month IS NOT NULL QUALIFY count(*) OVER (PARTITION BY replicate) >= 12), "
    "l AS (SELECT replicate, 'rep' AS outcome, p, t, rep AS y FROM k UNION ALL SELECT replicate, 'dem', p, t, dem FROM k), "
    "f AS (SELECT replicate, outcome, covar_pop(p, p) AS pp, covar_pop(t, t) AS tt, covar_pop(p, t) AS pt, covar_pop(p, y) AS py, covar_pop(t, y) AS ty FROM l GROUP BY 1, 2), "
    "b AS (SELECT outcome, (py * tt - ty * pt) / (pp * tt - pt * pt) AS x FROM f) SELECT outcome, count(x) AS n_valid, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS standard_error, round(quantile_cont(x, 0.025), 6) AS ci_lower, round(quantile_cont(x, 0.975), 6) AS ci_upper, round(avg(CAST(x < 0 AS INT)), 6) AS probability_negative FROM b WHERE x IS NOT NULL GROUP BY 1"
)
ROWS_ONLY = (
    "trend_p_values", "cluster_bootstrap", "changepoint_search", "changepoint_winners", "trend_break_comparison", "winner_refit", "breakpoint_coefficients", "endpoint_contrasts",
    "bivariate_ar1", "residual_checks", "influence", "replicate_regressions", "replicate_effects", "stationary_bootstrap", "dominance_contrasts",
)
QUERIES = {name: globals()[name] for name in (*ORACLE, *ROWS_ONLY)}
