"""The tables for publication out of the series' results, their export, and a run that writes all measures."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.operators import dominance as D
from loomstat.operators import measure as M
from loomstat.operators import regress as G
from loomstat.operators import report as R
from loomstat.operators import resample as B
from loomstat.operators import trend as T
from loomstat.plans import inputs as I
from loomstat.plans import measurement as P
from loomstat.plans import series as Q
from loomstat.session import cut
from loomstat.sources import files as S


def _trends(spark: SparkSession, root: str) -> DataFrame:
    s = I.reporting_series(spark, root)
    tests = T.hamed_rao_tests(s, lags=Q.LAGS)
    sen = T.sen_slope(s.where("y is not null")).select("series", "ci_lower", "ci_upper")
    lag = F.coalesce(F.create_map(*[F.lit(x) for kv in Q.LAGS.items() for x in kv])[F.col("series")], F.lit(2))
    return tests.join(sen, "series").withColumn("lag", lag).withColumn("corrected", F.col("variance") * F.col("factor")).orderBy("series")


def _structural(spark: SparkSession, root: str) -> DataFrame:
    return Q.changepoint_winners(spark, root).withColumn("delta", F.col("objective") - F.expr("min(objective) over (partition by series)")).orderBy("series", "min_duration")


def _regression_models(spark: SparkSession, root: str) -> DataFrame:
    fits = [(k, f) for k, f, _ in Q.observed_fits(spark, root)]
    best = min(f["bic"] for _, f in fits)
    return spark.createDataFrame([(k, float(f["phi"]), float(f["loglik"]), float(f["bic"]), float(f["bic"] - best), bool(f["bic"] == best)) for k, f in fits], "ar_order int, phi double, loglik double, bic double, delta_bic double, selected boolean")


def _coefficients(spark: SparkSession, root: str) -> DataFrame:
    rows = [G.coefficient_rows(f, n, M.PARTIES, ("intercept", "polarization", "time")).assign(ar_order=k) for k, f, n in Q.observed_fits(spark, root)]
    both = spark.createDataFrame(rows[0]).unionByName(spark.createDataFrame(rows[1]))
    made = Q.replicate_effects(spark, root)
    names = F.create_map(*[F.lit(x) for kv in {"rep_polarization": "republican", "dem_polarization": "democrat", "contrast": "contrast"}.items() for x in kv])
    measured = made.select("ar_order", names[F.col("effect")].alias("outcome"), F.lit("polarization").alias("term"), F.col("mean").alias("measurement_mean"), F.col("ci_lower").alias("measurement_lower"), F.col("ci_upper").alias("measurement_upper"))
    return cut(both.join(measured, ["ar_order", "outcome", "term"], "left")).orderBy("ar_order", "outcome", "term")


def _dominance(spark: SparkSession, root: str) -> DataFrame:
    return D.ranking(D.general_dominance_sql(Q._dominance_panel(spark, root), "q1", ("q2", "q3", "q4"))).orderBy("place")


def _regimes(spark: SparkSession, root: str) -> DataFrame:
    return Q.regime_means_shifts(spark, root).orderBy("regime")


_CI = "ci_lower ci_upper"
#: Each table with what makes its rows.
TABLES: dict[str, tuple[R.Table, Callable[[SparkSession, str], DataFrame]]] = {
    "trends": (R.Table("Trend tests of the reporting series", (("Series", "text", "series"), ("n", "int", "n"), ("Lag", "int", "lag"), ("S", "int", "S"), ("Var(S)", "number", "variance"), ("Var(S), corrected", "number", "corrected"), ("Factor", "number", "factor"), ("Z", "number", "Z"), ("tau", "number", "tau"), ("p", "p", "p_value"), ("Sen slope", "number", "sen_slope"), ("95% CI", "interval", _CI))), _trends),
    "structural_models": (R.Table("Best structural model of each series and least duration", (("Series", "text", "series"), ("Least duration", "int", "min_duration"), ("AR", "int", "ar_order"), ("Breaks", "int", "n_breakpoints"), ("Onsets", "list", "onsets"), ("Objective", "number", "objective"), ("Delta", "number", "delta"))), _structural),
    "regression_models": (R.Table("Error structures of the regression", (("AR order", "int", "ar_order"), ("phi", "number", "phi"), ("Log likelihood", "number", "loglik"), ("BIC", "number", "bic"), ("Delta BIC", "number", "delta_bic"), ("Selected", "yes", "selected"))), _regression_models),
    "regression_coefficients": (R.Table("Coefficients by party", (("AR", "int", "ar_order"), ("Party", "text", "outcome"), ("Term", "plain", "term"), ("Estimate", "number", "estimate"), ("SE", "number", "standard_error"), ("p", "p", "p_two_sided"), ("95% CI", "interval", _CI), ("Measurement mean", "number", "measurement_mean"), ("Measurement interval", "interval", "measurement_lower measurement_upper"))), lambda s, r: _coefficients(s, r).where("outcome <> 'contrast'")),
    "regression_contrasts": (R.Table("Contrast of the parties", (("AR", "int", "ar_order"), ("Estimate", "number", "estimate"), ("p", "p", "p_two_sided"), ("95% CI", "interval", _CI), ("Measurement mean", "number", "measurement_mean"), ("Measurement interval", "interval", "measurement_lower measurement_upper"))), lambda s, r: _coefficients(s, r).where("outcome = 'contrast'")),
    "dominance_observed": (R.Table("General dominance", (("Predictor", "text", "predictor"), ("Contribution", "number", "contribution"), ("% of R squared", "percent", "share_of_r2"), ("Correlation", "number", "correlation"), ("R squared", "number", "full_r2"))), _dominance),
    "dominance_contrasts": (R.Table("Contrasts of q4 with a joint band", (("Block", "int", "block_length"), ("Layer", "text", "layer"), ("q4 - q2", "number", "q4_minus_q2"), ("q4 - q3", "number", "q4_minus_q3"), ("Radius", "number", "radius"), ("Both positive", "yes", "both_positive"))), lambda s, r: Q.dominance_contrasts(s, r).orderBy("block_length", "layer")),
    "dominance_blocks": (R.Table("Dominance by block length", (("Block", "int", "block_length"), ("Layer", "text", "layer"), ("Statistic", "plain", "statistic"), ("Mean", "number", "mean"), ("SE", "number", "standard_error"), ("95% interval", "interval", _CI), ("Pr(positive)", "number", "probability_positive"))), lambda s, r: Q.stationary_bootstrap(s, r).orderBy("block_length", "layer", "statistic")),
    "trend_break_models": (R.Table("Trend, breaks or both", (("Least duration", "int", "min_duration"), ("Model", "text", "model_class"), ("AR", "int", "ar_order"), ("Breaks", "int", "n_breakpoints"), ("Onsets", "list", "onsets"), ("Objective", "number", "objective"), ("Delta", "number", "delta"), ("Selected", "yes", "selected"))), lambda s, r: Q.trend_break_comparison(s, r).orderBy("min_duration", "model_class")),
    "trend_break_coefficients": (R.Table("Coefficients of breaks with a trend", (("AR", "int", "ar_order"), ("Term", "plain", "term"), ("Estimate", "number", "estimate"), ("SE", "number", "standard_error"), ("p", "p", "p_two_sided"), ("95% CI", "interval", _CI))), lambda s, r: Q.breakpoint_coefficients(s, r).orderBy("ar_order", "term")),
    "endpoint_contrasts": (R.Table("Last month minus first", (("AR", "int", "ar_order"), ("Estimate", "number", "estimate"), ("SE", "number", "standard_error"), ("Ljung-Box p, lag 8", "p", "p8"))), lambda s, r: Q.endpoint_contrasts(s, r).orderBy("ar_order")),
    "s_decomposition": (R.Table("S within and between regimes", (("Pairs of", "text", "pair_category"), ("Positive", "int", "positive"), ("Negative", "int", "negative"), ("Ties", "int", "ties"), ("Pairs", "int", "pairs"), ("S", "int", "s_contribution"))), lambda s, r: Q.s_decomposition(s, r).orderBy("pair_category")),
    "candidate_models": (R.Table("Given sets of onsets", (("Model", "text", "model"), ("Breaks", "int", "n_breakpoints"), ("BIC", "number", "bic"), ("Objective", "number", "objective"), ("Delta BIC", "number", "delta_bic"))), lambda s, r: Q.candidate_models(s, r).orderBy("n_breakpoints")),
    "regimes": (R.Table("Regimes", (("Regime", "int", "regime"), ("Start", "plain", "start_month"), ("End", "plain", "end_month"), ("Months", "int", "duration"), ("Mean", "number", "regime_mean"), ("Shift", "number", "shift"))), _regimes),
}


def write_tables(spark: SparkSession, root: str, folder: str, names: tuple[str, ...] = tuple(TABLES)) -> str:
    """Each table in full precision as CSV (lists with bars), and one JSON file with all of them as text; returns its path."""
    out = {}
    for name in names:
        table, make = TABLES[name]
        df = cut(make(spark, root))
        flat = df.select(*[F.array_join(c.cast("array<string>"), "|").alias(n) if t.startswith("array") else c for (n, t), c in ((x, F.col(x[0])) for x in df.dtypes)])
        S.write_csv(flat.coalesce(1), f"{folder}/{name}")
        out[name] = table.blueprint(df)
    path = f"{folder}/tables.json"
    Path(path).write_text(json.dumps(out, indent=1), encoding="utf-8")
    return path


def table_trends(spark: SparkSession, root: str) -> DataFrame:
    """The first table as text."""
    table, make = TABLES["trends"]
    return table.formatted(make(spark, root))


def table_s_decomposition(spark: SparkSession, root: str) -> DataFrame:
    table, make = TABLES["s_decomposition"]
    return table.formatted(make(spark, root))


def table_dominance(spark: SparkSession, root: str) -> DataFrame:
    table, make = TABLES["dominance_observed"]
    return table.formatted(make(spark, root))


def trajectory(spark: SparkSession, root: str) -> DataFrame:
    """Both parties' monthly means of q1 with their intervals, ready to draw."""
    keys = ["year_month", "party", "dimension"]
    long = I.written_long(spark, root).where("dimension = 'q1'")
    return R.trajectory(M.monthly_stance(long), P.mean_intervals(long)).select(*keys, *P.r6("mean", "ci_lower", "ci_upper"), "n_articles")


def measurement_run(spark: SparkSession, root: str, folder: str, replicates: int = 5000, seed: int = 42, namespace: str = "joint_article_cluster") -> dict:
    """All measures, replicates and intervals in a folder, with a record of what went in and came out; returns the record.

    The index is recalibrated in each replicate. The run id depends on the inputs and settings alone.
    """
    keys = ["year_month", "party", "dimension"]
    stance = cut(I.stance(spark, root))
    made = cut(B.cluster_bootstrap(I.long(spark, root), replicates, seed, namespace))
    gaps = M.monthly_polarization(stance)
    index = cut(M.composite_index(stance))
    tables = {
        "replicates": made,
        "stance": B.attach(stance, M.percentile_interval(made, keys, "mean", replicates), keys),
        "polarization": gaps,
        "coherence": M.message_coherence_long(index),
        "index": B.attach(index, M.index_intervals(made, replicates), ["year_month"]),
    }
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    record = S.lineage(spark, {"lineitem": f"{root}/lineitem.parquet", "orders": f"{root}/orders.parquet"}, {n: f"{folder}/{n}" for n in tables}, replicates=replicates, seed=seed, namespace=namespace)
    Path(f"{folder}/run.json").write_text(json.dumps(record, indent=1, sort_keys=True), encoding="utf-8")
    return record


ORACLE = {
    "table_s_decomposition": "WITH d AS (" + Q.ORACLE["s_decomposition"] + ") SELECT CASE pair_category WHEN 'within_regime' THEN 'Within Regime' ELSE 'Between Regimes' END AS \"Pairs of\", " + ", ".join(f"CAST({c} AS VARCHAR) AS \"{label}\"" for label, c in (("Positive", "positive"), ("Negative", "negative"), ("Ties", "ties"), ("Pairs", "pairs"), ("S", "s_contribution"))) + " FROM d",
    "table_dominance": Q.ORACLE["general_dominance"].rpartition(" SELECT predictor")[0] + " SELECT upper(left(predictor, 1)) || substr(predictor, 2) AS \"Predictor\", " + ", ".join(f"printf('%.{n}f', {c}) AS \"{label}\"" for label, c, n in (("Contribution", "c", 6), ("% of R squared", "100 * c / sum(c) OVER ()", 3), ("Correlation", "k", 6), ("R squared", "f", 6))) + " FROM g",
}
ORACLE["trajectory"] = f"{P._DRAWN}, ci AS (SELECT year_month, party, dimension, {P._CI('mean', P.REPLICATES)} FROM means WHERE dimension = 'q1' GROUP BY 1, 2, 3) SELECT year_month, party, dimension, round(mean, 6) AS mean, ci_lower, ci_upper, n_articles FROM stance LEFT JOIN ci USING (year_month, party, dimension) WHERE dimension = 'q1'"
ROWS_ONLY = ("table_trends",)
QUERIES = {name: globals()[name] for name in (*ORACLE, *ROWS_ONLY)}
