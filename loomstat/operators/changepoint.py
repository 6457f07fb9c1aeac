"""Mean-shift models with autoregressive errors, and their search by enumeration.

The likelihood is the exact Gaussian one. For given autoregressive coefficients
the regression is least squares on whitened data, so only these coefficients are
searched. All sets of change points are tried instead of a random search: each
coefficient needs one Gram matrix of the step columns, and each set solves a
small part of it. Sets are spread over tasks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstat.functions.dist import student_quantile, student_two_sided
from loomstat.operators.trend import acf, ljung_box_p
from loomstat.session import map_frames


def whiten(m: np.ndarray, phi: tuple[float, ...]) -> tuple[np.ndarray, float]:
    """Rows turned into innovations of unit scale, and the log determinant that goes with it."""
    m = np.asarray(m, float)
    u = m.copy()
    if len(phi) == 0:
        return u, 0.0
    if len(phi) == 1:
        (a,) = phi
        g = 1 / (1 - a * a)
        u[1:] = m[1:] - a * m[:-1]
        u[0] = m[0] / math.sqrt(g)
        return u, math.log(g)
    a, b = phi
    g = (1 - b) / ((1 + b) * ((1 - b) ** 2 - a * a))
    r = a / (1 - b)
    g1 = g * (1 - r * r)
    u[2:] = m[2:] - a * m[1:-1] - b * m[:-2]
    u[0] = m[0] / math.sqrt(g)
    u[1] = (m[1] - r * m[0]) / math.sqrt(g1)
    return u, math.log(g) + math.log(g1)


def design(n: int, taus: tuple[int, ...], trend: bool = False) -> np.ndarray:
    """Intercept, step at each (1-based) onset, and a centred time if wanted."""
    t = np.arange(1, n + 1)
    columns = [np.ones(n), *[(t >= tau).astype(float) for tau in taus]]
    return np.column_stack([*columns, *([t - t.mean()] if trend else [])])


def _profile(y: np.ndarray, x: np.ndarray, phi: tuple[float, ...]) -> tuple[float, np.ndarray, float, np.ndarray]:
    uy, log_det = whiten(y, phi)
    ux, _ = whiten(x, phi)
    beta, *_ = np.linalg.lstsq(ux, uy, rcond=None)
    u = uy - ux @ beta
    s2 = float(u @ u) / len(y)
    return -len(y) / 2 * (math.log(2 * math.pi * max(s2, 1e-300)) + 1) - log_det / 2, beta, s2, u


def _stationary(phi: tuple[float, ...]) -> bool:
    if len(phi) == 1:
        return abs(phi[0]) < 0.999
    return len(phi) == 0 or (abs(phi[1]) < 0.999 and phi[0] + phi[1] < 0.999 and phi[1] - phi[0] < 0.999)


def grid(p: int, step: float = 0.1) -> list[tuple[float, ...]]:
    values = np.round(np.arange(-0.95, 0.96, step), 6) if p == 1 else np.round(np.arange(-1.9, 1.91, 2 * step), 6)
    return [()] if p == 0 else [x for x in itertools.product(*([values] if p == 1 else [values, np.round(np.arange(-0.9, 0.91, 2 * step), 6)])) if _stationary(x)]


def fit(y: np.ndarray, taus: tuple[int, ...], p: int, trend: bool = False) -> dict:
    """Maximum likelihood: the best point of a grid, refined by a pattern search."""
    x = design(len(y), taus, trend)
    best = max(grid(p), key=lambda f: _profile(y, x, f)[0])
    step, value = 0.05, _profile(y, x, best)[0]
    while step > 1e-7 and p:
        moves = [tuple(b + d * step for b, d in zip(best, m)) for m in itertools.product((-1, 0, 1), repeat=p) if any(m)]
        scored = [(_profile(y, x, m)[0], m) for m in moves if _stationary(m)]
        top = max(scored, default=(value, best))
        if top[0] > value + 1e-13:
            value, best = top
        else:
            step /= 2
    loglik, beta, s2, u = _profile(y, x, best)
    n, k = len(y), len(beta) + p + 1
    ux, _ = whiten(x, best)
    cov = s2 * np.linalg.pinv(ux.T @ ux)
    bic = -2 * loglik + k * math.log(n)
    return {"phi": best, "beta": beta, "s2": s2, "innovation": u / math.sqrt(s2), "loglik": loglik, "bic": bic, "objective": bic + len(taus) * math.log(n), "cov": cov, "mean": x @ beta}


def shortest_regime(onsets: tuple[int, ...], n: int) -> int:
    """Months of the shortest regime."""
    at = (1, *onsets, n + 1)
    return min(b - a for a, b in zip(at, at[1:]))


def valid_onsets(onsets: tuple[int, ...], n: int, least: int) -> bool:
    """Whether 1-based onsets are in order, each once, with regimes of at least ``least`` months."""
    return list(onsets) == sorted(set(onsets)) and shortest_regime(onsets, n) >= least


def suggested_onsets(n: int, least: int, most: int = 4) -> list[tuple[int, ...]]:
    """Evenly spaced onsets for each number of them that the least duration allows; halves go to the even month."""
    even = [tuple(round(1 + k * n / (m + 1)) for k in range(1, m + 1)) for m in range(min(most, n // least - 1) + 1)]
    return [t for t in even if valid_onsets(t, n, least)]


def search(spark: SparkSession, y: list[float], name: str, durations: tuple[int, ...] = (3, 4, 5, 6), most: int = 4, orders: tuple[int, ...] = (0, 1, 2), keep: int = 20, trend: bool = False) -> DataFrame:
    """The ``keep`` best configurations of one series for each least duration of a regime: every set of onsets and order is tried.

    Likelihoods come from a grid of coefficients first; of each task's sets the ``keep`` best for each duration and order are
    refined. The result has the objective BIC + m ln n, as whether an onset is searched costs its place too.
    """
    n, least = len(y), min(durations)
    v = np.array(y, float)
    firsts = list(range(1 + least, n - least + 2))
    seeds = spark.createDataFrame([(k, int(tau)) for k in orders for tau in (0, *firsts)], "p int, first int").repartition(max(1, min(64, len(firsts) * len(orders))))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = design(n, tuple(range(2, n + 1)), trend)  # column 0 is the mean, column tau - 1 the step at tau
        for batch in batches:
            for p, first in zip(batch["p"], batch["first"]):
                sets = [()] if first == 0 else [(first, *rest) for rest in _tails(n, int(first), least, most - 1)]
                by_size: dict[int, list[tuple[int, ...]]] = {}
                for s in sets:
                    by_size.setdefault(len(s), []).append(s)
                extra = (steps.shape[1] - 1,) if trend else ()
                at = {m: np.array([(0, *(t - 1 for t in s), *extra) for s in group]) for m, group in by_size.items()}
                best = {m: np.full(len(group), -np.inf) for m, group in by_size.items()}
                for phi in grid(int(p)):
                    uy, log_det = whiten(v, phi)
                    ux, _ = whiten(steps, phi)
                    gram, cross, yy = ux.T @ ux, ux.T @ uy, float(uy @ uy)
                    for m in by_size:
                        rss = _rss(gram, cross, yy, at[m])
                        np.maximum(best[m], -n / 2 * (np.log(2 * np.pi * np.maximum(rss, 1e-300) / n) + 1) - log_det / 2, out=best[m])
                kept: set[tuple[int, ...]] = set()
                shortest = {m: np.array([shortest_regime(s, n) for s in group]) for m, group in by_size.items()}
                for d in durations:
                    rows = []
                    for m, ll in best.items():
                        value = np.where(shortest[m] >= d, -2 * ll + (2 * m + 2 + int(trend) + p) * math.log(n), np.inf)
                        top = np.argpartition(value, min(keep, len(value)) - 1)[:keep]
                        rows += [(value[i], by_size[m][i]) for i in top if np.isfinite(value[i])]
                    kept |= {s for _, s in sorted(rows)[:keep]}
                fits = [(s, fit(v, s, int(p), trend)) for s in sorted(kept)]
                yield pd.DataFrame({"series": name, "n_breakpoints": [len(s) for s, _ in fits], "ar_order": int(p), "onsets": [list(s) for s, _ in fits], "shortest": [shortest_regime(s, n) for s, _ in fits], "loglik": [f["loglik"] for _, f in fits], "raw_bic": [f["bic"] for _, f in fits], "objective": [f["objective"] for _, f in fits]})

    schema = "series string, n_breakpoints int, ar_order int, onsets array<int>, shortest int, loglik double, raw_bic double, objective double"
    found = map_frames(seeds, run, schema)
    each = found.withColumn("min_duration", F.explode(F.filter(F.array(*map(F.lit, durations)), lambda d: d <= F.col("shortest"))))
    place = Window.partitionBy("series", "min_duration").orderBy("objective", "ar_order", "n_breakpoints", "onsets")
    return each.withColumn("place", F.row_number().over(place)).where(F.col("place") <= keep)


def winners(found: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """The best configuration of each series and least duration; within the tolerance the one of lower order, then fewer onsets."""
    of_cell = Window.partitionBy("series", "min_duration")
    near = found.withColumn("_low", F.min("objective").over(of_cell)).where(F.col("objective") <= F.col("_low") + tolerance)
    return near.withColumn("_n", F.row_number().over(of_cell.orderBy("ar_order", "n_breakpoints", "objective", "onsets"))).where("_n = 1").drop("_n", "_low", "place")


def fitted_series(y: np.ndarray, months: list[str], taus: tuple[int, ...], p: int, trend: bool = False) -> pd.DataFrame:
    """Months with their value, structural mean, innovation in units of its deviation, and regime."""
    f = fit(y, taus, p, trend)
    regime = 1 + sum((np.arange(1, len(y) + 1) >= tau).astype(int) for tau in taus) if taus else np.ones(len(y), int)
    return pd.DataFrame({"year_month": months, "observed": y, "structural_mean": f["mean"], "standardized_innovation": f["innovation"], "regime": regime})


def candidate_models(series: DataFrame, models: DataFrame) -> DataFrame:
    """Given sets of onsets (model, onsets) compared on one series with independent errors: BIC, objective and their distance from the best.

    Months by models by regimes in two aggregations; the models are few parameters.
    """
    regime = F.size(F.filter("onsets", lambda o: o <= F.col("t") + 1))
    each = series.crossJoin(F.broadcast(models)).withColumn("regime", regime)  # months by parameter rows
    inner = each.groupBy("series", "model", "regime").agg((F.var_pop("y") * F.count("y")).alias("rss"), F.count("y").alias("n"), F.first(F.size("onsets")).alias("m"))
    fit_ = inner.groupBy("series", "model").agg(F.sum("rss").alias("rss"), F.sum("n").alias("n"), F.max("m").alias("n_breakpoints"))
    bic = F.expr(f"n * (ln(2 * {math.pi!r} * rss / n) + 1) + (n_breakpoints + 2) * ln(n)")
    made = fit_.withColumn("bic", bic).withColumn("objective", F.expr("bic + n_breakpoints * ln(n)"))
    best = Window.partitionBy("series")
    return made.withColumns({"delta_bic": F.col("bic") - F.min("bic").over(best), "delta_objective": F.col("objective") - F.min("objective").over(best)})


def _rss(gram: np.ndarray, cross: np.ndarray, yy: float, at: np.ndarray) -> np.ndarray:
    """Residual sums of squares on each row's columns: a Cholesky decomposition of all rows at once."""
    k, rss = at.shape[1], np.full(len(at), yy)
    low: dict[tuple[int, int], np.ndarray] = {}
    z: list[np.ndarray] = []
    for j in range(k):
        for q in range(j):
            low[j, q] = (gram[at[:, j], at[:, q]] - sum(low[j, r] * low[q, r] for r in range(q))) / low[q, q]
        low[j, j] = np.sqrt(np.maximum(gram[at[:, j], at[:, j]] + 1e-12 - sum(low[j, q] ** 2 for q in range(j)), 1e-12))
        z.append((cross[at[:, j]] - sum(low[j, q] * z[q] for q in range(j))) / low[j, j])
        rss = rss - z[j] ** 2
    return rss


def _tails(n: int, first: int, least: int, more: int) -> list[tuple[int, ...]]:
    out: list[tuple[int, ...]] = [()]
    if more > 0:
        for tau in range(first + least, n - least + 2):
            out += [(tau, *rest) for rest in _tails(n, tau, least, more - 1)]
    return out


def regime_means(series: DataFrame, onsets: list[int]) -> DataFrame:
    """Mean, start, end and shift to the regime before, by cumulative onsets and a lag."""
    step = sum((F.when(F.col("t") + 1 >= o, 1).otherwise(0) for o in onsets), F.lit(1))
    regimes = series.groupBy("series", step.alias("regime")).agg(F.min("year_month").alias("start_month"), F.max("year_month").alias("end_month"), F.count(F.lit(1)).alias("duration"), F.avg("y").alias("regime_mean"))
    return regimes.withColumn("shift", F.col("regime_mean") - F.lag("regime_mean").over(Window.partitionBy("series").orderBy("regime")))


def shift_model_ar0(series: DataFrame, onsets: list[int]) -> DataFrame:
    """Likelihood and BIC of the mean-shift model with independent errors: least squares around regime means."""
    step = sum((F.when(F.col("t") + 1 >= o, 1).otherwise(0) for o in onsets), F.lit(1))
    mean = F.avg("y").over(Window.partitionBy("series", step))
    m = len(onsets)
    fit_ = series.withColumn("e", F.col("y") - mean).groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("e") * F.col("e")).alias("s2"))
    loglik = F.expr(f"-n / 2.0 * (ln(2 * {math.pi!r} * s2) + 1)")
    return fit_.withColumn("loglik", loglik).withColumn("joint_bic", F.expr(f"-2 * loglik + (2 * {m} + 2) * ln(n)"))


def coefficient_table(y: np.ndarray, taus: tuple[int, ...], p: int, trend: bool = False) -> pd.DataFrame:
    """Estimates with conditional standard errors, t tests and intervals."""
    f = fit(y, taus, p, trend)
    terms = ["intercept", *[f"shift_{t}" for t in taus], *(["time"] if trend else [])]
    df = len(y) - len(terms) - p
    se = np.sqrt(np.diag(f["cov"]))
    q = student_quantile(0.975, df)
    t = f["beta"] / se
    return pd.DataFrame({"term": terms, "estimate": f["beta"], "standard_error": se, "t": t, "df": df, "p_two_sided": [student_two_sided(x, df) for x in t], "ci_lower": f["beta"] - q * se, "ci_upper": f["beta"] + q * se})


def endpoint_contrast(y: np.ndarray, taus: tuple[int, ...], p: int, trend: bool = False) -> dict[str, float]:
    """Fitted last month minus first, with its conditional standard error."""
    f = fit(y, taus, p, trend)
    c = np.array([0.0, *[1.0] * len(taus), *([len(y) - 1.0] if trend else [])])
    return {"estimate": float(c @ f["beta"]), "standard_error": float(math.sqrt(max(0.0, c @ f["cov"] @ c)))}


def diagnostics(y: np.ndarray, taus: tuple[int, ...], p: int) -> dict[str, float]:
    u = fit(y, taus, p)["innovation"]
    r = acf(u, 2)
    (q4, p4), (q8, p8) = ljung_box_p(u, 4, p), ljung_box_p(u, 8, p)
    return {"acf1": r[0], "acf2": r[1], "q4": q4, "p4": p4, "q8": q8, "p8": p8}


def compare_classes(spark: SparkSession, y: list[float], name: str, durations: tuple[int, ...] = (3, 4, 5, 6), most: int = 4, tolerance: float = 1e-8) -> DataFrame:
    """Trend only, breaks only and both, for each least duration: best of each class, its distance from the best of all, and which is selected."""
    v = np.array(y, float)
    trend = min((fit(v, (), p, True) | {"p": p} for p in (0, 1, 2)), key=lambda f: f["objective"])
    rows = [(d, "trend_only", int(trend["p"]), 0, [], float(trend["loglik"]), float(trend["objective"])) for d in durations]
    both = spark.createDataFrame(rows, "min_duration int, model_class string, ar_order int, n_breakpoints int, onsets array<int>, loglik double, objective double")
    for label, with_trend in (("break_only", False), ("break_plus_trend", True)):
        found = winners(search(spark, y, name, durations, most, trend=with_trend).where("n_breakpoints > 0"))
        both = both.unionByName(found.select("min_duration", F.lit(label).alias("model_class"), "ar_order", "n_breakpoints", "onsets", "loglik", "objective"))
    low = F.min("objective").over(Window.partitionBy("min_duration"))
    return both.withColumn("delta", F.col("objective") - low).withColumn("selected", F.col("delta") <= tolerance)
