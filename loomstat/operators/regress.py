"""Regression of two outcomes on one design with common autoregressive errors, over one panel or many replicates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.functions.dist import student_quantile, student_two_sided
from loomstat.operators.trend import acf, ljung_box_p
from loomstat.session import by_group


def _segments(kept: np.ndarray) -> np.ndarray:
    """Where a run of consecutive months begins."""
    return np.concatenate(([True], np.diff(kept) > 1))


def _quasi(m: np.ndarray, phi: float, start: np.ndarray) -> np.ndarray:
    out = m.astype(float).copy()
    inner = np.flatnonzero(~start)
    out[inner] = m[inner] - phi * m[inner - 1]
    out[start] *= math.sqrt(1 - phi * phi)
    return out


def _evaluate(y: np.ndarray, x: np.ndarray, phi: float, start: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    qy, qx = _quasi(y, phi, start), _quasi(x, phi, start)
    b, *_ = np.linalg.lstsq(qx, qy, rcond=None)
    e = qy - qx @ b
    n = len(y)
    s = e.T @ e / n
    sign, log_det = np.linalg.slogdet(s)
    loglik = -n / 2 * (2 * math.log(2 * math.pi) + log_det + 2) + start.sum() * math.log(1 - phi * phi) if sign > 0 else -np.inf
    return float(loglik), b, s, e, qx


def bivariate(y: np.ndarray, x: np.ndarray, order: int, kept: np.ndarray | None = None, bound: float = 0.95) -> dict:
    """Least squares of both outcomes with common AR(0) or AR(1) errors; phi by golden section."""
    start = _segments(np.arange(len(y)) if kept is None else kept)
    phi = 0.0
    if order:
        phis = np.linspace(-bound, bound, 39)
        best = int(np.argmax([_evaluate(y, x, f, start)[0] for f in phis]))
        low, high = phis[max(0, best - 1)], phis[min(38, best + 1)]
        g = (math.sqrt(5) - 1) / 2
        while high - low > 1e-9:
            a, b = high - g * (high - low), low + g * (high - low)
            if _evaluate(y, x, a, start)[0] < _evaluate(y, x, b, start)[0]:
                low = a
            else:
                high = b
        phi = (low + high) / 2
    loglik, beta, s, e, qx = _evaluate(y, x, phi, start)
    inverse = np.linalg.inv(qx.T @ qx)
    k = beta.size + 3 + order
    return {"phi": phi, "loglik": loglik, "bic": -2 * loglik + k * math.log(len(y)), "beta": beta, "sigma": s, "se": np.sqrt(np.outer(np.diag(inverse), np.diag(s))), "innovation": e, "inverse": inverse}


def coefficient_rows(f: dict, n: int, outcomes: tuple[str, str], terms: tuple[str, ...]) -> pd.DataFrame:
    """A row for each outcome and term, and the contrast of the outcomes' effects of the second term."""
    df = n - len(terms)
    q = student_quantile(0.975, df)
    rows = []
    for o, name in enumerate(outcomes):
        for t, term in enumerate(terms):
            b, se = f["beta"][t, o], f["se"][t, o]
            p = student_two_sided(b / se, df)
            rows.append((name, term, b, se, b / se, df, p, p / 2 if b < 0 else 1 - p / 2, b - q * se, b + q * se))
    v = f["inverse"][1, 1] * (f["sigma"][0, 0] + f["sigma"][1, 1] - 2 * f["sigma"][0, 1])
    b, se = f["beta"][1, 0] - f["beta"][1, 1], math.sqrt(v)
    p = student_two_sided(b / se, df)
    rows.append(("contrast", terms[1], b, se, b / se, df, p, p / 2 if b < 0 else 1 - p / 2, b - q * se, b + q * se))
    return pd.DataFrame(rows, columns=["outcome", "term", "estimate", "standard_error", "t", "df", "p_two_sided", "p_one_sided_negative", "ci_lower", "ci_upper"])


def panel_arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Outcomes, and intercept, centred polarization and centred time, of a panel in the order of months."""
    pdf = pdf.sort_values("t")
    x = pdf["polarization"].to_numpy(float)
    t = pdf["t"].to_numpy(float)
    return pdf[["rep", "dem"]].to_numpy(float), np.column_stack([np.ones(len(pdf)), x - x.mean(), t - t.mean()])


def bivariate_of(y: np.ndarray, x: np.ndarray, order: int, bound: float = 0.95) -> dict[str, np.ndarray]:
    """The fit of ``bivariate`` for many panels at once: outcomes (panels, months, 2), design (panels, months, 3).

    With z the design and outcomes together, the products of quasi-differences are a quadratic in phi,
    so that a likelihood costs one small system of equations and no pass over the months.
    """
    z = np.concatenate([x, y], axis=2)
    n, k = z.shape[1], x.shape[2]
    first = np.einsum("si,sj->sij", z[:, 0], z[:, 0])
    now, lag, cross = (np.einsum("sti,stj->sij", a, b) for a, b in ((z[:, 1:], z[:, 1:]), (z[:, :-1], z[:, :-1]), (z[:, 1:], z[:, :-1])))
    cross = cross + cross.transpose(0, 2, 1)

    def at(phi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = phi[:, None, None]
        s = (1 - f * f) * first + now - f * cross + f * f * lag
        beta = np.linalg.solve(s[:, :k, :k], s[:, :k, k:])
        sigma = (s[:, k:, k:] - s[:, k:, :k] @ beta) / n
        log_det = np.log(np.maximum(sigma[:, 0, 0] * sigma[:, 1, 1] - sigma[:, 0, 1] ** 2, 1e-300))
        return -n / 2 * (2 * np.log(2 * np.pi) + log_det + 2) + np.log(1 - phi * phi), beta

    phi = np.zeros(len(z))
    if order:
        phis = np.linspace(-bound, bound, 39)
        best = np.argmax([at(np.full(len(z), f))[0] for f in phis], axis=0)
        low, high = phis[np.maximum(0, best - 1)], phis[np.minimum(38, best + 1)]
        g = (np.sqrt(5) - 1) / 2
        while (high - low).max() > 1e-9:
            a, b = high - g * (high - low), low + g * (high - low)
            left = at(a)[0] < at(b)[0]
            low, high = np.where(left, a, low), np.where(left, high, b)
        phi = (low + high) / 2
    loglik, beta = at(phi)
    return {"phi": phi, "loglik": loglik, "bic": -2 * loglik + (2 * k + 3 + order) * np.log(n), "beta": beta}


_REPLICATE = "replicate bigint, ar_order int, phi double, loglik double, bic double, rep_polarization double, dem_polarization double, contrast double"


def replicate_regressions(panels: DataFrame, orders: tuple[int, ...] = (0, 1), group: int = 250) -> DataFrame:
    """Refit of every complete panel (replicate, year_month, rep, dem, polarization); a panel lacks no month and no value.

    Replicates are spread over tasks, ``group`` to each, and fitted together.
    """
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        months = pdf["year_month"].nunique()
        pdf = pdf.sort_values(["replicate", "year_month"])
        values = pdf[["polarization", "rep", "dem"]].to_numpy(float)
        ok = pd.Series(np.isfinite(values).all(axis=1)).groupby(pdf["replicate"].to_numpy()).agg(["sum", "size"])
        keep = ok.index[(ok["sum"] == months) & (ok["size"] == months)].to_numpy()
        columns = [c.split()[0] for c in _REPLICATE.split(", ")]
        if not len(keep) or months < 12:
            return pd.DataFrame([], columns=columns)
        v = values[np.isin(pdf["replicate"].to_numpy(), keep)].reshape(len(keep), months, 3)
        p, t = v[:, :, 0], np.arange(months, dtype=float)
        x = np.stack([np.ones_like(p), p - p.mean(axis=1, keepdims=True), np.broadcast_to(t - t.mean(), p.shape)], axis=2)
        out = []
        for k in orders:
            f = bivariate_of(v[:, :, 1:], x, k)
            rep, dem = f["beta"][:, 1, 0], f["beta"][:, 1, 1]
            out.append(pd.DataFrame(dict(zip(columns, (keep, k, f["phi"], f["loglik"], f["bic"], rep, dem, rep - dem)))))
        return pd.concat(out)

    return by_group(panels.withColumn("_group", F.floor(F.col("replicate") / group)), ["_group"], one, _REPLICATE)


def effects_summary(fits: DataFrame, replicates: int, keys: list[str], effects: tuple[str, ...] = ("rep_polarization", "dem_polarization", "contrast"), share: float = 0.95) -> DataFrame:
    """Mean, error, interval and chance of a negative sign of each effect over replicates; null unless enough of them could be used."""
    long = fits.unpivot(keys, list(effects), "effect", "x").where("x is not null")
    p = F.percentile("x", F.array(F.lit(0.025), F.lit(0.975)))
    made = long.groupBy(*keys, "effect").agg(F.count("x").alias("n_valid"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("standard_error"), p[0].alias("ci_lower"), p[1].alias("ci_upper"), F.avg((F.col("x") < 0).cast("int")).alias("probability_negative"))
    enough = F.col("n_valid") >= share * replicates
    return made.withColumns({c: F.when(enough, F.col(c)) for c in ("mean", "standard_error", "ci_lower", "ci_upper", "probability_negative")})


def leave_one_out(panel: DataFrame, order: int = 1) -> DataFrame:
    """Refit without each month; the errors start again after the gap. The panel is one calendar."""
    omitted = panel.select(F.col("t").alias("omitted"))
    each = omitted.crossJoin(panel).where("t <> omitted")  # months by months of one series

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        y, x = panel_arrays(pdf)
        f = bivariate(y, x, order, pdf["t"].to_numpy())
        return pd.DataFrame({"omitted": [int(pdf["omitted"].iloc[0])], "phi": [f["phi"]], "rep_polarization": [f["beta"][1, 0]], "dem_polarization": [f["beta"][1, 1]]})

    return by_group(each, ["omitted"], one, "omitted int, phi double, rep_polarization double, dem_polarization double")


def residual_diagnostics(f: dict, lags: tuple[int, ...] = (4, 8)) -> pd.DataFrame:
    e = f["innovation"]
    rows = [(o, k, float(acf(e[:, i], k)[-1]), *ljung_box_p(e[:, i], k)) for i, o in enumerate(("republican", "democrat")) for k in lags]
    out = pd.DataFrame(rows, columns=["outcome", "lag", "acf_at_lag", "q", "p"])
    out["contemporaneous_correlation"] = float(np.corrcoef(e.T)[0, 1])
    return out


def ols_ar0(panel: DataFrame, outcome: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Slope of an outcome on polarization and time from sums of products: one aggregation, no Python."""
    c = lambda a, b: F.covar_pop(a, b)
    m = panel.groupBy(*by).agg(c("polarization", "polarization").alias("pp"), c("t", "t").alias("tt"), c("polarization", "t").alias("pt"), c("polarization", outcome).alias("py"), c("t", outcome).alias("ty"), F.avg(outcome).alias("intercept"))
    return m.select(*by, F.lit(outcome).alias("outcome"), "intercept", F.expr("(py * tt - ty * pt) / (pp * tt - pt * pt)").alias("polarization_slope"), F.expr("(ty * pp - py * pt) / (pp * tt - pt * pt)").alias("time_slope"))


def table_ar0(panel: DataFrame, outcomes: tuple[str, str] = ("rep", "dem")) -> DataFrame:
    """(outcome, term, estimate, standard_error, t, df) of both outcomes on polarization and time with independent errors, from one aggregation."""
    c = lambda a, b: F.covar_pop(a, b)
    sums = [c("polarization", "polarization").alias("pp"), c("t", "t").alias("tt"), c("polarization", "t").alias("pt"), F.count(F.lit(1)).alias("n")]
    for o in outcomes:
        sums += [F.avg(o).alias(f"{o}_0"), c("polarization", o).alias(f"{o}_p"), c("t", o).alias(f"{o}_t"), c(o, o).alias(f"{o}_o")]
    m = panel.agg(*sums).withColumn("det", F.expr("nullif(pp * tt - pt * pt, 0D)"))  # without a solution there are no coefficients
    rows = []
    for o in outcomes:
        p, t = f"({o}_p * tt - {o}_t * pt) / det", f"({o}_t * pp - {o}_p * pt) / det"
        s2 = f"({o}_o - ({p}) * {o}_p - ({t}) * {o}_t)"
        rows += [f"named_struct('outcome', '{o}', 'term', '{term}', 'estimate', {b}, 'standard_error', sqrt({s2} * {inverse} / n))" for term, b, inverse in (("intercept", f"{o}_0", "1.0D"), ("polarization", p, "tt / det"), ("time", t, "pp / det"))]
    b, se = F.col("estimate"), F.col("standard_error")
    t = F.when(se == 0, b * F.lit(float("inf"))).otherwise(b / se)  # as floating point has it, where division would be an error
    return m.select("n", F.inline(F.expr(f"array({', '.join(rows)})"))).select("outcome", "term", "estimate", "standard_error", t.alias("t"), (F.col("n") - 3).alias("df"))


def decision(summary: DataFrame) -> DataFrame:
    """Whether both effects are negative with intervals under zero, and whether signs agree."""
    of = lambda o, c: F.max(F.when(F.col("outcome") == o, F.col(c)))
    both = summary.agg(of("republican", "estimate").alias("r"), of("democrat", "estimate").alias("d"), of("republican", "ci_upper").alias("ru"), of("democrat", "ci_upper").alias("du"))
    return both.select((F.col("r") < 0).alias("rep_negative"), (F.col("d") < 0).alias("dem_negative"), F.expr("r < 0 and d < 0 and ru < 0 and du < 0").alias("supported"), F.expr("sign(r) = sign(d)").alias("same_sign"))
