"""General dominance of three predictors, in closed form from correlations, and its stationary bootstrap."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstat.functions.text import child_seed
from loomstat.session import map_frames


def general_dominance_sql(df: DataFrame, outcome: str, predictors: tuple[str, str, str]) -> DataFrame:
    """Contributions of three predictors to R squared, from six correlations of one aggregation."""
    a, b, c = predictors
    r = df.agg(*[F.corr(outcome, p).alias(f"y{i}") for i, p in enumerate(predictors)], F.corr(a, b).alias("r01"), F.corr(a, c).alias("r02"), F.corr(b, c).alias("r12"), F.count(F.lit(1)).alias("n"))
    two = lambda i, j: f"((y{i} * y{i} + y{j} * y{j} - 2 * y{i} * y{j} * r{min(i, j)}{max(i, j)}) / (1 - r{min(i, j)}{max(i, j)} * r{min(i, j)}{max(i, j)}))"
    det = "(1 + 2 * r01 * r02 * r12 - r01 * r01 - r02 * r02 - r12 * r12)"
    full = f"((y0 * y0 * (1 - r12 * r12) + y1 * y1 * (1 - r02 * r02) + y2 * y2 * (1 - r01 * r01) + 2 * y0 * y1 * (r02 * r12 - r01) + 2 * y0 * y2 * (r01 * r12 - r02) + 2 * y1 * y2 * (r01 * r02 - r12)) / {det})"
    out = None
    for i, p in enumerate(predictors):
        j, k = [x for x in range(3) if x != i]
        value = F.expr(f"(y{i} * y{i} + (({two(i, j)} - y{j} * y{j}) + ({two(i, k)} - y{k} * y{k})) / 2 + ({full} - {two(j, k)})) / 3")
        row = r.select(F.lit(p).alias("predictor"), value.alias("contribution"), F.expr(full).alias("full_r2"), F.col(f"y{i}").alias("correlation"), "n")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("share", F.col("contribution") / F.col("full_r2"))


def general_dominance(panel: np.ndarray) -> np.ndarray:
    """Contributions of columns 1.. to the R squared of column 0."""
    sd = panel.std(axis=0)
    k = panel.shape[1] - 1
    if sd[0] == 0:
        return np.zeros(k)
    r = np.nan_to_num(np.corrcoef(panel.T))
    def r2(s: tuple[int, ...]) -> float:
        if not s:
            return 0.0
        at = list(s)
        return float(np.clip(r[0, at] @ np.linalg.pinv(r[np.ix_(at, at)]) @ r[at, 0], 0, 1))

    memo = {s: r2(s) for size in range(k + 1) for s in combinations(range(1, k + 1), size)}
    out = np.zeros(k)
    for i in range(1, k + 1):
        rest = [x for x in range(1, k + 1) if x != i]
        out[i - 1] = np.mean([np.mean([memo[tuple(sorted((*s, i)))] - memo[s] for s in combinations(rest, size)]) for size in range(k)])
    return out


def general_dominance_of(panels: np.ndarray) -> np.ndarray:
    """Contributions of three predictors in each of many panels (panels, months, 4), from their correlations in closed form."""
    z = panels - panels.mean(axis=1, keepdims=True)
    cov = np.einsum("sti,stj->sij", z, z)
    sd = np.sqrt(np.einsum("sii->si", cov))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.nan_to_num(cov / (sd[:, :, None] * sd[:, None, :]))
        y, (a, b, c) = r[:, 0, 1:], (r[:, 1, 2], r[:, 1, 3], r[:, 2, 3])
        one = y * y
        two = {(i, j): (one[:, i] + one[:, j] - 2 * y[:, i] * y[:, j] * x) / (1 - x * x) for (i, j), x in (((0, 1), a), ((0, 2), b), ((1, 2), c))}
        det = 1 + 2 * a * b * c - a * a - b * b - c * c
        full = (one[:, 0] * (1 - c * c) + one[:, 1] * (1 - b * b) + one[:, 2] * (1 - a * a) + 2 * y[:, 0] * y[:, 1] * (b * c - a) + 2 * y[:, 0] * y[:, 2] * (a * c - b) + 2 * y[:, 1] * y[:, 2] * (a * b - c)) / det
    clip = lambda x: np.clip(x, 0, 1)
    out = np.empty((len(panels), 3))
    for i in range(3):
        j, k = [x for x in range(3) if x != i]
        ij, ik, jk = (two[tuple(sorted(p))] for p in ((i, j), (i, k), (j, k)))
        out[:, i] = (clip(one[:, i]) + (clip(ij) - clip(one[:, j]) + clip(ik) - clip(one[:, k])) / 2 + clip(full) - clip(jk)) / 3
    # without variance, or with predictors that depend on each other, by the general way
    for s in np.flatnonzero((sd == 0).any(axis=1) | (det < 1e-9)):
        out[s] = general_dominance(panels[s])
    return out


def stationary_indices(rng: np.random.Generator, n: int, block: int, draws: int = 1) -> np.ndarray:
    """Months of each draw: a block starts anew with probability 1 / block and runs around the end."""
    restart = rng.random((draws, n)) < 1 / block
    restart[:, 0] = True
    starts = rng.integers(0, n, (draws, n))
    at = np.maximum.accumulate(np.where(restart, np.arange(n), 0), axis=1)
    return (np.take_along_axis(starts, at, axis=1) + np.arange(n) - at) % n


_DRAW = "block_length int, layer string, replicate bigint, q2 double, q3 double, q4 double, full_r2 double"


def stationary_bootstrap(spark: SparkSession, panels: np.ndarray, blocks: tuple[int, ...] = (3, 4, 5), replicates: int = 5000, seed: int = 42, chunk: int = 250) -> DataFrame:
    """Draws of months, alone (temporal) and with a random measurement panel too; (panels, months, 4), panel 0 the observed, the rest replicates.

    Chunks of draws are the tasks' work; each has its own seed, so any partitioning gives the same draws.
    Without a replicate there is only the temporal layer. The panels are months by dimensions of a bounded number of replicates and travel with the task.
    """
    chunks = [(b, i, min(chunk, replicates - i)) for b in blocks for i in range(0, replicates, chunk)]
    work = spark.createDataFrame(chunks, "block int, start int, size int").repartition(min(len(chunks), spark.sparkContext.defaultParallelism))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, start, size in batch.itertuples(index=False):
                rng = np.random.default_rng(child_seed(seed, f"stationary_{block}_{start}"))
                at = stationary_indices(rng, panels.shape[1], int(block), int(size))
                layers = [("temporal", panels[0][at])]
                if len(panels) > 1:
                    pick = rng.integers(1, len(panels), int(size))
                    layers.append(("temporal_and_measurement", panels[pick[:, None], at]))
                for layer, panel in layers:
                    g = general_dominance_of(panel)
                    yield pd.DataFrame({"block_length": int(block), "layer": layer, "replicate": np.arange(start, start + size), "q2": g[:, 0], "q3": g[:, 1], "q4": g[:, 2], "full_r2": g.sum(axis=1)})

    return map_frames(work, run, _DRAW)


def simultaneous_contrasts(draws: DataFrame, level: float = 0.95) -> DataFrame:
    """By block length and layer: both contrasts of q4 with one joint band, half as wide as the level of the larger of their deviations from the mean."""
    d = draws.select("block_length", "layer", (F.col("q4") - F.col("q2")).alias("a"), (F.col("q4") - F.col("q3")).alias("b"))
    means = d.groupBy("block_length", "layer").agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))
    off = F.greatest(F.abs(F.col("a") - F.col("mean_a")), F.abs(F.col("b") - F.col("mean_b")))
    banded = d.join(means, ["block_length", "layer"]).groupBy("block_length", "layer").agg(F.first("mean_a").alias("q4_minus_q2"), F.first("mean_b").alias("q4_minus_q3"), F.percentile(off, level).alias("radius"))
    return banded.withColumn("both_positive", (F.col("q4_minus_q2") > F.col("radius")) & (F.col("q4_minus_q3") > F.col("radius")))


def ranking(dominance: DataFrame) -> DataFrame:
    """Predictors in the order of their contribution, with their share of the whole."""
    total = F.sum("contribution").over(Window.partitionBy(F.lit(1)))  # three rows
    return dominance.withColumns({"share_of_r2": F.try_divide(F.col("contribution"), total), "place": F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("contribution"), "predictor"))})


def dominance_summary(draws: DataFrame) -> DataFrame:
    """Mean, error, interval and sign probability of each statistic, by block length and layer."""
    long = draws.withColumns({"q4_minus_q2": F.col("q4") - F.col("q2"), "q4_minus_q3": F.col("q4") - F.col("q3"), "q4_largest": F.expr("cast(q4 > q2 and q4 > q3 as double)")})
    long = long.unpivot(["block_length", "layer"], ["q2", "q3", "q4", "full_r2", "q4_minus_q2", "q4_minus_q3", "q4_largest"], "statistic", "x")
    p: Column = F.percentile("x", F.array(F.lit(0.025), F.lit(0.975)))
    return long.groupBy("block_length", "layer", "statistic").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("standard_error"), p[0].alias("ci_lower"), p[1].alias("ci_upper"), F.avg(F.expr("cast(x > 0 as int)")).alias("probability_positive"))
