"""Cluster bootstrap of articles within months: the same counts for every party and dimension.

``replicate_measures`` draws Poisson(1) counts from a hash of (article, replicate):
tasks add them up over their own rows, and the sums are exact, so that any
partitioning gives the same numbers. ``drawn`` makes the same counts in built-in
expressions, a row for each. The other operators draw exact multinomial counts month by month with numpy, in chunks of
replicates that each have their own seed and a bounded number of counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions.text import child_seed
from loomstat.operators import hashes
from loomstat.operators.measure import ACCURACY, DIMENSIONS, PARTIES
from loomstat.session import by_group, cut, ship

#: Cumulative Poisson(1) probabilities in ten thousandths: k is the number of them at or under the hash.
_POISSON = (3679, 7358, 9197, 9810, 9963, 9994, 9999)
#: Replicates of a chunk, and counts that a chunk may have.
CHUNK, COUNTS = 250, 4_000_000


#: Weights and products count in steps of 2 ** -20, which makes double sums under 2 ** 33 exact, in any order.
_STEP = 1 << 20


def hash_counts(u: Column) -> Column:
    """How often a cluster is drawn, from a number under ten thousand."""
    return sum((F.when(u >= p, 1).otherwise(0) for p in _POISSON), F.lit(0))


def drawn(df: DataFrame, key: str, columns: list[str], replicates: int) -> DataFrame:
    """(replicate, c, columns): the rows of each key that is drawn, with how often; its counts are made once for all its rows."""
    rows = df.groupBy(key).agg(F.collect_list(F.struct(*columns)).alias("_rows"))  # of one article, or one item
    each = rows.select(key, "_rows", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("replicate").cast("string"))), 1, 8), 16, 10).cast("bigint") % 10000
    # a generator keeps the hash from being copied into each use
    counted = each.select("_rows", "replicate", F.explode(F.array(u)).alias("_u")).select("_rows", "replicate", hash_counts(F.col("_u")).alias("c"))
    return counted.where("c > 0").select("replicate", "c", F.inline("_rows"))


#: Rank errors at which a group's values are bracketed, and how many deviations of a drawn rank a bracket must hold on either side.
_DELTAS = tuple(0.25 * 0.7**k for k in range(18))
DEVIATIONS = 6.0
#: Bytes of counts made at once, and counts of single values that a task holds before it passes them on.
_BYTES, _HELD = 100_000_000, 64_000_000
_CELL = ["year_month", "party", "dimension"]
_PARTS = "year_month string, party string, dimension string, kind int, x double, width int, counts binary"
_SUMS, _INSIDE = -1, 0
_MADE = "replicate int, year_month string, party string, dimension string, mean double, raw_iqr double, n_drawn bigint, missed boolean"


def replicate_measures(long: DataFrame, replicates: int, spread: bool = True, deviations: float = DEVIATIONS) -> DataFrame:
    """Weighted mean and interquartile range of each month, party, dimension and replicate, given hash counts.

    Weights and products are cut to steps of 2 ** -20, so that sums don't depend on the order of addition. A task hashes
    its articles' counts and sums them by cell; only such sums are shuffled, so that nothing grows with rows times
    replicates. For the interquartile range (left out without ``spread``; with it ``long`` is read twice) a sketch
    brackets both quartiles by ranks that a replicate's hardly leave: values inside are counted one by one, values
    outside together. A cell with a replicate whose quartile did leave them is counted again, in wider brackets.
    """
    step = lambda c: F.floor(c * _STEP).cast("double")
    rows = long.where("score is not null and article is not null").select(F.col("article").cast("string").alias("article"), *_CELL, F.col("score").cast("double").alias("score"), step(F.col("weight")).alias("w"), step(F.col("weight") * F.col("score")).alias("ws"))
    columns = ["replicate", *_CELL, "mean", "raw_iqr", "n_drawn"]
    if not spread:
        return _replicated(rows.withColumns({"x": F.lit(None).cast("double"), "kind": F.lit(_INSIDE)}), replicates, False).select(*columns).drop("raw_iqr")
    out = None
    while True:
        bounds = cut(_bounds(rows, deviations))  # a row a cell
        made = cut(_replicated(_placed(rows, bounds), replicates, True))
        good = made.where("not missed")
        out = good if out is None else out.unionByName(good)
        missed = cut(made.where("missed").select(*_CELL).distinct())
        if missed.isEmpty():
            return out.select(*columns)
        rows = rows.join(F.broadcast(missed.toDF("_k0", "_k1", "_k2")), _same_cell(), "left_semi")
        deviations = 4 * max(deviations, 1.0)


def _same_cell() -> Column:
    return F.col("year_month").eqNullSafe(F.col("_k0")) & F.col("party").eqNullSafe(F.col("_k1")) & F.col("dimension").eqNullSafe(F.col("_k2"))


def _bounds(rows: DataFrame, deviations: float) -> DataFrame:
    """(_k0.._k2, _e0.._e3): the brackets of both quartiles of each cell; all its values, where that is what a drawn rank may reach."""
    x, n = F.col("score"), F.col("n")
    made = rows.groupBy(*_CELL).agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.percentile_approx(x, [q + s * d for q in (0.25, 0.75) for s in (-1, 1) for d in _DELTAS], ACCURACY).alias("at"))
    need = deviations * F.sqrt(0.1875 / n) + 3 / ACCURACY + 2 / n
    k = F.size(F.filter(F.array(*map(F.lit, _DELTAS)), lambda d: d >= need))  # 0: none is wide enough
    end = lambda i: F.when(k == 0, F.col("high" if i % 2 else "low")).otherwise(F.try_element_at("at", k + i * len(_DELTAS)))
    return made.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(_CELL)], *[end(i).alias(f"_e{i}") for i in range(4)])


def _placed(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """With x and kind: 0 and its value inside a bracket; under them 1, between 2, over 3, and the value after which those stand."""
    x = F.col("score")
    e = [F.col(f"_e{i}") for i in range(4)]
    inside = x.between(e[0], e[1]) | x.between(e[2], e[3])
    kind = F.when(inside, _INSIDE).when(x > e[3], 3).when(x > e[1], 2).otherwise(1)
    place = F.when(inside, x).when(x > e[3], e[3]).when(x > e[1], e[1]).otherwise(F.lit(float("-inf")))
    return rows.join(F.broadcast(bounds), _same_cell()).withColumns({"kind": kind, "x": place})


def _replicated(placed: DataFrame, replicates: int, spread: bool) -> DataFrame:
    """``_MADE`` out of rows with x and kind: sums by task and cell, then by cell."""
    ship(placed.sparkSession)
    parts = placed.select("article", *_CELL, "x", "kind", "w", "ws").mapInArrow(lambda batches: _partial_sums(batches, replicates, spread), _PARTS)
    return by_group(parts, _CELL, lambda pdf: _measures(pdf, replicates, spread), _MADE)


def _partial_sums(batches: Iterator[pa.RecordBatch], replicates: int, spread: bool) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple, np.ndarray] = {}
    places: dict[tuple, list[float]] = {}
    held: list[tuple[tuple, np.ndarray, np.ndarray]] = []
    size = 0
    for table in _gathered(batches, max(1024, _BYTES // replicates)):
        for cell, added, singles in _of_cells(table, replicates, spread):
            sums[cell] = sums[cell] + added if cell in sums else added
            if spread:
                values, counts, outside = singles
                places.setdefault(cell, [np.nan] * 4)
                for kind, place in outside:
                    places[cell][kind] = place
                if len(values):
                    held.append((cell, values, counts))
                    size += counts.nbytes
        if size > _HELD:
            held = _tied(held)
            size = sum(c.nbytes for *_, c in held)
            if size > _HELD // 2:
                yield from _emitted([(cell, _INSIDE, x, c) for cell, values, counts in held for x, c in zip(values, counts)])
                held, size = [], 0
    rows = [(cell, _INSIDE, x, c) for cell, values, counts in _tied(held) for x, c in zip(values, counts)]
    for cell, s in sums.items():
        rows.append((cell, _SUMS, None, s[:3]))
        if spread:
            rows += [(cell, kind, places[cell][kind], s[2 + kind].astype(np.uint32)) for kind in (1, 2, 3) if s[2 + kind].any()]
    yield from _emitted(rows)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _of_cells(table: pa.Table, replicates: int, spread: bool) -> Iterator[tuple]:
    """For each cell its sums by replicate (drawn, w, ws; with ``spread`` those under, between and over the brackets too) and the counts of values inside."""
    encoded = [table[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in ("article", *_CELL)]
    article, *codes = (e.indices.to_numpy(zero_copy_only=False).astype(np.int64) for e in encoded)
    names = [e.dictionary.to_pylist() for e in encoded[1:]]
    cell = (codes[0] * len(names[1]) + codes[1]) * len(names[2]) + codes[2]
    counts = hashes.counts(encoded[0].dictionary, replicates, _POISSON)
    x, w, ws = (table[c].to_numpy() for c in ("x", "w", "ws"))
    kind = table["kind"].to_numpy()
    order = np.argsort(cell, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(cell[order]) > 0)))
    for at in np.split(order, starts[1:]):
        mine = counts[article[at]]
        columns = [np.ones(len(at)), np.nan_to_num(w[at]), np.nan_to_num(ws[at])] + [(kind[at] == k).astype(float) for k in (1, 2, 3)] * spread
        added = np.stack(columns) @ mine.astype(float)
        key = int(cell[at[0]])
        name = (names[0][key // len(names[2]) // len(names[1])], names[1][key // len(names[2]) % len(names[1])], names[2][key % len(names[2])])
        singles = None
        if spread:
            inside = kind[at] == _INSIDE
            outside = [(k, float(x[at[of_kind[0]]])) for k in (1, 2, 3) if len(of_kind := np.flatnonzero(kind[at] == k))]
            singles = (*_ties(x[at][inside], mine[inside]), outside)
        yield name, added, singles


def _ties(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their counts added up, in the narrowest type."""
    if len(values) < 2:
        return values, counts
    order = np.argsort(values, kind="stable")
    values = values[order]
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    if len(starts) == len(values):
        return values, counts[order]
    made = np.add.reduceat(counts[order], starts, axis=0, dtype=np.uint32)
    return values[starts], made.astype(np.min_scalar_type(int(made.max())))


def _tied(held: list[tuple]) -> list[tuple]:
    by: dict[tuple, list] = {}
    for cell, values, counts in held:
        by.setdefault(cell, []).append((values, counts))
    return [(cell, *_ties(np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts]))) for cell, parts in by.items()]


def _emitted(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(rows), 4096):
        part = rows[start : start + 4096]
        yield pa.RecordBatch.from_arrays([pa.array([r[0][i] for r in part], pa.string()) for i in range(3)] + [pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.float64()), pa.array([r[3].itemsize for r in part], pa.int32()), pa.array([r[3].tobytes() for r in part], pa.binary())], names=[*_CELL, "kind", "x", "width", "counts"])


def _measures(pdf: pd.DataFrame, replicates: int, spread: bool) -> pd.DataFrame:
    """Measures of one cell, and whether a quartile lies outside its bracket in any replicate."""
    sums = sum(np.frombuffer(b, float).reshape(3, replicates) for b in pdf.loc[pdf["kind"] == _SUMS, "counts"])
    n = sums[0].astype(np.int64)
    mean = np.divide(sums[2], sums[1], out=np.full(replicates, np.nan), where=sums[1] != 0)
    iqr, missed = np.full(replicates, np.nan), False
    if spread:
        rows = pdf[pdf["kind"] != _SUMS]
        x, outside = rows["x"].to_numpy(float), np.sign(rows["kind"].to_numpy() * (rows["kind"].to_numpy() - 1.5))  # -1 before its place, 0 on it, 1 after
        order = np.lexsort((outside, x))
        counts = np.empty((len(rows), replicates), np.int64 if n.max() >= 2**31 else np.int32)
        blobs, widths = rows["counts"].to_numpy(), rows["width"].to_numpy()
        for line, i in zip(counts, order):
            line[:] = np.frombuffer(blobs[i], f"u{widths[i]}")
        x, outside = x[order], outside[order]
        np.cumsum(counts, axis=0, out=counts)

        def at(rank: np.ndarray) -> np.ndarray:
            return np.count_nonzero(counts <= rank, axis=0).clip(max=len(x) - 1)

        top, ends = (n - 1).clip(min=0), []
        for p in (0.25, 0.75):
            h = top * p
            low, high = at(np.floor(h)), at(np.ceil(h))
            missed = missed or bool(((outside[low] != 0) | (outside[high] != 0))[n >= 4].any())
            a, b = x[low], x[high]
            with np.errstate(invalid="ignore"):
                ends.append(np.where(a == b, a, (np.ceil(h) - h) * a + (h - np.floor(h)) * b))
        with np.errstate(invalid="ignore"):
            iqr = np.where(n >= 4, ends[1] - ends[0], np.nan)
    first = pdf.iloc[0]
    out = pd.DataFrame({"replicate": np.arange(1, replicates + 1), **{c: first[c] for c in _CELL}, "mean": mean, "raw_iqr": iqr, "n_drawn": n, "missed": missed})
    return out[n > 0]


def draws(n: int, replicates: int, seed: int, namespace: str) -> Iterator[tuple[int, np.ndarray]]:
    """Multinomial counts of n articles drawn n times, (first replicate, replicates by articles), chunk by chunk."""
    chunk = max(1, min(CHUNK, COUNTS // max(1, n)))
    for start in range(0, replicates, chunk):
        size = min(chunk, replicates - start)
        rng = np.random.default_rng(child_seed(seed, f"{namespace}_{start}"))
        at = rng.integers(0, n, (size, n)) + np.arange(size)[:, None] * n
        yield start, np.bincount(at.ravel(), minlength=size * n).reshape(size, n)


def sequential_states(sizes: dict[str, int], replicates: int, seed: int) -> dict[str, dict]:
    """States of one generator before each month, in order, as it draws all replicates of one month after the other.

    With ``seed`` the child seed of a run by a single stream, ``cluster_bootstrap`` given these states draws that
    run's counts, though months are drawn apart. The numbers are drawn here once more, on the driver: for parity with such a run, not for scale.
    """
    rng, states = np.random.default_rng(seed), {}
    for month, n in sorted(sizes.items()):
        states[month] = rng.bit_generator.state
        rng.multinomial(n, np.full(n, 1.0 / n), size=replicates)
    return states


def _drawn_from(state: dict, n: int, replicates: int) -> Iterator[tuple[int, np.ndarray]]:
    rng = np.random.default_rng()
    rng.bit_generator.state = state
    yield 0, rng.multinomial(n, np.full(n, 1.0 / n), size=replicates)


def _usable(part: pd.DataFrame) -> pd.DataFrame:
    s, w = part["score"].to_numpy(float), part["weight"].to_numpy(float)
    return part[np.isfinite(s) & np.isfinite(w) & (w > 0)]


_OUT = "replicate bigint, year_month string, party string, dimension string, mean double, raw_iqr double"


def cluster_bootstrap(long: DataFrame, replicates: int = 5000, seed: int = 42, namespace: str = "joint_article_cluster", states: dict[str, dict] | None = None) -> DataFrame:
    """Mean and interquartile range of each month, party, dimension and replicate.

    A group is one month; its articles' counts are drawn once, alike for each of its dimensions, from ``states``
    if they are given.
    """
    rows = long.where("article is not null").select("year_month", "article", "party", "dimension", "score", "weight")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        month = pdf["year_month"].iloc[0]
        articles, at = np.unique(pdf["article"].to_numpy(), return_inverse=True)
        pdf = pdf.assign(at=at)
        names = [(party, dimension) for dimension, part in pdf.groupby("dimension", dropna=False) for party in part["party"].dropna().unique()]
        cells = [_Cell(_usable(part[part["party"] == party])) for _, part in pdf.groupby("dimension", dropna=False) for party in part["party"].dropna().unique()]
        sums = np.empty((len(articles), 5 * len(cells)))
        for i, cell in enumerate(cells):
            sums[:, 5 * i : 5 * i + 5] = cell.columns(len(articles))
        out = []
        drawing = _drawn_from(states[month], len(articles), replicates) if states else draws(len(articles), replicates, seed, f"{namespace}_{month}")
        for start, counts in drawing:
            made = counts.astype(float) @ sums
            for i, ((party, dimension), cell) in enumerate(zip(names, cells)):
                mean, iqr = cell.measured(counts, made[:, 5 * i : 5 * i + 5])
                out.append(pd.DataFrame({"replicate": np.arange(start, start + len(counts)), "year_month": month, "party": party, "dimension": dimension, "mean": mean, "raw_iqr": iqr}))
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in _OUT.split(", ")])

    made = by_group(rows, ["year_month"], one, _OUT)
    return made.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("mean", "raw_iqr")})


class _Cell:
    """Scores of one party and dimension of a month, in order, with those rows whose places a drawn quartile hardly leaves."""

    def __init__(self, part: pd.DataFrame, deviations: float = DEVIATIONS):
        s, order = part["score"].to_numpy(float), np.argsort(part["score"].to_numpy(float), kind="stable")
        self.s, self.w, self.at = s[order], part["weight"].to_numpy(float)[order], part["at"].to_numpy()[order]
        n = len(s)
        reach = deviations * np.sqrt(0.1875 * n) + 2
        self.inside = [(max(0, int(n * p - reach)), min(n, int(n * p + reach) + 1)) for p in (0.25, 0.75)]

    def columns(self, articles: int) -> np.ndarray:
        """For each article of the month its weight, weighted score and rows, and its rows before either bracket."""
        before = [np.arange(len(self.s)) < first for first, _ in self.inside]
        out = np.zeros((articles, 5))
        for i, v in enumerate((self.w, self.w * self.s, np.ones(len(self.s)), *before)):
            out[:, i] = np.bincount(self.at, weights=v, minlength=articles)
        return out

    def measured(self, counts: np.ndarray, sums: np.ndarray, minimum: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Weighted mean and linear interquartile range in each replicate; one whose quartile left its bracket is counted whole."""
        if not len(self.s):
            return np.full(len(counts), np.nan), np.full(len(counts), np.nan)
        mean = np.divide(sums[:, 1], sums[:, 0], out=np.full(len(counts), np.nan), where=sums[:, 0] > 0)
        n, ends, left = sums[:, 2].astype(np.int64), [], np.zeros(len(counts), bool)
        for p, (first, last), before in zip((0.25, 0.75), self.inside, sums[:, 3:].T.astype(np.int64)):
            cum = np.cumsum(counts[:, self.at[first:last]], axis=1, dtype=np.int64) + before[:, None]
            h = (n - 1).clip(min=0) * p
            low = np.floor(h)
            high = np.minimum(low + 1, (n - 1).clip(min=0))
            left |= (low < before) | (high >= cum[:, -1])
            a, b = (self.s[first:last][np.count_nonzero(cum <= rank[:, None], axis=1).clip(max=last - first - 1)] for rank in (low, high))
            ends.append(a + (h - low) * (b - a))
        iqr = np.where(n >= minimum, ends[1] - ends[0], np.nan)
        if (left := left & (n >= minimum)).any():
            iqr[left] = _weighted_iqr(self.s, counts[left][:, self.at], minimum)
        return mean, iqr


def _measured(part: pd.DataFrame, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted mean and interquartile range of one cell in each replicate."""
    s, w = part["score"].to_numpy(float), part["weight"].to_numpy(float)
    c = counts[:, part["at"].to_numpy()]
    if not len(s):
        return np.full(len(counts), np.nan), np.full(len(counts), np.nan)
    sums = c.astype(float) @ np.column_stack([w, w * s])
    mean = np.divide(sums[:, 1], sums[:, 0], out=np.full(len(c), np.nan), where=sums[:, 0] > 0)
    return mean, _weighted_iqr(s, c)


def _weighted_iqr(s: np.ndarray, counts: np.ndarray, minimum: int = 4) -> np.ndarray:
    """Linear interquartile range of scores repeated by counts, for every replicate at once."""
    order = np.argsort(s, kind="stable")
    s, cum = s[order], np.cumsum(counts[:, order], axis=1, dtype=np.int32)
    n = cum[:, -1]

    def at(rank: np.ndarray) -> np.ndarray:
        return s[np.count_nonzero(cum <= rank[:, None], axis=1).clip(max=len(s) - 1)]

    def quantile(p: float) -> np.ndarray:
        h = (n - 1).clip(min=0) * p
        low = np.floor(h)
        a, b = at(low), at(np.minimum(low + 1, (n - 1).clip(min=0)))
        return a + (h - low) * (b - a)

    return np.where(n >= minimum, quantile(0.75) - quantile(0.25), np.nan)


_PANEL = "replicate bigint, year_month string, polarization double, rep double, dem double"


def replicate_panels(long: DataFrame, dimension: str = "q1", replicates: int = 5000, seed: int = 42, namespace: str = "joint_article_cluster") -> DataFrame:
    """(replicate, year_month, polarization, rep, dem) of one dimension: gap and both parties' dispersion in each replicate, a row a month."""
    rows = long.where(F.col("article").isNotNull() & (F.col("dimension") == dimension)).select("year_month", "article", "party", "score", "weight")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        month = pdf["year_month"].iloc[0]
        articles, at = np.unique(pdf["article"].to_numpy(), return_inverse=True)
        pdf = pdf.assign(at=at)
        rep, dem = (_usable(pdf[pdf["party"] == p]) for p in PARTIES)
        out = []
        for start, counts in draws(len(articles), replicates, seed, f"{namespace}_{month}"):
            (m1, q1), (m2, q2) = _measured(rep, counts), _measured(dem, counts)
            out.append(pd.DataFrame({"replicate": np.arange(start, start + len(counts)), "year_month": month, "polarization": m1 - m2, "rep": q1, "dem": q2}))
        return pd.concat(out)

    return by_group(rows, ["year_month"], one, _PANEL)


_GAPS = "replicate bigint, year_month string, " + ", ".join(f"{q} double" for q in DIMENSIONS)


def replicate_gaps(long: DataFrame, replicates: int = 5000, seed: int = 42, namespace: str = "joint_article_cluster") -> DataFrame:
    """(replicate, year_month, q1..q4): the gaps of all dimensions in each replicate, a row a month; means need one product of matrices."""
    rows = long.where("article is not null").select("year_month", "article", "party", "dimension", "score", "weight")
    cells = [(p, q) for q in DIMENSIONS for p in PARTIES]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        month = pdf["year_month"].iloc[0]
        articles, at = np.unique(pdf["article"].to_numpy(), return_inverse=True)
        pdf = _usable(pdf.assign(at=at))
        sums = np.zeros((len(articles), 2 * len(cells)))
        for i, (p, q) in enumerate(cells):
            part = pdf[(pdf["party"] == p) & (pdf["dimension"] == q)]
            k, s, w = part["at"].to_numpy(), part["score"].to_numpy(float), part["weight"].to_numpy(float)
            np.add.at(sums[:, 2 * i], k, w)
            np.add.at(sums[:, 2 * i + 1], k, w * s)
        out = []
        for start, counts in draws(len(articles), replicates, seed, f"{namespace}_{month}"):
            t = counts.astype(float) @ sums
            mean = np.divide(t[:, 1::2], t[:, ::2], out=np.full((len(t), len(cells)), np.nan), where=t[:, ::2] > 0)
            gap = mean[:, ::2] - mean[:, 1::2]
            out.append(pd.DataFrame({"replicate": np.arange(start, start + len(t)), "year_month": month} | {q: gap[:, i] for i, q in enumerate(DIMENSIONS)}))
        return pd.concat(out)

    return by_group(rows, ["year_month"], one, _GAPS)


def stream_stability(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals (keys, ci_lower, ci_upper) of two independent streams: lengths, their ratio, and whether they are within a tenth of each other."""
    of = lambda df, n: df.select(*keys, F.col("ci_lower").alias(f"lower_{n}"), (F.col("ci_upper") - F.col("ci_lower")).alias(f"length_{n}"))
    both = of(first, 1).join(of(second, 2), keys)
    ratio = F.try_divide(F.col("length_2"), F.col("length_1"))
    return both.withColumn("length_ratio", ratio).withColumn("within_a_tenth", F.abs(ratio - 1) <= 0.1)


def attach(point: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals beside point estimates, one to one; a point without an interval keeps its row."""
    return point.join(intervals, keys, "left")
