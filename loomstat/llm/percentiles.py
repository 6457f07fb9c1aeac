"""Problem 4: percentiles of very large columns by deterministic buffer collapsing.

A summary has buffers of K sorted values at each level; a value of level h
stands for 2^h values. Two full buffers of a level collapse into one of the next:
their 2K values are merged in order and every second one is kept, beginning with
the first or the second in turn. A collapse at level h moves a rank by at most
2^h, and the summary adds these up: the bound that is reported is a fact about
this very summary, not a probability. Up to K values a summary is exact.

Summaries of the same K combine by adding their buffers and collapsing; the
order is that of month and part, a balanced tree by the levels themselves. So
summaries are kept by single months of ``computed_at`` and combined afterwards,
FAN parts at a time, until one is left.

A group is spread over parts by its replicate number, as many as keep a part at
PART_ROWS, so that a group with a third of all rows is a small share of any task;
sent-again rows of one key meet in one part and are dropped there in a stream
sorted by key.

Defined cases: null and NaN are left out; a key counts once, in the month in
which it was computed first; null keys are a group of their own; a group
without values has no rows; -0.0 and infinities are ordinary values. The
percentile p of n values is the value of rank ceil(p n / 100).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm.arrowmap import arrow_schema, map_tasks
from loomstat.session import read_table

K, PART_ROWS, FAN = 4096, 2_000_000, 32
PERCENTILES = (1, 5, 25, 50, 75, 95, 99)
MEASURES = ("mean", "raw_iqr")


class Summary:
    """Buffers by level; ``error`` bounds how far any rank can be off."""

    def __init__(self, k: int = K) -> None:
        self.k, self.n, self.error = k, 0, 0
        self.levels: list[list[np.ndarray]] = [[]]
        self.turn: list[int] = [0]
        self.loose: list[np.ndarray] = []
        self.n_loose = 0

    def add(self, values: np.ndarray) -> None:
        """Values in any order; full buffers are sorted and collapse as they come."""
        if len(values):
            self.n += len(values)
            self.loose.append(values)
            self.n_loose += len(values)
            self._settle()

    def _settle(self) -> None:
        if self.n_loose >= self.k:
            flat = np.concatenate(self.loose)
            cutoff = len(flat) // self.k * self.k
            for i in range(0, cutoff, self.k):
                self._put(0, np.sort(flat[i : i + self.k]))
            self.loose, self.n_loose = [flat[cutoff:]], len(flat) - cutoff

    def _put(self, level: int, buffer: np.ndarray) -> None:
        while True:
            if level == len(self.levels):
                self.levels.append([])
                self.turn.append(0)
            self.levels[level].append(buffer)
            if len(self.levels[level]) < 2:
                return
            both = np.sort(np.concatenate(self.levels[level]), kind="stable")
            self.levels[level] = []
            buffer = both[self.turn[level] :: 2]
            self.turn[level] ^= 1
            self.error += 1 << level
            level += 1

    def merge(self, other: "Summary") -> None:
        self.n += other.n
        self.error += other.error
        for level, buffers in enumerate(other.levels):
            for b in buffers:
                while level >= len(self.levels):
                    self.levels.append([])
                    self.turn.append(0)
                self._put(level, b)
        self.loose += other.loose
        self.n_loose += other.n_loose
        self._settle()

    def rows(self) -> Iterator[tuple[int, np.ndarray]]:
        """(level, values) of all buffers; level -1 for values not yet in one."""
        if self.n_loose:
            yield -1, np.concatenate(self.loose)
        for level, buffers in enumerate(self.levels):
            for b in buffers:
                yield level, b

    def quantiles(self, shares: Iterable[float]) -> list[float]:
        parts = list(self.rows())
        values = np.concatenate([b for _, b in parts])
        weights = np.concatenate([np.full(len(b), 1 << max(0, h), np.int64) for h, b in parts])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        at = [min(len(ranks) - 1, int(np.searchsorted(ranks, max(1, -(-self.n * p // 100))))) for p in shares]
        return values[order][at].tolist()


_SUMMARY = "year_month string, party string, dimension string, measure string, computed_month string, part int, level int, n bigint, error bigint, buffer array<double>"
_RESULT = "year_month string, party string, dimension string, measure string, percentile int, value double, n bigint, rank_error_bound bigint"


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def parts_of(df: DataFrame) -> int:
    """In how many parts the rows of a group are summarised."""
    return max(1, -(-df.count() // PART_ROWS))


def month_summaries(df: DataFrame, k: int = K, parts: int | None = None) -> DataFrame:
    """A row for each buffer of each summary: group, measure, month of computed_at, part."""
    parts = parts or parts_of(df)
    rows = df.select(
        "year_month", "party", "dimension", F.pmod(F.xxhash64("replicate"), F.lit(parts)).cast("int").alias("part"), "replicate",
        F.date_format("computed_at", "yyyy-MM").alias("computed_month"), *[F.nanvl(m, F.lit(None)).alias(m) for m in MEASURES], "computed_at",
    )
    group = ["year_month", "party", "dimension", "part"]
    ordered = rows.repartition(*group).sortWithinPartitions(*group, "replicate", "computed_at").drop("computed_at")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        last: int | None = None
        open_: dict[tuple[str, str | None], Summary] = {}

        def close() -> Iterator[pa.RecordBatch]:
            out = []
            for (m, month), s in open_.items():
                for i, (level, b) in enumerate(s.rows()):
                    out.append((*now[:3], m, month, now[3], level, s.n if i == 0 else 0, s.error if i == 0 else 0, b))
            open_.clear()
            if out:
                yield _emit(out, schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [np.asarray(batch.column(c).dictionary_encode().indices.fill_null(-1)) for c in group[:3]] + [batch.column("part").to_numpy()]
            change = np.zeros(batch.num_rows, bool)
            for c in codes:
                change[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            replicate = batch.column("replicate").to_numpy()
            months = batch.column("computed_month").dictionary_encode()
            month_names, month_codes = months.dictionary.to_pylist(), np.asarray(months.indices.fill_null(-1))
            values = {m: batch.column(m).to_numpy(zero_copy_only=False) for m in MEASURES}
            for a, b in zip(starts, starts[1:]):
                if a == b:
                    continue
                key = tuple(batch.column(c)[a].as_py() for c in group)
                if key != now:
                    yield from close()
                    now, last = key, None
                r = replicate[a:b]
                fresh = np.ones(b - a, bool)
                fresh[1:] = r[1:] != r[:-1]
                fresh[0] = last is None or r[0] != last
                last = int(r[-1])
                codes_ab = month_codes[a:b]
                for code in np.unique(codes_ab):
                    of = fresh & (codes_ab == code)
                    month = month_names[code] if code >= 0 else None
                    for m in MEASURES:
                        v = values[m][a:b][of]
                        v = v[~np.isnan(v)]
                        if len(v):
                            open_.setdefault((m, month), Summary(k)).add(v)
        yield from close()

    schema = arrow_schema(df, _SUMMARY)
    return map_tasks(ordered, run, _SUMMARY)


def _merged(summaries: DataFrame, group: list[str], k: int, result: str, emit: Callable[[tuple, Summary], list[tuple]]) -> DataFrame:
    """Summaries of a group merged in the order of month and part, and what ``emit`` makes of each."""
    ordered = summaries.repartition(*group).sortWithinPartitions(*group, "computed_month", "part", "level", F.col("n").desc())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, s = None, Summary(k)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in group]
            levels, ns, errors, buffers = batch.column("level").to_pylist(), batch.column("n").to_pylist(), batch.column("error").to_pylist(), batch.column("buffer")
            for i, key in enumerate(zip(*columns)):
                if key != now:
                    if s.n:
                        yield _emit(emit(now, s), schema)
                    now, s = key, Summary(k)
                one = Summary(k)
                one.n, one.error = ns[i], errors[i]
                b = buffers[i].values.to_numpy(zero_copy_only=False)
                if levels[i] < 0:
                    one.loose, one.n_loose = [b], len(b)
                else:
                    one.levels = [[] for _ in range(levels[i])] + [[b]]
                s.merge(one)
        if s.n:
            yield _emit(emit(now, s), schema)

    schema = arrow_schema(summaries, result)
    return map_tasks(ordered, run, result)


def combined(summaries: DataFrame, k: int = K, percentiles: tuple[int, ...] = PERCENTILES, parts: int = 1) -> DataFrame:
    """Percentiles of each group and measure, from any set of its summaries; ``parts`` is how many a group has at most."""
    group = ["year_month", "party", "dimension", "measure"]

    def buffers(key: tuple, s: Summary) -> list[tuple]:
        return [(*key[:4], None, key[4], level, s.n if i == 0 else 0, s.error if i == 0 else 0, b) for i, (level, b) in enumerate(s.rows())]

    while parts > FAN:
        parts = -(-parts // FAN)
        summaries = _merged(summaries.withColumn("part", F.expr(f"cast(part div {FAN} as int)")), [*group, "part"], k, _SUMMARY, buffers)
    return _merged(summaries, group, k, _RESULT, lambda key, s: [(*key, p, v, s.n, s.error) for p, v in zip(percentiles, s.quantiles(percentiles))])


def percentiles_of(df: DataFrame, k: int = K) -> DataFrame:
    parts = parts_of(df)
    return combined(month_summaries(df, k, parts), k, parts=parts)


def p4_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles of mean and raw_iqr for each month, party and dimension, with the bound on the rank's error."""
    return percentiles_of(read_table(spark, root, "monthly_stance"))


def ranks_off(df: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with how far each value's rank among the group's values is from the rank it stands for, by counting them."""
    group = ["year_month", "party", "dimension"]
    once = df.groupBy(*group, "replicate").agg(*[F.max(m).alias(m) for m in MEASURES])
    long = once.unpivot([*group, "replicate"], list(MEASURES), "measure", "x").where("x is not null and not isnan(x)")
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"f.{c}")) for c in [*group, "measure"]]
    per = found.groupBy(*group, "measure").agg(F.collect_list(F.struct("percentile", "value", "n", "rank_error_bound")).alias("p"))  # a row for each percentile
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    rows = long.alias("v").join(per.alias("f"), cond).select(*[f"f.{c}" for c in [*group, "measure"]], "x", F.explode("p").alias("p"))
    counted = rows.groupBy(*group, "measure", "p").agg(F.count_if(F.col("x") < F.col("p.value")).alias("under"), F.count_if(F.col("x") <= F.col("p.value")).alias("upto"))
    rank = F.expr("greatest(1, (p.n * p.percentile + 99) div 100)")
    return counted.select(*group, "measure", "p.*", F.greatest(F.lit(0), F.col("under") + 1 - rank, rank - F.col("upto")).alias("off"))


def p4_bound_holds(spark: SparkSession, root: str) -> DataFrame:
    """With small buffers of 64 values, which collapse in every group of some size: whether each group's ranks keep to the bound they report."""
    df = read_table(spark, root, "monthly_stance")
    checked = ranks_off(df, percentiles_of(df, 64))
    return checked.groupBy("year_month", "party", "dimension", "measure").agg(F.max("n").alias("n"), F.bool_and(F.col("off") <= F.col("rank_error_bound")).alias("within"), (F.max("rank_error_bound") > 0).alias("collapsed"))


def p4_month_summaries(spark: SparkSession, root: str) -> DataFrame:
    """The summaries themselves: how many values each holds and the size of its buffers."""
    group = ["year_month", "party", "dimension", "measure", "computed_month"]
    return month_summaries(read_table(spark, root, "monthly_stance")).groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.size("buffer").cast("bigint")).alias("n_kept"), F.sum("error").alias("rank_error_bound"))


#: Exact percentiles; where no group exceeds K values the summaries give the same.
ORACLE = {
    "p4_percentiles": """
WITH once AS (SELECT year_month, party, dimension, replicate, any_value(mean) AS m, any_value(raw_iqr) AS q FROM monthly_stance GROUP BY ALL),
long AS (SELECT year_month, party, dimension, 'mean' AS measure, m AS x FROM once UNION ALL SELECT year_month, party, dimension, 'raw_iqr', q FROM once),
ranked AS (SELECT *, row_number() OVER (PARTITION BY year_month, party, dimension, measure ORDER BY x) AS r, count(*) OVER (PARTITION BY year_month, party, dimension, measure) AS n FROM long WHERE x IS NOT NULL AND NOT isnan(x)),
p AS (SELECT unnest([1, 5, 25, 50, 75, 95, 99]) AS percentile)
SELECT year_month, party, dimension, measure, CAST(percentile AS INTEGER) AS percentile, x AS value, n, CAST(0 AS BIGINT) AS rank_error_bound FROM ranked, p WHERE r = greatest(1, (n * percentile + 99) // 100)""",
    "p4_bound_holds": """
WITH once AS (SELECT year_month, party, dimension, replicate, any_value(mean) AS m, any_value(raw_iqr) AS q FROM monthly_stance GROUP BY ALL),
long AS (SELECT year_month, party, dimension, 'mean' AS measure, m AS x FROM once UNION ALL SELECT year_month, party, dimension, 'raw_iqr', q FROM once)
SELECT year_month, party, dimension, measure, count(*) AS n, true AS "within", count(*) >= 128 AS collapsed FROM long WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY ALL""",
    "p4_month_summaries": """
WITH once AS (SELECT year_month, party, dimension, replicate, strftime(min(computed_at), '%Y-%m') AS computed_month, any_value(mean) AS m, any_value(raw_iqr) AS q FROM monthly_stance GROUP BY year_month, party, dimension, replicate),
long AS (SELECT year_month, party, dimension, computed_month, 'mean' AS measure, m AS x FROM once UNION ALL SELECT year_month, party, dimension, computed_month, 'raw_iqr', q FROM once)
SELECT year_month, party, dimension, measure, computed_month, count(*) AS n, count(*) AS n_kept, CAST(0 AS BIGINT) AS rank_error_bound FROM long WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY ALL""",
}
