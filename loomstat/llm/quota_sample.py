"""Problem 1: a sample whose categories match target proportions.

The targets are a two-way table, party by month. What a category can get is its
target, kept between its minimum and the rows it has; a common factor is found
with which these fractional numbers add up to the sample's size. The table is
made integer by controlled rounding: a flow from parties over categories to
months, in which every category, party total and month total may be its floor
or its ceiling; a maximal flow exists because the fractional table is itself
one, and an integer one because all bounds are integers. Then each category
draws its exact number of rows, the ones with the smallest random keys.

The targets are parameters (one row for each category) and the counts have as
many rows, so both are handled on the driver; rows aren't.

Defined cases: a record sent again counts once; records whose party or month
cannot be read belong to no category; a null target or minimum is 0; empty
targets give an empty sample; a sample size beyond the rows there are draws all
rows that categories have.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstat.llm.binding import let
from loomstat.session import read_table

SEED = 42
#: Parts in which a category is ranked first, so that none meets in one task whole.
SALTS = 64


def party_of(c: Column) -> Column:
    """republican or democrat from any notation, else null."""

    def read(s: Column) -> Column:
        rep = s.rlike("^((the)?(gop|rep(s|ublican|ublicans|ublicanparty|ublicansparty|party)?)|r)$")
        dem = s.rlike("^((the)?dem(s|ocrat|ocrats|ocratic|ocraticparty|ocratsparty|ocratparty|party)?|d)$")
        return F.when(rep, F.lit("republican")).when(dem, F.lit("democrat"))

    return let(F.regexp_replace(F.lower(c), "[^a-z]", ""), read)


def month_of(c: Column) -> Column:
    """'yyyy-MM' from any notation of a day, else null."""
    names = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    months = F.array(*map(F.lit, names))

    def read(s: Column) -> Column:
        # year, month as a number or a name
        forms = [
            (r"^(\d{4})[-/.](\d{1,2})[-/.]\d{1,2}([t ].*)?$", 1, 2),
            (r"^(\d{4})(\d{2})\d{2}$", 1, 2),
            (r"^\d{1,2}\.(\d{1,2})\.(\d{4})$", 2, 1),
            (r"^\d{1,2}[. -]+([a-z]{3})[a-z]*\.?,?[ -]+(\d{4})$", 2, 1),
            (r"^([a-z]{3})[a-z]*\.? \d{1,2},? (\d{4})$", 2, 1),
        ]
        return F.coalesce(*[F.when(s.rlike(p), F.struct(F.regexp_extract(s, p, y).alias("y"), F.regexp_extract(s, p, m).alias("m"))) for p, y, m in forms])

    def numbered(v: Column) -> Column:
        return F.struct(v["y"].alias("y"), F.lpad(F.coalesce(F.nullif(F.array_position(months, v["m"]), F.lit(0)).cast("string"), v["m"]), 2, "0").alias("m"))

    def joined(v: Column) -> Column:
        return F.when(v["m"].rlike("^(0[1-9]|1[0-2])$"), F.concat_ws("-", v["y"], v["m"]))

    return let(F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))), lambda s: let(read(s), lambda v: let(numbered(v), joined)))


def categorised(df: DataFrame) -> DataFrame:
    """(sample_id, party_mentioned, year_month): the readable category of each record, once."""
    return df.select("sample_id", party_of(F.col("party_mentioned")).alias("party_mentioned"), month_of(F.col("date")).alias("year_month")).dropna().distinct()


def fractional(targets: list[float], low: list[int], high: list[int], size: int) -> list[float]:
    """Targets times a common factor, kept between low and high, that add up to ``size`` as far as ``high`` allows."""
    total = min(size, sum(high))
    low = [min(a, b) for a, b in zip(low, high)]
    if sum(low) >= total:  # the minima alone fill the sample
        f = total / max(1, sum(low))
        return [a * f for a in low]
    if not sum(targets):
        targets = [1.0] * len(targets)
    at = lambda f: [min(b, max(a, f * t)) for t, a, b in zip(targets, low, high)]
    lo, hi = 0.0, 1.0
    while sum(at(hi)) < total - 1e-9 and hi < 1e12:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(at(mid)) < total else (lo, mid)
    out = at(hi)
    short = total - sum(out)
    for i in range(len(out)):  # a category without a target has room that no factor reaches
        if short > 1e-6 and not targets[i]:
            more = min(high[i] - out[i], short)
            out[i] += more
            short -= more
    return out


class _Flow:
    """Maximal flow by shortest augmenting paths."""

    def __init__(self, n: int) -> None:
        self.to: list[int] = []
        self.cap: list[int] = []
        self.at: list[list[int]] = [[] for _ in range(n)]

    def edge(self, a: int, b: int, cap: int) -> int:
        self.at[a].append(len(self.to))
        self.to.append(b)
        self.cap.append(cap)
        self.at[b].append(len(self.to))
        self.to.append(a)
        self.cap.append(0)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            via, queue = {s: -1}, deque([s])
            while queue and t not in via:
                x = queue.popleft()
                for e in self.at[x]:
                    if self.cap[e] and self.to[e] not in via:
                        via[self.to[e]] = e
                        queue.append(self.to[e])
            if t not in via:
                return total
            path, x = [], t
            while x != s:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            step = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= step
                self.cap[e ^ 1] += step
            total += step


def controlled_rounding(cells: dict[tuple[str, str], float]) -> dict[tuple[str, str], int]:
    """Integers next to the cells' values, whose row, column and whole sums are next to theirs."""
    eps = 1e-7
    low = lambda v: math.floor(v + eps)
    up = lambda v: math.ceil(v - eps)
    rows, cols = sorted({r for r, _ in cells}), sorted({c for _, c in cells})
    row = {r: sum(v for (a, _), v in cells.items() if a == r) for r in rows}
    col = {c: sum(v for (_, b), v in cells.items() if b == c) for c in cols}
    names = ["s", "t", "S", "T", *(("r", r) for r in rows), *(("c", c) for c in cols)]
    node = {x: i for i, x in enumerate(names)}
    flow, need = _Flow(len(names)), 0
    # lower bounds: what must pass is moved to the super source S and super sink T
    def bounded(a: object, b: object, lo: int, hi: int) -> int:
        nonlocal need
        e = flow.edge(node[a], node[b], hi - lo)
        if lo:
            flow.edge(node["S"], node[b], lo)
            flow.edge(node[a], node["T"], lo)
            need += lo
        return e

    for r in rows:
        bounded("s", ("r", r), low(row[r]), up(row[r]))
    edges = {k: (bounded(("r", k[0]), ("c", k[1]), low(v), up(v)), low(v)) for k, v in sorted(cells.items())}
    for c in cols:
        bounded(("c", c), "t", low(col[c]), up(col[c]))
    total = round(sum(cells.values()))
    bounded("t", "s", total, total)
    if flow.run(node["S"], node["T"]) != need:
        raise ArithmeticError("no controlled rounding; the cells don't add up to an integer")
    return {k: lo + flow.cap[e ^ 1] for k, (e, lo) in edges.items()}


def quotas(records: DataFrame, targets: DataFrame) -> list[tuple]:
    """(party_mentioned, year_month, target, min_rows, available, quota) of each category of the targets."""
    rows = targets.groupBy("party_mentioned", "year_month").agg(F.first("target_share").alias("share"), F.max("min_rows").alias("low"), F.max("sample_size").alias("size")).dropna(subset=["party_mentioned", "year_month"])
    wanted = rows.orderBy("party_mentioned", "year_month").collect()
    counted = {(r[0], r[1]): r[2] for r in records.join(F.broadcast(rows.select("party_mentioned", "year_month")), ["party_mentioned", "year_month"], "left_semi").groupBy("party_mentioned", "year_month").agg(F.countDistinct("sample_id")).collect()}
    if not wanted:
        return []
    size = max(r["size"] or 0 for r in wanted)
    have = [counted.get((r[0], r[1]), 0) for r in wanted]
    share, low = [r["share"] or 0.0 for r in wanted], [r["low"] or 0 for r in wanted]
    cells = dict(zip([(r[0], r[1]) for r in wanted], fractional([s * size for s in share], low, have, size)))
    whole = controlled_rounding(cells)
    return [(r[0], r[1], float(s * size), int(m), int(h), int(whole[(r[0], r[1])])) for r, s, m, h in zip(wanted, share, low, have)]


def report(spark: SparkSession, records: DataFrame, targets: DataFrame) -> DataFrame:
    """Each category with its target, minimum, available rows and quota, and whether the target could be met."""
    schema = "party_mentioned string, year_month string, target double, min_rows bigint, available bigint, quota bigint"
    return spark.createDataFrame(quotas(records, targets), schema).withColumn("met", (F.col("available") >= F.col("min_rows")) & (F.col("available") >= F.col("target")))


def draw(records: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """The drawn records: in each category those with the smallest keys, exactly as many as its quota."""
    one = records.groupBy("sample_id").agg(F.min(F.struct("party_mentioned", "year_month")).alias("k")).select("sample_id", "k.*")
    keyed = one.join(F.broadcast(plan.select("party_mentioned", "year_month", "quota")), ["party_mentioned", "year_month"]).withColumn("key", F.xxhash64(F.lit(seed), "sample_id"))
    part = Window.partitionBy("party_mentioned", "year_month", F.pmod("sample_id", F.lit(SALTS))).orderBy("key", "sample_id")
    near = keyed.withColumn("n", F.row_number().over(part)).where("n <= quota")
    whole = Window.partitionBy("party_mentioned", "year_month").orderBy("key", "sample_id")
    return near.withColumn("n", F.row_number().over(whole)).where("n <= quota").select("sample_id", "party_mentioned", "year_month")


def _inputs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return categorised(read_table(spark, root, "manual_coding_full")), read_table(spark, root, "sample_targets")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Categories whose target could not be met."""
    return report(spark, *_inputs(spark, root)).where("not met").select("party_mentioned", "year_month")


def p1_report(spark: SparkSession, root: str) -> DataFrame:
    """All categories with target, minimum, available rows and quota."""
    return report(spark, *_inputs(spark, root))


def p1_sample(spark: SparkSession, root: str) -> DataFrame:
    """The drawn sentences with their category."""
    records, targets = _inputs(spark, root)
    return draw(records, report(spark, records, targets))


ORACLE = {"p1_found": r"""
WITH r AS (SELECT DISTINCT sample_id, regexp_replace(lower(party_mentioned), '[^a-z]', '', 'g') AS p, trim(date) AS d FROM manual_coding_full),
c AS (SELECT DISTINCT sample_id,
 CASE WHEN p IN ('gop', 'r') OR regexp_full_match(p, 'rep(s|ublican|ublicans|ublicanparty)?') THEN 'republican' WHEN p = 'd' OR regexp_full_match(p, 'dem(s|ocrat|ocrats|ocratic|ocraticparty)?') THEN 'democrat' END AS party_mentioned,
 CASE WHEN regexp_matches(d, '^\d{4}-\d\d-\d\d') THEN left(d, 7) WHEN regexp_matches(d, '^\d{4}/\d\d/\d\d') THEN replace(left(d, 7), '/', '-') WHEN regexp_full_match(d, '\d{8}') THEN left(d, 4) || '-' || substr(d, 5, 2)
  WHEN regexp_full_match(d, '\d\d [A-Z][a-z][a-z] \d{4}') THEN strftime(strptime(d, '%d %b %Y'), '%Y-%m') END AS year_month FROM r),
n AS (SELECT party_mentioned, year_month, count(DISTINCT sample_id) AS n FROM c GROUP BY 1, 2)
SELECT t.party_mentioned, t.year_month FROM sample_targets t LEFT JOIN n USING (party_mentioned, year_month)
WHERE coalesce(n, 0) < min_rows OR coalesce(n, 0) < target_share * sample_size"""}
