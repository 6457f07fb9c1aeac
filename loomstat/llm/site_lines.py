"""Problem 6: lines repeated across the documents of one source, kept up incrementally.

The state has two tables that only grow: *counts*, one row for each (source,
line) and partition, in how many new documents it occurs; and *places*, where
each line stands in which document. ``advance`` takes a new partition of
documents:

* documents that the state has seen are dropped, and the lines of the rest counted:
  the delta;
* the delta's lines are looked up in the counts, which tells the lines that
  cross the threshold by this partition;
* the documents to rebuild are the new ones that hold a line at or over the
  threshold, and the old ones that hold a line newly over it. No other document is read.

A first partition, the bulk load, begins with the empty state. However the
documents are cut into partitions, the places found add up to those of one count
over all of them.

A line is known by two 64-bit hashes of source and normalised line, so that no
line text is shuffled or stored. Counting goes by (line, document) first and by line
afterwards, with partial sums before each shuffle, and joins on a line are
salted by document: neither a line that stands in a third of all documents nor a
source that has a third of them meets in one task.

Defined cases: a null source has no repeated lines; blank lines are never
repeated lines, but they are numbered; null and empty bodies have no lines; a
document sent again counts once, with the first partition that brings it; documents
without a load time come before all others.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstat.session import cut, read_table

#: Documents of one source from which on a line is repeated excessively.
THRESHOLD = 10
#: Months of loading that the queries add one by one to the bulk load of all months before.
INCREMENTS = 2
#: Parts in which the documents of one line are joined.
SALTS = 16

_BLANKS = r"(?U)[\s\x1c-\x1f]+"
_LINE = ["h1", "h2"]


def normal_source(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))


def normal_line(line: Column) -> Column:
    """Lower case, outer white space dropped, runs of white space as a blank, runs of digits as 0."""
    one_blank = F.trim(F.regexp_replace(F.lower(line), _BLANKS, " "))
    return F.regexp_replace(one_blank, r"[0-9]+", "0")


def occurrences(df: DataFrame, key: str, source: str, body: str, batch: Column | None = None) -> DataFrame:
    """(h1, h2, doc, line_nos, batch): each line of each document once, with the places where it stands."""
    lines = (
        df.select(F.col(key).alias("doc"), normal_source(F.col(source)).alias("src"), F.split(F.col(body), "\n").alias("lines"), (batch if batch is not None else F.lit(0)).alias("batch"))
        .where("src is not null")
        .select("doc", "src", "batch", F.posexplode("lines").alias("at", "raw"))
        .select("doc", "src", "batch", (F.col("at") + 1).cast("bigint").alias("line_no"), normal_line(F.col("raw")).alias("line"))
        .where("line <> ''")
        .select(F.xxhash64("src", "line").alias("h1"), F.xxhash64(F.lit(1), "line", "src").alias("h2"), "doc", "line_no", "batch")
    )
    return lines.groupBy("h1", "h2", "doc").agg(F.collect_set("line_no").alias("line_nos"), F.min("batch").alias("batch"))


def line_counts(found: DataFrame) -> DataFrame:
    """(h1, h2, batch, n_docs): what each batch adds to the counts; the delta of one batch if there is only one."""
    return found.groupBy("h1", "h2", "batch").agg(F.count(F.lit(1)).alias("n_docs"))


def merge(*tables: DataFrame) -> DataFrame:
    """(h1, h2, n_docs) from counts and deltas, in any order."""
    whole = tables[0].select("h1", "h2", "n_docs")
    for t in tables[1:]:
        whole = whole.unionByName(t.select("h1", "h2", "n_docs"))
    return whole.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))


def crossings(before: DataFrame, after: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Lines under the threshold before and not after; only their documents change."""
    return after.where(F.col("n_docs") >= threshold).join(before.where(F.col("n_docs") >= threshold).select("h1", "h2"), ["h1", "h2"], "left_anti")


def places(found: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, line_no) of the given lines; a hot line is joined in SALTS parts."""
    salted = lines.select("h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return found.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(salted, [*_LINE, "salt"]).select("doc", F.explode("line_nos").alias("line_no"))


def without_lines(df: DataFrame, key: str, body: str, at: DataFrame) -> DataFrame:
    """(key, body) of the documents that hold one of the places, without these lines."""
    drop = at.groupBy("doc").agg(F.collect_set("line_no").alias("drop_nos"))
    kept = F.expr(f"array_join(transform(filter(transform(split({body}, '\n'), (x, i) -> struct(x as line, cast(i + 1 as bigint) as no)), s -> not array_contains(drop_nos, s.no)), s -> s.line), '\n')")
    return df.select(key, body).join(drop, F.col(key) == F.col("doc")).select(key, kept.alias(body))


@dataclass(frozen=True)
class State:
    """Tables of one row for each partition and line, and for each line and document; empty at first."""

    counts: tuple[DataFrame, ...] = ()
    places: tuple[DataFrame, ...] = ()
    found: tuple[DataFrame, ...] = field(default=())

    def save(self, folder: str) -> None:
        """Each partition's tables in a folder of its own; those that are there already stay as they are."""
        for name, tables in (("counts", self.counts), ("places", self.places), ("found", self.found)):
            for i, t in enumerate(tables):
                t.write.mode("ignore").parquet(f"{folder}/{name}/step={i:06d}")

    @staticmethod
    def load(spark: SparkSession, folder: str, steps: int) -> State:
        read = lambda name: tuple(spark.read.parquet(f"{folder}/{name}/step={i:06d}") for i in range(steps))
        return State(read("counts"), read("places"), read("found"))


def _all(tables: tuple[DataFrame, ...], columns: list[str]) -> DataFrame:
    whole = tables[0].select(columns)
    for t in tables[1:]:
        whole = whole.unionByName(t.select(columns))
    return whole


def advance(state: State, df: DataFrame, key: str, source: str, body: str, threshold: int = THRESHOLD) -> State:
    """The state with a new partition; ``found[-1]`` has the places (doc, line_no) that this partition makes repeated ones."""
    new = occurrences(df, key, source, body).drop("batch")
    if state.places:
        new = new.join(_all(state.places, ["doc"]).distinct(), "doc", "left_anti").select("h1", "h2", "doc", "line_nos")
    new = cut(new)
    delta = cut(line_counts(new.withColumn("batch", F.lit(0))).select("h1", "h2", "n_docs"))
    if not state.counts:
        return State((delta,), (new,), (cut(places(new, delta.where(F.col("n_docs") >= threshold))),))
    # of the counts only the delta's lines matter
    before = cut(merge(_all(state.counts, ["h1", "h2", "n_docs"]).join(delta.select(_LINE), _LINE, "left_semi")))
    after = cut(merge(before, delta).where(F.col("n_docs") >= threshold))
    found = places(new, after).unionByName(places(_all(state.places, ["h1", "h2", "doc", "line_nos"]), crossings(before, after, threshold)))
    return State((*state.counts, delta), (*state.places, new), (*state.found, cut(found)))


def rebuilt(state: State, df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, body) of the documents that the last partition touches, without all lines found so far."""
    touched = state.found[-1].select("doc").distinct()
    at = _all(state.found, ["doc", "line_no"]).join(touched, "doc", "left_semi")
    return without_lines(df, key, body, at)


def replay(df: DataFrame, key: str, source: str, body: str, loaded: str, increments: int = INCREMENTS) -> list[tuple[State, DataFrame]]:
    """The state after the bulk load and after each of the last months of loading, with the partition that led there."""
    month = F.trunc(loaded, "month")
    first = df.select(key, source, body, month.alias("_month"))
    months = sorted(r[0] for r in first.select("_month").distinct().collect() if r[0] is not None)  # a row a month
    last = months[-increments:] if len(months) > increments else []
    old = first.where(F.col("_month").isNull() | (F.col("_month") < F.lit(last[0]))) if last else first
    out, state = [], State()
    for part in (old, *(first.where(F.col("_month") == F.lit(m)) for m in last)):
        state = advance(state, part, key, source, body)
        out.append((state, part))
    return out


def _replayed(spark: SparkSession, root: str) -> list[tuple[State, DataFrame]]:
    return replay(read_table(spark, root, "articles"), "article_no", "publisher", "body", "loaded_at")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Each non-blank line that stands in at least 10 articles of its publisher, as bulk load and monthly partitions bring them up."""
    state = _replayed(spark, root)[-1][0]
    return _all(state.found, ["doc", "line_no"]).select(F.col("doc").alias("article_no"), "line_no")


def p6_bodies(spark: SparkSession, root: str) -> DataFrame:
    """Every article's body without its repeated lines: of each partition's rebuilt bodies the last, and other articles' own."""
    once = read_table(spark, root, "articles").select("article_no", "body").dropDuplicates(["article_no"])
    versions = [rebuilt(state, once, "article_no", "body").withColumn("step", F.lit(i)) for i, (state, _) in enumerate(_replayed(spark, root))]
    last = versions[0]
    for v in versions[1:]:
        last = last.unionByName(v)
    last = last.groupBy("article_no").agg(F.max_by("body", "step").alias("clean"))
    return once.join(last, "article_no", "left").select("article_no", F.coalesce("clean", "body").alias("body"))


def p6_crossings(spark: SparkSession, root: str) -> DataFrame:
    """By month of loading: how many lines crossed the threshold by the delta of that month, if every month were a partition."""
    articles = read_table(spark, root, "articles")
    delta = line_counts(occurrences(articles, "article_no", "publisher", "body", F.trunc("loaded_at", "month")))
    # a line has at most one row a month here, so that these windows stay small
    order = Window.partitionBy("h1", "h2").orderBy(F.col("batch").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    running = delta.withColumn("after", F.sum("n_docs").over(order))
    crossed = running.where((F.col("after") >= THRESHOLD) & (F.col("after") - F.col("n_docs") < THRESHOLD))
    return crossed.groupBy(F.date_format("batch", "yyyy-MM").alias("load_month")).agg(F.count(F.lit(1)).alias("lines_crossed"))


ORACLE = {}
_SQL_LINES = r"""
WITH arts AS (SELECT article_no, lower(regexp_replace(any_value(publisher), '^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$', '', 'g')) AS src, any_value(body) AS body, date_trunc('month', min(loaded_at)) AS load_month FROM articles GROUP BY article_no),
lines AS (SELECT article_no, src, load_month, unnest(string_split(body, chr(10))) AS raw, generate_subscripts(string_split(body, chr(10)), 1) AS line_no FROM arts WHERE body IS NOT NULL),
norm AS (SELECT article_no, src, load_month, raw, CAST(line_no AS BIGINT) AS line_no, regexp_replace(trim(regexp_replace(lower(raw), '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+', ' ', 'g')), '[0-9]+', '0', 'g') AS line FROM lines),
hot AS (SELECT src, line FROM norm WHERE src IS NOT NULL AND line <> '' GROUP BY src, line HAVING count(DISTINCT article_no) >= 10)
"""
ORACLE["p6_found"] = _SQL_LINES + "SELECT DISTINCT article_no, line_no FROM norm JOIN hot USING (src, line)"
ORACLE["p6_bodies"] = _SQL_LINES + ", kept AS (SELECT article_no, coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (h.line IS NULL), '') AS body FROM norm n LEFT JOIN hot h ON n.src = h.src AND n.line = h.line GROUP BY 1) SELECT article_no, k.body FROM arts LEFT JOIN kept k USING (article_no)"
ORACLE["p6_crossings"] = _SQL_LINES + ", d AS (SELECT src, line, load_month, count(DISTINCT article_no) AS k FROM norm WHERE src IS NOT NULL AND line <> '' GROUP BY 1, 2, 3), r AS (SELECT *, sum(k) OVER (PARTITION BY src, line ORDER BY load_month NULLS FIRST) AS a FROM d) SELECT strftime(load_month, '%Y-%m') AS load_month, count(*) AS lines_crossed FROM r WHERE a >= 10 AND a - k < 10 GROUP BY 1"
