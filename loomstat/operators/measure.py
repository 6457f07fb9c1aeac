"""From scored records to monthly measures: roll-ups, weighted means, dispersion, gaps, index and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.session import cut

DIMENSIONS = ("q1", "q2", "q3", "q4")
PARTIES = ("republican", "democrat")


def first_value(column: str, order: str) -> Column:
    """First value that isn't null in the order of another column."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order)))


def normalize_party(c: Column) -> Column:
    """'rep' anywhere makes republican, else 'dem' makes democrat, else null; the order matters."""
    s = F.lower(F.trim(c))
    return F.when(s.contains("rep"), F.lit("republican")).when(s.contains("dem"), F.lit("democrat"))


def party_or_error(c: Column) -> Column:
    """As normalize_party, but a value that names no party is an error."""
    return F.coalesce(normalize_party(c), F.raise_error(F.concat(F.lit("no party: "), F.coalesce(c, F.lit("null")))))


def successful(df: DataFrame, error: str = "llm_error_type") -> DataFrame:
    """Rows that were scored without an error of any kind."""
    return df.where(F.col(error) == "success")


def with_fallback(df: DataFrame, name: str, other: str) -> DataFrame:
    """The column ``name``, or ``other`` under that name if there is none."""
    return df if name in df.columns else df.withColumn(name, F.col(other))


def with_row_numbers(df: DataFrame, name: str = "row_no") -> DataFrame:
    """Rows numbered from 0 in their order, as they were read: a count of each partition, and places within it.

    ``df`` should be a scan or a written table, whose partitions are the same whenever they are read.
    """
    parted = df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return parted.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def align(universe: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Every key of the universe, with null where the cells have none."""
    return universe.select(*keys).distinct().join(cells, keys, "left")


def lookup_last(df: DataFrame, dictionary: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """``value`` of the last row of the dictionary with the same key, as ``name``."""
    last = dictionary.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(name))
    return df.join(last, key, "left")


def article_party_rollup(scored: DataFrame, article: str = "article", party: str = "party", order: str = "row_no", carry: tuple[str, ...] = ("year_month",)) -> DataFrame:
    """Mean and number of scores of each dimension for each article and party, in one aggregation."""
    rows = scored.where(F.col(article).isNotNull() & F.col(party).isNotNull())
    scores = [a for q in DIMENSIONS for a in (F.avg(q).alias(f"{q}_score"), F.nullif(F.count(q), F.lit(0)).alias(f"{q}_n"))]
    return rows.groupBy(article, party).agg(*[first_value(c, order).alias(c) for c in carry], F.log1p(F.count(F.lit(1))).alias("weight"), *scores)


def unpivot_dimensions(rollup: DataFrame, ids: tuple[str, ...] = ("article", "party", "year_month", "weight")) -> DataFrame:
    """A row for each dimension, with its score."""
    wide = rollup.select(*ids, *[F.col(f"{q}_score").alias(q) for q in DIMENSIONS])
    return wide.unpivot(list(ids), list(DIMENSIONS), "dimension", "score")


def usable(score: str = "score", weight: str = "weight") -> Column:
    """Finite score and finite positive weight."""
    x, w = F.col(score), F.col(weight)
    infinite = float("inf")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite) & w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < infinite)


def weighted_mean(score: str = "score", weight: str = "weight") -> Column:
    ok = usable(score, weight)
    return F.try_divide(F.sum(F.when(ok, F.col(score) * F.col(weight))), F.sum(F.when(ok, F.col(weight))))


def raw_iqr(score: str = "score", minimum: int = 4, frequency: str | None = None) -> Column:
    """Exact linear interquartile range; null under the minimum number of values. ``frequency`` repeats values."""
    n = F.count(score) if frequency is None else F.sum(F.when(F.col(score).isNotNull(), F.col(frequency)))
    p = F.percentile(score, F.array(F.lit(0.25), F.lit(0.75)), *([F.col(frequency)] if frequency else []))
    return F.when(n >= minimum, p[1] - p[0])


#: Rank accuracy of the first look at a group's quartiles; groups of fewer rows are looked at whole.
ACCURACY = 10_000


def group_quartiles(df: DataFrame, keys: list[str], value: str, *more: Column) -> DataFrame:
    """(keys, n, q25, median, q75, more): exact linear quartiles of the values that aren't null, with a state that doesn't grow with the group.

    A quantile sketch first brackets each quartile by values within a known rank error; ``more`` are
    aggregates made in the same pass. Values are then counted: one by one inside a bracket, together outside, with
    map-side sums. The ranks wanted are read off the running counts, over the few distinct values that are left.
    ``df`` is read twice.
    """
    x = F.col(value).cast("double")
    e = 3 / ACCURACY
    wanted = [q + d for q in (0.25, 0.5, 0.75) for d in (-e, e)]
    few = F.col("n") < 2 * ACCURACY  # here a rank is worth more than the sketch's error
    made = df.groupBy(*keys).agg(F.count(x).alias("n"), F.min(x).alias("_min"), F.max(x).alias("_max"), F.percentile_approx(x, wanted, ACCURACY).alias("_b"), *more)
    ends = [F.when(few, F.col("_max" if i % 2 else "_min")).otherwise(F.col("_b")[i]).alias(f"_e{i}") for i in range(6)]
    groups = cut(made.select("*", *ends, F.monotonically_increasing_id().alias("_group")).drop("_min", "_max", "_b"))
    bound = groups.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_group", *[f"_e{i}" for i in range(6)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = df.where(F.col(value).isNotNull()).select(*keys, x.alias("_x")).join(bound, same)
    x, inside = F.col("_x"), F.lit(False)
    for i in (0, 2, 4):
        inside = inside | x.between(F.col(f"_e{i}"), F.col(f"_e{i + 1}"))
    # outside the brackets a value counts only by which of them it lies beyond
    beyond = sum((F.when(x > F.col(f"_e{i}"), 1).otherwise(0) for i in (1, 3, 5)), F.lit(0))
    place = F.struct(F.when(inside, x).when(beyond == 0, F.lit(float("-inf"))).when(beyond == 1, F.col("_e1")).when(beyond == 2, F.col("_e3")).otherwise(F.col("_e5")).alias("x"), F.when(inside, 0).otherwise(beyond).alias("beyond"))
    counted = rows.groupBy("_group", place.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    of_group = Window.partitionBy("_group")
    upto = counted.withColumns({"_upto": F.sum("_c").over(of_group.orderBy("_v")), "_n": F.sum("_c").over(of_group)})
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))["x"]
    ranks = {q: (F.col("_n") - 1) * q for q in (0.25, 0.5, 0.75)}
    found = upto.groupBy("_group", "_n").agg(*[at(f(h)).alias(f"_{side}{q}") for q, h in ranks.items() for side, f in (("a", F.floor), ("b", F.ceil))])
    between = lambda q, h: F.when(F.col(f"`_a{q}`") == F.col(f"`_b{q}`"), F.col(f"`_a{q}`")).otherwise((F.ceil(h) - h) * F.col(f"`_a{q}`") + (h - F.floor(h)) * F.col(f"`_b{q}`"))
    quartiles = found.select("_group", *[between(q, h).alias(name) for (q, h), name in zip(ranks.items(), ("q25", "median", "q75"))])
    return groups.drop(*[f"_e{i}" for i in range(6)]).join(quartiles, "_group", "left").drop("_group")


def monthly_stance(long: DataFrame) -> DataFrame:
    """Weighted mean, interquartile range and number of articles by month, party and dimension; ``long`` is read twice."""
    keys = ["year_month", "party", "dimension"]
    made = group_quartiles(long, keys, "score", weighted_mean().alias("mean"))
    return made.select(*keys, "mean", F.when(F.col("n") >= 4, F.col("q75") - F.col("q25")).alias("raw_iqr"), F.col("n").alias("n_articles"))


def monthly_polarization(stance: DataFrame) -> DataFrame:
    """Signed gap between the parties' means, by conditional aggregation."""
    of = lambda column, party: F.max(F.when(F.col("party") == party, F.col(column)))
    gap = stance.groupBy("year_month", "dimension").agg(of("mean", "republican").alias("rep_mean"), of("mean", "democrat").alias("dem_mean"), of("n_articles", "republican").alias("rep_n"), of("n_articles", "democrat").alias("dem_n"))
    return gap.withColumn("polarization", F.col("rep_mean") - F.col("dem_mean"))


def coherence(iqr: Column, k: Column) -> Column:
    return k / (k + iqr)


def index_intervals(replicates: DataFrame, b: int, dimension: str = "q1") -> DataFrame:
    """(year_month, n_valid, ci_lower, ci_upper) of the index, whose scale and k are recomputed in each replicate.

    A replicate without a positive scale and k is dropped; an interval needs 95 % of the ``b`` replicates.
    """
    made = composite_index(replicates.withColumn("n_articles", F.lit(None).cast("bigint")), dimension, by=("replicate",))
    return percentile_interval(made, ["year_month"], "index_value", b)


def composite_index(stance: DataFrame, dimension: str = "q1", by: tuple[str, ...] = ()) -> DataFrame:
    """P, the parties' coherence and their cube-root index, for each month (and replicate, if ``by`` names it).

    k is the median of both parties' interquartile ranges and the scale the
    largest absolute gap, both within each replicate. A month has one row there,
    so the windows span a calendar, not the data.
    """
    keys = [*by, "year_month"]
    of = lambda column, party: F.max(F.when(F.col("party") == party, F.col(column)))
    wide = stance.where(F.col("dimension") == dimension).groupBy(*keys).agg(
        *[of(c, p).alias(f"{s}_{c}") for c in ("mean", "raw_iqr", "n_articles") for p, s in (("republican", "rep"), ("democrat", "dem"))]
    )
    wide = cut(wide.withColumn("polarization", F.col("rep_mean") - F.col("dem_mean")))  # read twice
    scale = wide.select(*by, "polarization", F.explode(F.array("rep_raw_iqr", "dem_raw_iqr")).alias("iqr")).groupBy(*by).agg(F.max(F.abs("polarization")).alias("max_pol_used"), F.median("iqr").alias("k_used"))
    scale = scale.where("k_used > 0 and max_pol_used > 0")
    both = wide.join(scale, list(by)) if by else wide.crossJoin(scale)  # without ``by`` the scale is a single row
    k = F.col("k_used")
    both = both.withColumns({"P": F.abs("polarization") / F.col("max_pol_used"), "C_R": coherence(F.col("rep_raw_iqr"), k), "C_D": coherence(F.col("dem_raw_iqr"), k)})
    return both.withColumn("index_value", 100 * F.cbrt(F.col("P") * F.col("C_R") * F.col("C_D")))


def message_coherence_long(index: DataFrame) -> DataFrame:
    """Both parties' dispersion and coherence, one row each."""
    side = lambda p, s, c: index.select("year_month", F.lit(p).alias("party"), F.col(f"{s}_raw_iqr").alias("raw_iqr"), F.col(c).alias("message_coherence"), F.col(f"{s}_n_articles").alias("n_articles"), "k_used")
    return side("republican", "rep", "C_R").unionByName(side("democrat", "dem", "C_D"))


def percentile_interval(df: DataFrame, keys: list[str], value: str, replicates: int, valid_share: float = 0.95, bounds: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """Percentile interval of finite replicates, null unless enough of them are valid, and how many are."""
    x = F.when(~F.isnan(value), F.col(value))
    p = F.percentile(x, F.array(*map(F.lit, bounds)))
    enough = F.count(x) >= -(-int(replicates * valid_share * 1000) // 1000)
    return df.groupBy(*keys).agg(F.count(x).alias("n_valid"), F.when(enough, p).alias("ci")).select(*keys, "n_valid", F.col("ci")[0].alias("ci_lower"), F.col("ci")[1].alias("ci_upper"))


def replicate_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, standard error, interval and sign probability of replicates."""
    x = F.col(value)
    p = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("standard_error"), p[0].alias("ci_lower"), p[1].alias("ci_upper"), F.avg((x < 0).cast("int")).alias("probability_negative"), F.avg((x > 0).cast("int")).alias("probability_positive"))


def simultaneous_radius(df: DataFrame, first: str, second: str, level: float = 0.95) -> DataFrame:
    """Level of the larger of two absolute deviations: half the width of a joint band."""
    return df.agg(F.percentile(F.greatest(F.abs(first), F.abs(second)), level).alias("radius"))


def prefix_stability(df: DataFrame, keys: list[str], replicate: str, value: str, prefixes: tuple[int, ...]) -> DataFrame:
    """Interval of the first k replicates of each group for each k under its last one, and of all of them.

    (keys, prefix, is_full, n_valid, ci_lower, ci_upper, length, length_ratio, endpoint_deviation): the ratio of the
    lengths, and the larger distance of an endpoint from that of the full interval, over the full length.
    """
    of_group = Window.partitionBy(*keys)
    last = df.groupBy(*keys).agg(F.max(replicate).alias("_last"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        last = last.withColumnRenamed(k, f"_k{i}")
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    k_of = F.array_append(F.filter(F.array(*map(F.lit, prefixes)), lambda p: (p < F.col("_last")) & (p >= F.col(replicate))), F.col("_last"))
    rows = df.join(last, same).select(*keys, value, "_last", F.explode(k_of).alias("prefix"))
    p = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    each = rows.groupBy(*keys, "prefix").agg(F.max("_last").alias("_last"), F.count(value).alias("n_valid"), p[0].alias("ci_lower"), p[1].alias("ci_upper"))
    each = each.withColumns({"is_full": F.col("prefix") == F.col("_last"), "length": F.col("ci_upper") - F.col("ci_lower")})
    full = lambda c: F.max(F.when(F.col("is_full"), F.col(c))).over(of_group)
    off = F.greatest(F.abs(F.col("ci_lower") - full("ci_lower")), F.abs(F.col("ci_upper") - full("ci_upper")))
    return each.withColumns({"length_ratio": F.try_divide(F.col("length"), full("length")), "endpoint_deviation": F.try_divide(off, full("length"))}).drop("_last")


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row for each key, the first in order: a deterministic survivor."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def best_row(df: DataFrame, keys: list[str], objective: str, ties: list[str], tolerance: float = 1e-5) -> DataFrame:
    """The row with the least objective; within the tolerance the first by ``ties``."""
    low = F.min(objective).over(Window.partitionBy(*keys))
    return keep_first(df.withColumn("_low", low).where(F.col(objective) <= F.col("_low") + tolerance).drop("_low"), keys, ties)


def config_frequency(df: DataFrame, cell: str, config: str, objective: str) -> DataFrame:
    """How often each configuration was found in its cell, its best objective, and how far that is from the cell's best."""
    each = df.groupBy(cell, config).agg(F.count(F.lit(1)).alias("run_frequency"), F.min(objective).alias("best_objective"))
    w = Window.partitionBy(cell)
    return each.withColumns({"run_proportion": F.col("run_frequency") / F.sum("run_frequency").over(w), "delta_from_best": F.col("best_objective") - F.min("best_objective").over(w)}).withColumn("is_winner", F.col("delta_from_best") == 0)


def stratified_sample(df: DataFrame, strata: list[str], per_stratum: int, key: Column) -> DataFrame:
    """The rows with the smallest keys of each stratum; only that many leave a task."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*strata).orderBy(key))).where(F.col("_n") <= per_stratum).drop("_n")
