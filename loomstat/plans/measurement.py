"""Queries of roll-ups, measures, contracts, resampling and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.operators import agreement as A
from loomstat.operators import contracts as C
from loomstat.operators import measure as M
from loomstat.operators import report as R
from loomstat.operators import resample as B
from loomstat.functions import text as X
from loomstat.plans import inputs as I
from loomstat.session import cut, read_table

#: Replicates of the hash bootstrap in the queries.
REPLICATES = 500
#: Prefixes of replicates whose intervals are compared with that of all.
PREFIXES = (100, 500, 1000, 2000, 5000)


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def r10(*names: str) -> list:
    """For means of a few short decimals, which at six places could lie halfway."""
    return [F.round(n, 10).alias(n) for n in names]


def monthly_weighted_stance(spark: SparkSession, root: str) -> DataFrame:
    return I.stance(spark, root).select("year_month", "party", "dimension", *r6("mean", "raw_iqr"), "n_articles")


def monthly_polarization(spark: SparkSession, root: str) -> DataFrame:
    return I.gap(spark, root).select("year_month", "dimension", *r6("rep_mean", "dem_mean", "polarization"), "rep_n", "dem_n")


def party_index_timeseries(spark: SparkSession, root: str) -> DataFrame:
    return M.composite_index(I.stance(spark, root)).select("year_month", *r6("polarization", "P", "C_R", "C_D", "index_value", "k_used", "max_pol_used"))


def message_coherence_long(spark: SparkSession, root: str) -> DataFrame:
    return M.message_coherence_long(M.composite_index(I.stance(spark, root))).select("year_month", "party", *r6("raw_iqr", "message_coherence", "k_used"), "n_articles")


def article_party_rollup(spark: SparkSession, root: str) -> DataFrame:
    return I.rollup(spark, root).select("article", "party", "year_month", *r10("weight", "q1_score", "q2_score", "q3_score", "q4_score"), "q1_n", "q2_n", "q3_n", "q4_n")


def party_normalize(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "manual_coding_full").select(M.normalize_party(F.col("party_mentioned")).alias("party"))
    return rows.groupBy("party").agg(F.count(F.lit(1)).alias("n_rows"))


def dedupe_keep_first(spark: SparkSession, root: str) -> DataFrame:
    docs = read_table(spark, root, "documents").withColumn("primary_body", F.substring("text", 1, 50))
    return M.keep_first(docs, ["title", "primary_body"], ["doc_id"]).select("doc_id", "title", "primary_body")


def calendar_gaps(spark: SparkSession, root: str) -> DataFrame:
    months = read_table(spark, root, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("year_month"))
    return C.calendar_gaps(months, "1994-07", "2001-03")


def complete_panels(spark: SparkSession, root: str) -> DataFrame:
    return C.complete_panels(I.stance(spark, root), "year_month", "raw_iqr", 8)


def fd_violations(spark: SparkSession, root: str) -> DataFrame:
    return C.fd_violations(read_table(spark, root, "orders"), "o_custkey", "o_orderstatus")


def duplicate_keys(spark: SparkSession, root: str) -> DataFrame:
    return C.duplicate_keys(read_table(spark, root, "monthly_stance"), "year_month", "party", "dimension", "replicate")


def na_rates(spark: SparkSession, root: str) -> DataFrame:
    return A.scale_usage(I.scored(spark, root), list(M.DIMENSIONS)).select("dimension", *r6("lowest", "highest", "mean", "sd", "na_rate"))


def bootstrap_given_counts(spark: SparkSession, root: str) -> DataFrame:
    return B.replicate_measures(I.written_long(spark, root), REPLICATES).select("replicate", "year_month", "party", "dimension", *r6("mean"), *r10("raw_iqr"), F.col("n_drawn").cast("bigint").alias("n_drawn"))


def mean_intervals(long: DataFrame) -> DataFrame:
    """Intervals of the means of each month, party and dimension."""
    made = B.replicate_measures(long, REPLICATES, spread=False)
    return M.percentile_interval(made, ["year_month", "party", "dimension"], "mean", REPLICATES).select("year_month", "party", "dimension", "n_valid", *r6("ci_lower", "ci_upper"))


def percentile_intervals(spark: SparkSession, root: str) -> DataFrame:
    return mean_intervals(I.long(spark, root))


def stance_with_intervals(spark: SparkSession, root: str) -> DataFrame:
    """Point estimates with the interval of their replicates beside them."""
    long = I.written_long(spark, root)
    return B.attach(M.monthly_stance(long), mean_intervals(long), ["year_month", "party", "dimension"]).select("year_month", "party", "dimension", *r6("mean"), "n_articles", "n_valid", "ci_lower", "ci_upper")


def index_intervals(spark: SparkSession, root: str) -> DataFrame:
    """Intervals of the index, recalibrated in each replicate."""
    made = B.replicate_measures(I.written_long(spark, root).where("dimension = 'q1'"), REPLICATES)
    return M.index_intervals(made, REPLICATES).select("year_month", "n_valid", *r6("ci_lower", "ci_upper"))


def stream_stability(spark: SparkSession, root: str) -> DataFrame:
    """Intervals of two independent halves of the replicates against each other."""
    keys = ["year_month", "party", "dimension"]
    made = cut(B.replicate_measures(I.long(spark, root), REPLICATES, spread=False).select("replicate", *keys, "mean"))
    half = REPLICATES // 2
    one, two = (M.percentile_interval(made.where(c), keys, "mean", half) for c in (F.col("replicate") <= half, F.col("replicate") > half))
    return B.stream_stability(one, two, keys).select(*keys, *r6("length_1", "length_2", "length_ratio"))


def replicates(spark: SparkSession, root: str) -> DataFrame:
    """The table of replicates with each key once."""
    rows = read_table(spark, root, "monthly_stance")
    return rows.groupBy("year_month", "party", "dimension", "replicate").agg(F.max("mean").alias("mean"), F.max("raw_iqr").alias("raw_iqr")).withColumns({c: F.nanvl(c, F.lit(None)) for c in ("mean", "raw_iqr")})


def prefix_stability(spark: SparkSession, root: str) -> DataFrame:
    keys = ["year_month", "party", "dimension"]
    made = M.prefix_stability(replicates(spark, root).where("replicate is not null"), keys, "replicate", "mean", PREFIXES)
    return made.select(*keys, F.col("prefix").cast("bigint").alias("prefix"), "is_full", "n_valid", *r6("ci_lower", "ci_upper", "length", "length_ratio", "endpoint_deviation"))


def panel_completeness(spark: SparkSession, root: str) -> DataFrame:
    """Replicates by how many of the months, parties and dimensions that there are they have; those with all can be used."""
    rows = replicates(spark, root)
    cells = rows.select("year_month", "party", "dimension").distinct().count()
    return C.panel_cells(rows, "replicate", "mean").groupBy("n_valid").agg(F.count(F.lit(1)).alias("n_replicates")).withColumn("complete", F.col("n_valid") == cells)


def aligned_scores(spark: SparkSession, root: str) -> DataFrame:
    """Every article and party of the roll-up with its q1 score, null where it has none."""
    r = cut(I.rollup(spark, root).select("article", "party", "q1_score"))
    return M.align(r, r.where("q1_score is not null"), ["article", "party"]).select("article", "party", *r10("q1_score"))


def ingest_row_numbers(spark: SparkSession, root: str) -> DataFrame:
    """Row numbers of a scan: that they are 0 to n - 1, each once."""
    rows = M.with_row_numbers(read_table(spark, root, "lineitem").select("l_orderkey"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("row_no").cast("bigint").alias("lowest"), F.max("row_no").cast("bigint").alias("highest"), F.countDistinct("row_no").alias("n_distinct"))


def ingested_scores(spark: SparkSession, root: str) -> DataFrame:
    """Successful scores by party and source, where the source falls back on another column and every party must have a name."""
    e = read_table(spark, root, "events").withColumn("llm_error_type", X.score_error(F.col("props"), ["k"]))
    rows = M.with_fallback(M.successful(e), "source", "event_type").withColumn("party", M.party_or_error(F.when(F.col("user_id") % 2 == 0, F.lit(" REP ")).otherwise(F.lit("Democratic"))))
    return rows.groupBy("party", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(X.score_of(F.col("props"), "k")).alias("total"))


def selected_cells(spark: SparkSession, root: str) -> DataFrame:
    """Orders of some priorities placed after a day, compared as text."""
    o = read_table(spark, root, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "5-LOW") & (F.date_format("o_orderdate", "yyyy-MM-dd") > "1996-01-01"))
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def contracted_stance(spark: SparkSession, root: str) -> DataFrame:
    """The stance after its contracts: columns, unique keys, rows for every month, party and dimension, and a share of valid cells."""
    s = C.assert_unique(C.assert_columns(cut(I.stance(spark, root)), "year_month", "party", "dimension", "mean", "raw_iqr"), "year_month", "party", "dimension")
    cells = s.select("year_month", "party").distinct().count() * len(M.DIMENSIONS)
    C.assert_rowcount(s, cells)
    C.require_share(s.where("mean is not null").count(), cells, 0.95)
    return s.groupBy("dimension").agg(F.count(F.lit(1)).alias("n_cells"), F.min("year_month").alias("first_month"), F.max("year_month").alias("last_month"))


def ratings_described(spark: SparkSession, root: str) -> DataFrame:
    """Scores by rater's seat: count, mean, deviation and quartiles."""
    long = _ratings(spark, root).unpivot(["sample_id"], ["coder1_q1", "coder2_q1", "llm_q1"], "rater", "v")
    return A.describe(long, "rater", "v").select("rater", "n", *r6("mean", "sd", "lowest", "q25", "median", "q75", "highest"))


def agreement_bootstrap(spark: SparkSession, root: str) -> DataFrame:
    """Intervals of bias and mean absolute difference of two raters, items drawn whole."""
    rows = _ratings(spark, root).where("coder1_q1 is not null and coder2_q1 is not null").select("sample_id", "coder1_q1", "coder2_q1")
    return A.agreement_bootstrap(rows, "sample_id", "coder1_q1", "coder2_q1", REPLICATES).select("statistic", "n_replicates", *r6("mean", "ci_lower", "ci_upper"))


def json_compliance(spark: SparkSession, root: str) -> DataFrame:
    """Responses by how they could be read, with their share."""
    e = read_table(spark, root, "events").select(X.score_error(F.col("props"), ["k"]).alias("error_type"))
    return A.shares(e, "error_type").select("error_type", "n", *r6("share"))


def party_balance(spark: SparkSession, root: str) -> DataFrame:
    """Sentences of each party, with their share."""
    rows = read_table(spark, root, "manual_coding_full").select(M.normalize_party(F.col("party_mentioned")).alias("party"))
    return A.shares(rows, "party").select("party", "n", *r6("share"))


def artifact_checks(spark: SparkSession, root: str) -> DataFrame:
    """Whether scores follow the masking of names or the length of a sentence."""
    rows = read_table(spark, root, "manual_coding_full").groupBy("sample_id", "cleaned_sentence").agg(F.max("llm_q1").alias("q1"))
    return A.artifact_checks(rows, "cleaned_sentence", "q1", X.TOKEN).select("n_masked", "n_unmasked", *r6("mean_masked", "mean_unmasked", "length_correlation"))


def correlation_tests(spark: SparkSession, root: str) -> DataFrame:
    """The pairwise correlations with their p-values."""
    rows = A.pairwise_correlations(I.scored(spark, root), list(M.DIMENSIONS)).collect()  # a row for each pair of four columns
    return spark.createDataFrame([(r["dimension_1"], r["dimension_2"], r["n"], r["pearson_r"], A.correlation_p(r["pearson_r"], r["n"])) for r in rows], "dimension_1 string, dimension_2 string, n bigint, pearson_r double, p_value double")


def group_ttests(spark: SparkSession, root: str) -> DataFrame:
    """Student's and Welch's tests with their p-values."""
    return A.with_p(A.ttest_moments(I.scored(spark, root), "party", "republican", "democrat", "q1"))


def replicate_summary(spark: SparkSession, root: str) -> DataFrame:
    rows = replicates(spark, root).where("mean is not null").withColumn("d", F.col("mean") - 50)
    return M.replicate_summary(rows, ["party", "dimension"], "d").select("party", "dimension", *r6("mean", "standard_error", "ci_lower", "ci_upper", "probability_negative", "probability_positive"))


def simultaneous_radius(spark: SparkSession, root: str) -> DataFrame:
    wide = I.gap(spark, root).where("rep_mean is not null and dem_mean is not null").select((F.col("rep_mean") - 25).alias("a"), (F.col("dem_mean") - 25).alias("b"))
    return M.simultaneous_radius(wide, "a", "b").select(*r6("radius"))


def config_frequency(spark: SparkSession, root: str) -> DataFrame:
    runs = read_table(spark, root, "orders").select(F.col("o_orderpriority").alias("cell"), F.col("o_orderstatus").alias("config"), F.col("o_totalprice").alias("objective"))
    return M.config_frequency(runs, "cell", "config", "objective").select("cell", "config", "run_frequency", *r6("run_proportion", "best_objective", "delta_from_best"), "is_winner")


def argmin_tiebreak(spark: SparkSession, root: str) -> DataFrame:
    runs = read_table(spark, root, "orders")
    return M.best_row(runs, ["o_custkey"], "o_totalprice", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", *r6("o_totalprice"))


def pivot_wide(spark: SparkSession, root: str) -> DataFrame:
    wide = I.gap(spark, root).groupBy("year_month").pivot("dimension", list(M.DIMENSIONS)).agg(F.first("polarization"))
    return wide.select("year_month", *[F.round(q, 6).alias(f"{q}_polarization") for q in M.DIMENSIONS])


def unpivot_long(spark: SparkSession, root: str) -> DataFrame:
    return I.long(spark, root).select("article", "party", "dimension", *r10("score"))


def stratified_sample(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "orders").withColumn("year_month", F.date_format("o_orderdate", "yyyy-MM"))
    return M.stratified_sample(rows, ["year_month", "o_orderstatus"], 3, F.md5(F.concat(F.lit("42:"), F.col("o_orderkey").cast("string")))).select("year_month", "o_orderstatus", "o_orderkey")


def _ratings(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "test6_manual_results").select("sample_id", "coding_round", "coder1_q1", "coder2_q1", "llm_q1").distinct()


def lins_ccc(spark: SparkSession, root: str) -> DataFrame:
    return A.inter_rater(_ratings(spark, root), "coder1_q1", "coder2_q1").select("n_pairs", *r6("na_agreement", "r", "mae", "rmse", "bias", "within", "ccc"))


def icc_agreement(spark: SparkSession, root: str) -> DataFrame:
    long = _ratings(spark, root).withColumn("item", F.concat_ws(":", "sample_id", "coding_round")).unpivot(["item"], ["coder1_q1", "coder2_q1", "llm_q1"], "rater", "v")
    return A.icc_single(long, "item", "rater", "v").select(F.col("n").cast("bigint").alias("n"), F.col("k").cast("bigint").alias("k"), *r6("icc"))


def within_item_sd(spark: SparkSession, root: str) -> DataFrame:
    long = _ratings(spark, root).unpivot(["sample_id"], ["coder1_q1", "coder2_q1", "llm_q1"], "rater", "v").where("v is not null")
    return A.within_item_sd(long, "sample_id", "v").select("n_items", *r6("within_item_sd"))


def pairwise_correlations(spark: SparkSession, root: str) -> DataFrame:
    return A.pairwise_correlations(I.scored(spark, root), list(M.DIMENSIONS)).select("dimension_1", "dimension_2", "n", *r6("pearson_r"))


def group_ttest_moments(spark: SparkSession, root: str) -> DataFrame:
    return A.ttest_moments(I.scored(spark, root), "party", "republican", "democrat", "q1").select("n1", "n2", *r6("m1", "m2", "t_student", "t_welch", "df_welch"))


def exact_agreement(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "test6_manual_results")
    key = F.concat_ws(":", "sample_id", "coding_round").alias("k")
    a, b = rows.select(key, F.col("coder1_q1").alias("q1"), F.col("coder1_q2").alias("q2")).distinct(), rows.select(key, F.col("coder2_q1").alias("q1"), F.col("coder2_q2").alias("q2")).distinct()
    return A.exact_agreement(a, b, "k", ["q1", "q2"]).select("n", "dimension", *r6("agreement"))


def publisher_having(spark: SparkSession, root: str) -> DataFrame:
    return A.spread_by_group(read_table(spark, root, "documents").withColumn("len", F.length("text")), "source", "len").select("source", "n_rows", *r6("mean", "sd"))


def formatted_ci_table(spark: SparkSession, root: str) -> DataFrame:
    s = I.stance(spark, root).where("raw_iqr is not null").withColumns({"lo": F.round(F.col("mean") - F.col("raw_iqr"), 3), "hi": F.round(F.col("mean") + F.col("raw_iqr"), 3), "mean": F.round("mean", 6)})
    return R.interval_table(s.withColumn("month", R.month_text("year_month")), ["month", "party", "dimension"], "mean", "lo", "hi")


def equal_runs(spark: SparkSession, root: str) -> DataFrame:
    sign = I.series(spark, root).select("t", F.signum("y").cast("int").alias("s"))
    return R.equal_runs(sign, "t", "s").select("run", "first", "last", "value", "length")


_W = "WITH" + I.SQL
_COUNT = " + ".join(f"CAST(u >= {p} AS BIGINT)" for p in B._POISSON)
_DRAWN = f"""{_W}, reps AS (SELECT unnest(range(1, {REPLICATES + 1})) AS replicate),
whole AS (SELECT article, year_month, party, dimension, score, floor(weight * 1048576) / 1048576 AS w, floor(weight * score * 1048576) / 1048576 AS ws FROM long WHERE score IS NOT NULL),
counts0 AS (SELECT article, replicate, CAST('0x' || substr(md5(article || ':' || replicate), 1, 8) AS BIGINT) % 10000 AS u FROM (SELECT DISTINCT article FROM whole), reps),
counts AS (SELECT article, replicate, {_COUNT} AS c FROM counts0),
drawn AS (SELECT * FROM whole JOIN counts USING (article) WHERE c > 0),
reprow AS (SELECT replicate, year_month, party, dimension, score, unnest(range(0, c)) AS k FROM drawn),
spread AS (SELECT replicate, year_month, party, dimension, CASE WHEN count(*) >= 4 THEN quantile_cont(score, 0.75) - quantile_cont(score, 0.25) END AS raw_iqr FROM reprow GROUP BY ALL),
means AS (SELECT replicate, year_month, party, dimension, sum(c * ws) / sum(c * w) AS mean, CAST(sum(c) AS BIGINT) AS n_drawn FROM drawn GROUP BY ALL),
measures AS (SELECT * FROM means JOIN spread USING (replicate, year_month, party, dimension))
"""
_CI = lambda x, n: f"CASE WHEN count({x}) >= {-(-n * 95 // 100)} THEN round(quantile_cont({x}, 0.025), 6) END AS ci_lower, CASE WHEN count({x}) >= {-(-n * 95 // 100)} THEN round(quantile_cont({x}, 0.975), 6) END AS ci_upper"
_RATED = "WITH ratings AS (SELECT DISTINCT sample_id, coding_round, coder1_q1, coder2_q1, llm_q1 FROM test6_manual_results)"
_REPS = "WITH reps AS (SELECT year_month, party, dimension, replicate, max(mean) AS m, max(raw_iqr) AS q FROM monthly_stance GROUP BY ALL), clean AS (SELECT *, CASE WHEN isnan(m) THEN NULL ELSE m END AS mean FROM reps)"
ORACLE = {
    "monthly_weighted_stance": f"{_W} SELECT year_month, party, dimension, round(mean, 6) AS mean, round(raw_iqr, 6) AS raw_iqr, n_articles FROM stance",
    "monthly_polarization": f"{_W} SELECT year_month, dimension, round(rep_mean, 6) AS rep_mean, round(dem_mean, 6) AS dem_mean, round(rep_mean - dem_mean, 6) AS polarization, rep_n, dem_n FROM gap",
    "party_index_timeseries": f"{_W} SELECT year_month, round(polarization, 6) AS polarization, round(P, 6) AS P, round(C_R, 6) AS C_R, round(C_D, 6) AS C_D, round(100 * cbrt(P * C_R * C_D), 6) AS index_value, round(k_used, 6) AS k_used, round(max_pol_used, 6) AS max_pol_used FROM idx",
    "message_coherence_long": f"{_W} SELECT year_month, 'republican' AS party, round(rep_raw_iqr, 6) AS raw_iqr, round(C_R, 6) AS message_coherence, round(k_used, 6) AS k_used, rep_n_articles AS n_articles FROM idx UNION ALL SELECT year_month, 'democrat', round(dem_raw_iqr, 6), round(C_D, 6), round(k_used, 6), dem_n_articles FROM idx",
    "article_party_rollup": f"{_W} SELECT article, party, year_month, round(weight, 10) AS weight, round(q1_score, 10) AS q1_score, round(q2_score, 10) AS q2_score, round(q3_score, 10) AS q3_score, round(q4_score, 10) AS q4_score, q1_n, q2_n, q3_n, q4_n FROM rollup",
    "party_normalize": "SELECT CASE WHEN contains(lower(trim(party_mentioned)), 'rep') THEN 'republican' WHEN contains(lower(trim(party_mentioned)), 'dem') THEN 'democrat' END AS party, count(*) AS n_rows FROM manual_coding_full GROUP BY 1",
    "dedupe_keep_first": "SELECT doc_id, title, primary_body FROM (SELECT doc_id, title, substr(text, 1, 50) AS primary_body, row_number() OVER (PARTITION BY title, substr(text, 1, 50) ORDER BY doc_id) AS n FROM documents) WHERE n = 1",
    "calendar_gaps": "WITH have AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS year_month FROM orders), want AS (SELECT strftime(m, '%Y-%m') AS year_month FROM (SELECT unnest(generate_series(DATE '1994-07-01', DATE '2001-03-01', INTERVAL 1 MONTH)) AS m)) SELECT year_month, 'missing' AS problem FROM want ANTI JOIN have USING (year_month) UNION ALL SELECT year_month, 'unexpected' FROM have ANTI JOIN want USING (year_month)",
    "complete_panels": f"{_W} SELECT year_month, count(*) AS n_cells, count(raw_iqr) AS n_valid FROM stance GROUP BY year_month HAVING count(*) = 8 AND count(raw_iqr) = 8",
    "fd_violations": "SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_values FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1",
    "duplicate_keys": "SELECT year_month, party, dimension, replicate, count(*) AS n_rows FROM monthly_stance GROUP BY ALL HAVING count(*) > 1",
    "na_rates": f"{_W}, l AS (SELECT 'q1' AS dimension, q1 AS x FROM scored UNION ALL SELECT 'q2', q2 FROM scored UNION ALL SELECT 'q3', q3 FROM scored UNION ALL SELECT 'q4', q4 FROM scored) SELECT dimension, round(min(x), 6) AS lowest, round(max(x), 6) AS highest, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(avg(CAST(x IS NULL AS INT)), 6) AS na_rate FROM l GROUP BY 1",
    "bootstrap_given_counts": f"{_DRAWN} SELECT CAST(replicate AS INTEGER) AS replicate, year_month, party, dimension, round(mean, 6) AS mean, round(raw_iqr, 10) AS raw_iqr, n_drawn FROM measures",
    "percentile_intervals": f"{_DRAWN} SELECT year_month, party, dimension, count(mean) AS n_valid, {_CI('mean', REPLICATES)} FROM means GROUP BY 1, 2, 3",
    "stance_with_intervals": f"{_DRAWN}, ci AS (SELECT year_month, party, dimension, count(mean) AS n_valid, {_CI('mean', REPLICATES)} FROM means GROUP BY 1, 2, 3) SELECT year_month, party, dimension, round(mean, 6) AS mean, n_articles, n_valid, ci_lower, ci_upper FROM stance LEFT JOIN ci USING (year_month, party, dimension)",
    "index_intervals": f"{_DRAWN}, rw AS (SELECT replicate, year_month, max(mean) FILTER (party = 'republican') AS a, max(mean) FILTER (party = 'democrat') AS b, max(raw_iqr) FILTER (party = 'republican') AS ra, max(raw_iqr) FILTER (party = 'democrat') AS rb FROM measures WHERE dimension = 'q1' GROUP BY 1, 2), rs AS (SELECT r.replicate, max(abs(a - b)) AS mx, median(i) AS k FROM rw r, LATERAL (SELECT unnest([r.ra, r.rb]) AS i) GROUP BY 1), ri AS (SELECT year_month, 100 * cbrt(abs(a - b) / mx * (k / (k + ra)) * (k / (k + rb))) AS v FROM rw JOIN rs USING (replicate) WHERE k > 0 AND mx > 0) SELECT year_month, count(v) AS n_valid, {_CI('v', REPLICATES)} FROM ri GROUP BY 1",
    "stream_stability": f"{_DRAWN}, h AS (SELECT year_month, party, dimension, replicate > {REPLICATES // 2} AS two, CASE WHEN count(mean) >= {-(-(REPLICATES // 2) * 95 // 100)} THEN quantile_cont(mean, 0.975) - quantile_cont(mean, 0.025) END AS len FROM means GROUP BY ALL), j AS (SELECT year_month, party, dimension, max(len) FILTER (NOT two) AS l1, max(len) FILTER (two) AS l2 FROM h GROUP BY ALL HAVING count(*) = 2) SELECT year_month, party, dimension, round(l1, 6) AS length_1, round(l2, 6) AS length_2, CASE WHEN l1 <> 0 THEN round(l2 / l1, 6) END AS length_ratio FROM j",
    "prefix_stability": f"{_REPS}, c AS (SELECT * FROM clean WHERE replicate IS NOT NULL), g AS (SELECT year_month, party, dimension, max(replicate) AS last FROM c GROUP BY ALL), k AS (SELECT *, unnest(list_append(list_filter({list(PREFIXES)}::BIGINT[], lambda p: p < last), last)) AS prefix FROM g), e AS (SELECT k.year_month, k.party, k.dimension, prefix, prefix = last AS is_full, count(mean) AS n_valid, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM k JOIN c ON c.year_month IS NOT DISTINCT FROM k.year_month AND c.party IS NOT DISTINCT FROM k.party AND c.dimension IS NOT DISTINCT FROM k.dimension AND replicate <= prefix GROUP BY ALL), f AS (SELECT *, max(lo) FILTER (is_full) OVER w AS flo, max(hi) FILTER (is_full) OVER w AS fhi FROM e WINDOW w AS (PARTITION BY year_month, party, dimension)) SELECT year_month, party, dimension, prefix, is_full, n_valid, round(lo, 6) AS ci_lower, round(hi, 6) AS ci_upper, round(hi - lo, 6) AS length, CASE WHEN fhi <> flo THEN round((hi - lo) / (fhi - flo), 6) END AS length_ratio, CASE WHEN fhi <> flo THEN round(greatest(abs(lo - flo), abs(hi - fhi)) / (fhi - flo), 6) END AS endpoint_deviation FROM f",
    "panel_completeness": f"{_REPS}, p AS (SELECT replicate, count(mean) AS n_valid FROM clean GROUP BY 1) SELECT n_valid, count(*) AS n_replicates, n_valid = (SELECT count(*) FROM (SELECT DISTINCT year_month, party, dimension FROM monthly_stance)) AS complete FROM p GROUP BY 1",
    "aligned_scores": f"{_W} SELECT article, party, round(q1_score, 10) AS q1_score FROM rollup",
    "ingest_row_numbers": "SELECT count(*) AS n, CAST(0 AS BIGINT) AS lowest, count(*) - 1 AS highest, count(*) AS n_distinct FROM lineitem",
    "ingested_scores": "WITH e AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'republican' ELSE 'democrat' END AS party, event_type AS source, props, json_extract_string(props, '$.k') AS raw FROM events) SELECT party, source, count(*) AS n, sum(TRY_CAST(raw AS DOUBLE)) AS total FROM e WHERE props IS NOT NULL AND json_valid(props) AND (raw IS NULL OR raw IN ('NA', 'na') OR TRY_CAST(raw AS DOUBLE) BETWEEN 0 AND 100) GROUP BY 1, 2",
    "selected_cells": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AND strftime(o_orderdate, '%Y-%m-%d') > '1996-01-01' GROUP BY 1",
    "contracted_stance": f"{_W} SELECT dimension, count(*) AS n_cells, min(year_month) AS first_month, max(year_month) AS last_month FROM stance GROUP BY 1",
    "ratings_described": f"{_RATED}, l AS (SELECT 'coder1_q1' AS rater, coder1_q1 AS v FROM ratings UNION ALL SELECT 'coder2_q1', coder2_q1 FROM ratings UNION ALL SELECT 'llm_q1', llm_q1 FROM ratings) SELECT rater, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS lowest, round(quantile_cont(v, 0.25), 6) AS q25, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS highest FROM l GROUP BY 1",
    "agreement_bootstrap": f"{_RATED}, b AS (SELECT sample_id, coder1_q1 - coder2_q1 AS d FROM ratings WHERE coder1_q1 IS NOT NULL AND coder2_q1 IS NOT NULL), u AS (SELECT sample_id, replicate, CAST('0x' || substr(md5(sample_id || ':' || replicate), 1, 8) AS BIGINT) % 10000 AS u FROM (SELECT DISTINCT sample_id FROM b), (SELECT unnest(range(1, {REPLICATES + 1})) AS replicate)), c AS (SELECT sample_id, replicate, {_COUNT} AS c FROM u), r AS (SELECT replicate, sum(c * d) / sum(c) AS bias, sum(c * abs(d)) / sum(c) AS mae FROM b JOIN c USING (sample_id) WHERE c > 0 GROUP BY 1), l AS (SELECT 'bias' AS statistic, bias AS x FROM r UNION ALL SELECT 'mae', mae FROM r) SELECT statistic, count(x) AS n_replicates, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.025), 6) AS ci_lower, round(quantile_cont(x, 0.975), 6) AS ci_upper FROM l GROUP BY 1",
    "json_compliance": "WITH e AS (SELECT CASE WHEN props IS NULL OR NOT json_valid(props) THEN 'json_error' WHEN json_extract_string(props, '$.k') IS NOT NULL AND json_extract_string(props, '$.k') NOT IN ('NA', 'na') AND coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) NOT BETWEEN 0 AND 100, true) THEN 'range_error' ELSE 'success' END AS error_type FROM events) SELECT error_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM e GROUP BY 1",
    "party_balance": "WITH p AS (SELECT CASE WHEN contains(lower(trim(party_mentioned)), 'rep') THEN 'republican' WHEN contains(lower(trim(party_mentioned)), 'dem') THEN 'democrat' END AS party FROM manual_coding_full) SELECT party, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM p GROUP BY 1",
    "artifact_checks": "WITH r AS (SELECT sample_id, cleaned_sentence AS s, max(llm_q1) AS q FROM manual_coding_full GROUP BY 1, 2) SELECT count(q) FILTER (contains(s, '[ENTITY]')) AS n_masked, count(q) FILTER (NOT contains(s, '[ENTITY]')) AS n_unmasked, round(avg(q) FILTER (contains(s, '[ENTITY]')), 6) AS mean_masked, round(avg(q) FILTER (NOT contains(s, '[ENTITY]')), 6) AS mean_unmasked, round(corr(q, length(s)), 6) AS length_correlation FROM r",
    "replicate_summary": f"{_REPS}, d AS (SELECT party, dimension, mean - 50 AS d FROM clean WHERE mean IS NOT NULL) SELECT party, dimension, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS standard_error, round(quantile_cont(d, 0.025), 6) AS ci_lower, round(quantile_cont(d, 0.975), 6) AS ci_upper, round(avg(CAST(d < 0 AS INT)), 6) AS probability_negative, round(avg(CAST(d > 0 AS INT)), 6) AS probability_positive FROM d GROUP BY 1, 2",
    "simultaneous_radius": f"{_W} SELECT round(quantile_cont(greatest(abs(rep_mean - 25), abs(dem_mean - 25)), 0.95), 6) AS radius FROM gap WHERE rep_mean IS NOT NULL AND dem_mean IS NOT NULL",
    "config_frequency": "WITH e AS (SELECT o_orderpriority AS cell, o_orderstatus AS config, count(*) AS run_frequency, min(o_totalprice) AS best FROM orders GROUP BY 1, 2) SELECT cell, config, run_frequency, round(run_frequency / sum(run_frequency) OVER (PARTITION BY cell), 6) AS run_proportion, round(best, 6) AS best_objective, round(best - min(best) OVER (PARTITION BY cell), 6) AS delta_from_best, best = min(best) OVER (PARTITION BY cell) AS is_winner FROM e",
    "argmin_tiebreak": "WITH b AS (SELECT *, min(o_totalprice) OVER (PARTITION BY o_custkey) AS low FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM b WHERE o_totalprice <= low + 1e-5) SELECT o_custkey, o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM r WHERE n = 1",
    "pivot_wide": f"{_W} SELECT year_month, " + ", ".join(f"round(max(rep_mean - dem_mean) FILTER (dimension = '{q}'), 6) AS {q}_polarization" for q in M.DIMENSIONS) + " FROM gap GROUP BY 1",
    "unpivot_long": f"{_W} SELECT article, party, dimension, round(score, 10) AS score FROM long",
    "stratified_sample": "SELECT year_month, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY year_month, o_orderstatus ORDER BY md5('42:' || o_orderkey)) AS n FROM (SELECT *, strftime(o_orderdate, '%Y-%m') AS year_month FROM orders)) WHERE n <= 3",
    "lins_ccc": f"{_RATED}, b AS (SELECT coder1_q1 AS x, coder2_q1 AS y FROM ratings WHERE coder1_q1 IS NOT NULL AND coder2_q1 IS NOT NULL) SELECT count(*) AS n_pairs, (SELECT round(avg(CAST((coder1_q1 IS NULL) = (coder2_q1 IS NULL) AS INT)), 6) FROM ratings) AS na_agreement, round(corr(x, y), 6) AS r, round(avg(abs(x - y)), 6) AS mae, round(sqrt(avg((x - y) * (x - y))), 6) AS rmse, round(avg(x - y), 6) AS bias, round(avg(CAST(abs(x - y) <= 15 AS INT)), 6) AS \"within\", round(2 * covar_pop(x, y) / (var_pop(x) + var_pop(y) + pow(avg(x) - avg(y), 2)), 6) AS ccc FROM b",
    "icc_agreement": f"{_RATED}, f AS (SELECT coder1_q1 AS a, coder2_q1 AS b, llm_q1 AS c FROM ratings WHERE coder1_q1 IS NOT NULL AND coder2_q1 IS NOT NULL AND llm_q1 IS NOT NULL), m AS (SELECT count(*) AS n, avg((a + b + c) / 3) AS g, sum(a * a + b * b + c * c) AS ss, var_pop((a + b + c) / 3) AS vi, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM f), v AS (SELECT *, ((ma - g) ** 2 + (mb - g) ** 2 + (mc - g) ** 2) / 3 AS vr FROM m), s AS (SELECT n, n * 3 * vi / (n - 1) AS msr, n * 3 * vr / 2 AS msc, (ss - n * 3 * g * g - n * 3 * vi - n * 3 * vr) / ((n - 1) * 2) AS mse FROM v) SELECT n, CAST(3 AS BIGINT) AS k, round((msr - mse) / (msr + 2 * mse + 3 * (msc - mse) / n), 6) AS icc FROM s",
    "within_item_sd": f"{_RATED}, l AS (SELECT sample_id, coder1_q1 AS v FROM ratings UNION ALL SELECT sample_id, coder2_q1 FROM ratings UNION ALL SELECT sample_id, llm_q1 FROM ratings), s AS (SELECT sample_id, stddev_pop(v) AS sd FROM l WHERE v IS NOT NULL GROUP BY 1) SELECT count(*) AS n_items, round(avg(sd), 6) AS within_item_sd FROM s",
    "pairwise_correlations": f"{_W} " + " UNION ALL ".join(f"SELECT '{a}' AS dimension_1, '{b}' AS dimension_2, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, round(corr({a}, {b}), 6) AS pearson_r FROM scored" for i, a in enumerate(M.DIMENSIONS) for b in M.DIMENSIONS[i + 1 :]),
    "group_ttest_moments": f"{_W}, m AS (SELECT count(q1) FILTER (party = 'republican') AS n1, count(q1) FILTER (party = 'democrat') AS n2, avg(q1) FILTER (party = 'republican') AS m1, avg(q1) FILTER (party = 'democrat') AS m2, var_samp(q1) FILTER (party = 'republican') AS v1, var_samp(q1) FILTER (party = 'democrat') AS v2 FROM scored) SELECT n1, n2, round(m1, 6) AS m1, round(m2, 6) AS m2, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) AS t_student, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t_welch, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 6) AS df_welch FROM m",
    "exact_agreement": "WITH k AS (SELECT DISTINCT sample_id, coding_round, coder1_q1 AS a1, coder1_q2 AS a2 FROM test6_manual_results), l AS (SELECT DISTINCT sample_id, coding_round, coder2_q1 AS b1, coder2_q2 AS b2 FROM test6_manual_results), j AS (SELECT * FROM k JOIN l USING (sample_id, coding_round)) SELECT count(*) AS n, 'q1' AS dimension, round(avg(CAST(a1 IS NOT DISTINCT FROM b1 AS INT)), 6) AS agreement FROM j UNION ALL SELECT count(*), 'q2', round(avg(CAST(a2 IS NOT DISTINCT FROM b2 AS INT)), 6) FROM j",
    "publisher_having": "SELECT source, count(*) AS n_rows, round(avg(length(text)), 6) AS mean, round(stddev_samp(length(text)), 6) AS sd FROM documents GROUP BY 1 HAVING count(*) >= 5",
    "formatted_ci_table": f"{_W} SELECT strftime(CAST(year_month || '-01' AS DATE), '%b %Y') AS month, party, dimension, printf('%.6f', round(mean, 6)) AS estimate_text, '[' || printf('%.3f', round(mean - raw_iqr, 3)) || ', ' || printf('%.3f', round(mean + raw_iqr, 3)) || ']' AS ci_text FROM stance WHERE raw_iqr IS NOT NULL",
    "equal_runs": f"{_W}, s AS (SELECT t, CAST(sign(y) AS INT) AS s FROM series), c AS (SELECT *, CASE WHEN s = lag(s) OVER (ORDER BY t) THEN 0 ELSE 1 END AS c FROM s), r AS (SELECT *, sum(c) OVER (ORDER BY t) AS run FROM c) SELECT CAST(run AS BIGINT) AS run, min(t) AS \"first\", max(t) AS \"last\", min(s) AS value, count(*) AS length FROM r GROUP BY run",
}
ROWS_ONLY = ("correlation_tests", "group_ttests")
QUERIES = {name: globals()[name] for name in (*ORACLE, *ROWS_ONLY)}
