"""Queries of the text functions, JSON parsing, joins of results and the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.functions import text as X
from loomstat.operators import measure as M
from loomstat.sources import files as S
from loomstat.session import read_table

# Parameters of the queries: term lists.
TOPIC = ["Ukraine", "Kyiv", "Ukrainian", "Ucrania"]
SIDE_A = ["committee", "chair", "majority", "budget"]
SIDE_B = ["senator", "minority", "veteran", "auditor"]
ABBREVIATED = ["Sen", "Rep", "Gov", "Dr", "Gen", "Amb"]
FULL = ["Senator", "Governor", "Chair"]
LABELS = ["Republican", "Democrat", "GOP"]
PROTECTED = ["committee", "office", "minister"]


def _sentences(spark: SparkSession, root: str) -> DataFrame:
    docs = read_table(spark, root, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


def sentence_split_counts(spark: SparkSession, root: str) -> DataFrame:
    docs = read_table(spark, root, "documents").where("text is not null")
    return docs.select("doc_id", F.size(X.sentences(F.col("text"))).alias("n_sentences"))


def topic_exclusive_attribution(spark: SparkSession, root: str) -> DataFrame:
    rows = _sentences(spark, root).where(X.mentions(F.col("sentence"), TOPIC))
    return rows.select("doc_id", "pos", X.exclusive_party(F.col("sentence"), SIDE_A, SIDE_B).alias("party")).where("party is not null")


def weight_transforms(spark: SparkSession, root: str) -> DataFrame:
    rows = _sentences(spark, root).groupBy("doc_id").agg(F.count_if(X.mentions(F.col("sentence"), TOPIC)).alias("k"), F.count(F.lit(1)).alias("n"))
    return rows.select("doc_id", "k", "n", *[F.round(X.weight(F.col("k"), F.col("n"), how), 6).alias(how) for how in ("linear", "sqrt", "log", "log_volume")])


def mask_terms(spark: SparkSession, root: str) -> DataFrame:
    docs = read_table(spark, root, "documents").where("text is not null")
    masked = docs.select("doc_id", X.mask(F.col("text"), TOPIC + SIDE_A).alias("masked"))
    return masked.select("doc_id", X.token_count(F.col("masked")).cast("bigint").alias("n_tokens"), F.md5("masked").alias("masked_md5"))


def remove_titles(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "manual_coding_full").select("sample_id", X.remove_titles(X.strip_possessive(F.col("cleaned_sentence")), ABBREVIATED, FULL).alias("cleaned")).distinct()
    return rows.where(F.length("cleaned") > 10)


def party_sentences(spark: SparkSession, root: str) -> DataFrame:
    """Each side's sentences masked by its own terms, original and masked text exploded together."""
    docs = read_table(spark, root, "documents").where("text is not null").select("doc_id", X.sentences(F.col("text")).alias("s"))

    def side(name: str, own: list[str], other: list[str]) -> DataFrame:
        own_ = docs.select("doc_id", X.party_pieces(F.col("s"), TOPIC, own, other).alias("o"))
        both = own_.select("doc_id", X.parallel(F.col("o"), F.transform("o", lambda x: X.mask(x, own))).alias("p"))
        return both.select("doc_id", F.lit(name).alias("party"), F.posexplode("p").alias("pos", "p")).select("doc_id", "party", "pos", F.md5("p.original").alias("original_md5"), F.md5("p.cleaned").alias("cleaned_md5"))

    return side("a", SIDE_A, SIDE_B).unionByName(side("b", SIDE_B, SIDE_A))


def _cleaned(spark: SparkSession, root: str, masking: bool) -> DataFrame:
    rows = read_table(spark, root, "manual_coding_full").groupBy("sample_id", "cleaned_sentence", "party_mentioned", "date").agg(F.count(F.lit(1)).alias("n"))
    made = rows.withColumn("cleaned", X.clean(F.col("cleaned_sentence"), TOPIC + SIDE_A + SIDE_B, ABBREVIATED, FULL, LABELS, PROTECTED, masking)).where(F.length("cleaned") > 10)
    kept = M.keep_first(made, ["cleaned", "party_mentioned", "date"], ["sample_id", "cleaned_sentence"])
    return kept.select("sample_id", "cleaned", X.token_count(F.col("cleaned")).cast("bigint").alias("n_tokens"))


def clean_masking(spark: SparkSession, root: str) -> DataFrame:
    """Names masked, titles and labels removed, short and repeated sentences dropped."""
    return _cleaned(spark, root, True)


def clean_removal(spark: SparkSession, root: str) -> DataFrame:
    """The same with names removed."""
    return _cleaned(spark, root, False)


def salience_filter(spark: SparkSession, root: str) -> DataFrame:
    """Documents whose share of sentences on the topic reaches a fiftieth for either side."""
    is_of = lambda own, other: F.count_if(X.mentions(F.col("sentence"), TOPIC) & X.mentions(F.col("sentence"), own) & ~X.mentions(F.col("sentence"), other))
    rows = _sentences(spark, root).groupBy("doc_id").agg(is_of(SIDE_A, SIDE_B).alias("a"), is_of(SIDE_B, SIDE_A).alias("b"), F.count(F.lit(1)).alias("n"))
    kept = rows.withColumns({"salience_a": X.salience(F.col("a"), F.col("n")), "salience_b": X.salience(F.col("b"), F.col("n"))}).where(X.salient(0.02, F.col("salience_a"), F.col("salience_b")))
    return kept.select("doc_id", F.round("salience_a", 6).alias("salience_a"), F.round("salience_b", 6).alias("salience_b"))


def result_lines(spark: SparkSession, root: str) -> DataFrame:
    """Requests answered in the form of a batch's result lines, some without an id, parsed back."""
    e = read_table(spark, root, "events")
    body = F.struct(F.array(F.struct(F.struct(F.col("props").alias("content")).alias("message"))).alias("choices"))
    id_ = F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("sentence_"), F.col("event_id").cast("string"))).otherwise(F.lit("other"))
    lines = e.select(F.to_json(F.struct(id_.alias("custom_id"), F.struct(body.alias("body")).alias("response"))).alias("line"))
    return lines.select(X.result_index(F.col("line")).alias("row_index"), X.score_of(X.result_content(F.col("line")), "k").alias("k")).groupBy("row_index").agg(F.count(F.lit(1)).alias("n_lines"), F.count("k").alias("n_scored"), F.max("k").alias("highest"))


def pipe_lists(spark: SparkSession, root: str) -> DataFrame:
    """A day's event types as a list with bars, its length when read back, and its first 20 characters."""
    days = read_table(spark, root, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    return days.select("day", X.pipe_list(F.col("types")).alias("types")).select("day", "types", F.size(X.from_pipe_list(F.col("types"))).alias("n_types"), X.truncated(F.col("types"), 20).alias("short"))


def clean_export(spark: SparkSession, root: str) -> DataFrame:
    """Articles in the form of a raw export, with bodies in parts, words and days as text, cleaned; the first of equal articles stays."""
    a = read_table(spark, root, "articles").where("body is not null and title is not null").dropDuplicates(["article_no"])
    raw = a.select(F.col("article_no").alias("Nr"), F.col("title").alias("Titel"), F.concat(F.col("word_count").cast("string"), F.lit(" words")).alias("Woerter"), F.date_format("date", "yyyy/MM/dd").alias("Datum"), F.substring("body", 1, 100).alias("body_1"), F.lit(None).cast("string").alias("body_2"), F.nullif(F.substring("body", 101, 100), F.lit("")).alias("body_3"))
    named = S.translate(raw, {"Nr": "row_index", "Titel": "title", "Woerter": "word_count", "Datum": "date", "body_1": "body_1", "body_2": "body_2", "body_3": "body_3"})
    return S.clean_articles(named).select("row_index", "word_count", F.date_format("date", "yyyy-MM-dd").alias("day"), F.md5("body").alias("body_md5"))


def original_sentences(spark: SparkSession, root: str) -> DataFrame:
    """Each document with the first sentence of the last document of its title."""
    docs = read_table(spark, root, "documents").select("doc_id", "title", X.sentences(F.col("text")).alias("s"))
    found = M.lookup_last(docs.select("doc_id", "title"), docs.select("title", "doc_id", F.struct(F.get("s", F.lit(0)).alias("first")).alias("v")), "title", "doc_id", "v", "v")
    return found.select("doc_id", F.md5("v.first").alias("first_md5"))


def stable_article_id(spark: SparkSession, root: str) -> DataFrame:
    docs = read_table(spark, root, "documents")
    return docs.select("doc_id", X.stable_id("art_v1_", title=F.col("title"), source=F.col("source")).alias("stable_id"))


def json_score_parse(spark: SparkSession, root: str) -> DataFrame:
    e = read_table(spark, root, "events")
    return e.select("event_id", X.score_of(F.col("props"), "k").alias("k"), X.score_error(F.col("props"), ["k"]).alias("error_type"))


def result_left_join(spark: SparkSession, root: str) -> DataFrame:
    """Results of events joined to users' requests; a user's last event is the result that counts."""
    requests = read_table(spark, root, "customer").select(F.col("c_custkey").alias("custom_id"))
    e = read_table(spark, root, "events")
    responses = e.select(F.col("user_id").alias("custom_id"), F.col("event_id").alias("line_no"), X.score_of(F.col("props"), "k").alias("k"), F.lit("success").alias("llm_error_type"))
    return S.annotate_from_files(requests, responses).select("custom_id", "k", "llm_error_type")


def request_lines(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "manual_coding_full").where("cleaned_sentence is not null").select("sample_id", "cleaned_sentence").distinct()
    lines = rows.select("sample_id", X.request_line(F.col("sample_id"), "Score: ", F.col("cleaned_sentence")).alias("line"))
    return lines.select("sample_id", F.get_json_object("line", "$.custom_id").alias("custom_id"), F.get_json_object("line", "$.body.messages[0].content").alias("content"))


def cost_estimate(spark: SparkSession, root: str) -> DataFrame:
    n = read_table(spark, root, "manual_coding_full").agg(F.countDistinct("sample_id").alias("n"))
    return n.select("n", F.round(X.cost(F.col("n"), 0.15, 0.6), 6).alias("cost"))


def name_variants(spark: SparkSession, root: str) -> DataFrame:
    parts = F.split("p_name", " ")
    p = read_table(spark, root, "part").select("p_partkey", parts[0].alias("a"), F.get(parts, F.lit(1)).alias("b"), F.element_at(parts, -1).alias("c"), F.nullif("p_brand", F.lit("Brand#11")).alias("d"))
    return p.select("p_partkey", F.explode(X.name_variants(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).alias("variant"))


def daily_weighted_events(spark: SparkSession, root: str) -> DataFrame:
    """The batch form of the stream's windows: sums of the same weights by day and type."""
    w = (F.col("user_id") % 5 + 1).cast("double")
    e = read_table(spark, root, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.sum(w * F.col("value")).alias("wx"), F.sum(F.when(F.col("value").isNotNull(), w)).alias("w"), F.count("value").alias("n_events"))
    return e.select("day", "event_type", F.round(F.expr("wx / w"), 6).alias("weighted_mean"), "n_events")


_ALT = lambda terms: "(?i)\\b(" + "|".join(sorted(terms, key=lambda t: (-len(t), t))) + ")\\b"
#: The same with word bounds that know letters outside ASCII.
_WORDS = lambda terms: "(?i)(?:^|[^\\pL\\pN_])(?:" + "|".join(sorted(terms, key=lambda t: (-len(t), t))) + ")(?:$|[^\\pL\\pN_])"
_SENT = "WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[\\s\\pZ\\x0b\\x{85}]+|[\\s\\pZ\\x0b\\x{85}]+$', '', 'g')), lambda x: x <> '') AS a FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(a) AS sentence, generate_subscripts(a, 1) - 1 AS pos FROM s)"
_TITLE = "(?i)\\b(?:" + "|".join(sorted(ABBREVIATED, key=lambda t: (-len(t), t))) + ")\\.(\\s|$)"


def _clean_sql(masking: bool) -> str:
    known, short = _ALT(TOPIC + SIDE_A + SIDE_B), "|".join(sorted(ABBREVIATED, key=lambda t: (-len(t), t)))
    full = "|".join(sorted(FULL, key=lambda t: (-len(t), t)))
    name = f"(?i)\\b((?:{short})\\.|(?:{full}))\\s+([a-z]{{2,}}(?:[\\s-][a-z]{{2,}})?)"
    bare = "regexp_replace(p, '\\x01[^\\x02]*\\x02', '[ENTITY]', 'g')" if masking else f"regexp_replace(p, '(?i)\\b(?:(?:{short})\\.|(?:{full})) \\x01[^\\x02]*\\x02', '', 'g')"
    return f"""WITH r AS (SELECT DISTINCT sample_id, cleaned_sentence, party_mentioned, date FROM manual_coding_full),
k AS (SELECT *, regexp_replace(regexp_replace(cleaned_sentence, '{known}', '{'[ENTITY]' if masking else ''}', 'g'), '{name}', '\\1 ' || chr(1) || '\\2' || chr(2), 'g') AS m FROM r),
p AS (SELECT *, regexp_replace(m, '(?i)\\x01([^\\x02]*(?:{'|'.join(sorted(PROTECTED, key=lambda t: (-len(t), t)))})[^\\x02]*)\\x02', '\\1', 'g') AS p FROM k),
b AS (SELECT *, regexp_replace(regexp_replace({bare}, '{_TITLE}', '\\1', 'g'), '{_ALT(FULL + LABELS)}', '', 'g') AS b FROM p),
o AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '(?:\\[ENTITY\\]\\s*)+', '[ENTITY] ', 'g'), '[`'']s\\b', '', 'g'), '\\s+', ' ', 'g'), ' ([.,;:!?])', '\\1', 'g') AS o FROM b),
c AS (SELECT *, trim(regexp_replace(o, '^\\s*[.,;:]\\s*', '')) AS cleaned FROM o),
n AS (SELECT *, row_number() OVER (PARTITION BY cleaned, party_mentioned, date ORDER BY sample_id, cleaned_sentence NULLS FIRST) AS n FROM c WHERE length(cleaned) > 10)
SELECT sample_id, cleaned, CAST((length(cleaned) - length(replace(cleaned, '[ENTITY]', ''))) // 8 AS BIGINT) AS n_tokens FROM n WHERE n = 1"""


ORACLE = {
    "sentence_split_counts": f"{_SENT} SELECT doc_id, CAST(len(a) AS INTEGER) AS n_sentences FROM s",
    "topic_exclusive_attribution": f"{_SENT}, m AS (SELECT doc_id, pos, regexp_matches(sentence, '{_WORDS(SIDE_A)}') AS a, regexp_matches(sentence, '{_WORDS(SIDE_B)}') AS b FROM e WHERE regexp_matches(sentence, '{_WORDS(TOPIC)}')) SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN a THEN 'a' ELSE 'b' END AS party FROM m WHERE a <> b",
    "weight_transforms": f"{_SENT}, k AS (SELECT doc_id, count(*) FILTER (regexp_matches(sentence, '{_WORDS(TOPIC)}')) AS k, count(*) AS n FROM e GROUP BY 1) SELECT doc_id, k, n, round(k / n, 6) AS linear, round(sqrt(k / n), 6) AS sqrt, round(ln(1 + k) / ln(1 + n), 6) AS log, round(ln(1 + k), 6) AS log_volume FROM k",
    "mask_terms": f"WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{_ALT(TOPIC + SIDE_A)}', '[ENTITY]', 'g'), '\\[ENTITY\\](?:\\s+\\[ENTITY\\])+', '[ENTITY]', 'g') AS masked FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST((length(masked) - length(replace(masked, '[ENTITY]', ''))) // 8 AS BIGINT) AS n_tokens, md5(masked) AS masked_md5 FROM m",
    "remove_titles": f"WITH c AS (SELECT DISTINCT sample_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(cleaned_sentence, '[`'']s\\b', '', 'g'), '{_TITLE}', '\\1', 'g'), '{_ALT(FULL)}', '', 'g'), '\\s+', ' ', 'g'), ' ([.,;:!?])', '\\1', 'g'), '^[\\s.,;:!?]+', '')) AS cleaned FROM manual_coding_full) SELECT sample_id, cleaned FROM c WHERE length(cleaned) > 10",
    "party_sentences": f"{_SENT}, m AS (SELECT doc_id, pos, sentence, regexp_matches(sentence, '{_WORDS(SIDE_A)}') AS a, regexp_matches(sentence, '{_WORDS(SIDE_B)}') AS b FROM e WHERE regexp_matches(sentence, '{_WORDS(TOPIC)}')), q AS (SELECT doc_id, pos, sentence, CASE WHEN a THEN 'a' ELSE 'b' END AS party, CASE WHEN a THEN regexp_replace(sentence, '{_ALT(SIDE_A)}', '[ENTITY]', 'g') ELSE regexp_replace(sentence, '{_ALT(SIDE_B)}', '[ENTITY]', 'g') END AS c FROM m WHERE a <> b) SELECT doc_id, party, CAST(row_number() OVER (PARTITION BY doc_id, party ORDER BY pos) - 1 AS INTEGER) AS pos, md5(sentence) AS original_md5, md5(regexp_replace(c, '\\[ENTITY\\](?:\\s+\\[ENTITY\\])+', '[ENTITY]', 'g')) AS cleaned_md5 FROM q",
    "clean_masking": _clean_sql(True),
    "clean_removal": _clean_sql(False),
    "salience_filter": f"{_SENT}, k AS (SELECT doc_id, count(*) FILTER (t AND a AND NOT b) AS a, count(*) FILTER (t AND b AND NOT a) AS b, count(*) AS n FROM (SELECT doc_id, regexp_matches(sentence, '{_WORDS(TOPIC)}') AS t, regexp_matches(sentence, '{_WORDS(SIDE_A)}') AS a, regexp_matches(sentence, '{_WORDS(SIDE_B)}') AS b FROM e) GROUP BY 1) SELECT doc_id, round(a / n, 6) AS salience_a, round(b / n, 6) AS salience_b FROM k WHERE greatest(a, b) / n >= 0.02",
    "result_lines": "WITH e AS (SELECT CASE WHEN event_id % 7 <> 0 THEN event_id ELSE -1 END AS row_index, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM events) SELECT row_index, count(*) AS n_lines, count(*) FILTER (v BETWEEN 0 AND 100) AS n_scored, max(v) FILTER (v BETWEEN 0 AND 100) AS highest FROM e GROUP BY 1",
    "pipe_lists": "WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS types, count(DISTINCT event_type) AS n FROM events GROUP BY 1) SELECT day, types, CAST(n AS INTEGER) AS n_types, left(types, 20) AS short FROM d",
    "clean_export": "WITH a AS (SELECT article_no, any_value(title) AS title, any_value(word_count) AS w, any_value(date) AS d, any_value(body) AS body FROM articles WHERE body IS NOT NULL AND title IS NOT NULL GROUP BY 1), r AS (SELECT *, concat_ws(' ', substr(body, 1, 100), nullif(substr(body, 101, 100), '')) AS b FROM a) SELECT article_no AS row_index, w AS word_count, strftime(d, '%Y-%m-%d') AS day, md5(b) AS body_md5 FROM r QUALIFY row_number() OVER (PARTITION BY title, substr(b, 1, 50) ORDER BY article_no) = 1",
    "original_sentences": f"{_SENT}, l AS (SELECT title, max(doc_id) AS doc_id FROM documents WHERE title IS NOT NULL GROUP BY 1), f AS (SELECT l.title, a[1] AS first FROM l LEFT JOIN s USING (doc_id)) SELECT d.doc_id, md5(first) AS first_md5 FROM documents d LEFT JOIN f USING (title)",
    "stable_article_id": "SELECT doc_id, CASE WHEN title IS NOT NULL AND source IS NOT NULL THEN 'art_v1_' || sha256('{\"source\":' || CAST(to_json(source) AS VARCHAR) || ',\"title\":' || CAST(to_json(title) AS VARCHAR) || '}') END AS stable_id FROM documents",
    "json_score_parse": "WITH e AS (SELECT event_id, props, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v, json_extract_string(props, '$.k') AS raw FROM events) SELECT event_id, CASE WHEN v BETWEEN 0 AND 100 THEN v END AS k, CASE WHEN props IS NULL OR NOT json_valid(props) THEN 'json_error' WHEN raw IS NOT NULL AND raw NOT IN ('NA', 'na') AND (v IS NULL OR v NOT BETWEEN 0 AND 100) THEN 'range_error' ELSE 'success' END AS error_type FROM e",
    "result_left_join": "WITH l AS (SELECT user_id, arg_max(struct_pack(k := CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) BETWEEN 0 AND 100 THEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END), event_id).k AS k FROM events GROUP BY 1) SELECT c_custkey AS custom_id, k, CASE WHEN user_id IS NULL THEN 'not_scored' ELSE 'success' END AS llm_error_type FROM customer LEFT JOIN l ON user_id = c_custkey",
    "request_lines": "SELECT DISTINCT sample_id, 'sentence_' || sample_id AS custom_id, 'Score: ' || cleaned_sentence AS content FROM manual_coding_full WHERE cleaned_sentence IS NOT NULL",
    "cost_estimate": "SELECT count(DISTINCT sample_id) AS n, round(count(DISTINCT sample_id) * (350 * 0.15 + 50 * 0.6) / 1e6, 6) AS cost FROM manual_coding_full",
    "name_variants": "WITH p AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, string_split(p_name, ' ')[-1] AS c, nullif(p_brand, 'Brand#11') AS d FROM part) SELECT DISTINCT p_partkey, unnest([a || ' ' || c, a || ' ' || b || ' ' || c, a || ' ' || left(b, 1) || ' ' || c, a || ' ' || left(b, 1) || '. ' || c, CASE WHEN d IS NOT NULL THEN d || ' ' || c ELSE a || ' ' || c END]) AS variant FROM p",
    "daily_weighted_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, round(sum((user_id % 5 + 1) * value) / sum(user_id % 5 + 1) FILTER (value IS NOT NULL), 6) AS weighted_mean, count(value) AS n_events FROM events GROUP BY 1, 2",
}
QUERIES = {name: globals()[name] for name in ORACLE}
