"""Text expressions: topic mentions, attribution, masking, cleaning, weights, parsing of scores."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[ENTITY]"


def alternation(terms: list[str]) -> str:
    """Word-bounded, case-insensitive pattern; longest terms first, so that they win."""
    return r"(?i)\b(" + "|".join(re.escape(t).replace(r"\ ", " ") for t in sorted(set(terms), key=lambda t: (-len(t), t))) + r")\b"


def mentions(c: Column, terms: list[str]) -> Column:
    return c.rlike(alternation(terms))


def sentences(c: Column) -> Column:
    """Pieces after a final mark and white space; a documented rule in place of a parser's model."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def exclusive_party(c: Column, a: list[str], b: list[str]) -> Column:
    """'a' or 'b' if only that side is mentioned, else null."""
    has_a, has_b = mentions(c, a), mentions(c, b)
    return F.when(has_a & ~has_b, F.lit("a")).when(has_b & ~has_a, F.lit("b"))


def salience(count: Column, total: Column) -> Column:
    return F.try_divide(count, total)


def salient(threshold: float, *saliences: Column) -> Column:
    """Whether any side reaches the threshold."""
    return F.greatest(*[F.coalesce(s, F.lit(0.0)) for s in saliences], F.lit(0.0)) >= threshold


def weight(count: Column, total: Column, how: str = "log_volume") -> Column:
    """Weight of an article from its matching and all sentences."""
    forms = {
        "linear": F.try_divide(count, total),
        "sqrt": F.sqrt(F.try_divide(count, total)),
        "log": F.try_divide(F.log1p(count), F.log1p(total)),
        "log_volume": F.log1p(count),
    }
    if how not in forms:
        raise ValueError(f"unknown weight: {how}")
    return forms[how]


def mask(c: Column, terms: list[str], token: str = TOKEN) -> Column:
    """Terms replaced by the token, adjacent tokens collapsed in one pass."""
    t = re.escape(token)
    return F.regexp_replace(F.regexp_replace(c, alternation(terms), token), rf"{t}(?:\s+{t})+", token)


def _longest_first(terms: list[str]) -> str:
    return "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))


def remove_titles(c: Column, abbreviated: list[str], full: list[str]) -> Column:
    """Titles removed: abbreviated ones with their full stop before white space or the end, others at word bounds."""
    return tidy(_without_titles(c, abbreviated, full))


def _without_titles(c: Column, abbreviated: list[str], full: list[str]) -> Column:
    short = rf"(?i)\b(?:{_longest_first(abbreviated)})\.(\s|$)"
    return F.regexp_replace(F.regexp_replace(c, short, "$1"), alternation(full), "")


def mark_names(c: Column, abbreviated: list[str], full: list[str], protected: list[str]) -> Column:
    """One or two words after a title set between the marks \\x01 and \\x02, unless a protected term is part of them.

    Case isn't looked at, so any word after a title is a name.
    """
    title = rf"(?i)\b((?:{_longest_first(abbreviated)})\.|(?:{_longest_first(full)}))\s+([a-z]{{2,}}(?:[\s-][a-z]{{2,}})?)"
    marked = F.regexp_replace(c, title, "$1 \x01$2\x02")
    return F.regexp_replace(marked, rf"(?i)\x01([^\x02]*(?:{_longest_first(protected)})[^\x02]*)\x02", "$1") if protected else marked


def clean(c: Column, known: list[str], abbreviated: list[str], full: list[str], labels: list[str], protected: list[str], masking: bool, token: str = TOKEN) -> Column:
    """Sentences without names, titles and labels: names are masked by the token, or removed.

    Known terms, then unknown names after titles, then titles and labels themselves; adjacent tokens
    become one; possessives, white space before punctuation and a leading mark go.
    """
    named = mark_names(F.regexp_replace(c, alternation(known), token if masking else ""), abbreviated, full, protected)
    if masking:
        bare = F.regexp_replace(named, r"\x01[^\x02]*\x02", token)
    else:
        bare = F.regexp_replace(named, rf"(?i)\b(?:(?:{_longest_first(abbreviated)})\.|(?:{_longest_first(full)})) \x01[^\x02]*\x02", "")
    bare = _without_titles(bare, abbreviated, full + labels)
    one = F.regexp_replace(bare, rf"(?:{re.escape(token)}\s*)+", f"{token} ")
    close = F.regexp_replace(F.regexp_replace(strip_possessive(one), r"\s+", " "), r" ([.,;:!?])", "$1")
    return F.trim(F.regexp_replace(close, r"^\s*[.,;:]\s*", ""))


def party_pieces(sentences_: Column, topic: list[str], own: list[str], other: list[str]) -> Column:
    """The sentences on the topic that mention the own side only."""
    return F.filter(sentences_, lambda s: mentions(s, topic) & mentions(s, own) & ~mentions(s, other))


def parallel(original: Column, cleaned: Column) -> Column:
    """Two arrays as one of pairs, for one explode; the first's order and length count."""
    return F.transform(original, lambda x, i: F.struct(x.alias("original"), F.get(cleaned, i).alias("cleaned")))


def tidy(c: Column) -> Column:
    """One blank for white space, none before punctuation, no leading punctuation."""
    one = F.regexp_replace(c, r"\s+", " ")
    close = F.regexp_replace(one, r" ([.,;:!?])", "$1")
    return F.trim(F.regexp_replace(close, r"^[\s.,;:!?]+", ""))


def strip_possessive(c: Column) -> Column:
    return F.regexp_replace(c, r"[`']s\b", "")


def token_count(c: Column, token: str = TOKEN) -> Column:
    return F.regexp_count(c, F.lit(re.escape(token)))


def stable_id(prefix: str, **parts: Column) -> Column:
    """Prefix and SHA-256 of the canonical JSON of the parts, keys in order; null if any part is null.

    Control characters are escaped with capital hexadecimal digits, other than by
    some JSON writers; ids of this engine agree with each other.
    """
    body = F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]))
    some = F.lit(True)
    for c in parts.values():
        some = some & c.isNotNull()
    return F.when(some, F.concat(F.lit(prefix), F.sha2(body, 256)))


def child_seed(master: int, namespace: str, scheme: str = "loomstat-seed-1") -> int:
    """128-bit seed of a named stream; ``scheme`` keeps the streams of different programs apart."""
    return int.from_bytes(hashlib.sha256(f"{scheme}|{master}|{namespace}".encode()).digest()[:16], "big")


def search_seed(master: int, namespace: str) -> int:
    """31-bit seed for generators that take no more."""
    return child_seed(master, namespace) % (2**31 - 2) + 1


def score_of(json: Column, key: str) -> Column:
    """A score in 0..100 from a JSON object, number or numeric string; null if absent, NA or out of range."""
    v = F.expr("try_cast(null as double)") if key is None else F.get_json_object(json, f"$.{key}").try_cast("double")
    return F.when(v.between(0, 100), v)


def score_error(json: Column, keys: list[str]) -> Column:
    """json_error, api_error, range_error or success of a response."""
    def bad(key: str) -> Column:
        raw = F.get_json_object(json, f"$.{key}")
        v = raw.try_cast("double")
        return raw.isNotNull() & ~raw.isin("NA", "na") & (v.isNull() | ~v.between(0, 100))

    any_bad = F.lit(False)
    for k in keys:
        any_bad = any_bad | bad(k)
    no_object = json.isNull() | (F.left(F.trim(json), F.lit(1)) != "{") | F.try_parse_json(json).isNull()
    return F.when(no_object, F.lit("json_error")).when(F.get_json_object(json, "$.error").isNotNull(), F.lit("api_error")).when(any_bad, F.lit("range_error")).otherwise(F.lit("success"))


def request_line(index: Column, prompt: str, sentence: Column, model: str = "model") -> Column:
    """One JSON request of a batch: id, and prompt with the sentence."""
    message = F.struct(F.lit("user").alias("role"), F.concat(F.lit(prompt), sentence).alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message).alias("messages"), F.lit(0).alias("temperature"), F.lit(100).alias("max_tokens"))
    return F.to_json(F.struct(F.concat(F.lit("sentence_"), index.cast("string")).alias("custom_id"), body.alias("body")))


def result_content(line: Column) -> Column:
    return F.get_json_object(line, "$.response.body.choices[0].message.content")


def result_index(line: Column) -> Column:
    """Number in the id of a result; -1 if it has none."""
    return F.coalesce(F.regexp_extract(F.get_json_object(line, "$.custom_id"), r"^sentence_(\d+)$", 1).try_cast("bigint"), F.lit(-1))


def cost(n: Column, per_input: float, per_output: float, tokens_in: int = 350, tokens_out: int = 50) -> Column:
    return n * (tokens_in * per_input + tokens_out * per_output) / 1e6


def name_variants(first: Column, middle: Column, last: Column, nickname: Column) -> Column:
    """First Last, First Middle Last, First M Last, First M. Last and Nickname Last, without repeats."""
    initial = F.left(middle, F.lit(1))
    forms = [F.concat(first, F.lit(" "), last), F.concat(first, F.lit(" "), middle, F.lit(" "), last), F.concat(first, F.lit(" "), initial, F.lit(" "), last), F.concat(first, F.lit(" "), initial, F.lit(". "), last), F.concat(nickname, F.lit(" "), last)]
    return F.array_distinct(F.array_compact(F.array(*forms)))


def interval_text(lower: Column, upper: Column, places: int = 3) -> Column:
    return F.concat(F.lit("["), F.format_string(f"%.{places}f", lower), F.lit(", "), F.format_string(f"%.{places}f", upper), F.lit("]"))


def p_text(p: Column) -> Column:
    """Six places, scientific under one millionth."""
    return F.when(p < 1e-6, F.format_string("%.2e", p)).otherwise(F.format_string("%.6f", p))


def truncated(c: Column, length: int) -> Column:
    return F.left(c, F.lit(length))


def pipe_list(c: Column) -> Column:
    """An array as text with bars between its entries."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "|")


def from_pipe_list(c: Column, type_: str = "string") -> Column:
    """The array of such a text; null for null, empty for empty."""
    return F.when(c == "", F.array().cast(f"array<{type_}>")).otherwise(F.transform(F.split(c, r"\|"), lambda x: x.try_cast(type_)))
