"""Problem 10: statistics of each text, and whether it is prose, a list, a table or junk.

The decision combines what stands in lines with what stands in words:

* vertical alignment: the delimiter (bar, tab, semicolon, comma, run of blanks)
  that cuts most lines into the same number of cells makes a table;
* indentation and markers: marked lines, indents that come back with a period
  (entries with hanging lines, nested entries), or short lines that neither end nor
  continue sentences make a list; wrapped prose is told from the last by the
  autocorrelation of its line lengths, which are nearly one length throughout;
* words and characters: broken encodings, code, machine strings, symbols,
  random letters and repeated words make junk.

Words mixed over all languages that a text of words can hardly do without are
fixed values; the share of them tells random words. Null, empty and blank texts
have statistics of 0 and no kind. Texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm.arrowmap import map_batches, texts
from loomstat.session import read_table

# Frequent function words by language.
COMMON = frozenset(
    """
the of and to in a an is was for on that with by at from as it be this are or not his her he she they we you i but have has had which one another said under before after while did will without despite near during
der die das und in den von zu mit für auf ist im dem nicht ein eine des aus am hat vor sich auch als an nach wie um bei oder einer einem einen ohne trotz zum zur sagte
le la les de des du un une et en à au aux pour dans par sur que qui a est pas ce sans après devant malgré avec il elle pourquoi selon cette son sa
el los las del y que se por con una para su lo como más al sin según tras pese fue es dijo no ha
и в не на что с по из к за от о для после без при до как это он она они почему согласно сказал у
في من على إلى عن أن هذا هذه التي الذي مع بعد وفق قال لماذا دون رغم لا لم أمام
का की के में ने है को से और पर यह कि क्या भी नहीं कहा हैं बाद फिर कल
""".split()
)

_MARK = re.compile(r"\s*(?:[-–—*•·▪◦●○→►▸✓+]|\[[ xX]?\]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxlIVXL]{1,5})[.):]|\(\d{1,3}\)|#\d{1,3})\s+\S")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|\bfunction\s*\w*\(|\breturn\b[^\n]{0,60};|\bvar \w+\s*=|[{;]\s*\n|\w\(\w*\)\s*[;{]|\bdef \w+\(|\bSELECT\b.{1,80}\bFROM\b|\"\w+\":\s*[\[{\"\d]")
_HEX = re.compile(r"(?:0x)?[0-9a-fA-F]{2,}")
_EDGE = ".,;:!?…。！？।؟،؛\"“”„«»'’‘()[]{}|*-–—"
_TERMINAL = ".!?…。！？।؟:;\"”»)」』]'"
#: Abbreviations whose full stop ends no sentence inside a list entry.
_SHORT = frozenset("rep sen gov gen amb dr mr mrs ms st inc co corp ltd etc no sec dra sr sra prof pág núm art nr abs mio mme m d s p cf vs ext jr u e g i z b h डॉ पृ د ст т г ч".split())

# Classes of characters, as bits of one table over all code points.
_BITS = {n: 1 << i for i, n in enumerate("alnum space lower upper latin vowel unspaced code term stop strong closer mid broken odd lead high digit letter".split())}


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint32)
    chars = list(map(chr, range(0x110000)))
    is_a = {name: np.frombuffer(bytes(map(test, chars)), np.bool_) for name, test in (("alnum", str.isalnum), ("space", str.isspace), ("lower", str.islower), ("upper", str.isupper), ("letter", str.isalpha), ("digit", str.isdigit))}
    for name, found in is_a.items():
        table[found & (is_a["alnum"] if name != "space" else ~is_a["alnum"])] |= _BITS[name]
    for name, chars in {
        "vowel": "aeiouyàâäéèêëîïíóôöùûüúáñœæAEIOUYÀÂÄÉÈÊËÎÏÍÓÔÖÙÛÜÚÁŒÆ", "code": "{}<>=;$\\|~^`#@*+[]&", "term": ".!?…。！？।؟", "stop": ".", "strong": "。！？", "closer": "\"”»)]」』%",
        "mid": ",;:!?", "broken": "\ufffd", "odd": "þ¤©®¬¢™€Ã", "lead": "ÃÂâàÐÑØÙãäåæçèéêï",
    }.items():
        for c in chars:
            table[ord(c)] |= _BITS[name]
    for name, ranges in {"latin": [(65, 91), (97, 123), (0xC0, 0x250)], "unspaced": [(0xE00, 0xE80), (0x3040, 0x3100), (0x3400, 0xA000)], "broken": [(0, 9), (0x80, 0x85), (0x86, 0xA0)], "high": [(0x80, 0xA0), (0xA1, 0xAB), (0xAC, 0xBB), (0xBC, 0xC0)]}.items():
        for low, high in ranges:
            table[low:high] |= _BITS[name]
    return table


def _cells(lines: list[str]) -> tuple[float, int, float]:
    """The best delimiter's share of lines with one number of cells, that number, and the mean length of the cells."""
    best = (0.0, 0, 0.0)
    for cut in ("|", "\t", ";", ",", "  "):
        if sum(cut in x for x in lines) < 0.5 * len(lines):
            continue
        if cut == "  ":
            rows = [re.split(r"\s{2,}|\t", x.strip()) for x in lines]
        else:
            rows = [x.split(cut) for x in lines]
        counts = Counter(len(r) for r in rows if len(r) > 1)
        if not counts:
            continue
        size, n = max(counts.items(), key=lambda x: (x[1], x[0]))
        share = n / len(lines)
        own = [c for r in rows if len(r) == size for c in r]
        mean = sum(len(c.strip()) for c in own) / len(own)
        if share > best[0] + 0.05:
            best = (share, size, mean)
    return best


#: Lags over which line lengths are compared, and the longest period of indents.
LAGS, PERIOD = 3, 6


def _autocorrelation(lengths: np.ndarray) -> float:
    """Autocorrelation of line lengths about zero, the mean of the lags 1 to LAGS: 1 for lines of one length, 1 / (1 + cv^2) for lengths that don't depend on each other.

    The last line, which ends where its text does, isn't counted.
    """
    x = lengths[:-1]
    found = [float(x[k:] @ x[:-k]) / max(1.0, float(np.sqrt((x[k:] @ x[k:]) * (x[:-k] @ x[:-k])))) for k in range(1, LAGS + 1) if len(x) > k]
    return sum(found) / len(found) if found else 0.0


def _periodicity(indents: np.ndarray) -> float:
    """The best share of lines whose indent is that of the line a period (2 to PERIOD) before, over what any two lines have; 0 if all indents are equal."""
    if len(indents) < 6 or (indents == indents[0]).all():
        return 0.0
    _, n = np.unique(indents, return_counts=True)
    chance = float((n * n).sum()) / len(indents) ** 2
    same = [float((indents[k:] == indents[:-k]).mean()) for k in range(2, min(PERIOD, len(indents) // 2) + 1)]
    return (max(same) - chance) / (1 - chance)


def statistics(text: str) -> dict[str, float]:
    """The statistics of one text; all 0 if it is blank."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    c = _classes()[points]
    has = lambda name: (c & _BITS[name]) != 0
    count = lambda name: int(np.count_nonzero(c & _BITS[name]))
    visible = len(c) - count("space")
    if not visible:
        return dict.fromkeys(FIELDS, 0.0)
    lines = [x for x in text.replace("\r", "\n").split("\n") if x and not x.isspace()]
    tokens = text.split()
    marks = [t.strip(_EDGE) or t for t in text.lower().split()]
    words = [w for w in marks if w and not w.isdigit() and w not in _EDGE]
    n = len(words)
    space, letter, stop = has("space"), has("letter"), has("stop")
    before, after = c[:-1], c[1:]
    # sentences end at a mark before white space, a closing mark or the end, or at a mark of a script without spaces
    ends = has("term")
    ends[:-1] &= ((after & (_BITS["space"] | _BITS["closer"])) != 0) | ((before & _BITS["strong"]) != 0)
    n_ends = 0
    for i in np.flatnonzero(ends).tolist():
        if text[i] == ".":
            k = i
            while k > 0 and i - k < 14 and text[k - 1].isalnum():
                k -= 1
            w = text[k:i]
            # not after an abbreviation, nor after a number, which may be an ordinal or an entry's marker
            n_ends += (k < i and not w.isdigit() and w.lower() not in _SHORT) or (k == i and i > 0 and text[i - 1] in "\"”»)]")
        else:
            n_ends += 1
    odd_joins = int(np.count_nonzero(((before & _BITS["lower"]) != 0) & ((after & _BITS["upper"]) != 0))) + int(np.count_nonzero(space[:-1] & ((after & (_BITS["mid"] | _BITS["stop"])) != 0)))
    if len(c) > 2:
        around = letter[:-2] & letter[2:]
        odd_joins += int(np.count_nonzero(around & ((c[1:-1] & _BITS["mid"]) != 0))) + int(np.count_nonzero(around & stop[1:-1] & ((c[2:] & _BITS["lower"]) != 0)))
    odd = has("odd")
    broken = count("broken") + int(np.count_nonzero(odd[:-1] & odd[1:])) + 2 * int(np.count_nonzero(((before & _BITS["lead"]) != 0) & ((after & _BITS["high"]) != 0)))
    # distinct words in stretches of 60, so that long texts aren't taken for repetitive ones
    shares = [len(set(marks[i : i + 60])) / len(marks[i : i + 60]) for i in range(0, max(1, len(marks) - 20), 60)]
    lengths = np.array([len(x.rstrip()) for x in lines], float)
    indents = np.array([len(x) - len(x.lstrip()) for x in lines])
    share, cells, cell_length = _cells(lines) if len(lines) > 1 else (0.0, 0, 0.0)
    code, digits, letters = count("code") / visible, count("digit") / visible, int(np.count_nonzero(letter))
    return {
        "n_words": float(n),
        "n_tokens": float(len(tokens)),
        "mean_word_length": sum(map(len, words)) / n if n else 0.0,
        "symbol_ratio": 1 - count("alnum") / visible,
        "lines_ending_in_punctuation": sum(x.rstrip()[-1] in _TERMINAL for x in lines) / max(1, len(lines)),
        "common_words": sum(w in COMMON for w in words) / n if n else 0.0,
        "n_lines": float(len(lines)),
        "sentence_ends": float(n_ends),
        "marked_lines": sum(_MARK.match(x) is not None for x in lines) / max(1, len(lines)),
        "indent_period": _periodicity(indents),
        "length_autocorrelation": _autocorrelation(lengths),
        "median_line": float(np.median(lengths)) if len(lines) else 0.0,
        "aligned_lines": share,
        "cells": float(cells),
        "cell_length": cell_length,
        "broken": broken / visible,
        "code": code,
        "tags": sum(len(m[0]) for m in _TAG.finditer(text)) / visible if code > 0.02 else 0.0,
        "odd_joins": odd_joins / max(1, len(tokens)),
        "hex_tokens": sum(len(x) for x in tokens if _HEX.fullmatch(x)) / visible if digits > 0.15 else 0.0,
        "longest_token": float(max(map(len, tokens))),
        "distinct_words": float(np.median(shares)),
        "vowels": count("vowel") / max(1, letters),
        "latin": count("latin") / visible,
        "unspaced": count("unspaced") / visible,
        "repeated": int(np.count_nonzero((points[1:] == points[:-1]) & ~space[1:])) / visible,
        "commas": sum(text.count(x) for x in ",،，、·•|/;") / max(1, n),
        "dots": float(text.count(" · ") + text.count(" • ") + text.count(" | ")),
        "lower_starts": sum(x.lstrip()[0].islower() for x in lines[1:]) / max(1, len(lines) - 1),
    }


FIELDS = (
    "n_words n_tokens mean_word_length symbol_ratio lines_ending_in_punctuation common_words n_lines sentence_ends marked_lines indent_period length_autocorrelation median_line "
    "aligned_lines cells cell_length broken code tags odd_joins hex_tokens longest_token distinct_words vowels latin unspaced repeated commas dots lower_starts"
).split()


def _junk(s: dict[str, float]) -> bool:
    if s["broken"] > 0.08 or s["hex_tokens"] > 0.6 or s["repeated"] > 0.4:
        return True
    n = s["n_words"]
    if s["tags"] > 0.3 or (s["tags"] > 0.1 and s["code"] > 0.08):
        return True
    if s["symbol_ratio"] > 0.5 and s["unspaced"] < 0.2 and s["latin"] < 0.5:
        return True
    if s["latin"] > 0.6 and s["longest_token"] > 50 and s["n_words"] < 0.02 * s["longest_token"] * 10:
        return True
    if s["n_tokens"] >= 8 and s["distinct_words"] < 0.42 and s["unspaced"] < 0.3:
        return True
    if s["latin"] > 0.45 and n >= 5 and (s["vowels"] < 0.2 or (s["odd_joins"] > 0.12 and s["odd_joins"] * s["n_tokens"] >= 4)):
        return True
    return s["unspaced"] < 0.3 and n >= 25 and s["common_words"] < 0.02 and s["n_lines"] < 3 and s["odd_joins"] > 0.04


def kind(s: dict[str, float]) -> str:
    """prose, list, table or junk, from the statistics of a text that isn't blank."""
    lines, n = s["n_lines"], s["n_words"]
    if lines >= 2 and s["aligned_lines"] >= 0.75 and s["broken"] < 0.08 and s["tags"] < 0.1:
        short = s["cell_length"] < 14
        if s["cells"] >= 3 and short and s["sentence_ends"] <= 0.4 * lines:
            return "table"
        if s["cells"] == 2 and short and lines >= 4 and s["sentence_ends"] <= 0.1 * lines and s["common_words"] < 0.05 and s["marked_lines"] < 0.5:
            return "table"
    if _junk(s):
        return "junk"
    ends_a_line = s["sentence_ends"] / max(1, lines)
    if lines >= 2 and s["marked_lines"] >= 0.6 and ends_a_line < 0.8:
        return "list"
    if lines >= 3 and ends_a_line <= 0.15 and s["median_line"] < 75 and s["lines_ending_in_punctuation"] < 0.4:
        wrapped = s["lower_starts"] > 0.3 and s["length_autocorrelation"] > 0.94 and s["median_line"] > 35 and s["marked_lines"] < 0.3
        if not wrapped:
            return "list"
    # entries with hanging or nested lines come back with a period, and hardly a sentence ends in them
    if lines >= 6 and s["indent_period"] > 0.5 and ends_a_line <= 0.3 and s["commas"] < 0.5:
        return "list"
    # entries one after the other in a line: many separators, few words between them, hardly an end
    if n >= 8 and s["dots"] >= 3 and s["dots"] / n > 0.08 and s["sentence_ends"] <= 0.4 * s["dots"]:
        return "list"
    entries = s["commas"] * n
    if lines <= 3 and entries >= 6 and s["commas"] > 0.14 and s["sentence_ends"] <= 0.2 * entries and s["sentence_ends"] <= max(2, 0.05 * n) and s["longest_token"] < 30:
        return "list"
    return "prose"


def with_kind(df: DataFrame, key: str, text: str, every: bool = False) -> DataFrame:
    """(key, statistics.., kind) of each row in one pass without a shuffle; kind is null for a blank text."""
    kept = FIELDS if every else []
    schema = ", ".join([f"{key} {df.schema[key].dataType.simpleString()}", *(f"{f} double" for f in kept), "kind string"])

    def work(batch: pa.RecordBatch) -> dict:
        rows = [statistics(t) if t.strip() else None for t in texts(batch.column(1))]
        out = {key: batch.column(0)} | {f: np.array([r[f] if r else 0.0 for r in rows]) for f in kept}
        return out | {"kind": pa.array([kind(r) if r else None for r in rows], pa.string())}

    return map_batches(df.select(F.col(key), F.col(text)), work, schema)


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that aren't prose for the most part, with what they are."""
    return with_kind(read_table(spark, root, "documents"), "doc_id", "text").where("kind <> 'prose'").select("doc_id", "kind")


def p10_statistics(spark: SparkSession, root: str) -> DataFrame:
    """The statistics and the kind of each document."""
    return with_kind(read_table(spark, root, "documents"), "doc_id", "text", every=True)
