"""Problem 2: sentence units of texts in many languages and scripts.

A pushdown automaton reads each line. Only the characters that can change its
state are visited (one regular expression finds them): terminators, quotation
marks, brackets and, in Thai, blanks. At the bottom of its stack are the list
levels that are open, each with its indentation, style and last number, from line to
line; above them lie the open quotations and brackets of the line, and while
there is one no terminator ends a unit. Otherwise a full stop is looked up in
tries of abbreviations, read backwards.

Rules, in the order in which they are tried:

* a line end ends the unit; an opener that its line never closes, or that a pair
  around it crosses, counts as an ordinary character;
* a list marker at the head of a line opens a list level or goes on with it, and a less
  indented line closes the levels above its own; inside a line the number that follows
  a level's last one, or a 1 after a colon, is a marker too; a marker's full stop ends nothing;
* a full stop after an abbreviation that stands before its word ends nothing; one
  after an abbreviation that can close a sentence ends it if a start follows;
* initials and ordinal numbers before a word end nothing;
* after any other full stop a lower-case word continues the unit;
* a quotation that closes with a terminator inside ends the unit if a start
  follows; in scripts without case only if a comma or colon led into it;
* a bracket that closes with a terminator inside ends the unit if it opened it;
* in Thai, a blank between two Thai characters ends a unit; one beside a number or
  a Latin letter doesn't.

A line takes one pass to match its openers and one to read it.

Offsets count code points; outer white space isn't part of a unit, so that the
units of a text hold all its other characters. Null, empty and blank texts have
no unit. Whole texts are read, whatever their length.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm.arrowmap import map_batches, texts
from loomstat.session import read_table

# Abbreviations by language, written without the last full stop.
#: They stand before the word they belong to, so that they never end a sentence.
BEFORE = """
Mr Mrs Ms Mx Dr Prof Rep Reps Sen Sens Gov Gen Amb Sec Lt Col Capt Cmdr Sgt Maj Adm Rev Hon Pres St Mt Ft Fr Sr Jr No Nos Vol vol pp p cf Cf vs v viz i.e e.g ext Ext art Art Arts Fig fig Eq ch Ch ca approx Messrs Supt Atty Dist Ave Bros
Nr Abs gem bzw vgl z.B z d.h d u.a u i.d s S Hr Fr Frl Mio Mrd Tsd Dipl Ing Bd Kap ggf inkl exkl zzgl sog Str
M MM Mme Mlle Me Mgr Pr p.ex n° art al éd
Sra Sres Srta Dra Dña D Da Ud Uds pág págs núm núms art arts EE FF cap vol ej p.ej
г-н г-жа гр проф акад ст п пп см ср т т.е т.к т.д стр рис им ул напр д-р
د أ م ص رقم
डॉ श्री श्रीमती प्रो पृ सं क्र
น.ส ดร นาย นาง พ.ต ร.ต พล.อ
""".split()
#: They can be the last word of a sentence.
CLOSING = """
U.S U.K U.N E.U D.C a.m p.m A.M P.M etc Etc Inc Ltd Co Corp LLC Bros Assn Dept al Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec
usw usf Std
etc cie
UU etc Cía S.A
г гг ч мин руб млн млрд тыс др пр
ق.م
ई.पू
น
""".split()
#: Words that name a time zone after a.m. and p.m.
ZONES = "Eastern Central Mountain Pacific Atlantic Alaska Hawaii Greenwich Standard Daylight ET CT MT PT EST EDT CST CDT MST MDT PST PDT GMT UTC CET CEST EET BST".split()
#: Months; before a day they end nothing, after an ordinal they are no start.
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()
#: Words before a German ordinal number.
ORDINAL_BEFORE = "am im vom zum beim seit bis ab der dem den des die das ein einem einen einer dieser diesem ihrer ihrem seiner seinem jeder jedem und zur".split()
#: Opening marks with the marks that close them.
PAIRS = {"“": "”“", "„": "“”\"", "«": "»", "»": "«", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "《": "》", '"': '"'}
TERMINATORS = ".!?…。．！？؟।॥｡‼⁇⁈⁉۔።"
CLOSERS = "”“»」』)]）】》\"’'"
#: Full stops that only end after what the abbreviations say.
SOFT = "."

_EVENT = re.compile(r"[!?…。．！？؟।॥｡‼⁇⁈⁉۔።“”„«»「」『』()\[\]（）【】《》\"]|\.(?![\w/])|\.(?=[A-ZÀ-Þ][a-zß-ÿ])|(?<=[А-Яа-я])\.(?=[А-Я][а-я])|(?<=[ء-ي])\.(?=[ء-ي])")
_PAIRED = re.compile(r"[“”„«»「」『』()\[\]（）【】《》\"]")
_LINE = re.compile(r"[^\n\r\x0b\x0c\x85  ]+")
_MARKER = re.compile(r"\s*(?:\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.)]|[-–—*•·▪◦→])\s+")
_THAI = re.compile(r"[฀-๿]")
_THAI_BLANK = re.compile(r"(?<=[฀-๿.”»)])[  \t]+(?=[฀-๿“«(])")
_SKIP = re.compile(r"[\s“„«»\"'‘’(\[¿¡*_–—-]*")
_WORD = re.compile(r"\w+")
_WHITE = re.compile(r"[\s\x1c-\x1f]*")
_NOTHING = re.compile(r"[ \t .…]*")


class Trie:
    """Abbreviations read backwards from the full stop."""

    def __init__(self, words: list[str]) -> None:
        self.root: dict = {}
        for word in words:
            node = self.root
            for c in reversed(word):
                node = node.setdefault(c, {})
            node[""] = word

    def longest(self, text: str, end: int) -> str | None:
        """The longest entry that ends at ``end`` and begins where a word does."""
        node, found, k = self.root, None, end - 1
        while True:
            if "" in node and (k < 0 or not (text[k].isalnum() or text[k] in ".-_")):
                found = node[""]
            if k < 0 or (node := node.get(text[k])) is None:
                return found
            k -= 1


@lru_cache(maxsize=1)
def tries() -> tuple[Trie, Trie]:
    return Trie(BEFORE), Trie(CLOSING)


def _follower(line: str, at: int) -> str:
    """What stands after a possible end: '' nothing, 'l' lower case, 'd' digit, 'u' anything else that can begin a unit."""
    k = _SKIP.match(line, at).end()
    if k >= len(line):
        return ""
    c = line[k]
    return "l" if c.islower() else "d" if c.isdigit() else "p" if c in ",;:،؛，；" else "u"


def _back(line: str, at: int) -> int:
    """Where the white space before ``at`` begins."""
    while at > 0 and line[at - 1].isspace():
        at -= 1
    return at


def _word_before(line: str, at: int) -> str:
    end = _back(line, at)
    return line[line.rfind(" ", 0, end) + 1 : end]


def _is_initial(line: str, dot: int) -> bool:
    """A capital alone before the full stop, beside another name."""
    c = line[dot - 1]
    if not c.isupper() or (dot >= 2 and (line[dot - 2].isalnum() or line[dot - 2] == ".")):
        return False
    after = line[dot + 1 : dot + 3]
    if not (len(after) == 2 and after[0] in "  " and after[1].isupper()):
        return False
    before = _word_before(line, dot - 1)
    return not before or before[:1].isupper() or before[-1] in ".!?…“„”«»\"():;," or before in ("by", "and", "von", "para", "pour", "for")


def _stop_ends(line: str, dot: int, after: int) -> bool:
    """Whether the full stop at ``dot`` (closers follow up to ``after``) ends the unit."""
    kind = _follower(line, after)
    if kind == "":
        return True
    if kind in "lp":
        return False
    before, closing = tries()
    joined = after == dot + 1
    if joined:
        b, c = before.longest(line, dot), closing.longest(line, dot)
        if c and (not b or len(c) >= len(b)):
            if c.lower() in ("a.m", "p.m"):
                m = _WORD.match(line, _SKIP.match(line, after).end())
                return not (m and m[0] in ZONES)
            return kind == "u"
        if b or _is_initial(line, dot):
            return False
        if line[dot - 1 : dot].isdigit():
            k = dot - 1
            while k > 0 and line[k - 1].isdigit():
                k -= 1
            if dot - k <= 3:
                word = _word_before(line, k)
                m = _WORD.match(line, _SKIP.match(line, after).end())
                if word in ORDINAL_BEFORE or (m and m[0] in MONTHS):
                    return False
    return True


def matches(line: str, first: int = 0) -> dict[int, int]:
    """Closers of a line with their openers, which nest. What isn't in a pair is an ordinary character.

    A closer takes the nearest opener that it can close; those in between are given up.
    """
    stack: list[tuple[int, str]] = []
    waiting: dict[str, int] = {}  # how many openers of the stack a mark can close
    found: dict[int, int] = {}
    for m in _PAIRED.finditer(line, first):
        c = m[0]
        if waiting.get(c):
            closers = ""
            while c not in closers:
                at, closers = stack.pop()
                for x in closers:
                    waiting[x] -= 1
            found[m.start()] = at
        elif c in PAIRS and c != "»":
            stack.append((m.start(), PAIRS[c]))
            for x in PAIRS[c]:
                waiting[x] = waiting.get(x, 0) + 1
    return found


class Levels:
    """The open list levels: indentation, style and last number of each; a bullet has no number."""

    def __init__(self) -> None:
        self.open: list[list] = []

    def head(self, line: str) -> int:
        """Close and open levels by the head of a line; where its text begins."""
        indent = len(line) - len(line.lstrip())
        m = _MARKER.match(line)
        while self.open and self.open[-1][0] > indent:
            self.open.pop()
        if not m:
            while self.open and self.open[-1][0] == indent:
                self.open.pop()
            return 0
        mark = m[0].strip()
        digits = mark.strip("(.)")
        style, number = ("#" + mark.replace(digits, ""), int(digits)) if digits.isdigit() else (mark, 0)
        if self.open and self.open[-1][0] == indent:
            self.open[-1][1:] = style, number
        else:
            self.open.append([indent, style, number])
        return m.end()

    def inside(self, line: str, dot: int) -> bool:
        """Whether the full stop ends a number that goes on with the innermost level, or opens one after a colon."""
        k = dot
        while k > 0 and dot - k < 3 and line[k - 1].isdecimal():
            k -= 1
        if k == dot or k == 0 or not line[k - 1].isspace() or not line[dot + 1 : dot + 2].isspace():
            return False
        number = int(line[k:dot])
        if self.open and self.open[-1][1] == "#." and self.open[-1][2] + 1 == number:
            self.open[-1][2] = number
            return True
        if number == 1 and line.endswith(":", 0, _back(line, k)):
            self.open.append([len(line), "#.", 1])
            return True
        return False


def line_ends(line: str, levels: Levels | None = None) -> list[int]:
    """Where units end inside one line; the line's own end isn't among them."""
    levels = levels or Levels()
    first = levels.head(line)
    pairs = matches(line, first)
    openers = set(pairs.values())
    events = [(m.start(), m[0]) for m in _EVENT.finditer(line, first)]
    if _THAI.search(line):
        events = sorted(events + [(m.start(), " ") for m in _THAI_BLANK.finditer(line, first)])
    stack: list[tuple[int, bool]] = []  # position, and whether it opened the unit; the levels lie below
    ends: list[int] = []
    unit, skip = 0, first
    for at, c in events:
        if at < skip:
            continue
        if c == " ":
            if not stack and at > unit:
                ends.append(at)
                unit = at
        elif c in TERMINATORS:
            if stack:
                continue
            after = at + 1
            while after < len(line) and line[after] in TERMINATORS:
                after += 1
            only_stop = c == "." and after == at + 1
            if only_stop and levels.inside(line, at):
                continue
            close = after
            while close < len(line) and line[close] in "”»」』)]）】》’" and close not in openers:
                close += 1
            if only_stop:
                ended = _stop_ends(line, at, close)
            elif c == "…" or line[at:after] == "...":
                ended = _follower(line, close) not in ("l", "p")
            else:
                ended = _follower(line, close) != "p" and not (close > after and _follower(line, close) == "l")
            skip = close
            if ended and _NOTHING.match(line, unit).end() < at:
                ends.append(close)
                unit = close
        elif at in pairs:
            opened_at, opened_unit = stack.pop()
            if not stack:
                close = _pair_ends(line, opened_at, opened_unit, at)
                if close:
                    ends.append(close)
                    unit = close
        elif at in openers:
            stack.append((at, _WHITE.match(line, unit).end() >= at or (unit == 0 and at <= first)))
    return ends


def _pair_ends(line: str, opened_at: int, opened_unit: bool, at: int) -> int:
    """Where the unit ends with the closer at ``at``; 0 if it goes on."""
    inner = at - 1
    while inner > opened_at and (line[inner].isspace() or line[inner] in CLOSERS):
        inner -= 1
    if line[inner] not in TERMINATORS or inner == opened_at:
        return 0
    close = at + 1
    while close < len(line) and line[close] in "”»」』)]）】》":
        close += 1
    k = _SKIP.match(line, close).end()
    nxt = line[k : k + 1]
    if not nxt or nxt in ",;:،؛，；、" or nxt in TERMINATORS or "—" in line[close:k] or "–" in line[close:k]:
        ended = False
    elif line[at] in ")]）】":
        ended = opened_unit
    elif nxt.islower():
        ended = False
    elif nxt.isupper() or nxt.istitle() or nxt.isdigit() or not nxt.isalpha():
        ended = True
    else:
        led = _back(line, opened_at)
        ended = led > 0 and line[led - 1] in ",:،：，"
    return close if ended else 0


def units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each unit of a text, in order."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    levels = Levels()
    for m in _LINE.finditer(text):
        line, base, start = m[0], m.start(), 0
        if line.isspace():
            continue
        for end in (*line_ends(line, levels), len(line)):
            piece = line[start:end]
            body = piece.strip()
            if body:
                low = base + start + len(piece) - len(piece.lstrip())
                out.append((low, low + len(body)))
            start = end
    return out


def with_units(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_at, end_at) of each unit; one pass and no shuffle. Repeated rows give repeated units."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, start_at bigint, end_at bigint"

    def work(batch: pa.RecordBatch) -> dict | None:
        rows, starts, ends = array("q"), array("q"), array("q")
        for i, t in enumerate(texts(batch.column(1))):
            found = units(t)
            rows.extend([i] * len(found))
            for a, b in found:
                starts.append(a)
                ends.append(b)
        if not rows:
            return None
        return {key: batch.column(0).take(pa.array(np.frombuffer(rows, np.int64))), "start_at": np.frombuffer(starts, np.int64), "end_at": np.frombuffer(ends, np.int64)}

    return map_batches(df.select(F.col(key), F.col(text)), work, schema)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Each sentence unit of each body; an article that was sent again counts once."""
    return with_units(read_table(spark, root, "articles"), "article_no", "body").distinct()


def p2_sentence_text(spark: SparkSession, root: str) -> DataFrame:
    """The units with their place in the article and their text."""
    articles = read_table(spark, root, "articles").select("article_no", "body").dropDuplicates(["article_no"])
    schema = "article_no bigint, sentence_no bigint, sentence string"

    def work(batch: pa.RecordBatch) -> dict | None:
        rows, numbers, found = [], [], []
        for i, t in enumerate(texts(batch.column(1))):
            for k, (a, b) in enumerate(units(t)):
                rows.append(i)
                numbers.append(k + 1)
                found.append(t[a:b])
        if not rows:
            return None
        return {"article_no": batch.column(0).take(pa.array(rows)), "sentence_no": np.array(numbers, np.int64), "sentence": pa.array(found, pa.string())}

    return map_batches(articles, work, schema)
