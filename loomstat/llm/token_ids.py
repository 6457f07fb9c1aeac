"""Problem 8: encoding of every text with a public tokenizer, by monoid tree reduction.

A text is cut into halves until a piece is at most ``leaf`` characters long;
pieces are encoded alone, and neighbours are joined going back up the tree.
Near a cut the pieces' ids can be wrong, because a pre-token may span the cut.
So a window around the cut is encoded again. It grows on either side until it
reaches an *anchor*: a place where the pre-tokenizer must cut whatever stands
before it, namely after a letter that no letter follows, after a digit that no
digit follows, and between any visible character and white space. No
alternative of the pre-tokenizer's pattern matches across such a place, and it
scans on from there without memory, so the ids before the left anchor and
after the right one are final: that is the proof that tokens outside the
window have stabilised. Without an anchor the window grows to the whole piece,
which is right as well. Joining is associative, so that a tree of any shape
gives the ids of the whole text.

Null and empty texts have the empty list.
"""

from __future__ import annotations

import base64
import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm.arrowmap import map_batches, texts
from loomstat.session import read_table

#: Where the vocabulary files are; a parameter of every function that reads one.
VOCABULARIES = "/opt/tokenizers"
#: Pattern of the byte-level pre-tokenizer (fixed value of the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters up to which a piece is encoded at once.
LEAF = 8192
#: First width of the window beside a cut; it doubles until there is an anchor.
WINDOW = 32

_AFTER = regex.compile(r"(?<=\p{L})(?![\p{L}\p{Cn}])|(?<=\p{N})(?![\p{N}\p{Cn}])|(?<=[^\s\p{Cn}])(?=[ \t\n])")


@lru_cache(maxsize=4)
def vocabulary(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> tiktoken.Encoding:
    """The tokenizer of a ``.tiktoken`` file; once in each Python worker."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _left_anchor(text: str, start: int, cut: int) -> int:
    """Last anchor in text[start:cut] judged by that piece alone; ``start`` if there is none."""
    width = WINDOW
    while True:
        low = max(start, cut - width)
        found = [m.start() for m in _AFTER.finditer(text, low, cut) if start < m.start() < cut]
        # the look-behind at ``low`` sees nothing before it, so a hit there is not trusted
        found = [p for p in found if p > low]
        if found:
            return found[-1]
        if low == start:
            return start
        width *= 2


def _right_anchor(text: str, cut: int, end: int) -> int:
    """First anchor in text[cut:end] judged by that piece alone; ``end`` if there is none."""
    width = WINDOW
    while True:
        high = min(end, cut + width)
        for m in _AFTER.finditer(text, cut, high):
            if cut < m.start() < high:
                return m.start()
        if high == end:
            return end
        width *= 2


def _drop_bytes(ids: list[int], size: int, enc: tiktoken.Encoding, front: bool) -> list[int]:
    """ids without the tokens of the first or last ``size`` bytes; an anchor is always a token boundary."""
    step, k = (1, 0) if front else (-1, len(ids) - 1)
    while size > 0:
        size -= len(enc.decode_single_token_bytes(ids[k]))
        k += step
    if size:
        raise ValueError("an anchor was not a token boundary")
    return ids[k:] if front else ids[: k + 1]


def join(text: str, start: int, cut: int, end: int, left: list[int], right: list[int], enc: tiktoken.Encoding) -> list[int]:
    """ids of text[start:end] from the ids of text[start:cut] and text[cut:end]."""
    if not left or not right:
        return left or right
    low, high = _left_anchor(text, start, cut), _right_anchor(text, cut, end)
    window = enc.encode_ordinary(text[low:high])
    head = _drop_bytes(left, len(text[low:cut].encode()), enc, front=False)
    tail = _drop_bytes(right, len(text[cut:high].encode()), enc, front=True)
    return head + window + tail


def encode(text: str | None, enc: tiktoken.Encoding, leaf: int = LEAF) -> list[int]:
    """ids of a text; those of the tokenizer on the whole text, for any ``leaf``."""
    if not text:
        return []

    def tree(start: int, end: int) -> list[int]:
        if end - start <= leaf:
            return enc.encode_ordinary(text[start:end])
        cut = (start + end) // 2
        return join(text, start, cut, end, tree(start, cut), tree(cut, end), enc)

    return tree(0, len(text))


def decode(ids: list[int], enc: tiktoken.Encoding) -> str:
    """The text of ids: bytes concatenated up a tree, then read as UTF-8."""
    if not len(ids):
        return ""

    def tree(low: int, high: int) -> bytes:
        if high - low <= 1024:
            return b"".join(enc.decode_single_token_bytes(int(i)) for i in ids[low:high])
        middle = (low + high) // 2
        return tree(low, middle) + tree(middle, high)

    return tree(0, len(ids)).decode("utf-8", "replace")


def with_ids(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES, leaf: int = LEAF) -> DataFrame:
    """(key, ids) of each row: no shuffle, one pass, whatever other columns ``df`` has."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>"

    def work(batch: pa.RecordBatch) -> dict:
        enc, flat, offsets = vocabulary(name, folder), array("i"), [0]
        for t in texts(batch.column(1)):
            flat.extend(encode(t, enc, leaf))
            offsets.append(len(flat))
        ids = pa.array(np.frombuffer(flat, dtype=np.int32) if flat else np.empty(0, np.int32))
        return {key: batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids)}

    return map_batches(df.select(F.col(key), F.col(text)), work, schema)


def with_lengths(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES, leaf: int = LEAF) -> DataFrame:
    """(key, n_tokens) of each row; the ids don't leave the Python worker."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, n_tokens bigint"

    def work(batch: pa.RecordBatch) -> dict:
        enc = vocabulary(name, folder)
        return {key: batch.column(0), "n_tokens": np.array([len(encode(t, enc, leaf)) for t in texts(batch.column(1))], dtype=np.int64)}

    return map_batches(df.select(F.col(key), F.col(text)), work, schema)


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    """doc_id and the ids of every document by byte_bpe_50k."""
    return with_ids(read_table(spark, root, "documents"), "doc_id", "text")
