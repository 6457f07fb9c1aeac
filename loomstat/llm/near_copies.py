"""Problem 3: records that tell the same text with small edits, by T-occurrence search.

Similarity of two records is that of their sets of runs of 8 characters (Jaccard,
0.5 or more). Every list of a single run is long in a corpus made of recurring
phrases, so lists are divided as in DivideSkip:

* *Short lists.* A text's runs are dealt to CLASSES by their hash; in each class
  the least values of the runs under FUNCTIONS hash functions are taken, and ROWS
  of these make a *feature*. Two texts of similarity J have a least value in
  common with a chance of J, so each feature with J ** ROWS, wherever the edits
  are and however common the runs. Lists of features are merged in order (the
  sort does the heap's work) and give each pair its number of shared features.
  A pair goes on from T = REQUIRED shared features: at J = 0.5 it has 10 of 320
  on average and fewer than 2 with a chance of about 1 in 2,000, at J = 0.55 of
  1 in 500,000.
* *Long lists* are those of the single runs. They are never merged: for a pair
  from the short lists each run of the smaller text is looked up by binary search
  in the sorted runs of the larger, and the pair is retained if the overlap
  reaches what J requires of the two sizes. This is exact.

Lists of any length are merged. One of more than LONG texts is cut into blocks,
whose pairs are dealt over all tasks, so that no task has a hot list's work. The
lists are dealt to parts whose number grows with the number of texts.

A class of a short text has few runs. Texts of up to 2 * FEW runs have features
over all their runs too, and those of up to FEW only these; any two texts within
a factor of two of each other have one kind in common.

Texts equal in their letters and digits are one text from the start (the key is
their hash); copies join the result at the end and have no postings of their own.

Defined cases: null and blank bodies take no part; a null title is empty; a
text of fewer than 8 letters and digits has no runs and is similar to none; a
record sent again counts once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm import shingles
from loomstat.llm.arrowmap import arrow_schema, batches_of, map_batches, map_tasks, texts
from loomstat.session import cut, read_table

#: Similarity from which on two records are near copies.
SIMILARITY = 0.5
#: Classes of the runs, hash functions of each class, and least values that make a feature.
CLASSES, FUNCTIONS, ROWS = 16, 100, 5
#: Runs up to which a text's features are over all its runs.
FEW = 64
#: Features that a pair must have in common.
REQUIRED = 2
#: Postings of a part; there are as many parts as that takes.
PART_POSTINGS = 2_000_000
#: Texts from which on a list is paired by blocks of so many, and pairs that are made at once.
LONG, PAIRS = 1024, 500_000
#: Bytes up to which a side is broadcast; beyond, it is shuffled.
BROADCAST_BYTES = 32 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Odd factors of the hash functions; the same in every task.
_FACTORS = np.random.default_rng(3).integers(0, 2**31, (CLASSES, FUNCTIONS), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Features of a class and of a text.
_EACH = FUNCTIONS // ROWS
FEATURES = CLASSES * _EACH
#: A number for each feature of a kind and class.
_NAMES = np.arange(1, 2 * FEATURES + 1, dtype=np.uint64).reshape(2, CLASSES, _EACH)
_EDGES = np.arange(1, CLASSES, dtype=np.uint64) << np.uint64(64 - int(np.log2(CLASSES)))


def _keys(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of each text's letters and digits, and 0 for a text without a run."""
    return np.array([xxhash.xxh3_64_intdigest(a[x:y]) if y - x >= shingles.RUN else 0 for x, y in zip(at, at[1:])], np.uint64).view(np.int64)


def _sets(a: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct runs of each text."""
    h = shingles.run_hashes(a)
    return [shingles.distinct(h[x : max(x, y - shingles.RUN + 1)]) for x, y in zip(at, at[1:])]


def _least(runs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The least values of a text, a row for each feature, and the names of the features, from its sorted distinct runs."""
    x = runs.astype(np.uint32)
    if len(x) <= 2 * FEW:
        yield (x[:, None] * _FACTORS.reshape(1, -1)).min(axis=0).reshape(-1, ROWS), _NAMES[0].ravel()
    if len(x) > FEW:
        at = np.concatenate(([0], np.searchsorted(runs, _EDGES)))
        some = np.diff(np.append(at, len(x))) > 0  # a class without a run has no feature
        least = np.minimum.reduceat(x[:, None] * _FACTORS[0], at[some], axis=0)
        yield least.reshape(-1, ROWS), _NAMES[1].ravel() if some.all() else _NAMES[1][some].ravel()


def features(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Features of texts, as 64-bit hashes, and the number of the text each belongs to."""
    found = [(i, *f) for i, runs in enumerate(sets) if len(runs) for f in _least(runs)]
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, least = np.concatenate([names for _, _, names in found]), np.concatenate([values for _, values, _ in found])
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            h = shingles.mix(h * _STEP + least[:, j])
    return h, np.repeat([i for i, _, _ in found], [len(names) for _, _, names in found])


def _pieces(texts_: list[str]) -> Iterator[list[str]]:
    """A batch in pieces that stay in a CPU's cache."""
    low, size = 0, 0
    for i, t in enumerate(texts_):
        size += len(t)
        if size > 300_000 or i + 1 == len(texts_):
            yield texts_[low : i + 1]
            low, size = i + 1, 0


def _joined(df: DataFrame, key: str, title: str, body: str) -> DataFrame:
    blank = F.trim(F.regexp_replace(F.col(body), r"(?U)[\s\x1c-\x1f]+", " ")) == ""
    return df.where(F.col(body).isNotNull() & ~blank).select(F.col(key).alias("id"), F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.col(body)).alias("text"))


def members(joined: DataFrame) -> DataFrame:
    """(id, key): each record with the key of its text; texts without a run have none."""

    def work(batch: pa.RecordBatch) -> dict | None:
        keys = np.concatenate([_keys(*shingles.code_points(piece)) for piece in _pieces(texts(batch.column(1)))])
        return {"id": batch.column(0).filter(pa.array(keys != 0)), "key": keys[keys != 0]}

    return map_batches(joined, work, "id bigint, key bigint").distinct()


_POSTINGS = "part int, key bigint, size int, found array<int>"


def postings(joined: DataFrame, parts: int) -> DataFrame:
    """(part, key, size, found): a text's features that lie in a part, in 32 bits beside the part's own.

    A task gives a text's postings once, however many copies it reads.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for piece in _pieces(texts(batch.column(1))):
                a, at = shingles.code_points(piece)
                keys, fresh = _keys(a, at), []
                for i, k in enumerate(keys.tolist()):
                    if k and k not in seen:
                        seen.add(k)
                        fresh.append(i)
                sets = _sets(a, at)
                sets = [sets[i] for i in fresh]
                h, doc = features(sets)
                code = doc.astype(np.uint64) * np.uint64(parts) + h % np.uint64(parts)
                order = np.argsort(code)
                code = code[order]
                start = np.flatnonzero(np.concatenate((np.ones(min(1, len(code)), bool), code[1:] != code[:-1])))
                if len(seen) > 2_000_000:  # only saves repetition, so it may be forgotten
                    seen.clear()
                if len(start):
                    own, part = (code[start] // np.uint64(parts)).astype(np.int64), (code[start] % np.uint64(parts)).astype(np.int32)
                    low = (h[order] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    found = pa.ListArray.from_arrays(pa.array(np.append(start, len(code)).astype(np.int32)), pa.array(low))
                    yield batches_of({"part": part, "key": keys[fresh][own], "size": np.array([len(x) for x in sets], np.int32)[own], "found": found}, schema)

    schema = arrow_schema(joined, _POSTINGS)
    return map_tasks(joined, run, _POSTINGS)


def _lists(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each part its texts' keys and sizes, and its postings merged: features in order, with the text of each."""
    held: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        own = batch.column("part").to_numpy()
        for p in np.unique(own).tolist():
            held.setdefault(p, []).append(batch.filter(pa.array(own == p)))
    for p in list(held):
        t = pa.Table.from_batches(held.pop(p)).combine_chunks()
        key, size, found = t["key"].to_numpy(), t["size"].to_numpy(), t["found"].combine_chunks()
        keys, first, at = np.unique(key, return_index=True, return_inverse=True)
        per = np.diff(found.offsets.to_numpy())
        code = found.values.to_numpy().view(np.uint32).astype(np.uint64) << np.uint64(32) | np.repeat(at, per).astype(np.uint64)
        code = shingles.distinct(code)  # copies of a text that several tasks read
        yield keys, size[first], (code >> np.uint64(32)), (code & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar."""
    return np.minimum(x, y) >= SIMILARITY * np.maximum(x, y)


_COUNTED = "k1 bigint, k2 bigint, n bigint"


def _counted(keys: np.ndarray, sizes: np.ndarray, pairs: list[np.ndarray]) -> dict | None:
    """Pairs of texts (numbers i * n + j with i < j) with how often each occurs."""
    if not pairs:
        return None
    pair = np.sort(np.concatenate(pairs))
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(pair)), bool), pair[1:] != pair[:-1])))
    x, y = np.divmod(pair[start], len(keys))
    return {"k1": keys[x], "k2": keys[y], "n": np.diff(np.append(start, len(pair)))}


def merged(lists: DataFrame, parts: int, most: int = LONG) -> DataFrame:
    """(k1, k2, n): in how many lists of a part two texts of similar size meet.

    The merge is one pass, whose result is written: pairs of ordinary lists, and pairs of
    blocks of long ones, which are dealt over all tasks to be paired there.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sizes, f, doc in _lists(batches):
            start = np.flatnonzero(np.concatenate((np.ones(min(1, len(f)), bool), f[1:] != f[:-1])))
            length = np.diff(np.append(start, len(f)))
            pairs, made = [], 0
            for s in np.flatnonzero(np.bincount(length[length <= most], minlength=3)[2:]) + 2:
                at = start[length == s]
                i, j = np.triu_indices(s, 1)
                step = max(1, PAIRS // len(i))
                for low in range(0, len(at), step):
                    block = doc[at[low : low + step, None] + np.arange(s)]  # in order of key
                    x, y = block[:, i].ravel(), block[:, j].ravel()
                    ok = _alike(sizes[x], sizes[y])
                    pairs.append(x[ok] * len(keys) + y[ok])
                    made += len(pairs[-1])
                    if made > 20 * PAIRS:
                        yield output(_counted(keys, sizes, pairs))
                        pairs, made = [], 0
            if pairs:
                yield output(_counted(keys, sizes, pairs))
            for at, s in zip(start[length > most].tolist(), length[length > most].tolist()):
                own = [doc[at + i : at + min(i + most, s)] for i in range(0, s, most)]
                for i, x in enumerate(own):
                    for j, y in enumerate(own[i:], i):
                        yield output({}, i == j, keys[x], sizes[x], keys[y], sizes[y])

    def output(pairs: dict, *block: object) -> pa.RecordBatch:
        n = len(pairs["n"]) if pairs else 1
        columns = [pa.array(pairs[c]) if pairs else pa.nulls(1, pa.int64()) for c in ("k1", "k2", "n")]
        columns += [pa.array([x], type=f.type) if block else pa.nulls(n, f.type) for x, f in zip(block or [None] * 5, list(schema)[3:])]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def paired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                k1, s1, k2, s2 = (batch.column(c)[r].values.to_numpy() for c in range(1, 5))
                ok = _alike(s1[:, None], s2[None, :])
                if batch.column(0)[r].as_py():
                    ok = np.triu(ok, 1)
                x, y = np.nonzero(ok)
                if len(x):
                    a, b = k1[x], k2[y]
                    yield batches_of({"k1": np.minimum(a, b), "k2": np.maximum(a, b), "n": np.ones(len(x), np.int64)}, counted)

    blocks = ["same", "b1", "s1", "b2", "s2"]
    text = f"{_COUNTED}, same boolean, b1 array<bigint>, s1 array<int>, b2 array<bigint>, s2 array<int>"
    counted, schema = arrow_schema(lists, _COUNTED), arrow_schema(lists, text)
    both = cut(map_tasks(lists.repartition(parts, "part"), run, text))
    pairs, long = both.where("k1 is not null").select("k1", "k2", "n"), both.where("same is not null").select(blocks)
    n = long.count()
    return pairs.unionByName(map_tasks(long.repartition(max(parts, n // 64)), paired, _COUNTED)) if n else pairs


def _small(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """Broadcast a side of fixed-width rows whose number was counted; beyond the bound it is left to a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def candidates(joined: DataFrame, n_texts: int, part_postings: int = PART_POSTINGS, most: int = LONG) -> DataFrame:
    """(k1, k2) of the pairs to compare."""
    parts = max(2, -(-n_texts * FEATURES // part_postings))
    counts = merged(postings(joined, parts), parts, most).groupBy("k1", "k2").agg(F.sum("n").alias("n"))
    return cut(counts.where(f"n >= {REQUIRED}").select("k1", "k2"))


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """How many values of the smaller sorted array a binary search finds in the larger."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x)) if len(x) else 0


def compared(pairs: DataFrame, joined: DataFrame, who: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(k1, k2, shared, total) of the pairs that are similar, by all runs of both whole texts."""
    wanted = pairs.select(F.explode(F.array("k1", "k2")).alias("key")).distinct()
    readers = who.groupBy("key").agg(F.min("id").alias("id")).join(wanted, "key")
    one = joined.join(_small(cut(readers)), "id").dropDuplicates(["key"]).select("key", "text")
    both = pairs.join(one.select(F.col("key").alias("k1"), F.col("text").alias("t1")), "k1").join(one.select(F.col("key").alias("k2"), F.col("text").alias("t2")), "k2")

    def work(batch: pa.RecordBatch) -> dict | None:
        n = batch.num_rows
        k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
        distinct: dict[int, str] = {}
        for k, t in (*zip(k1.tolist(), batch.column("t1").to_pylist()), *zip(k2.tolist(), batch.column("t2").to_pylist())):
            distinct[k] = t
        sets = dict(zip(distinct, (s for piece in _pieces(list(distinct.values())) for s in _sets(*shingles.code_points(piece)))))
        shared, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i, (a, b) in enumerate(zip(k1.tolist(), k2.tolist())):
            shared[i] = overlap(sets[a], sets[b])
            total[i] = len(sets[a]) + len(sets[b]) - shared[i]
        ok = shared >= similarity * total
        return {"k1": k1[ok], "k2": k2[ok], "shared": shared[ok], "total": total[ok]}

    return map_batches(both.select("k1", "k2", "t1", "t2"), work, "k1 bigint, k2 bigint, shared bigint, total bigint")


def near_copies(df: DataFrame, key: str, title: str, body: str, **sizes: int) -> tuple[DataFrame, DataFrame]:
    """Similar pairs of texts (k1, k2, shared, total), and the records of each text (id, key)."""
    joined = _joined(df, key, title, body)
    who = cut(members(joined))
    return cut(compared(candidates(joined, who.count(), **sizes), joined, who)), who


def record_pairs(pairs: DataFrame, who: DataFrame) -> DataFrame:
    """(a, b) of records, the smaller first: records of similar texts, and copies of one text."""
    left, right = who.select(F.col("id").alias("x"), F.col("key").alias("k1")), who.select(F.col("id").alias("y"), F.col("key").alias("k2"))
    across = pairs.join(left, "k1").join(right, "k2").select("x", "y")
    within = left.join(right, F.col("k1") == F.col("k2")).where("x < y").select("x", "y")
    return across.unionByName(within).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(links: DataFrame, nodes: DataFrame, rounds: int = 40) -> DataFrame:
    """(key, root): the smallest key of each key's component. Roots spread along the links and jump to their roots."""
    edges = cut(links.select(F.col("k1").alias("s"), F.col("k2").alias("t")).unionByName(links.select(F.col("k2").alias("s"), F.col("k1").alias("t"))).distinct())
    labels = cut(nodes.select("key", F.col("key").alias("root")))
    for _ in range(rounds):
        least = edges.join(labels, F.col("t") == F.col("key")).groupBy(F.col("s").alias("key")).agg(F.min("root").alias("near"))
        step = labels.join(least, "key", "left").select("key", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = step.select(F.col("key").alias("root"), F.col("root").alias("far"))
        new = cut(step.join(jump, "root", "left").select("key", "old", F.least("root", F.coalesce("far", "root")).alias("root")))
        labels = new.select("key", "root")
        if new.where("root <> old").isEmpty():
            return labels
    raise RuntimeError(f"components aren't complete after {rounds} rounds")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of articles with a similarity of at least 0.5."""
    pairs, who = near_copies(read_table(spark, root, "articles"), "article_no", "title", "body")
    return record_pairs(pairs, who).select(F.col("a").alias("article_no_a"), F.col("b").alias("article_no_b"))


def p3_groups(spark: SparkSession, root: str) -> DataFrame:
    """One row for each article with a run: its group, and its links to other texts."""
    pairs, who = near_copies(read_table(spark, root, "articles"), "article_no", "title", "body")
    degree = pairs.select(F.explode(F.array("k1", "k2")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    linked = pairs.select(F.explode(F.array("k1", "k2")).alias("key")).distinct()
    labels = components(pairs, linked)
    # a group is named by its smallest article
    grouped = who.join(labels, "key", "left").join(degree, "key", "left").select("id", "key", F.coalesce("root", "key").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    names = grouped.groupBy("root").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("group_size"))
    return grouped.join(names, "root").select(F.col("id").alias("article_no"), "group_id", "group_size", "n_links")
