"""Problem 9: filling containers of fixed capacity by the sum-of-squares rule.

Open bins are counted by the space they have left. A document goes where, with it
placed, the sum of the squared counts over all spaces becomes smallest: this
keeps bins of every remaining space at hand, so that later documents find one
they fill. Ties go to the fullest bin. The rule needs the counts alone, so a
step costs one vectorised pass over the spaces from the document's size to the capacity.

The documents of each kind are packed in blocks of about BLOCK, by a hash of their
id; a block is one task's work and the number of blocks grows with the data. Bins
that stay below FULL of their capacity are opened again, and their documents are
packed in a second round of far fewer blocks, so that each block of the first
round doesn't leave a tail of its own.

Defined cases: a document larger than the capacity is cut into full pieces, of
which each fills a container, and the rest is packed like any document; no other
is cut; documents without a token are in no container; a null or non-positive
capacity is no container.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm.arrowmap import arrow_schema, map_tasks
from loomstat.llm.token_ids import with_lengths
from loomstat.session import cut, read_table

BLOCK, SECOND, FULL = 20_000, 32, 0.98


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item, and what each bin has left. Items are between 1 and capacity."""
    counts = np.zeros(capacity + 1, np.int64)
    bins: dict[int, list[int]] = defaultdict(list)
    left: list[int] = []
    out = np.empty(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        # a bin with space g moves to g - s: the change of the sum of squares, halved and less by one
        gain = counts[: capacity + 1 - s] - counts[s:]
        gain[0] = -counts[s]  # a full bin is closed: its count doesn't rise
        usable = counts[s:] > 0
        cost = np.where(usable, 2 * gain + 2, np.iinfo(np.int64).max)
        cost[0] = -2 * counts[s] + 1 if usable[0] else cost[0]
        k = int(np.argmin(cost))  # the first of equals leaves the least space
        fresh = 2 * counts[capacity - s] + 1 if capacity > s else 0
        if usable[k] and cost[k] <= fresh:
            g = k + s
            b = bins[g].pop()
            counts[g] -= 1
        else:
            b, g = len(left), capacity
            left.append(capacity)
        left[b] = g - s
        if g > s:
            counts[g - s] += 1
            bins[g - s].append(b)
        out[i] = b
    return out, np.array(left, np.int64)


def pieces(df: DataFrame, containers: DataFrame) -> DataFrame:
    """(kind, capacity, doc_id, piece, start_token, n_tokens): documents for each kind of container, cut where they must be."""
    kinds = containers.where("capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity")).collect()  # parameters, a row for each kind
    each_kind = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in kinds]).cast("array<struct<container_kind: string, capacity: bigint>>")
    each = df.where("n_tokens > 0").select("doc_id", "n_tokens", F.inline(each_kind))
    cutting = each.withColumn("piece", F.explode(F.expr("sequence(0, cast((n_tokens - 1) div capacity as int))")))
    return cutting.select(F.col("container_kind").alias("kind"), "capacity", "doc_id", "piece", F.expr("piece * capacity").alias("start_token"), F.expr("least(n_tokens - piece * capacity, capacity)").alias("n_tokens"))


def packed(items: DataFrame, blocks: int, tag: str) -> DataFrame:
    """Items with container and space left; a container's name says round, block and number."""
    schema_text = "kind string, capacity bigint, doc_id bigint, piece int, start_token bigint, n_tokens bigint, container string, space_left bigint"
    schema = arrow_schema(items, schema_text)
    block = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int")
    ordered = items.withColumn("block", block).repartition(F.col("kind"), F.col("block")).sortWithinPartitions("kind", "block", F.xxhash64("doc_id", "piece"), "doc_id", "piece")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            capacity, kind, number = table["capacity"][0].as_py(), table["kind"][0].as_py(), table["block"][0].as_py()
            at, left = pack(table["n_tokens"].to_numpy(), capacity)
            names = pa.array([f"{kind}-{tag}{number}-{b}" for b in at.tolist()])
            columns = [table[c].combine_chunks() for c in ("kind", "capacity", "doc_id", "piece", "start_token", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, names, pa.array(left[at])], schema=schema)

        for batch in batches:
            kinds, numbers = batch.column("kind").to_pylist(), batch.column("block").to_numpy()
            keys = list(zip(kinds, numbers.tolist()))
            start = 0
            for i in range(len(keys)):
                own = keys[start]
                if keys[i] != own:
                    if held and (held[0].column("kind")[0].as_py(), held[0].column("block")[0].as_py()) != own:
                        yield from close()
                        held = []
                    held.append(batch.slice(start, i - start))
                    start = i
            if len(keys):
                own = keys[start]
                if held and (held[0].column("kind")[0].as_py(), held[0].column("block")[0].as_py()) != own:
                    yield from close()
                    held = []
                held.append(batch.slice(start))
        if held:
            yield from close()

    return map_tasks(ordered, run, schema_text)


def containers_of(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """(kind, container, doc_id, piece, start_token, n_tokens) of all documents and kinds; ``sizes`` has doc_id and n_tokens."""
    items = cut(pieces(sizes, containers))
    whole = items.where("n_tokens = capacity").withColumn("container", F.concat_ws("-", "kind", F.lit("w"), "doc_id", "piece"))
    rest = items.where("n_tokens < capacity")
    largest = items.groupBy("kind").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, round(largest / BLOCK))
    first = cut(packed(rest, blocks, "a"))
    good = first.where(f"space_left <= {1 - FULL} * capacity")
    again = packed(first.where(f"space_left > {1 - FULL} * capacity").drop("container", "space_left"), max(1, blocks // SECOND), "b")
    columns = ["kind", "container", "doc_id", "piece", "start_token", "n_tokens"]
    return whole.select(columns).unionByName(good.select(columns)).unionByName(again.select(columns))


def _containers(spark: SparkSession, root: str) -> DataFrame:
    return containers_of(with_lengths(read_table(spark, root, "documents"), "doc_id", "text"), read_table(spark, root, "containers"))


def p9_containers(spark: SparkSession, root: str) -> DataFrame:
    """Container of each piece of each document, for each kind."""
    return _containers(spark, root).withColumnRenamed("kind", "container_kind")


def p9_fill(spark: SparkSession, root: str) -> DataFrame:
    """By kind: containers, tokens and the share of space that is filled."""
    placed = _containers(spark, root)
    each = placed.groupBy("kind").agg(F.countDistinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    caps = read_table(spark, root, "containers").select(F.col("container_kind").alias("kind"), F.col("capacity_tokens").alias("capacity"))
    return each.join(F.broadcast(caps), "kind").select(F.col("kind").alias("container_kind"), "capacity", "n_containers", "n_tokens", F.expr("ceil(n_tokens / capacity)").alias("fewest"), F.expr("round(n_tokens / (n_containers * capacity), 6)").alias("filled"))
