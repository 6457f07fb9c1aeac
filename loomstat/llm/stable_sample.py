"""Problem 5: a reproducible sample that keeps its members as data grow.

An identifier ends in 64 hexadecimal digits: a number of the fixed domain
0 .. 2^256 - 1. A Feistel network of four rounds permutes the domain; a record
is in the sample if its permuted number lies under rate x 2^256. A permutation
has no collisions, and whether a record is in depends on its identifier and the
seed alone: not on other records, partitions, runs or batches. A larger rate
keeps all members of a smaller one.

The halves are four 32-bit words; a round's function is SHA-256 of the half.
All of it is built-in expressions, one fold over the rounds for each row, which
a generator keeps from being copied into the filter that follows.

Defined cases: writings of one id that differ in case or outer white space are
one record; null and blank ids are none; an id of another form has the number
SHA-256 gives it; records without a load batch count as arrived before all others.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstat.session import read_table

RATE, SEED, ROUNDS = 0.1, 20240901, 4

#: Bits of the permuted number that are compared with the threshold.
_BITS = 53


def canonical(identifier: Column) -> Column:
    return F.lower(F.regexp_replace(identifier, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))


def digits(identifier: Column) -> Column:
    """The 64 hexadecimal digits of a canonical identifier."""
    return F.when(identifier.rlike("^[a-z]+_v[0-9]+_[0-9a-f]{64}$"), F.right(identifier, F.lit(64))).otherwise(F.sha2(identifier, 256))


def permute(words: list[int], seed: int = SEED, rounds: int = ROUNDS) -> list[int]:
    """The plain definition, on eight words."""
    left, right = words[:4], words[4:]
    for r in range(rounds):
        h = hashlib.sha256(f"{seed}:{r}:{','.join(map(str, right))}".encode()).hexdigest()
        left, right = right, [a ^ int(h[8 * i : 8 * i + 8], 16) for i, a in enumerate(left)]
    return left + right


def unpermute(words: list[int], seed: int = SEED, rounds: int = ROUNDS) -> list[int]:
    """The inverse of permute; that it exists is why there are no collisions."""
    left, right = words[:4], words[4:]
    for r in reversed(range(rounds)):
        h = hashlib.sha256(f"{seed}:{r}:{','.join(map(str, left))}".encode()).hexdigest()
        left, right = [a ^ int(h[8 * i : 8 * i + 8], 16) for i, a in enumerate(right)], left
    return left + right


def with_permuted(df: DataFrame, identifier: str, seed: int = SEED, rounds: int = ROUNDS) -> DataFrame:
    """``df`` with the canonical id as record_id and the first 53 bits of its permuted number as permuted."""
    out = df.drop("permuted", "_d").withColumn("record_id", canonical(F.col(identifier))).where("record_id <> ''").withColumn("_d", digits(F.col("record_id")))
    word = "cast(conv(substring({0}, cast(8 * i + 1 as int), 8), 16, 10) as bigint)"
    words = "transform(sequence({1}, {2}), i -> " + word + ")"
    # one fold over the rounds: written as columns on columns, the optimizer would inline each round into the next
    fold = f"""aggregate(sequence(0, {rounds - 1}), named_struct('l', {words.format('_d', 0, 3)}, 'r', {words.format('_d', 4, 7)}),
        (acc, k) -> transform(array(sha2(concat('{seed}:', cast(k as string), ':', concat_ws(',', cast(acc.r as array<string>))), 256)),
            h -> named_struct('l', acc.r, 'r', transform(sequence(0, 3), i -> acc.l[i] ^ {word.format('h')})))[0],
        acc -> shiftleft(acc.l[0], 21) | shiftright(acc.l[1], 11))"""
    return out.select("*", F.explode(F.array(F.expr(fold))).alias("permuted")).drop("_d")


def sample(df: DataFrame, identifier: str, batch: str, rate: float = RATE, as_of: int | None = None, seed: int = SEED) -> DataFrame:
    """(record_id, first_batch, permuted) of the sample as of a batch; one row for each record."""
    if as_of is not None:
        df = df.where(F.coalesce(F.col(batch), F.lit(0)) <= as_of)
    # the choice comes before the shuffle: a tenth of the rows is grouped
    chosen = with_permuted(df.select(identifier, batch), identifier, seed).where(F.col("permuted") < int(rate * (1 << _BITS)))
    return chosen.groupBy("record_id").agg(F.min(batch).alias("first_batch"), F.first("permuted").alias("permuted"))


def p5_sentence_ids(spark: SparkSession, root: str) -> DataFrame:
    """A tenth of the sentence ids."""
    return sample(read_table(spark, root, "sentence_id_crosswalk"), "stable_sentence_id", "load_batch").select(F.col("record_id").alias("stable_sentence_id"), "first_batch", "permuted")


def p5_article_ids(spark: SparkSession, root: str) -> DataFrame:
    """A tenth of the article ids."""
    return sample(read_table(spark, root, "article_level_scores"), "stable_article_id", "load_batch").select(F.col("record_id").alias("stable_article_id"), "first_batch", "permuted")


def p5_article_ids_by_batch(spark: SparkSession, root: str) -> DataFrame:
    """How many records and members there are as of each load batch."""
    rows = with_permuted(read_table(spark, root, "article_level_scores").select("stable_article_id", "load_batch"), "stable_article_id")
    records = rows.groupBy("record_id").agg(F.min("load_batch").alias("first_batch"), F.max((F.col("permuted") < int(RATE * (1 << _BITS))).cast("int")).alias("is_in"))
    batches = records.groupBy(F.coalesce("first_batch", F.lit(-1)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("is_in").alias("m"))
    upto = Window.orderBy("b")  # a row for each load batch
    return batches.select(F.nullif("b", F.lit(-1)).alias("as_of_batch"), F.sum("n").over(upto).alias("n_records"), F.sum("m").over(upto).alias("n_members")).where("as_of_batch is not null")


def _permuted_sql(table: str, column: str) -> str:
    def word(c: str, i: int) -> str:
        return f"CAST('0x' || substr({c}, {8 * i + 1}, 8) AS BIGINT)"

    sql = f"WITH ids AS (SELECT lower(regexp_replace({column}, '^[\\s\\x{{a0}}\\x{{3000}}]+|[\\s\\x{{a0}}\\x{{3000}}]+$', '', 'g')) AS id, min(load_batch) AS first_batch FROM {table} WHERE {column} IS NOT NULL GROUP BY 1),\n"
    sql += "dig AS (SELECT id, first_batch, CASE WHEN regexp_full_match(id, '[a-z]+_v[0-9]+_[0-9a-f]{64}') THEN right(id, 64) ELSE sha256(id) END AS d FROM ids WHERE id <> ''),\n"
    sql += f"s0 AS (SELECT id, first_batch, {', '.join(f'{word('d', i)} AS w{i}' for i in range(8))} FROM dig)"
    for r in range(ROUNDS):
        h = f"sha256('{SEED}:{r}:' || w4 || ',' || w5 || ',' || w6 || ',' || w7)"
        sql += f",\nh{r} AS (SELECT *, {h} AS h FROM s{r}),\ns{r + 1} AS (SELECT id, first_batch, {', '.join(f'w{i + 4} AS w{i}' for i in range(4))}, {', '.join(f'xor(w{i}, {word('h', i)}) AS w{i + 4}' for i in range(4))} FROM h{r})"
    return sql + f",\np AS (SELECT id, first_batch, w0 * 2097152 + (w1 >> 11) AS permuted FROM s{ROUNDS})\n"


def _oracle(table: str, column: str) -> str:
    return _permuted_sql(table, column) + f"SELECT id AS {column}, first_batch, permuted FROM p WHERE permuted < {int(RATE * (1 << _BITS))}"


ORACLE = {"p5_sentence_ids": _oracle("sentence_id_crosswalk", "stable_sentence_id"), "p5_article_ids": _oracle("article_level_scores", "stable_article_id")}
ORACLE["p5_article_ids_by_batch"] = _permuted_sql("article_level_scores", "stable_article_id") + f"SELECT as_of_batch, count(*) AS n_records, count(*) FILTER (permuted < {int(RATE * (1 << _BITS))}) AS n_members FROM p JOIN (SELECT DISTINCT first_batch AS as_of_batch FROM p WHERE first_batch IS NOT NULL) ON coalesce(first_batch, -1) <= as_of_batch GROUP BY 1"
