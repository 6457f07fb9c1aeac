"""Problem 7: consensus of several annotators' labels, with their reliability.

Two annotators' agreement beyond chance is close to the product of their
reliabilities, so the matrix of these agreements has rank one but for noise,
and its leading eigenvector holds the reliabilities. Pairs of annotators share
different numbers of items: each entry is weighted by its overlap and shrunk
where it is small, and an annotator's own entry, which isn't observed, is left
out of sum and norm alike. The eigenvector is found by power iteration, each
step a join of the sparse matrix with the vector and a sum by annotator, until
no entry moves by more than TOLERANCE.

There are two such matrices: agreement on the label, whose eigenvector says how
often an annotator gives the true label, and agreement within a step of the scale,
whose eigenvector says how often they come within a step of it. What lies between the two
are near misses, the rest far ones.

The consensus weights each vote by its log-likelihood under these two
reliabilities: an annotator gives the true label, a neighbour of it or else one
from their own habit, so that one who always gives the same label adds little.

Labels: ``NA`` (also n/a, in any case) or a multiple of 10 from 0 to 100,
also as 70.0, 070 or 70/100, with outer white space; anything else is none.

Defined cases: rows of the same item and round count once; null and blank rater
ids vote as rater ''; items without a readable label have no row; a rater who shares
no item with another has the reliability ALONE; ties go to the label that is more
frequent overall, then to the one that sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstat.llm.binding import let
from loomstat.session import cut, read_table

#: Change of an entry under which the power iteration ends, steps between two looks at it, and looks after which it is an error.
TOLERANCE, STEPS, LOOKS = 1e-4, 3, 60
#: Overlap at which an agreement counts by half.
SHRINK = 5.0
#: Reliability without anything to compare with.
ALONE = 0.3


def label_of(c: Column) -> Column:
    def read(s: Column) -> Column:
        number = F.regexp_extract(s, r"^0*(\d{1,3})(?:\.0*)?(?:\s*/\s*100)?$", 1)
        # to ten from the digits themselves: 0, 10 .. 90, 100
        return F.when(s.rlike("^n/?a$"), F.lit("NA")).when(number.rlike("^(0|[1-9]0|100)$"), number)

    return let(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), read)


def votes_of(df: DataFrame, question: str = "q1") -> DataFrame:
    """(item, rater, label, n): how often a rater gave an item a label."""
    pair = [F.struct(F.coalesce(F.col(f"{who}_id"), F.lit("")).alias("rater"), label_of(F.col(f"{who}_{question}_parsed")).alias("label")) for who in ("coder1", "coder2", "llm")]
    rows = df.select(F.col("sample_id").alias("item"), "coding_round", F.posexplode(F.array(*pair)).alias("seat", "v")).select("item", "coding_round", "seat", "v.rater", "v.label")
    return rows.where("label is not null").distinct().groupBy("item", "rater", "label").agg(F.count(F.lit(1)).alias("n"))


#: Distance of two labels on the scale; null if one of them is NA, 0 if both are.
_APART = "case when {0} = {1} then 0 else abs(cast(nullif({0}, 'NA') as int) - cast(nullif({1}, 'NA') as int)) end"


def agreement(votes: DataFrame) -> DataFrame:
    """(r, s, w, m0, m10): agreement of two raters beyond chance, on the label and within a step, and its weight; both ways round."""
    a, b = votes.select("item", F.col("rater").alias("r"), F.col("label").alias("x"), F.col("n").alias("i")), votes.select("item", F.col("rater").alias("s"), F.col("label").alias("y"), F.col("n").alias("j"))
    apart = F.expr(_APART.format("x", "y")).alias("apart")
    seen = a.join(b, "item").where("r <> s").select("r", "s", F.expr("i * j").alias("k"), apart).groupBy("r", "s").agg(F.sum("k").alias("both"), *[F.sum(F.when(F.col("apart") <= d, F.col("k")).otherwise(0)).alias(f"same{d}") for d in (0, 10)])
    habit = habits(votes)
    # each label beside itself and its neighbours, so that the join is one of equals
    beside = F.expr("filter(array(named_struct('x', y, 'apart', 0), named_struct('x', cast(try_cast(y as int) - 10 as string), 'apart', 10), named_struct('x', cast(try_cast(y as int) + 10 as string), 'apart', 10)), v -> v.x is not null)")
    other = habit.select(F.col("rater").alias("s"), F.col("label").alias("y"), F.col("share").alias("q")).select("s", "q", F.inline(beside))
    by_chance = habit.select(F.col("rater").alias("r"), F.col("label").alias("x"), F.col("share").alias("p")).join(other, "x")
    chance = by_chance.select("r", "s", F.expr("p * q").alias("pq"), "apart").groupBy("r", "s").agg(*[F.least(F.sum(F.when(F.col("apart") <= d, F.col("pq")).otherwise(0)), F.lit(0.95)).alias(f"chance{d}") for d in (0, 10)])
    beyond = [F.expr(f"(same{d} / both - chance{d}) / (1 - chance{d})").alias(f"m{d}") for d in (0, 10)]
    return seen.join(chance, ["r", "s"]).select("r", "s", F.expr(f"both * both / (both + {SHRINK})").alias("w"), *beyond)


def habits(votes: DataFrame) -> DataFrame:
    """(rater, label, share) of each rater's votes."""
    n = votes.groupBy("rater", "label").agg(F.sum("n").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("rater"))).drop("n")


def reliabilities(votes: DataFrame) -> DataFrame:
    """(rater, exact, near): how often each rater gives the label, and comes within a step of it; between 0 and 1."""
    matrix = cut(agreement(votes))
    v = votes.select("rater").distinct().withColumns({"exact": F.lit(0.6), "near": F.lit(0.8)})
    fit = lambda m, a: F.sum(F.expr(f"w * {m} * {a}")) / F.sum(F.expr(f"w * {a} * {a}"))
    for look in range(LOOKS):
        for k in range(STEPS):
            near = matrix.join(v.select(F.col("rater").alias("s"), F.col("exact").alias("a"), F.col("near").alias("b")), "s").groupBy(F.col("r").alias("rater")).agg(fit("m0", "a").alias("new0"), fit("m10", "b").alias("new10"))
            # part of the old vector damps the oscillation between raters that were good and those they met
            old = 0.3 if look or k else 0.0
            step = lambda was, new: f"least(0.98, greatest(0.01, {old} * {was} + {1 - old} * coalesce({new}, {ALONE})))"
            v = v.join(near, "rater", "left").select("rater", F.expr(step("exact", "new0")).alias("exact"), F.expr(step("near", "new10")).alias("near"), F.col("exact").alias("was0"), F.col("near").alias("was10"))
        v = cut(v)
        moved = v.agg(F.max(F.greatest(F.abs(F.col("exact") - F.col("was0")), F.abs(F.col("near") - F.col("was10"))))).first()[0]
        if (moved or 0.0) <= TOLERANCE:
            return v.select("rater", "exact", F.greatest("near", "exact").alias("near"))
    raise ArithmeticError(f"the power iteration still moves by {moved} after {LOOKS * STEPS} steps")


def _scored(votes: DataFrame, rated: DataFrame, log_like: str) -> DataFrame:
    """The best label of each item; ``rated`` has the columns of ``log_like`` by rater and label."""
    labels = votes.select("item", F.col("label").alias("c")).distinct()
    overall = votes.groupBy(F.col("label").alias("c")).agg(F.sum("n").alias("k"))
    prior = overall.withColumn("prior", F.log(F.col("k") / F.sum("k").over(Window.partitionBy())))
    scored = votes.join(rated, ["rater", "label"]).join(labels, "item").groupBy("item", "c").agg(F.sum(F.expr(f"n * ({log_like})")).alias("score"))
    scored = scored.join(F.broadcast(prior), "c")  # a row for each label of the scale
    best = scored.groupBy("item").agg(F.max(F.struct(F.expr("round(score + prior, 9)").alias("s"), "k", F.expr("case when c = 'NA' then -1000 else -cast(c as int) end").alias("o"), "c")).alias("b"))
    return best.select("item", F.col("b.c").alias("label"), F.col("b.s").alias("score"))


def consensus(votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, label, score) and (rater, reliability, near, n_votes)."""
    spectral = cut(reliabilities(votes))
    # a far miss follows the rater's habit, smoothed towards every label of the scale alike
    rated = habits(votes).join(spectral, "rater").select("rater", "label", F.col("exact").alias("reliability"), F.expr("greatest(0.01, near - exact) / 2").alias("beside"), F.expr("greatest(0.002, 1 - greatest(near, exact + 0.01)) * (0.9 * share + 0.1 / 12)").alias("far"))
    apart = _APART.format("label", "c")
    final = _scored(votes, rated, f"case {apart} when 0 then ln(reliability + far) when 10 then ln(beside + far) else ln(far) end")
    n = votes.groupBy("rater").agg(F.sum("n").alias("n_votes"))
    return final, spectral.join(n, "rater").select("rater", F.col("exact").alias("reliability"), "near", "n_votes")


def _votes(spark: SparkSession, root: str) -> DataFrame:
    return cut(votes_of(read_table(spark, root, "test6_manual_results")))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """The consensus label of each item with a readable label."""
    return consensus(_votes(spark, root))[0].select(F.col("item").alias("sample_id"), F.col("label").alias("q1_label"))


def p7_items(spark: SparkSession, root: str) -> DataFrame:
    """Consensus with the votes, the share that agrees with it, and the share of agreeing pairs of votes."""
    votes = _votes(spark, root)
    final, _ = consensus(votes)
    per = votes.groupBy("item", "label").agg(F.sum("n").alias("n"))
    pairs = per.groupBy("item").agg(F.sum("n").alias("n_votes"), F.sum(F.expr("n * (n - 1)")).alias("same"))
    return final.join(per.withColumnRenamed("n", "n_for"), ["item", "label"]).join(pairs, "item").select(F.col("item").alias("sample_id"), F.col("label").alias("q1_label"), "n_votes", F.expr("round(n_for / n_votes, 6)").alias("share_for"), F.expr("case when n_votes > 1 then round(same / (n_votes * (n_votes - 1)), 6) end").alias("pair_agreement"))


def p7_raters(spark: SparkSession, root: str) -> DataFrame:
    """Each rater's reliability, and how often they come within a step of the label."""
    return consensus(_votes(spark, root))[1].select("rater", "n_votes", F.round("reliability", 6).alias("reliability"), F.round("near", 6).alias("near"))
