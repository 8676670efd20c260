"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

1. Targets: sources share the words of all documents by weight; a target stops at `repeats` times its source's size and the
   excess is reshared by weight (water filling, in closed form over the sources in the order of cap / weight).
2. Blocks of BLOCK words are allocated to the sources by the highest quotients target / (2k + 1), and each source's
   blocks to its shards likewise by the shards' sizes. Rounding at the mean divisor leaves at most half a block per
   party to move, so only the quotients next to that rounding are ranked, never one row per block.
3. A shard's documents, in seeded order, are a stream of words; its quota of blocks is that many whole passes over the
   stream plus the blocks at its front. A shard holds about SHARD_WORDS words, so no source is ever one task.

Nulls: a null text has size 0; a null source is a source of its own, after all others. Repeated rows and equal ids each
count; the order of equal rows does not change what is taken in sum. Ties of quotients go to the smaller source, then shard.
Sources of size 0 have target 0. An empty table gives no rows. Further columns of the input are ignored by `mixed` and
kept by `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK = 8
SHARD_WORDS = 1_000_000
SHARD_ROWS = 2_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _seeded(key: Column, salt: str) -> Column:
    """A pseudo-random number below 2^32 that depends on the key and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:{salt}:"), F.coalesce(key, F.lit("-")))), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """sizes(source, source_size, ...) with weight and target; one row per source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", repeats * F.col("source_size"))
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # capped are the first sources in the order of cap / weight, up to the first whose fair share of the rest fits
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    rest = F.col("_total") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left = F.col("_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumns(
        {"_total": F.sum("source_size").over(everything), "_weights": F.sum("weight").over(everything)}
    ).withColumn("_level", rest / left)
    open_ = F.col("cap") > F.col("_level") * F.col("weight")
    rows = rows.withColumn("_place", F.row_number().over(fill))
    level = F.min(F.when(open_, F.struct("_place", "_level")))
    rows = rows.withColumn("_fit", level.over(everything)["_level"])
    target = F.when(F.col("_fit").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), F.col("_fit") * F.col("weight"))
    )
    return rows.withColumn("target", target).drop("_total", "_weights", "_level", "_place", "_fit", "cap")


def apportion(parties: DataFrame, group: list[str], key: list[Column], votes: Column, seats: Column, out: str) -> DataFrame:
    """Sainte-Lague: `seats` (equal within a group) to the group's parties by highest quotients votes / (2k + 1)."""
    own = W.partitionBy(*group)
    rows = parties.withColumns({"_v": votes.cast("double"), "_n": seats.cast("long")})
    rows = rows.withColumn("_all", F.sum("_v").over(own)).withColumn("_count", F.count(F.lit(1)).over(own))
    ideal = F.when(F.col("_all") > 0, F.col("_v") * F.col("_n") / F.col("_all")).otherwise(0.0)
    # the final divisor moves no party further than by its share of the parties' halves
    spare = F.ceil(F.when(F.col("_all") > 0, F.col("_v") / F.col("_all") * F.col("_count")).otherwise(0.0)).cast("long") + 1
    rows = rows.withColumn("_low", F.greatest(F.lit(0).cast("long"), F.floor(ideal + 0.5) - spare)).withColumn("_spare", spare)
    rows = rows.withColumn("_open", F.col("_n") - F.sum("_low").over(own))
    steps = rows.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), 2 * F.col("_spare"))))
    quotient = F.col("_v") / (2 * (F.col("_low") + F.col("_k")) + 1)
    best = W.partitionBy(*group).orderBy(quotient.desc(), *key, F.col("_k"))
    steps = steps.withColumn("_rank", F.row_number().over(best))
    won = F.count(F.when((F.col("_rank") <= F.col("_open")) & (F.col("_v") > 0), 1))
    keep = [F.col(c) for c in parties.columns]
    counted = steps.groupBy(*keep, "_low").agg(won.alias("_won"))
    return counted.select(*keep, (F.col("_low") + F.col("_won")).alias(out))


def _plan(sized: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """One row per (source, shard): source_size, target, shard words, quota of words."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    found = targets(sizes, weights, repeats)
    # targets add up to all words; the integer sum does not depend on the order of rows
    total = F.sum("source_size").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    found = found.withColumn("_blocks", F.round(total / BLOCK).cast("long"))
    found = found.withColumn("_g", F.lit(0))
    seats = apportion(
        found, ["_g"], [F.col("source").asc_nulls_last()], F.col("target"), F.col("_blocks"), "blocks"
    )
    shards = F.ceil(F.greatest(F.col("source_size") / SHARD_WORDS, F.col("_rows") / SHARD_ROWS)).cast("long")
    return seats.select("source", "source_size", "target", "blocks", F.greatest(shards, F.lit(1).cast("long")).alias("shards"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, text: str = "text") -> DataFrame:
    """Per row of docs(doc_id, text, source): doc_id, size, source, source_size, target, taken."""
    sized = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col(text).cast("string")).alias("size")
    )
    plan = _plan(sized, weights, repeats)
    # sources are few against documents, but may be many: a join that needs no broadcast
    plan = plan.withColumnRenamed("source", "_named")
    placed = sized.join(plan, F.col("source").eqNullSafe(F.col("_named"))).drop("_named")
    placed = placed.withColumn("shard", F.pmod(_seeded(F.col("doc_id").cast("string"), "shard"), F.col("shards")))
    sums = placed.groupBy("source", "source_size", "target", "blocks", "shard").agg(F.sum("size").alias("shard_size"))
    quotas = apportion(sums, ["source"], [F.col("shard")], F.col("shard_size"), F.col("blocks"), "quota")
    quotas = quotas.select(
        F.col("source").alias("_source"),
        F.col("shard").alias("_shard"),
        "shard_size",
        F.least(F.col("quota") * BLOCK, repeats * F.col("shard_size")).alias("quota"),
    )
    joined = placed.join(quotas, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    order = [_seeded(F.col("doc_id").cast("string"), "order"), F.col("doc_id"), F.col("size")]
    stream = W.partitionBy("source", "shard").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = F.sum("size").over(stream) - F.col("size")
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(0)
    rest = F.col("quota") - passes * F.col("shard_size")
    front = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    taken = (passes * F.col("size") + front).cast("long")
    return joined.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """docs with each row as often as the mix takes it: taken / size times, a part counted as a whole from one half on."""
    mix = mixed(docs, weights, repeats)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    # equal rows share one shard and may be taken unequally: number them on both sides
    nth = W.partitionBy("_id", "_source").orderBy("_size")
    # the input's columns travel as one, so that no name of theirs meets those of the plan
    left = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col("doc_id").alias("_id"),
        F.col("source").cast("string").alias("_source"),
        word_count(F.col("text").cast("string")).alias("_size"),
    ).withColumn("_nth", F.row_number().over(nth))
    right = mix.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), copies.alias("_copies"))
    right = right.withColumn("_nth", F.row_number().over(W.partitionBy("_id", "_source").orderBy("_size", "_copies")))
    right = right.select(*[F.col(c).alias(f"{c}2") for c in right.columns])
    same = F.col("_id").eqNullSafe(F.col("_id2")) & F.col("_source").eqNullSafe(F.col("_source2")) & (F.col("_nth") == F.col("_nth2"))
    repeated = left.join(right.filter("_copies2 > 0"), same)
    return repeated.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies2"))).select("_row.*")
