"""Orders, queues and top-k. A full rank never sorts one edition in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions import articles as A
from tidewire.functions import dates as D
from tidewire.workspace import Rounds, save_once


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows per group. Spark limits each group before the shuffle."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def global_rank(df: DataFrame, by: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """row_number() per group for groups of any size.

    Rows are range-partitioned by (group, order); the partition layout is written once so that a
    retry sees the same one. A rank is the local number plus the rows of the same group in earlier
    partitions, which is a prefix sum over (partitions x groups) counts.
    """
    spark = df.sparkSession
    keyed = df.repartitionByRange(*[F.col(b) for b in by], *order)
    keyed = keyed.sortWithinPartitions(*[F.col(b) for b in by], *order)
    keyed = keyed.withColumn("_part", F.spark_partition_id())
    saved = Rounds(spark, "rank").save(keyed)
    local = W.partitionBy("_part", *by).orderBy(*order)
    counts = saved.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = saved.withColumn("_local", F.row_number().over(local)).join(offsets, ["_part", *by])
    return ranked.withColumn(out, (F.col("_local") + F.col("_before")).cast("long")).drop(
        "_part", "_local", "_before"
    )


def priority_order() -> list[Column]:
    return [F.col("priority").desc(), F.col("pos")]


def base_order_v1() -> list[Column]:
    topic = A.ai_topic(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("description", F.lit(""))))
    return [
        F.col("priority").desc(),
        topic.desc(),
        A.trend_rank().asc(),
        A.trend_heat().desc(),
        F.col("pos").asc(),
    ]


def base_order_v2(analysis: str = "analysis") -> list[Column]:
    return [
        F.col(analysis)["relevance"].desc(),
        F.col("priority").desc(),
        A.trend_rank().asc(),
        A.trend_heat().desc(),
        F.col("pos").asc(),
    ]


def published_epoch() -> Column:
    return F.coalesce(F.unix_micros(D.parse_published("publish_time")), F.lit(0))


def candidate_order(analysis: str = "analysis") -> list[Column]:
    return [
        F.col(analysis)["relevance"].desc(),
        F.col("priority").desc(),
        published_epoch().desc(),
        A.trend_rank().asc(),
        F.col("pos").asc(),
    ]


def lead_order(analysis: str = "analysis") -> list[Column]:
    return [
        F.col(analysis)["relevance"].desc(),
        F.col("priority").desc(),
        A.trend_rank().asc(),
        F.col("pos").asc(),
    ]


def candidate_queue(df: DataFrame, analysis: str = "analysis", cap: int | None = None) -> DataFrame:
    """Round-robin over primary entities; entities in order of their best row.

    With a cap only the first `cap` queue rows per edition are returned, and no group is ever
    sorted beyond that depth. Only keys travel through the sorts; rows are joined at the end.
    """
    key = F.struct(
        (-F.col(analysis)["relevance"]).alias("a"),
        (-F.col("priority")).alias("b"),
        (-published_epoch()).alias("c"),
        A.trend_rank().alias("d"),
        F.col("pos").alias("e"),
    )
    primary = F.col(analysis)["primary_entity"]
    bucket = F.when(primary != "", primary).otherwise(F.concat(F.lit("\0"), F.col("pos")))
    keys = save_once(df.select("edition", "pos", key.alias("_key"), bucket.alias("_bucket")), "queue-keys")
    if cap is None:
        turns = global_rank(keys, ["edition", "_bucket"], [F.col("_key").asc()], "turn")
    else:
        turns = top_k(keys, ["edition", "_bucket"], [F.col("_key").asc()], cap, "turn")
    first = turns.filter("turn = 1").select("edition", "_bucket", F.col("_key").alias("_first"))
    turns = turns.join(first, ["edition", "_bucket"])
    order = [F.col("turn").asc(), F.col("_first").asc()]
    if cap is None:
        queue = global_rank(turns, ["edition"], order, "queue_pos")
    else:
        queue = top_k(turns, ["edition"], order, cap, "queue_pos")
    queue = queue.select("edition", "pos", F.col("queue_pos").cast("long").alias("queue_pos"))
    if cap is not None:
        # written, so that its size is known before rows with their texts would be dealt to meet a few keys
        queue = save_once(queue, "queue-places")
    return df.join(queue, ["edition", "pos"])


def admission_split(df: DataFrame, analysis: str = "analysis", cap: int = 30) -> tuple[DataFrame, DataFrame]:
    """(admitted queue rows, rows dropped by the daily cap)."""
    cap = max(0, cap)
    admitted = candidate_queue(df, analysis, cap) if cap else candidate_queue(df, analysis, 1).limit(0)
    dropped = df.join(admitted.select("edition", "pos"), ["edition", "pos"], "left_anti")
    return admitted, dropped.withColumn("reason", F.lit("candidate_daily_budget_cap"))


def first_per_source(ranked: DataFrame, order: list[Column], limit: int = 10, share: float = 0.6) -> DataFrame:
    """Best row of each source group plus the per-source cap of the edition."""
    groups = top_k(ranked, ["edition", "source_group"], order, 1, "_r").drop("_r")
    sizes = ranked.groupBy("edition").agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("source_group").alias("_g")
    )
    target = F.least(F.lit(limit), F.col("_n"))
    cap = F.when(F.col("_g") >= 2, F.greatest(F.lit(1), F.floor(target * share))).otherwise(target)
    return groups.join(
        sizes.select("edition", target.cast("int").alias("target"), cap.cast("int").alias("source_cap")),
        "edition",
    )


def rank_channel(items: DataFrame, k: int) -> DataFrame:
    order = [F.col("hot").desc_nulls_last(), F.col("rank").asc()]
    return top_k(items, ["edition", "channel"], order, k, "channel_pos")


def call_plan(
    queue: DataFrame, outcomes: DataFrame, rounds: int = 2, budget: int = 30
) -> DataFrame:
    """Breadth-first (round, candidate) calls up to the budget and the first terminal outcome.

    `queue` is the admitted queue, so an edition has at most (rows admitted by its cap) x rounds calls.
    """
    rounds = max(1, rounds)
    calls = queue.select("edition", "pos", "queue_pos").withColumn(
        "round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))
    )
    calls = calls.join(outcomes.select("edition", "pos", "round", "outcome"), ["edition", "pos", "round"], "left")
    calls = calls.withColumn("outcome", F.coalesce("outcome", F.lit("success")))
    w = W.partitionBy("edition").orderBy("round", "queue_pos")
    terminal = F.col("outcome").isin(*A.TERMINAL_OUTCOMES).cast("int")
    earlier = F.coalesce(
        F.max(terminal).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    return (
        calls.withColumn("call_no", F.row_number().over(w).cast("long"))
        .withColumn("_stop", earlier)
        .filter((F.col("call_no") <= budget) & (F.col("_stop") == 0))
        .drop("_stop")
    )


def verify_budget_split(candidates: DataFrame, settings, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """First N candidates are verified, the rest is preserved."""
    available = max(0, settings.max_total_calls)
    stages = 3 if settings.official_fallback else 2
    reserved = 0
    if settings.max_refill_rounds > 0 and settings.min_articles > 1:
        room = max(0, available - 1) if settings.max_verify_calls > 0 else available
        reserved = min(settings.max_refill_rounds * stages, room)
    budget = max(0, min(settings.max_verify_calls, max(0, available - reserved)))
    verify = top_k(candidates, ["edition"], order, budget, "verify_no")
    rest = candidates.join(verify.select("edition", "pos"), ["edition", "pos"], "left_anti")
    return verify, rest


def within_result_duplicates(results: DataFrame, title: str, run: list[str], rank: str = "rank") -> DataFrame:
    """Flag titles that an earlier result of the same run already showed."""
    first = results.groupBy(*run, title).agg(F.min(rank).alias("_first"))
    joined = results.alias("r").join(
        first.alias("f"),
        reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in [*run, title]]),
    )
    return joined.select("r.*", (F.col(f"r.{rank}") > F.col("_first")).alias("duplicate_within_results"))


def rank_contiguity(trends: DataFrame) -> DataFrame:
    """Editions whose ranks are not exactly 1..n."""
    stats = trends.groupBy("edition").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("rank").alias("distinct_ranks"),
        F.min("rank").alias("lowest"),
        F.max("rank").alias("highest"),
    )
    bad = (F.col("lowest") != 1) | (F.col("highest") != F.col("n")) | (F.col("distinct_ranks") != F.col("n"))
    return stats.filter(bad)


def sample_per_edition(df: DataFrame, value: str, order: list[Column], k: int, out: str = "sample") -> DataFrame:
    """First k non-empty values per edition as an ordered array."""
    rows = top_k(df.filter(F.coalesce(F.col(value), F.lit("")) != ""), ["edition"], order, k, "_r")
    return rows.groupBy("edition").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_r", F.col(value).alias("v")))), lambda x: x["v"]
        ).alias(out)
    )


def latest_runs(runs: DataFrame, key: str, order: str) -> DataFrame:
    """Newest manifest per key."""
    fields = [F.col(c) for c in runs.columns if c != key]
    best = runs.groupBy(key).agg(F.max_by(F.struct(*fields), F.col(order)).alias("_b"))
    return best.select(key, "_b.*")


def select_editions(editions: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requested editions that exist, requested editions that do not)."""
    have = editions.select("edition").distinct()
    return wanted.join(have, "edition", "left_semi"), wanted.join(have, "edition", "left_anti")


def domain_ranking(summary: DataFrame) -> DataFrame:
    keys = [
        F.coalesce(F.col(c), F.lit(-1.0)).desc()
        for c in ("avg_unique_valid_count", "avg_published_date_availability")
    ]
    return summary.orderBy(*keys, F.col("domain"))
