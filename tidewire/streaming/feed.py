"""The batch rules on a continuous article feed (Structured Streaming)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType

from tidewire.functions.text import safe_code, text
from tidewire.functions.urls import canonical_story_url

LEDGER = "day date, batch long, phase string"
INDEX = "day date, latest timestamp, n long, batch long"


def stream_freshness_gate(
    stream: DataFrame,
    reference: Column | None = None,
    max_age_hours: int = 30,
    future_tolerance_minutes: int = 5,
    ts: str = "published_at",
) -> tuple[DataFrame, DataFrame]:
    """(fresh rows, rejected rows with reason). The reference is the batch's current time by default.

    The watermark of the fresh rows lags by the age allowed and the tolerance, so as long as references do not go back from
    batch to batch, no later operator drops a fresh row: every row is either counted on or among the rejected.
    """
    ref = reference if reference is not None else F.current_timestamp()
    at = F.col(ts)
    reason = (
        F.when(at.isNull(), "invalid_published_at")
        .when(at > ref + F.make_dt_interval(mins=F.lit(future_tolerance_minutes)), "future_published_at")
        .when(at < ref - F.make_dt_interval(hours=F.lit(max_age_hours)), "stale_published_at")
    )
    marked = stream.withColumn("reason", reason)
    fresh = marked.filter("reason is null").drop("reason").withWatermark(ts, f"{max_age_hours * 60 + future_tolerance_minutes} minutes")
    return fresh, marked.filter("reason is not null")


def stream_recent_dedupe(stream: DataFrame, days: int = 3, ts: str = "published_at") -> DataFrame:
    """First row per story URL within the window; state older than the watermark is dropped.

    Rows without a usable URL are never duplicates of each other and get a key of their own.
    """
    url = canonical_story_url("link")
    own = F.concat(F.lit("\0"), F.xxhash64(F.to_json(F.struct(*stream.columns))).cast("string"), F.lit("\0"), text("title"))
    keyed = stream.withColumn("url_key", F.when(url != "", url).otherwise(own))
    return keyed.withWatermark(ts, f"{days} days").dropDuplicatesWithinWatermark(["url_key"])


def _failed(stream: DataFrame) -> DataFrame:
    return stream.filter("coalesce(outcome, '') not in ('', 'success')")


def _daily(failed: DataFrame, ts: str) -> DataFrame:
    return failed.groupBy(
        F.window(ts, "1 day").alias("day"),
        safe_code("stage", "unknown_stage").alias("stage"),
        safe_code("outcome").alias("code"),
    ).agg(F.count(F.lit(1)).alias("n"))


def stream_daily_diagnostics(stream: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Failures per (day, stage, code) over (ts, stage, outcome)."""
    return _daily(_failed(stream).withWatermark(ts, late), ts)


def stream_daily_failures(
    stream: DataFrame,
    reference: Column | None = None,
    late_hours: int = 24,
    future_tolerance_minutes: int = 5,
    ts: str = "ts",
) -> tuple[DataFrame, DataFrame]:
    """(failures per day, stage and code for append mode, failures rejected as too late, too early or without a time).

    In append mode a day comes out once, when the watermark has passed its end; only open days are kept as state. The
    gate lets no row through that the watermark would drop, so the counts of all closed days and the rejected rows
    together are all failures.
    """
    fresh, rejected = stream_freshness_gate(_failed(stream), reference, late_hours, future_tolerance_minutes, ts)
    return _daily(fresh, ts), rejected


def _own(name: str, columns: list[str]) -> str:
    """A column name of ours that the input does not have."""
    while name in columns:
        name = f"{name}_"
    return name


def edition_states(spark: SparkSession, store: str) -> DataFrame:
    """(day, batch, state) of the days that `stream_edition_close` has closed: delivered, or in_doubt if the job's end was never noted."""
    noted = spark.read.schema(LEDGER).parquet(f"{store}/ledger")
    done = F.max((F.col("phase") == "commit").cast("int")) == 1
    return noted.groupBy("day", "batch").agg(F.when(done, "delivered").otherwise("in_doubt").alias("state"))


def late_rows(spark: SparkSession, store: str, schema) -> DataFrame:
    """The rows that came after their day was closed, with all their columns."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{store}/late")


def stream_edition_close(
    stream: DataFrame,
    job: Callable[[DataFrame, int], None],
    checkpoint: str,
    store: str,
    ts: str = "published_at",
    grace_hours: int = 6,
    name: str | None = "edition-close",
    delivered: Callable[[int], bool] | None = None,
):
    """Run the batch job on all rows of a day once the day is closed, however many batches they came in.

    A day is closed when a row from `grace_hours` after its end has been seen; the job then gets every landed row of the
    closed days. Days still open stay landed for a later run. Rows without a time belong to no day and are
    landed under a null day. Rows that come after the close of their day are rejected into a table of their own (`late_rows`).

    The ledger notes the days before the job starts and again after it has ended. A batch that is tried again overwrites its
    own files and decides as before. If its job was started and its end is not noted, `delivered` is asked whether
    the job's output is there, and the job runs again only if it is not. Without `delivered` such days are never run
    again and stay in doubt (`edition_states`).

    Rows are landed by day, and an index keeps the number of rows and the latest time per batch and day, so a batch reads
    the index and the days that it closes, not all landed rows. Columns may have any names.
    """
    spark, schema = stream.sparkSession, stream.schema
    day, of_batch = _own("_day", stream.columns), _own("_batch", stream.columns)
    ledger, index = f"{store}/ledger", f"{store}/index"
    # tables that are read before anything is written to them
    spark.createDataFrame([], "day date").write.mode("overwrite").parquet(f"{ledger}/batch=-1/phase=intent")
    spark.createDataFrame([], "day date, latest timestamp, n long").write.mode("overwrite").parquet(f"{index}/batch=-1")
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{store}/late/batch=-1")

    def note(session: SparkSession, days: list, number: int, phase: str) -> None:
        rows = session.createDataFrame([(d,) for d in days], "day date").coalesce(1)
        rows.write.mode("overwrite").parquet(f"{ledger}/batch={number}/phase={phase}")

    def land(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        earlier = session.read.schema(LEDGER).parquet(ledger).filter((F.col("phase") == "intent") & (F.col("batch") < number))
        closed = [r.day for r in earlier.select("day").distinct().collect()]  # one value a day
        rows = batch.withColumn(day, F.to_date(ts)).withColumn(of_batch, F.lit(number))
        is_late = F.coalesce(F.col(day).isin(closed), F.lit(False))
        rows.filter(is_late).drop(day, of_batch).write.mode("overwrite").parquet(f"{store}/late/batch={number}")
        on_time = rows.filter(~is_late).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        on_time.partitionBy(day, of_batch).parquet(f"{store}/landed")
        n = F.sum((~is_late).cast("long")).alias("n")
        seen = rows.groupBy(F.col(day).alias("day")).agg(F.max(F.col(ts).cast("timestamp")).alias("latest"), n)
        seen.write.mode("overwrite").parquet(f"{index}/batch={number}")

    def ready(session: SparkSession, number: int) -> list:
        days = session.read.schema(INDEX).parquet(index).filter(F.col("batch") <= number)
        latest = F.lit(days.agg(F.max("latest")).first()[0]).cast("timestamp")
        over = F.col("day").cast("timestamp") + F.make_dt_interval(days=F.lit(1), hours=F.lit(grace_hours)) <= latest
        closed = session.read.schema(LEDGER).parquet(ledger).filter("phase = 'intent'").select("day")
        found = days.filter(over & (F.col("n") > 0)).select("day").distinct().join(closed, "day", "left_anti")
        return sorted(r.day for r in found.collect())  # one value a day

    def deliver(session: SparkSession, days: list, number: int) -> None:
        landed = StructType([*schema.fields, StructField(day, DateType()), StructField(of_batch, LongType())])
        rows = session.read.schema(landed).parquet(f"{store}/landed").filter(F.col(day).isin(days) & (F.col(of_batch) <= number))
        job(rows.drop(day, of_batch), number)
        note(session, days, number, "commit")

    def close(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        mine = session.read.schema(LEDGER).parquet(ledger).filter(F.col("batch") == number).select("day", "phase").collect()
        begun = sorted({r.day for r in mine if r.phase == "intent"})
        if begun:  # a second try of this batch: all its rows are landed
            ended = any(r.phase == "commit" for r in mine)
            if not ended and delivered is not None:
                note(session, begun, number, "commit") if delivered(number) else deliver(session, begun, number)
            return
        land(batch, number)
        days = ready(session, number)
        if days:
            note(session, days, number, "intent")
            deliver(session, days, number)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(close)
    return (writer.queryName(name) if name else writer).start()
