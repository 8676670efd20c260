"""The stream operators over the given tables: each query reads `events` as a stream until no data is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.queries import views as V
from tidewire.queries.registry import query
from tidewire.streaming import feed as St
from tidewire.workspace import Rounds

LATE_HOURS, GRACE_HOURS = 24, 6


def _events(spark, sf: str) -> DataFrame:
    path = f"{sf}/event[s].parquet"  # as a pattern: a stream takes a table that is one file only so
    rows = spark.readStream.schema(V.table(spark, sf, "events").schema).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _run(out: DataFrame, name: str) -> DataFrame:
    """What a stream has written once its input is used up."""
    base = Rounds(out.sparkSession, name).base
    writer = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{base}/out")


@query(
    "stream_freshness_gate",
    f"""WITH {V.EV} SELECT event_id, CASE WHEN k < 20 THEN 'future_published_at' WHEN k > 50 THEN 'stale_published_at' ELSE '' END AS reason FROM ev""",
)
def stream_freshness_gate(spark, sf):
    landed = F.col("ts") + F.make_dt_interval(hours=F.col("k") - 20)
    fresh, rejected = St.stream_freshness_gate(_events(spark, sf), landed, ts="ts")
    kept = _run(fresh.select("event_id"), "fresh").withColumn("reason", F.lit(""))
    return kept.unionByName(_run(rejected.select("event_id", "reason"), "rejected"))


@query("stream_recent_dedupe", "SELECT DISTINCT 'h.test/' || user_id AS url_key FROM events")
def stream_recent_dedupe(spark, sf):
    rows = _events(spark, sf).withColumn("link", F.concat(F.lit("https://www.h.test/"), "user_id", F.lit("?utm_source=x"))).withColumn("title", F.col("event_type"))
    found = St.stream_recent_dedupe(rows.select("link", "title", "ts"), days=3, ts="ts")
    # a URL comes again after three days, and how often depends on how the files fall into batches
    return _run(found.select("url_key"), "recent").distinct()


@query(
    "stream_daily_failures",
    f"""WITH {V.EV}, bad AS (SELECT ts, edition, event_type AS stage, 'code_' || (k % 4) AS code, k % 40 > {LATE_HOURS} AS late FROM ev WHERE k % 4 > 1),
 seen AS (SELECT max(ts) - INTERVAL {LATE_HOURS * 60 + 5} MINUTE AS mark FROM bad WHERE NOT late)
 SELECT edition AS day, stage, code, count(*) AS n FROM bad, seen WHERE NOT late AND edition + INTERVAL 1 DAY <= mark GROUP BY ALL
 UNION ALL SELECT edition, stage, 'stale_published_at', count(*) FROM bad WHERE late GROUP BY ALL""",
)
def stream_daily_failures(spark, sf):
    outcome = F.when(F.col("k") % 4 == 0, "success").when(F.col("k") % 4 == 1, "").otherwise(F.concat(F.lit("code_"), F.col("k") % 4))
    rows = _events(spark, sf).select("ts", F.col("event_type").alias("stage"), outcome.alias("outcome"), "k")
    landed = F.col("ts") + F.make_dt_interval(hours=F.col("k") % 40)
    counts, rejected = St.stream_daily_failures(rows, landed, LATE_HOURS)
    closed = _run(counts.select(F.to_date("day.start").alias("day"), "stage", "code", "n"), "daily")
    late = _run(rejected.select(F.to_date("ts").alias("day"), "stage", F.col("reason").alias("code")), "late")
    return closed.unionByName(late.groupBy("day", "stage", "code").agg(F.count(F.lit(1)).alias("n")))


@query(
    "stream_edition_close",
    f"""WITH {V.EV} SELECT edition AS day, event_type, count(*) AS n FROM ev
 WHERE edition + INTERVAL {24 + GRACE_HOURS} HOUR <= (SELECT max(ts) FROM events) GROUP BY ALL""",
)
def stream_edition_close(spark, sf):
    base = Rounds(spark, "close").base

    def job(rows: DataFrame, number: int) -> None:
        days = rows.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
        days.write.mode("overwrite").parquet(f"{base}/out/run={number}")

    events = _events(spark, sf).select("event_id", "ts", "event_type")
    St.stream_edition_close(events, job, f"{base}/checkpoint", f"{base}/store", "ts", GRACE_HOURS, name=None).awaitTermination()
    spark.createDataFrame([], "day date, event_type string, n long").write.mode("overwrite").parquet(f"{base}/out/run=-1")
    return spark.read.schema("day date, event_type string, n long").parquet(f"{base}/out").select("day", "event_type", "n")
