"""Streams over several batches, restarts and failures of the job."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewire.streaming import feed as St

BASE = dt.datetime(2026, 7, 18, 12)
SCHEMA = "link string, published_at timestamp, day string, batch int, _day string"


class Feed:
    """A folder of files, each of which becomes one batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.path, self.schema = spark, str(folder / "in"), schema

    def land(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)


def at(*hours):
    return [(f"h{h}", BASE + dt.timedelta(hours=h), "given", 7, "x") for h in hours]


def names(rows):
    return sorted(rows, key=lambda n: int(n[1:]))


def close(feed, folder, job, **options):
    return St.stream_edition_close(feed.stream(), job, str(folder / "ck"), str(folder / "store"), **options).awaitTermination()


def test_daily_failures_in_append_mode(spark, tmp_path):
    """Every failure is counted once in a closed day or rejected, over batches, a late row and a restart."""
    schema = "ts timestamp, stage string, outcome string, landed_at timestamp"
    feed = Feed(spark, tmp_path, schema)

    def land(now, *hours):
        feed.land([(None if h is None else BASE + dt.timedelta(hours=h), "fetch", "timeout", BASE + dt.timedelta(hours=now)) for h in hours])

    def run():
        daily, rejected = St.stream_daily_failures(feed.stream(), F.col("landed_at"), late_hours=24)
        for name, out in (("daily", daily.select(F.to_date("day.start").alias("day"), "stage", "code", "n")), ("rejected", rejected)):
            query = out.writeStream.format("parquet").option("path", str(tmp_path / name)).outputMode("append")
            query.option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start().awaitTermination()
        days = spark.read.schema("day date, stage string, code string, n long").parquet(str(tmp_path / "daily")).collect()
        assert len({r.day for r in days}) == len(days)
        reasons = Counter(r.reason for r in spark.read.schema(f"{schema}, reason string").parquet(str(tmp_path / "rejected")).collect())
        return {r.day.day: r.n for r in days}, reasons

    land(0, 0, -1, -11, None)
    land(20, 19, 0, 18)
    assert run() == ({}, {"invalid_published_at": 1})
    # a restart; the row of hour 2 is older than a day, that of hour 30 is not; days 18 to 20 close
    land(50, 49, 2, 30, 60)
    land(90, 89)
    assert run() == ({18: 4, 19: 3, 20: 1}, {"invalid_published_at": 1, "stale_published_at": 1, "future_published_at": 1})
    land(200, 199)
    assert run()[0] == {18: 4, 19: 3, 20: 1, 22: 1}


def test_close_keeps_columns_and_rejects_late_rows(spark, tmp_path):
    feed, seen = Feed(spark, tmp_path, SCHEMA), []

    def job(rows, number):
        assert rows.columns == ["link", "published_at", "day", "batch", "_day"]
        got = rows.collect()
        assert {(r.day, r.batch, r["_day"]) for r in got} == {("given", 7, "x")}
        seen.append(names(r.link for r in got))

    feed.land(at(0, 1) + [("h99", None, "given", 7, "x")])
    feed.land(at(5))
    close(feed, tmp_path, job)
    assert seen == []
    feed.land(at(19))
    close(feed, tmp_path, job)
    assert seen == [["h0", "h1", "h5"]]
    feed.land(at(2, 43))
    feed.land([])
    close(feed, tmp_path, job)
    assert seen[1:] == [["h19"]]
    store = str(tmp_path / "store")
    late = St.late_rows(spark, store, SCHEMA).collect()
    assert [(r.link, r.day, r.batch) for r in late] == [("h2", "given", 7)]
    assert {(r.day.day, r.state) for r in St.edition_states(spark, store).collect()} == {(18, "delivered"), (19, "delivered")}


@pytest.mark.parametrize("dies", ["before", "after"])
@pytest.mark.parametrize("asked", [False, True])
def test_job_that_dies_is_not_run_twice(spark, tmp_path, dies, asked):
    """The job fails before or after its delivery, and the end is not noted; the same batch is then tried again."""
    feed, out, fail = Feed(spark, tmp_path, SCHEMA), [], [True]

    def job(rows, number):
        if fail[0] and dies == "before":
            raise RuntimeError("lost")
        out.append(names(r.link for r in rows.collect()))
        if fail[0]:
            raise RuntimeError("lost")

    options = {"delivered": lambda number: bool(out)} if asked else {}
    feed.land(at(0, 1))
    feed.land(at(19))
    with pytest.raises(Exception, match="lost"):
        close(feed, tmp_path, job, **options)
    states = lambda: {(r.day.day, r.state) for r in St.edition_states(spark, str(tmp_path / "store")).collect()}
    assert states() == {(18, "in_doubt")}
    fail[0] = False
    close(feed, tmp_path, job, **options)
    # asked, the day is delivered exactly once; otherwise never a second time
    assert out == ([["h0", "h1"]] if asked or dies == "after" else [])
    assert states() == {(18, "delivered" if asked else "in_doubt")}
    # later days are not held up
    feed.land(at(43))
    close(feed, tmp_path, job, **options)
    assert out[-1] == ["h19"] and (19, "delivered") in states()


def test_batch_tried_again_before_the_intent_lands_once(spark, tmp_path, monkeypatch):
    feed, seen = Feed(spark, tmp_path, SCHEMA), []
    feed.land(at(0, 1))
    feed.land(at(19))
    real, calls = St.F.make_dt_interval, []

    def once(*args, **kwargs):
        calls.append(1)
        if len(calls) == 2:  # the second batch is landed and dies before it knows its closed days
            raise RuntimeError("lost")
        return real(*args, **kwargs)

    monkeypatch.setattr(St.F, "make_dt_interval", once)
    with pytest.raises(Exception, match="lost"):
        close(feed, tmp_path, lambda rows, n: seen.append(names(r.link for r in rows.collect())))
    close(feed, tmp_path, lambda rows, n: seen.append(names(r.link for r in rows.collect())))
    feed.land(at(43))
    close(feed, tmp_path, lambda rows, n: seen.append(names(r.link for r in rows.collect())))
    assert seen == [["h0", "h1"], ["h19"]]
