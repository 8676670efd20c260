"""What the edition job shuffles and writes: no more than in proportion to its rows, and texts only where they must move."""

import os
import random

from helpers import CATALOG, DAY, article, frame
from pyspark.sql import functions as F

from tidewire.operators.catalog import analyze_articles
from tidewire.operators.dedupe import dedupe_stories
from tidewire.operators.ranking import candidate_queue
from tidewire.plans.edition import build_edition
from tidewire.workspace import checkpoint_root


def shuffled_rows(spark, run):
    """Rows that all stages of `run` write for a shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        found = store.stageList(None, False, False, none, None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    run()
    # the counts come by a queue
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(rows for stage, rows in stages().items() if stage not in before)


def stories(spark, number):
    rng = random.Random(11)
    words = ["opening", "factory", "battery", "council", "minister", "harbour", "railway", "station", "weather", "council"]
    rows = [article(i, f"{' '.join(rng.choices(words, k=6))} {i}", f"https://x.test/{i}") for i in range(number)]
    return frame(spark, rows)


def test_titles_of_common_words_shuffle_in_proportion(spark):
    moved = [shuffled_rows(spark, lambda n=n: dedupe_stories(stories(spark, n))[0].count()) for n in (500, 2000)]
    assert moved[1] < 6 * moved[0], moved


def test_queue_of_few_keys_leaves_texts_where_they_are(spark):
    rows = analyze_articles(stories(spark, 60).withColumn("content", F.repeat("title", 100)), CATALOG)
    queue = candidate_queue(rows, cap=3)
    plan = queue._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert sorted(r.queue_pos for r in queue.select("queue_pos").collect()) == [1, 2, 3]
    assert candidate_queue(rows, cap=0).count() == 0


def test_texts_of_stories_are_written_twice(spark):
    """Once with their keys and once with their routes."""
    rows = stories(spark, 40).withColumn("content", F.lit("text of the story"))
    results = spark.createDataFrame(
        [],
        "edition date, pos long, round int, rank int, title string, url string, published_date string, score double,"
        " content string, raw_content string, reference_ts timestamp",
    )
    runs = spark.createDataFrame(
        [(DAY, "x", "ok", None, ["x"])],
        "edition date, source string, status string, error_kind string, diagnostic_codes array<string>",
    )
    history = spark.createDataFrame([], "edition date, url string")
    outcomes = spark.createDataFrame([], "edition date, pos long, round int, outcome string")
    root = checkpoint_root(spark)
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    build_edition(rows, runs, history, results, outcomes, CATALOG)["items"].count()
    whole = []
    for name in set(os.listdir(root)) - before:
        for table in os.listdir(f"{root}/{name}"):
            saved = spark.read.parquet(f"{root}/{name}/{table}")
            if "content" in saved.columns and saved.count() > 30:
                whole.append(f"{name.rsplit('-', 1)[0]}/{table}")
    assert sorted(whole) == ["enrich/routed-0", "stories/state-0"]
