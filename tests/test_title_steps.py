"""Steps of the title relations are done once, and no match at the start of a title is lost."""

from difflib import SequenceMatcher

from helpers import DAY, article, frame, random_titles
from pyspark.sql import functions as F

from tidewire.operators.clusters import annotate_story_clusters
from tidewire.operators.dedupe import mark_story_duplicates
from tidewire.operators.greedy import components
from tidewire.operators.similarity import TitleBlock, _reaches, related_titles, title_similarity_join


def done_again(df):
    return "BatchEvalPython" in df._jdf.queryExecution().executedPlan().toString()


def once(df):
    """Titles through a Python function, which shows in each plan that computes them."""
    return df.withColumn("title", F.udf(lambda t: t)("title"))


def test_popular_start_counts_as_a_match():
    one = "ab" * 100
    two = one[:180] + "cd" * 10
    assert SequenceMatcher(None, one, two).ratio() == 0.9
    assert TitleBlock([two]).similar(one, 0.9).tolist() == [0]
    assert TitleBlock([one]).similar(two, 0.9).tolist() == [0]


def test_a_title_does_not_meet_itself():
    titles = ["breaking news of today", "breaking news of todas"]
    block = TitleBlock(titles)
    assert block.similar(titles[0], 0.9, 0).tolist() == []
    assert block.similar(titles[1], 0.9, 1).tolist() == [0]


def test_dear_columns_are_written_once(spark):
    rows = once(frame(spark, [article(i, f"Acme opens plant {i} in Ohio this week", f"https://x.com/{i}") for i in range(1, 5)]))
    assert not done_again(mark_story_duplicates(rows))
    assert not done_again(annotate_story_clusters(rows)[0])
    edges = rows.select("edition", F.length("title").alias("a"), F.col("pos").alias("b"))
    assert not done_again(components(edges))


def test_relations_are_matched_once(spark):
    names = ["Acme opens battery factory in Ohio", "Acme opens battery factory in Iowa", "Unrelated words of another day"]
    titles = spark.createDataFrame([(DAY, t) for t in names], "edition date, title string")
    found = related_titles(titles, titles, ascending=True)
    assert "EvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.left_title, r.right_title, r.relation_type) for r in found.collect()] == [(names[1], names[0], "near_duplicate")]


def test_ratios_are_matched_after_titles_are_dealt(spark):
    rows = [(DAY, t) for t in random_titles(5, 60)]
    found = title_similarity_join(spark.createDataFrame(rows, "edition date, norm string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("EvalPython") == 1


def test_threshold_is_decided_as_by_the_ratio():
    titles = random_titles(7, 120) + ["ab" * 100, "ab" * 90 + "cd" * 10, "ba" * 100]
    reached = 0
    for a in titles:
        for b in titles:
            want = SequenceMatcher(None, a, b).ratio() >= 0.9
            assert _reaches(a, b, 0.9) == want
            reached += want
    assert reached > len(titles)
