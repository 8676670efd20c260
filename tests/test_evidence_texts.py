"""Texts of search results: the same evidence, without whole texts in the joins."""

import datetime as dt

from helpers import CATALOG, article, frame

from tidewire.operators import evidence as Ev

def results(spark, texts):
    at = dt.datetime(2026, 7, 18, 1)
    rows = [(dt.date(2026, 7, 18), 1, 1, i, "OpenLab launches GPT", f"https://h.com/{i}", "2026-07-17T20:00:00Z", 0.9, c, r, at) for i, (c, r) in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "edition date, pos long, round int, rank int, title string, url string, published_date string, score double, content string, raw_content string, reference_ts timestamp")


def test_whole_texts_stay_out_of_the_joins(spark):
    leads = frame(spark, [article(1, "OpenLab launches GPT in Ohio", "https://a.com/1")])
    out = Ev.match_evidence(leads, results(spark, [("words of evidence " * 20, "more words " * 900)] * 3), CATALOG)
    assert not {"content", "raw_content"} & set(out.columns)
    rows = out.filter("accepted").collect()
    assert len(rows) == 3 and all(r.evidence_item.text.startswith("words of evidence") for r in rows)
