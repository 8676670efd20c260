"""Editions of any size as bounded records, page lines and a hash tree."""

import datetime as dt
import glob
import hashlib
import json

from helpers import DAY, article, frame

from tidewire.sinks import editions as Sk
from tidewire.sources import editions as Se

OTHER = dt.date(2026, 7, 19)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_records_are_bounded_and_keep_the_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Sk, "RECORD_ROWS", 4)
    titles = [f"标题 {i} \"q\"\n\\ é" for i in range(1, 12)]
    rows = [article(i, t, content=None if i == 3 else f"c{i}") for i, t in enumerate(titles, 1)] + [article(1, "one", edition=OTHER)]
    path = str(tmp_path / "json")
    Sk.write_edition_json(frame(spark, rows), path)
    found = Se.edition_articles(Se.read_editions(spark, path, lines=True)).orderBy("edition", "pos").collect()
    assert [(r.edition, r.pos, r.title, r.content) for r in found] == [(r["edition"], r["pos"], r["title"], r["content"]) for r in rows]
    sizes = [len(json.loads(line)["articles"]) for f in glob.glob(path + "/*/part-*") for line in open(f)]
    assert sorted(sizes) == [1, 3, 4, 4]
    # a second write replaces its own editions only
    Sk.write_edition_json(frame(spark, [article(1, "new", edition=OTHER)]), path)
    again = Se.edition_articles(Se.read_editions(spark, path, lines=True)).collect()
    assert len(again) == 12 and [r.title for r in again if r.edition == OTHER] == ["new"]
    Sk.write_edition_json(frame(spark, []), path)
    assert len(Se.read_editions(spark, path, lines=True).collect()) == 4


def test_page_lines_in_order(spark, tmp_path):
    items = spark.createDataFrame([(DAY, i, f"fact {i}", "") for i in (3, 1, 2, 10, 11)], "edition date, item_no long, summary string, why_it_matters string")
    topics = spark.createDataFrame([(DAY, "t"), (OTHER, "u")], "edition date, discussion_topic string")
    path = str(tmp_path / "md")
    Sk.write_markdown_lines(Sk.markdown_lines(items, topics), path)
    pages = {}
    for day in (DAY, OTHER):
        files = sorted(glob.glob(f"{path}/edition={day}/part-*"))
        pages[day] = "".join(open(f).read() for f in files).split("\n")
    assert pages[DAY][:5] == ["---", f"title: AI 新闻日报 {DAY}", f"date: {DAY}", "---", ""]
    assert [x.split(".")[0] for x in pages[DAY][5:10]] == ["1", "2", "3", "10", "11"]
    assert pages[DAY][10:] == ["", "💬 互动话题：t", ""]
    assert pages[OTHER][5:] == ["今日没有达到证据门槛的主新闻。", "", "💬 互动话题：u", ""]


def test_fingerprint_is_a_hash_tree_in_order(spark, monkeypatch):
    monkeypatch.setattr(Sk, "SPAN", 3)
    rows = [(DAY, i, f"t{i}", None if i == 4 else "l") for i in range(1, 32)] + [(OTHER, 1, "a|1:b", "")]

    def found(rows):
        df = spark.createDataFrame(rows, "edition date, selected_rank long, title string, link string").repartition(5)
        return {r.edition: r.input_fingerprint for r in Sk.fingerprint_input(df, ["title", "link"], "p").collect()}

    def model(day):
        level = [sha(("-" if x is None else f"{len(x)}:{x}") + f"|{len(t)}:{t}") for d, _, t, x in rows if d == day]
        for _ in range(3):
            level = [sha(",".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        return sha(",".join(level))

    first = found(rows)
    assert first == {DAY: model(DAY), OTHER: model(OTHER)} and found(rows[::-1]) == first
    swapped = [(d, {7: 8, 8: 7}.get(i, i), t, x) for d, i, t, x in rows]
    assert found(swapped)[DAY] != first[DAY] and found(swapped)[OTHER] == first[OTHER]
    assert found([(OTHER, 1, "a", "1:b|")])[OTHER] != first[OTHER]
