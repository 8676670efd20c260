import datetime as dt
import random

from helpers import CATALOG, article, frame
from pyspark.sql import functions as F

from tidewire.functions import articles as A
from tidewire.operators import catalog as Cat
from tidewire.operators import clusters as C
from tidewire.operators import selection as Sel
from tidewire.settings import ChannelSettings, SelectSettings

SUBJECTS = ["OpenLab", "Mega", "ChipCo", "Shop", "GPT", "Orca", "a robot", "AI", "someone", "OpenLab and Mega"]
VERBS = ["launches", "raises", "sues", "shows", "release of"]
OBJECTS = ["a data center", "3 billion", "Orca", "GPT", "a robotaxi", "something", "500 M", "phones"]


def random_editions(seed, count, size):
    rng = random.Random(seed)
    rows = []
    for e in range(count):
        day = dt.date(2026, 7, 1) + dt.timedelta(days=e)
        for i in range(1, size + 1):
            rows.append(
                article(
                    i,
                    f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(OBJECTS)}",
                    f"https://h{rng.randrange(4)}.com/{i}",
                    day,
                    source=rng.choice(["a", "b", "agihunt", "agihunt_trending", ""]),
                    priority=rng.randrange(3),
                    kind=rng.choice(["story"] * 5 + ["lead"]),
                    description=rng.choice(["", "news about a chip", "text"]),
                    provenance=rng.choice([{}, {"trend_rank": str(rng.randrange(9)), "trend_heat": "2.5"}]),
                )
            )
    return rows


def analysed(spark, rows):
    df = Cat.analyze_for_selection(frame(spark, rows), CATALOG)
    df = df.withColumn("source_group", A.source_group()).withColumn("ok", A.has_enough_facts())
    df = C.story_signature(df, CATALOG).withColumn("rank", A.trend_rank()).withColumn("heat", A.trend_heat())
    df = df.withColumn("topic1", A.ai_topic(F.concat("title", F.lit("\n"), "description")))
    return [r.asDict(True) for r in df.collect()]


def base_key(r):
    return (-r["analysis"]["relevance"], -r["priority"], r["rank"], -r["heat"], r["pos"])


def reason(x, y):
    x, y = x["sig"], y["sig"]

    def both(k):
        return set(x[k]) & set(y[k])

    if not (both("title_entities") or both("title_models") or both("title_numbers")):
        return None
    same = x["primary"] and x["primary"] == y["primary"]
    if (same or len(both("title_entities")) >= 2) and len(both("entities")) >= 2 and both("actions"):
        return "shared_entities_action"
    if not both("entities") or not both("actions"):
        return None
    if both("models"):
        return "shared_entity_action_model"
    if both("numbers"):
        return "shared_entity_action_number"
    return "shared_entity_action_object" if same and both("objects") else None


def brute_v2(rows, limit):
    ranked = sorted(rows, key=base_key)
    stories = [r for r in ranked if r["kind"] == "story"]
    base = [r for r in stories if r["ok"]] or stories
    reps, attached = [], {}
    for r in base:
        for p in reps:
            if why := reason(r, p):
                attached[r["pos"]] = (p["pos"], why)
                break
        else:
            reps.append(r)
    pool = [r for r in reps if r["analysis"]["relevance"] >= 2] or reps
    target = min(limit, len(pool))
    groups = list(dict.fromkeys(r["source_group"] for r in pool))
    cap = max(1, int(target * 0.6)) if len(groups) >= 2 else target
    chosen, notes = [], {}

    def count(get, value):
        return sum(list(get(c)).count(value) for c in chosen)

    def broken(r):
        a, out = r["analysis"], set()
        if count(lambda c: [c["source_group"]], r["source_group"]) >= cap:
            out.add("source_cap")
        if a["primary_entity"] and count(lambda c: [c["analysis"]["primary_entity"]], a["primary_entity"]) >= 2:
            out.add("primary_entity")
        if any(count(lambda c: c["analysis"]["entities"], e) >= 3 for e in a["entities"]):
            out.add("mentioned_entity")
        if any(count(lambda c: c["analysis"]["families"], f) >= 1 for f in a["families"]):
            out.add("model_family")
        return out

    def best(cands):
        rungs = ["model_family", "mentioned_entity", "primary_entity", "source_cap"]
        for i in range(5):
            fit = [r for r in cands if broken(r) <= set(rungs[:i])]
            if fit:
                def key(r):
                    b = base_key(r)
                    pen = max(0, count(lambda c: [c["analysis"]["topic"]], r["analysis"]["topic"]) - 1)
                    return (b[0], b[1], pen, count(lambda c: [c["source_group"]], r["source_group"]), *b[2:])

                r = min(fit, key=key)
                if broken(r):
                    notes[r["pos"]] = sorted(broken(r))
                return r

    for g in groups[:target]:
        chosen.append(best([r for r in pool if r["source_group"] == g and r not in chosen]))
    while len(chosen) < target:
        chosen.append(best([r for r in pool if r not in chosen]))
    return [r["pos"] for r in sorted(chosen, key=base_key)], attached, notes


def brute_v1(rows, limit):
    def bk(r):
        return (-r["priority"], -int(r["topic1"]), r["rank"], -r["heat"], r["pos"])

    ranked = sorted((r for r in rows if r["kind"] == "story"), key=bk)
    pool = [r for r in ranked if r["ok"]] or ranked
    target = min(limit, len(pool))
    groups = list(dict.fromkeys(r["source_group"] for r in pool if r["ok"]))
    cap = max(1, int(target * 0.6)) if len(groups) >= 2 else target
    chosen = []
    for g in groups[:target]:
        chosen.append(next(r for r in pool if r["source_group"] == g))
    while len(chosen) < target:
        rest = [r for r in pool if r not in chosen]
        n = {g: sum(c["source_group"] == g for c in chosen) for g in {r["source_group"] for r in rest}}
        fit = [r for r in rest if n[r["source_group"]] < cap] or rest
        chosen.append(min(fit, key=lambda r: (*bk(r)[:2], n[r["source_group"]], *bk(r)[2:])))
    return [r["pos"] for r in sorted(chosen, key=bk)]


def test_select_v2_equals_model(spark):
    rows = random_editions(7, 12, 30)
    data = analysed(spark, rows)
    out = Sel.select_v2(frame(spark, rows), CATALOG, SelectSettings(limit=6))
    got = {}
    for r in out["selected"].orderBy("edition", "selected_rank").collect():
        got.setdefault(r.edition, []).append(r.pos)
    members = {}
    for r in out["members"].collect():
        members.setdefault(r.edition, {})[r.pos] = (r.representative_pos, r.reason)
    relaxed = {}
    for r in out["relaxations"].collect():
        relaxed.setdefault(r.edition, {})[int(r.article_id[1:])] = r.constraints
    for day in {r["edition"] for r in data}:
        want, attached, notes = brute_v2([r for r in data if r["edition"] == day], 6)
        assert got.get(day, []) == want
        assert members.get(day, {}) == attached
        assert relaxed.get(day, {}) == notes
    assert relaxed and members
    counts = out["counts"].collect()
    assert all(r.input_count == 30 and r.selected_count == len(got[r.edition]) for r in counts)
    dims = Sel.selection_counts(out["selected"]).filter("dimension = 'source'").groupBy("edition").agg(F.sum("n").alias("n"))
    assert all(r.n == len(got[r.edition]) for r in dims.collect())


def test_select_v1_equals_model(spark):
    rows = random_editions(11, 8, 25)
    data = analysed(spark, rows)
    got = {}
    for r in Sel.select_v1(frame(spark, rows), 7).orderBy("edition", "selected_rank").collect():
        got.setdefault(r.edition, []).append(r.pos)
    for day in {r["edition"] for r in data}:
        assert got.get(day, []) == brute_v1([r for r in data if r["edition"] == day], 7)


def test_analysis_cases(spark):
    cases = [
        ("GPT5 launches at OpenLab", "", 3, "openlab", ["gpt"], "model_release"),
        ("Mega opens a chip plant", "", 2, "mega", [], "other_ai"),
        ("巨型发布大模型", "", 2, "mega", [], "model_release"),
        ("Shop opens", "OpenLab watches", 3, "shop", [], "other_ai"),
        ("Workshopping chair", "", 0, "", [], "general_technology"),
        ("Orcas swim", "", 0, "", [], "general_technology"),
    ]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, t string, b string")
    rows = Cat.analyze(df, CATALOG, F.col("t"), F.col("b")).orderBy("i").collect()
    for c, r in zip(cases, rows):
        a = r.analysis
        assert (a.relevance, a.primary_entity, a.families, a.topic) == c[2:]


def test_channel_quota(spark):
    settings = ChannelSettings(core_channels=("m", "r"), supplemental_channel="p", core_quota=1, supplemental_quota=1, entity_limit=1, max_articles=4)
    items = [
        ("m", 1, "OpenAI ships the first thing", "https://a.com/1", 5.0),
        ("m", 2, "Google ships another thing", "https://a.com/2", 9.0),
        ("m", 3, "Quiet lab ships something", "https://a.com/3", None),
        ("r", 1, "Google ships another thing", "https://b.com/1", 2.0),
        ("r", 2, "Meta paper about agents", "https://b.com/2", 1.0),
        ("p", 1, "openai product page opened", "https://c.com/1", 7.0),
        ("p", 2, "openai product page closed", "https://c.com/2", 6.0),
        ("x", 1, "not configured", "https://d.com/1", 6.0),
    ]
    df = spark.createDataFrame(
        [(dt.date(2026, 7, 1), *i) for i in items], "edition date, channel string, rank int, title string, url string, hot double"
    )
    got = {(r.channel, r["rank"]): (r.selected_no, r.reason) for r in Sel.select_channel_quota(df, settings).collect()}
    assert got == {
        ("m", 2): (1, None),
        ("r", 1): (None, "duplicate_story"),
        ("r", 2): (2, None),
        ("p", 1): (3, None),
        ("m", 1): (None, "entity_limit"),
        ("m", 3): (4, None),
        ("p", 2): (None, "max_articles"),
    }
