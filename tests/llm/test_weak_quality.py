from collections import Counter

from pyspark.sql import functions as F

from tests.llm.helpers import frame, prose, words_of
from tidewire.llm.weak_quality import fit, judged, kept_only

import random


def features(text):
    text = text or ""
    w = words_of(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    found, covered = Counter(windows), set()
    for i, g in enumerate(windows):
        if found[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(1)
    clean = [" ".join(f"{x}{rng.randrange(60)}" for x in prose(rng, rng.choice([60, 200]))) for _ in range(60)]
    marks = [" ".join(f"{x}{rng.choice(['###', '%%%', '&&&'])}" for x in prose(rng, 80)) for _ in range(9)]
    loud = [" ".join(prose(rng, 80)).upper() + " AAAA!! BBBBBB!! CCCC!!" * 40 for _ in range(9)]
    edge = [None, "", "a", "a b", "a b c", "a b c a b c", "x\n\nx\n x\ny", "w " * 300, " \n", "é€ " * 60]
    return clean + marks + loud + edge


def test_features_and_verdicts(spark):
    rows = texts()
    df = frame(spark, rows).withColumns({"quality": F.lit("q"), "_quality": F.lit(1)})
    got = {r.doc_id: r["__quality"] for r in judged(df).collect()}
    for i, text in enumerate(rows):
        f = got[i]
        assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words) == features(text), text
        assert f.base_failed == (f.n_words < 50 or 100 * f.n_repeat_words > 50 * f.n_words)
        assert not (f.base_failed and f.kept)
    assert all(got[i].kept for i in range(60)) and not any(got[i].kept for i in range(60, 78))
    kept = kept_only(df)
    assert kept.columns == df.columns and kept.count() == 60


def test_plan_has_no_python(spark):
    plan = judged(frame(spark, ["a b", "a b"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_estimate():
    assert fit([]) == {}
    patterns = [((0, 0, 1), 900), ((-1, 0, 0), 60), ((0, -1, 0), 40), ((-1, 0, 1), 3)]
    posterior = fit(patterns)
    assert posterior[0, 0, 1] > 0.9 and posterior[-1, 0, 0] < 0.5 and posterior[0, -1, 0] < 0.5


def test_empty_table(spark):
    assert judged(frame(spark, [])).collect() == []


def test_columns_with_the_rules_names_keep_their_values(spark):
    texts = ["word " * 30 + "and the other one " * 20, "a b", None, "", "x y z " * 60_000] * 2
    df = frame(spark, texts, [1, 2, 3, 4, 5, 1, None, 3, 4, 6])
    plain = sorted(map(repr, kept_only(df).collect()))
    clash = df.withColumns({n: F.lit(n) for n in ("quality", "quality_votes", "_quality", "posterior", "kept")})
    out = kept_only(clash)
    assert out.columns == clash.columns and sorted(map(repr, out.select(*df.columns).collect())) == plain
    assert all(r[n] == n for r in out.collect() for n in ("quality", "quality_votes", "_quality", "posterior", "kept"))
