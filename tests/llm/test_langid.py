import random
import zlib

import numpy as np

from tidewire.llm.langid import codewords, identified


def sample(rng, lang, n):
    letters = {"en": ["the", "ing", "th", "ou"], "de": ["sch", "ung", "ich", "ß"], "fr": ["eau", "é", "oi", "que"]}[lang]
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(1)
    rows = [(i, sample(rng, lang := rng.choice(["en", "de", "fr"]), rng.choice([3, 30])), lang, lang) for i in range(400)]
    rows += [(1000, None, "en", ""), (1001, "", "de", ""), (1002, "12 34 !?", "fr", ""), (None, sample(rng, "de", 20), "xx", "")]
    rows += [(1003, sample(rng, "fr", 9000), None, ""), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = identified(df).collect()
    assert len(got) == len(rows)
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    truth = {r[0]: r[2] for r in rows}
    out = [r for r in got if r.held_out and r.doc_id < 1000]
    assert len(out) > 60 and np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.97
    for r in got:
        assert r.held_out == (r.doc_id is not None and fold(r.doc_id) == 2)
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "fr", "und")
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002, 1003)} == {1000: "und", 1001: "und", 1002: "und", 1003: "fr"}
    assert {r.lang_pred for r in got if r.doc_id is None} == {"de"}
    assert identified(df.limit(0)).collect() == []
    assert {r.lang_pred for r in identified(df.filter("doc_id = 1003")).collect()} == {"und"}


def test_codewords_are_distinct():
    for n in range(1, 40):
        codes = codewords(n)
        assert len({tuple(c) for c in codes.tolist()}) == n
