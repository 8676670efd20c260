import itertools
import random
import zlib

import numpy as np

from tests.llm.helpers import frame, prose
from tidewire.llm import toxicity as t

PLAIN = "the scoundrel said a villain and his fool were here with stone and trees " * 30
MODEL = t.LanguageModel(t.trigram_counts(np.frombuffer(PLAIN.encode(), np.uint8), np.array([0, len(PLAIN)])))
RESTORE = t.Restorer(MODEL)


def test_disguises_are_restored():
    cases = {
        "v1llain": "villain", "a sc0undr3l here": "a scoundrel here", "f o o l": "fool", "f.o.o.l": "fool", "vi-ll-ain": "villain",
        "fooooool!": "fool!", "$coundrel": "scoundrel", "V!LLA1N": "villain", "st0ne,": "stone,",
    }
    for text, want in cases.items():
        assert t.restored_text(text, RESTORE) == want, text
    for same in ("", "the fool", "Trees,\nand stone.", "1234 55", "é à", "#### ---"):
        assert t.restored_text(same, RESTORE) == same


def test_viterbi_path_is_the_cheapest_of_all():
    def total(parts):
        cost, at = 0.0, 0
        for letters, extra, breaks in parts:
            cost += extra
            if breaks:
                cost += MODEL.cost[at * t.CLASSES] if at else 0.0
                at = 0
            for x in letters:
                code = int(t.CODES[ord(x)])
                cost += MODEL.cost[at * t.CLASSES + code]
                at = at % t.CLASSES * t.CLASSES + code
        return cost + (MODEL.cost[at * t.CLASSES] if at else 0.0)

    for word in ("f0ol", "v1lla1n", "7ree5", "5aid", "1s", "st0n33"):
        runs = [(sign, len(list(group))) for sign, group in itertools.groupby(word)]
        options, last = [], max(i for i, (s, _) in enumerate(runs) if s.isalpha())
        for i, (sign, n) in enumerate(runs):
            own = [(letters, extra, False, letters) for letters, extra in t._options(sign, n)]
            if not sign.isalpha():
                own.append(("", t.INSIDE if i < last else t.ITSELF, True, sign * n))
            options.append(own)
        best = min(itertools.product(*options), key=lambda path: total([p[:3] for p in path]))
        got = t.decoded(word.encode(), MODEL).decode()
        assert got == "".join(p[3] for p in best), word


def test_segments_stay_inside_texts_and_rows():
    texts = ["end.", "next aaa b", "c d", "", "1", "x"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(x) for x in texts])
    row, a, b = t.segments(t.words_of(raw, offsets))
    assert [(r, raw[i:j].tobytes()) for r, i, j in zip(row, a, b, strict=True)] == [(1, b"aaa")]


def test_blocks_give_the_grams_of_each_text_alone():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["fool", "v1llain", "a b c d", "tre.es", "ééé", "12", "stooone"]) for _ in range(rng.randrange(9))) for _ in range(60)]
    data = [x.encode() for x in texts]
    row, gram, changed = t.restored_grams(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(x) for x in data]), RESTORE)
    for i, x in enumerate(data):
        _, alone, n = t.restored_grams(np.frombuffer(x, np.uint8), np.array([0, len(x)]), RESTORE)
        assert sorted(gram[row == i].tolist()) == sorted(alone.tolist()) and n[0] == changed[i]


def test_held_out_and_disguised_documents_and_edge_cases(spark):
    rng = random.Random(5)
    texts = []
    for i in range(600):
        words = prose(rng, 60)
        words = ["".join(c for c in w if not c.isdigit()) + rng.choice("aeiou") for w in words]
        if i % 4 == 0:
            words.insert(rng.randrange(60), rng.choice(["villain", "scoundrel"]))
        texts.append(" ".join(words))
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "x") for i in range(600)] + [(None, 1, ""), (7, None, "")], "doc_id long, toxic int, text string")
    hidden = ["oa v1ll4in ua", "oa s c o u n d r e l ua", "oa viiiillain ua", "oa sc.oun.drel ua"]
    long = "wa we wi " * 50_000
    df = frame(spark, [*texts, *hidden, None, "", texts[0], long, long + "villain"], [*range(600), *range(1000, 1004), 2000, 2001, 0, 2002, 2003])
    got = t.toxicity(df, labels).collect()
    assert len(got) == 609 and all(0 <= r.score <= 1 and r.predicted == (r.score >= t.CUT) for r in got)
    by_id = {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in held)
    assert all(by_id[i].predicted == 1 and by_id[i].n_restored >= 1 for i in range(1000, 1004))
    assert by_id[2000].score == by_id[2001].score < t.CUT
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    assert by_id[2003].score > by_id[2002].score
    assert {round(r.score, 9) for r in t.toxicity(df, labels.limit(0)).collect()} == {0.1}
    assert t.toxicity(frame(spark, []), labels).collect() == []


def test_clashing_columns(spark):
    df = frame(spark, ["a v1llain", "b"]).selectExpr("*", "1 as _id", "2 as _label", "3 as score", "4 as held_out", "5 as gram")
    labels = spark.createDataFrame([(0, 1, 9, 9), (1, 0, 9, 9)], "doc_id long, toxic int, _id int, text int")
    assert sorted(r.doc_id for r in t.toxicity(df, labels).collect()) == [0, 1]
    fixed = {r.doc_id: r.text for r in t.restored(df, MODEL).collect()}
    assert fixed == {0: "a villain", 1: "b"}
