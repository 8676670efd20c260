import random
import zlib

import numpy as np

from tests.llm.helpers import frame, prose
from tidewire.llm.byte_cnn import CHUNK, WIDTH, Network, chunk_bounds, scored


def test_chunks_cover_every_window():
    for n in (0, 1, WIDTH - 1, WIDTH, CHUNK, CHUNK + 1, 5 * CHUNK + 3):
        covered = {w for a, b in chunk_bounds(n).tolist() for w in range(a, b - WIDTH + 1)}
        assert covered == set(range(max(0, n - WIDTH + 1)))


def test_scores_equal_a_plain_loop():
    net, rng = Network(), np.random.default_rng(1)
    texts = [rng.integers(0, 256, n).astype(np.uint8) for n in (0, 3, WIDTH, 700, 3000)]
    got = net.scores(np.concatenate(texts), np.cumsum([0] + [len(t) for t in texts]))
    for text, score in zip(texts, got, strict=True):
        pooled = []
        for a, b in chunk_bounds(len(text)).tolist():
            sums = [sum(net.filters[j][text[w + j]] for j in range(WIDTH)) for w in range(a, b - WIDTH + 1)]
            pooled.append(np.tanh(np.max(sums, axis=0) + net.shift))
        mean, top = (np.mean(pooled, axis=0), np.max(pooled, axis=0)) if pooled else (np.zeros(16), np.zeros(16))
        x = np.concatenate([mean, top, [np.log1p(len(text)) / 10]])
        assert abs(1 / (1 + np.exp(-(x @ net.layer + net.bias))) - score) < 1e-5


def test_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(1)
    texts = [" ".join(x + rng.choice(["", "", "###"]) if i % 2 else x for x in prose(rng, 80)) for i in range(400)]
    labels = spark.createDataFrame([(i, 1 - i % 2, "x") for i in range(400)] + [(None, 1, ""), (401, None, "")], "doc_id long, quality int, text string")
    df = frame(spark, [*texts, None, "", texts[0], texts[1]], [*range(400), 600, 601, 0, None])
    got = scored(df, labels).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == 1 - r.doc_id % 2 for r in held]) > 0.95
    assert {r.score for r in scored(df, labels.limit(0)).collect()} == {0.5}
    assert scored(frame(spark, []), labels).collect() == []
