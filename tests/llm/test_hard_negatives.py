import math
import random

import numpy as np
import pytest

from tidewire.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<float>, label int"


def model(rows):
    """Rows (vec_id, embedding, label) -> sorted rows of the result, by the definition."""
    seen = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        q = tuple(math.floor(256 * float(np.float32(v))) for v in x)
        if any(abs(v) > h.LARGEST for v in q):
            continue
        seen[i, (label + 1) % 10 if i % 7 == 0 else label, q] = None
    score = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    out = set()
    for a, la, x in seen:
        if a % 50:
            continue
        others = sorted((-score(x, y), b) for b, lb, y in seen if lb == la and b != a)
        negatives = sorted((-score(x, y), b) for b, lb, y in seen if lb != la)
        for minus, b in others[:5]:
            p = -minus
            fits = [(n, -m) for m, n in negatives if 50 * p <= 100 * -m <= 95 * p][:3]
            out |= {(a, b, i + 1, n, p, s) for i, (n, s) in enumerate(fits)}
    return sorted(out)


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in h.hard_negatives(df, **kw).collect())


def vectors(seed, n, dims, centres=6):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    return [(i, [m + rng.gauss(0, 0.3) for m in rng.choice(middle)], rng.randrange(10)) for i in range(n)]


@pytest.mark.parametrize("fanout,leaf_rows,block_rows", [(16, 20_000, 20_000), (3, 10, 7), (2, 40, 1000)])
def test_equals_the_definition(spark, fanout, leaf_rows, block_rows):
    rows = vectors(fanout, 500, 5)
    got = found(spark, rows, fanout=fanout, leaf_rows=leaf_rows, block_rows=block_rows)
    assert got == model(rows) and len(got) > 20


def test_equal_vectors_ties_and_wrong_rows(spark, monkeypatch):
    monkeypatch.setattr(h, "QUERY_PART", 2)
    rows = vectors(9, 200, 4)
    rows += [(1000 + i, [0.5, 0.5, 0.25, 0.0], i % 3) for i in range(120)]
    rows += [(2000 + i, [0.5, 0.25, 0.25, 0.0], i % 3) for i in range(120)]
    rows += [rows[150], rows[150], rows[5]]
    rows += [(50, None, 1), (100, [0.1, None, 0.1, 0.1], 1), (150, [float("nan")] * 4, 1), (201, [float("inf")] * 4, 1), (None, [0.1] * 4, 1)]
    rows += [(250, [0.1] * 4, None), (300, [1e30] * 4, 1), (350, [], 1), (400, [0.4, 0.4], 1), (450, [300.0] * 4, 2), (451, [290.0, 1.0], 2), (452, [150.0] * 4, 3)]
    got = found(spark, rows, fanout=3, leaf_rows=20, block_rows=16)
    assert got == model(rows) and len(got) > 100


def test_no_rows_and_clashing_columns(spark):
    assert found(spark, []) == []
    assert found(spark, [(50, [0.1], 1)]) == []
    rows = vectors(4, 120, 3)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'a' as query", "1 as vector", "2 as _salt", "3 as nth", "4 as rank", "5 as x")
    assert sorted(tuple(r) for r in h.hard_negatives(df).collect()) == model(rows)


def test_tree_drops_no_row_and_some_subtrees():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(3000, 3)) * 256).astype(np.int64)
    tree = h.Tree(x, len(x), fanout=8, leaf_rows=100)
    leaf = tree.leaf_of(x)

    class Shared:
        value = (tree,)

    import pyarrow as pa

    packed = pa.array([b"\x04" + r.astype("<i4").tobytes() for r in x], pa.binary())
    (ranges,) = h._ranges(Shared)([pa.RecordBatch.from_arrays([packed], ["vector"])])
    tree.set_ranges(zip(*(c.to_pylist() for c in ranges.columns), strict=True))
    queries = x[::100]
    scores = queries @ x.T
    top = np.sort(scores, axis=1)[:, ::-1]
    least, most = top[:, 20:21].copy(), top[:, 3:4].copy()
    open_ = tree.open_leaves(queries, least, most)
    wanted = (scores >= least) & (scores <= most)
    visits = 0
    for i, rows in enumerate(open_):
        visits += len(rows)
        assert set(np.flatnonzero(wanted[:, leaf == i].any(axis=1))) <= set(rows.tolist())
    assert visits < 0.6 * len(queries) * tree.leaves
