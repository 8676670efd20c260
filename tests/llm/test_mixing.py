import random
from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm.helpers import frame, prose
from tidewire.llm import mixing
from tidewire.llm.mixing import apportion, mixed, mixed_documents


def brute_targets(sizes, weights=(5, 2, 1), repeats=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / whole > repeats * sizes[s]}
        if not over:
            target.update({s: rest * weight[s] / whole for s in open_})
            break
        for s in over:
            target[s] = float(repeats * sizes[s])
            rest -= target[s]
        open_ -= over
    return target


def docs(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        source = rng.choice(["b", "b", "b", "b", "a", "Z", "é", "", None, "tiny"])
        n = 0 if rng.random() < 0.05 else rng.choice([3, 40, 200])
        rows.append((i, " ".join(prose(rng, 3 if source == "tiny" else n)), source))
    rows += [(7, "a b c", "b"), (7, "a b c", "b"), (500, None, "b"), (None, "x y z", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_taken(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 20)
    df = docs(spark).withColumns({"shard": F.lit(1), "target": F.lit("x"), "size": F.lit(9)})
    got = mixed(df).collect()
    assert len(got) == df.count()
    sizes, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in got:
        sizes[r.source] += r["size"]
        target[r.source] = r.target
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    want = brute_targets(sizes)
    for s, t in want.items():
        assert abs(target[s] - t) < 1e-6 * max(1, t)
        assert abs(taken[s] - t) <= 2 * mixing.BLOCK
        assert {r.source_size for r in got if r.source == s} == {sizes[s]}
    assert sorted(map(repr, mixed(df.repartition(3)).collect())) == sorted(map(repr, got))


def test_apportionment_by_highest_quotients(spark):
    rng = random.Random(3)
    votes = {f"p{i}": rng.choice([0, 1, 7, 50, 333, 1000]) for i in range(12)}
    for seats in (0, 1, 5, 40, 997):
        won = dict.fromkeys(votes, 0)
        for _ in range(seats):
            best = max(sorted(votes), key=lambda p: votes[p] / (2 * won[p] + 1))
            won[best] += 1
        df = spark.createDataFrame(list(votes.items()), "p string, v long").withColumn("g", F.lit(0))
        got = {r.p: r.n for r in apportion(df, ["g"], [F.col("p")], F.col("v"), F.lit(seats), "n").collect()}
        assert got == won


def test_documents_are_repeated_and_empty_table(spark):
    df = docs(spark, 2).withColumns({"_id": F.lit(1), "_copies": F.lit(2)})
    out = mixed_documents(df)
    assert out.columns == df.columns and out.filter("doc_id = 500").isEmpty()
    assert 0 < out.count() < 3 * df.count()
    assert mixed(frame(spark, [])).collect() == [] and mixed_documents(frame(spark, [])).collect() == []


def test_columns_with_the_plan_s_names_keep_their_values(spark):
    plain = docs(spark, 2)
    names = ["_id", "_source", "_size", "_nth", "_copy", "_copies", "_id2", "_row", "size", "taken"]
    df = plain.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in names})
    want = sorted(map(repr, mixed_documents(plain).collect()))
    out = mixed_documents(df)
    assert sorted(map(repr, out.select(*plain.columns).collect())) == want
    assert all(r[n] == f"{n}{'-' if r.doc_id is None else r.doc_id}" for r in out.collect() for n in names)
    assert mixed_documents(docs(spark).limit(0)).collect() == []
