"""Hard negatives of anchor vectors, exact, over a GNAT-style multiway hyperplane tree.

Steps
1. Components become floor(256 * x). Rows of equal vector and label differ by vec_id only, and ties go to the smaller
   one, so FOLD of them are searched; anchors of equal vector and label are one query. A vector that a third of all
   rows share is FOLD rows, and its anchors are one query.
2. Index: a node holds FANOUT split points, spread over its part of a bounded sample, and a row goes to its nearest one, so
   siblings are separated by hyperplanes. Every row is indexed. For each split point and each sibling subtree the range of
   distances, over all rows, is stored, and the range of norms for each subtree.
3. Positives: the sample gives a lower bound of the last positive's score. A query's windows of scores are annuli around it; a
   subtree is eliminated when, for some split point, its stored range does not meet the distances that the annulus allows.
4. The leaves that are left are searched exactly: a leaf is blocks of bounded size, and a task holds one block and a bounded
   part of the queries. 5. Negatives: the same search with one window for each of a query's positives.

Elimination is as strong as the vectors' intrinsic dimension lets it be; what is left is compared in blocks, exactly.

Rows that take no part: a null vec_id, label or vector, a null or non-finite component, or one beyond LARGEST after scaling
(sums of products would leave 64 bits). An empty vector has only zero components; of vectors of unequal length the missing components
count as 0. Rows that repeat in vec_id, label and vector count once; other rows of one vec_id each take part, and `other rows` are those
of another vec_id. Ties go to the smaller vec_id. An anchor without positives, or a positive without rows in its window, gives
no rows; an empty table gives none. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.workspace import Rounds

SCALE = 256
LARGEST = 1 << 26
#: an anchor has at most FOLD - 1 positives, so of equal rows it needs FOLD, itself included
POSITIVES, NEGATIVES = 5, 3
FOLD = POSITIVES + 1
#: rows from which split points are chosen and first bounds are taken; every row is indexed
SAMPLE_ROWS = 20_000
FANOUT = 16
#: rows of a leaf that is not split further, of a block, and queries that meet a block at a time
LEAF_ROWS, BLOCK_ROWS, QUERY_PART = 20_000, 20_000, 50_000
DEEPEST = 3
#: scores that are held at a time
HELD_SCORES = 2_000_000
#: copies of a query's result over which its anchors are dealt
SALTS = 8
LOW, HIGH = -(1 << 62), 1 << 62


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that take part, with their vector as bytes: item size, then the integers."""
    for batch in batches:
        column = batch.column(2)
        offsets = np.asarray(column.offsets).astype(np.int64)
        flat = column.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
        with np.errstate(invalid="ignore", over="ignore"):
            x = np.floor(SCALE * x)
            bad = ~(np.abs(x) <= LARGEST)
        wrong = np.concatenate([[0], np.cumsum(bad)])
        ok = np.asarray(column.is_valid()) & (wrong[offsets[1:]] == wrong[offsets[:-1]])
        x = np.where(bad, 0, x).astype(np.int32)
        vectors = []
        for i in np.flatnonzero(ok).tolist():
            own = x[offsets[i] : offsets[i + 1]]
            small = not len(own) or np.abs(own).max() < 1 << 15
            vectors.append(b"\x02" + own.astype("<i2").tobytes() if small else b"\x04" + own.astype("<i4").tobytes())
        rows = batch.filter(pa.array(ok))
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), pa.array(vectors, pa.binary())], ["vec_id", "label", "vector"]
        )


def matrix(column) -> np.ndarray:
    """Integer rows of encoded vectors, filled up with zeros."""
    rows = column.to_pylist()
    if not rows:
        return np.zeros((0, 0), np.int64)
    if len({(len(r), r[0]) for r in rows}) == 1:
        size = rows[0][0]
        return np.frombuffer(b"".join(r[1:] for r in rows), f"<i{size}").reshape(len(rows), -1).astype(np.int64)
    parts = [np.frombuffer(r, f"<i{r[0]}", offset=1) for r in rows]
    out = np.zeros((len(rows), max(map(len, parts))), np.int64)
    for i, part in enumerate(parts):
        out[i, : len(part)] = part
    return out


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in floating point where every partial sum is an exact number."""
    width = max(a.shape[1], b.shape[1])
    a, b = _widened(a, width), _widened(b, width)
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    # no partial sum of products exceeds the product of the norms
    most = np.sqrt((a.astype(float) ** 2).sum(axis=1).max() * (b.astype(float) ** 2).sum(axis=1).max())
    for kind, exact in ((np.float32, 1 << 24), (np.float64, 1 << 52)):
        if most < exact:
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    return a @ b.T


def norms(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.float64) ** 2).sum(axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = norms(a)[:, None] + norms(b)[None, :] - 2.0 * products(a, b).astype(np.float64)
    return np.sqrt(np.maximum(square, 0))


class Tree:
    """Split points by node; `child[node][i]` is a node, or -1 - leaf. Ranges are set once all rows are indexed."""

    def __init__(self, sample: np.ndarray, rows: int, fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS, deepest: int = DEEPEST):
        self.points: list[np.ndarray] = []
        self.child: list[list[int]] = []
        self.leaves = 0
        depth = 1
        while depth < deepest and rows / fanout**depth > leaf_rows:
            depth += 1
        self.root = self._grown(np.unique(sample, axis=0), depth, fanout)
        self.low = self.high = self.norms = None
        self.blocks = np.ones(self.leaves, np.int64)

    def _grown(self, sample: np.ndarray, depth: int, fanout: int) -> int:
        if not depth or len(sample) < 2:
            self.leaves += 1
            return -self.leaves
        # each next split point is the one farthest from those chosen
        chosen = [0]
        nearest = distances(sample, sample[:1])[:, 0]
        while len(chosen) < min(fanout, len(sample)):
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, distances(sample, sample[chosen[-1:]])[:, 0])
        points = sample[chosen]
        node = len(self.points)
        self.points.append(points)
        self.child.append([])
        owner = distances(sample, points).argmin(axis=1)
        self.child[node] = [self._grown(sample[owner == i], depth - 1, fanout) for i in range(len(points))]
        return node

    def walk(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(node, rows that reach it, their distances to its split points, number of the nearest) from the root on."""
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0 or not len(rows):
                continue
            away = distances(x[rows], self.points[node])
            nearest = away.argmin(axis=1)
            yield node, rows, away, nearest
            todo += [(c, rows[nearest == i]) for i, c in enumerate(self.child[node])]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        leaf = np.zeros(len(x), np.int64)
        for node, rows, _, nearest in self.walk(x):
            leaf[rows] = -1 - np.array(self.child[node])[nearest]
        return np.maximum(leaf, 0)

    def set_ranges(self, found) -> None:
        """found: (node, split point, sibling, low, high); the split point -1 stands for squared norms."""
        width = max([len(p) for p in self.points], default=1)
        shape = (len(self.points), width, width)
        self.low, self.high = np.full(shape, np.inf), np.full(shape, -np.inf)
        self.norms = np.stack([np.full(shape[:2], np.inf), np.full(shape[:2], -np.inf)])
        for node, i, j, low, high in found:
            if i < 0:
                self.norms[:, node, j] = low, high
            else:
                self.low[node, i, j], self.high[node, i, j] = low, high

    def open_leaves(self, x: np.ndarray, least: np.ndarray, most: np.ndarray) -> list[np.ndarray]:
        """By leaf, the queries of which a window may hold rows there; least, most: scores by (query, window), empty if least > most."""
        found: list[list[np.ndarray]] = [[] for _ in range(self.leaves)]
        own = norms(x)
        todo = [(self.root, np.flatnonzero((least <= most).any(axis=1)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                found[-1 - node].append(rows)
                continue
            away = distances(x[rows], self.points[node])
            for j, child in enumerate(self.child[node]):
                smallest, largest = self.norms[:, node, j]
                if smallest > largest:
                    continue
                # squared distance = both squared norms - 2 * score
                outer = own[rows, None] + largest - 2.0 * least[rows]
                inner = own[rows, None] + smallest - 2.0 * most[rows]
                live = (least[rows] <= most[rows]) & (outer >= 0)
                outer, inner = np.sqrt(np.maximum(outer, 0)) * (1 + 1e-9) + 1e-3, np.sqrt(np.maximum(inner, 0)) * (1 - 1e-9) - 1e-3
                for i in range(len(self.points[node])):
                    at = away[:, i, None]
                    begin = np.maximum(np.maximum(self.low[node, i, j] - 1e-3, at - outer), inner - at)
                    live &= begin <= np.minimum(self.high[node, i, j] + 1e-3, at + outer)
                todo.append((child, rows[live.any(axis=1)]))
        return [np.concatenate(f) if f else np.zeros(0, np.int64) for f in found]


def _best(scores: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k highest scores of each row that fit; of equal ones the first columns."""
    held = np.where(fits, scores, LOW)
    out = []
    at = np.arange(len(held))
    for _ in range(min(k, held.shape[1])):
        best = held.argmax(axis=1)
        value = held[at, best]
        ok = value > LOW
        if not ok.any():
            break
        out.append((at[ok], best[ok], value[ok]))
        held[at, best] = LOW
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _bounds(scores: np.ndarray, same: np.ndarray, least: np.ndarray, most: np.ndarray, k: int) -> np.ndarray:
    """`least`, raised to the k-th highest score inside the window among these columns, where there are k of them."""
    out = least.copy()
    for w in range(least.shape[1]):
        row, _, value = _best(scores, same & (scores >= least[:, w, None]) & (scores <= most[:, w, None]), k)
        full = np.bincount(row, minlength=len(scores)) == k
        lowest = np.full(len(scores), HIGH)
        np.minimum.at(lowest, row, value)
        out[full, w] = lowest[full]
    return out


def _windows_of(batch) -> tuple[np.ndarray, np.ndarray]:
    lists = [batch.column(name).to_pylist() for name in ("least", "most")]
    width = max((len(v) for v in lists[0]), default=0)
    least, most = np.full((batch.num_rows, width), 1, np.int64), np.zeros((batch.num_rows, width), np.int64)
    for i, (a, b) in enumerate(zip(*lists, strict=True)):
        least[i, : len(a)], most[i, : len(b)] = a, b
    return least, most


def _routed(shared, k: int, same_label: bool):
    """Queries (query, label, vector, least, most) sent to the blocks of the leaves that are left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, sample, sample_labels = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, step := max(1, HELD_SCORES // max(1, len(sample)))):
                batch = whole.slice(lo, step)
                x, (least, most) = matrix(batch.column(2)), _windows_of(batch)
                agree = np.asarray(batch.column(1))[:, None] == sample_labels[None, :]
                raised = _bounds(products(x, sample), agree if same_label else ~agree, least, most, k)
                for leaf, rows in enumerate(tree.open_leaves(x, raised, most)):
                    for block in range(int(tree.blocks[leaf]) if len(rows) else 0):
                        some = batch.take(pa.array(rows))
                        kept = [pa.array([r[: len(b)] for r, b in zip(raised[rows].tolist(), some.column(4).to_pylist(), strict=True)], pa.list_(pa.int64()))]
                        cell = pa.array(np.full(len(rows), (leaf << 32) + block))
                        yield pa.RecordBatch.from_arrays(
                            [cell, some.column(0), some.column(1), some.column(2), *kept, some.column(4)],
                            ["cell", "query", "label", "vector", "least", "most"],
                        )

    return run


_FOUND = "query string, label int, window int, vec_id long, score long"


def _searched(k: int, same_label: bool):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and queries.num_rows:
            rows = rows.sort_by("vec_id")
            y, labels = matrix(rows.column("vector")), np.asarray(rows.column("label"))
            ids = np.asarray(rows.column("vec_id"))
            for lo in range(0, queries.num_rows, step := max(1, HELD_SCORES // len(y))):
                some = queries.slice(lo, step)
                x, (least, most) = matrix(some.column("vector")), _windows_of(some)
                scores = products(x, y)
                agree = np.asarray(some.column("label"))[:, None] == labels[None, :]
                agree = agree if same_label else ~agree
                for w in range(least.shape[1]):
                    row, at, value = _best(scores, agree & (scores >= least[:, w, None]) & (scores <= most[:, w, None]), k)
                    own = some.select(["query", "label"]).take(pa.array(row))
                    out.append([*own.columns, pa.array(np.full(len(row), w, np.int32)), pa.array(ids[at]), pa.array(value)])
        names = ["query", "label", "window", "vec_id", "score"]
        if not out:
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            return pa.table([pa.array([], kind) for kind in kinds], names)
        return pa.concat_tables([pa.table(c, names) for c in out])

    return run


def _ranges(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value[0]
        low: dict[tuple[int, int, int], float] = {}
        high: dict[tuple[int, int, int], float] = {}
        for batch in batches:
            x = matrix(batch.column(0))
            square = norms(x)
            for node, rows, away, nearest in tree.walk(x):
                for j in np.unique(nearest).tolist():
                    own = nearest == j
                    spans = [(i, away[own, i]) for i in range(away.shape[1])] + [(-1, square[rows[own]])]
                    for i, values in spans:
                        key = (node, i, j)
                        low[key] = min(low.get(key, np.inf), float(values.min()))
                        high[key] = max(high.get(key, -np.inf), float(values.max()))
        keys = list(low)
        columns = [pa.array([k[c] for k in keys], pa.int32()) for c in range(3)]
        values = [pa.array([side[k] for k in keys], pa.float64()) for side in (low, high)]
        yield pa.RecordBatch.from_arrays([*columns, *values], ["node", "point", "sibling", "low", "high"])

    return run


def _leaves(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value[0]
        for batch in batches:
            leaf = tree.leaf_of(matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["vec_id", "label", "vector", "leaf"])

    return run


class Index:
    """All rows (vec_id, label, vector) by leaf and block, the tree with the ranges over all of them, and the sample."""

    def __init__(self, rows: DataFrame, rounds: Rounds, fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS):
        context = rows.sparkSession.sparkContext
        # at most SAMPLE_ROWS rows
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label").limit(SAMPLE_ROWS).select("label", "vector").toArrow()
        points, labels = matrix(sample.column("vector")), np.asarray(sample.column("label")).astype(np.int64)
        tree = Tree(points, rows.count(), fanout, leaf_rows)
        shared = context.broadcast((tree, points, labels))
        placed = rows.select("vec_id", "label", "vector").mapInArrow(_leaves(shared), "vec_id long, label int, vector binary, leaf long")
        self.rows = rounds.save(placed, "leaves")
        shape = "node int, point int, sibling int, low double, high double"
        ranges = self.rows.select("vector").mapInArrow(_ranges(shared), shape).groupBy("node", "point", "sibling")
        # at most FANOUT + 1 rows for each child of the tree
        tree.set_ranges([tuple(r) for r in ranges.agg(F.min("low"), F.max("high")).collect()])
        for leaf, n in self.rows.groupBy("leaf").count().collect():
            tree.blocks[leaf] = -(-n // block_rows)
        self.blocks = F.array(*[F.lit(int(b)) for b in tree.blocks])
        # split points, ranges and sample: bounded by FANOUT, DEEPEST and SAMPLE_ROWS
        self.shared = context.broadcast((tree, points, labels))

    def search(self, queries: DataFrame, parts: int, k: int, same_label: bool) -> DataFrame:
        """The k best rows of each window of queries(query, label, vector, least, most): query, label, window, vec_id, score, nth."""
        spark = queries.sparkSession
        shape = "cell long, query string, label int, vector binary, least array<long>, most array<long>"
        routed = queries.select("query", "label", "vector", "least", "most").mapInArrow(_routed(self.shared, k, same_label), shape)
        routed = routed.withColumn("part", F.pmod(F.xxhash64("query", "label"), F.lit(parts)))
        block = F.pmod(F.xxhash64("vec_id"), F.element_at(self.blocks, F.col("leaf").cast("int") + 1))
        cells = self.rows.withColumn("cell", F.shiftleft("leaf", 32) + block).drop("leaf")
        cells = cells.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        # few bytes, much work: a fixed number of tasks that is not reduced
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        left, right = (df.repartition(tasks, "cell", "part").groupBy("cell", "part") for df in (cells, routed))
        found = left.cogroup(right).applyInArrow(_searched(k, same_label), _FOUND)
        order = W.partitionBy("query", "label", "window").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)


def hard_negatives(
    embeddings: DataFrame,
    anchors_every: int = 50,
    relabel_every: int = 7,
    fanout: int = FANOUT,
    leaf_rows: int = LEAF_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """embeddings(vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rounds = Rounds(embeddings.sparkSession, "hard-negatives")
    label = F.col("label").cast("int")
    moved = F.when(F.col("vec_id").cast("long") % relabel_every == 0, (label + 1) % 10).otherwise(label)
    raw = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    raw = raw.filter("vec_id is not null and label is not null and x is not null")
    encoded = raw.mapInArrow(_encoded, "vec_id long, label int, vector binary").withColumn("query", F.md5("vector"))
    whole = rounds.save(encoded.groupBy("query", "label", "vec_id").agg(F.first("vector").alias("vector")), "rows")
    copies = W.partitionBy("query", "label").orderBy("vec_id")
    folded = whole.withColumn("_nth", F.row_number().over(copies)).filter(F.col("_nth") <= FOLD).drop("_nth", "query")
    folded = rounds.save(folded, "folded")
    index = Index(folded, rounds, fanout, leaf_rows, block_rows)
    anchors = whole.filter(F.col("vec_id") % anchors_every == 0)
    queries = rounds.save(anchors.groupBy("query", "label").agg(F.first("vector").alias("vector")), "queries")
    parts = max(1, -(-queries.count() // QUERY_PART))
    wide = lambda v: F.array(F.lit(v).cast("long"))
    positives = index.search(queries.withColumn("least", wide(LOW + 1)).withColumn("most", wide(HIGH)), parts, FOLD, True)
    positives = rounds.save(positives.select("query", "label", "vec_id", "score", "nth"), "positives")
    scores = positives.filter("score >= 0").groupBy("query", "label").agg(F.sort_array(F.collect_set("score")).alias("scores"))
    half = lambda s: F.call_function("div", s + 1, F.lit(2))
    windows = (
        queries.join(scores, ["query", "label"])
        .withColumn("least", F.transform("scores", half))
        .withColumn("most", F.transform("scores", lambda s: F.call_function("div", s * 95, F.lit(100))))
    )
    negatives = index.search(windows, parts, NEGATIVES, False)
    negatives = negatives.join(scores, ["query", "label"]).select(
        "query", "label", F.element_at("scores", F.col("window") + 1).alias("score"), "vec_id", F.col("score").alias("negative_score"), "nth"
    )
    negatives = negatives.groupBy("query", "label", "score").agg(
        F.sort_array(F.collect_list(F.struct("nth", F.col("vec_id").alias("negative_id"), "negative_score"))).alias("negatives")
    )
    # at most FOLD positives with NEGATIVES negatives each
    mined = positives.join(negatives, ["query", "label", "score"], "left").groupBy("query", "label")
    mined = mined.agg(F.sort_array(F.collect_list(F.struct("nth", F.col("vec_id").alias("positive_id"), "score", "negatives"))).alias("mined"))
    mined = mined.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = anchors.select("query", "label", F.col("vec_id").alias("anchor_id"))
    asked = asked.withColumn("_salt", F.pmod(F.xxhash64("anchor_id"), F.lit(SALTS)).cast("int"))
    joined = asked.join(mined, ["query", "label", "_salt"])
    others = F.slice(F.filter("mined", lambda m: m["positive_id"] != F.col("anchor_id")), 1, POSITIVES)
    pairs = joined.select("anchor_id", F.explode(others).alias("m"))
    rows = pairs.select("anchor_id", F.col("m.positive_id"), F.col("m.score").alias("positive_score"), F.explode("m.negatives").alias("n"))
    return rows.select(
        "anchor_id",
        "positive_id",
        F.col("n.nth").alias("rank"),
        F.col("n.negative_id"),
        "positive_score",
        F.col("n.negative_score"),
    )
