"""Jaccard self-join of documents on word n-grams, by T-occurrence search.

Steps
1. Each text becomes the set of its n-gram hashes (64 bits). Equal sets are one node from here on.
2. Which sets can meet: a level bounds the set size by U, so linked sets differ in at most D n-grams. They are dealt by
   hash into D + T segments, at least T segments are equal, and equal segments of at least one n-gram share a key. A set
   with T or more empty segments is dealt anew with the next salt, so an equal segment that is not empty always exists.
   Frequent n-grams alone make no key: a key holds all n-grams of a segment.
   Below a similarity of about 0.65 the smallest sets of a level cannot fill that many segments; there, a set's keys are its
   n-grams of a prefix, in one order of all n-grams, that is so long that linked sets share one of them.
3. Nodes that share keys form candidate groups. A group's n-gram sets are searched in blocks of bounded size by DivideSkip:
   the shortest inverted lists are merged, the long ones probed by binary search for the merged candidates only, and sets
   that reach the required overlap T are linked. Nodes that are linked already are not compared again.
4. A group wider than a block may hang together by chance: long texts that share a passage share a key here and there. Each n-gram of
   such groups is counted, and a node goes that has fewer n-grams in common with all others than it needs in common with one; the
   keys of those left make the groups anew. Keys and n-grams are dealt by hash, so this grows with the texts of wide groups only.
5. Groups that are still large are dealt by size, as a set can be linked with its own and neighbouring levels only, then by hash into blocks. Every block also holds the
   group's first node; only nodes that their block does not link to it are carried to the other blocks of their own level and of
   those below and above that linked sets can be in.

Nulls: a null, empty or blank text has no n-grams and is linked with nothing. Rows with a null doc_id are returned with a
null component. Repeated rows are returned as often as they come. Ties do not exist: links are symmetric and a component
takes its smallest doc_id. Further columns of the input are ignored. Texts of any length are used whole.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.words import Words, mix64, window_hashes, word_runs
from tidewire.operators.greedy import components
from tidewire.workspace import Rounds

#: ratio of the size bounds of neighbouring levels
GROWTH = 1.4
#: segments beyond the necessary ones, as a share of them; so many may consist of frequent n-grams alone
SPARE = 0.3
#: n-grams in at least FREQUENT of about SAMPLE documents count as frequent; this steers the work, never the result
SAMPLE, FREQUENT, MOST_FREQUENT = 20_000, 4, 1_000_000
#: n-grams of a block of a candidate group
BLOCK_NGRAMS = 1_000_000


def needed(a: int, b, num: int, den: int):
    """Smallest overlap at which sets of sizes a and b reach the similarity num/den."""
    return -(-num * (a + b) // (num + den))


@lru_cache(None)
def _levels(num: int, den: int) -> list[tuple[int, int, int]]:
    """(U, segments, T) by level."""
    out, upper = [], 1
    while upper < 1 << 34:
        differ = 2 * upper * (den - num) // (den + num)
        # the smallest set at this level is one that a linked one of the level below makes come here as well
        t, smallest = 1, max(1.0, upper * num / den / GROWTH)
        for _ in range(8):
            empty = (differ + t) * math.exp(-smallest / (differ + t))
            t = min(1 + math.ceil(empty + math.sqrt(empty)), 2 + differ // 4) if differ else 1
            t = max(t, math.ceil(SPARE * differ))
        out.append((upper, differ + t, t))
        upper = max(upper + 1, int(upper * GROWTH))
    return out


@lru_cache(None)
def _fillable(level: int, num: int, den: int) -> bool:
    """Whether a deal of the level's smallest set fills enough segments, at least about every second time."""
    _, segments, t = _levels(num, den)[level]
    below = _levels(num, den)[level - 1][0] if level else 0
    smallest = max(1, -(-(below + 1) * num // den))
    empty = segments * (1 - 1 / segments) ** smallest
    return segments == t or (smallest > segments - t and empty <= t - 1)


@lru_cache(1 << 16)
def _level_of(n: int, num: int, den: int) -> int:
    return next(i for i, (upper, _, _) in enumerate(_levels(num, den)) if upper >= n)


def ngram_sets(words: Words, n: int, lower: bool) -> Iterator[np.ndarray]:
    """The sorted n-gram hashes of each row; a text of fewer words is one n-gram as a whole."""
    hashes = words.hashes(lower)
    grams = window_hashes(hashes, n)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield window_hashes(hashes[a:b], b - a, salt=1)
        else:
            yield hashes[:0]


def set_key(grams: np.ndarray) -> int:
    total = mix64(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(grams))
    return int(mix64(total[None])[0].view(np.int64))


def segment_keys(grams: np.ndarray, rare: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the segments with a rare n-gram; of the others too if they are T or more.

    Of two linked sets at least T segments are equal. If either has fewer than T segments without a rare n-gram, one
    of the equal segments has one, in both sets; else both sets have the keys of all their segments.
    """
    n, found = len(grams), []
    values = mix64(grams ^ np.uint64(0x2545F4914F6CDD1D))
    levels = range(_level_of(n, num, den), _level_of(n * den // num, num, den) + 1)
    if not all(_fillable(level, num, den) for level in levels):
        # of linked sets, each holds an n-gram of the other's prefix: all but one less than the least overlap, rare ones first
        order = np.lexsort((values, ~rare))
        found.append(mix64(values[order[: n - -(-num * n // den) + 1]]))
    for level in levels:
        if not _fillable(level, num, den):
            continue
        _, segments, t = _levels(num, den)[level]
        salt = 0
        while True:
            mark = mix64(np.array([level * 1_000_003 + salt + 1], np.uint64))
            at = ((mix64(grams ^ mark) >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
            order = np.argsort(at, kind="stable")
            at = at[order]
            begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            keys = mix64(np.add.reduceat(values[order], begin) + mix64(at[begin] + mark))
            strong = np.maximum.reduceat(rare[order], begin)
            found.append(keys[strong] if segments - strong.sum() < t else keys)
            if segments - len(begin) < t:
                break
            salt += 1
    return np.concatenate(found).view(np.int64)


def _digests(n: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_runs(batch.column(1)):
                sizes, keys = [], []
                for grams in ngram_sets(words, n, lower):
                    sizes.append(len(grams))
                    keys.append(set_key(grams) if len(grams) else None)
                own = batch.column(0).slice(words.row, len(words))
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())], ["doc_id", "n_shingles", "node"]
                )

    return run


def _node_keys(texts: Iterator[pa.Array], n: int, num: int, den: int, lower: bool, frequent: np.ndarray):
    """(keys, node of each key) of the texts' sets, a run of texts at a time; a run's repeated sets once."""
    for column in texts:
        for words in word_runs(column):
            keys, nodes, seen = [], [], set()
            for grams in ngram_sets(words, n, lower):
                node = set_key(grams) if len(grams) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
                keys.append(segment_keys(grams, frequent[at] != grams, num, den))
                nodes.append(np.full(len(keys[-1]), node, np.int64))
            if keys:
                yield np.concatenate(keys), np.concatenate(nodes)


def frequent_ngrams(texts: DataFrame, n: int, lower: bool) -> np.ndarray:
    """Sorted hashes of frequent n-grams, at most MOST_FREQUENT; a last entry keeps the array from being empty."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_runs(batch.column(0)):
                for grams in ngram_sets(words, n, lower):
                    yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], ["gram"])

    share = max(1, texts.count() // SAMPLE)
    some = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("text")
    counts = some.mapInArrow(sets, "gram long").groupBy("gram").count().filter(F.col("count") >= FREQUENT)
    found = counts.orderBy(F.desc("count"), "gram").limit(MOST_FREQUENT).select("gram").toArrow().column(0)
    return np.append(np.unique(np.asarray(found).astype(np.int64).view(np.uint64)), np.uint64(2**64 - 1))


class Block:
    """Inverted lists of a bounded number of sets, in ascending order of size."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        grams = np.concatenate(sets)
        self.vocabulary, token = np.unique(grams, return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.tokens = np.split(token, np.cumsum(self.sizes)[:-1])
        self.width = len(sets)
        # ascending (list, member): one array serves all lists and all binary probes
        self.entries = np.sort(token.astype(np.int64) * self.width + owner)
        self.begin = np.searchsorted(self.entries, np.arange(len(self.vocabulary) + 1) * self.width)
        self.length = np.diff(self.begin)

    def tokens_of(self, grams: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, grams), len(self.vocabulary) - 1)
        return at[self.vocabulary[at] == grams]

    def _merged(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members of these lists and in how many of them each one is."""
        runs = [self.entries[self.begin[t] : self.begin[t + 1]] - t * self.width for t in lists]
        if not runs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if sum(map(len, runs)) <= 256:
            merged = np.fromiter(heapq.merge(*(r.tolist() for r in runs)), np.int64)
            new = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))
            return merged[new], np.diff(np.append(new, len(merged)))
        return np.unique(np.concatenate(runs), return_counts=True)

    def search(self, size: int, tokens: np.ndarray, num: int, den: int, allowed) -> Iterator[int]:
        """Members that reach the required overlap with a set of `size` n-grams, of which `tokens` are in the lists.

        allowed: members -> mask of those still worth a comparison; asked again after each find.
        """
        least = needed(size, -(-num * size // den), num, den)
        if len(tokens) < least:
            return
        order = tokens[np.argsort(self.length[tokens], kind="stable")]
        short = max(len(tokens) - least + 1, int(np.searchsorted(self.length[order], 8, side="right")))
        members, counts = self._merged(order[:short])
        long = order[short:]
        other = self.sizes[members]
        least_each = needed(size, other, num, den)
        fits = (den * np.minimum(size, other) >= num * np.maximum(size, other)) & (counts + len(long) >= least_each)
        members, counts, least_each = members[fits], counts[fits], least_each[fits]
        best = np.argsort(-counts, kind="stable")
        members, counts, least_each = members[best], counts[best], least_each[best]
        step = 1
        while len(members):
            keep = allowed(members)
            members, counts, least_each = members[keep], counts[keep], least_each[keep]
            some, have, least_some = members[:step], counts[:step].copy(), least_each[:step]
            for lo in range(0, len(long), 64):
                lists = long[lo : lo + 64]
                probes = (lists[:, None] * self.width + some).ravel()
                at = np.minimum(np.searchsorted(self.entries, probes), len(self.entries) - 1)
                have += (self.entries[at] == probes).reshape(len(lists), len(some)).sum(axis=0)
                alive = have + max(0, len(long) - lo - 64) >= least_some
                some, have, least_some = some[alive], have[alive], least_some[alive]
                if not len(some):
                    break
            yield from some[have >= least_some].tolist()
            members, counts, least_each = members[step:], counts[step:], least_each[step:]
            step = min(4 * step, 4096)


class _Linked:
    """Labels of linked members; the smaller side takes the other's label."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members = {i: [i] for i in range(n)}

    def join(self, a: int, b: int) -> None:
        a, b = int(self.label[a]), int(self.label[b])
        if a == b:
            return
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        self.label[moved] = a
        self.members[a] += moved


def _sets_of(table: pa.Table, n: int, lower: bool) -> dict[int, np.ndarray]:
    """n-gram sets of a group's rows by node; rows whose text is another one under the same doc_id are left out."""
    nodes, out, i = table.column("node").to_pylist(), {}, 0
    for words in word_runs(table.column("text").combine_chunks()):
        for grams in ngram_sets(words, n, lower):
            if len(grams) and set_key(grams) == nodes[i]:
                out[nodes[i]] = grams
            i += 1
    return out


_EDGES = "root long, chunk long, node long, peer long, apart boolean"


def _edge_table(root, chunk, nodes, peers, apart) -> pa.Table:
    count = len(nodes)
    return pa.table(
        {
            "root": pa.array([root] * count, pa.int64()),
            "chunk": pa.array([chunk] * count, pa.int64()),
            "node": pa.array(nodes, pa.int64()),
            "peer": pa.array(peers, pa.int64()),
            "apart": pa.array(apart, pa.bool_()),
        }
    )


def _within(n: int, num: int, den: int, lower: bool):
    """Links inside a block; `apart`: not linked, inside this block, to the group's first node."""

    def run(table: pa.Table) -> pa.Table:
        root, chunk = table.column("root")[0].as_py(), table.column("chunk")[0].as_py()
        by_node = _sets_of(table, n, lower)
        nodes = sorted(by_node, key=lambda k: (len(by_node[k]), k))
        if not nodes:
            return _edge_table(root, chunk, [], [], [])
        block, linked = Block([by_node[k] for k in nodes]), _Linked(len(nodes))
        for i in range(len(nodes)):
            open_ = lambda found, i=i: (found < i) & (linked.label[found] != linked.label[i])
            for j in block.search(len(block.tokens[i]), block.tokens[i], num, den, open_):
                linked.join(i, j)
        first = linked.label[nodes.index(root)] if root in by_node else -1
        peers = [nodes[k] for k in linked.label.tolist()]
        return _edge_table(root, chunk, nodes, peers, (linked.label != first).tolist())

    return run


def _across(n: int, num: int, den: int, lower: bool):
    """Links between a block's members and nodes carried from other blocks."""

    def run(table: pa.Table) -> pa.Table:
        root, chunk = table.column("root")[0].as_py(), table.column("chunk")[0].as_py()
        carried = np.asarray(table.column("carried").combine_chunks().cast(pa.uint8())).astype(bool)
        members = _sets_of(table.filter(pa.array(~carried)), n, lower)
        queries = _sets_of(table.filter(pa.array(carried)), n, lower)
        nodes = sorted(members, key=lambda k: (len(members[k]), k))
        left, right = [], []
        if nodes:
            block = Block([members[k] for k in nodes])
            for node, grams in queries.items():
                tokens = block.tokens_of(grams)
                for j in block.search(len(grams), tokens, num, den, lambda found: np.ones(len(found), bool)):
                    left.append(node)
                    right.append(nodes[j])
        return _edge_table(root, chunk, left, right, [False] * len(left))

    return run


#: (key, node) pairs that are grouped at a time
PAIRS = 2_000_000


#: rows of ids and numbers, about 50 bytes each, that are broadcast
BROADCAST_ROWS = 1_000_000
#: keys are dealt to this many buckets per partition, which are grouped one after the other
BUCKETS = 4

#: bytes of a key beside its bucket, and of a node, in packed rows: keys that agree in them only add a candidate; linked nodes that do,
#: with odds of 2 ** -48 a link, are not found by each other
PACKED_BYTES = 6
_PACKED = "bucket int, linked boolean, a binary, b binary"


def _short(values: np.ndarray) -> np.ndarray:
    """The bits of nodes that packed rows hold."""
    return values & np.int64((1 << 8 * PACKED_BYTES) - 1)


def _to_bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :PACKED_BYTES]).tobytes()


def _from_bytes(raw: bytes) -> np.ndarray:
    values = np.zeros((len(raw) // PACKED_BYTES, 8), np.uint8)
    values[:, :PACKED_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, PACKED_BYTES)
    return values.view("<i8").ravel().astype(np.int64)


def _packed_rows(linked: bool, by: np.ndarray, other: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Pairs by bucket of the first number: the bucket has its high bits, more or less, and the row its low ones."""
    if not len(by):
        return
    mixed = mix64(by.view(np.uint64))
    bucket = (((mixed >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
    by = by if linked else mixed.view(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, by, other = bucket[order], by[order], other[order]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True):
        columns = [pa.array([bucket[lo]], pa.int32()), pa.array([linked])]
        columns += [pa.array([_to_bytes(x[lo:hi])], pa.binary()) for x in (by, other)]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "linked", "a", "b"])


def _first_of_keys(keys: np.ndarray, nodes: np.ndarray):
    """(keys, smallest node of each, nodes that share a key with a smaller one, that one); the latter two without repeats."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.append(True, keys[1:] != keys[:-1])
    first = nodes[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
    apart = nodes != first
    left, right = nodes[apart], first[apart]
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    fresh = np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1]))[: len(left)]
    return keys[new], nodes[new], left[fresh], right[fresh]


def _packed(sets, buckets: int):
    """Keys with their smallest node, and links of nodes, packed by bucket; a key goes on once per run of PAIRS rows.

    sets: texts -> (keys, nodes). A key that most documents share is a few numbers a task.
    """

    def flush(held) -> Iterator[pa.RecordBatch]:
        keys, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, nodes, left, right = _first_of_keys(keys, _short(nodes))
        yield from _packed_rows(False, keys, nodes, buckets)
        yield from _packed_rows(True, left, right, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for pairs in sets(b.column(0) for b in batches):
            held.append(pairs)
            size += len(pairs[0])
            if size >= PAIRS:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from every node of a key to the smallest one; rows come bucket by bucket."""

    def rows(nodes, peers) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(peers)], ["node", "peer"])

    held, current = [], None
    for batch in batches:
        for bucket, linked, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pair = _from_bytes(a), _from_bytes(b)
            if linked:
                yield rows(*pair)
                continue
            if bucket != current and held:
                yield rows(*_first_of_keys(*(np.concatenate(x) for x in zip(*held, strict=True)))[2:])
                held = []
            current = bucket
            held.append(pair)
    if held:
        yield rows(*_first_of_keys(*(np.concatenate(x) for x in zip(*held, strict=True)))[2:])


def _packed_ngrams(n: int, lower: bool, buckets: int):
    """N-grams of the rows' sets with their node, packed by bucket; a node's n-gram once per run of PAIRS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            yield from _packed_rows(False, *(np.concatenate(x) for x in zip(*held, strict=True)), buckets)

        for batch in batches:
            roots, nodes, seen = batch.column(0).to_pylist(), batch.column(1).to_pylist(), set()
            i = 0
            for words in word_runs(batch.column(2)):
                for grams in ngram_sets(words, n, lower):
                    # rows whose text is another one under the same doc_id are left out
                    if len(grams) and set_key(grams) == nodes[i] and nodes[i] not in seen:
                        seen.add(nodes[i])
                        # groups are counted apart
                        group = mix64(np.array([roots[i]], np.int64).view(np.uint64))
                        held.append(((grams ^ group).view(np.int64), np.full(len(grams), _short(np.int64(nodes[i])), np.int64)))
                        size += len(grams)
                    i += 1
                    if size >= PAIRS:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, how many of its n-grams of a bucket another node has as well); rows come bucket by bucket."""

    def rows(held) -> pa.RecordBatch:
        grams, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((nodes, grams))
        grams, nodes = grams[order], nodes[order]
        fresh = np.append(True, (grams[1:] != grams[:-1]) | (nodes[1:] != nodes[:-1]))
        grams, nodes = grams[fresh], nodes[fresh]
        same = grams[1:] == grams[:-1]
        found, counts = np.unique(nodes[np.append(same, False) | np.append(False, same)], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts.astype(np.int64))], ["short", "shared"])

    held, current = [], None
    for batch in batches:
        for bucket, _, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != current and held:
                yield rows(held)
                held = []
            current = bucket
            held.append((_from_bytes(a), _from_bytes(b)))
    if held:
        yield rows(held)


def _by_bucket(packed: DataFrame, parts: int) -> DataFrame:
    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket")


def _grouped(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """The nodes that edges(node, peer) between their short forms connect with others, with the smallest node of their group as root."""
    groups = _roots(edges, name).withColumnsRenamed({"node": "short", "root": "_group"})
    short = F.col("node").bitwiseAND(F.lit((1 << 8 * PACKED_BYTES) - 1))
    placed = nodes.drop("root").withColumn("short", short).join(groups, "short").drop("short")
    heads = placed.groupBy("_group").agg(F.min("node").alias("root"))
    return placed.join(heads, "_group").drop("_group")


def _without_chance(texts: DataFrame, nodes: DataFrame, sets, n: int, num: int, den: int, lower: bool, rounds: Rounds) -> DataFrame:
    """nodes (node, root, doc_id, n_shingles) with groups wider than a block made anew, without those that no other set there can be linked with."""
    wide = nodes.groupBy("root").agg(F.sum("n_shingles").alias("_all")).filter(F.col("_all") > BLOCK_NGRAMS).select("root")
    inside = rounds.save(nodes.join(wide, "root", "left_semi"), "wide")
    count = inside.count()
    if not count:
        return nodes
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def of(some: DataFrame) -> DataFrame:
        return texts.join(_sized(some.select("doc_id", "root", "node"), count), "doc_id").select("root", "node", "text")

    packed = of(inside).mapInArrow(_packed_ngrams(n, lower, BUCKETS * parts), _PACKED)
    shared = _by_bucket(packed, parts).mapInArrow(_counted, "short long, shared long").groupBy("short").agg(F.sum("shared").alias("shared"))
    short = F.col("node").bitwiseAND(F.lit((1 << 8 * PACKED_BYTES) - 1))
    left = inside.withColumn("short", short).join(shared, "short").filter(F.col("shared") * den >= F.col("n_shingles") * num)
    left = rounds.save(left.drop("short", "shared"), "left")
    keyed = of(left).select("text").mapInArrow(_packed(sets, BUCKETS * parts), _PACKED)
    edges = rounds.save(_by_bucket(keyed, parts).mapInArrow(_edges, "node long, peer long").distinct(), "left-candidates")
    regrouped = _grouped(left, edges, "ngram-regroups")
    columns = ["node", "root", "doc_id", "n_shingles"]
    return nodes.join(wide, "root", "left_anti").select(*columns).unionByName(regrouped.select(*columns))


def _roots(edges: DataFrame, name: str) -> DataFrame:
    found = components(edges.select(F.lit(0).alias("edition"), F.col("node").alias("a"), F.col("peer").alias("b")), name)
    return found.select(F.col("vertex").alias("node"), "root")


def _chunk_of_level(level, piece):
    return F.shiftleft(level.cast("long"), 32) + piece


def _in_all_pieces(df: DataFrame) -> DataFrame:
    each = df.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    return each.withColumn("chunk", _chunk_of_level(F.col("level"), F.col("piece"))).drop("piece", "pieces")


def _level(size, num: int, den: int):
    uppers = F.array(*[F.lit(u).cast("long") for u, _, _ in _levels(num, den)])
    return F.size(F.filter(uppers, lambda u: u < size)).cast("long")


def _placed(nodes: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(nodes with level and chunk, pieces by root and level).

    A group of at most a block is one chunk, level -1. A wider one is dealt by size first, so that a set meets those of its own
    and the neighbouring levels only, then by hash into pieces of a block; its first node is in every chunk.
    """
    level = _level(F.col("n_shingles"), num, den)
    wide = nodes.groupBy("root").agg((F.sum("n_shingles") > BLOCK_NGRAMS).alias("wide"))
    leveled = nodes.join(wide, "root").withColumn("level", F.when(F.col("wide"), level).otherwise(-1)).drop("wide")
    pieces = leveled.groupBy("root", "level").agg(F.ceil(F.sum("n_shingles") / BLOCK_NGRAMS).alias("pieces"))
    others = leveled.filter("node <> root").join(pieces, ["root", "level"])
    others = others.withColumn("chunk", _chunk_of_level(F.col("level"), F.pmod(F.xxhash64("node"), "pieces"))).drop("pieces")
    first = _in_all_pieces(nodes.filter("node = root").join(pieces, "root"))
    return others.unionByName(first), pieces


def linked_sets(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, lower: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows(doc_id, n_shingles, node) of all documents, and links(node, peer) that connect each component."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rounds = Rounds(docs.sparkSession, "ngram-join")
    digests = rounds.save(texts.mapInArrow(_digests(n, lower), "doc_id long, n_shingles long, node long"), "digests")
    known = digests.filter("doc_id is not null and node is not null")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # at most MOST_FREQUENT + 1 hashes
    shared = docs.sparkSession.sparkContext.broadcast(frequent_ngrams(texts, n, lower))

    def sets(columns):
        return _node_keys(columns, n, num, den, lower, shared.value)

    packed = texts.filter("doc_id is not null").select("text").mapInArrow(_packed(sets, BUCKETS * parts), _PACKED)
    edges = rounds.save(_by_bucket(packed, parts).mapInArrow(_edges, "node long, peer long").distinct(), "candidates")
    found = known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"))
    nodes = rounds.save(_grouped(found, edges, "ngram-groups"), "members")
    rounds.drop(edges)
    nodes = rounds.save(_without_chance(texts, nodes, sets, n, num, den, lower, rounds), "regrouped")
    placed, pieces = _placed(nodes, num, den)
    placed = rounds.save(placed, "placed")
    members = texts.join(_sized(placed, placed.count()), "doc_id").select("root", "chunk", "node", "text")
    inside = rounds.save(members.groupBy("root", "chunk").applyInArrow(_within(n, num, den, lower), _EDGES), "inside")
    links = inside.filter("node <> peer").select("node", "peer")
    wide = pieces.filter("level >= 0")
    if not wide.isEmpty():
        apart = inside.filter("apart").select("node").distinct()
        left = placed.filter("level >= 0 and node <> root").join(apart, "node", "left_semi").withColumnRenamed("chunk", "own")
        # a linked set lies in a level between the bounds that the threshold sets to its size, below this one or above
        least, most = F.ceil(F.col("n_shingles") * num / den), F.floor(F.col("n_shingles") * den / num)
        levels = F.sequence(_level(least, num, den), _level(most, num, den))
        met = left.withColumn("level", F.explode(levels)).join(wide, ["root", "level"])
        carried = _in_all_pieces(met).filter("chunk <> own")
        sizes = carried.groupBy("root", "chunk").agg(F.ceil(F.sum("n_shingles") / BLOCK_NGRAMS).alias("parts"))
        carried = carried.join(sizes, ["root", "chunk"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), "parts"))
        base = placed.join(sizes, ["root", "chunk"]).withColumn(
            "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        )
        columns = ["doc_id", "root", "chunk", "part", "node"]
        both = rounds.save(carried.select(*columns, F.lit(True).alias("carried")).union(base.select(*columns, F.lit(False))), "both")
        blocks = texts.join(_sized(both, both.count()), "doc_id").select("root", "chunk", "part", "node", "text", "carried")
        across = blocks.groupBy("root", "chunk", "part").applyInArrow(_across(n, num, den, lower), _EDGES)
        links = links.union(rounds.save(across, "across").filter("node <> peer").select("node", "peer"))
    return digests.select("doc_id", "n_shingles", "node"), links


def ngram_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, lower: bool = True) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    rows, links = linked_sets(docs, n, num, den, lower)
    known = rows.filter("doc_id is not null and node is not null")
    firsts = known.groupBy("node").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_copies"))
    joined = firsts.join(_roots(links, "ngram-components"), "node", "left").filter("_copies > 1 or root is not null")
    joined = joined.withColumn("root", F.coalesce("root", "node"))
    heads = joined.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = joined.join(heads, "root").select("node", "component_id")
    return rows.join(named, "node", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def _sized(small: DataFrame, rows: int) -> DataFrame:
    """A saved table of ids and short columns, broadcast if it has few rows and shuffled beyond."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, lower: bool = True) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id; rows with a null doc_id stay."""
    rounds = Rounds(docs.sparkSession, "ngram-heads")
    found = ngram_components(docs, n, num, den, lower).filter("doc_id = component_id")
    heads = rounds.save(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies")), "heads")
    count = heads.count()
    # only rows of a repeated id can be equal, and only these are compared
    single, repeated = (_sized(heads.filter(f"copies {test} 1").select("doc_id"), count) for test in ("=", ">"))
    kept = docs.join(single, "doc_id", "left_semi")
    kept = kept.unionByName(docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.unionByName(docs.filter("doc_id is null"))
