"""Exact order-dependent selection and connected components in distributed rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.workspace import Rounds

UNDECIDED, KEPT, DROPPED = 0, 1, 2


def first_fit(members: DataFrame, edges: DataFrame, name: str = "first-fit") -> DataFrame:
    """Keep a node iff no earlier kept node conflicts with it.

    members: (edition, node, ord, hub) - a node may sit in several hubs; `ord` is unique per node.
    edges:   (edition, later, earlier) - a node of hub `later` conflicts with an earlier node of hub
             `earlier`; a hub whose nodes conflict with each other has an edge to itself.
    Returns (edition, node, kept, match) with the earliest kept conflicting order as `match`.

    Conflicts are stored per hub, never per pair of nodes. A round decides every node whose earlier
    conflicts are decided, by two minimum-aggregations (kept and undecided order per hub).
    """
    spark = members.sparkSession
    rounds = Rounds(spark, name)
    edges = rounds.save(edges.select("edition", "later", "earlier").distinct(), "edges")
    members = rounds.save(members.select("edition", "node", "ord", "hub"), "members")
    sizes = members.groupBy("edition", "hub").agg(F.count(F.lit(1)).alias("_size"))
    self_hot = (
        edges.filter("later = earlier")
        .join(sizes.filter("_size > 1"), (edges.edition == sizes.edition) & (edges.later == sizes.hub))
        .select(edges.edition, edges.later.alias("hub"))
    )
    cross = edges.filter("later <> earlier")
    contested = (
        self_hot.union(cross.select("edition", "later")).union(cross.select("edition", "earlier")).distinct()
    )
    involved = members.join(contested, ["edition", "hub"], "left_semi").select("edition", "node").distinct()
    state = rounds.save(
        members.join(involved, ["edition", "node"], "left_semi").withColumn("status", F.lit(UNDECIDED))
    )

    def conflicts(current: DataFrame) -> DataFrame:
        """Per membership row: earliest kept and earliest undecided conflicting order of the node."""
        hubs = current.filter(F.col("status") < DROPPED).groupBy("edition", "hub").agg(
            F.min(F.when(F.col("status") == KEPT, F.col("ord"))).alias("mk"),
            F.min(F.when(F.col("status") == UNDECIDED, F.col("ord"))).alias("mu"),
        )
        seen = (
            edges.join(hubs.withColumnRenamed("hub", "earlier"), ["edition", "earlier"])
            .groupBy("edition", F.col("later").alias("hub"))
            .agg(F.min("mk").alias("mk"), F.min("mu").alias("mu"))
        )
        node = W.partitionBy("edition", "node")
        return (
            current.join(seen, ["edition", "hub"], "left")
            .withColumn("mk", F.min("mk").over(node))
            .withColumn("mu", F.min("mu").over(node))
        )

    while not state.filter(F.col("status") == UNDECIDED).isEmpty():
        step = conflicts(state)
        status = (
            F.when(F.col("status") != UNDECIDED, F.col("status"))
            .when(F.col("mk") < F.col("ord"), DROPPED)
            .when(F.col("mu") < F.col("ord"), UNDECIDED)
            .otherwise(KEPT)
        )
        previous, state = state, rounds.save(
            step.select("edition", "node", "ord", "hub", status.alias("status"))
        )
        rounds.drop(previous)
    final = conflicts(state).select(
        "edition",
        "node",
        (F.col("status") == KEPT).alias("kept"),
        F.when(F.col("status") == DROPPED, F.col("mk")).alias("match"),
    ).distinct()
    nodes = members.select("edition", "node").distinct()
    return nodes.join(final, ["edition", "node"], "left").withColumn("kept", F.coalesce("kept", F.lit(True)))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(edition, vertex, root) with the smallest vertex id of each component as root.

    Alternating large-star and small-star rounds; the number of rounds grows with the logarithm of
    the component size, not with its diameter.
    """
    spark = edges.sparkSession
    rounds = Rounds(spark, name)
    # read for the first round and for the vertices
    both = rounds.save(edges.select("edition", F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")
    state = both.filter("u <> v")

    def signature(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("edition", "u", "v").cast("decimal(38,0)"))).first()

    def star(df: DataFrame, large: bool) -> DataFrame:
        directed = df.union(df.select("edition", F.col("v").alias("u"), F.col("u").alias("v")))
        if not large:
            directed = directed.filter("v <= u")
        lowest = directed.groupBy("edition", "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = directed.join(lowest, ["edition", "u"])
        if large:
            return joined.filter("v > u").select("edition", F.col("v").alias("u"), F.col("m").alias("v"))
        linked = joined.select("edition", F.col("v").alias("u"), F.col("m").alias("v"))
        return linked.union(lowest.select("edition", "u", F.col("m").alias("v")))

    before = None
    current = signature(state)
    while current != before:
        grown = star(state, True).filter("u <> v").distinct()
        shrunk = star(grown, False).filter("u <> v").distinct()
        previous, state = state, rounds.save(shrunk)
        rounds.drop(previous)
        before, current = current, signature(state)
    found = state.select("edition", F.col("u").alias("vertex"), F.col("v").alias("root"))
    vertices = both.select("edition", F.col("u").alias("vertex")).union(both.select("edition", "v")).distinct()
    return vertices.join(found, ["edition", "vertex"], "left").withColumn("root", F.coalesce("root", "vertex"))
