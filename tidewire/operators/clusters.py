"""Same-event clusters: token/similarity components and the conservative v2 relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import numbers as N
from tidewire.functions.text import normalize_title_search, text
from tidewire.operators.catalog import Catalog, title_model_aliases
from tidewire.operators.greedy import components, first_fit
from tidewire.operators.ranking import global_rank, top_k
from tidewire.operators.similarity import near_duplicate_pairs
from tidewire.operators.token_links import shared_token_links
from tidewire.workspace import save_once


def story_titles(df: DataFrame) -> DataFrame:
    """(edition, title, first, norm): distinct titles with their first position and normal form, written once."""
    titles = df.select("edition", text("title").alias("title"), "pos").groupBy("edition", "title").agg(
        F.min("pos").alias("first")
    )
    return save_once(titles.withColumn("norm", normalize_title_search("title")), "story-titles")


def story_edges(titles: DataFrame) -> DataFrame:
    """Edges between title ids and normalised-title ids of each edition; titles: see story_titles.

    A title is tied to its normal form; titles are tied by shared tokens and normal forms by
    similarity. Rows with the same title never need an edge of their own.
    """
    norms = titles.groupBy("edition", "norm").agg(F.min("first").alias("nfirst"))
    # even ids are titles, odd ids normal forms; both grow with the first position
    tid, nid = F.col("first") * 2, F.col("nfirst") * 2 + 1
    tie = titles.join(norms, ["edition", "norm"]).select("edition", tid.alias("a"), nid.alias("b"))
    tokens = shared_token_links(titles)
    ids = titles.select("edition", "title", tid.alias("id"))
    by_token = (
        tokens.join(ids.withColumnsRenamed({"title": "left", "id": "a"}), ["edition", "left"])
        .join(ids.withColumnsRenamed({"title": "right", "id": "b"}), ["edition", "right"])
        .select("edition", "a", "b")
    )
    # candidate pairs are compared with the earlier title first
    near = near_duplicate_pairs(norms)
    nids = norms.select("edition", "norm", nid.alias("id"))
    by_norm = (
        near.join(nids.withColumnsRenamed({"norm": "left", "id": "a"}), ["edition", "left"])
        .join(nids.withColumnsRenamed({"norm": "right", "id": "b"}), ["edition", "right"])
        .filter(F.when(F.col("a") < F.col("b"), F.col("sim_lr")).otherwise(F.col("sim_rl")) >= 0.82)
        .select("edition", "a", "b")
    )
    return tie.union(by_token).union(by_norm)


def annotate_story_clusters(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with cluster id, size, role and representative title; one row per cluster)."""
    df = save_once(df, "stories")
    titles = story_titles(df)
    roots = components(story_edges(titles))
    rooted = titles.join(
        roots.select("edition", F.col("vertex").alias("_v"), "root"),
        (titles.edition == roots.edition) & (titles["first"] * 2 == F.col("_v")),
    ).select(titles.edition, "title", "root")
    rows = df.withColumn("_title", text("title"))
    # read for the sizes, the numbers and the rows
    labelled = save_once(rows.join(rooted.withColumnRenamed("title", "_title"), ["edition", "_title"]), "labelled")
    sizes = labelled.groupBy("edition", "root").agg(
        F.count(F.lit(1)).alias("cluster_size"),
        F.min_by(F.struct("pos", "title", "source", "link"), "pos").alias("rep"),
    )
    multi = global_rank(sizes.filter("cluster_size > 1"), ["edition"], [F.col("rep.pos").asc()], "_no")
    number = F.col("_no").cast("string")
    multi = multi.withColumn(
        "cluster_id",
        F.concat(F.lit("cluster-"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)),
    )
    clusters = multi.select(
        "edition",
        "cluster_id",
        "cluster_size",
        F.col("rep.title").alias("representative_title"),
        F.col("rep.source").alias("representative_source"),
        F.col("rep.link").alias("representative_link"),
        (F.col("cluster_size") - 1).alias("saved_calls"),
    )
    joined = labelled.join(
        multi.select("edition", "root", "cluster_id", "cluster_size", F.col("rep").alias("_rep")),
        ["edition", "root"],
        "left",
    )
    role = (
        F.when(F.col("cluster_id").isNull(), "singleton")
        .when(F.col("_rep.pos") == F.col("pos"), "representative")
        .otherwise("alternate")
    )
    annotated = (
        joined.withColumn("cluster_role", role)
        .withColumn("cluster_size", F.coalesce("cluster_size", F.lit(1)))
        .withColumn("cluster_representative_title", F.coalesce(F.col("_rep.title"), F.col("title")))
        .drop("_rep", "root", "_title")
    )
    return annotated, clusters


def collapse_clusters(annotated: DataFrame, order: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to verify: the first of each cluster and all singletons, skipped rows)."""
    order = order or [F.col("bucket_rank").asc(), F.col("pos").asc()]
    clustered = annotated.filter("cluster_id is not null")
    first = top_k(clustered, ["edition", "cluster_id"], order, 1, "_r").drop("_r")
    kept = annotated.filter("cluster_id is null").unionByName(first)
    skipped = clustered.join(first.select("edition", "pos"), ["edition", "pos"], "left_anti")
    return kept, skipped


# ---- conservative cross-language relation -------------------------------------------------------

_SIGNATURE = (
    "primary entities title_entities title_models title_numbers actions objects models numbers".split()
)


def story_signature(df: DataFrame, catalog: Catalog) -> DataFrame:
    """Add the attribute set the v2 relation looks at, and its hash."""
    a = F.col("analysis")
    generic = F.array(*[F.lit(m) for m in catalog.generic_models])
    sig = F.struct(
        a["primary_entity"].alias("primary"),
        F.array_sort(a["entities"]).alias("entities"),
        F.array_sort(a["title_entities"]).alias("title_entities"),
        title_model_aliases(F.col("title"), catalog).alias("title_models"),
        F.array_sort(N.raw_number_keys("title")).alias("title_numbers"),
        a["actions"].alias("actions"),
        a["objects"].alias("objects"),
        F.array_except(a["model_aliases"], generic).alias("models"),
        N.number_keys("title", "description").alias("numbers"),
    )
    return df.withColumn("sig", sig).withColumn("sig_id", F.md5(F.to_json("sig")))


def relation_reason(left: str = "l", right: str = "r"):
    """Reason why two signatures are the same story, or NULL."""
    l, r = F.col(left), F.col(right)

    def common(name: str):
        return F.size(F.array_intersect(l[name], r[name]))

    title_link = (common("title_entities") > 0) | (common("title_models") > 0) | (common("title_numbers") > 0)
    same_primary = (l["primary"] != "") & (l["primary"] == r["primary"])
    acts = common("actions") > 0
    related = acts & (common("entities") > 0)
    return F.when(
        title_link,
        F.when(
            (same_primary | (common("title_entities") >= 2)) & (common("entities") >= 2) & acts,
            "shared_entities_action",
        )
        .when(related & (common("models") > 0), "shared_entity_action_model")
        .when(related & (common("numbers") > 0), "shared_entity_action_number")
        .when(related & same_primary & (common("objects") > 0), "shared_entity_action_object"),
    )


def _relation_keys(sigs: DataFrame) -> DataFrame:
    """Composite keys; any related pair shares one.

    Every reason needs a common action and entity plus a third feature, so each key joins three
    features instead of one popular entity.
    """
    def cross3(kind, xs, ys, zs):
        return F.flatten(
            F.transform(
                xs,
                lambda x: F.flatten(
                    F.transform(ys, lambda y: F.transform(zs, lambda z: F.concat_ws("\x1f", F.lit(kind), x, y, z)))
                ),
            )
        )

    s = F.col("sig")
    primary = F.when(s["primary"] != "", F.array(s["primary"])).otherwise(F.array().cast("array<string>"))
    ents = s["entities"]
    pairs = F.flatten(
        F.transform(
            ents,
            lambda x: F.transform(F.filter(ents, lambda y: y > x), lambda y: F.concat_ws("\x1e", x, y)),
        )
    )
    keys = F.concat(
        F.transform(pairs, lambda p: F.concat(F.lit("e\x1f"), p)),
        cross3("m", ents, s["actions"], s["models"]),
        cross3("n", ents, s["actions"], s["numbers"]),
        cross3("o", primary, s["actions"], s["objects"]),
    )
    # the entity-pair key also needs an action
    with_action = F.flatten(
        F.transform(
            keys,
            lambda k: F.when(
                k.startswith("e\x1f"),
                F.transform(s["actions"], lambda act: F.concat_ws("\x1f", k, act)),
            ).otherwise(F.array(k)),
        )
    )
    return sigs.select("edition", "sig_id", F.explode(F.array_distinct(with_action)).alias("key"))


def related_signatures(df: DataFrame) -> DataFrame:
    """(edition, left_id, right_id, reason) for all related signature pairs, both directions and self."""
    # the distinct signatures are read three times and are far fewer than the rows
    sigs = save_once(df.select("edition", "sig_id", "sig").dropDuplicates(["edition", "sig_id"]), "signatures")
    keys = _relation_keys(sigs)
    pairs = (
        keys.withColumnRenamed("sig_id", "left_id")
        .join(keys.withColumnRenamed("sig_id", "right_id"), ["edition", "key"])
        .select("edition", "left_id", "right_id")
        .distinct()
    )
    left = sigs.select("edition", F.col("sig_id").alias("left_id"), F.col("sig").alias("l"))
    right = sigs.select("edition", F.col("sig_id").alias("right_id"), F.col("sig").alias("r"))
    joined = pairs.join(left, ["edition", "left_id"]).join(right, ["edition", "right_id"])
    return joined.withColumn("reason", relation_reason()).filter("reason is not null").select(
        "edition", "left_id", "right_id", "reason"
    )


def collapse_story_clusters_v2(ranked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(representative rows, members (pos, representative_pos, reason), one row per cluster).

    `ranked` has sig, sig_id and `ord`, the comparable selection order.
    """
    related = save_once(related_signatures(ranked), "related")
    members = ranked.select("edition", F.col("pos").alias("node"), "ord", F.col("sig_id").alias("hub"))
    edges = related.select("edition", F.col("left_id").alias("later"), F.col("right_id").alias("earlier"))
    decided = first_fit(members, edges, "clusters-v2")
    marked = ranked.join(decided.withColumnRenamed("node", "pos"), ["edition", "pos"])
    representatives = marked.filter("kept").drop("kept", "match")
    keyed = marked.filter(~F.col("kept")).select(
        "edition", "pos", "ord", F.col("sig_id").alias("left_id"), F.col("match").alias("rep_ord")
    )
    reps = representatives.select(
        "edition", F.col("ord").alias("rep_ord"), F.col("pos").alias("representative_pos"), F.col("sig_id").alias("right_id")
    )
    attached = keyed.join(reps, ["edition", "rep_ord"]).join(related, ["edition", "left_id", "right_id"])
    members_out = attached.select("edition", "pos", "representative_pos", "reason", "ord")
    by_reason = members_out.groupBy("edition", "representative_pos", "reason").agg(
        F.min("ord").alias("o"), F.count(F.lit(1)).alias("n")
    )
    clusters = by_reason.groupBy("edition", "representative_pos").agg(
        (F.sum("n") + 1).alias("member_count"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("o", "reason"))), lambda x: x["reason"]
        ).alias("reasons"),
    )
    return representatives, members_out, clusters
