"""The registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words_sql(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


OP2_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {_words_sql(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
 s AS (SELECT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
  UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 2),
 c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT x.a, x.b FROM x JOIN c ca ON ca.doc_id = x.a JOIN c cb ON cb.doc_id = x.b WHERE 100 * x.i >= 90 * (ca.n + cb.n - x.i)),
 t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 r AS (SELECT a AS doc_id, b AS reach FROM t UNION SELECT r.doc_id, t.b FROM r JOIN t ON r.reach = t.a),
 m AS (SELECT doc_id, min(reach) AS lowest FROM r GROUP BY doc_id)
 SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(least(w.doc_id, m.lowest), w.doc_id) AS component_id
 FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id"""

OP4_SQL = f"""WITH w AS (SELECT doc_id, {_words_sql("coalesce(text, '')")} AS ws FROM documents),
 g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
 o AS (SELECT g, min(doc_id) AS owner FROM g GROUP BY g),
 r AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT g.doc_id, g.i, unnest(range(0, 13)) AS j FROM g JOIN o ON g.g = o.g WHERE o.owner < g.doc_id)),
 p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
 k AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.p) AS t, count(*) AS n FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.p = r.p WHERE r.p IS NULL GROUP BY p.doc_id)
 SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(len(w.ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""


def _seeded_sql(salt: str) -> str:
    return f"CAST('0x' || substr(md5('mix-1:{salt}:' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 8) AS BIGINT)"


OP5_SQL = f"""WITH d AS (SELECT doc_id, source, CAST(len({_words_sql("coalesce(text, '')")}) AS BIGINT) AS size FROM documents),
 z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY source),
 w AS (SELECT *, 3 * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM z),
 f AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place,
  (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
 l AS (SELECT arg_min(level, place) AS level FROM f WHERE cap > level * weight),
 t AS (SELECT source, source_size, n, least(CAST(cap AS DOUBLE), coalesce(l.level * weight, CAST(cap AS DOUBLE))) AS target, CAST(round(sum(source_size) OVER () / 8) AS BIGINT) AS blocks, count(*) OVER () AS parties FROM f, l),
 q AS (SELECT source, blocks, k, target / (2 * k + 1) AS quotient FROM (SELECT *, unnest(range(0, CAST(target / 8 AS BIGINT) + parties + 2)) AS k FROM t WHERE target > 0)),
 s AS (SELECT source, count(*) AS seats FROM (SELECT source, blocks, row_number() OVER (ORDER BY quotient DESC, source NULLS LAST, k) AS r FROM q) WHERE r <= blocks GROUP BY source),
 p AS (SELECT d.doc_id, d.size, d.source, t.source_size, t.target, coalesce(s.seats, 0) AS seats,
  {_seeded_sql("shard")} % CAST(greatest(ceil(greatest(t.source_size / 1000000, t.n / 2000)), 1) AS BIGINT) AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN s ON d.source IS NOT DISTINCT FROM s.source),
 h AS (SELECT source, shard, seats, CAST(sum(size) AS BIGINT) AS shard_size FROM p GROUP BY source, shard, seats),
 i AS (SELECT *, count(*) OVER (PARTITION BY source) AS parties, sum(shard_size) OVER (PARTITION BY source) AS whole FROM h),
 u AS (SELECT source, shard, seats, k, shard_size / (2 * k + 1) AS quotient FROM (SELECT *, unnest(range(0, CAST(shard_size * seats / whole AS BIGINT) + parties + 2)) AS k FROM i WHERE shard_size > 0)),
 v AS (SELECT source, shard, count(*) AS quota FROM (SELECT source, shard, seats, row_number() OVER (PARTITION BY source ORDER BY quotient DESC, shard, k) AS r FROM u) WHERE r <= seats GROUP BY source, shard),
 o AS (SELECT p.*, h.shard_size, least(8 * coalesce(v.quota, 0), 3 * h.shard_size) AS quota,
  sum(p.size) OVER (PARTITION BY p.source, p.shard ORDER BY {_seeded_sql("order").replace("doc_id", "p.doc_id")}, p.doc_id, p.size ROWS UNBOUNDED PRECEDING) - p.size AS before
  FROM p JOIN h ON p.source IS NOT DISTINCT FROM h.source AND p.shard = h.shard LEFT JOIN v ON p.source IS NOT DISTINCT FROM v.source AND p.shard = v.shard),
 x AS (SELECT *, CASE WHEN shard_size > 0 THEN quota // shard_size ELSE 0 END AS passes FROM o)
 SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(size, quota - passes * shard_size - before)) AS BIGINT) AS taken, source FROM x"""


OP12_SQL = """WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
 w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
 l AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
 v AS (SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS n FROM l GROUP BY lang),
 c AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM w JOIN l ON w.lang = l.lang AND w.term = l.term GROUP BY ALL),
 g AS (SELECT d.lang, d.source, coalesce(any_value(v.v), 0) AS v, coalesce(any_value(s.n), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN v ON d.lang = v.lang
  LEFT JOIN (SELECT lang, source, CAST(sum(c) AS BIGINT) AS n FROM c GROUP BY lang, source) s ON d.lang = s.lang AND d.source = s.source GROUP BY d.lang, d.source),
 p AS (SELECT g.lang, g.source, l.term, coalesce(c.c, 0) AS c, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 1)) // (g.n + g.v) AS BIGINT) AS p
  FROM g JOIN l ON g.lang = l.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term),
 q AS (SELECT l.lang, l.term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (l.total + 1)) // (v.n + v.v) AS BIGINT) AS q FROM l JOIN v ON l.lang = v.lang),
 pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pairs.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // q.q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p.p > q.q),
 y AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x)
 SELECT lang, source, part, item, value, rank FROM y WHERE part = 'pair' OR rank <= 200"""


OP13_SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS a, a.label AS la, b.vec_id AS b, b.label AS lb, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS s
  FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
 p AS (SELECT a, b, s FROM s WHERE la = lb QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
 SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS INTEGER) AS rank,
  s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
 FROM p JOIN s ON p.a = s.a AND s.la <> s.lb AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s
 QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) <= 3"""


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.token_files import token_digest, tokens_path, write_tokens

    path = tokens_path(spark)
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"))
    return token_digest(spark, path)


@query("op2_ngram_jaccard_join", OP2_SQL)
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


@query("op8_weak_quality")
def op8_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.weak_quality import judged

    fields = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept posterior".split()
    found = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return found.select("doc_id", *[f"quality.{f}" for f in fields])


@query("op5_source_mix", OP5_SQL)
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.mixing import mixed

    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op4_substring_dedup", OP4_SQL)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.substring import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"), k=13).drop("kept_text")


@query("op9_spaced_seed_leaks")
def op9_spaced_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.langid import identified

    return identified(table(spark, sf_dir, "documents"))


@query("op10_byte_cnn_quality")
def op10_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.byte_cnn import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_surrogates")
def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tidewire.llm.pii import rewritten

    found = rewritten(table(spark, sf_dir, "documents").select("doc_id", "text"), key="surrogates-1")
    return found.select(
        "doc_id",
        "text",
        F.size("entities").alias("n_entities"),
        F.array_join(F.array_sort(F.array_distinct("entities.kind")), ",").alias("kinds"),
    )


@query("op12_source_divergence", OP12_SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.divergence import divergences

    return divergences(table(spark, sf_dir, "documents"))


@query("op13_hard_negatives", OP13_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.hard_negatives import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"))


@query("op11_toxicity")
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
