"""Registered queries against their comparison SQL on the smallest tables."""

import math

import duckdb
import pytest

from tidewire.queries import registry

registry.load_all()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = (
    "canonical_url parse_published story_tokens number_claims partition_for_publication prefilter_stats analyze_editorial "
    "match_catalog_aliases dedupe_exact shared_token_pairs story_relation_v2 recent_exact_antijoin homepage_links channel_items "
    "union_sources source_outcomes candidate_queue call_plan one_lead_per_entity match_evidence resolve_story enrich_story "
    "scorecard benchmark_groups check_grounding leak_check publication_gate fingerprint_input read_editions markdown_edition "
    "stream_freshness_gate stream_recent_dedupe stream_daily_failures stream_edition_close catalog_mentions"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, (str, bool)):
        return value
    if hasattr(value, "as_tuple") or isinstance(value, float):
        return None if math.isnan(value) else round(float(value), 6)
    return value


def table(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = table(df.columns, df.collect())
    cursor = duck.execute(registry.ORACLES[name])
    want = table([d[0] for d in cursor.description], cursor.fetchall())
    assert got == want and got[1]


def test_every_query_is_registered_once():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert len(registry.QUERIES) > 130


def test_dedupe_plan_prunes_and_limits(spark, sf_dir):
    plan = registry.QUERIES["dedupe_exact"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    # at most one row per key and task is shuffled; only the needed columns are read
    assert "WindowGroupLimit" in plan
    assert "n_chars" not in plan


def test_recent_filter_is_an_equi_join(spark, sf_dir):
    plan = registry.QUERIES["recent_exact_antijoin"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
