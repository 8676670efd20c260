"""The v2 relation of stories looks at numbers, in the query and in its comparison SQL."""

import re

import duckdb

from tests.test_odd_pages import page
from tests.test_queries import table
from tidewire.functions import numbers as N
from tidewire.queries import registry
from tidewire.queries import sqltext as S

registry.load_all()
KEY = re.compile(r"(?<![a-z0-9])[$¥]?\d+(?:\.\d+)?\s*(?:trillion|billion|million|[tbm]|万|亿)?", re.IGNORECASE)
TEXTS = ["7 8  9", "$1.5 B 3万6", "1.2.3 $$6 $5$6", "5k 5M3 x7 ¥8亿9", "7 Billion\n7 men 5.", "GPT-5 in 2 \t3", "万$4 5$", ""]


def test_number_keys_in_both_engines(spark):
    want = [sorted(set(KEY.findall(t))) for t in TEXTS]
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").orderBy("i")
    assert [sorted(r.k) for r in rows.select(N.raw_number_keys("t").alias("k")).collect()] == want
    con = duckdb.connect()
    assert [sorted(con.execute(f"select {S.number_keys('?')}", [t]).fetchone()[0]) for t in TEXTS] == want


def test_relation_by_number(spark, tmp_path):
    # numbers alone link the titles, and with an entity and an action the stories
    pages = [page(7, "7 mice", "für the one"), page(14, "7 men", "für the two"), page(21, "8 men", "für the 7 men"), page(28, "8 men", "the men")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    df = registry.QUERIES["story_relation_v2"](spark, str(tmp_path))
    got = table(df.columns, df.collect())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    cursor = con.execute(registry.ORACLES["story_relation_v2"])
    assert got == table([d[0] for d in cursor.description], cursor.fetchall())
    assert [(r.p1, r.p2, r.reason) for r in df.collect()] == [(2, 3, "shared_entity_action_number")]
