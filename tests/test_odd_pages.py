"""Registered queries against their comparison SQL on made pages: titles with figures, editions of more than 9999 articles."""

import duckdb
import pytest

from tests.test_queries import table
from tidewire.queries import registry

registry.load_all()


def page(page_id, title, body="x"):
    html = f"<html><title>{title}</title><article><p>{body}</p></article></html>"
    return page_id, f"https://a{page_id}.example.com/en/{page_id}", html


PAGES = {
    # one number, entity and action in common, and nothing else
    "story_relation_v2": [page(7, "7 mice", "für the one"), page(14, "7 men", "für the two"), page(21, "für the men")],
    # 69986 is number 9999 of its edition; 63 and 69993 are drafts without a known id
    "join_summary_items": [page(63, "one"), page(69986, "two"), page(69986 - 7 * 5, "three"), page(69993, "four")],
}


@pytest.mark.parametrize("name", PAGES)
def test_query_equals_sql_on_odd_pages(spark, tmp_path, name):
    rows = spark.createDataFrame(PAGES[name], "page_id long, url string, html string")
    rows.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    cursor = con.execute(registry.ORACLES[name])
    want = table([d[0] for d in cursor.description], cursor.fetchall())
    df = registry.QUERIES[name](spark, str(tmp_path))
    assert table(df.columns, df.collect()) == want
