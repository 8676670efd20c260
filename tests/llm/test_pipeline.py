import corpus_pipeline
from tests.llm.helpers import jaccard_components


def test_stages_on_the_smallest_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, {}
    state = docs
    for name, stage in corpus_pipeline.STAGES:
        before = state
        state = stage(spark, before, sf_dir).cache()
        if name != "tokens":
            assert state.columns == columns
        rows[name] = state.collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in rows["quality"]}
    long = {r.doc_id for r in docs.collect() if len(r.text.split()) >= 50}
    good = {d for d, q in labels.items() if q == 1 and d in long}
    assert len(good & kept) >= 0.98 * len(good) and not {d for d, q in labels.items() if q == 0} & kept
    groups = jaccard_components([(r.doc_id, r.text) for r in rows["quality"]], 5, 80, 100)
    assert {r.doc_id for r in rows["near_duplicates"]} == {c for _, _, c in groups}
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    holds = lambda r: any(i in " ".join(r.text.split()) for i in items)
    assert not any(map(holds, rows["decontaminate"]))
    assert len(rows["decontaminate"]) >= len([r for r in rows["near_duplicates"] if not holds(r)]) - 5
    assert {r.doc_id for r in rows["mix"]} <= {r.doc_id for r in rows["decontaminate"]}
    assert sorted(r.doc_id for r in rows["tokens"]) == sorted(r.doc_id for r in rows["mix"])
