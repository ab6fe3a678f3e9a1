import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import connect, difference
from drawlytics.llm import queries


def test_every_operator_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(queries.sql()) <= set(queries.registered())


@pytest.mark.parametrize("name", sorted(queries.sql()))
def test_query_equals_oracle(name, spark, sf_dir):
    assert difference(queries.registered()[name](spark, sf_dir), connect(sf_dir), queries.sql()[name]) is None


def test_pipeline_equals_its_stages_one_by_one(spark, sf_dir, documents):
    """Each stage keeps the documents' columns and is checked against its own operator's decisions."""
    from drawlytics.llm import decontam, quality, simhash

    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        seen.append((name, before, docs))
        if name != "best_fit_packing":
            assert docs.dtypes == documents.dtypes
    ids = {name: {r["doc_id"] for r in out.select("doc_id").collect()} for name, _, out in seen}
    before = {name: b for name, b, _ in seen}
    assert ids["quality_rules"] == {r["doc_id"] for r in quality.report(before["quality_rules"], labels).where("kept").collect()}
    assert ids["line_dedup"] == ids["quality_rules"]
    assert ids["near_dedup"] == {r["component_id"] for r in simhash.near_duplicates(before["near_dedup"]).collect()}
    leaks = {r["doc_id"] for r in decontam.contaminations(before["decontamination"], bench).collect()}
    assert leaks and ids["decontamination"] == ids["near_dedup"] - leaks == ids["best_fit_packing"]
    run = corpus_pipeline.run(spark, sf_dir)
    # Where a piece lies depends on how rows are dealt; which pieces there are does not.
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run.select(own).collect())) == sorted(map(tuple, docs.select(own).collect()))
