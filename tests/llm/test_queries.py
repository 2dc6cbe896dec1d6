"""The registered queries and the pipeline on the smallest tables."""

import re

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from fieldmerge.llm import dedup, near, packing, queries, secrets

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    names = [re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES]
    assert sorted(map(int, names)) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in result.description]
    want = sorted(result.fetchall(), key=repr)
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == want


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        before, after = {r["doc_id"] for r in docs.select("doc_id").collect()}, {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert after <= before
        if name == "exact_dedup":
            assert after == {r["doc_id"] for r in dedup.exact_duplicates(docs).where("kept").collect()}
        if name == "near_dedup":
            assert after == {r["doc_id"] for r in near.near_groups(docs).where("doc_id = component_id").collect()}
        if name == "secrets":
            assert after == before
            assert not any(secrets.base_spans(r["text"]) for r in kept.select("text").collect())
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    found = corpus_pipeline.run(spark, SF)
    want = packing.pack_documents(docs, queries.RANKS, queries.public_tokenizers.PATTERN, queries.ADDED)
    columns = ["doc_id", "piece", "start", "length", "ids"]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
