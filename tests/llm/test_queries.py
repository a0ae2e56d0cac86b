"""The registered queries against their SQL, and the pipeline against brute force, on the smallest tables."""

import hashlib

import brute
import duckdb
import numpy as np
import pytest

import check_oracles
import corpus_pipeline
from meteospan.llm import catalog, quality_rules

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in check_oracles.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    got = catalog.queries()[name](spark, SF_DIR).toPandas()
    assert len(got) and check_oracles.compare(got, sql.execute(catalog.oracle_sql()[name]).df()) == "ok"


def documents(sql):
    return sql.execute("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall()


def test_pii_query(spark, sql):
    got = {r.doc_id: r for r in catalog.queries()["op5_pii"](spark, SF_DIR).collect()}
    for doc_id, text, *_ in documents(sql):
        spans = brute.pii_spans(text)
        assert got[doc_id].base_sha256 == brute.pii_digest(spans)
        assert [got[doc_id][f"n_{k}"] for k in brute.PII] == [sum(k == i for _, k, _ in spans) for i in range(4)]


def test_pipeline_equals_brute_force(spark, sql):
    from tokenizers import Tokenizer

    public_tokenizers = pytest.importorskip("public_tokenizers")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [r[:2] for r in documents(sql)]
    kept = {r.doc_id for r in quality_rules.quality_rules(spark.read.parquet(f"{SF_DIR}/documents.parquet")).filter("kept").collect()}
    assert kept <= {i for i, t in rows if not brute.quality(t)[5]}
    rows = [r for r in rows if r[0] in kept]
    rows = [r[:2] for r in brute.dedup_lines(rows)]
    first = {i for i, _, c in brute.components(rows, 5, 80) if i == c}
    rows = [r for r in rows if r[0] in first]
    items = sql.execute("SELECT item_id, text FROM benchmark").fetchall()
    clean = {i for i, *_, c in brute.contamination(rows, items) if not c}
    want = set()
    for i, text in rows:
        if i in clean:
            ids = library.encode(text, add_special_tokens=False).ids
            raw = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            want.add((i, len(ids), raw, hashlib.sha256(text.encode()).hexdigest()))
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF_DIR).collect()} == want


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).dtypes == docs.dtypes


def test_tokens_need_one_python_worker_for_each_task(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for df in (corpus_pipeline.tokenise(spark, docs, SF_DIR), catalog.queries()["op7_bpe"](spark, SF_DIR)):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
