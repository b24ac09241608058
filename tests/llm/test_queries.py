"""The numbered queries and the pipeline on the smallest given tables."""

import os
import zlib

import pyarrow as pa
import pytest

import corpus_pipeline
from clearwell.llm.common import batches_of
from clearwell.llm.decontaminate import contamination
from clearwell.llm.pii import base_spans
from clearwell.llm.queries import ORACLE_SQL, QUERIES
from tests.check_catalog import compare, connect

from .cases import AWKWARD, documents, prose
from .test_simhash import plain_kept

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"op3_best_fit_packing"}))
def test_query_answers_every_row(spark, name):
    table = {"op6_html": "pages", "op12_codes": "embeddings", "op13_whitening": "embeddings"}.get(name, "documents")
    each = 8 if name == "op13_whitening" else 1  # components
    assert QUERIES[name](spark, FOLDER).count() == each * spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_stages_by_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    states = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, states[-1], FOLDER).write.parquet(f"{tmp_path}/{i}")
        states.append(spark.read.parquet(f"{tmp_path}/{i}"))
    assert all(s.columns == docs.columns for s in states[:-1])
    clean, single, unleaked, hidden, packed = states[1:]
    assert 0 < clean.count() < docs.count()
    # Near copies by the Jaccard index of five-word shingles, by brute force.
    assert sorted(r.doc_id for r in single.collect()) == plain_kept([(r.doc_id, r.text) for r in clean.collect()])
    hits = {r["id"]: r.n_hit for r in contamination(single, bench).collect()}
    assert {r.doc_id for r in unleaked.collect()} == {i for i, n in hits.items() if not n}
    assert {r.doc_id for r in hidden.collect()} == {r.doc_id for r in unleaked.collect()}
    assert not any(base_spans(r.text) for r in hidden.collect())
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in hidden.collect()}
    assert corpus_pipeline.run(spark, FOLDER).count() == packed.count()


def test_held_out_rows(spark):
    rows = QUERIES["op4_toxicity"](spark, FOLDER).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


@pytest.mark.parametrize("rows", [AWKWARD, [], [(None, None)] * 3])
def test_stages_on_awkward_rows(spark, tmp_path, rows):
    """Nulls, empty and long texts, repeated rows, clashing columns and empty tables pass every stage."""
    folder = str(tmp_path)
    spark.createDataFrame([(i, 1, i % 2) for i in range(1, 9)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("b1", prose(4, 12)), ("b2", None), (None, "")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = documents(spark, rows)
    names, kept = docs.columns, len(rows)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names and docs.count() <= kept
            kept = docs.count()
    assert docs.select("doc_id", "piece").count() >= kept


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_hold_few_texts_at_a_time(spark, tmp_path, stage):
    """Batches of 10,000 whole texts took an executor beyond its memory in decontamination."""

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b1", prose(4, 12))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    with batches_of(spark, 10_000):
        stage(spark, documents(spark, AWKWARD), str(tmp_path))
        held = spark.range(0, 3_000, 1, 1).mapInArrow(rows, "n bigint").collect()
    assert sum(r.n for r in held) == 3_000 and max(r.n for r in held) <= corpus_pipeline.TEXT_ROWS


def test_batches_are_set_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with batches_of(spark, 700):
        with batches_of(spark, 900):
            assert spark.conf.get(name) == "700"
    assert spark.conf.get(name) == before
