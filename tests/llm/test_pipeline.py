"""The pipeline's stages on the smallest tables, and queries without SQL against held-out rows."""

import zlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from kinweave.llm import minhash

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_stages_keep_the_columns_and_their_decisions(spark, documents):
    sizes, docs = [], documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == documents.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        sizes.append(docs.count())
        if stage is corpus_pipeline.drop_near_duplicates:
            assert minhash.near_duplicates(docs, percent=80).where("not kept").count() == 0
        if stage is corpus_pipeline.hide_personal_data:
            assert docs.where("text rlike '@mail[0-9].example.com'").count() == 0
    assert documents.count() >= sizes[0] > sizes[1] == sizes[2]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert out.count() == sizes[3]


def test_held_out_toxicity_and_language(spark, documents):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    found = entry.queries()["op5_toxicity_ftrl"](spark, FOLDER).collect()
    assert len(found) == documents.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert sum(r.predicted for r in found if labels.get(r.doc_id) == 0) == 0
    langs = {r.doc_id: r.lang for r in documents.collect()}
    found = entry.queries()["op6_cross_parsing"](spark, FOLDER).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == len(langs) and sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.9 * len(held)


def test_all_queries_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
