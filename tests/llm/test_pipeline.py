"""The registered operator queries and the pipeline: schemas, SQL where it exists, and brute force for the stages."""

import hashlib

import harness
import numpy as np
import pytest
from test_edges import shingles

import corpus_pipeline
from dossierflow.llm import bpe_codec, queries

COLUMNS = {
    "op2_minhash_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op3_bpe_codec": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op4_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op6_document_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op7_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op8_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op9_line_dedup": {"doc_id", "text", "n_lines", "n_removed"},
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    assert harness.ours(queries.QUERIES[name](spark, sf)) == harness.oracle(sf, queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_one_row_a_document(spark, sf, name):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = queries.QUERIES[name](spark, sf)
    assert COLUMNS[name] <= set(out.columns)
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_benchmark_passages_are_found(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = {d.doc_id for d in docs if any(i in d.text for i in items)}
    assert whole <= {r.doc_id for r in queries.QUERIES["op1_benchmark_decontamination"](spark, sf).collect()}


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages, texts = dict(corpus_pipeline.STAGES), []
    for name in ("language_id", "line_dedup", "minhash_dedup", "decontamination"):
        docs = spark.createDataFrame(stages[name](spark, docs, sf).collect(), docs.schema)
        texts.append({r.doc_id: r.text for r in docs.collect()})
    known, lines, unique, clean = texts
    assert len(known) >= 199 and set(lines) == set(known)
    seen = [x for t in lines.values() for x in t.split("\n") if len(x) >= 16]
    assert len(seen) == len(set(seen))
    sets = {i: shingles(t) for i, t in lines.items()}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    assert set(unique) == {i for i in sets if top(i) == i}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not [i for i, t in clean.items() if any(x in t for x in items)] and len(clean) >= 0.8 * len(unique)
    final = stages["bpe_codec"](spark, docs, sf).collect()
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe_codec.vocabulary_path())
    for r in final:
        ids = library.encode(clean[r.doc_id] or "", add_special_tokens=False).ids
        assert r.token_ids == np.array(ids, "<u4").tobytes() and r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert set(clean) == {r.doc_id for r in final}


def test_pipeline_links_lines_without_a_common_block(spark, sf):
    line = "and the reingsh esing thlyre or in of the that oferor inin onwh and nd antione andre erednd ouin"
    edited = "".join("y" if k % 7 == 3 and c != " " else c for k, c in enumerate(line))
    docs = spark.createDataFrame([(1, line), (2, edited)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in corpus_pipeline.unique_lines(spark, docs, sf).collect()} == {1: line, 2: ""}


def test_pipeline_on_no_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
