import subprocess
from pathlib import Path

import corpus_pipeline
from tidemark.llm import decontam, neardup, packing, pii, quality
from tidemark.llm.registry import oracle_sql, queries, word_tokenizer

ROOT = Path(__file__).resolve().parents[2]


def test_stages_take_effect_on_what_is_kept(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "neardup", "decontam", "pii", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert sorted(after.columns) == sorted(docs.columns)
        ids, left = {r.doc_id for r in before.collect()}, {r.doc_id for r in after.collect()}
        if name == "quality":
            bad = {r.doc_id for r in quality.score_quality(before, labels).collect() if r.predicted == 0}
            assert bad and left == ids - bad
        elif name == "neardup":
            assert left == {r.doc_id for r in neardup.link_duplicates(before).collect() if r.kept}
        elif name == "decontam":
            assert left == {r.doc_id for r in decontam.find_passages(before, benchmark).collect() if not r.hits}
        elif name == "pii":
            assert left == ids and not any(pii.fixed_spans(r.text) for r in after.collect())
            assert all(r.n_chars == len(r.text) for r in after.collect())
        else:
            assert left == ids
            want = {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in packing.pack_documents(before, word_tokenizer()).collect()}
            last = {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in after.collect()}
            assert last == want
        before = after
    whole = {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == last


def test_stages_take_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []


def test_registry():
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in queries()} and "pipeline" in queries()
    assert set(oracle_sql()) <= set(queries())


def test_nothing_else_imports_the_operators():
    found = subprocess.run(["grep", "-rlE", r"(tidemark|\.)\.?llm", "--include=*.py", "."], cwd=ROOT, capture_output=True, text=True).stdout.split()
    assert {f for f in found if "/llm/" not in f} <= {"./__spark_entry__.py", "./corpus_pipeline.py", "./bench.py", "./tests/test_entry.py"}


def test_queries_run_over_the_small_tables(spark, sf):
    n = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("documents", "pages")}
    for name, f in queries().items():
        rows = f(spark, sf).collect()
        if name in ("op1_pii", "op2_licenses", "op3_neardup", "op5_decontam", "op6_quality", "op9_shards", "op10_fingerprints"):
            assert len(rows) == n["documents"], name
        elif name == "op8_urls":
            assert len(rows) == n["pages"]
        else:
            assert rows, name
