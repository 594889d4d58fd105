"""The registered queries: SQL answers, whole tables, and the pipeline against a plain version."""

import hashlib
import re
import sys
from pathlib import Path

import compare
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from earshot.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_its_sql(spark, small_dir, name):
    assert compare.differences(queries.QUERIES[name](spark, small_dir), compare.connect(small_dir), queries.SQL[name]) == []


@pytest.mark.parametrize("name", ["op4_license_scan", "op7_packing", "op9_sharding"])
def test_query_reads_all_documents(spark, small_dir, name):
    found = queries.QUERIES[name](spark, small_dir)
    n = spark.read.parquet(f"{small_dir}/documents.parquet").count()
    if name == "op7_packing":
        assert len({d for r in found.collect() for row in r.doc_ids for d in row}) == n
    else:
        assert found.count() == n


@pytest.mark.parametrize("planted", [3, 40])
def test_secrets_planted_in_documents_are_found(spark, small_dir, tmp_path, planted):
    """Few and many secrets among documents that hold none, against a plain scan of the texts."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(-1 - i, f'Some words first.\ntoken = "{key(i)}"\nand more', "en", "planted", 80) for i in range(planted)]
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op2_secret_scan"](spark, str(tmp_path)).where("is_secret").select("doc_id", "start", "end")
    texts = [*((r.doc_id, r.text or "") for r in docs.collect()), *((d, t) for d, t, *_ in rows)]
    plain = [(d, m.start(1), m.end(1)) for d, t in texts for m in re.finditer('token = "([0-9a-f]{40})"', t)]
    assert sorted(map(tuple, found.collect())) == sorted(plain) and len(plain) >= planted


def test_pipeline_stages_keep_clean_documents(spark, small_dir, tmp_path):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, small_dir).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "quality_rules":
            want = {d for d, t in before if not brute.quality_counts(t)[-1]}  # too few labels here for a cutoff
        elif name == "near_dedup":
            want = {d for d, _, _, k in brute.near_duplicates(before, 5, 80) if k}
        elif name == "decontamination":
            want = {d[0] for d in brute.decontamination(before, items) if not d[-1]}
        else:
            want = {d for d, _ in before}
        assert kept == want, name
        if name != "bpe_encoding":
            assert after.columns == docs.columns
        if name == "pii":
            assert not any(any(brute.personal_data(r.text).values()) for r in after.collect())
        docs = after
    assert sorted(kept) == sorted(r.doc_id for r in corpus_pipeline.run(spark, small_dir).collect())
