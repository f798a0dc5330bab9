"""Registered queries over the smallest tables, and the pipeline stage by stage."""

from __future__ import annotations

import hashlib

import compare
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hindsail.llm import pii, quality, queries, simhash
from hindsail.llm.common import read_table, written


def test_registered():
    import __spark_entry__

    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert [n for n in queries.QUERIES if n.startswith("op")] == list(queries.QUERIES) and len(queries.QUERIES) == len({n.split("_")[0] for n in queries.QUERIES})


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, small, name):
    assert compare.differences(queries.QUERIES[name](spark, small), queries.ORACLE_SQL[name], compare.connect(small)) == []


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op3_chat", "op7_urlfilter", "op8_topk", "op2_packing", "op11_repair", "op12_ann", "op13_trie")])
def test_a_row_per_document(spark, small, name):
    ids = sorted(r[0] for r in queries.QUERIES[name](spark, small).select("doc_id").collect())
    assert ids == sorted(r[0] for r in read_table(spark, small, "documents").select("doc_id").collect())


def test_chat_digests(spark, small):
    turns = {}
    for r in sorted(read_table(spark, small, "conversations").collect(), key=lambda r: r.turn):
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    turns[-1] = [("user", queries.FORGED), ("assistant", queries.FORGED)]
    rows = {r.conv_id: r for r in queries.op3_chat(spark, small).collect()}
    assert rows.keys() == turns.keys()
    for c, t in turns.items():
        loss = "".join(x for role, x in t if role == "assistant")
        assert rows[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
        assert (rows[c].n_turns, rows[c].loss_chars, rows[c].loss_sha256) == (len(t), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_native_queries_stay_native(spark, small):
    for name in ("op1_sharding", "op7_urlfilter"):
        plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "ExistingRDD")), name


def test_pipeline_stages(spark, small):
    documents = read_table(spark, small, "documents")
    kept = {}
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, small), "t")
        kept[name] = (before, docs)
        if name != "best-fit packing":
            assert docs.columns == documents.columns
    before, after = kept["quality classifier"]
    model = quality.train(before, read_table(spark, small, "labels"))
    good = {r.doc_id for r in quality.score_all(before, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in after.collect()} == good and len(good) > 0.7 * before.count()
    before, after = kept["simhash near-dedup"]
    part = {r.key: r.component_id for r in simhash.near_copies(before).collect()}
    groups = {}
    for r in before.collect():
        groups.setdefault(part[hashlib.md5(r.text.encode()).hexdigest()], set()).add(r.doc_id)
    assert {r.doc_id for r in after.collect()} == set(groups) and all(min(g) == c for c, g in groups.items())
    before, after = kept["pii"]
    assert after.count() == before.count()
    assert not any(pii.base_spans(r.text) for r in after.collect()) and after.where(F.char_length("text") != F.col("n_chars")).count() == 0
    before, after = kept["mixing to target weights"]
    assert after.select("doc_id").distinct().count() == before.count() < after.count()
    before, after = kept["best-fit packing"]
    assert after.where("piece = 0").count() == before.count()
    ends = after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 2048 for r in ends)


def test_pipeline_on_empty_documents(spark, small, tmp_path):
    import shutil

    shutil.copy(f"{small}/labels.parquet", tmp_path / "labels.parquet")
    read_table(spark, small, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
