"""Joins that Spark would broadcast because it sizes a side too low."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from hindsail.llm import common, simhash


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_not_broadcast(spark):
    nodes = spark.range(500).select(F.xxhash64("id").alias("fp"), F.lit(1).cast("long").alias("n"))
    nodes = common.written(nodes.union(nodes.withColumn("fp", F.col("fp").bitwiseXOR(F.lit(5)))), "nodes")
    index = simhash.postings(nodes, 3)
    assert "Broadcast" not in planned(index) and index.count() >= 1000 * 35  # seven bytes of eight are equal


def test_prefixes_and_verified_sets_are_not_broadcast(spark):
    sets = common.written(spark.range(50).select(F.col("id").alias("node"), F.sequence(F.col("id") % 5, F.col("id") % 5 + 200).alias("s")), "sets")
    assert "Broadcast" not in planned(simhash._prefixes(sets, 0.8))
    pairs = spark.range(25).select(F.col("id").alias("a"), (F.col("id") + 25).alias("b"))
    found = simhash._verified(pairs, sets, 0.8)
    assert "Broadcast" not in planned(found) and found.count() == 25


@pytest.mark.parametrize("some", [0, 20_000])
def test_counted_goes_by_rows(spark, monkeypatch, some):
    monkeypatch.setattr(common, "SOME", some)
    few = common.written(spark.range(30).withColumnRenamed("id", "k"), "few")
    joined = spark.range(60).withColumnRenamed("id", "k").join(common.counted(few), "k")
    assert ("Broadcast" in planned(joined)) == bool(some) and joined.count() == 30


def test_near_duplicates_without_broadcasts(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    bodies = [" ".join(rng.choices(words, k=80)) for _ in range(30)]
    rows = [(k, f"{bodies[k % 30]} {'end' if k % 3 else ''}") for k in range(120)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = lambda: (sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), sorted(map(tuple, simhash.near_duplicates(docs).collect())))
    with_broadcasts = told()
    monkeypatch.setattr(common, "SOME", -1)
    assert told() == with_broadcasts and with_broadcasts[0] == [*range(30), 500]
