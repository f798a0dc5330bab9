"""The quality fit stands on every labelled document."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindsail.functions import ranks
from hindsail.llm import quality


def rows(spark, n, bad):
    """n documents; those with an id divisible by `bad` are bad and full of symbols, by an amount of their own."""
    i = F.col("id")
    docs = spark.range(n).select(i.alias("doc_id"), F.concat(F.lit("plain words "), F.repeat(F.lit("abc de "), (i % 23).cast("int")), F.when(i % bad == 0, F.repeat(F.lit("# "), (i % 7 + 3).cast("int"))).otherwise(""), i.cast("string")).alias("text"))
    return docs, spark.range(n).select(i.alias("doc_id"), (i % bad != 0).cast("int").alias("quality"))


def test_labels_beyond_any_bound_change_the_model(spark):
    docs, labels = rows(spark, 26_000, 5)
    kept = labels.where(~quality.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(20_000)
    first, every = quality.train(docs, labels.join(kept.select("doc_id"), "doc_id", "left_semi")), quality.train(docs, labels)
    assert not np.allclose(first.mean, every.mean, rtol=1e-12, atol=0)
    x = np.array([quality.describe(r.text.encode()) for r in docs.where(~quality.held_out(F.col("doc_id"))).collect()])
    assert np.allclose(every.mean, x.mean(axis=0)) and np.allclose(every.edges, np.quantile(x, np.arange(1, quality.BINS) / quality.BINS, axis=0).T)


@pytest.mark.parametrize("partitions", [1, 7])
def test_tables_give_the_fit_of_arrays(spark, partitions):
    docs, labels = rows(spark, 900, 4)
    known = docs.join(labels, "doc_id").where(~quality.held_out(F.col("doc_id"))).collect()
    plain = quality.fit(np.array([quality.describe(r.text.encode()) for r in known]), np.array([r.quality for r in known]))
    model = quality.train(docs.repartition(partitions), labels.repartition(partitions))
    assert np.allclose(model.weights, plain.weights, atol=1e-7) and model.threshold == pytest.approx(plain.threshold) and model.width == pytest.approx(plain.width)


def test_every_row_is_in_a_block_with_the_other_label(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 100)
    table = spark.range(3000).select(F.array(F.col("id").cast("double")).alias("features"), (F.col("id") >= 5).cast("int").alias("quality"), F.lit(1).alias("n"))
    blocks = [{(i.features[0], i.quality) for i in r["items"]} for r in quality._blocks(table, {0: 5, 1: 2995}).collect()]
    assert all({q for _, q in b} == {0, 1} for b in blocks) and sum(q for b in blocks for _, q in b) == 2995 and max(map(len, blocks)) < 200


def test_weighted_places(spark):
    table = spark.createDataFrame([(1, float(v), v % 3 + 1) for v in range(500)], "k int, v double, n int")
    whole = sorted(float(v) for v in range(500) for _ in range(v % 3 + 1))
    assert ranks.order_statistics(table, ["k"], "v", [0, 7, 500, 998], "n", parts=8, whole=16).first()["at"] == [whole[p] for p in (0, 7, 500, 998)]
