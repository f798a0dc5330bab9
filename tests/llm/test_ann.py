"""Nearest neighbours against all distances."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindsail.llm import ann
from hindsail.llm.queries import op12_ann

SCHEMA = "vec_id long, embedding array<double>, row long, asks string, v int, h1 int"


def exact(rows, k=10, every=100):
    """(query row, its k nearest as (score, id)) over the rows that take part; ids may repeat."""
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in fine), default=0)
    x, ids = np.array([[*v, *[0] * (width - len(v))] for _, v in fine], float).reshape(len(fine), width), np.array([i for i, _ in fine], int)
    out = []
    for q in np.flatnonzero(ids % every == 0):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, far)) if j != q][:k]
        out.append((int(ids[q]), [(far[j], int(ids[j])) for j in order]))
    return out


def searched(df):
    by = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect():
        by.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    return {q: sorted(found) for q, found in by.items()}


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], SCHEMA).repartition(4)


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(250)]
    rows += [(1000, None), (1100, []), (1200, [0.0, 0.0]), (1300, [1.0, None]), (1400, [math.nan, 1.0]), (1500, [math.inf]), (None, [1.0]), (1600, [0.5]), (1700, [1e300, 1.0, 1.0, 1.0])]
    want = dict(exact(rows))
    got = searched(frame(spark, rows))
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [r for r, *_ in found] == list(range(1, 11))
        assert [i for *_, i in found] == [i for _, i in want[q]] and np.allclose([s for _, s, _ in found], [s for s, _ in want[q]], rtol=1e-15)


def test_copies_and_repeated_ids(spark):
    rng = np.random.default_rng(2)
    same = [0.25, -1.0, 3.0]
    rows = [(i, same) for i in range(0, 900, 3)] + [(i, rng.normal(size=3).tolist()) for i in range(1, 600, 3)] + [(7, same)] * 3
    got = searched(frame(spark, rows))
    for q, near in exact(rows):
        assert [(s, i) for _, s, i in got[q]] == near
    twice = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (5, [0.0, 2.0])]
    found = ann.nearest(frame(spark, twice), F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found) == [(100, 1, 100), (100, 1, 100), (100, 2, 5), (100, 2, 5)]


def test_fewer_than_k_and_none(spark):
    assert searched(frame(spark, [(0, [1.0]), (1, [2.0]), (2, [4.0])])) == {0: [(1, 1.0, 1), (2, 3.0, 2)]}
    assert searched(frame(spark, [(0, [1.0])])) == {} == searched(frame(spark, []))


def test_far_queries_with_thin_lists_are_asked_everywhere(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 20)
    rng = np.random.default_rng(4)
    rows = [(i + 1, (rng.normal(size=8) + 50 * (i % 2)).tolist()) for i in range(400)] + [(900 + i, (rng.normal(size=8) * 0.01 - 5000).tolist()) for i in range(4)]
    got, want = searched(frame(spark, rows)), dict(exact(rows))
    assert [i for *_, i in got[900]][:3] == [i for _, i in want[900]][:3] and all(len(found) == 10 for found in got.values())


@pytest.mark.parametrize("spread", [0.1, 10.0])
def test_recall_over_many_lists(spark, monkeypatch, spread):
    monkeypatch.setattr(ann, "LIST", 50)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + spread * rng.normal(size=16)).tolist()) for i in range(6000)]
    got, want = searched(frame(spark, rows)), exact(rows)
    hits = sum(len({i for _, i in near} & {i for *_, i in got[q]}) for q, near in want)
    assert hits >= 0.9 * 10 * len(want) and all(s == dict((i, s) for s, i in exact(rows, 6000)[0][1]).get(i, s) for _, s, i in got[0])


def test_lists_are_balanced_and_the_graph_finds_the_nearest():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000, 16)).astype(np.float32)
    x[:6000] = x[0] + 0.2 * rng.normal(size=(6000, 16))  # a third in one place
    centroids, links, ratio = ann.fitted(x, len(x))
    lists = ann.lists_of(x, centroids, links)
    true = ann._squares(x, centroids).argmin(1)
    assert (lists[:, 0] == true).mean() > 0.97 and np.bincount(true).max() < 6 * ann.LIST
    wide = ann.flood(x[::500], centroids, links, ratio)
    to = np.sqrt(ann._squares(x[::500], centroids))
    assert np.mean([len(w) / (t <= ratio * t.min()).sum() for w, t in zip(wide, to)]) > 0.97
    clustered = np.repeat(rng.normal(size=(50, 16)), 200, axis=0).astype(np.float32) + 0.01 * rng.normal(size=(10_000, 16)).astype(np.float32)
    tight = ann.fitted(clustered, 10_000)
    assert np.mean([len(w) for w in ann.flood(clustered[::100], *tight)]) < 0.3 * len(tight[0])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    got = {}
    for r in op12_ann(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact(rows)
    assert sum(len({i for _, i in near} & got[q]) for q, near in want) >= 0.9 * 10 * len(want)


def test_queries_of_many_lists_are_not_broadcast(spark):
    """Spark takes what an explode or a Python function makes of few rows for few rows."""
    index = spark.range(3).select(F.col("id").cast("int").alias("list"), F.array(F.struct(F.col("id").alias("g"), F.array(F.lit(1.0)).alias("v"), F.array(F.struct(F.col("id").alias("vec_id"), F.col("id").alias("row"))).alias("ids"))).alias("members"))
    to = spark.range(40).select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("list"), F.col("id").alias("q"), F.array(F.lit(0.5)).alias("v"))
    met = ann.meet(index, to)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastExchange") == 1  # of the lists' counts
    assert plan.count("Exchange hashpartitioning") == 3  # the counts, the queries once, the index
    assert sorted((r.m, r.q) for r in met.select(F.explode("queries.q").alias("q"), F.col("members")[0]["g"].alias("m")).collect()) == [(m, q) for m in range(3) for q in range(40)]


def test_fitting_holds_few_distances_at_once(monkeypatch):
    x, held, squares = np.random.default_rng(9).normal(size=(6000, 4)).astype(np.float32), [], ann._squares
    monkeypatch.setattr(ann, "CELLS", 1 << 17)
    monkeypatch.setattr(ann, "_squares", lambda a, b: held.append(len(a) * len(b)) or squares(a, b))
    ann.fitted(x, 600_000)
    assert max(held) <= max(1 << 17, 256 * 1500, 16 * 6000)  # the charge's scale is of 256 rows, the rest in steps
