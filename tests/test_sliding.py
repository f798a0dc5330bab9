"""Neighbours of every row among the rows before it against a loop."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest

from hindsail.operators.sliding import conditional_calibration_each, sliding_neighbours

START = dt.datetime(2024, 1, 1)
WEIGHTS = {"a": 1.0, "b": 1.5}
SCHEMA = "k string, id long, ts timestamp_ntz, a double, b double, y int, pool string"


def made(seed: int, n: int, key: str | None, first: int):
    """Ties in time and distance, missing and constant features, times before and after others."""
    r = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += r.choice([0, 1, 1, 40])
        a = None if r.random() < 0.1 else float(r.randrange(6))
        b = 0.1 if key == "flat" else r.choice([None, r.gauss(0, 1), 0.5])
        rows.append((key, first + i, None if r.random() < 0.02 else START + dt.timedelta(hours=t), a, b, r.choice([0, 1, None]), "x"))
    return rows


HISTORY = [*made(1, 160, "long", 0), *made(2, 60, "flat", 1000), *made(3, 8, "short", 2000), *made(4, 5, None, 3000)]
# a third of the queries are copies of one row
QUERIES = [*made(5, 60, "long", 5000), *made(6, 20, "flat", 6000), *made(7, 12, "short", 7000), *made(8, 4, None, 8000), ("absent", 9000, START, 1.0, 1.0, 1, "x"), *[("long", 9001, START + dt.timedelta(hours=900), 2.0, 0.5, 1, "x")] * 48]


def by_loop(q, k: int, pool: int):
    """(pool size, [(id, distance)]) of one query."""
    past = sorted((h for h in HISTORY if h[0] == q[0] is not None and q[2] and h[2] and h[2] < q[2]), key=lambda h: (h[2], h[1]))[::-1][:pool]
    total, usable = [0.0] * len(past), False
    for f, weight in ((3, 1.0), (4, 1.5)):
        known = [h[f] for h in past if h[f] is not None]
        if len(known) < 5 or q[f] is None:
            continue
        usable = True
        mean = math.fsum(known) / len(known)
        std = 1.0 if min(known) == max(known) else math.sqrt(math.fsum((v - mean) ** 2 for v in known) / len(known))
        total = [d + (0 if h[f] is None else weight * ((q[f] - h[f]) / std) ** 2) for d, h in zip(total, past)]
    ranked = sorted((round(math.sqrt(d), 9), n) for n, d in enumerate(total)) if usable else []
    return len(past), [(past[n][1], d) for d, n in ranked[:k]]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(QUERIES, SCHEMA).repartition(3), spark.createDataFrame(HISTORY, SCHEMA).repartition(3)


@pytest.mark.parametrize("pool, block", [(30, 32), (50, 8), (300, 1024)])
def test_neighbours_are_the_loops(tables, pool, block):
    got = sorted((r.row.id, r.pool, [(n.id, round(n.dist, 7)) for n in r.neighbours]) for r in sliding_neighbours(*tables, ["k"], WEIGHTS, 7, pool=pool, block=block).collect())
    loop = lambda q: by_loop(q, 7, pool)
    assert got == sorted((q[1], loop(q)[0], [(i, round(d, 7)) for i, d in loop(q)[1]]) for q in QUERIES)


def test_share_of_ups(tables):
    ups = {h[1]: h[5] for h in HISTORY}
    out = conditional_calibration_each(*tables, ["k"], WEIGHTS, k=9, min_neighbors=6, pool=40, y="y", block=16)
    assert out.columns == [*tables[0].columns, "p_up_conditional", "n_neighbors"]
    for r in out.collect():
        near = by_loop(next(q for q in QUERIES if q[1] == r.id), 9, 40)[1]
        known = [ups[i] for i, _ in near if ups[i] is not None]
        assert (r.n_neighbors, r.p_up_conditional) == ((len(near), pytest.approx(sum(known) / len(known))) if len(near) >= 6 else (None, None))
    assert out.count() == len(QUERIES)


def test_nothing(tables):
    queries, history = tables
    assert sliding_neighbours(queries.limit(0), history, ["k"], WEIGHTS, 3).count() == 0
    assert {(r.pool, len(r.neighbours)) for r in sliding_neighbours(queries, history.limit(0), ["k"], WEIGHTS, 3).collect()} == {(0, 0)}
