"""The conversation trie against a dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from hindsail.llm import trie
from hindsail.llm.queries import op13_trie

SCHEMA = "conv_id long, turn long, role string, text string, pos string, block int, t1 int"


def plain_trie(rows):
    """Every prefix as a tuple, its subtree walked."""
    said = lambda r, x: hashlib.md5(f"{len(r)}\n{r}{x}".encode()).hexdigest()
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, said(r or "", x or ""), r or "", x or ""))
    own = {c: [v[3:] for v in sorted(turns)] for c, turns in own.items()}
    members, below = {}, {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append((c, len(whole)))
    for p in members:
        for d in range(len(p) + 1):
            below.setdefault(p[:d], []).append(p)
    found = []
    for p, m in members.items():
        kids = lambda q: sum(1 for x in below[q] if len(x) == len(q) + 1)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below[p] if q)
        ends = ",".join(str(c) for c in sorted(c for c, n in m if n == len(p)))
        found.append((min(m)[0], len(p), min(members[p[:-1]])[0] if p else None, len(m), kids(p), sum(not kids(q) for q in below[p]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found)


def built(df):
    return sorted(tuple(r) for r in trie.prefix_trie(trie.grafted(trie.turn_ids(df))).collect())


def test_shared_heads_long_and_odd_conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "日本"])) for c in range(40) for t in range(rng.choice([1, 2, 9, 30]))]
    rows += [(c, 25 * t, "user", str(t % 3)) for c in (100, 105, 110) for t in range(120)]  # three pieces of turn numbers
    rows += [(7, 2, "user", "again")] * 3  # repeated rows
    rows += [(None, 1, "user", "x"), (200, None, None, None), (200, 1, "", ""), (-3, 5, "user", "n" * 30_000), (201, 0, "us", "er"), (202, 0, "user", "")]
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(5)
    assert built(df) == plain_trie(rows)


def test_copies_are_members_of_one_path(spark):
    rows = [(5 * c, t, "user", f"same {t}") for c in range(3000) for t in range(2)]
    got = built(spark.createDataFrame([(*r, "", 0, 0) for r in rows], SCHEMA))
    assert got == plain_trie(rows) and len(got) == 3 and {r[3] for r in got} == {3000}


def test_no_conversations(spark):
    assert built(spark.createDataFrame([], SCHEMA)) == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    assert sorted(tuple(r) for r in op13_trie(spark, folder).collect()) == plain_trie(rows)
