"""Conversation repair against a plain dynamic program over whole audits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from hindsail.llm import repair
from hindsail.llm.queries import op11_repair

SCHEMA = "conv_id long, turn long, role string, text string, seq long, edit string, pos int, said string"
BLANK = hashlib.sha256(b"").hexdigest()


def cheapest(rows):
    """(cost, audit, repaired) over (role, text, fault), a state for every prefix of the pattern, audits whole."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    name = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(2):
            for state, (cost, audit, said) in list(best.items()):
                for to in step[state].keys() & {"u", "a"}:
                    new = (cost + 2, audit + "I", [*said, f"{name[to]}:"])
                    if to not in best or new[:2] < best[to][:2]:
                        best[to] = new
        return best

    best = {"": (0, "", [])}
    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, said) in inserted(best).items():
            ways = [(state, 3, "D", [])]
            if fault in (None, "truncated"):
                late = fault is not None
                ways += [(to, late, "K", [f"{role}:{text}"]) for to in step[state] if role[:1] == to]
                ways += [(to, 2 + late, "R", [f"{name[to]}:{text}"]) for to in step[state].keys() & {"u", "a"}]
            for to, price, letter, more in ways:
                new = (cost + price, audit + letter, said + more)
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        best = after
    return min((best for state, best in inserted(best).items() if state in ("", "a")), key=lambda b: b[:2])


def plain(rows):
    """The whole report from rows of conversations."""
    found, convs = [], {}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        turns = convs.setdefault(c, [])
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        r = "user" if k == 4 else r
        said = hashlib.md5(f"{len(r)}\n{r}{x}".encode()).hexdigest()
        turns += [(t is not None, t or 0, said, r, x)] * {0: 0, 3: 2}.get(k, 1)
    for c, turns in convs.items():
        seen, marked = set(), []
        for *_, r, x in sorted(turns):
            solid = re.sub(r"[ \t-\r]", "", x)
            fault = "blank" if not solid else "duplicate" if (r, x) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((r, x))
            marked.append((r, x, fault))
        cost, audit, said = cheapest(marked)
        at = [n for known, n, *_ in turns if known]
        count = lambda f: sum(m[2] == f for m in marked)  # noqa: E731, B023
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        found.append((c, max(at) - min(at) + 1 - len(set(at)) if at else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(found, key=str)


@settings(max_examples=400, deadline=None)
@given(st.text("abcdefghijkl", max_size=14))
def test_audits_are_the_cheapest_and_least(symbols):
    rows = [({0: "s", 1: "u", 2: "a", 3: "x"}[k // 3], "", (None, "truncated", "blank")[k % 3]) for k in map(repair.SYMBOLS.index, symbols)]
    cost, audit, _ = cheapest(rows)
    letters, place = repair.unroll(symbols, repair.TAIL_COSTS, (0,))[0] if symbols else ("", 0)
    assert letters + repair.TAIL[place] == audit
    if symbols:
        assert repair.ahead(repair.matrix_of(symbols), repair.TAIL_COSTS)[0] == cost


def test_long_runs_take_few_products():
    symbols = "d" * 3000 + "g" * 1000
    rows = [("u", "", None)] * 3000 + [("a", "", None)] * 1000
    cost, audit, _ = cheapest(rows)
    letters, place = repair.unroll(symbols, repair.TAIL_COSTS, (0,))[0]
    assert letters + repair.TAIL[place] == audit and len(repair.binary_runs(symbols)) < 20


def built(df):
    return sorted((tuple(r) for r in repair.repair_report(repair.damaged(df)).collect()), key=str)


def test_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK_BITS", 3)  # many chunks
    rng = random.Random(5)
    texts = ["Yes.", "no", "", " \t", "Ha!", "Why? ", "日本", "end.\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(texts) + str(rng.choice(["", t]))) for c in range(60) for t in range(rng.choice([1, 2, 3, 9, 40]))]
    rows += [(70, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(0, 3000, 7)]
    rows += [(71, 3, "user", "Same.")] * 4 + [(72, None, None, None), (72, 2, "user", None), (None, 1, "user", "x."), (None, None, "assistant", "y."), (73, 1, "user", "w" * 50_000 + ".")]
    df = spark.createDataFrame([(*r, 9, "K", 1, "c") for r in rows], SCHEMA).repartition(7)
    assert built(df) == plain(rows)


def test_edits_are_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", True), (1, 1, "user", "Again", True), (2, 0, "system", "S.", True), (3, 0, "user", "gone.", False)], "conv_id long, turn long, role string, text string, present boolean")
    rows = sorted((r.conv_id, r.seq, r.edit, r.role, r.text, r.fault) for r in repair.repair(df).collect())
    assert rows == [(1, 1, "K", "user", "Hi.", None), (1, 2, "R", "assistant", "Again", "truncated"), (2, 1, "D", "system", "S.", None), (3, 0, None, None, None, None)]


def test_nothing(spark):
    assert built(spark.createDataFrame([], SCHEMA)) == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    assert sorted((tuple(r) for r in op11_repair(spark, folder).collect()), key=str) == plain(rows)
