"""Rows that repeat an id and a text do not fall into one packing group."""

from __future__ import annotations

from collections import Counter

from hindsail.llm import packing


def test_repeated_rows_are_spread(spark):
    rows = [(7, "the same text")] * 900 + [(None, "the same text")] * 300 + [(100 + i, f"text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    pieces = packing.tokenize(df).collect()
    groups = Counter(r.deal % 10 for r in pieces if r.doc_id == 7)
    assert len(pieces) == 1500 and sum(groups.values()) == 900 and max(groups.values()) < 200
    assert sorted(map(str, pieces)) == sorted(map(str, packing.tokenize(df.orderBy("text")).collect()))
    packed = packing.pack(packing.tokenize(df), group_rows=150)
    assert packed.count() == 1500 and packed.where("doc_id = 7").count() == 900
