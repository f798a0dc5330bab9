"""Every stage of the pipeline on nulls, empty and very long texts, repeated rows, ties, and columns with names of its own."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hindsail.llm.common import read_table, written

STAGES = dict(corpus_pipeline.STAGES)
CLASHING = ("key", "text_key", "FIRST_ID", "component_id", "node", "mixing_p", "mixing_tokens", "mixing_copy", "_group", "deal", "spans", "score", "label")


@pytest.fixture(scope="module")
def documents(spark, small):
    """The smallest table, odd rows with negative ids, and columns that operators use inside."""
    r = random.Random(3)
    long = " ".join("".join(r.choice("aeinorst") for _ in range(r.randint(2, 9))) for _ in range(150_000))
    plain = "the same few words stand here more than once in this text, and end with a stop."
    rows = [(-1, None, None, None, None), (-2, "", "en", "web", 0), (-3, " \n\t", None, "web", 3), (-4, long, "en", None, len(long)), (-5, plain, "xx", "web", None), (-5, plain, "xx", "web", None), (-6, plain, None, None, 1), (None, plain, "en", "web", 1), (None, None, None, None, None), (-7, "mail a.b@c.org now " + plain, "de", "web", 1), (-8, "<|endoftext|>", "fr", "web", 13)]
    whole = read_table(spark, small, "documents")
    odd = spark.createDataFrame(rows, whole.schema)
    return written(whole.union(odd).withColumns({c: F.lit(f"own {c}") for c in CLASHING}), "odd")


def kept(rows):
    return Counter((r.doc_id, r.text, r.lang, r.source) for r in rows)


def test_quality(spark, small, documents):
    out = STAGES["quality classifier"](spark, documents, small)
    before, after = kept(documents.collect()), kept(out.collect())
    assert out.columns == documents.columns and after <= before and all(after[k] == before[k] for k in after)


def test_near_duplicates(spark, small, documents):
    out = STAGES["simhash near-dedup"](spark, documents, small)
    rows = out.collect()
    ids = Counter(r.doc_id for r in rows if r.doc_id is not None and r.doc_id < 0)
    # texts without words are one group, of which the smallest id stays; -5 and -6 are copies, and near ones of -7
    assert out.columns == documents.columns and ids == {-3: 1, -4: 1, -7: 1, -8: 1}
    assert sum(r.doc_id is None for r in rows) == 2 and all(r.component_id == "own component_id" and r.key == "own key" for r in rows)


def test_personal_data(spark, small, documents):
    out = STAGES["pii"](spark, documents, small)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == documents.columns and out.count() == documents.count()
    assert rows[-1].text is None and rows[-1].n_chars is None and rows[-2].text == "" and rows[-7].text.startswith("mail [EMAIL] now") and rows[-7].n_chars == len(rows[-7].text)


def test_mixing(spark, small, documents):
    out = STAGES["mixing to target weights"](spark, documents, small)
    before, after = kept(documents.collect()), kept(out.collect())
    assert out.columns == documents.columns and set(after) == set(before) and all(after[k] >= n for k, n in before.items())
    assert after[(-5, *[x for x in next(k for k in before if k[0] == -5)[1:]])] % 2 == 0


def test_packing(spark, small, documents):
    rows = STAGES["best-fit packing"](spark, documents, small).collect()
    first = Counter(r.doc_id for r in rows if r.piece == 0)
    assert first == Counter(r.doc_id for r in documents.select("doc_id").collect())
    assert [r.length for r in rows if r.doc_id in (-1, -2)] == [1, 1] and sum(r.doc_id == -4 for r in rows) > 50
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 2048
