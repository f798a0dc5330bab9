"""The pipeline's near-dedup links texts by SimHash too."""

import random

import corpus_pipeline

from hindsail.llm import simhash


def test_texts_that_only_simhash_links(spark):
    # many repeats outweigh the few words by which the sets of shingles differ
    rng = random.Random(3)
    body = "one two three four five six seven " * 300
    texts = [body + " ".join(f"{tag}{rng.randrange(10**6)}" for _ in range(20)) for tag in "ab"]
    a, b = (simhash.fingerprint(t.encode()) & (2**64 - 1) for t in texts)
    x, y = (set(simhash.shingle_set(t.encode()).tolist()) for t in texts)
    assert bin(a ^ b).count("1") <= 4 and len(x & y) / len(x | y) < 0.8
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[1]), (3, "something else altogether, said in other words")], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
