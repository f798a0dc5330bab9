"""The training-data pipeline: documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hindsail.llm import mixing, packing, pii, quality, simhash
from hindsail.llm.common import counted, if_few, read_table, unused, written
from hindsail.llm.components import component_labels

#: No stage but the second could be told in SQL, and all build on the first.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranker accepts, in one pass over their texts. A null text counts as empty; rows with equal texts stay or go together, repeated or not; without labels of both kinds nothing goes."""
    return quality.keep_good(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Texts are linked by SimHash (fingerprints at most 4 bits apart, the method), and texts too far apart for 64 bits by their shingle sets (five words, similarity 0.8); a group is what either reaches.

    Null and empty texts, and those of white space, are one group. Rows without
    an id, and rows that repeat id and text, are kept. docs may have columns of
    any name.
    """
    key, first = (unused(n, docs.columns) for n in ("text_key", "first_id"))
    keyed = docs.withColumn(key, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    near = simhash.near_copies(docs)
    # every text with its SimHash class, named by a text of it
    texts = keyed.select(F.col(key).alias("doc_id"), "text")
    alike = written(simhash.near_duplicates(texts).select(F.col("doc_id").alias("key"), F.col("component_id").alias("to")).distinct(), "alike")
    named = near.groupBy("component_id").agg(F.min("key").alias("to"))
    joined = near.join(counted(named, near.count()), "component_id").select("key", "to").union(alike)
    labels = component_labels(joined.where("key <> to").select(F.col("key").alias("a"), F.col("to").alias("b")))
    parts = near.join(counted(labels), near["key"] == labels["node"], "left").select("key", "component_id", F.coalesce("label", "key").alias("part"))
    smallest = parts.groupBy("part").agg(F.min("component_id").alias("smallest"))
    copies = written(parts.join(smallest, "part").select(F.col("key").alias(key), F.col("smallest").alias(first)), "copies")
    # those that go, by id and text, so that a text of very many documents is no key of its own
    gone = keyed.select("doc_id", key).join(copies, key).where(F.col("doc_id") != F.col(first)).select("doc_id", key).distinct()
    return keyed.join(if_few(written(gone, "gone")), ["doc_id", key], "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; n_chars follows the text. Null texts stay null, repeated rows stay."""
    masked = pii.mask_pii(docs, pii.train_tagger(pii.labelled_table(spark)))
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their fitted rates, so that languages reach their target shares; none is lost. A null or empty text has no tokens and a rate like any other; repeated rows are repeated alike."""
    return mixing.resample(docs, mixing.labelled_sample(docs, read_table(spark, sf_dir, "labels")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences. A null or empty text is one token; every repeated row has pieces of its own; columns besides doc_id and text are left out."""
    return packing.pack(packing.tokenize(docs))


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing to target weights", mix_to_targets),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
