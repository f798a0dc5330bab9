"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of a narrow table, some 100 bytes each, that may be broadcast.
FEW = 200_000
#: Rows up to which counted() broadcasts.
SOME = 20_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder, opened by Spark's own reader only."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def unused(wanted: str, names: Iterable[str]) -> str:
    """wanted, with as many underscores put before it as make it differ from all names."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that a Python worker holds what it makes of few texts at once."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where none is named, a local master (as in tests) gets one of its own; a cluster is a RuntimeError, since its machines share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def if_few(df: DataFrame, rows: int = FEW) -> DataFrame:
    """df, a table of narrow rows, as the side of a join that is looked up: broadcast if its rows, counted, are within the bound, else shuffled and hashed, so that the other side is not sorted."""
    return F.broadcast(df) if df.count() <= rows else df.hint("shuffle_hash")


def counted(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df as a side of a join that goes by its rows, counted unless a bound of them is told: broadcast if they are few, else sorted and merged, with neither side broadcast. For tables that Spark sizes too low, since files are smaller than rows in memory, and what comes out of an explode counts as what goes in."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= SOME else df.hint("merge")


class Scratch:
    """Parquet tables of one job in the shared folder: lineage ends at each, and a lost executor costs nothing."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/hindsail-{uuid.uuid4().hex}"

    def put(self, tag: str, df: DataFrame) -> DataFrame:
        """df as a table, read again."""
        df.write.parquet(f"{self.folder}/{tag}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{tag}")

    def drop(self, *tags: str) -> None:
        """Removes tables that nothing reads any more."""
        jvm, context = self.spark._jvm, self.spark.sparkContext
        for tag in tags:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{tag}")
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table of its own in the shared folder, read again."""
    return Scratch(df.sparkSession).put(tag, df)
