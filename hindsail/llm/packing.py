"""Best-fit packing of tokenised documents into sequences of at most 2048 tokens.

Sum-of-squares packing: with N(g) open sequences that have g tokens free, each
piece goes where the sum of N(g)^2 over all gaps g becomes smallest. Gaps thus
stay evenly spread and some gap nearly always fits the next piece exactly.

Pieces are counted and dealt into groups of about `group_rows` of them, large enough that what
a group leaves open is a fraction of a thousandth, and of a fixed size, so more
data means more groups and not larger ones. Inside a group pieces come longest
first, and a new sequence is opened only for a piece that fits no open one.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, written

CAPACITY = 2048
END_ID = 0
GROUP_ROWS = 40_000
VOCABULARY = "byte_bpe_50k"
#: The added token of the tokenizers file.
ADDED = {"<|endoftext|>": 50256}


def tokenizer_path() -> str:
    """The ranks of the public byte-level BPE vocabulary on this machine (installed with Python on every executor)."""
    import public_tokenizers

    return public_tokenizers.path(f"{VOCABULARY}.tiktoken")


def encoder(path: str | None = None):
    """Encoder with the ids of the byte-level BPE file; encode_of() also gives its added token."""
    import public_tokenizers
    import tiktoken

    with open(path or tokenizer_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)


def encode_of(path: str | None = None):
    """Text -> ids as the tokenizers file gives them: the added token is one id wherever its string stands."""
    own = encoder(path)
    return lambda text: own.encode(text, allowed_special="all")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, after a first one that takes the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece int, start long, length long, ids_crc32 long, deal long (a hash that deals rows evenly), and ids array<int> if asked for.

    A null or empty text has the one id END_ID. Repeated rows each give their
    own pieces. Other columns are left out. deal depends on a row's content
    alone, so a task that runs again deals alike; rows that repeat an id and
    text, and rows without an id, are told apart by how often that was seen in
    the partition.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    fields = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, deal long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encode_of(path), Counter()
        for batch in slices(batches):
            rows, kept, owner = [], [], []
            for k, (name, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                whole = zlib.crc32(ids.tobytes())
                seen[name, whole] += 1
                if name is None:
                    name = f"{whole} {seen[name, whole]}"
                elif seen[name, whole] > 1:
                    name = f"{name} {whole} {seen[name, whole]}"
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    crc = zlib.crc32(part.tobytes())
                    rows.append((piece, start, length, crc, zlib.crc32(f"{name} {piece} {crc}".encode())))
                    owner.append(k)
                    if with_ids:
                        kept.append(part.astype("int32"))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.int64()] * 4))] if rows else [pa.array([], t) for t in (pa.int32(), *[pa.int64()] * 4)]
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), *columns]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "deal", "ids"][: len(columns)])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, fields)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) of each length by sum-of-squares packing, longest first.

    Moving a sequence from gap g to g - s changes the sum of squares by
    2 (N(g - s) - N(g)) + 2, and by 1 - 2 N(s) where the piece fills it. Ties
    go to the smaller gap, then to the sequence that came to that gap last.
    """
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(capacity, np.int64)  # by gap, 1 .. capacity - 1
    waiting: list[list[int]] = [[] for _ in range(capacity)]
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        own = count[size:]
        change = np.where(own > 0, 2 * (count[: capacity - size] - own) + 2, np.iinfo(np.int64).max)
        if len(change) and own[0]:
            change[0] = 1 - 2 * own[0]
        best = int(change.argmin()) if len(change) else 0
        if len(change) and own[best]:
            gap = size + best
            into = waiting[gap].pop()
            count[gap] -= 1
        else:
            gap, into, opened = capacity, opened, opened + 1
        sequence[i], offset[i] = into, capacity - gap
        if gap > size:
            waiting[gap - size].append(into)
            count[gap - size] += 1
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Columns of tokenize()'s pieces (ids too, if there) without deal, plus sequence_id long and offset long.

    The pieces are written as a table and counted, so that groups have about
    group_rows of them however long documents are. No row is lost: equal pieces
    are placed one by one.
    """
    pieces = written(pieces, "pieces")
    groups = max(1, math.ceil(pieces.count() / group_rows))
    kept = [f for f in pieces.schema.fields if f.name != "deal"]
    names = [f.name for f in kept]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = sum_of_squares(part["length"].to_numpy(), capacity)
        return part[names].assign(sequence_id=sequence + (int(key[0]) << 40), offset=offset)

    return pieces.withColumn("_group", F.col("deal") % groups).groupBy("_group").applyInPandas(run, fields)
