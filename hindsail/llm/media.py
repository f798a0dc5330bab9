"""Media columns: ISO base media containers in a binary column.

encode_media() stores each payload as raw samples of 192 bytes in an ISO base
media file (ftyp, moov with one track, mdat). index_media() walks the nested
boxes of any such file, decodes the sample tables (stts, stsc, stsz, stco or
co64, stss) and returns codec, timing and the byte ranges of keyframes from
those tables alone: payload bytes are never decoded. read_payload() joins the
samples' byte ranges back to the payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Fixed values of the stored form.
UNIT = 192  # bytes of a sample; payloads are padded with PAD to a positive multiple
PAD = b" "
CODEC = b"raw "
TIMESCALE = 1000
SAMPLE_TICKS = 40
SAMPLES_PER_CHUNK = 16
KEY_EVERY = 12
#: Boxes whose content is boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(text: bytes | None) -> bytes:
    body = text or b""
    return body + PAD * ((-len(body)) % UNIT or (UNIT if not body else 0))


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size < 1 << 32:
        return b"".join((struct.pack(">I4s", size, kind), *parts))
    return b"".join((struct.pack(">I4sQ", 1, kind, size + 8), *parts))


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(payload: bytes) -> bytes:
    """An ISO base media file with the payload's samples of UNIT bytes; keyframes are every KEY_EVERY samples from the first."""
    count = len(payload) // UNIT
    ticks = count * SAMPLE_TICKS
    chunks, rest = divmod(count, SAMPLES_PER_CHUNK)
    runs = [(1, SAMPLES_PER_CHUNK)] * (chunks > 0) + [(chunks + 1, rest)] * (rest > 0)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def moov(first: int) -> bytes:
        step = UNIT * SAMPLES_PER_CHUNK
        offsets = first + step * np.arange(chunks + (rest > 0), dtype=np.int64)
        wide = bool(len(offsets)) and int(offsets[-1]) >= 1 << 32
        keys = np.arange(1, count + 1, KEY_EVERY, dtype=">u4")
        entry = box(CODEC, bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", 8, 8), bytes(50))
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, count, SAMPLE_TICKS)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, n, 1) for a, n in runs)),
            full(b"stsz", struct.pack(">II", UNIT, count)),
            full(b"co64" if wide else b"stco", struct.pack(">I", len(offsets)), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0)),
            full(b"hdlr", bytes(4), b"vide", bytes(12), b"payload\0"),
            box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
        )
        track = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, ticks), bytes(16), MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=7)
        movie = full(b"mvhd", struct.pack(">IIII", 0, 0, TIMESCALE, ticks), struct.pack(">IHH", 0x10000, 0x100, 0), bytes(8), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", movie, box(b"trak", track, media))

    head = 8 if len(payload) + 8 < 1 << 32 else 16
    first = len(ftyp) + len(moov(1 << 33 if len(payload) >> 32 else 0)) + head
    return ftyp + moov(first) + box(b"mdat", payload)


def boxes(data: memoryview, lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, content start, end) of the boxes in data[lo:hi]; stops at a box that does not fit."""
    while lo + 8 <= hi:
        size, kind = struct.unpack_from(">I4s", data, lo)
        at = lo + 8
        if size == 1 and lo + 16 <= hi:
            size, at = struct.unpack_from(">Q", data, lo + 8)[0], lo + 16
        end = hi if size == 0 else lo + size
        if end > hi or end < at:
            return
        yield kind, at, end
        lo = end


def walk(data: memoryview, lo: int, hi: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Every box under data[lo:hi] with its path, parents first."""
    for kind, at, end in boxes(data, lo, hi):
        yield (*path, kind), at, end
        if kind in NESTED and len(path) < 16:
            yield from walk(data, at, end, (*path, kind))


def tables(media: bytes) -> dict | None:
    """Codec, timescale, duration and the sample tables of the first track; None if the bytes hold no whole track."""
    data, found, tracks = memoryview(media), {}, 0
    for path, at, end in walk(data, 0, len(data)):
        tracks += path[-1] == b"trak"
        if tracks > 1:
            break
        found.setdefault(path[-1], (at, end))
    try:
        return _decode(data, found)
    except (KeyError, struct.error, ValueError, IndexError):
        return None


def _decode(data: memoryview, found: dict) -> dict:
    def numbers(kind: bytes, width: int = 4, skip: int = 8) -> np.ndarray:
        at, end = found[kind]
        (n,) = struct.unpack_from(">I", data, at + skip - 4)
        return np.frombuffer(data[at + skip : end], f">u{width}").astype(np.int64), n

    at, _ = found[b"mdhd"]
    timescale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    codec = bytes(data[found[b"stsd"][0] + 12 : found[b"stsd"][0] + 16]).decode("latin-1")
    times, n = numbers(b"stts")
    ticks = np.repeat(times[1 : 2 * n : 2], times[0 : 2 * n : 2])
    at, _ = found[b"stsz"]
    same, count = struct.unpack_from(">II", data, at + 4)
    sizes = np.full(count, same, np.int64) if same else numbers(b"stsz", skip=12)[0][:count]
    offsets, n = numbers(b"co64", 8) if b"co64" in found else numbers(b"stco")
    offsets = offsets[:n]
    runs, n = numbers(b"stsc")
    first, per = runs[0 : 3 * n : 3], runs[1 : 3 * n : 3]
    each = np.repeat(per, np.diff(np.append(first, len(offsets) + 1)))[: len(offsets)]
    chunk = np.repeat(np.arange(len(offsets)), each)[:count]
    before = np.concatenate(([0], np.cumsum(sizes)[:-1])) if count else sizes
    head = np.concatenate(([0], np.cumsum(each)[:-1])) if len(each) else each
    places = offsets[chunk] + before - before[head[chunk]]
    keys = numbers(b"stss")[0] - 1 if b"stss" in found else np.arange(count)
    if len(places) != count or len(ticks) != count:
        raise ValueError("sample tables disagree")
    return {"codec": codec, "timescale": timescale, "duration": duration, "places": places, "sizes": sizes, "ticks": ticks, "keys": keys}


def samples(media: bytes, found: dict) -> bytes:
    """The payload: all samples' byte ranges, read in order."""
    data, out = memoryview(media), []
    places, sizes = found["places"], found["sizes"]
    joined = np.flatnonzero(places[1:] != places[:-1] + sizes[:-1]) + 1  # starts of contiguous stretches
    for lo, hi in zip([0, *joined.tolist()], [*joined.tolist(), len(places)]):
        if hi > lo:
            out.append(data[int(places[lo]) : int(places[hi - 1] + sizes[hi - 1])])
    return b"".join(out)


INDEX = "codec string, timescale long, duration long, n_samples long, keyframes array<struct<time:long,offset:long,length:long>>"


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes long, media binary): each row's whole text as UTF-8, padded and muxed. A null text counts as empty; repeated rows stay; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo in range(0, len(texts), 64):  # small batches: a long text has room
                part = texts[lo : lo + 64]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)), pa.array([len(x or b"") for x in part], pa.int64()), pa.array([mux(padded(x)) for x in part], pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def index_media(media: DataFrame, with_payload_digests: bool = False) -> DataFrame:
    """All columns of media but the bytes, plus those of INDEX and media_bytes long; with_payload_digests adds payload_bytes, payload_sha256, tail_crc32 and media_sha256 of the stored bytes.

    Bytes that are null or hold no whole track give nulls, never an error.
    media may hold any columns beside `media`; those named like results are
    left out.
    """
    made = INDEX + ", media_bytes long" + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string" * with_payload_digests
    names = [x.strip().split(" ")[0] for x in "codec x,timescale x,duration x,n_samples x,keyframes x,media_bytes x,payload_bytes x,payload_sha256 x,tail_crc32 x,media_sha256 x".split(",")]
    kept = [f for f in media.schema.fields if f.name not in {"media", *names}]
    arrow = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("time", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    width = 10 if with_payload_digests else 6

    def one(stored: bytes | None) -> tuple:
        found = tables(stored) if stored else None
        size = None if stored is None else len(stored)
        if not found:
            return (*[None] * 5, size, None, None, None, hashlib.sha256(stored).hexdigest() if stored is not None else None)[:width]
        keys, begins = found["keys"], np.concatenate(([0], np.cumsum(found["ticks"])))
        ranges = [{"time": t, "offset": o, "length": n} for t, o, n in zip(begins[keys].tolist(), found["places"][keys].tolist(), found["sizes"][keys].tolist())]
        row = (found["codec"], found["timescale"], found["duration"], len(found["sizes"]), ranges, size)
        if not with_payload_digests:
            return row
        payload = samples(stored, found)
        return (*row, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), hashlib.sha256(stored).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * width, arrow)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*[f.name for f in kept], *names[:width]])

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return media.select(*[F.col(f.name) for f in kept], "media").mapInArrow(run, head + made)
