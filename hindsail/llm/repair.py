"""Structure repair of conversations by a run-length, min-plus dynamic program.

A turn is one of twelve symbols: its role's initial (s, u, a or other) and
whether it is fine, truncated, or blank or a duplicate (which has to go). Edits
bring the initials into `(s?(ua)+)?`: Keep costs 0, Rerole to user or assistant
2, Delete 3, Insert an empty user or assistant turn 2; a truncated turn that is
not deleted adds 1. What a turn does to the costs of the four places in that
pattern is a 4 by 4 matrix over (min, +). Equal consecutive symbols are one
run; a run is a product of binary powers of its symbol's matrix, which are
cached. The audit, the cheapest edits' initials and of these the least in ASCII
order, is unrolled by halving those powers again.

A conversation is cut into chunks of CHUNK turns. Matrices of chunks and their
audits (for each place that a chunk can be entered in) are made in any task;
what has to be handed on from chunk to chunk, four costs backward and one place
forward, passes along a sorted partition, and texts stream by it. So no task
holds a conversation.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, slices
from .turns import numbered, spoken

CHUNK_BITS = 12
#: Places in the pattern: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a new user or assistant turn leads from each place.
NEXT = (USER, USER, ASSISTANT, USER)
#: Edits that close the pattern after the last turn, and their costs.
TAIL = ("", "II", "I", "")
TAIL_COSTS = (0, 4, 2, 0)
NEVER = 1 << 50
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Symbols: the role's class times 3, plus 0 fine, 1 truncated, 2 to be deleted.
SYMBOLS = "abcdefghijkl"
EDITS = "conv_id long, seq long, edit string, turn long, role string, text string, initial string, fault string"
WHITE = " \t\n\x0b\f\r"


def kept(kind: int, place: int) -> int | None:
    """Where a kept turn of a class (0 s, 1 u, 2 a, 3 other) leads from a place, if it may stand there."""
    if kind == 0:
        return SYSTEM if place == START else None
    return NEXT[place] if kind < 3 and NEXT[place] == (USER if kind == 1 else ASSISTANT) else None


@lru_cache
def choices(symbol: str, place: int) -> tuple[tuple[str, int, int], ...]:
    """(edits, cost, place after) of all ways past one turn, least edits first; none is the beginning of another. More than two inserts never pay."""
    kind, fault = divmod(SYMBOLS.index(symbol), 3)
    ways, at = [], place
    for inserts in range(3):
        letters, cost = "I" * inserts, INSERT * inserts
        ways.append((letters + "D", cost + DELETE, at))
        if fault < 2:
            if (to := kept(kind, at)) is not None:
                ways.append((letters + "K", cost + KEEP + TRUNCATED * fault, to))
            ways.append((letters + "R", cost + REROLE + TRUNCATED * fault, NEXT[at]))
        at = NEXT[at]
    return tuple(sorted(ways))


Matrix = tuple[tuple[int, ...], ...]


def times(x: Matrix, y: Matrix) -> Matrix:
    """The product over (min, +)."""
    columns = tuple(zip(*y))
    return tuple(tuple(min(map(int.__add__, row, column)) for column in columns) for row in x)


def ahead(x: Matrix, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before, from costs after."""
    return tuple(min(map(int.__add__, row, costs)) for row in x)


@lru_cache(maxsize=None)
def power(symbol: str, k: int) -> Matrix:
    """The matrix of 2^k turns of one symbol; 12 symbols times CHUNK_BITS + 1 powers at most."""
    if k:
        return times(power(symbol, k - 1), power(symbol, k - 1))
    return tuple(tuple(min((c for _, c, to in choices(symbol, i) if to == j), default=NEVER) for j in range(4)) for i in range(4))


def binary_runs(symbols: str) -> list[tuple[str, int]]:
    """Runs of equal symbols, each as (symbol, k) of its binary powers, highest first."""
    found = []
    for symbol, run in itertools.groupby(symbols):
        n = sum(1 for _ in run)
        found += [(symbol, k) for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
    return found


@lru_cache(maxsize=1 << 14)
def matrix_of(symbols: str) -> Matrix:
    """The matrix of a chunk."""
    parts = binary_runs(symbols)
    out = power(*parts[0])
    for part in parts[1:]:
        out = times(out, power(*part))
    return out


@lru_cache(maxsize=1 << 12)
def unrolled_power(symbol: str, k: int, place: int, costs: tuple[int, ...]) -> tuple[str, int]:
    """(edits, place after) of 2^k turns of one symbol on the cheapest way from a place, given what is still to pay after them."""
    if k:
        left, middle = unrolled_power(symbol, k - 1, place, level(ahead(power(symbol, k - 1), costs)))
        right, to = unrolled_power(symbol, k - 1, middle, costs)
        return left + right, to
    best = min(c + costs[to] for _, c, to in choices(symbol, place))
    return next((letters, to) for letters, c, to in choices(symbol, place) if c + costs[to] == best)


def level(costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs less the least of them, which decide alike and repeat more often."""
    return tuple(c - min(costs) for c in costs)


@lru_cache(maxsize=1 << 14)
def unroll(symbols: str, costs: tuple[int, ...], places: tuple[int, ...]) -> list[tuple[str, int]]:
    """(edits, place after) of a chunk for each place that it may be entered in."""
    parts, left = binary_runs(symbols), [level(costs)]
    for part in reversed(parts):
        left.append(level(ahead(power(*part), left[-1])))
    left.reverse()
    out = []
    for place in places:
        letters = []
        for part, rest in zip(parts, left[1:]):
            more, place = unrolled_power(*part, place, rest)
            letters.append(more)
        out.append(("".join(letters), place))
    return out


def _chunk_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        flat = [[c for row in matrix_of(s) for c in row] for s in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flat, pa.list_(pa.int64()))], ["conv_id", "chunk", "symbols", "m"])


def _costs_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a conversation come last first."""
    at, costs = (), TAIL_COSTS
    for batch in slices(batches):
        after = []
        for conv, m in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            if conv != at:
                at, costs = conv, TAIL_COSTS
            after.append(costs)
            costs = level(ahead(tuple(tuple(m[i : i + 4]) for i in range(0, 16, 4)), costs))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(after, pa.list_(pa.int64()))], ["conv_id", "chunk", "symbols", "costs"])


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        done = [unroll(s, tuple(c), (START,) if chunk == 0 else (0, 1, 2, 3)) for chunk, s, c in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
        made = pa.array([[letters for letters, _ in ways] for ways in done], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], ["conv_id", "chunk", "audits"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """EDITS from rows in order of conversation and place, each chunk's audits before its turns."""
    out: list[tuple] = []
    at, place, seq, letters = (), START, 0, iter("")

    def insert() -> None:
        nonlocal place, seq
        place, seq = NEXT[place], seq + 1
        out.append((at, seq, "I", None, "user" if place == USER else "assistant", "", None, None))

    def close() -> None:
        for _ in TAIL[place]:
            insert()

    def batch_of() -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
        made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 8, types)], [f.split(" ")[0] for f in EDITS.split(", ")])
        out.clear()
        return made

    for batch in slices(batches):
        for conv, pos, turn, role, text, initial, fault, audits in zip(*(c.to_pylist() for c in batch.columns)):
            if conv != at:
                close()
                at, place, seq, letters = conv, START, 0, iter("")
            if audits is not None:
                letters = iter(audits[place if len(audits) > 1 else 0])
            elif pos == 0:
                out.append((conv, 0, None, None, None, None, None, None))
            else:
                while (letter := next(letters)) == "I":
                    insert()
                seq += 1
                if letter == "K":
                    place = kept("sua".index(initial), place)
                elif letter == "R":
                    place = NEXT[place]
                    role = "user" if place == USER else "assistant"
                out.append((conv, seq, letter, turn, role, text, initial, fault))
        yield batch_of()
    close()
    yield batch_of()


def _ordered(turns: DataFrame) -> DataFrame:
    """What _apply() takes, sorted inside partitions by conversation."""
    tables = Scratch(turns.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    plain = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), F.col("present"))
    there = plain.where("present").drop("present").withColumn("said", spoken(F.col("role"), F.col("text")))
    end = F.right(F.rtrim(F.col("text"), F.lit(WHITE)), F.lit(1))
    rows = tables.put("rows", numbered(there, ["said"]).withColumn("end", end))
    again = rows.groupBy(F.col("conv_id").alias("c"), F.col("said").alias("x")).agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    seen = rows.join(again, rows["conv_id"].eqNullSafe(again["c"]) & (rows["said"] == again["x"]), "left")
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("end") == "", "blank").when(F.col("pos") > F.col("first"), "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated")
    marked = seen.select("conv_id", "pos", "turn", "role", "text", initial.alias("initial"), fault.alias("fault"))
    marked = tables.put("marked", marked)
    kind = F.coalesce(F.when(F.col("initial") == "", 3), F.when((x := F.instr(F.lit("sua"), F.col("initial"))) > 0, x - 1), F.lit(3))
    spoiled = F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0)
    symbol = F.substring(F.lit(SYMBOLS), (kind * 3 + spoiled + 1).cast("int"), F.lit(1))
    coded = marked.select("conv_id", F.shiftright(F.col("pos") - 1, CHUNK_BITS).alias("chunk"), F.struct("pos", symbol.alias("symbol")).alias("s"))
    chunks = coded.groupBy("conv_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["symbol"]), "").alias("symbols"))
    with_matrix = chunks.mapInArrow(_chunk_matrices, "conv_id long, chunk long, symbols string, m array<long>")
    backward = with_matrix.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("chunk")).mapInArrow(_costs_after, "conv_id long, chunk long, symbols string, costs array<long>")
    audits = backward.repartition("conv_id", "chunk").mapInArrow(_audits, "conv_id long, chunk long, audits array<string>")
    none = lambda t, *names: [F.lit(None).cast(t).alias(n) for n in names]
    heads = audits.select("conv_id", (F.shiftleft("chunk", CHUNK_BITS) + 1).alias("pos"), *none("long", "turn"), *none("string", "role", "text", "initial", "fault"), "audits")
    known = plain.where("not present").select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("pos"), *none("long", "turn"), *none("string", "role", "text", "initial", "fault"), *none("array<string>", "audits"))
    whole = marked.withColumn("audits", F.lit(None).cast("array<string>")).union(heads).union(known)
    return whole.repartition("conv_id").sortWithinPartitions("conv_id", "pos", F.col("audits").isNull())


def repair(turns: DataFrame) -> DataFrame:
    """The edits of turns(conv_id, turn, role, text, present boolean): EDITS, a row per turn and per inserted turn, in order of seq.

    edit is K, R, D or I; role and text are those after it; initial and fault
    (blank, duplicate, truncated) those before; turn and initial are null where
    a turn is inserted. A conversation's turns come by turn (null first), equal
    ones by a digest of role and text. Null roles and texts are one space, so
    such a text is blank and such a role is rerolled. Rows that are not present
    only name their conversation: it gets a row with seq 0 and no edit. A null
    conv_id is a conversation. Other columns are left out.
    """
    return _ordered(turns).mapInArrow(_apply, EDITS)


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """REPORT from rows of EDITS in order of conversation and seq."""
    done: list[tuple] = []
    names = ("blank", "duplicate", "truncated")
    prices = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
    at = ()

    def close() -> None:
        gaps = high - low + 1 - distinct if distinct else 0
        done.append((at, gaps, *(faults[f] for f in names), illegal, cost, "".join(audit), digest.hexdigest()))

    for batch in slices(batches):
        for conv, edit, turn, role, text, initial, fault in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6, 7))):
            if conv != at:
                if at != ():
                    close()
                at, faults, audit, digest = conv, dict.fromkeys(names, 0), [], hashlib.sha256()
                low = high = before = None
                distinct = illegal = cost = written = 0
            if edit is None:
                continue
            audit.append(edit)
            cost += prices[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
            if edit != "D":
                digest.update(f"{chr(10) * (written > 0)}{role}:{text}".encode())
                written += 1
            if edit == "I":
                continue
            if fault:
                faults[fault] += 1
            illegal += before is not None and before + initial not in ("su", "ua", "au")
            before = initial
            if turn is not None and turn != high:
                low, high, distinct = turn if low is None else low, turn, distinct + 1
        yield _told(done)
    if at != ():
        close()
    yield _told(done)


def _told(done: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 7 + [pa.string()] * 2
    made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done) if done else [[]] * 9, types)], [f.split(" ")[0] for f in REPORT.split(", ")])
    done.clear()
    return made


def repair_report(turns: DataFrame) -> DataFrame:
    """REPORT, one row per conversation, of what repair() does: gaps in turn numbers, turns by fault, adjacent initials other than su, ua, au (all of these before it), cost, audit, SHA-256 of the repaired `role:text` lines. A conversation without turns has zeros, an empty audit and the empty text's hash; an empty table has no rows."""
    return repair(turns).mapInArrow(_report, REPORT)


def damaged(turns: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) damaged by crc32(conv_id:turn) % 20: 0 drops the row (present is false), 1 empties its text, 2 removes its [.!?], 3 repeats it, 4 makes it a user's. Nulls are one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    rows = turns.select(F.col("conv_id"), F.col("turn"), told("role").alias("role"), told("text").alias("text"), k.alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("k") != 0).alias("present"), twice).drop("col")
