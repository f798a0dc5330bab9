"""Approximate nearest neighbours over balanced posting lists.

Every vector stands in the list of its nearest centroid, and a boundary vector,
one that other centroids are nearly as near to, in theirs as well. Centroids
are fitted on a bounded sample by k-means that charges full clusters for more,
so lists come out even. They are few enough to be held in memory and are
searched by a graph of near centroids: a beam descends from a few entries, and
from where it ends a query floods on to all centroids within `ratio` times the
distance of the nearest one. Those are its lists. The ratio is measured when
the centroids are fitted: it is the one at which TARGET of the sample's true
neighbours lie in lists that a query visits, so it is tight on clustered data
and wide where distances say little.

Vectors, and the queries of a list, meet in blocks of bounded size: an
equi-join of blocks on their list, one NumPy product each, at most k + 1 rows a
query and block. Equal vectors are one entry that keeps its k + 1 smallest ids,
which is all that k neighbours can take of them. A query whose lists hold too
few vectors is asked again in all lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import Scratch

K = 10
#: Vectors of a list, on average.
LIST = 400
#: Rows and bytes of the sample that centroids are fitted on, and rows of it a centroid; beyond LIST * SAMPLE_ROWS / SAMPLE_EACH vectors lists grow, and with them the number of their blocks.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_EACH = 100_000, 64 << 20, 4
#: Share of true neighbours that a query's lists hold on the sample.
TARGET = 0.97
PROBES = 512
#: A vector stands in up to REPLICAS lists whose centroids are within EDGE times its nearest one's distance.
REPLICAS, EDGE = 3, 1.01
LINKS, BEAM, ENTRIES = 16, 24, 8
MEMBER_BLOCK, QUERY_BLOCK = 1024, 256
#: Distances that the driver holds at once when it fits centroids.
CELLS = 1 << 22


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of a matrix of doubles; shorter ones end in zeros."""
    sizes = np.array(column.value_lengths(), np.int64)
    flat, width = column.flatten().to_numpy(zero_copy_only=False), int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None] < sizes[:, None]] = flat
    return out


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def coarse(x: np.ndarray, width: int) -> np.ndarray:
    """Rows as single floats of one width, to look for lists; components are held where their squares stay finite."""
    return widened(np.clip(x, -1e15, 1e15).astype(np.float32), width)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y, up to rounding."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def _at_once(n: int) -> int:
    """Rows whose distances to n others are held at once."""
    return max(16, min(4096, CELLS // max(1, n)))


def balanced_centroids(sample: np.ndarray, n: int, rounds: int = 12, charge: float = 0.02, seed: int = 7) -> np.ndarray:
    """n centroids of k-means in which a cluster's fill, against the mean, raises its distance."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), n, replace=False)].astype(np.float32)
    extra, scale = np.zeros(n, np.float32), charge * float(_squares(sample[:256], centroids).min(1).mean() or 1)
    step = _at_once(n)
    for _ in range(rounds):
        nearest = np.concatenate([(_squares(sample[lo : lo + step], centroids) + extra).argmin(1) for lo in range(0, len(sample), step)])
        filled = np.bincount(nearest, minlength=n)
        extra += scale * np.clip(filled / filled.mean() - 1, -1, 3).astype(np.float32)
        order = np.argsort(nearest, kind="stable")
        starts = np.flatnonzero(np.diff(nearest[order], prepend=-1))
        centroids[nearest[order][starts]] = np.add.reduceat(sample[order], starts, axis=0) / filled[filled > 0, None]
    return centroids


def linked(centroids: np.ndarray) -> np.ndarray:
    """The graph: each centroid's LINKS nearest ones and two far ones, the next and the one half way around, which hold it together."""
    n = len(centroids)
    near = min(LINKS, n - 1)
    links = np.empty((n, near + 2), np.int32)
    step = _at_once(n)
    for lo in range(0, n, step):
        far = _squares(centroids[lo : lo + step], centroids)
        far[np.arange(len(far)), np.arange(lo, lo + len(far))] = np.inf
        links[lo : lo + step, :near] = np.argpartition(far, near - 1, axis=1)[:, :near] if near else 0
    at = np.arange(n)
    links[:, near], links[:, near + 1] = (at + 1) % n, (at + n // 2) % n
    return links


def descend(x: np.ndarray, centroids: np.ndarray, links: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, distances) of up to `beam` nearest centroids of each row that a best-first walk of the graph finds, nearest first."""
    n, rows = len(centroids), np.arange(len(x))[:, None]
    own = (x * x).sum(1)
    norms = (centroids * centroids).sum(1)

    def to(c: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(own[:, None] + norms[c] - 2 * np.einsum("bd,bmd->bm", x, centroids[c]), 0))

    ids = np.tile(np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int32)), (len(x), 1))
    far, opened, seen = to(ids), np.zeros(ids.shape, bool), np.zeros((len(x), n), bool)
    seen[rows, ids] = True
    while True:
        open_far = np.where(opened, np.inf, far)
        pick = open_far.argmin(1)
        live = np.flatnonzero(np.isfinite(open_far[rows[:, 0], pick]))
        if not len(live):
            order = np.argsort(far, axis=1, kind="stable")
            return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
        opened[live, pick[live]] = True
        more = links[ids[rows[:, 0], pick]]
        fresh = ~seen[rows, more]
        fresh[np.setdiff1d(rows[:, 0], live)] = False
        # a link that stands twice counts once
        fresh &= ~np.tril(more[:, :, None] == more[:, None, :], -1).any(2)
        seen[rows, more] = True
        ids, far, opened = np.hstack([ids, more]), np.hstack([far, np.where(fresh, to(more), np.inf)]), np.hstack([opened, ~fresh])
        if ids.shape[1] > beam:
            keep = np.argpartition(far, beam - 1, axis=1)[:, :beam]
            ids, far, opened = (np.take_along_axis(a, keep, 1) for a in (ids, far, opened))


def flood(x: np.ndarray, centroids: np.ndarray, links: np.ndarray, ratio: float) -> list[np.ndarray]:
    """Of each row, the centroids within ratio times its nearest one's distance, as far as the graph leads over such ones."""
    found = []
    step = max(1, (1 << 22) // len(centroids))
    norms = (centroids * centroids).sum(1)
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        own, far = (part * part).sum(1), np.full((len(part), len(centroids)), np.inf, np.float32)
        ids, near = descend(part, centroids, links)
        r, c = np.nonzero(np.isfinite(near))
        far[r, ids[r, c]] = near[r, c]
        opened = np.zeros(far.shape, bool)
        while True:
            limit = ratio * far.min(1, keepdims=True)
            r, c = np.nonzero((far <= limit) & ~opened)
            if not len(r):
                found += [np.flatnonzero(row) for row in far <= limit]
                break
            opened[r, c] = True
            fresh = np.zeros(far.shape, bool)
            fresh[np.repeat(r, links.shape[1]), links[c].reshape(-1)] = True
            r, c = np.nonzero(fresh & np.isinf(far))
            for k in range(0, len(r), 1 << 15):
                i, j = r[k : k + (1 << 15)], c[k : k + (1 << 15)]
                far[i, j] = np.sqrt(np.maximum(own[i] + norms[j] - 2 * np.einsum("nd,nd->n", part[i], centroids[j]), 0))
    return found


def lists_of(x: np.ndarray, centroids: np.ndarray, links: np.ndarray) -> np.ndarray:
    """(rows, REPLICAS) numbers of the lists that a vector stands in, -1 where it has no more."""
    ids, far = (a[:, :REPLICAS] for a in descend(x, centroids, links))
    return np.where(np.isfinite(far) & (far <= EDGE * far[:, :1]), ids, -1)


def fitted(sample: np.ndarray, n: int, k: int = K) -> tuple[np.ndarray, np.ndarray, float]:
    """(centroids, links, ratio) for n vectors."""
    sample = np.asarray(sample, np.float32)
    centroids = balanced_centroids(sample, max(1, min(math.ceil(n / LIST), len(sample) // SAMPLE_EACH)))
    links = linked(centroids)
    probes = np.random.default_rng(11).choice(len(sample), min(PROBES, len(sample)), replace=False)
    asked, needed = sample[probes], []
    step = min(64, _at_once(len(sample)))
    for lo in range(0, len(probes) if len(sample) > 1 else 0, step):
        far = _squares(asked[lo : lo + step], sample)
        far[np.arange(len(far)), probes[lo : lo + step]] = np.inf
        best = np.argsort(far, axis=1)[:, : min(k, len(sample) - 1)]
        to = np.sqrt(_squares(asked[lo : lo + step], centroids))
        held = lists_of(sample[best.reshape(-1)], centroids, links).reshape(*best.shape, -1)
        over = np.where(held >= 0, to[np.arange(len(to))[:, None, None], held], np.inf).min(2)
        needed.append((over / np.maximum(to.min(1, keepdims=True), 1e-12)).reshape(-1))
    return centroids, links, max(1.0, float(np.quantile(np.concatenate(needed), TARGET))) if needed else 1.0


def clean(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, asks, row) of vectors that are not null, not zero and hold no null or non-finite component; floats stay floats, other numbers become doubles."""
    kind = vectors.schema[vector_col].dataType
    x = F.col(vector_col) if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else F.col(vector_col).cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    fine = x.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, bad) & F.exists(x, lambda c: c != 0)
    return vectors.where(fine).select(F.col(id_col).alias("vec_id"), x.alias("v"), is_query.alias("asks")).withColumn("row", F.monotonically_increasing_id())


def blocked(rows: DataFrame, size: int, name: str, *columns: str, together: bool = False) -> DataFrame:
    """(list, name): the rows of a list, as structs of columns, in blocks of about so many; a long list is many blocks. Lists are no more than centroids, so their counts are broadcast, and never the rows, whose number Spark can't tell. together: the blocks of a list lie in one partition, so that a join on lists deals nothing out again."""
    parts = rows.groupBy("list").agg(F.ceil(F.count("*") / size).alias("parts"))
    dealt = rows.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64(columns[0]), F.col("parts")))
    if together:
        dealt = dealt.repartition("list")
    return dealt.groupBy("list", "part").agg(F.collect_list(F.struct(*columns)).alias(name)).drop("part")


def meet(index: DataFrame, to: DataFrame) -> DataFrame:
    """(members, queries): every block of index(list, members) with every block of the queries to(list, q, v) of its list. Never by a broadcast: a query stands in many lists, and Spark takes their rows for as few as the queries."""
    return index.join(blocked(to, QUERY_BLOCK, "queries", "q", "v", together=True).hint("merge"), "list").select("members", "queries")


def gathered(vectors: DataFrame, width: int) -> np.ndarray:
    """Column v of vectors on the driver, as coarse() makes it; sent as single floats."""
    column = vectors.select(F.transform("v", lambda c: F.least(F.greatest(c, F.lit(-1e15)), F.lit(1e15)).cast("float")).alias("v")).toArrow().column("v")
    out, at = np.empty((len(column), width), np.float32), 0
    for chunk in column.chunks:
        for lo in range(0, len(chunk), step := _at_once(width)):
            part = coarse(matrix(chunk.slice(lo, step)), width)
            out[at : at + len(part)] = part
            at += len(part)
    return out


def score_block(queries: np.ndarray, members: np.ndarray, least_ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, distances) of the k nearest members of each query, ties by id."""
    with np.errstate(over="ignore", invalid="ignore"):  # squares of huge components are infinite, and so are their distances
        near = _squares(queries, members)
        slack = 1e-9 * ((queries * queries).sum(1) + (members * members).sum(1).max(initial=0))
    unsure = np.isnan(near)
    near[unsure] = np.inf
    for row, query, spare, also in zip(near, queries, slack, unsure):
        at = np.arange(len(row)) if len(row) <= k else np.flatnonzero((row <= np.partition(row, k - 1)[k - 1] + spare) | also)
        with np.errstate(over="ignore"):
            away = members[at] - query
            far = np.sqrt((away * away).sum(1))
        best = np.lexsort((least_ids[at], far))[:k]
        yield at[best], far[best]


def ask(met: DataFrame, k: int) -> DataFrame:
    """(q, vec_id, row, score) from met(members array of g, v, ids; queries array of q, v): of each block, a query's k nearest rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                members, queries = (batch.column(batch.schema.get_field_index(c)).slice(i, 1).flatten() for c in ("members", "queries"))
                x, y = matrix(queries.field("v")), matrix(members.field("v"))
                width = max(x.shape[1], y.shape[1])
                ids, sizes = members.field("ids"), np.array(members.field("ids").value_lengths(), np.int64)
                flat, starts = ids.flatten(), np.cumsum(sizes) - sizes
                vec, row = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "row"))
                out: list[list[np.ndarray]] = [[], [], [], []]
                names = queries.field("q").to_numpy(zero_copy_only=False)
                for name, (at, far) in zip(names, score_block(widened(x, width), widened(y, width), vec[starts], k)):
                    every = np.concatenate([np.arange(starts[a], starts[a] + sizes[a]) for a in at])
                    far = np.repeat(far, sizes[at])
                    best = np.lexsort((row[every], vec[every], far))[:k]
                    for column, part in zip(out, (np.full(len(best), name), vec[every][best], row[every][best], far[best])):
                        column.append(part)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, types)], ["q", "vec_id", "row", "score"])

    return met.mapInArrow(run, "q long, vec_id long, row long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank int from 1, vec_id, score double): the k nearest found, by Euclidean distance, of each row that is_query marks among all other rows.

    All, if fewer; nearest first, ties to the smaller vec_id. The search is
    approximate, distances are exact. A row is itself, whatever its id, so rows
    that repeat an id or a vector are candidates for each other. Vectors that
    are null, zero or hold null or non-finite components take no part; shorter
    ones end in zeros. Other columns are left out, an empty table gives no rows.
    """
    tables = Scratch(vectors.sparkSession)
    plain = tables.put("vectors", clean(vectors, is_query, id_col, vector_col).withColumns({f"h{i}": F.xxhash64(F.lit(i), "v") for i in (1, 2)}))
    first = Window.partitionBy("h1", "h2").orderBy("vec_id", "row")
    few = plain.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    entries = few.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_list(F.struct("vec_id", "row"))).alias("ids"))
    entries = tables.put("entries", entries.withColumn("g", F.monotonically_increasing_id()))
    n, rows = entries.count(), plain.count()
    width = entries.agg(F.max(F.size("v"))).first()[0] or 0
    size = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (4 * max(1, width))))
    drawn = entries.where(F.pmod("h2", F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * size / max(1, n)))).select("h1", "v").orderBy("h1").limit(size)
    sample = gathered(drawn, width)
    if not len(sample):
        return plain.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    centroids, links, ratio = fitted(sample, n, k)
    model = plain.sparkSession.sparkContext.broadcast((centroids, links, ratio))
    kind = plain.schema["v"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, links, _ = model.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                lists = lists_of(coarse(matrix(part.column(1)), centroids.shape[1]), centroids, links)
                at, place = np.nonzero(lists >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(lists[at, place], pa.int32()), *(c.take(pa.array(at)) for c in part.columns)], ["list", "g", "v", "ids"])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, links, ratio = model.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                lists = flood(coarse(matrix(part.column(1)), centroids.shape[1]), centroids, links, ratio)
                at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists), pa.int32()), *(c.take(pa.array(at)) for c in part.columns)], ["list", "q", "v"])

    held = tables.put("held", entries.select("g", "v", "ids").mapInArrow(placed, f"list int, g long, v {kind}, ids array<struct<vec_id:long,row:long>>"))
    index = tables.put("index", blocked(held, MEMBER_BLOCK, "members", "g", "v", "ids"))
    askers = plain.where("asks").select("h1", "h2", "vec_id", "row")
    asked = tables.put("asked", entries.join(askers.select("h1", "h2").distinct(), ["h1", "h2"]).select(F.col("g").alias("q"), "h1", "h2", "v"))

    def search(tag: str, to: DataFrame) -> DataFrame:
        found = ask(meet(index, to), k + 1).repartition("q").groupBy("q", "vec_id", "row").agg(F.min("score").alias("score"))
        best = Window.partitionBy("q").orderBy("score", "vec_id", "row")
        return tables.put(tag, found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place"))

    found = search("found", asked.select("q", "v").mapInArrow(routed, f"list int, q long, v {kind}"))
    counts = found.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") >= min(k + 1, rows))
    short = tables.put("short", asked.select("q", "v").join(counts, "q", "left_anti"))
    if not short.isEmpty():
        everywhere = F.explode(F.sequence(F.lit(0), F.lit(len(centroids) - 1))).alias("list")
        found = found.join(counts, "q", "left_semi").union(search("everywhere", short.select(everywhere, "q", "v")))
    own = askers.join(asked.select("h1", "h2", "q"), ["h1", "h2"]).select("q", F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"))
    others = own.join(found, "q").where("row <> query_row")
    place = Window.partitionBy("query_row").orderBy("score", "vec_id", "row")
    return others.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
