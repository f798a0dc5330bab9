"""Quality scores learned from preference pairs (Bradley-Terry).

A document's strength is a linear function of features of its whole text. A
pair of labelled documents, one good and one bad, says that the good one is
preferred; the weights minimise the logistic loss on the difference of the
pair's features. The threshold is a quantile of the labelled strengths, the
share of bad labels, and strengths are mapped to scores from 0 to 1 so that
the threshold lands on CUT.

Training reads every labelled document. Labelled rows of equal features and
label are one row with a weight; these are dealt by hash into blocks of about
BLOCK rows, and each row is compared with all rows of the other label in its
block: up to BLOCK rows these are all preference pairs. The fit is Newton's
method, one job a step that sums blocks; means, bin bounds and the threshold are
exact over all labelled rows. Only sums and the fitted weights pass through the
driver. Scoring is one pass over all documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ranks import order_statistics
from .common import FEW, Scratch, slices

CUT = 0.3
BINS = 6
#: Labelled rows of a block, on average, and rows of the rarer label that a block has at least, on average, by copies if need be.
BLOCK, RARER = 2048, 64
RIDGE = 1e-3

FEATURES = ("log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "bangs", "bars", "stops", "commas", "high", "spaces", "new_lines", "distinct_words", "distinct_lines", "same_next", "capitalised", "long_words")
SYMBOLS = np.frombuffer(b"#$%&*@^~<>=+/\\{}[]_", np.uint8)


def describe(text: bytes | None) -> list[float]:
    """FEATURES of a whole text; all zero for an empty one."""
    body = text or b""
    if not body:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    n, words, lines = len(body), body.split(), body.split(b"\n")
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    low = body.lower().split()
    share = lambda *codes: sum(int(count[c]) for c in codes) / n
    return [
        np.log1p(n), np.log1p(len(words)), float(sizes.mean()) if len(words) else 0.0,
        count[65:91].sum() / n, count[48:58].sum() / n, count[SYMBOLS].sum() / n, share(33, 63), share(124), share(46), share(44, 59, 58), count[128:].sum() / n, share(32), share(10),
        len(set(low)) / w, len(set(lines)) / len(lines), sum(map(bytes.__eq__, low, low[1:])) / w,
        sum(map(bytes.istitle, words)) / w, float((sizes > 20).mean()) if len(words) else 0.0,
    ]


def describe_all(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features array<double>) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [describe(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "features"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary")).mapInArrow(run, f"doc_id {kind}, features array<double>")


@dataclass
class Ranker:
    """mean, scale: of the features; edges: (features, BINS - 1) inner bin bounds; weights: of scaled features, then of bins; threshold and width: of strengths."""

    mean: np.ndarray
    scale: np.ndarray
    edges: np.ndarray
    weights: np.ndarray
    threshold: float
    width: float

    def design(self, x: np.ndarray) -> np.ndarray:
        bins = (x[:, :, None] >= self.edges[None]).reshape(len(x), -1)
        return np.hstack([np.clip((x - self.mean) / self.scale, -4, 4), bins])

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        lean = (self.strength(x) - self.threshold) / self.width + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(lean, -40, 40)))


def _terms(x: np.ndarray, good: np.ndarray, count: np.ndarray, w: np.ndarray, rows: int = 512) -> np.ndarray:
    """Pairs, logistic loss, its slope and its curvature, in one array, summed over all pairs of a good and a bad row of a design matrix; a row counts `count` times."""
    n, up, down = len(w), good == 1, good == 0
    behind, weight = x[down], count[down]
    pairs, loss, slope, curve = 0.0, 0.0, np.zeros(n), np.zeros((n, n))
    for lo in range(0, int(up.sum()), rows):
        ahead, many = x[up][lo : lo + rows], count[up][lo : lo + rows, None] * weight[None]
        lead = (ahead @ w)[:, None] - (behind @ w)[None]
        wrong = np.exp(-np.logaddexp(0, lead))
        pairs, loss = pairs + many.sum(), loss + (many * np.logaddexp(0, -lead)).sum()
        slope += (many * wrong).sum(axis=0) @ behind - (many * wrong).sum(axis=1) @ ahead
        bend = many * wrong * (1 - wrong)
        cross = ahead.T @ (bend @ behind)
        curve += ahead.T @ (bend.sum(axis=1)[:, None] * ahead) + behind.T @ (bend.sum(axis=0)[:, None] * behind) - cross - cross.T
    return np.concatenate([[pairs, loss], slope, curve.ravel()])


def _minimise(terms: Callable[[np.ndarray], np.ndarray], n: int, ridge: float = RIDGE, rounds: int = 60) -> np.ndarray:
    """Weights of least mean loss plus ridge, by Newton steps that are halved where they lead up. The optimum is unique; 9 decimals of it rest on no order of sums."""
    w, best, step = np.zeros(n), np.inf, np.zeros(n)
    for _ in range(rounds):
        total = terms(w + step)
        at = w + step
        cost = total[1] / total[0] + ridge / 2 * (at @ at)
        if cost > best + 1e-13:
            step = step / 2
            continue
        slope = total[2 : 2 + n] / total[0] + ridge * at
        w, best = at, cost
        if np.abs(slope).max() < 1e-12:
            break
        step = -np.linalg.solve(total[2 + n :].reshape(n, n) / total[0] + ridge * np.eye(n), slope)
        if np.abs(step).max() < 1e-11:
            break
    return np.round(w, 9)


def _neutral(n: int = len(FEATURES)) -> Ranker:
    return Ranker(np.zeros(n), np.ones(n), np.zeros((n, BINS - 1)), np.zeros(n * BINS), 0.0, 1.0)


def fit(x: np.ndarray, good: np.ndarray, ridge: float = RIDGE) -> Ranker:
    """Bradley-Terry on all preference pairs of rows held in arrays; train() does the same over tables. With one label only, or no rows, every score is CUT or more: nothing says that a document is bad."""
    n = x.shape[1] if x.ndim == 2 and len(x) else len(FEATURES)
    k = int((good == 0).sum())
    if not k or not (good == 1).any():
        return _neutral(n)
    edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T
    model = Ranker(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9), edges, np.zeros(n * BINS), 0.0, 1.0)
    design = model.design(x)
    model.weights = _minimise(lambda w: _terms(design, good, np.ones(len(x)), w), n * BINS, ridge)
    strengths = np.sort(design @ model.weights)
    model.threshold = float((strengths[k - 1] + strengths[min(k, len(strengths) - 1)]) / 2)
    model.width = float(max(np.std(strengths) / 2, 1e-9))
    return model


def held_out(id_col: Column) -> Column:
    """True where the CRC-32 of the id's text is divisible by 5. A null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _shape(rows: DataFrame, n: int) -> Ranker:
    """Means, scales and bin bounds of n labelled rows; rows(features, n)."""
    many = F.col("n").cast("double")
    long = rows.select("n", F.posexplode("features").alias("i", "x"))
    moments = long.groupBy("i").agg((F.sum(F.col("x") * many) / n).alias("mean"))
    spread = long.join(F.broadcast(moments), "i").groupBy("i").agg(F.first("mean").alias("mean"), F.sqrt(F.sum(many * (F.col("x") - F.col("mean")) ** 2) / n).alias("std"))
    at = np.arange(1, BINS) / BINS * (n - 1)
    below = np.floor(at).astype(int)
    places = sorted({int(p) for p in below} | {int(min(p + 1, n - 1)) for p in below})
    found = {r.i: r for r in order_statistics(long, ["i"], "x", places, "n").collect()}
    held = {r.i: r for r in spread.collect()}
    edges = [[np.quantile([found[i].at[places.index(p)], found[i].at[places.index(min(p + 1, n - 1))]], a - p) for a, p in zip(at, below.tolist())] for i in range(len(FEATURES))]
    mean, std = np.array([held[i].mean for i in range(len(FEATURES))]), np.array([held[i]["std"] for i in range(len(FEATURES))])
    return Ranker(mean, np.maximum(std, 1e-9), np.array(edges), np.zeros(len(FEATURES) * BINS), 0.0, 1.0)


def _blocks(rows: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """(items) of rows(features, quality, n): one row a block. Rows of the rarer label go to as many blocks as give each block RARER of them."""
    blocks = -(-sum(sizes.values()) // BLOCK)
    rare = min(sizes, key=lambda label: (sizes[label], label))
    copies = min(blocks, -(-RARER * blocks // sizes[rare]))
    own = F.pmod(F.xxhash64("features"), F.lit(blocks))
    places = F.when(F.col("quality") == rare, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.withColumn("_copy", F.explode(places)).withColumn("_block", F.pmod(own + F.col("_copy"), F.lit(blocks)))
    return dealt.groupBy("_block").agg(F.collect_list(F.struct("features", "quality", "n")).alias("items")).select("items")


def _summed(blocks: DataFrame, model: Ranker, w: np.ndarray) -> np.ndarray:
    """_terms() summed over blocks: one job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + len(w) + len(w) ** 2)
        for batch in batches:
            for i in range(batch.num_rows):
                items = batch.column(0).slice(i, 1).flatten()
                x = items.field("features").flatten().to_numpy(zero_copy_only=False).reshape(len(items), -1)
                total += _terms(model.design(x), items.field("quality").to_numpy(zero_copy_only=False), items.field("n").to_numpy(zero_copy_only=False).astype(float), w)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    sums = blocks.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    return sums.sort_values("i")["v"].to_numpy()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Ranker:
    """Ranker from all documents that labels(doc_id, quality) marks and that are not held out. Labels other than 0 and 1 are left out; an id with two labels, or two documents, counts with each."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    ids, texts = known.select("_id").distinct(), docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if ids.count() <= FEW:  # beyond, features of all rows are joined, which are narrow, not texts
        texts = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left_semi")
    scratch = Scratch(docs.sparkSession)
    marked = describe_all(texts).join(known, F.col("doc_id") == F.col("_id"))
    rows = scratch.put("labelled", marked.groupBy("features", "quality").agg(F.count("*").alias("n")))
    counts = {r.quality: r for r in rows.groupBy("quality").agg(F.count("*").alias("distinct"), F.sum("n").alias("n")).collect()}
    if len(counts) < 2:
        scratch.drop("labelled")
        return _neutral()
    n, k = counts[0].n + counts[1].n, counts[0].n
    model = _shape(rows, n)
    blocks = scratch.put("blocks", _blocks(rows, {label: r.distinct for label, r in counts.items()}))
    model.weights = _minimise(lambda w: _summed(blocks, model, w), len(model.weights))
    fitted = replace(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(np.round(fitted.strength(x), 12)), batch.column(1)], ["s", "n"])

    strengths = scratch.put("strengths", rows.select("features", "n").mapInArrow(run, "s double, n long").withColumn("one", F.lit(1)))
    places = sorted({k - 1, min(k, n - 1)})
    edge = order_statistics(strengths, ["one"], "s", places, "n").first()["at"]
    mean = strengths.agg(F.sum(F.col("s") * F.col("n")) / n).first()[0]
    spread = strengths.agg(F.sqrt(F.sum(F.col("n") * (F.col("s") - mean) ** 2) / n)).first()[0]
    model.threshold, model.width = (edge[0] + edge[-1]) / 2, float(np.round(max(spread / 2, 1e-9), 12))
    scratch.drop("labelled", "blocks", "strengths")
    return model


def _scores(model: Ranker, texts: list[bytes | None]) -> np.ndarray:
    return np.round(model.score(np.array([describe(x) for x in texts], float).reshape(-1, len(FEATURES))), 12)


def score_all(docs: DataFrame, model: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs. Null texts count as empty; repeated rows have equal scores; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = _scores(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= CUT).astype("int32"))], ["doc_id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Ranker, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text the model accepts."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = _scores(model, [None if t is None else t.encode() for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(score >= CUT))

    return docs.mapInArrow(run, docs.schema)
