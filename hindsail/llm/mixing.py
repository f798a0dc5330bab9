"""Mixing documents to target domain weights by soft membership.

A softmax classifier, trained from a bounded labelled table, gives every
document a posterior over domains. Each document gets a rate, how often it is
read; the expected tokens of a domain are the sum over documents of rate x
tokens x posterior. Rates are the projected-gradient solution of least squares
between expected and target totals, never below `floor` (0 unless asked):
every step is two aggregates over all documents that return a few sums for each
domain, and a document's rate is a fold of its posterior over those steps.
Steps end on proof only: when totals meet the targets, or when the dual problem
shows that no rates come nearer.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, slices, unused, written

HASHED = 1024
MAX_LABELLED = 4000
TOLERANCE = 1e-4
#: Where targets are out of reach, distances this near to the least one end the descent.
NEARLY = 1.01
#: Steps after which rates are written.
WRITE = 16
#: Lengths that a step along the domains' curvature, and one along the plain gradient, are tried at.
CURVED, PLAIN = tuple(0.5**k for k in range(10)), (1.0, 4.0, 16.0, 64.0)
#: Where no domain may lose documents, totals are so much above the fullest domain's, since every domain gains from others' posteriors.
HEADROOM = 0.02
#: Target share of tokens by domain.
TARGETS = {"de": 0.2, "en": 0.45, "es": 0.15, "fr": 0.2}


def profile(text: bytes | None) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs of a whole text; zeros for less than two bytes."""
    codes = np.frombuffer(text or b"", np.uint8).astype(np.int32)
    if len(codes) < 2:
        return np.zeros(HASHED, np.float32)
    counts = np.bincount((codes[:-1] * 131 + codes[1:] * 7) % HASHED, minlength=HASHED)
    return np.sqrt(counts / (len(codes) - 1)).astype(np.float32)


@dataclass
class Domains:
    names: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, names: list[str], rounds: int = 200, ridge: float = 1e-4) -> Domains:
    """Softmax regression by gradient descent with momentum; without rows every domain is equally likely."""
    weights, bias = np.zeros((HASHED, len(names))), np.zeros(len(names))
    if not len(x):
        return Domains(names, weights, bias)
    hot = np.eye(len(names))[y]
    speed, speed_b, step = np.zeros_like(weights), np.zeros_like(bias), 2.0
    for _ in range(rounds):
        error = Domains(names, weights, bias).posterior(x) - hot
        speed = 0.9 * speed - step * (x.T @ error / len(x) + ridge * weights)
        speed_b = 0.9 * speed_b - step * error.mean(axis=0)
        weights, bias = weights + speed, bias + speed_b
    return Domains(names, weights, bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Rows of docs whose doc_id is among the first max_labelled of labels in hash order; that many ids are broadcast."""
    ids = labels.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    return docs.join(F.broadcast(ids), docs["doc_id"] == ids["_id"], "left_semi")


def train(labelled: DataFrame, names: list[str], text_col: str = "text", domain_col: str = "lang", max_labelled: int = MAX_LABELLED) -> Domains:
    """Classifier from labelled(text, domain), at most max_labelled rows in the order of their texts' hashes. Rows of other domains, or of none, are left out."""
    rows = labelled.where(F.col(domain_col).isin(*names)).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(domain_col).alias("domain"))
    picked = rows.withColumn("h", F.xxhash64("text")).orderBy("h", "domain").limit(max_labelled).select("text", "domain")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [profile(t.encode()).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float32())), batch.column(1)], ["x", "domain"])

    part = picked.mapInArrow(run, "x array<float>, domain string").toPandas()
    return fit(np.array(part["x"].tolist(), float).reshape(-1, HASHED), part["domain"].map({n: k for k, n in enumerate(names)}).to_numpy(int), names)


def posteriors(docs: DataFrame, model: Domains, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, tokens long, p array<double>) for every row, or all columns of docs with the two that keep names. Tokens are words parted by ASCII white space."""
    names = [*docs.columns, *keep] if keep else ["doc_id", "tokens", "p"]
    plain = docs if keep else docs.select(F.col(id_col), F.col(text_col).cast("string"))
    at = docs.columns.index(text_col) if keep else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
            p = np.round(model.posterior(np.array([profile(t) for t in texts], np.float32).reshape(-1, HASHED)), 9)
            columns = [*batch.columns] if keep else [batch.column(0)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(t.split()) for t in texts], pa.int64()), pa.array(p.tolist(), pa.list_(pa.float64()))], names)

    head = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names[:-2], plain.schema.fields))
    return plain.mapInArrow(run, f"{head}, {names[-2]} long, {names[-1]} array<double>")


@dataclass
class Step:
    """slope: the gradient by domain; along: what is taken off a rate, by domain, `by` times; plain: it is divided by the document's share of scale, and rates at the floor move too."""

    slope: np.ndarray
    along: np.ndarray
    by: float
    plain: bool


@dataclass
class Rates:
    """steps from the rate `start` on; scale: the domains' tokens at rates of one; reached: their tokens now; status: met, nearest (targets are out of reach) or empty (no tokens)."""

    scale: np.ndarray
    floor: float
    start: float
    steps: list[Step]
    reached: np.ndarray
    status: str = "empty"
    miss: float = 0.0

    def after(self, r: np.ndarray, p: np.ndarray, step: Step) -> np.ndarray:
        """Rates r of documents of posteriors p after a step."""
        move = p @ (step.along * step.by)
        if step.plain:
            return np.maximum(self.floor, r - move / np.maximum(p @ self.scale, 1e-300))
        return np.where(self.free(r, p, step.slope), np.maximum(self.floor, r - move), r)

    def free(self, r: np.ndarray, p: np.ndarray, slope: np.ndarray) -> np.ndarray:
        """Whether rates are off the floor, or the slope draws them off."""
        return (r > self.floor) | (p @ slope < 0)

    def fold(self, p: Column, since: int = 0, r: Column | None = None) -> Column:
        """A document's rate after the steps from number since on, r being what it was before."""
        begin = r if r is not None else F.lit(float(self.start))
        if not self.steps[since:]:
            return begin
        row = lambda x: F.struct(*[F.array(*[F.lit(float(v)) for v in a]).alias(n) for n, a in (("slope", x.slope), ("along", x.along * x.by))], F.lit(x.plain).alias("plain"))
        dot = lambda v: reduce(lambda a, b: a + b, [F.element_at(p, i + 1) * F.element_at(v, i + 1) for i in range(len(self.scale))])
        floor, size = F.lit(float(self.floor)), F.greatest(dot(F.array(*[F.lit(float(x)) for x in self.scale])), F.lit(1e-300))

        def step(rate: Column, x: Column) -> Column:
            curved = F.when((rate > floor) | (dot(x["slope"]) < 0), F.greatest(floor, rate - dot(x["along"]))).otherwise(rate)
            return F.when(x["plain"], F.greatest(floor, rate - dot(x["along"]) / size)).otherwise(curved)

        return F.aggregate(F.array(*[row(x) for x in self.steps[since:]]), begin, step)

    def of(self, p: Column) -> Column:
        return self.fold(p)


def measured(now: DataFrame, rates: Rates, since: int, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """of(t, r, p) over all documents of now(t, p, r), r after the steps from number since on: its first number's least value, and the sums of the other size - 1. Each task tells one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.array([np.inf, *[0.0] * (size - 1)])
        for batch in batches:
            if batch.num_rows:
                t, r = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
                p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
                for step in rates.steps[since:]:
                    r = rates.after(r, p, step)
                own = of(t, r, p)
                told[0], told[1:] = min(told[0], own[0]), told[1:] + own[1:]
        yield pa.RecordBatch.from_arrays([pa.array([told.tolist()], pa.list_(pa.float64()))], ["v"])

    rows = now.mapInArrow(run, "v array<double>")
    return np.array(list(rows.agg(F.min(F.element_at("v", 1)), *[F.sum(F.element_at("v", i + 1)) for i in range(1, size)]).first()), float)


def least_distance(slope: np.ndarray, lowest: float, targets: np.ndarray, scale: np.ndarray, floor: float) -> float:
    """A distance from targets that no rates can be nearer than: the dual value of the slope (totals less targets), raised by what its lowest product with a posterior is below zero so that it is feasible, at its best length."""
    dual = slope + max(0.0, -lowest)
    gain = -float(dual @ (targets - floor * scale))
    return gain / float(np.linalg.norm(dual)) if gain > 0 else 0.0


def solve(soft: DataFrame, targets: np.ndarray, floor: float = 0.0, tokens: str = "tokens", p: str = "p") -> Rates:
    """Rates of floor or more for soft(tokens, p) whose expected totals have the least squared distance from targets.

    With r the rates, s = sum r t p the totals and g = s - targets, p . g is a
    document's gradient in the metric t of its tokens. A step goes along it, or
    along p . w with H w = g, H = sum t p p' over the rates that are free to
    move: where no rate meets the floor that one lands on the targets. Both are
    projected to floor, and of several lengths of both the one that comes
    nearest is taken. The plain one at length 1, divided by p . n (n the totals
    at rates of one), has curvature 1 at most and never ascends, so no step
    does. Ends when the totals are within TOLERANCE of the targets (as a share
    of their sum), or when least_distance() proves that rates NEARLY as far are
    the nearest, or when no step comes nearer in floating point. The result
    says which, and what is missing. Rates are written every WRITE steps, so
    that a round costs as much late as early.
    """
    tables, d = Scratch(soft.sparkSession), range(len(targets))
    t, q, r = F.col("t"), F.col("p"), F.col("r")
    at = [F.element_at(q, i + 1) for i in d]
    now = soft.select(F.col(tokens).cast("double").alias("t"), F.col(p).alias("p"))
    scale = np.array([x or 0.0 for x in now.agg(*[F.sum(t * a) for a in at]).first()])
    rates = Rates(scale, floor, max(1.0, floor), [], scale * max(1.0, floor))
    if scale.sum() <= 0:
        return rates
    total, kept = max(float(targets.sum()), 1.0), 0
    now = now.select("t", "p", F.lit(float(rates.start)).alias("r"))
    while True:
        slope = rates.reached - targets
        far = float(np.linalg.norm(slope))
        rates.miss = float(np.abs(slope).max()) / total
        if rates.miss <= TOLERANCE:
            rates.status = "met"
            break

        def curved(t: np.ndarray, r: np.ndarray, p: np.ndarray) -> np.ndarray:
            free = p[rates.free(r, p, slope)]  # noqa: B023
            return np.array([(p @ slope).min(), *((free * t[rates.free(r, p, slope), None]).T @ free).reshape(-1)])  # noqa: B023

        row = measured(now, rates, kept, curved, 1 + len(targets) ** 2)
        rates.status = "nearest"
        if far <= NEARLY * least_distance(slope, row[0], targets, scale, floor):
            break
        curvature = row[1:].reshape(len(targets), -1)
        along = np.linalg.lstsq(curvature + 1e-9 * np.trace(curvature) * np.eye(len(targets)), slope, rcond=None)[0]
        tried = [Step(slope, along, a, False) for a in CURVED] + [Step(slope, slope, a, True) for a in PLAIN]

        def totals(t: np.ndarray, r: np.ndarray, p: np.ndarray) -> np.ndarray:
            return np.concatenate([[0.0], *[(rates.after(r, p, s) * t) @ p for s in tried]])  # noqa: B023

        sums = measured(now, rates, kept, totals, 1 + len(tried) * len(targets))[1:].reshape(len(tried), -1)
        best = int(np.linalg.norm(sums - targets, axis=1).argmin())
        if np.linalg.norm(sums[best] - targets) >= far * (1 - 1e-9):
            break
        rates.steps.append(tried[best])
        rates.reached = sums[best]
        if len(rates.steps) - kept >= WRITE:
            now = tables.put(f"rates{len(rates.steps)}", now.select("t", "p", rates.fold(q, kept, r).alias("r")))
            tables.drop(f"rates{kept}")
            kept = len(rates.steps)
    tables.drop(f"rates{kept}")
    logging.getLogger(__name__).log(logging.INFO if rates.status == "met" else logging.WARNING, "mixing: %s after %d steps, the largest miss of a domain is %.4f of all target tokens", rates.status, len(rates.steps), rates.miss)
    return rates


def copies(rate_col: Column, *key: Column) -> Column:
    """Whole copies of a document: the rate's whole part, and one more if the hash of its key falls below the rest. Expected copies are the rate."""
    draw = F.pmod(F.xxhash64(*key, F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate_col) + (draw < rate_col - F.floor(rate_col)).cast("int")).cast("int")


def budget(soft: DataFrame, targets: Mapping[str, float], names: list[str], total: float | None = None, keep_all: bool = False, tokens: str = "tokens", p: str = "p") -> np.ndarray:
    """Target tokens by domain: shares of total, by default all tokens there are; with keep_all as many that no domain has to lose any."""
    share = np.array([targets[n] for n in names]) / sum(targets[n] for n in names)
    row = soft.agg(F.sum(tokens).alias("all"), *[F.sum(F.col(tokens) * F.element_at(p, i + 1)).alias(f"d{i}") for i in range(len(names))]).first()
    have = np.array([row[f"d{i}"] or 0.0 for i in range(len(names))])
    if keep_all:
        return share * float((have / share).max()) * (1 + HEADROOM)
    return share * float(total if total is not None else row["all"] or 0)


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang") -> DataFrame:
    """(doc_id, tokens long, p array<double> in the sorted order of domains, rate double, copies int, status string, miss double) for every row of docs.

    status says whether the rates meet the targets (met), are the nearest there
    are (nearest) or had no tokens to work on (empty), miss how far the worst
    domain's tokens are off, as a share of all target tokens.
    Null texts count as empty: no tokens, a rate, no effect. Repeated rows have
    equal rates; an empty table gives no rows; other columns are left out.
    """
    names = sorted(targets)
    soft = written(posteriors(docs, train(labelled, names, text_col, domain_col), id_col, text_col), "soft")
    rates = solve(soft, budget(soft, targets, names))
    told = soft.withColumn("rate", F.round(rates.of(F.col("p")), 9)).withColumn("copies", copies(F.col("rate"), F.col("doc_id")))
    return told.withColumns({"status": F.lit(rates.status), "miss": F.lit(round(rates.miss, 6))})


def resample(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, text_col: str = "text", domain_col: str = "lang") -> DataFrame:
    """docs with each row as many times as its copies: domains short of their share are repeated, none loses a document (rates are 1 or more).

    Null texts count as empty; rows with equal texts and first columns have
    equal copies; an empty table gives no rows; docs may have columns of any
    name.
    """
    names = sorted(targets)
    tokens, p, copy = (unused(n, docs.columns) for n in ("mixing_tokens", "mixing_p", "mixing_copy"))
    rows = written(posteriors(docs, train(labelled, names, text_col, domain_col), text_col=text_col, keep=(tokens, p)), "rows")
    rates = solve(rows, budget(rows, targets, names, keep_all=True, tokens=tokens, p=p), floor=1.0, tokens=tokens, p=p)
    times = copies(rates.of(F.col(p)), F.xxhash64(F.col(text_col)), F.col(docs.columns[0]))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)
