"""Continuous forms of ingest, resolution, scores, de-duplication and budgets.

Event times are timestamps with zone (cast NTZ columns first). A price later
than its prediction's target plus tolerance plus watermark cannot resolve it
here; the batch job can.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.expressions import correct
from ..operators.catalysts import HIGH_PRIORITY, pick_within_budget, remaining_budget


PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Rows (ts, then an id) of a key handled in order of time, once the watermark has passed them.

    New rows are appended to a list state, which is not read for it, and a timer
    at the first waiting row wakes the key: then, and only then, the waiting
    rows are read, those due handled in order, and the rest, no older than the
    watermark's delay, put back. What handle() remembers is a value state of its
    own. A key with nothing to remember and nothing waiting has no state left.
    """

    #: Further columns of a row after ts, the id first; all as a schema, times in microseconds; and what is remembered.
    columns: tuple[str, ...] = ()
    waiting_schema = remembered_schema = ""

    def handle(self, key: tuple, remembered: tuple | None, due: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        """(what to remember, rows to write) of due rows in order."""
        raise NotImplementedError

    def forget_at(self, remembered: tuple) -> int | None:
        """When, in milliseconds, what is remembered matters no more."""
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = handle
        self.wake = handle.getValueState("wake", "ms long")
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.remembered = handle.getValueState("remembered", self.remembered_schema)

    def _sleep(self, wake: int | None, old: int | None = None) -> None:
        """Moves the key's one timer."""
        if old == wake:
            return
        if old is not None:
            self.states.deleteTimer(old)
        if wake is None:
            self.wake.clear()
        else:
            self.states.registerTimer(wake)
            self.wake.update((wake,))

    @staticmethod
    def _tuples(rows: pd.DataFrame) -> list[tuple]:
        return list(zip(*(rows[c].tolist() for c in rows.columns)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        old = self.wake.get()[0] if self.wake.exists() else None
        first = old
        for part in rows:
            new = part[list(self.columns)].assign(us=part["ts"].astype("datetime64[us]").astype("int64"))[["us", *self.columns]]
            self.waiting.appendList(self._tuples(new))
            first = min(x for x in (first, int(new["us"].min() // 1000)) if x is not None)
        self._sleep(first, old)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        kept = self.remembered.get() if self.remembered.exists() else None
        rows = pd.DataFrame(list(self.waiting.get()), columns=["us", *self.columns]).sort_values(["us", *self.columns[:1]], kind="stable")
        late = rows["us"] > now * 1000
        due, left = rows[~late], rows[late]
        if len(due):
            kept, out = self.handle(key, kept, due.assign(ts=pd.to_datetime(due["us"], unit="us")))
            if len(out):
                yield out
        if len(left):
            wake = int(left["us"].iloc[0] // 1000)
            self.waiting.put(self._tuples(left))
        else:
            wake = None if kept is None else self.forget_at(kept)
            if wake is not None and wake <= now:
                kept = wake = None
            self.waiting.clear()
        if kept is None:
            self.remembered.clear()
        else:
            self.remembered.update(kept)
        self._sleep(wake)  # the timer that has gone off is no more

    def close(self) -> None:
        pass


def _stateful(df: DataFrame, key: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    """df by key through a processor with timers in event time. Its states are kept in RocksDB, which the session is set to."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return df.groupBy(*key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


class TickScores(InOrder):
    """A tick's score from the n ticks before it; what is remembered are their prices."""

    columns = ("obs_id", "price")
    waiting_schema = "us long, obs_id long, price double"
    remembered_schema = "past array<double>"

    def __init__(self, n: int) -> None:
        self.n = n

    @staticmethod
    def score(past: list[float]) -> float:
        # whole numbers, as in functions.windows.momentum_score()
        whole = [math.floor(p * 1e12 + 0.5) if abs(p) < 1e16 else None for p in past]
        changes = [b - a for a, b in zip(whole, whole[1:]) if a is not None and b is not None]
        gain, loss = sum(max(c, 0) for c in changes), sum(max(-c, 0) for c in changes)
        if len(past) < 6 or gain == loss == 0:
            return 50.0
        return float((201 * gain + loss) // (2 * (gain + loss)))

    def handle(self, key: tuple, remembered: tuple | None, due: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        past, scores = list(remembered[0]) if remembered else [], []
        for price in due["price"]:
            scores.append(self.score(past))
            past = [*past, float(price)][-self.n :]
        return (past,), due.assign(series_id=key[0], technical_score=scores)[["series_id", "obs_id", "ts", "price", "technical_score"]]


def stream_ticks(ticks: DataFrame, n: int = 30, late: str = "1 hour") -> DataFrame:
    """ticks(series_id, obs_id, ts, price), repeats within the watermark dropped, with technical_score from the n ticks of the series before each.

    A tick waits until the watermark passes it and is scored in order of time,
    whatever order ticks came in. State: n prices a series, and waiting ticks.
    """
    fresh = ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["series_id", "obs_id"])
    kind = ticks.schema["series_id"].dataType.simpleString()
    return _stateful(fresh, ["series_id"], TickScores(n), f"series_id {kind}, obs_id long, ts timestamp, price double, technical_score double")


def stream_resolve(predictions: DataFrame, prices: DataFrame, tolerance: str = "288 minutes", late: str = "1 hour") -> DataFrame:
    """predictions(id, series_id, target_ts, price) resolved by prices(series_id, obs_id, ts, price) of a second stream: the nearest within tolerance of target_ts, decided once the watermark passes target_ts plus tolerance.

    Every prediction comes out once, with status resolved, or no_price and nulls
    if the interval closes without a price: an outer join of two streams, whose
    nulls the watermark lets go.
    """
    asked = predictions.select("id", F.col("series_id").alias("_s"), F.col("price").alias("_p"), (F.col("target_ts") + F.expr(f"interval {tolerance}")).alias("due")).withWatermark("due", late)
    seen = prices.withWatermark("ts", late)
    wide = F.expr(f"interval {tolerance}")
    pairs = asked.join(seen, (F.col("_s") == F.col("series_id")) & (F.col("ts") <= F.col("due")) & (F.col("ts") >= F.col("due") - wide - wide), "left_outer")
    gap = F.abs(F.unix_micros("ts") - F.unix_micros(F.col("due") - wide))
    best = pairs.groupBy("due", "id", "_s", "_p").agg(F.min_by(F.col("price"), F.struct(gap, F.col("ts"), F.col("obs_id"))).alias("realized_price"))
    ret = F.try_divide(F.col("realized_price") - F.col("_p"), F.col("_p")) * 100
    return best.select(F.col("id").alias("prediction_id"), F.col("_s").alias("series_id"), "realized_price", ret.alias("realized_return"), (ret > 0).cast("int").alias("realized_up"), F.when(F.col("realized_price").isNull(), "no_price").otherwise("resolved").alias("status"))


def stream_scores(rows: DataFrame) -> DataFrame:
    """Running scores of rows(coin, horizon_hours, variant, p, realized_up); update or complete mode."""
    known = rows.where("p is not null and realized_up is not null")
    return known.groupBy("coin", "horizon_hours", "variant").agg(F.count("*").alias("n"), F.avg((F.col("p") - F.col("realized_up")) ** 2).alias("brier"), F.avg(correct(F.col("p"), F.col("realized_up"), ">").cast("int")).alias("accuracy"))


def stream_dedupe(catalysts: DataFrame, hours: float = 6, late: str = "1 hour") -> DataFrame:
    """catalysts(id, coin, category, ts) without those within `hours`, inclusive, of one kept before for the same coin and category, by (time, id): the rule of drop_fuzzy_duplicates(within_batch=True).

    A row waits until the watermark passes it. State: the last time kept, and
    waiting rows; it goes when the last time kept is too old to matter.
    """
    marked = catalysts.select("id", "coin", "category", "ts").withWatermark("ts", late)
    return _stateful(marked, ["coin", "category"], FirstOfKind(int(pd.Timedelta(hours=hours).value // 1000)), "id long, coin string, category string, ts timestamp")


class FirstOfKind(InOrder):
    """Rows more than span microseconds after the last one kept, which is what is remembered."""

    columns = ("id",)
    waiting_schema = "us long, id long"
    remembered_schema = "last long"

    def __init__(self, span: int) -> None:
        self.span = span

    def forget_at(self, remembered: tuple) -> int:
        return (remembered[0] + self.span) // 1000 + 1

    def handle(self, key: tuple, remembered: tuple | None, due: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        last, keep = remembered[0] if remembered else None, []
        for t in due["us"].tolist():
            keep.append(last is None or t - last > self.span)
            last = t if keep[-1] else last
        return (last,), due[keep].assign(coin=key[0], category=key[1])[["id", "coin", "category", "ts"]]


def stream_budget(log_path: str, per_day: int = 1, per_hour: int = 1, threshold: float = HIGH_PRIORITY) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: ranks a batch of (coin, priority, request_ts), takes what the log's trailing day and hour leave, and appends all rows with their decision to the log at log_path. A batch that is run again finds its rows and adds none."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = spark.read.schema("coin string, priority double, request_ts timestamp, place int, decision string, batch_id long").parquet(log_path)
        if log.where(F.col("batch_id") == batch_id).limit(1).count() or batch.isEmpty():
            return
        now = F.lit(batch.agg(F.max("request_ts")).first()[0])
        left = remaining_budget(log.where("decision = 'selected'"), now, per_day, per_hour)
        pick_within_budget(batch, left, threshold=threshold).select("coin", "priority", "request_ts", "place", "decision", F.lit(batch_id).cast("long").alias("batch_id")).write.mode("append").parquet(log_path)

    return run
