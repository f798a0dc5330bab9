"""Nearest-time and as-of joins without range-join blow-up.

A bounded tolerance cuts time into blocks of at least a few tolerances. A right
row goes to every block that a match could come from (nearly always one), a
left row to its own, and two window passes inside a (key, block) find the last
row before and the first after. So one long series is many tasks, and no pair
of rows is ever formed but the match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import HOUR, micros, unit_ratio, units

BLOCK_TOLERANCES = 64


def nearest_join(left: DataFrame, right: DataFrame, key: Sequence[str], left_ts: Column | str, right_ts: str, tol: int, right_id: str, take: Sequence[str], strict: bool = False, how: str = "inner", prefix: str = "", within: str | None = None) -> DataFrame:
    """left rows with the nearest right row of the same key: columns take, named with prefix, and `_diff` (right minus left, microseconds).

    abs(difference) <= tol microseconds, or < with strict; on equal distance
    the earlier row, then the smaller right_id. how: inner, left or anti (rows
    without a match, no new columns). Null times never match. within: a column
    of left with a row's own tolerance, tol being the largest.
    """
    at = left_ts if isinstance(left_ts, Column) else F.col(left_ts)
    block = max(1, tol) * BLOCK_TOLERANCES
    keys = [F.col(k) for k in key]
    probes = left.select(*keys, micros(at).alias("_t"), F.struct(*left.columns).alias("_left")).withColumn("_block", F.expr(f"_t div {block}") - F.when(F.col("_t") % block < 0, 1).otherwise(0))
    found = F.struct(*[F.col(c) for c in take])
    rows = right.select(*keys, micros(F.col(right_ts)).alias("_t"), F.col(right_id).cast("long").alias("_id"), found.alias("_right")).where("_t is not null")
    lo, hi = F.floor((F.col("_t") - tol) / block), F.floor((F.col("_t") + tol) / block)
    rows = rows.withColumn("_block", F.explode(F.sequence(lo, hi)))
    both = probes.unionByName(rows, allowMissingColumns=True)
    part = Window.partitionBy(*key, "_block")
    upto = Window.unboundedPreceding, 0
    is_row = F.col("_right").isNotNull()
    before = F.max(F.when(is_row, F.struct("_t", (-F.col("_id")).alias("_n"), "_id"))).over(part.orderBy("_t").rangeBetween(*upto))
    after = F.min(F.when(is_row, F.struct("_t", "_id"))).over(part.orderBy(F.desc("_t")).rangeBetween(*upto))
    marked = both.withColumn("_before", before).withColumn("_after", after)
    b, a, t = F.col("_before._t"), F.col("_after._t"), F.col("_t")
    back = b.isNotNull() & (a.isNull() | (t - b <= a - t))
    picked = marked.where(F.col("_left").isNotNull()).select(*keys, "_left", t.alias("_at"), F.when(back, b).otherwise(a).alias("_t"), F.when(back, F.col("_before._id")).otherwise(F.col("_after._id")).alias("_id"))
    gap = F.abs(F.col("_t") - F.col("_at"))
    most = F.least(F.lit(tol), F.col(f"_left.{within}")) if within else F.lit(tol)
    near = F.coalesce(gap < most if strict else gap <= most, F.lit(False))
    if how == "anti":
        return picked.where(~near).select("_left.*")
    own = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_t").alias("_rt"), F.col("_id").alias("_rid"), "_right").dropDuplicates([*[f"_k{i}" for i in range(len(key))], "_rt", "_rid"])
    joined = picked.withColumn("_hit", F.when(near, F.col("_t")))
    joined = joined.join(own, [joined[k] == own[f"_k{i}"] for i, k in enumerate(key)] + [joined["_hit"] == own["_rt"], joined["_id"] == own["_rid"]], how)
    return joined.select("_left.*", *[F.col(f"_right.{c}").alias(prefix + c) for c in take], (F.col("_hit") - F.col("_at")).alias("_diff"))


def forward_return(rows: DataFrame, prices: DataFrame, key: Sequence[str], horizon_hours: float, how: str = "inner", share: float = 0.2, price: str = "price", name: str = "return_pct") -> DataFrame:
    """rows(ts, price) with the percent return to the price nearest to ts + horizon, within `share` of the horizon."""
    ahead = F.col("ts") + F.expr(f"interval {int(horizon_hours * 3600)} second")
    out = nearest_join(rows, prices, key, ahead, "ts", int(horizon_hours * HOUR * share), "obs_id", [price], how=how, prefix="_fwd_")
    return out.withColumn(name, F.try_divide(F.col(f"_fwd_{price}") - F.col(price), F.col(price)) * 100).drop(f"_fwd_{price}", "_diff")


def forward_returns(rows: DataFrame, prices: DataFrame, key: Sequence[str], longest: float, how: str = "inner", share: float = 0.2, price: str = "price", name: str = "return_pct") -> DataFrame:
    """forward_return() for rows with an integer horizon_hours of their own, at most `longest`: one join for all horizons."""
    ahead = F.col("ts") + F.expr("make_dt_interval(0, horizon_hours)")
    own = rows.withColumn("_within", (F.col("horizon_hours") * HOUR * share).cast("long"))
    out = nearest_join(own, prices, key, ahead, "ts", int(longest * HOUR * share), "obs_id", [price], how=how, prefix="_fwd_", within="_within")
    return out.withColumn(name, F.try_divide(F.col(f"_fwd_{price}") - F.col(price), F.col(price)) * 100).drop(f"_fwd_{price}", "_diff", "_within")


def tolerance_anti_join(left: DataFrame, right: DataFrame, key: Sequence[str], ts: str, tol: int, right_id: str, strict: bool = True) -> DataFrame:
    """left rows that no right row of the same key comes within tol microseconds of."""
    return nearest_join(left, right, key, ts, ts, tol, right_id, [ts], strict=strict, how="anti")


#: An as-of join cuts each key into pieces of this length, in microseconds.
PIECE = 24 * HOUR
#: Parts that rows of all series are dealt into where a join has no key but time.
SALTS = 32


def _numbered(both: DataFrame, keys: Sequence[str], piece: int) -> DataFrame:
    """both(keys, _t, _row) with `_seen`: how many rows of the key that are marked _row are not after _t.

    Counts run inside a piece of time; what earlier pieces hold, one row per
    key and piece, is summed up beside and joined in. So a key is as many
    window partitions as it has pieces. Null keys are a key.
    """
    cut = both.withColumn("_piece", F.coalesce(F.floor(F.col("_t") / piece), F.lit(-(1 << 62))))
    sums = cut.groupBy(*keys, "_piece").agg(F.count_if("_row").alias("_count"))
    before = F.sum("_count").over(Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], F.col("_piece").alias("_opiece"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.count_if("_row").over(Window.partitionBy(*keys, "_piece").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0))
    same = [F.col(k).eqNullSafe(F.col(f"_o{i}")) for i, k in enumerate(keys)] + [F.col("_piece") == F.col("_opiece")]
    return cut.withColumn("_inside", inside).join(offsets, same).withColumn("_seen", F.col("_inside") + F.col("_before"))


def asof_join(left: DataFrame, right: DataFrame, key: Sequence[str], left_ts: Column | str, right_ts: str, right_id: str, take: Sequence[str], lookback: int | None = None, fallback: bool = False, upto: Column | str | None = None, prefix: str = "", piece: int = PIECE) -> DataFrame:
    """left rows with the newest right row at or before left_ts (ties: smaller right_id), or nulls.

    With lookback, only the newest `lookback` right rows at or before `upto`
    (left_ts unless given) count, and with fallback the oldest of those stands
    in where none is old enough. Right rows are numbered per key, so both cases
    are comparisons of row numbers, not lists. Numbers are counted in pieces of
    time (see _numbered), so one long key is many tasks. Null times and null
    keys never match; repeated rows stay.
    """
    col = lambda c: c if isinstance(c, Column) else F.col(c)
    keys = list(key)
    rows = right.select(*keys, micros(F.col(right_ts)).alias("_t"), F.col(right_id).cast("long").alias("_id"), F.struct(*take).alias("_right")).where("_t is not null")
    times = [F.struct(micros(col(left_ts)).alias("t"), F.lit(0).alias("which"))]
    if lookback is not None:
        times.append(F.struct(micros(col(upto if upto is not None else left_ts)).alias("t"), F.lit(1).alias("which")))
    probes = left.select(*keys, F.struct(*left.columns).alias("_left"), F.explode(F.array(*times)).alias("_p"))
    probes = probes.select(*keys, F.col("_p.t").alias("_t"), F.lit(False).alias("_row"), "_left", F.col("_p.which").alias("_which"))
    both = _numbered(probes.unionByName(rows.withColumn("_row", F.lit(True)), allowMissingColumns=True), keys, piece)
    # rows of one time count each other; the newest of them is the one with the smallest id
    tied = F.row_number().over(Window.partitionBy(*keys, "_piece", "_t").orderBy("_id"))
    numbered = both.where("_row").select(*keys, "_right", (F.col("_seen") - tied + 1).alias("_n"))
    at = both.where("not _row").withColumn("_seen", F.when(F.col("_seen") > 0, F.col("_seen")))
    if lookback is None:
        by = at.select(*keys, "_left", F.col("_seen").alias("_old"), F.lit(1).alias("_times"))
    else:
        pair = lambda which: F.max(F.when(F.col("_which") == which, F.col("_seen")))
        by = at.groupBy(*keys, "_left").agg(pair(0).alias("_old"), pair(1).alias("_new"), (F.count("*") / 2).cast("int").alias("_times"))
    picked = F.col("_old")
    if lookback is not None:
        oldest = F.greatest(F.lit(1), F.col("_new") - lookback + 1)
        picked = F.when(F.col("_old") >= oldest, F.col("_old"))
        if fallback:
            picked = F.coalesce(picked, F.when(F.col("_new").isNotNull(), oldest))
    chosen = by.withColumn("_n", picked)
    if lookback is not None:
        chosen = chosen.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    rows = numbered.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_n").alias("_rn"), "_right")
    out = chosen.join(rows, [chosen[k] == rows[f"_k{i}"] for i, k in enumerate(key)] + [chosen["_n"] == rows["_rn"]], "left")
    return out.select("_left.*", *[F.col(f"_right.{c}").alias(prefix + c) for c in take])


def dealt(df: DataFrame, name: str = "_part", parts: int = SALTS) -> DataFrame:
    """df with the number of a part, by a hash of its columns; maps and variants, which have none, do not count."""
    hashed = [f.name for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return df.withColumn(name, F.pmod(F.xxhash64(*[F.col(c) for c in hashed]) if hashed else F.lit(0), F.lit(parts)).cast("int"))


def asof_join_keyless(left: DataFrame, right: DataFrame, left_ts: Column | str, right_ts: str, right_id: str, take: Sequence[str], prefix: str = "", parts: int = SALTS, piece: int = PIECE) -> DataFrame:
    """asof_join() where time is the only key: left rows are dealt into `parts` parts and each gets a copy of the right rows, which are few by nature (some a day).

    So the rows of one day, or those that follow one right row, are as many
    window partitions and join keys as there are parts.
    """
    copies = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return asof_join(dealt(left, parts=parts), copies, ["_part"], left_ts, right_ts, right_id, take, prefix=prefix, piece=piece).drop("_part")


def enrich(prices: DataFrame, context: DataFrame, cols: Sequence[str], tol: int, defaults: dict[str, float], context_id: str = "ts", freshness: int | None = None, imputed: str = "context_imputed") -> DataFrame:
    """prices with the context columns of the nearest context row within tol microseconds, and context_imputed (any of them missing, 0 or 1).

    Context has no series key and one row a day or so: blocks of time deal it,
    and inside a block prices are dealt into SALTS parts, each with a copy of
    the context. Missing values become the mean of the real matches of all rows
    (of values to 9 decimals, summed exactly), or the column's default where nothing matched; a match older than freshness
    counts as missing.
    """
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    one = context.withColumn("_part", parts).withColumn("_cid", micros(F.col(context_id)))
    got = nearest_join(dealt(prices), one, ["_part"], "ts", "ts", tol, "_cid", list(cols), how="left", prefix="_c_")
    for c in cols:
        fresh = F.col(f"_c_{c}") if freshness is None else F.when(F.abs(F.col("_diff")) <= freshness, F.col(f"_c_{c}"))
        got = got.withColumn(f"_c_{c}", fresh)
    own = lambda c: units(F.col(f"_c_{c}"), 9)
    means = got.agg(*[(unit_ratio(F.sum(own(c)), F.count(own(c))) / 1e9).alias(f"_m_{c}") for c in cols])
    missing = F.lit(False)
    for c in cols:
        missing = missing | F.col(f"_c_{c}").isNull()
    filled = got.crossJoin(F.broadcast(means))  # one row of means
    return filled.select(*prices.columns, *[F.coalesce(f"_c_{c}", f"_m_{c}", F.lit(defaults[c])).alias(c) for c in cols], missing.cast("int").alias(imputed))
