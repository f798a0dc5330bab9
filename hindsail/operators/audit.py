"""Checks of stored tables: duplicates, order, budgets, chains, leakage, secrets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.expressions import HOUR, confidence, correct, micros
from .timejoin import PIECE, _numbered, asof_join

PASS, FAIL, UNAVAILABLE, NOT_APPLICABLE = "PASS", "FAIL", "UNAVAILABLE", "NOT_APPLICABLE"
SECRET = r"(?i)token|api[_-]?key|secret|password|authorization|bearer"
REDACTED = "[REDACTED]"


def check(status: Column, *evidence: Column) -> Column:
    """A check result: struct of status and evidence, null evidence left out."""
    return F.struct(status.alias("status"), F.array_compact(F.array(*evidence)).cast("array<string>").alias("evidence"))


def duplicate_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(cols, n) of keys that occur more than once; null is a key like any other."""
    return df.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_status(df: DataFrame | None, cols: Sequence[str], spark=None) -> DataFrame:
    """One row: status YES or NO and the number of repeated keys; UNAVAILABLE without a table."""
    if df is None:
        return spark.range(1).select(F.lit(UNAVAILABLE).alias("status"), F.lit(None).cast("long").alias("n_keys"))
    return duplicate_keys(df, cols).agg(F.count("*").alias("n_keys")).select(F.when(F.col("n_keys") > 0, "YES").otherwise("NO").alias("status"), "n_keys")


def check_order(prediction_ts: Column, request_ts: Column) -> Column:
    """PASS iff the prediction is not after the request; UNAVAILABLE if either is null."""
    delta = micros(request_ts) - micros(prediction_ts)
    known = delta.isNotNull()
    status = F.when(~known, UNAVAILABLE).when(delta >= 0, PASS).otherwise(FAIL)
    return check(status, F.when(~known, "a time is missing"), F.concat(F.lit("delta_ms="), F.floor(delta / 1000)))


def check_budget(log: DataFrame, per_hour: int | None, per_day: int | None, ts: str = "request_ts", key: Sequence[str] = (), row_id: str = "id") -> DataFrame:
    """log with requests in the hour and the day up to each one, itself included, a status for both limits and violation (YES, NO, UNAVAILABLE without limits). Every request is checked, not only the newest.

    The times of a key are cut into pieces of an hour. Requests are summed by
    time first and counted inside their piece; sums of pieces say how many
    stand before. A trailing count is the count up to a time less that up to
    the span before it, asked for like a request's, so a task is an hour of a
    key, and equal times are one row. A request without a time counts those of
    its key that have none.
    """
    t = micros(F.col(ts))
    own = log.withColumn("_t", t)
    names = list(key)
    counts = own.groupBy(*names, "_t").agg(F.count("*").alias("_n"))
    # the time itself, and the last microsecond before either span
    ends = F.explode(F.array(*[F.struct(F.lit(which).alias("which"), (F.col("_t") - back).alias("at")) for which, back in (("all", 0), ("hour", HOUR + 1), ("day", 24 * HOUR + 1))])).alias("_e")
    asked = counts.select(*names, F.col("_t").alias("_of"), ends, "_n").select(*names, "_of", F.col("_e.which").alias("_which"), F.col("_e.at").alias("_t"), F.when(F.col("_e.which") == "all", F.col("_n")).otherwise(0).alias("_n"))
    cut = asked.withColumn("_piece", F.coalesce(F.floor(F.col("_t") / HOUR), F.lit(-(1 << 62))))
    before = F.sum("_s").over(Window.partitionBy(*names).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cut.groupBy(*names, "_piece").agg(F.sum("_n").alias("_s")).select(*[F.col(k).alias(f"_o_{k}") for k in names], F.col("_piece").alias("_opiece"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("_n").over(Window.partitionBy(*names, "_piece").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0))
    same = lambda tag: [F.col(k).eqNullSafe(F.col(f"_{tag}_{k}")) for k in names]
    placed = cut.withColumn("_inside", inside).join(offsets, [*same("o"), F.col("_piece") == F.col("_opiece")]).withColumn("_upto", F.col("_inside") + F.when(F.col("_of").isNull(), 0).otherwise(F.col("_before")))
    upto = lambda which: F.max(F.when(F.col("_which") == which, F.col("_upto")))
    past = lambda which: F.when(F.col("_of").isNull(), 0).otherwise(upto(which))
    told = placed.groupBy(*names, "_of").agg((upto("all") - past("hour")).alias("in_hour"), (upto("all") - past("day")).alias("in_day"))
    told = told.withColumnsRenamed({k: f"_r_{k}" for k in names})
    out = own.join(told, [*same("r"), F.col("_t").eqNullSafe(F.col("_of"))]).select(*log.columns, "in_hour", "in_day")
    if per_hour is None or per_day is None:
        return out.withColumn("hourly", F.lit(UNAVAILABLE)).withColumn("daily", F.lit(UNAVAILABLE)).withColumn("violation", F.lit(UNAVAILABLE))
    out = out.withColumn("hourly", F.when(F.col("in_hour") <= per_hour, PASS).otherwise(FAIL)).withColumn("daily", F.when(F.col("in_day") <= per_day, PASS).otherwise(FAIL))
    return out.withColumn("violation", F.when((F.col("hourly") == FAIL) | (F.col("daily") == FAIL), "YES").otherwise("NO"))


def rollup(checks: DataFrame, key: Sequence[str], status: str = "status") -> DataFrame:
    """(key, result): FAIL if any check fails; PASS if there is one and all that apply pass; else UNVERIFIED."""
    s = F.col(status)
    applies = s.isNotNull() & (s != NOT_APPLICABLE)
    by = checks.groupBy(*key).agg(F.count_if(applies).alias("_n"), F.count_if(s == FAIL).alias("_f"), F.count_if(s == PASS).alias("_p"))
    return by.select(*key, F.when(F.col("_f") > 0, FAIL).when((F.col("_n") > 0) & (F.col("_p") == F.col("_n")), PASS).otherwise("UNVERIFIED").alias("result"))


def reconcile(investigations: DataFrame, ledger: DataFrame, hours: float = 3.5, newest: int = 10) -> DataFrame:
    """investigations(id, coin, request_ts, confidence, was_wrong) with the prediction each was about: among the newest ledger rows of its series resolved in the `hours` before the request, the first with the same confidence (to 1e-9) and wrongness; null if none.

    Rows are numbered per series in time order, so the newest ones before a
    request are numbers. Requests and rows meet on (series, wrongness, block of
    `newest` numbers), a request in at most two blocks: work grows with the
    rows, however many of them fall into the same hours.
    """
    span = int(hours * HOUR)
    known = ledger.where(F.col("realized_up").isNotNull()).select("coin", micros(F.col("resolved_ts")).alias("_t"), F.lit(True).alias("_row"), F.col("id").alias("_id"), confidence(F.col("p_up")).alias("_c"), (~correct(F.col("p_up"), F.col("realized_up"))).alias("_w")).where("_t is not null")
    asked = investigations.select("coin", micros(F.col("request_ts")).alias("_t"), F.lit(False).alias("_row"), F.col("id").alias("_id"), F.col("confidence").alias("_c"), F.col("was_wrong").alias("_w"))
    both = _numbered(known.unionByName(asked), ["coin"], PIECE)
    tied = F.row_number().over(Window.partitionBy("coin", "_piece", "_t").orderBy(F.desc("_id")))
    rows = both.where("_row").select(F.col("coin").alias("_coin"), F.col("_w").alias("_rw"), (F.col("_seen") - tied + 1).alias("_n"), F.col("_t").alias("_rt"), F.col("_id").alias("_rid"), F.col("_c").alias("_rc"))
    rows = rows.withColumn("_rb", F.floor(F.col("_n") / newest))
    last = F.floor(F.col("_seen") / newest)
    asks = both.where("not _row").select("coin", "_w", "_seen", "_t", "_id", "_c", F.explode(F.array(last, last - 1)).alias("_b"))
    meet = (F.col("coin") == F.col("_coin")) & (F.col("_w") == F.col("_rw")) & (F.col("_b") == F.col("_rb"))
    fits = (F.col("_n") <= F.col("_seen")) & (F.col("_n") > F.col("_seen") - newest) & (F.col("_rt") >= F.col("_t") - span) & (F.abs(F.col("_rc") - F.col("_c")) < 1e-9)
    found = asks.join(rows, meet & fits).groupBy(F.col("_id").alias("id")).agg(F.max_by("_rid", "_n").alias("prediction_id"))
    return investigations.join(found, "id", "left")


def preceding_decision(rows: DataFrame, decisions: DataFrame, key: Sequence[str], ts: str = "request_ts", slack: int = HOUR) -> DataFrame:
    """rows with the newest decision of the key at most `slack` microseconds after ts: decision_id, decision_ts."""
    late = F.timestamp_micros(micros(F.col(ts)) + slack)
    named = decisions.select(*key, F.col("id").alias("decision_id"), F.col("ts").alias("decision_ts"))
    return asof_join(rows, named, key, late, "decision_ts", "decision_id", ["decision_id", "decision_ts"])


def audit_chain(investigations: DataFrame, catalysts: DataFrame, ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """investigations(id, coin, horizon_hours, request_ts, confidence, was_wrong, catalysts_written) with three checks and their roll-up `result`: catalysts(investigation) counted as logged, a prediction found and made before the request, a decision found."""
    counted = catalysts.groupBy(F.col("investigation").alias("id")).agg(F.count("*").alias("_n"))
    about = reconcile(investigations, ledger)
    made = ledger.select(F.col("id").alias("prediction_id"), F.col("ts").alias("_made"))
    whole = preceding_decision(about.join(counted, "id", "left").join(made, "prediction_id", "left"), decisions, ["coin", "horizon_hours"])
    n = F.coalesce("_n", F.lit(0))
    found = check(F.when(F.col("catalysts_written").isNull(), UNAVAILABLE).when(n == F.col("catalysts_written"), PASS).otherwise(FAIL), F.concat(F.lit("stored="), n))
    chosen = check(F.when(F.col("decision_id").isNull(), UNAVAILABLE).otherwise(PASS), F.concat(F.lit("decision="), F.col("decision_id").cast("string")))
    out = whole.withColumn("catalyst_check", found).withColumn("prediction_check", check_order(F.col("_made"), F.col("request_ts"))).withColumn("decision_check", chosen)
    s = F.array("catalyst_check.status", "prediction_check.status", "decision_check.status")
    result = F.when(F.array_contains(s, FAIL), FAIL).when(F.forall(s, lambda x: x == PASS), PASS).otherwise("UNVERIFIED")
    return out.withColumn("result", result).drop("_n", "_made")


def versions_since(df: DataFrame, since: Column, ts: str = "ts", version: str = "git_commit_sha") -> DataFrame:
    """Distinct commit ids of rows since a time, without null and unknown."""
    return df.where((F.col(ts) >= since) & F.col(version).isNotNull() & (F.col(version) != "unknown")).select(version).distinct()


def mask_secrets(df: DataFrame) -> DataFrame:
    """df with every column, struct field or map entry whose name looks like a secret's replaced by [REDACTED] (a string), at any depth."""
    import re

    secret = lambda name: re.search(SECRET, name)

    def masked(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            fields = [(F.lit(REDACTED) if secret(f.name) else masked(value[f.name], f.dataType)).alias(f.name) for f in kind.fields]
            return F.when(value.isNotNull(), F.struct(*fields))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
            return F.transform(value, lambda x: masked(x, kind.elementType))
        if isinstance(kind, T.MapType):
            if isinstance(kind.keyType, T.StringType) and isinstance(kind.valueType, T.StringType):
                return F.transform_values(value, lambda k, v: F.when(k.rlike(SECRET), F.lit(REDACTED)).otherwise(v))
            return F.transform_values(value, lambda k, v: masked(v, kind.valueType))
        return value

    return df.select(*[(F.lit(REDACTED) if secret(f.name) else masked(F.col(f"`{f.name}`"), f.dataType)).alias(f.name) for f in df.schema.fields])


def immutability(before: DataFrame, after: DataFrame, row_id: str, outcome_cols: Sequence[str]) -> DataFrame:
    """(id, change) for rows of which more than outcome columns changed, or that are gone; an empty result means that history was kept."""
    fixed = [c for c in before.columns if c not in {row_id, *outcome_cols}]
    old = before.select(row_id, F.struct(*fixed).alias("_old"))
    new = after.select(row_id, F.struct(*fixed).alias("_new"), F.lit(True).alias("_there"))
    both = old.join(new, row_id, "left")
    change = F.when(F.col("_there").isNull(), "missing").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.select(row_id, change.alias("change")).where(F.col("change").isNotNull())


def leakage_checks(ledger: DataFrame, neighbours: DataFrame | None = None, tolerance: float = 0.2, curves: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """(rule, violations): outcome before its time, and resolution before the prediction.

    For neighbours(ts, query_ts, horizon_hours) also outcomes that lie after
    their query; for curves(computed_ts, newest_resolved_ts, used_ts) a curve
    built from outcomes later than its stamp, or used by a prediction before
    it; for stats(cutoff_ts, query_ts) statistics that reach past their query.
    """
    done = F.col("realized_up").isNotNull()
    due = micros(F.col("ts")) + F.col("horizon_hours") * HOUR
    rules = [(ledger, {"resolved_before_target": done & (micros(F.col("resolved_ts")) < due), "resolved_before_prediction": done & (F.col("resolved_ts") <= F.col("ts"))})]
    if neighbours is not None:
        late = micros(F.col("ts")) + (F.col("horizon_hours") * HOUR * (1 + tolerance)).cast("long") > micros(F.col("query_ts"))
        rules.append((neighbours, {"neighbour_outcome_after_query": late}))
    if curves is not None:
        rules.append((curves, {"curve_of_later_outcomes": F.col("newest_resolved_ts") > F.col("computed_ts"), "curve_used_before_its_time": F.col("used_ts") < F.col("computed_ts")}))
    if stats is not None:
        rules.append((stats, {"statistics_past_query": F.col("cutoff_ts") > F.col("query_ts")}))
    named = lambda tests: F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in tests])).alias("_r")
    parts = [df.agg(*[F.count_if(test).alias(rule) for rule, test in tests.items()]).select(named(tests)).select("_r.*") for df, tests in rules]
    return reduce(DataFrame.unionByName, parts)
