"""Choice of the variant to trust now, by local accuracy behind a significance gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.expressions import HOUR
from .analog import neighbourhood
from .evaluate import unpivot_variants
from .timejoin import nearest_join

KEY = ("coin", "horizon_hours")
# Critical z of a one-sided test at 0.05 / m for m = 1 to 6 variants.
CRITICAL_Z = (1.6449, 1.9600, 2.1280, 2.2414, 2.3263, 2.3940)


def eligible(variants: DataFrame, key: Sequence[str] = KEY, min_rows: int = 50) -> DataFrame:
    """(key, variant, n) with at least min_rows resolved rows that have a probability."""
    known = variants.where(F.col("p").isNotNull() & F.col("realized_up").isNotNull())
    return known.groupBy(*key, "variant").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows)


def condition_neighbourhood(core: DataFrame, features: Sequence[str], key: Sequence[str] = KEY, pool: int = 300, min_pool: int = 15, row_id: str = "id") -> DataFrame:
    """(key, n_pool, k_sel, ts, dist, rank) of the resolved rows most like each key's newest row, among the newest `pool` before it; keys under min_pool have none."""
    w = Window.partitionBy(*key).orderBy(F.desc("ts"), F.desc(row_id))
    newest = core.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*key, "ts", *features)
    past = core.where(F.col("realized_up").isNotNull()).select(*key, row_id, "ts", *features)
    near = neighbourhood(newest, past, key, {f: 1.0 for f in features}, pool=pool, row_id=row_id)
    k = F.least(F.lit(15), F.greatest(F.lit(7), F.floor(F.col("_pool") / 10)))
    return near.where((F.col("_pool") >= min_pool) & (F.col("_rank") <= 15) & (F.col("_rank") <= k)).select(*key, F.col("_pool").alias("n_pool"), k.cast("int").alias("k_sel"), F.col("h_ts").alias("ts"), F.col("_dist").alias("dist"), F.col("_rank").alias("rank"))


def lca(variants: DataFrame, near: DataFrame, calls: DataFrame, key: Sequence[str] = KEY, tol: int = 6 * HOUR, min_matched: int = 3, row_id: str = "id") -> DataFrame:
    """(key, variant, lca, n_matched): the share of right calls among the variant's own calls nearest to each neighbour, of the same direction as its call now; variants under min_matched are left out.

    calls(key, variant, call_up); each neighbour is asked once per variant.
    """
    known = variants.where(F.col("p").isNotNull() & F.col("realized_up").isNotNull())
    asked = near.select(*key, F.col("ts").alias("near_ts")).join(calls, list(key))
    got = nearest_join(asked, known, [*key, "variant"], "near_ts", "ts", tol, row_id, ["p", "realized_up"], prefix="_v_")
    up = F.col("_v_p") >= 0.5
    same = got.where(up == F.col("call_up"))
    return same.groupBy(*key, "variant").agg(F.avg((up == (F.col("_v_realized_up") == 1)).cast("int")).alias("lca"), F.count("*").alias("n_matched")).where(F.col("n_matched") >= min_matched)


def decide(scores: DataFrame, key: Sequence[str] = KEY, registry: Sequence[str] = ()) -> DataFrame:
    """(key, winner, winner_lca, n_matched, m, corrected_alpha, required_margin, cleared_gate, chosen): the best variant (ties by its place in registry, then by name) is chosen if it beats one half by more than z sqrt(0.25 / n), else `original`."""
    w = Window.partitionBy(*key)
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(v) for v in registry]).cast("array<string>"), F.col("variant")), F.lit(0)), F.lit(1 << 30))
    best = scores.withColumn("_m", F.least(F.lit(6), F.count("*").over(w))).withColumn("_n", F.row_number().over(w.orderBy(F.desc("lca"), place, "variant"))).where("_n = 1")
    z = F.element_at(F.array(*[F.lit(v) for v in CRITICAL_Z]), F.col("_m").cast("int"))
    margin = z * F.sqrt(0.25 / F.col("n_matched"))
    cleared = F.col("lca") - 0.5 > margin
    return best.select(*key, F.col("variant").alias("winner"), F.col("lca").alias("winner_lca"), "n_matched", F.col("_m").alias("m"), (0.05 / F.col("_m")).alias("corrected_alpha"), margin.alias("required_margin"), cleared.alias("cleared_gate"), F.when(cleared, F.col("variant")).otherwise("original").alias("chosen"))


def current_calls(variants: DataFrame, key: Sequence[str] = KEY, resolved_only: bool = True, row_id: str = "id") -> DataFrame:
    """(key, variant, call_up, call_p): each variant's newest row, by default its newest resolved one."""
    rows = variants.where(F.col("p").isNotNull())
    rows = rows.where(F.col("realized_up").isNotNull()) if resolved_only else rows
    newest = rows.groupBy(*key, "variant").agg(F.max_by("p", F.struct("ts", row_id)).alias("call_p"))
    return newest.select(*key, "variant", (F.col("call_p") >= 0.5).alias("call_up"), "call_p")


def select_variant(core: DataFrame, variants: Mapping[str, str], features: Sequence[str], key: Sequence[str] = KEY, min_rows: int = 50, resolved_only: bool = True, challenger: DataFrame | None = None, challenger_variants: Mapping[str, str] | None = None) -> DataFrame:
    """One decision per key: status, chosen variant and its probability, the gate's figures and the neighbourhood; early exits have a status and `original`.

    challenger(key, id, ts, realized_up, ...) is a second ledger whose variants,
    named in challenger_variants, compete too, for the keys it has; the
    neighbourhood is that of core rows alone. Ties go to the variant that is
    named first.
    """
    kept = [*key, "id", "ts", "realized_up"]
    long = unpivot_variants(core, variants, kept)
    if challenger is not None:
        long = long.unionByName(unpivot_variants(challenger, challenger_variants or {}, kept))
    registry = [*variants, *(challenger_variants or {})]
    fit = eligible(long, key, min_rows)
    near = condition_neighbourhood(core, features, key)
    calls = current_calls(long, key, resolved_only).join(fit.select(*key, "variant"), [*key, "variant"], "left_semi")
    scores = lca(long, near, calls, key)
    made = decide(scores, key, registry)
    around = near.groupBy(*key).agg(F.max("k_sel").alias("k_sel"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "ts", "dist"))), lambda n: F.struct(n["ts"].alias("ts"), F.round(n["dist"], 3).alias("dist"))).alias("neighborhood"))
    keys = core.select(*key).distinct()
    out = keys.join(fit.groupBy(*key).agg(F.count("*").alias("n_eligible")), list(key), "left").join(around, list(key), "left").join(made, list(key), "left")
    out = out.join(calls.select(*key, F.col("variant").alias("chosen"), F.col("call_p").alias("chosen_p_up")), [*key, "chosen"], "left")
    status = F.when(F.col("n_eligible").isNull(), "no_eligible_variants").when(F.col("k_sel").isNull(), "insufficient_meta_history").when(F.col("winner").isNull(), "no_scorable_variants").otherwise("ok")
    reason = F.when(F.col("cleared_gate"), F.concat(F.col("winner"), F.lit(" did better locally"))).when(F.col("winner").isNotNull(), F.lit("no local edge cleared the significance bar")).otherwise(status)
    return out.select(*key, status.alias("status"), F.coalesce("chosen", F.lit("original")).alias("chosen_variant"), "chosen_p_up", "winner", "winner_lca", "n_matched", F.col("m").alias("comparison_count"), "corrected_alpha", "required_margin", F.coalesce("cleared_gate", F.lit(False)).alias("cleared_gate"), "k_sel", "neighborhood", reason.alias("reason"))
