"""Joins whose rows grow with the input and not with its square."""

import datetime

from pyspark.sql import functions as F

from hindsail.operators import audit

DAY = datetime.datetime(2024, 1, 1)


def joined_rows(df) -> int:
    """The most rows that a join of df put out when it was run."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "Join" in name and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        inner = [node.executedPlan()] if name.startswith("AdaptiveSparkPlan") else [node.plan()] if "QueryStage" in name else []
        children = node.children()
        todo += inner + [children.apply(i) for i in range(children.size())]
    return most


def test_reconcile_many_rows_in_the_same_hours(spark):
    n = 3000
    rows = spark.range(n).select("id", F.lit("c").alias("coin"), (F.lit(DAY).cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, id % 1800)")).alias("resolved_ts"), ((F.col("id") * 7 % 501) / 1000 + 0.2).alias("p_up"), (F.col("id") % 2).cast("int").alias("realized_up"))
    asked = rows.select("id", "coin", (F.col("resolved_ts") + F.expr("interval 30 minute")).alias("request_ts"), F.greatest("p_up", 1 - F.col("p_up")).alias("confidence"), ((F.col("p_up") >= 0.5) != (F.col("realized_up") == 1)).alias("was_wrong"))
    found = audit.reconcile(asked, rows)
    assert joined_rows(found) <= 2 * n
    newest = sorted(((i % 1800, i) for i in range(n)), reverse=True)
    p = [i * 7 % 501 / 1000 + 0.2 for i in range(n)]
    sure, wrong = [max(x, 1 - x) for x in p], [(x >= 0.5) != (i % 2 == 1) for i, x in enumerate(p)]
    for r in found.where("id % 50 = 0").collect():
        before = [i for s, i in newest if s <= r.id % 1800 + 1800][:10]
        assert r.prediction_id == next((i for i in before if abs(sure[i] - sure[r.id]) < 1e-9 and wrong[i] == wrong[r.id]), None)


def test_budget_counts_equal_brute_force_without_trailing_frames(spark):
    """A frame that trails by time is summed anew for each row, so its work grows with the square of a day's rows."""
    hour = 3_600_000_000
    rows = [(i, i % 2 if i % 7 else None, None if i % 13 == 0 else (i * 37 % 90) * hour // 3 + (i % 3 > 1)) for i in range(400)]
    log = spark.createDataFrame(rows, "id long, k long, t long").select("id", "k", F.timestamp_micros("t").alias("request_ts"))
    for key in ([], ["k"]):
        out = audit.check_budget(log, 2, 40, key=key)
        plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "rangeframe, -" not in plan
        own = lambda a, b: (not key or a[1] == b[1])
        for r in out.collect():
            me = rows[r.id]
            seen = lambda span: sum(1 for o in rows if own(me, o) and (o[2] is None if me[2] is None else o[2] is not None and 0 <= me[2] - o[2] <= span))
            assert (r.in_hour, r.in_day) == (seen(hour), seen(24 * hour))


def test_neighbour_lists_are_not_shuffled_to_the_queries(spark):
    from hindsail.operators.sliding import conditional_calibration_each

    rows = spark.range(2000).select("id", (F.col("id") % 2).alias("k"), (F.lit(DAY).cast("timestamp_ntz") + F.expr("make_dt_interval(0, id)")).alias("ts"), (F.col("id") % 101).cast("double").alias("x"), (F.col("id") % 3 % 2).cast("int").alias("realized_up"))
    out = conditional_calibration_each(rows.select("id", "k", "ts", "x"), rows, ["k"], {"x": 1.0})
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]
    assert "n_neighbors" in above and "neighbours" not in above
