"""Events against the panel rows before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def event_windows(events: DataFrame, scores: DataFrame, event_id: str, entity: str, event_date: str, score_date: str, score: str, near: int = 4, base: int = 4, least: int = 2) -> DataFrame:
    """Per event the mean score of the ``near`` panel rows before it, and of the ``base`` rows before those, with a status.

    Status: event_after_panel_end, no_preceding_data, insufficient_history, ok.  Scores are reduced to one per entity and
    date; the last ``near + base`` dates are gathered per entity and date once, so an entity's many events of
    one day share one window.
    """
    s = scores.groupBy(F.col(entity).alias("_e"), F.col(score_date).alias("_d")).agg(F.avg(score).alias("_v"))
    end = scores.agg(F.max(score_date).alias("_end"))
    marks = events.select(F.col(entity).alias("_e"), F.col(event_date).alias("_d")).distinct()
    both = s.withColumn("_k", F.lit(1)).unionByName(marks.withColumn("_v", F.lit(None).cast("double")).withColumn("_k", F.lit(0)))
    # Events sort before the score of the same day: only earlier rows precede them. The frame counts score rows only.
    order = Window.partitionBy("_e").orderBy("_d", "_k")
    seen = F.sum("_k").over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = both.withColumn("_n", seen)
    span = Window.partitionBy("_e").orderBy("_n").rangeBetween(-(near + base) + 1, 0)
    lists = numbered.withColumn("_w", F.collect_list(F.when(F.col("_k") == 1, F.struct("_n", "_v"))).over(span)).filter("_k = 0")
    prior = F.filter("_w", lambda x: x["_n"] <= F.col("_n"))
    ages = lists.select("_e", "_d", F.transform(prior, lambda x: F.struct((F.col("_n") - x["_n"]).alias("age"), x["_v"].alias("v"))).alias("_a"))

    def part(lo: int, hi: int):
        return F.filter("_a", lambda x: (x["age"] >= lo) & (x["age"] < hi))

    def mean(p):
        values = F.filter(p, lambda x: x["v"].isNotNull())
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x["v"]) / F.nullif(F.size(values), F.lit(0))

    def valid(p):
        return F.size(F.filter(p, lambda x: x["v"].isNotNull()))

    n, b = part(0, near), part(near, near + base)
    windows = ages.select(
        "_e", "_d", F.size(n).alias("n_near_available"), valid(n).alias("n_near_valid"), F.size(b).alias("n_baseline_available"), valid(b).alias("n_baseline_valid"),
        mean(n).alias("near_mean"), mean(b).alias("baseline_mean"),
    )
    rows = events.join(F.broadcast(end)).join(windows, (F.col(entity) == F.col("_e")) & (F.col(event_date) == F.col("_d")), "left")  # end: one row
    status = (
        F.when(F.col(event_date) > F.col("_end"), "event_after_panel_end").when(F.coalesce("n_near_available", F.lit(0)) == 0, "no_preceding_data")
        .when((F.col("n_near_valid") < least) | (F.col("n_baseline_valid") < least), "insufficient_history").otherwise("ok")
    )
    ok = F.col("status") == "ok"
    return rows.withColumn("status", status).select(
        event_id, entity, event_date, "status", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_near_available", "n_near_valid", "n_baseline_available", "n_baseline_valid")),
        F.when(ok, F.col("near_mean")).alias("near_mean"), F.when(ok, F.col("baseline_mean")).alias("baseline_mean"), F.when(ok, F.col("near_mean") - F.col("baseline_mean")).alias("diff"),
    )
