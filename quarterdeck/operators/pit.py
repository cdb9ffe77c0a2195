"""Point-in-time operators: what a series said as of a date.

Each takes pre-aggregated or raw rows, needs one equi-key, and shuffles on it once.
Facts are first reduced to one per key and date (map-side), so an ordered window runs over a calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import epoch_day, quarter_end


def resample_last(df: DataFrame, keys: list[str], date: str, columns: list[str], tie: str) -> DataFrame:
    """``keys, rebal_date`` and, per column, its last value that isn't NULL in the quarter; columns may come from different days."""
    order = F.struct(F.col(date), F.col(tie))
    return df.groupBy(*keys, quarter_end(F.col(date)).alias("rebal_date")).agg(
        *(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns)
    )


def asof_backward(left: DataFrame, facts: DataFrame, keys: list[str], left_date: str, fact_date: str, carry: list[str], tie: list[Column]) -> DataFrame:
    """``left`` with the columns ``carry`` of the latest fact dated on or before ``left_date``.

    The latest *row* counts, even where its value is NULL.  Facts of one key and date are reduced to the
    one that is largest by ``tie`` first; then facts and left rows are merged in one ordered window.
    """
    best = facts.groupBy(*keys, F.col(fact_date).alias("_ts")).agg(F.max(F.struct(*(t.alias(f"_t{i}") for i, t in enumerate(tie)), *carry)).alias("_f"))
    dates = left.select(*keys, F.col(left_date).alias("_ts")).distinct()
    both = best.select(*keys, "_ts", "_f", F.lit(0).alias("_side")).unionByName(
        dates.select(*keys, "_ts", F.lit(None).cast(best.schema["_f"].dataType).alias("_f"), F.lit(1).alias("_side"))
    )
    w = Window.partitionBy(*keys).orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("_f", F.last("_f", ignorenulls=True).over(w)).filter("_side = 1")
    known = known.select(*keys, F.col("_ts").alias(left_date), *(F.col(f"_f.{c}").alias(c) for c in carry))
    return left.join(known, [*keys, left_date], "left")


def asof_quarters(facts: DataFrame, keys: list[str], fact_date: str, carry: list[str], tie: list[Column], first: str, last: str) -> DataFrame:
    """Every key on every quarter end between two dates, with the columns ``carry`` of its latest fact dated on or before it (NULL before the first).

    The latest *row* counts, even where its value is NULL; of one date the one that is largest by ``tie``.  Only a quarter's
    last fact can be seen on a quarter end, so facts are reduced to one per key and quarter (map-side); each then stands until
    the next one's quarter.  One exchange on the key, and no row of the spine is ever joined.
    """

    def index(d: Column) -> Column:
        return F.year(d) * 4 + F.quarter(d) - 1

    low, high = index(F.lit(first).cast("date")), index(F.lit(last).cast("date"))
    best = facts.groupBy(*keys, index(F.col(fact_date)).alias("_q")).agg(F.max(F.struct(F.col(fact_date).alias("_d"), *(t.alias(f"_t{i}") for i, t in enumerate(tie)), *carry)).alias("_f"))
    best = best.select(*keys, "_q", *(F.col(f"_f.{c}").alias(c) for c in carry))
    w = Window.partitionBy(*keys).orderBy("_q")
    spans = best.withColumn("_next", F.lead("_q").over(w)).withColumn("_before", F.lag("_q").over(w))
    start, end = F.greatest("_q", low), F.least(F.coalesce(F.col("_next") - 1, high), high)
    known = F.when(start <= end, F.transform(F.sequence(start, end), lambda q: F.struct(q.alias("q"), F.lit(True).alias("known"))))
    none = F.when(F.col("_before").isNull() & (low < F.col("_q")), F.transform(F.sequence(low, F.least(F.col("_q") - 1, high)), lambda q: F.struct(q.alias("q"), F.lit(False).alias("known"))))
    empty = F.array().cast("array<struct<q:int,known:boolean>>")
    rows = spans.select(*keys, *carry, F.explode(F.concat(F.coalesce(none, empty), F.coalesce(known, empty))).alias("_s"))
    date = F.last_day(F.make_date(F.floor(F.col("_s.q") / 4).cast("int"), (F.col("_s.q") % 4) * 3 + 3, F.lit(1)))
    return rows.select(*keys, date.alias("rebal_date"), *(F.when(F.col("_s.known"), F.col(c)).alias(c) for c in carry))


def bounded_lookup(anchors: DataFrame, daily: DataFrame, keys: list[str], anchor: str, date: str, value: str, tolerance: int, tie: str) -> DataFrame:
    """``anchors`` with ``value`` of the latest daily row in [anchor - tolerance, anchor], NULL or not; NULL without a row.

    Days are cut into blocks as long as the window, so each anchor meets the rows of two blocks by an equi-join.
    """
    size = tolerance + 1
    latest = daily.groupBy(*keys, F.col(date).alias("_d")).agg(F.max(F.struct(F.col(tie).alias("_t"), F.col(value).alias("_v"))).alias("_r"))
    rows = latest.withColumn("_b", F.floor(epoch_day(F.col("_d")) / size))
    wanted = anchors.select(*keys, F.col(anchor).alias("_a")).distinct()
    block = F.floor(epoch_day(F.col("_a")) / size)
    near = wanted.withColumn("_b", F.explode(F.array(block, block - 1)))
    hits = near.join(rows, [*keys, "_b"]).filter((F.col("_d") <= F.col("_a")) & (F.col("_d") >= F.date_sub("_a", tolerance)))
    found = hits.groupBy(*keys, F.col("_a").alias(anchor)).agg(F.max_by("_r", "_d").alias("_r"))
    return anchors.join(found, [*keys, anchor], "left").withColumn(value, F.col("_r._v")).drop("_r")


def trailing_zscore(anchors: DataFrame, daily: DataFrame, keys: list[str], anchor: str, date: str, value: str, days: int, least: int = 10) -> DataFrame:
    """``anchors`` with ``zscore``: the last value against mean and sample deviation of the values in (anchor - days, anchor].

    NULL below ``least`` values or at zero deviation.  Daily rows are reduced to one per key and date (count, sum, squares, last), then
    one range frame per key covers the window.
    """
    d = daily.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(date).alias("_d")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q"), F.max(value).alias("_v")
    )
    a = anchors.select(*keys, F.col(anchor).alias("_d")).distinct().withColumn("_anchor", F.lit(True))
    both = d.unionByName(a, allowMissingColumns=True).withColumn("_e", epoch_day(F.col("_d")))
    w = Window.partitionBy(*keys).orderBy("_e").rangeBetween(-(days - 1), 0)
    last = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_e"))).over(w)
    n, s, q = F.sum("_n").over(w), F.sum("_s").over(w), F.sum("_q").over(w)
    both = both.select(*keys, "_d", "_anchor", n.alias("_n"), s.alias("_s"), q.alias("_q"), last.alias("_last")).filter("_anchor")
    deviation = F.sqrt(F.greatest((F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")) / (F.col("_n") - 1), F.lit(0.0)))
    scored = both.withColumn("_sd", F.when(F.col("_n") >= least, deviation))
    z = F.when(F.col("_sd") > 1e-9, (F.col("_last") - F.col("_s") / F.col("_n")) / F.col("_sd"))
    return anchors.join(scored.select(*keys, F.col("_d").alias(anchor), z.alias("zscore")), [*keys, anchor], "left")


def gap_fill_union(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """All primary rows, and the secondary rows whose key the primary lacks."""
    return primary.unionByName(secondary.join(primary.select(*keys).distinct(), keys, "left_anti"))


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the smallest by ``order``: a map-side combined aggregation, not a sort of whole groups.

    By a single column every other one is an aggregate of its own: those that nobody reads are pruned, and numbers need no sort.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    if len(order) == 1:
        best = df.groupBy(*keys).agg(F.min(order[0]).alias(order[0]), *(F.min_by(c, order[0]).alias(c) for c in rest))
        return best.select(*df.columns)
    best = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_o"), F.min_by(F.struct(*(rest or order)), F.struct(*order)).alias("_r"))
    picked = {**{c: F.col(f"_o.{c}") for c in order}, **{c: F.col(f"_r.{c}") for c in rest}, **{k: F.col(k) for k in keys}}
    return best.select(*(picked[c].alias(c) for c in df.columns))
