"""Coverage, conflicts and anomaly checks on panels and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sharded import scan


def coverage(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per key the fraction of rows in which each column holds a value."""
    return df.groupBy(*keys).agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(f"coverage_{c}") for c in columns))


def coverage_report(entities: DataFrame, series: DataFrame, facts: DataFrame, years: int) -> DataFrame:
    """Rows over expected years of every (entity, series), 0 where there are none."""
    n = facts.groupBy("country", "series").agg(F.count(F.lit(1)).alias("n"))
    grid = entities.select("country").crossJoin(F.broadcast(series.select("series")))
    return grid.join(n, ["country", "series"], "left").select("country", "series", F.round(F.coalesce("n", F.lit(0)) / years, 3).alias("coverage_pct"))


def mad_outliers(df: DataFrame, keys: list[str], value: str, threshold: float = 3.5) -> DataFrame:
    """Rows whose modified z-score 0.6745 (x - median) / MAD exceeds the threshold; keys with zero MAD have none.

    Medians are taken over (key, value) counts, so a key costs its distinct values and not its rows.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    centre = counts.groupBy(*keys).agg(F.expr("percentile(_v, 0.5, _n)").alias("median"))
    spread = counts.join(centre, keys).groupBy(*keys, "median").agg(F.expr("percentile(abs(_v - median), 0.5, _n)").alias("mad")).filter("mad > 0")
    z = 0.6745 * (F.col(value) - F.col("median")) / F.col("mad")
    return df.join(spread, keys).withColumn("modified_z", z).filter(F.abs("modified_z") > threshold)


def notch_jumps(df: DataFrame, keys: list[str], order: list[str], value: str, keep: list[str], threshold: int = 4) -> DataFrame:
    """Consecutive pairs of a key whose values differ by more than the threshold: ``<c>_from, <c>_to, notch_jump``."""
    slim = df.select(*dict.fromkeys([*keys, *order, *keep, value]))
    prev = scan(slim, keys, [F.col(c) for c in order], before={**{f"{c}_from": F.col(c) for c in keep}, "_p": F.col(value)})
    return prev.withColumn("notch_jump", F.col(value) - F.col("_p")).filter(F.abs("notch_jump") > threshold).select(
        *keys, *(F.col(f"{c}_from") for c in keep), *(F.col(c).alias(f"{c}_to") for c in keep), "notch_jump"
    )


def close_mixed_precision(df: DataFrame, keys: list[str], order: list[str], date: str, value: str, rough: Column, days: int = 35) -> DataFrame:
    """Neighbours of equal value, 1 to ``days`` apart, of which exactly one is dated roughly: one action noted twice."""
    rows = df.withColumn("_rough", F.coalesce(rough, F.lit(False))).select(*dict.fromkeys([*keys, *order, date, value, "_rough"]))
    pairs = scan(rows, keys, [F.col(c) for c in order], before={"prev_date": F.col(date), "_pv": F.col(value), "_pr": F.col("_rough")})
    pairs = pairs.select(*keys, date, value, "_rough", "prev_date", "_pv", "_pr")
    gap = F.datediff(date, "prev_date")
    return pairs.withColumn("gap_days", gap).filter((F.col(value) == F.col("_pv")) & gap.between(1, days) & (F.col("_rough") != F.col("_pr"))).drop("_rough", "_pr", "_pv")


def two_way_counts(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Cross table of counts, 0 where a pair never occurs."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def share_where(df: DataFrame, keys: list[str], condition: Column, prefix: str) -> DataFrame:
    """Rows, rows that meet a condition, and their percentage to one decimal."""
    hit = F.sum(F.coalesce(condition, F.lit(False)).cast("int"))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), hit.alias(f"n_{prefix}")).withColumn(
        f"pct_{prefix}", F.round(100 * F.col(f"n_{prefix}") / F.col("n_rows"), 1)
    )


def missing_keys(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted keys that are absent."""
    return wanted.select(*keys).distinct().join(present.select(*keys), keys, "left_anti")
