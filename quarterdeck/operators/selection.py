"""Ranking and selection within dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sharded import scan


def rank_within(df: DataFrame, keys: list[str], score: str, tie: list[str], tops=(5, 10, 15)) -> DataFrame:
    """``df`` with ``rank_within_date`` (NULL without a score), ``n_scored_within_date`` and membership flags ``top_<n>``."""
    df = df.drop("rank_within_date", "n_scored_within_date", *(f"top_{n}" for n in tops))  # stored ranks give way to these
    has = F.col(score).isNotNull()
    counts = df.groupBy(*keys).agg(F.count(score).alias("n_scored_within_date"))
    placed = scan(df, keys, [F.col(score).isNull(), -F.col(score), *(F.col(t) for t in tie)], "rank_within_date")
    out = placed.withColumn("rank_within_date", F.when(has, F.col("rank_within_date"))).join(counts, keys)
    for n in tops:
        out = out.withColumn(f"top_{n}", has & F.coalesce(F.col("rank_within_date") <= n, F.lit(False)))
    return out


def best_of(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The whole row with the highest score of each key (smallest ``tie`` among equals); keys without scores give none."""
    rest = [c for c in df.columns if c not in keys]
    best = df.filter(F.col(score).isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t"))).alias("_b"))
    return best.select(*keys, *(F.col(f"_b.{c}") for c in rest))


def latest_slice(df: DataFrame, date: str) -> DataFrame:
    """The rows of the latest date."""
    return df.join(F.broadcast(df.agg(F.max(date).alias(date))), date)  # one row
