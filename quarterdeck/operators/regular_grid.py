"""Irregular readings onto a regular grid of calendar quarters.

Readings are reduced to one row per source and quarter (map-side), quarters are
grouped into time shards, each shard is summed up by its first and last reading,
the boundary states travel across shards by a window over the *shard summaries*
(a prefix scan whose length is the calendar, not the data), and every shard is
then filled on its own.  A source that holds a third of all rows therefore costs
no more than any other once its rows have been pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Quarters to a time shard (four years).
SHARD_QUARTERS = 16


def quarter_index(date: Column) -> Column:
    """Quarters since year 0."""
    return F.year(date) * 4 + F.quarter(date) - 1


def quarter_end(index: Column) -> Column:
    """Last day of the quarter with that index."""
    return F.last_day(F.make_date((index / 4).cast("int"), ((index % 4) * 3 + 3).cast("int"), F.lit(1)))


def observed(value: Column) -> Column:
    """Neither NULL nor NaN."""
    return value.isNotNull() & ~F.isnan(value)


def to_quarter_grid(
    df: DataFrame, source: str, date: str, value: str, row_id: str, shard_quarters: int = SHARD_QUARTERS
) -> DataFrame:
    """One row per source and quarter end between the source's first and last reading.

    Returns ``source, rebal_date, value, reading_date, n_readings, filled, periods_since``.
    A quarter with readings takes the last of them (latest date, then largest id); a
    quarter without takes the last reading before it and is marked ``filled``, with the
    number of quarters since that reading.

    NULL and NaN values are no readings; rows with a NULL source or date are skipped
    and a source without any reading gives no rows.  An empty table gives an empty grid.
    Other columns of the input are ignored, whatever their names.
    """
    rows = df.select(
        F.col(source).alias("source"), F.col(date).cast("date").alias("date"), F.col(value).cast("double").alias("value"), F.col(row_id).alias("id")
    ).filter(observed(F.col("value")) & F.col("source").isNotNull() & F.col("date").isNotNull())
    quarters = rows.groupBy("source", quarter_index(F.col("date")).alias("q")).agg(
        F.max(F.struct("date", "id", "value")).alias("last"), F.count(F.lit(1)).alias("n")
    )
    shards = quarters.groupBy("source", F.floor(F.col("q") / shard_quarters).alias("shard")).agg(
        F.sort_array(F.collect_list(F.struct("q", "n", F.col("last.date").alias("date"), F.col("last.value").alias("value")))).alias("readings")
    )
    scan = Window.partitionBy("source").orderBy("shard")
    carried = shards.withColumn("next_q", F.lead(F.col("readings")[0]["q"]).over(scan))
    filled = carried.select(
        "source",
        F.explode(
            F.flatten(
                F.transform(
                    "readings",
                    lambda r, i: F.transform(
                        F.sequence(
                            r["q"],
                            F.when(i + 1 < F.size("readings"), F.get(F.col("readings"), i + 1)["q"])
                            .otherwise(F.coalesce(F.col("next_q"), r["q"] + 1))
                            - 1,
                        ),
                        lambda q: F.struct(q.alias("q"), r.alias("r")),
                    ),
                )
            )
        ).alias("g"),
    )
    is_filled = F.col("g.q") > F.col("g.r.q")
    return filled.select(
        "source",
        quarter_end(F.col("g.q")).alias("rebal_date"),
        F.col("g.r.value").alias("value"),
        F.col("g.r.date").alias("reading_date"),
        F.when(is_filled, F.lit(0)).otherwise(F.col("g.r.n")).cast("bigint").alias("n_readings"),
        is_filled.alias("filled"),
        (F.col("g.q") - F.col("g.r.q")).cast("int").alias("periods_since"),
    )
