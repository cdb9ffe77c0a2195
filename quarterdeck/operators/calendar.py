"""Calendar spines: the regular dates that panels are built on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def quarter_spine(spark: SparkSession, start: str = "2005-01-01", end: str = "2025-12-31") -> DataFrame:
    """``rebal_date``: every quarter end between two dates."""
    months = F.sequence(F.add_months(F.trunc(F.lit(start).cast("date"), "quarter"), 2), F.lit(end).cast("date"), F.expr("interval 3 months"))
    dates = spark.range(1).select(F.explode(months).alias("m")).select(F.last_day("m").alias("rebal_date"))
    return dates.filter((F.col("rebal_date") >= F.lit(start).cast("date")) & (F.col("rebal_date") <= F.lit(end).cast("date")))


def with_next_date(spine: DataFrame) -> DataFrame:
    """The spine with ``next_date``, its successor on the spine (NULL at the end). The spine is a calendar: one window suffices."""
    return spine.withColumn("next_date", F.lead("rebal_date").over(Window.partitionBy(F.lit(0)).orderBy("rebal_date")))


def spine_by_entity(spine: DataFrame, entities: DataFrame) -> DataFrame:
    """Every spine date for every entity. The spine is the calendar's length (84 quarters in 21 years), so it is broadcast."""
    return entities.crossJoin(F.broadcast(spine))


def reindex(spine: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """The series aligned to the spine, NULL where it has no row."""
    return spine.join(series, keys, "left")
