"""Attributes as they were known at event time.

Facts are first reduced to one per entity, series and *effective* date (the day from
which both its availability and its period lie in the past), the best by the tie rule;
events are reduced to distinct (entity, date) keys.  Both reductions are map-side
combined, so no entity brings more rows into a bucket than its calendar has days.
Entities are hash-partitioned into buckets; each bucket runs an embedded DuckDB that
orders the versions by effective date, carries the current state forward and joins it by
ASOF LEFT JOIN.  The answers return to the events by an equi-join.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of versions and keys that a bucket should hold on average.
BUCKET_ROWS = 100_000
_ANSWER = "entity string, as_of date, series string, fact_id bigint, period_date date, available_date date"

_SQL = """
WITH versions AS (
  SELECT entity, series, effective,
         max(rank) OVER (PARTITION BY entity, series ORDER BY effective) AS rank
  FROM (SELECT entity, series, effective, {'p': period_date, 'a': available_date, 'f': -fact_id} AS rank FROM facts)
), wanted AS (
  SELECT k.entity, k.as_of, s.series FROM keys k JOIN (SELECT DISTINCT entity, series FROM facts) s USING (entity)
)
SELECT w.entity, w.as_of, w.series, -(v.rank.f) AS fact_id, v.rank.p AS period_date, v.rank.a AS available_date
FROM wanted w ASOF LEFT JOIN versions v
  ON w.entity = v.entity AND w.series = v.series AND w.as_of >= v.effective
WHERE v.rank IS NOT NULL
"""


def _bucket_join(facts: pa.Table, keys: pa.Table) -> pa.Table:
    import duckdb

    schema = pa.schema(
        [("entity", pa.string()), ("as_of", pa.date32()), ("series", pa.string()), ("fact_id", pa.int64()), ("period_date", pa.date32()), ("available_date", pa.date32())]
    )
    if facts.num_rows == 0 or keys.num_rows == 0:
        return schema.empty_table()
    con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})  # no spill to the worker's own disk: a bucket is bounded by its entities' calendars
    try:
        con.register("facts", facts)
        con.register("keys", keys)
        out = con.sql(_SQL).to_arrow_table()
    finally:
        con.close()
    return out.cast(schema)


def known_at(
    events: DataFrame,
    facts: DataFrame,
    event_id: str = "panel_id",
    event_entity: str = "country_name",
    event_date: str = "rebal_date",
    entity: str = "country",
    series: str = "series",
    fact_id: str = "fact_id",
    period_date: str = "period_date",
    available_date: str = "available_date",
    value: str = "value",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``event_id, series, fact_id, period_date, available_date``: per event and series the fact with
    the latest period, then the latest availability, then the smallest id, among those whose
    availability and period lie on or before the event date and which have a value.

    Facts with a NULL or NaN value, or a NULL entity, series, id or date, are never known; an event with
    a NULL entity or date, and an event before the first known fact, gives no row.  Repeated
    events are answered each.  Empty inputs give an empty result; other columns are ignored.
    """
    f = facts.select(
        F.col(entity).cast("string").alias("entity"), F.col(series).cast("string").alias("series"), F.col(fact_id).cast("bigint").alias("fact_id"),
        F.col(period_date).cast("date").alias("period_date"), F.col(available_date).cast("date").alias("available_date"), F.col(value).cast("double").alias("value"),
    )
    f = f.filter(F.col("value").isNotNull() & ~F.isnan("value")).drop("value").dropna()
    versions = (
        f.groupBy("entity", "series", F.greatest("period_date", "available_date").alias("effective"))
        .agg(F.max(F.struct("period_date", "available_date", (-F.col("fact_id")).alias("neg_id"))).alias("b"))
        .select("entity", "series", "effective", F.col("b.period_date").alias("period_date"), F.col("b.available_date").alias("available_date"), (-F.col("b.neg_id")).alias("fact_id"))
    )
    e = events.select(F.col(event_id).alias("event_id"), F.col(event_entity).cast("string").alias("entity"), F.col(event_date).cast("date").alias("as_of"))
    keys = e.select("entity", "as_of").dropna().distinct()
    n = facts.count() + events.count()  # footers only
    buckets = max(8, -(-n // bucket_rows))
    bucket = F.pmod(F.xxhash64("entity"), F.lit(buckets)).alias("bucket")
    answers = (
        versions.select(bucket, "*").groupBy("bucket").cogroup(keys.select(bucket, "*").groupBy("bucket")).applyInArrow(_bucket_join, _ANSWER)
    )
    packed = answers.groupBy("entity", "as_of").agg(F.collect_list(F.struct("series", "fact_id", "period_date", "available_date")).alias("known"))
    return (
        e.join(packed, ["entity", "as_of"])
        .select(F.col("event_id").alias(event_id), F.explode("known").alias("k"))
        .select(event_id, "k.series", "k.fact_id", "k.period_date", "k.available_date")
    )
