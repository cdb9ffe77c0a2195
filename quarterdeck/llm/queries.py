"""Queries of the llm-tagged problems over the test tables, and the SQL some are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, load
from .clusters import cluster, debt_and_spread, describe
from .packing import fills, pack
from .survivor import NO_STATEMENT, survivors
from .tokens import encode, token_counts
from .topn import latest_scored, top_n
from .truncated import rates, truncated


def p1_members(spark: SparkSession, d: str) -> DataFrame:
    """Every panel row that belongs to a group of like debt and spread."""
    rows, coordinates = debt_and_spread(load(spark, d, "feature_panel").select("panel_id", "debt_gdp", "yield_spread_bps"))
    return cluster(rows, "panel_id", coordinates)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_members(spark, d).select("panel_id", "cluster_id")


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every group with its size, centre and most typical rows."""
    return describe(p1_members(spark, d), "panel_id")


def p1_compare(spark: SparkSession, d: str) -> DataFrame:
    """The number of groups beside the numbers that earlier trials found."""
    found = p1_clusters(spark, d).agg(F.count(F.lit(1)).cast("int").alias("n_groups"))
    trials = load(spark, d, "stage1_algorithm_comparison").select("tier", "algorithm", "k_or_mcs", "n_clusters_found")
    return trials.crossJoin(F.broadcast(found)).withColumn("difference", F.col("n_groups") - F.col("n_clusters_found"))  # one row of counts


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One surviving record per noted action, its values, and the rows they come from."""
    return survivors(load(spark, d, "rating_raw"), load(spark, d, "source_trust"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_survivors(spark, d).select("group_id", "rating_raw_id", "outlook_raw_id", "date_raw_id")


def p3_majority(spark: SparkSession, d: str) -> DataFrame:
    """The same groups with every note as one vote: token by token the majority decides, and trust only ties."""
    return survivors(load(spark, d, "rating_raw"), load(spark, d, "source_trust"), vote="notes")


def p6_top(spark: SparkSession, d: str) -> DataFrame:
    """The five issuers with the highest predicted excess return of every run and date."""
    best = top_n(latest_scored(load(spark, d, "return_signals")), ["run_id", "rebal_date"], "predicted_excess_return", "country_code", 5)
    return best.withColumnRenamed("rank_in_group", "rank_within_date")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_top(spark, d).select("signal_id", "rank_within_date")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(load(spark, d, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document in a container of every capacity, sized by the tokenizer that the capacity names."""
    docs, caps = load(spark, d, "documents"), load(spark, d, "pack_capacity")
    n = docs.count()  # footers only
    out = None
    for (name,) in caps.select("tokenizer").distinct().orderBy("tokenizer").collect():  # a few parameters, not data
        sizes = cut_lineage(token_counts(docs, "doc_id", "text", name))  # two small columns; the texts are encoded once
        packed = pack(sizes, "doc_id", "n_tokens", caps.filter(F.col("tokenizer") == name), n_rows=n)
        out = packed if out is None else out.unionByName(packed)
    return out


def p9_fills(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of every capacity are."""
    return fills(p9_containers(spark, d), load(spark, d, "pack_capacity"))


def p10_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the reason why it counts as cut, or NULL."""
    return truncated(load(spark, d, "documents"), "doc_id", "source", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_rows(spark, d).filter("reason IS NOT NULL").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """The share of cut texts per source."""
    return rates(p10_rows(spark, d))


QUERIES = {"p1_found": p1_found, "p1_clusters": p1_clusters, "p1_compare": p1_compare, "p3_survivors": p3_survivors, "p3_found": p3_found, "p3_majority": p3_majority, "p6_top": p6_top, "p6_found": p6_found, "p8_ids": p8_ids, "p9_containers": p9_containers, "p9_fills": p9_fills, "p10_rows": p10_rows, "p10_found": p10_found, "p10_rates": p10_rates}

_MARKS = ", ".join(f"'{m}'" for m in NO_STATEMENT)
_P3 = f"""
WITH r AS (SELECT *, upper(trim(agency)) AS ag, date_trunc('month', date) AS mo FROM rating_raw),
g AS (SELECT country, ag, mo, min(raw_id) AS group_id, count(*) AS n_rows FROM r WHERE country IS NOT NULL AND ag IS NOT NULL AND mo IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
t AS (SELECT source, field_name, min(trust_rank) AS k FROM source_trust GROUP BY ALL),
c AS (
  SELECT g.group_id, f.field_name, r.raw_id, CASE f.field_name WHEN 'rating' THEN trim(r.rating) WHEN 'outlook' THEN trim(r.outlook) ELSE strftime(r.date, '%Y-%m-%d') END AS value,
         row_number() OVER (PARTITION BY g.group_id, f.field_name ORDER BY coalesce(t.k, 2147483647), r.recorded_at DESC NULLS LAST, r.raw_id) AS n
  FROM g JOIN r USING (country, ag, mo) CROSS JOIN (VALUES ('rating'), ('outlook'), ('date')) f(field_name)
  LEFT JOIN t ON t.source = r.source AND t.field_name = f.field_name
  WHERE f.field_name = 'date' OR (f.field_name = 'outlook' AND upper(trim(r.outlook)) NOT IN ({_MARKS}))
     OR (f.field_name = 'rating' AND upper(trim(r.rating)) NOT IN ({_MARKS}) AND NOT regexp_matches(trim(r.rating), '^\\([^()]*\\)$'))
)
"""
_IDS = """SELECT g.group_id,
  coalesce(max(CASE WHEN field_name = 'rating' THEN raw_id END), -1) AS rating_raw_id,
  coalesce(max(CASE WHEN field_name = 'outlook' THEN raw_id END), -1) AS outlook_raw_id,
  coalesce(max(CASE WHEN field_name = 'date' THEN raw_id END), -1) AS date_raw_id
FROM g LEFT JOIN c ON c.group_id = g.group_id AND c.n = 1 GROUP BY g.group_id
"""
_P6 = """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY run_id, rebal_date, country_code ORDER BY scored_at DESC NULLS LAST, signal_id) AS n FROM return_signals),
k AS (SELECT run_id, rebal_date, country_code, signal_id, predicted_excess_return, CAST(row_number() OVER (PARTITION BY run_id, rebal_date
             ORDER BY predicted_excess_return DESC, country_code) AS INT) AS rank_within_date
      FROM l WHERE n = 1 AND signal_status = 'scored' AND predicted_excess_return IS NOT NULL AND NOT isnan(predicted_excess_return))
"""
_VALUES = """
SELECT g.group_id, any_value(g.country) AS country, any_value(g.ag) AS agency, CAST(any_value(g.mo) AS DATE) AS month, any_value(g.n_rows) AS n_rows,
  max(CASE WHEN field_name = 'rating' THEN value END) AS rating, coalesce(max(CASE WHEN field_name = 'rating' THEN raw_id END), -1) AS rating_raw_id,
  max(CASE WHEN field_name = 'outlook' THEN value END) AS outlook, coalesce(max(CASE WHEN field_name = 'outlook' THEN raw_id END), -1) AS outlook_raw_id,
  max(CASE WHEN field_name = 'date' THEN value END) AS date, coalesce(max(CASE WHEN field_name = 'date' THEN raw_id END), -1) AS date_raw_id
FROM g LEFT JOIN c ON c.group_id = g.group_id AND c.n = 1 GROUP BY g.group_id
"""
ORACLE = {
    "p3_found": _P3 + _IDS,
    "p3_survivors": _P3 + _VALUES,
    "p6_top": _P6 + "SELECT * FROM k WHERE rank_within_date <= 5",
    "p6_found": _P6 + "SELECT signal_id, rank_within_date FROM k WHERE rank_within_date <= 5",
}
