"""Queries of the general data-pipeline problems (2, 4, 5, 7) over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ratings import BEST, WORST, rating_ordinal
from ..operators.hot_deck import NUMERIC_PLACEHOLDERS, TEXT_PLACEHOLDERS, filled_cells, hot_deck
from ..operators.implausible import Rules, implausible_fields
from ..operators.known_at import known_at
from ..operators.regular_grid import to_quarter_grid
from ..session import load


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every ric on the quarter grid, missing quarters filled and marked."""
    g = to_quarter_grid(load(spark, d, "market_daily"), "ric", "date", "mid_price", "row_id")
    return g.withColumnRenamed("source", "ric")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_grid(spark, d).filter("filled").select("ric", F.date_format("rebal_date", "yyyy-MM-dd").alias("rebal_date"))


def p4_known(spark: SparkSession, d: str) -> DataFrame:
    """Every panel row and series with the fact known on the rebalancing date."""
    return known_at(load(spark, d, "feature_panel"), load(spark, d, "macro_fact"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_known(spark, d).select("panel_id", "fact_id")


#: A price is positive; a quoted yield lies within these percentages; both are judged by moves.
PRICE_RULES = Rules(lowest=1e-9)
YIELD_RULES = Rules(lowest=-50.0, highest=500.0)
#: Ordinals move by a few notches: a departure counts in notches, which come in halves, and a third of a per mille is risked.
RATING_RULES = Rules(lowest=BEST, highest=WORST, window=4, risk=3e-4, trim=3e-4, grid=0.5, by_moves=False)


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Every unbelievable price, yield or rating number, with the reason."""
    daily, panel = load(spark, d, "market_daily"), load(spark, d, "rating_panel")
    market = implausible_fields(daily, ["ric"], "date", "row_id", {"mid_price": PRICE_RULES, "yldtomat": YIELD_RULES})
    rated = panel.select("country", "agency", "date", "rating_numeric", "rating_id", rating_ordinal(F.col("rating")).alias("letters"))
    ratings = implausible_fields(rated, ["country", "agency"], "date", "rating_id", {"rating_numeric": RATING_RULES}, {"rating_numeric": "letters"})
    return market.select(F.lit("market_daily").alias("table_name"), "field_name", F.col("row_id").alias("row_key"), "reason").unionByName(
        ratings.select(F.lit("rating_panel").alias("table_name"), "field_name", F.col("rating_id").alias("row_key"), "reason")
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_reasons(spark, d).select("table_name", "row_key").distinct()


def p7_filled(spark: SparkSession, d: str) -> DataFrame:
    """The panel with its four fields filled by hot-deck, and the marks."""
    return hot_deck(load(spark, d, "feature_panel"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return filled_cells(p7_filled(spark, d))


QUERIES = {"p2_grid": p2_grid, "p2_found": p2_found, "p4_known": p4_known, "p4_found": p4_found, "p5_reasons": p5_reasons, "p5_found": p5_found, "p7_filled": p7_filled, "p7_found": p7_found}

_P2 = """
WITH r AS (SELECT ric, date, mid_price, row_id, year(date) * 4 + quarter(date) - 1 AS q FROM market_daily
           WHERE mid_price IS NOT NULL AND NOT isnan(mid_price) AND ric IS NOT NULL AND date IS NOT NULL),
k AS (SELECT ric, q, count(*) AS n, arg_max(mid_price, (date, row_id)) AS v, max(date) AS dt FROM r GROUP BY ric, q),
s AS (SELECT *, coalesce(lead(q) OVER (PARTITION BY ric ORDER BY q), q + 1) AS nq FROM k),
g AS (SELECT ric, v, dt, n, q, unnest(generate_series(q, nq - 1)) AS gq FROM s)
"""
_END = "last_day(make_date(CAST(gq // 4 AS INT), CAST((gq % 4) * 3 + 3 AS INT), 1))"
_P4 = """
WITH f AS (SELECT country, series, fact_id, period_date, available_date FROM macro_fact
           WHERE value IS NOT NULL AND NOT isnan(value) AND period_date IS NOT NULL AND available_date IS NOT NULL),
j AS (SELECT p.panel_id, f.*, row_number() OVER (PARTITION BY p.panel_id, f.series
             ORDER BY f.period_date DESC, f.available_date DESC, f.fact_id) AS n
      FROM feature_panel p JOIN f ON f.country = p.country_name AND f.available_date <= p.rebal_date AND f.period_date <= p.rebal_date)
"""


def _p7_sql() -> str:
    parts = []
    for f, marks in NUMERIC_PLACEHOLDERS.items():
        parts.append(f"SELECT panel_id, '{f}' AS field_name FROM feature_panel WHERE {f} IS NULL OR isnan({f}) OR isinf({f}) OR {f} IN ({', '.join(map(str, marks))})")
    words = ", ".join(f"'{w}'" for w in TEXT_PLACEHOLDERS)
    parts.append(f"SELECT panel_id, 'coverage_tier' AS field_name FROM feature_panel WHERE coverage_tier IS NULL OR lower(trim(coverage_tier)) IN ({words})")
    return " UNION ALL ".join(parts)


def _p7_filled_sql() -> str:
    """Per field the missing cells, the donors of the three levels (one per key and date), and the nearest of the first level that has one."""
    words = ", ".join(f"'{w}'" for w in TEXT_PLACEHOLDERS)
    ok = {f: f"({f} IS NOT NULL AND NOT isnan({f}) AND NOT isinf({f}) AND {f} NOT IN ({', '.join(map(str, marks))}))" for f, marks in NUMERIC_PLACEHOLDERS.items()}
    ok["coverage_tier"] = f"(coverage_tier IS NOT NULL AND lower(trim(coverage_tier)) NOT IN ({words}))"
    ctes, cols, joins = [], [], ""
    for f, good in ok.items():
        ctes.append(f"c_{f} AS (SELECT DISTINCT country_code AS grp, dm_em_flag AS kind, rebal_date AS date FROM feature_panel WHERE NOT coalesce({good}, false))")
        for level, key in (("g", "country_code"), ("k", "dm_em_flag"), ("a", "1")):
            mine = {"g": "grp", "k": "kind", "a": "1"}[level]
            ctes.append(f"d_{level}_{f} AS (SELECT {key} AS k, rebal_date AS date, min(panel_id) AS id FROM feature_panel WHERE {good} GROUP BY ALL)")
            ctes.append(
                f"n_{level}_{f} AS (SELECT c.grp, c.kind, c.date, arg_min(d.id, (abs(date_diff('day', d.date, c.date)), d.date)) AS id FROM c_{f} c JOIN d_{level}_{f} d ON d.k IS NOT DISTINCT FROM c.{mine} GROUP BY ALL)"
                if level != "a" else f"n_a_{f} AS (SELECT c.grp, c.kind, c.date, arg_min(d.id, (abs(date_diff('day', d.date, c.date)), d.date)) AS id FROM c_{f} c, d_a_{f} d GROUP BY ALL)"
            )
        same = "IS NOT DISTINCT FROM"
        ctes.append(
            f"p_{f} AS (SELECT c.*, coalesce(g.id, k.id, a.id) AS id FROM c_{f} c LEFT JOIN n_g_{f} g ON g.grp {same} c.grp AND g.kind {same} c.kind AND g.date = c.date "
            f"LEFT JOIN n_k_{f} k ON k.grp {same} c.grp AND k.kind {same} c.kind AND k.date = c.date LEFT JOIN n_a_{f} a ON a.grp {same} c.grp AND a.kind {same} c.kind AND a.date = c.date)"
        )
        joins += f" LEFT JOIN p_{f} ON NOT coalesce({good.replace(f, 'r.' + f)}, false) AND p_{f}.grp {same} r.country_code AND p_{f}.kind {same} r.dm_em_flag AND p_{f}.date = r.rebal_date LEFT JOIN feature_panel o_{f} ON o_{f}.panel_id = p_{f}.id"
        cols.append(
            f"CASE WHEN {good.replace(f, 'r.' + f)} THEN r.{f} ELSE o_{f}.{f} END AS {f}, p_{f}.id IS NOT NULL AS {f}_filled, p_{f}.id AS {f}_donor, CAST(abs(date_diff('day', o_{f}.rebal_date, r.rebal_date)) AS INT) AS {f}_distance"
        )
    return f"WITH {', '.join(ctes)} SELECT r.panel_id, r.country_code, r.rebal_date, {', '.join(cols)} FROM feature_panel r{joins}"


ORACLE = {
    "p2_grid": _P2 + f"SELECT ric, {_END} AS rebal_date, v AS value, dt AS reading_date, CASE WHEN gq = q THEN n ELSE 0 END AS n_readings, gq > q AS filled, CAST(gq - q AS INT) AS periods_since FROM g",
    "p2_found": _P2 + f"SELECT ric, strftime({_END}, '%Y-%m-%d') AS rebal_date FROM g WHERE gq > q",
    "p4_known": _P4 + "SELECT panel_id, series, fact_id, period_date, available_date FROM j WHERE n = 1",
    "p4_found": _P4 + "SELECT panel_id, fact_id FROM j WHERE n = 1",
    "p7_filled": _p7_filled_sql(),
    "p7_found": _p7_sql(),
}
