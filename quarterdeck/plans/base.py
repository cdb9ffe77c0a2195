"""The tables as the engine reads them, in Spark and as SQL, and the register of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import nan_to_null
from ..operators.hot_deck import NUMERIC_PLACEHOLDERS
from ..operators.pit import first_by
from ..session import load
from ..sources.files import BOND_FIELDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    """Register a query under its function's name, with the SQL it is held against (named CTEs in front)."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = with_ctes(sql, *ctes)
        return fn

    return register


def with_ctes(sql: str, *names: str) -> str:
    parts = [f"{n} AS ({CTES[n]})" for n in names]
    if not parts:
        return sql
    body = sql.lstrip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body[15:]
    return "WITH " + ", ".join(parts) + (", " + body[5:] if body.upper().startswith("WITH ") else " " + body)


def r6(c: Column | str) -> Column:
    """Rounded to six decimals, as the SQL does."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def daily(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    """Bond readings, one per ric and date (the first delivered), NaN as NULL: ``ric, date, row_id`` and the fields asked for (else all, with the country)."""
    t = load(spark, d, "market_daily").select("ric", "date", "row_id", *(fields or ("country", *BOND_FIELDS)))
    return first_by(nan_to_null(t), ["ric", "date"], ["row_id"])


def macro(spark: SparkSession, d: str) -> DataFrame:
    """Macro facts with both dates, NaN as NULL."""
    t = load(spark, d, "macro_fact").select("fact_id", "country", "series", "period_date", "available_date", "value", "source")
    return nan_to_null(t).filter("period_date IS NOT NULL AND available_date IS NOT NULL")


PANEL_NUMBERS = (
    "yield_spread_bps", "debt_gdp", "fiscal_bal_gdp", "current_acct_gdp", "fx_reserves_mo", "cpi_inflation", "real_gdp_growth", "political_stability",
    "us_10y", "us_2y", "vix", "dxy_proxy", "curve_slope", "cds_5y",
)


def panel(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The feature panel, one row per country code and date (the smallest id); NaN and placeholders as NULL. With columns, only these beside the keys and the id."""
    every = ("country_name", "dm_em_flag", *PANEL_NUMBERS, "asof_max_available_date", "data_asof_ok", "missing_flag")
    t = nan_to_null(load(spark, d, "feature_panel").select("country_code", "rebal_date", "panel_id", *(columns or every)))
    for c, marks in NUMERIC_PLACEHOLDERS.items():
        if c in t.columns:
            t = t.withColumn(c, F.when(~F.col(c).isin(*marks), F.col(c)))
    return first_by(t, ["country_code", "rebal_date"], ["panel_id"])


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """Rating events with a number on the scale."""
    return load(spark, d, "rating_panel").filter(F.col("rating_numeric").between(1, 22))


def raw_log(spark: SparkSession, d: str) -> DataFrame:
    """Transcribed actions with trimmed, capitalised agencies."""
    t = load(spark, d, "rating_raw").select("raw_id", "country", F.initcap(F.trim("agency")).alias("agency"), "rating", "outlook", "date", "source", "recorded_at")
    return t


def signals(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The score of every issuer last recorded per run and date; NaN as NULL, unscored as NULL. With columns, only these beside the keys, the id and the scores."""
    keys, scores = ["run_id", "rebal_date", "country_code"], ["predicted_excess_return", "predicted_prob_positive", "signal_status"]
    t = load(spark, d, "return_signals")
    if columns:
        t = t.select(*dict.fromkeys([*keys, "signal_id", "scored_at", *scores, *columns]))
    t = nan_to_null(t).withColumn("_late", -F.unix_micros(F.col("scored_at").cast("timestamp")))
    t = first_by(t.drop("scored_at"), keys, ["_late", "signal_id"])
    scored = F.col("signal_status") == "scored"
    return t.withColumn("score", F.when(scored, F.col("predicted_excess_return"))).withColumn("prob", F.when(scored, F.col("predicted_prob_positive")))


def _nn(*names: str) -> str:
    return ", ".join(f"CASE WHEN NOT isnan({n}) THEN {n} END AS {n}" for n in names)


def _cell(name: str) -> str:
    marks = NUMERIC_PLACEHOLDERS.get(name)
    plain = f"CASE WHEN NOT isnan({name}) THEN {name} END"
    return f"CASE WHEN {plain} NOT IN ({', '.join(map(str, marks))}) THEN {plain} END AS {name}" if marks else f"{plain} AS {name}"


CTES = {
    "daily": f"SELECT ric, date, row_id, country, {_nn(*BOND_FIELDS)} FROM market_daily QUALIFY row_number() OVER (PARTITION BY ric, date ORDER BY row_id) = 1",
    "macro": f"SELECT fact_id, country, series, period_date, available_date, {_nn('value')}, source FROM macro_fact WHERE period_date IS NOT NULL AND available_date IS NOT NULL",
    "panel": f"SELECT country_code, rebal_date, panel_id, country_name, dm_em_flag, {', '.join(map(_cell, PANEL_NUMBERS))}, asof_max_available_date, data_asof_ok, missing_flag "
    "FROM feature_panel QUALIFY row_number() OVER (PARTITION BY country_code, rebal_date ORDER BY panel_id) = 1",
    "ratings": "SELECT * FROM rating_panel WHERE rating_numeric BETWEEN 1 AND 22",
    "rawlog": "SELECT raw_id, country, upper(substr(trim(agency), 1, 1)) || lower(substr(trim(agency), 2)) AS agency, rating, outlook, date, source, recorded_at FROM rating_raw",
    "signals": f"SELECT * EXCLUDE (excess_return, predicted_excess_return, predicted_prob_positive), {_nn('excess_return')}, "
    "CASE WHEN signal_status = 'scored' THEN CASE WHEN NOT isnan(predicted_excess_return) THEN predicted_excess_return END END AS score, "
    "CASE WHEN signal_status = 'scored' THEN CASE WHEN NOT isnan(predicted_prob_positive) THEN predicted_prob_positive END END AS prob "
    "FROM return_signals QUALIFY row_number() OVER (PARTITION BY run_id, rebal_date, country_code ORDER BY scored_at DESC, signal_id) = 1",
    "spine": "SELECT last_day(CAST(m AS DATE)) AS rebal_date FROM (SELECT unnest(generate_series(DATE '2005-03-01', DATE '2025-12-01', INTERVAL 3 MONTH)) AS m)",
    "globals": "SELECT rebal_date, avg(us_10y) AS us_10y, avg(us_2y) AS us_2y, avg(vix) AS vix, avg(dxy_proxy) AS dxy_proxy FROM panel GROUP BY rebal_date",
}
CTES["entities"] = (
    "SELECT iso3, name, CASE WHEN upper(trim(classification)) IN ('DM', 'EM') THEN upper(trim(classification)) END AS classification, bond_ric FROM universe "
    "QUALIFY row_number() OVER (PARTITION BY iso3 ORDER BY name NULLS FIRST, iso2 NULLS FIRST, classification NULLS FIRST, bond_ric NULLS FIRST, cds_ric NULLS FIRST) = 1"
)
#: The quarter end of a date in SQL.
QEND = "last_day(CAST(date_trunc('quarter', {0}) AS DATE) + INTERVAL 2 MONTH)"
