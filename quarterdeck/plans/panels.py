"""Queries of the panel algebra: spine, resampling, as-of joins, features, targets, guards, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import annual_available_date, month_start, quarter_end
from ..functions.numbers import any_missing, enough_observed, n_observed, simple_return
from ..operators import calendar as cal
from ..operators import folds as fo
from ..operators import panel as pn
from ..operators import pit
from ..session import load
from .base import QEND, daily, macro, panel, query, r6, signals

CORE = list(pn.CORE_FEATURES)
_MACRO_LIST = ", ".join(f"'{s}'" for s in pn.MACRO_FEATURES)
_NOBS = " + ".join(f"({c} IS NOT NULL)::INT" for c in CORE)


def _q(d: str) -> str:
    return f"CAST({QEND.format(d)} AS DATE)"


@query("SELECT rebal_date, lead(rebal_date) OVER (ORDER BY rebal_date) AS next_date FROM spine", "spine")
def o148_spine_next_date(spark: SparkSession, d: str) -> DataFrame:
    """O-148, O-56: quarter-end spine and each date's successor on it."""
    return cal.with_next_date(cal.quarter_spine(spark))


@query("SELECT country, rebal_date FROM (SELECT DISTINCT name AS country FROM universe WHERE name IS NOT NULL) CROSS JOIN spine", "spine")
def o063_spine_by_entity(spark: SparkSession, d: str) -> DataFrame:
    """O-63: spine times entities."""
    return cal.spine_by_entity(cal.quarter_spine(spark), load(spark, d, "universe").select(F.col("name").alias("country")).dropna().distinct())


@query(
    f"""WITH k AS (SELECT ric, {_q('date')} AS rebal_date, last(mid_price ORDER BY date, row_id) FILTER (mid_price IS NOT NULL) AS mid_price,
    last(zspread ORDER BY date, row_id) FILTER (zspread IS NOT NULL) AS zspread, last(int_cds ORDER BY date, row_id) FILTER (int_cds IS NOT NULL) AS int_cds
    FROM daily GROUP BY ALL) SELECT e.ric, s.rebal_date, mid_price, zspread, int_cds FROM (SELECT DISTINCT ric FROM daily) e CROSS JOIN spine s LEFT JOIN k USING (ric, rebal_date)""",
    "daily", "spine",
)
def o064_resample_last(spark: SparkSession, d: str) -> DataFrame:
    """O-64, O-54: last observed value per column and quarter, aligned to the spine."""
    t = daily(spark, d, "mid_price", "zspread", "int_cds")
    q = pit.resample_last(t, ["ric"], "date", ["mid_price", "zspread", "int_cds"], "row_id")
    return cal.reindex(cal.spine_by_entity(cal.quarter_spine(spark), load(spark, d, "market_daily").select("ric").distinct()), q, ["ric", "rebal_date"])


_ASOF = """WITH e AS (SELECT DISTINCT country, series FROM macro), f AS (SELECT * FROM macro QUALIFY row_number() OVER (PARTITION BY country, series, available_date ORDER BY period_date DESC, fact_id) = 1)
SELECT e.country, e.series, s.rebal_date, f.value, f.source, f.available_date FROM e CROSS JOIN spine s ASOF LEFT JOIN f ON e.country = f.country AND e.series = f.series AND s.rebal_date >= f.available_date"""


SPINE = ("2005-01-01", "2025-12-31")


def _asof(spark: SparkSession, d: str) -> DataFrame:
    return pit.asof_quarters(macro(spark, d), ["country", "series"], "available_date", ["value", "source", "available_date"], [F.col("period_date"), -F.col("fact_id")], *SPINE)


@query(_ASOF, "macro", "spine")
def o048_asof_macro(spark: SparkSession, d: str) -> DataFrame:
    """O-48, O-32: latest fact available on every spine date, its value NULL or not, with its source."""
    return _asof(spark, d)


@query(
    """WITH g AS (SELECT series, available_date, min(value) AS value FROM macro WHERE country = (SELECT min(country) FROM macro) GROUP BY ALL), k AS (SELECT DISTINCT series FROM g)
    SELECT c.country, k.series, s.rebal_date, g.value FROM (SELECT DISTINCT country FROM macro) c CROSS JOIN k CROSS JOIN spine s ASOF LEFT JOIN g ON k.series = g.series AND s.rebal_date >= g.available_date""",
    "macro", "spine",
)
def o049_asof_global(spark: SparkSession, d: str) -> DataFrame:
    """O-49: series of one tag country, as of every spine date, replicated to every entity."""
    facts = macro(spark, d)
    tag = F.broadcast(facts.agg(F.min("country").alias("country")))  # one row
    own = facts.join(tag, "country").groupBy("series", "available_date").agg(F.min("value").alias("value"))
    known = pit.asof_quarters(own, ["series"], "available_date", ["value"], [F.coalesce("value", F.lit(0.0))], *SPINE)
    return facts.select("country").distinct().crossJoin(F.broadcast(known)).select("country", "series", "rebal_date", "value")  # series x calendar


def _lookups(spark: SparkSession, d: str, sign: int, days: dict[str, int]) -> DataFrame:
    t = daily(spark, d, "mid_price")
    per = load(spark, d, "market_daily").select("ric", quarter_end(F.col("date")).alias("rebal_date")).distinct()
    names = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(k).alias("days")) for n, k in days.items()))).alias("k")
    anchors = per.select("ric", "rebal_date", names).select("ric", "rebal_date", "k.name", F.date_add("rebal_date", sign * F.col("k.days")).alias("anchor"))
    return pit.bounded_lookup(anchors, t, ["ric"], "anchor", "date", "mid_price", pn.TOLERANCE_DAYS, "row_id")


def _lookup_sql(sign: str, days: dict[str, int]) -> str:
    values = ", ".join(f"('{n}', {k})" for n, k in days.items())
    return f"""WITH a AS (SELECT DISTINCT ric, {_q('date')} AS rebal_date FROM daily), b AS (SELECT ric, rebal_date, name, CAST(rebal_date {sign} to_days(days) AS DATE) AS anchor FROM a CROSS JOIN (VALUES {values}) v(name, days))
    SELECT b.ric, b.rebal_date, b.name, b.anchor, arg_max_null(d.mid_price, d.date) FILTER (d.date IS NOT NULL) AS mid_price
    FROM b LEFT JOIN daily d ON d.ric = b.ric AND d.date <= b.anchor AND d.date >= b.anchor - 10 GROUP BY ALL"""


@query(_lookup_sql("-", pn.LOOKBACKS), "daily")
def o050_bounded_lookback(spark: SparkSession, d: str) -> DataFrame:
    """O-50: price 30, 91 and 365 days back, at most 10 days stale."""
    return _lookups(spark, d, -1, pn.LOOKBACKS)


@query(_lookup_sql("+", pn.HORIZONS), "daily")
def o051_bounded_forward(spark: SparkSession, d: str) -> DataFrame:
    """O-51: price 30, 91 and 182 days ahead, for historical targets only."""
    return _lookups(spark, d, 1, pn.HORIZONS)


@query(
    f"""WITH a AS (SELECT DISTINCT ric, {_q('date')} AS rebal_date FROM daily)
    SELECT a.ric, a.rebal_date, round(CASE WHEN count(zspread) >= 10 AND stddev_samp(zspread) > 1e-9 THEN (arg_max(zspread, d.date) - avg(zspread)) / stddev_samp(zspread) END, 6) AS zscore
    FROM a LEFT JOIN daily d ON d.ric = a.ric AND d.date <= a.rebal_date AND d.date > a.rebal_date - 364 GROUP BY ALL""",
    "daily",
)
def o066_trailing_zscore(spark: SparkSession, d: str) -> DataFrame:
    """O-52, O-66: spread against its trailing 364 days."""
    t = daily(spark, d, "zspread")
    anchors = load(spark, d, "market_daily").select("ric", quarter_end(F.col("date")).alias("rebal_date")).distinct()
    return pit.trailing_zscore(anchors, t, ["ric"], "rebal_date", "date", "zspread", 364).withColumn("zscore", r6("zscore"))


@query(
    """WITH h AS (SELECT ric, bool_or(dirty_prc IS NOT NULL) AS a, bool_or(clean_prc IS NOT NULL) AS b, bool_or(mid_price IS NOT NULL) AS c, bool_or(bid IS NOT NULL AND ask IS NOT NULL) AS e, bool_or(bid IS NOT NULL) AS f FROM daily GROUP BY ric),
    k AS (SELECT ric, CASE WHEN a THEN 'dirty_prc' WHEN b THEN 'clean_prc' WHEN c THEN 'mid_price' WHEN e THEN 'synthetic_mid' WHEN f THEN 'bid' END AS price_field FROM h)
    SELECT ric, date, price_field, round(CASE price_field WHEN 'dirty_prc' THEN dirty_prc WHEN 'clean_prc' THEN clean_prc WHEN 'mid_price' THEN mid_price WHEN 'synthetic_mid' THEN (bid + ask) / 2 WHEN 'bid' THEN bid END, 6) AS price
    FROM daily JOIN k USING (ric)""",
    "daily",
)
def o028_best_price(spark: SparkSession, d: str) -> DataFrame:
    """O-28: the price field each series has, in order of priority, with a synthetic mid."""
    return pn.best_price(daily(spark, d, "dirty_prc", "clean_prc", "mid_price", "bid", "ask"), ["ric"]).select("ric", "date", "price_field", r6("price").alias("price"))


@query(
    """WITH h AS (SELECT ric, bool_or(clean_prc IS NOT NULL) AND bool_or(dirty_prc IS NOT NULL) AS b, bool_or(yldtomat IS NOT NULL) AS y, bool_or(mid_price IS NOT NULL) AS m,
    round(avg(CASE WHEN mod_durtn IS NOT NULL AND convexity IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS dur_conv_coverage FROM daily GROUP BY ric)
    SELECT ric, CASE WHEN b AND y THEN 'full_dm' WHEN b THEN 'dm_standard' WHEN m THEN 'em_standard' ELSE 'em_minimal' END AS coverage_tier, dur_conv_coverage FROM h""",
    "daily",
)
def o035_coverage_tier(spark: SparkSession, d: str) -> DataFrame:
    """O-35, O-65: tier by the fields a series has, and the share of days with duration and convexity."""
    return bond_coverage(daily(spark, d, "clean_prc", "dirty_prc", "yldtomat", "mid_price", "mod_durtn", "convexity"))


def bond_coverage(t: DataFrame) -> DataFrame:
    """``ric, coverage_tier, dur_conv_coverage``: presence of fields and the share of days with both sensitivities, in one aggregation."""
    fields = ("clean_prc", "dirty_prc", "yldtomat", "mid_price")
    both = (F.col("mod_durtn").isNotNull() & F.col("convexity").isNotNull()).cast("double")
    has = t.groupBy("ric").agg(*(F.max(F.col(f).isNotNull()).alias(f"has_{f}") for f in fields), r6(F.avg(both)).alias("dur_conv_coverage"))
    return has.select("ric", pn.coverage_tier({f: F.col(f"has_{f}") for f in fields}).alias("coverage_tier"), "dur_conv_coverage")


_WIDE = ", ".join(f"max(value) FILTER (series = '{s}') AS {s}, max(source) FILTER (series = '{s}') AS {s}_source, max(available_date) FILTER (series = '{s}') AS {s}_avail" for s in pn.MACRO_FEATURES)


def macro_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per country and quarter end: every series' known value, source and availability, and the newest availability."""
    wide = _asof(spark, d).groupBy("country", "rebal_date").agg(
        *(F.max(F.when(F.col("series") == s, F.col(c))).alias(a) for s in pn.MACRO_FEATURES for c, a in (("value", s), ("source", f"{s}_source"), ("available_date", f"{s}_avail")))
    )
    return wide.withColumn("asof_max_available_date", F.greatest(*(f"{s}_avail" for s in pn.MACRO_FEATURES)))


@query(
    f"""WITH a AS (SELECT e.country, e.series, s.rebal_date, f.value, f.source, f.available_date FROM (SELECT DISTINCT country, series FROM macro) e CROSS JOIN spine s ASOF LEFT JOIN (SELECT * FROM macro QUALIFY row_number() OVER (PARTITION BY country, series, available_date ORDER BY period_date DESC, fact_id) = 1) f ON e.country = f.country AND e.series = f.series AND s.rebal_date >= f.available_date),
    w AS (SELECT country, rebal_date, {_WIDE} FROM a GROUP BY ALL),
    g AS (SELECT *, greatest({', '.join(f'{s}_avail' for s in pn.MACRO_FEATURES)}) AS asof_max_available_date FROM w)
    SELECT country, rebal_date, {', '.join(f'{s}, {s}_source' for s in pn.MACRO_FEATURES)}, asof_max_available_date, ({' OR '.join(f'{s} IS NULL' for s in pn.MACRO_FEATURES)}) AS missing_flag,
    asof_max_available_date IS NULL OR asof_max_available_date <= rebal_date AS data_asof_ok FROM g WHERE asof_max_available_date IS NULL OR asof_max_available_date <= rebal_date""",
    "macro", "spine",
)
def o031_macro_panel(spark: SparkSession, d: str) -> DataFrame:
    """O-29, O-31, O-32, O-34, O-38, O-99: wide macro panel with sources, newest availability, missing flag and leakage guard."""
    wide = macro_wide(spark, d)
    kept = pn.guard_known(wide, "asof_max_available_date", "rebal_date")
    return kept.select(
        "country", "rebal_date", *(c for s in pn.MACRO_FEATURES for c in (s, f"{s}_source")), "asof_max_available_date", any_missing(list(pn.MACRO_FEATURES)).alias("missing_flag"),
        F.lit(True).alias("data_asof_ok"),
    )


@query(
    "SELECT country_code, rebal_date, yield_spread_bps AS spread, round(us_10y - us_2y, 6) AS curve_slope, round(us_10y + yield_spread_bps / 100 - us_2y, 6) AS carry, round(cds_5y - yield_spread_bps, 6) AS cds_bond_basis, 'core' AS tier FROM panel",
    "panel",
)
def o023_derived(spark: SparkSession, d: str) -> DataFrame:
    """O-22, O-23, O-24, O-33: renamed, derived and constant columns (the two-year yield stands in for the bill)."""
    t = pn.carry_and_basis(panel(spark, d, "us_10y", "us_2y", "yield_spread_bps", "cds_5y").withColumn("slope", F.col("us_10y") - F.col("us_2y")), "us_2y")
    return t.select("country_code", "rebal_date", F.col("yield_spread_bps").alias("spread"), r6("slope").alias("curve_slope"), r6("carry").alias("carry"), r6("cds_bond_basis").alias("cds_bond_basis"), F.lit("core").alias("tier"))


@query(
    f"SELECT panel_id, country_code, rebal_date, CAST({_NOBS} AS INT) AS n_observed, {_NOBS} >= 5 AS sufficient, ({' OR '.join(f'{c} IS NULL' for c in CORE)}) AS missing_flag FROM panel WHERE dm_em_flag = 'EM' AND country_code IN (SELECT iso3 FROM universe)",
    "panel",
)
def o037_sufficiency(spark: SparkSession, d: str) -> DataFrame:
    """O-30, O-37, O-36, O-39, O-42: observed features, sufficiency at half of them, population filters."""
    members = load(spark, d, "universe").select(F.col("iso3").alias("country_code")).distinct()
    t = panel(spark, d, "dm_em_flag", *CORE).filter("dm_em_flag = 'EM'").join(members, "country_code", "left_semi")
    return t.select("panel_id", "country_code", "rebal_date", n_observed(CORE).alias("n_observed"), enough_observed(CORE, 0.5).alias("sufficient"), any_missing(CORE).alias("missing_flag"))


_TARGET_SQL = f"""WITH h AS (SELECT ric, date, (bid + ask) / 2 AS mid FROM daily),
q AS (SELECT ric, {_q('date')} AS rebal_date, last(mid ORDER BY date) FILTER (mid IS NOT NULL) AS price FROM h GROUP BY ALL),
n AS (SELECT rebal_date, lead(rebal_date) OVER (ORDER BY rebal_date) AS next_date FROM spine),
x AS (SELECT q.ric, q.rebal_date, n.next_date AS target_period_end, q.price AS price_t, p.price AS price_t1, g.us_2y / 4 / 100 AS rf FROM q JOIN n USING (rebal_date) LEFT JOIN q p ON p.ric = q.ric AND p.rebal_date = n.next_date LEFT JOIN globals g ON g.rebal_date = q.rebal_date),
y AS (SELECT *, CASE WHEN price_t <> 0 THEN price_t1 / price_t - 1 END AS total_return FROM x)
SELECT ric, rebal_date, target_period_end, round(total_return, 6) AS total_return, round(rf, 6) AS rf_quarterly, round(total_return - rf, 6) AS excess_return, total_return - rf > 0 AS excess_return_binary, (total_return - rf) IS NOT NULL AS target_realized FROM y"""


def _globals(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d, *pn.GLOBAL_FEATURES).groupBy("rebal_date").agg(*(F.avg(c).alias(c) for c in pn.GLOBAL_FEATURES))


@query(_TARGET_SQL, "daily", "spine", "panel", "globals")
def o056_next_quarter_target(spark: SparkSession, d: str) -> DataFrame:
    """O-25, O-26, O-27, O-53, O-55, O-56, O-119: return to the spine successor less the risk-free return, sign and realized flags."""
    t = daily(spark, d, "bid", "ask").select("ric", "date", "row_id", ((F.col("bid") + F.col("ask")) / 2).alias("price"))
    q = pit.resample_last(t, ["ric"], "date", ["price"], "row_id")
    rows = q.join(F.broadcast(cal.with_next_date(cal.quarter_spine(spark))), "rebal_date")  # the spine: 84 dates
    ahead = q.select("ric", F.col("rebal_date").alias("next_date"), F.col("price").alias("price_t1"))
    rows = rows.join(ahead, ["ric", "next_date"], "left").join(_globals(spark, d), "rebal_date", "left")
    rf = pn.quarterly_risk_free(F.col("us_2y"))
    rows = rows.select("ric", "rebal_date", F.col("next_date").alias("target_period_end"), simple_return(F.col("price"), F.col("price_t1")).alias("total_return"), rf.alias("rf_quarterly"))
    out = pn.with_target(rows.withColumn("excess_return", F.col("total_return") - F.col("rf_quarterly")))
    return out.select("ric", "rebal_date", "target_period_end", *(r6(c).alias(c) for c in ("total_return", "rf_quarterly", "excess_return")), "excess_return_binary", "target_realized")


_HORIZON = " UNION ALL ".join(
    f"""SELECT '{n}' AS horizon, ric, rebal_date, CAST(rebal_date + {k} AS DATE) AS target_period_end, round(CASE WHEN price_t <> 0 THEN p / price_t - 1 END - rf / 100 * {k} / 365, 6) AS excess_return FROM (
    SELECT q.ric, q.rebal_date, q.price AS price_t, g.us_2y AS rf, arg_max_null(d.mid_price, d.date) FILTER (d.date IS NOT NULL) AS p FROM q LEFT JOIN globals g ON g.rebal_date = q.rebal_date
    LEFT JOIN daily d ON d.ric = q.ric AND d.date <= q.rebal_date + {k} AND d.date >= q.rebal_date + {k} - 10 GROUP BY q.ric, q.rebal_date, q.price, g.us_2y)"""
    for n, k in pn.HORIZONS.items()
)


@query(f"WITH q AS (SELECT ric, {_q('date')} AS rebal_date, last(mid_price ORDER BY date, row_id) FILTER (mid_price IS NOT NULL) AS price FROM daily GROUP BY ALL) {_HORIZON}", "daily", "panel", "globals")
def o146_horizon_targets(spark: SparkSession, d: str) -> DataFrame:
    """O-146: targets over 30, 91 and 182 days, rebuilt for every row in one pass and stacked by horizon."""
    t = daily(spark, d, "mid_price")
    q = pit.resample_last(t, ["ric"], "date", ["mid_price"], "row_id").withColumnRenamed("mid_price", "price_t").join(_globals(spark, d).select("rebal_date", "us_2y"), "rebal_date", "left")
    names = F.explode(F.array(*(F.struct(F.lit(n).alias("horizon"), F.lit(k).alias("days")) for n, k in pn.HORIZONS.items()))).alias("h")
    rows = q.select("ric", "rebal_date", "price_t", "us_2y", names).select("ric", "rebal_date", "price_t", "us_2y", "h.horizon", "h.days", F.date_add("rebal_date", F.col("h.days")).alias("target_period_end"))
    found = pit.bounded_lookup(rows, t, ["ric"], "target_period_end", "date", "mid_price", pn.TOLERANCE_DAYS, "row_id")
    er = pn.excess_return(F.col("price_t"), F.col("mid_price"), pn.horizon_risk_free(F.col("us_2y"), F.col("days")))
    return found.select("horizon", "ric", "rebal_date", "target_period_end", r6(er).alias("excess_return"))


@query(
    """WITH p AS (SELECT * FROM macro WHERE source = 'world_bank'), s AS (SELECT * FROM macro WHERE source = 'imf_weo')
    SELECT * FROM p UNION ALL SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.country = s.country AND p.series = s.series AND p.period_date = s.period_date)""",
    "macro",
)
def o057_fallback_union(spark: SparkSession, d: str) -> DataFrame:
    """O-57: the primary source, its gaps filled by the secondary."""
    m = macro(spark, d)
    return pit.gap_fill_union(m.filter("source = 'world_bank'"), m.filter("source = 'imf_weo'"), ["country", "series", "period_date"])


@query(
    f"SELECT fact_id, year(period_date)::INT AS year, CAST(make_date(year(period_date)::INT, 12, 1) + INTERVAL 6 MONTH AS DATE) AS lagged, CAST(date_trunc('month', available_date) AS DATE) AS month, {_q('available_date')} AS quarter, CAST(available_date + 1 AS DATE) AS next_day, CAST(date_diff('day', period_date, available_date) AS INT) AS lag_days, strftime(period_date, '%Y-%m') AS month_text FROM macro",
    "macro",
)
def o102_dates(spark: SparkSession, d: str) -> DataFrame:
    """O-102 to O-105: publication lag, month and quarter buckets, day arithmetic, formatting."""
    p, a = F.col("period_date"), F.col("available_date")
    return macro(spark, d).select(
        "fact_id", F.year(p).alias("year"), annual_available_date(F.year(p), 6).alias("lagged"), month_start(a).alias("month"), quarter_end(a).alias("quarter"),
        F.date_add(a, 1).alias("next_day"), F.datediff(a, p).alias("lag_days"), F.date_format(p, "yyyy-MM").alias("month_text"),
    )


@query(
    f"WITH k AS (SELECT *, {_NOBS} >= 5 AS ok FROM panel), g AS (SELECT rebal_date, sum(ok::INT) AS n, min(rebal_date) FILTER (ok) AS f FROM k GROUP BY rebal_date) SELECT rebal_date, min(f) OVER w AS training_window_start, rebal_date AS training_window_end, CAST(sum(n) OVER w AS BIGINT) AS training_window_n_rows FROM g WINDOW w AS (ORDER BY rebal_date ROWS UNBOUNDED PRECEDING)",
    "panel",
)
def o092_training_windows(spark: SparkSession, d: str) -> DataFrame:
    """O-40, O-91, O-92: the expanding window of every date: start, end, rows."""
    return fo.window_metadata(panel(spark, d, *CORE), "rebal_date", enough_observed(CORE, 0.5))


@query(
    """WITH d AS (SELECT DISTINCT rebal_date FROM signals) SELECT d.rebal_date, count(s.signal_id) AS training_window_n_rows, max(s.target_period_end) AS max_target_period_end
    FROM d LEFT JOIN signals s ON s.target_realized AND s.rebal_date <= d.rebal_date AND s.target_period_end <= d.rebal_date GROUP BY ALL""",
    "signals",
)
def o041_realized_windows(spark: SparkSession, d: str) -> DataFrame:
    """O-41, O-92: rows whose target was realized by every date, and the latest target end among them."""
    return fo.realized_metadata(signals(spark, d, "target_period_end", "target_realized"), "rebal_date", "target_period_end", F.col("target_realized"))


@query("SELECT * FROM panel WHERE rebal_date = (SELECT max(rebal_date) FROM panel)", "panel")
def o047_latest_slice(spark: SparkSession, d: str) -> DataFrame:
    """O-47: rows of the latest date."""
    from ..operators.selection import latest_slice

    return latest_slice(panel(spark, d), "rebal_date")


@query("SELECT panel_id, asof_max_available_date, rebal_date FROM panel WHERE asof_max_available_date IS NULL OR asof_max_available_date <= rebal_date", "panel")
def o038_leakage_guard(spark: SparkSession, d: str) -> DataFrame:
    """O-38: rows that use nothing from after their date; an unknown date counts as known."""
    return pn.guard_known(panel(spark, d, "asof_max_available_date"), "asof_max_available_date", "rebal_date").select("panel_id", "asof_max_available_date", "rebal_date")
