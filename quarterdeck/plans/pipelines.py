"""The panels end to end: feature matrix, return panel, and what is fitted on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import quarter_end
from ..functions.numbers import any_missing, simple_return
from ..operators import calendar as cal
from ..operators import events as ev
from ..operators import models as mo
from ..operators import panel as pn
from ..operators import pit
from ..session import cut_lineage, load
from .base import QEND, daily, query, r6, ratings
from .logs import o001_universe
from .modelling import compared
from .panels import _globals, bond_coverage, macro_wide

# Coverage of the sensitivities that the extended tier asks of emerging issuers, and the model's features.
MIN_SENSITIVITY_COVERAGE = 0.7
RETURN_FEATURES = [
    "yield_spread_bps", "mom_1m", "mom_3m", "mom_12m", "carry", "spread_zscore_52w", "debt_gdp", "fiscal_bal_gdp", "cpi_inflation", "real_gdp_growth",
    "us_10y", "curve_slope", "vix", "dxy_proxy",
]
CORE_NUMBERS = ["yield_spread_bps", *pn.MACRO_FEATURES, *pn.GLOBAL_FEATURES, "curve_slope"]
_SOURCES = [f"{s}_source" for s in pn.MACRO_FEATURES]
_QUARTER = f"CAST({QEND.format('date')} AS DATE)"

_MATRIX = f"""WITH q AS (SELECT ric, {_QUARTER} AS rebal_date, {', '.join(f"last({c} ORDER BY date, row_id) FILTER ({c} IS NOT NULL) AS {a}" for c, a in (('zspread', 'yield_spread_bps'), ('mod_durtn', 'mod_duration'), ('convexity', 'convexity'), ('int_cds', 'cds_5y')))} FROM daily GROUP BY ALL),
h AS (SELECT ric, bool_or(clean_prc IS NOT NULL) AND bool_or(dirty_prc IS NOT NULL) AS b, bool_or(yldtomat IS NOT NULL) AS y, bool_or(mid_price IS NOT NULL) AS m, round(avg(CASE WHEN mod_durtn IS NOT NULL AND convexity IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS dur_conv_coverage FROM daily GROUP BY ric),
t AS (SELECT ric, CASE WHEN b AND y THEN 'full_dm' WHEN b THEN 'dm_standard' WHEN m THEN 'em_standard' ELSE 'em_minimal' END AS coverage_tier, dur_conv_coverage FROM h),
a AS (SELECT k.country, k.series, s.rebal_date, f.value, f.source, f.available_date FROM (SELECT DISTINCT country, series FROM macro) k CROSS JOIN spine s ASOF LEFT JOIN (SELECT * FROM macro QUALIFY row_number() OVER (PARTITION BY country, series, available_date ORDER BY period_date DESC, fact_id) = 1) f ON k.country = f.country AND k.series = f.series AND s.rebal_date >= f.available_date),
w AS (SELECT country, rebal_date, {', '.join(f"max(value) FILTER (series = '{s}') AS {s}, max(source) FILTER (series = '{s}') AS {s}_source" for s in pn.MACRO_FEATURES)}, max(available_date) FILTER (series IN ({', '.join(f"'{s}'" for s in pn.MACRO_FEATURES)})) AS asof_max_available_date FROM a GROUP BY ALL),
m AS (SELECT u.iso3 AS country_code, u.name AS country_name, u.classification AS dm_em_flag, u.bond_ric, s.rebal_date, q.yield_spread_bps, q.mod_duration, q.convexity, q.cds_5y, w.* EXCLUDE (country, rebal_date), g.us_10y, g.us_2y, g.vix, g.dxy_proxy, g.us_10y - g.us_2y AS curve_slope,
w.asof_max_available_date IS NULL OR w.asof_max_available_date <= s.rebal_date AS data_asof_ok, t.coverage_tier, t.dur_conv_coverage
FROM entities u CROSS JOIN spine s LEFT JOIN q ON q.ric = u.bond_ric AND q.rebal_date = s.rebal_date LEFT JOIN t ON t.ric = u.bond_ric LEFT JOIN w ON w.country = u.name AND w.rebal_date = s.rebal_date LEFT JOIN globals g ON g.rebal_date = s.rebal_date)
"""
_ROUNDED = ("us_10y", "us_2y", "vix", "dxy_proxy", "curve_slope")


def _columns(extended: bool) -> list[str]:
    extra = ["mod_duration", "convexity", "cds_5y"] if extended else []
    return ["country_code", "country_name", "dm_em_flag", "rebal_date", "yield_spread_bps", *extra, *pn.MACRO_FEATURES, *pn.GLOBAL_FEATURES, "curve_slope", *_SOURCES, "asof_max_available_date", "data_asof_ok", "missing_flag", "coverage_tier"]


def _matrix_sql(extended: bool) -> str:
    numbers = [*CORE_NUMBERS, *(["mod_duration", "convexity", "cds_5y"] if extended else [])]
    missing = f"({' OR '.join(f'{c} IS NULL' for c in numbers)}) AS missing_flag"
    cols = ", ".join(missing if c == "missing_flag" else f"round({c}, 6) AS {c}" if c in _ROUNDED else c for c in _columns(extended))
    return _MATRIX + f"SELECT {cols} FROM m WHERE data_asof_ok" + (f" AND (dm_em_flag = 'DM' OR dur_conv_coverage >= {MIN_SENSITIVITY_COVERAGE})" if extended else "")


_CTES = ("daily", "macro", "spine", "panel", "globals", "entities")


def feature_matrix(spark: SparkSession, d: str, extended: bool = False) -> DataFrame:
    """Every issuer on every quarter end: its bond's last readings of the quarter, macro and global figures known by then, guarded.

    Entities and calendar make the grid; bonds, coverage and macro are each reduced to one row per (series, quarter) before they are joined.
    """
    grid = cal.spine_by_entity(cal.quarter_spine(spark), o001_universe(spark, d))
    t = daily(spark, d, "zspread", "mod_durtn", "convexity", "int_cds")
    bonds = pit.resample_last(t, ["ric"], "date", ["zspread", "mod_durtn", "convexity", "int_cds"], "row_id")
    bonds = bonds.select(F.col("ric").alias("bond_ric"), "rebal_date", F.col("zspread").alias("yield_spread_bps"), F.col("mod_durtn").alias("mod_duration"), "convexity", F.col("int_cds").alias("cds_5y"))
    cover = bond_coverage(daily(spark, d, "clean_prc", "dirty_prc", "yldtomat", "mid_price", "mod_durtn", "convexity")).withColumnRenamed("ric", "bond_ric")
    wide = macro_wide(spark, d).withColumnRenamed("country", "name")
    m = grid.join(bonds, ["bond_ric", "rebal_date"], "left").join(cover, "bond_ric", "left").join(wide, ["name", "rebal_date"], "left")
    m = m.join(F.broadcast(_globals(spark, d)), "rebal_date", "left").withColumn("curve_slope", F.col("us_10y") - F.col("us_2y"))  # one row per date
    m = pn.guard_known(m, "asof_max_available_date", "rebal_date").withColumn("data_asof_ok", F.lit(True))
    if extended:
        m = m.filter((F.col("classification") == "DM") | (F.col("dur_conv_coverage") >= MIN_SENSITIVITY_COVERAGE))
    m = m.withColumns({"country_code": F.col("iso3"), "country_name": F.col("name"), "dm_em_flag": F.col("classification"), **{c: r6(c) for c in _ROUNDED}})
    return m.withColumn("missing_flag", any_missing([*CORE_NUMBERS, *(["mod_duration", "convexity", "cds_5y"] if extended else [])])).select(*_columns(extended))


@query(_matrix_sql(False), *_CTES)
def o022_feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    """O-22, O-23, O-29, O-31, O-32, O-34, O-38, O-48, O-49, O-63, O-64: the core feature matrix from raw series, facts and the universe."""
    return feature_matrix(spark, d)


@query(_matrix_sql(True), *_CTES)
def o035_extended_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The extended matrix: sensitivities and CDS as well, for developed issuers and those with enough of both."""
    return feature_matrix(spark, d, True)


@query("SELECT * FROM (" + _matrix_sql(False) + ") UNION ALL BY NAME SELECT *, 'extended' AS tier FROM (" + _matrix_sql(True) + ")", *_CTES)
def o099_stacked_matrices(spark: SparkSession, d: str) -> DataFrame:
    """O-99: both matrices as one bag, by name; columns that a part lacks are NULL."""
    return feature_matrix(spark, d).unionByName(feature_matrix(spark, d, True).withColumn("tier", F.lit("extended")), allowMissingColumns=True)


def _bond_quarters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Per bond and quarter price, momenta, spread z-score and CDS; and the daily best prices."""
    t = daily(spark, d, "dirty_prc", "clean_prc", "mid_price", "bid", "ask", "zspread", "int_cds")
    prices = cut_lineage(pn.best_price(t, ["ric"]).filter("price_field IS NOT NULL").select("ric", "date", "row_id", "price", "price_field", "zspread", "int_cds"))  # read four times
    q = pit.resample_last(prices, ["ric"], "date", ["price", "int_cds"], "row_id")
    field = prices.groupBy("ric").agg(F.max("price_field").alias("price_field_used"))
    spine = cal.spine_by_entity(cal.quarter_spine(spark), field.select("ric"))
    names = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(k).alias("days")) for n, k in pn.LOOKBACKS.items()))).alias("k")
    asked = q.filter("price IS NOT NULL").select("ric", "rebal_date", names).select("ric", "rebal_date", "k.name", F.date_sub("rebal_date", F.col("k.days")).alias("anchor"))
    past = pit.bounded_lookup(asked, prices, ["ric"], "anchor", "date", "price", pn.TOLERANCE_DAYS, "row_id")
    past = past.groupBy("ric", "rebal_date").agg(*(F.max(F.when(F.col("name") == n, F.col("price"))).alias(f"p_{n}") for n in pn.LOOKBACKS))
    z = pit.trailing_zscore(spine, prices, ["ric"], "rebal_date", "date", "zspread", 364).withColumnRenamed("zscore", "spread_zscore_52w")
    out = z.join(q, ["ric", "rebal_date"], "left").join(past, ["ric", "rebal_date"], "left").join(field, "ric")
    momenta = {n: r6(simple_return(F.col(f"p_{n}"), F.col("price"))) for n in pn.LOOKBACKS}
    return out.withColumns(momenta).withColumn("spread_zscore_52w", r6("spread_zscore_52w")).drop(*(f"p_{n}" for n in pn.LOOKBACKS)), prices


def return_panel(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The return panel of all emerging issuers with a price, and the daily best prices of their bonds."""
    bonds, prices = _bond_quarters(spark, d)
    core = feature_matrix(spark, d).filter("dm_em_flag = 'EM'").select("country_code", "country_name", "dm_em_flag", "rebal_date", *(c for c in RETURN_FEATURES if c in CORE_NUMBERS), "us_2y")
    rics = o001_universe(spark, d).select(F.col("iso3").alias("country_code"), F.col("bond_ric").alias("ric"))
    t = core.join(rics, "country_code").join(bonds, ["ric", "rebal_date"])
    ahead = bonds.select("ric", F.col("rebal_date").alias("target_period_end"), F.col("price").alias("price_t1"))
    t = t.join(F.broadcast(cal.with_next_date(cal.quarter_spine(spark)).withColumnRenamed("next_date", "target_period_end")), "rebal_date")  # the spine: 84 dates
    t = t.join(ahead, ["ric", "target_period_end"], "left").withColumnsRenamed({"price": "price_t", "int_cds": "cds_5y", "us_2y": "bill_yield_pct"})
    t = pn.carry_and_basis(t, "bill_yield_pct").withColumns({"carry": r6("carry"), "cds_bond_basis": r6("cds_bond_basis")})
    total = simple_return(F.col("price_t"), F.col("price_t1"))
    t = t.withColumns({"rf_quarterly": pn.quarterly_risk_free(F.col("bill_yield_pct")), "total_return_proxy": total, "has_income_component": F.col("price_field_used") == "dirty_prc"})
    t = pn.with_target(t.withColumn("excess_return", r6(F.col("total_return_proxy") - F.col("rf_quarterly"))))
    t = t.withColumns({"rf_quarterly": r6("rf_quarterly"), "total_return_proxy": r6("total_return_proxy")})
    cols = [
        "ric", "country_code", "country_name", "dm_em_flag", "rebal_date", "target_period_end", "price_field_used", "has_income_component", "cds_5y", *pn.LOOKBACKS, "spread_zscore_52w", "price_t", "price_t1", "bill_yield_pct",
        "rf_quarterly", "total_return_proxy", "excess_return", "excess_return_binary", "target_realized", *(c for c in RETURN_FEATURES if c in CORE_NUMBERS), "carry", "cds_bond_basis",
    ]
    return t.select(*cols), prices


_BEST = """b AS (SELECT ric, bool_or(dirty_prc IS NOT NULL) AS a, bool_or(clean_prc IS NOT NULL) AS b, bool_or(mid_price IS NOT NULL) AS c, bool_or(bid IS NOT NULL AND ask IS NOT NULL) AS e, bool_or(bid IS NOT NULL) AS f FROM daily GROUP BY ric),
bf AS (SELECT ric, CASE WHEN a THEN 'dirty_prc' WHEN b THEN 'clean_prc' WHEN c THEN 'mid_price' WHEN e THEN 'synthetic_mid' WHEN f THEN 'bid' END AS price_field FROM b),
p AS (SELECT d.ric, date, row_id, zspread, int_cds, price_field, CASE price_field WHEN 'dirty_prc' THEN dirty_prc WHEN 'clean_prc' THEN clean_prc WHEN 'mid_price' THEN mid_price WHEN 'synthetic_mid' THEN (bid + ask) / 2 WHEN 'bid' THEN bid END AS price FROM daily d JOIN bf ON bf.ric = d.ric WHERE price_field IS NOT NULL),
pq AS (SELECT ric, CAST({q} AS DATE) AS rebal_date, last(price ORDER BY date, row_id) FILTER (price IS NOT NULL) AS price, last(int_cds ORDER BY date, row_id) FILTER (int_cds IS NOT NULL) AS cds_5y FROM p GROUP BY ALL),
""".replace("{q}", QEND.format("date"))
_RETURNS = (
    "WITH "
    + _BEST
    + "f AS ("
    + _matrix_sql(False)
    + """),
x AS (SELECT f.*, u.bond_ric AS ric, k.price_field AS price_field_used, n.next_date AS target_period_end FROM f JOIN entities u ON u.iso3 = f.country_code JOIN (SELECT DISTINCT ric, price_field FROM p) k ON k.ric = u.bond_ric
JOIN (SELECT rebal_date, lead(rebal_date) OVER (ORDER BY rebal_date) AS next_date FROM spine) n ON n.rebal_date = f.rebal_date WHERE f.dm_em_flag = 'EM'),
"""
    + ", ".join(
        f"""{n} AS (SELECT x.ric, x.rebal_date, arg_max_null(p.price, p.date) FILTER (p.date IS NOT NULL) AS v FROM (SELECT DISTINCT ric, rebal_date FROM x) x LEFT JOIN p ON p.ric = x.ric AND p.date <= x.rebal_date - {k} AND p.date >= x.rebal_date - {k + pn.TOLERANCE_DAYS} GROUP BY ALL)"""
        for n, k in pn.LOOKBACKS.items()
    )
    + """, z AS (SELECT x.ric, x.rebal_date, CASE WHEN count(zspread) >= 10 AND stddev_samp(zspread) > 1e-9 THEN (arg_max(zspread, p.date) - avg(zspread)) / stddev_samp(zspread) END AS v FROM (SELECT DISTINCT ric, rebal_date FROM x) x LEFT JOIN p ON p.ric = x.ric AND p.date <= x.rebal_date AND p.date > x.rebal_date - 364 GROUP BY ALL),
r AS (SELECT x.ric, x.country_code, x.country_name, x.dm_em_flag, x.rebal_date, x.target_period_end, x.price_field_used, x.price_field_used = 'dirty_prc' AS has_income_component, a.cds_5y, """
    + ", ".join(f"round(CASE WHEN {n}.v <> 0 THEN a.price / {n}.v - 1 END, 6) AS {n}" for n in pn.LOOKBACKS)
    + """, round(z.v, 6) AS spread_zscore_52w, a.price AS price_t, c.price AS price_t1, x.us_2y AS bill_yield_pct, x.us_2y / 4 / 100 AS rf_quarterly, CASE WHEN a.price <> 0 THEN c.price / a.price - 1 END AS total_return_proxy, """
    + ", ".join(f"x.{c}" for c in RETURN_FEATURES if c in CORE_NUMBERS)
    + """, round(x.us_10y + x.yield_spread_bps / 100 - x.us_2y, 6) AS carry, round(a.cds_5y - x.yield_spread_bps, 6) AS cds_bond_basis
FROM x LEFT JOIN pq a ON a.ric = x.ric AND a.rebal_date = x.rebal_date LEFT JOIN pq c ON c.ric = x.ric AND c.rebal_date = x.target_period_end LEFT JOIN z ON z.ric = x.ric AND z.rebal_date = x.rebal_date """
    + " ".join(f"LEFT JOIN {n} ON {n}.ric = x.ric AND {n}.rebal_date = x.rebal_date" for n in pn.LOOKBACKS)
    + """), s AS (SELECT * REPLACE (round(rf_quarterly, 6) AS rf_quarterly, round(total_return_proxy, 6) AS total_return_proxy), round(total_return_proxy - rf_quarterly, 6) AS excess_return FROM r)
SELECT *, excess_return > 0 AS excess_return_binary, excess_return IS NOT NULL AS target_realized FROM s"""
)


@query(_RETURNS, *_CTES)
def o053_return_panel(spark: SparkSession, d: str) -> DataFrame:
    """O-24 to O-28, O-50, O-52 to O-56, O-66: momenta, z-score, carry, basis and the next quarter's excess return of every emerging issuer."""
    return return_panel(spark, d)[0]


def satellite(panel: DataFrame, labels: DataFrame) -> DataFrame:
    """O-39: the rows of emerging issuers that the walk-forward labels call satellite candidates on their date."""
    chosen = labels.filter(F.col("risk_label") == mo.TIERS[2]).select("country_code", "rebal_date").distinct()
    return panel.filter("dm_em_flag = 'EM'").join(chosen, ["country_code", "rebal_date"], "left_semi")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """Walk-forward labels and scores of the feature matrix, written once."""
    m = feature_matrix(spark, d).select("country_code", "rebal_date", *pn.CORE_FEATURES)
    return cut_lineage(mo.label_panel(m.withColumn("panel_id", F.xxhash64("country_code", "rebal_date")), list(pn.CORE_FEATURES)))


@query()
def o039_satellite_panel(spark: SparkSession, d: str) -> DataFrame:
    """O-39, O-139: the return panel of the satellite candidates, labelled from the feature matrix itself."""
    return satellite(return_panel(spark, d)[0], _labels(spark, d))


@query()
def o089_risk_score_windows(spark: SparkSession, d: str) -> DataFrame:
    """O-61, O-89, O-90, O-138: walk-forward risk scores of the four quarters before each downgrade against the four before those."""
    names = o001_universe(spark, d).select(F.col("iso3").alias("country_code"), F.col("name").alias("country_name"))
    scores = _labels(spark, d).join(names, "country_code").select("country_name", "rebal_date", "risk_score")
    downgrades = ratings(spark, d).filter("action = 'downgrade'").select("rating_id", F.translate("country", "_", " ").alias("country_name"), "date")
    return ev.event_windows(downgrades, scores, "rating_id", "country_name", "date", "rebal_date", "risk_score").withColumns({c: r6(c) for c in ("near_mean", "baseline_mean", "diff")})


def horizon_panel(panel: DataFrame, prices: DataFrame, days: int) -> DataFrame:
    """The rows of a return panel with the target of another horizon."""
    rows = panel.drop("target_period_end", "excess_return", "excess_return_binary", "target_realized").withColumn("target_period_end", F.date_add("rebal_date", days))
    found = pit.bounded_lookup(rows.select("ric", "target_period_end").distinct(), prices, ["ric"], "target_period_end", "date", "price", pn.TOLERANCE_DAYS, "row_id")
    t = rows.join(found.withColumnRenamed("price", "price_then"), ["ric", "target_period_end"], "left")
    risk_free = pn.horizon_risk_free(F.col("bill_yield_pct"), F.lit(days))
    return pn.with_target(t.withColumn("excess_return", pn.excess_return(F.col("price_t"), F.col("price_then"), risk_free)))


@query()
def o146_horizon_comparison(spark: SparkSession, d: str) -> DataFrame:
    """O-144, O-146: the model comparison at three horizons, a row per horizon, framing and model; the quarterly target is reused as it is."""
    panel, prices = return_panel(spark, d)
    base = cut_lineage(panel.withColumn("panel_id", F.xxhash64("country_code", "rebal_date")))
    out = None
    for name, days in pn.HORIZONS.items():
        part = compared(base if name == "quarterly" else horizon_panel(base, prices, days), RETURN_FEATURES).withColumn("horizon", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def o145_return_scores(spark: SparkSession, d: str) -> DataFrame:
    """O-140, O-141, O-145: walk-forward scores of the return panel by its fourteen features."""
    panel = return_panel(spark, d)[0].withColumn("panel_id", F.xxhash64("country_code", "rebal_date"))
    return mo.score_panel(panel, RETURN_FEATURES)


__all__ = ["feature_matrix", "horizon_panel", "return_panel", "satellite"]
