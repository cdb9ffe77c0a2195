"""Panel construction: features per entity and quarter, guards, targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import simple_return

MACRO_FEATURES = ("debt_gdp", "fiscal_bal_gdp", "current_acct_gdp", "fx_reserves_mo", "cpi_inflation", "real_gdp_growth", "political_stability")
GLOBAL_FEATURES = ("us_10y", "us_2y", "vix", "dxy_proxy")
CORE_FEATURES = ("yield_spread_bps", *MACRO_FEATURES, "us_10y", "curve_slope")
PRICE_PRIORITY = ("dirty_prc", "clean_prc", "mid_price", "synthetic_mid", "bid")
HORIZONS = {"monthly": 30, "quarterly": 91, "semi_annual": 182}
LOOKBACKS = {"mom_1m": 30, "mom_3m": 91, "mom_12m": 365}
TOLERANCE_DAYS = 10


def coverage_tier(has: dict[str, Column]) -> Column:
    """Tier by which fields an entity's series has at all."""
    both = has["clean_prc"] & has["dirty_prc"]
    return F.when(both & has["yldtomat"], "full_dm").when(both, "dm_standard").when(has["mid_price"], "em_standard").otherwise("em_minimal")


def field_presence(daily: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Per entity, whether each field holds any value: ``has_<field>``."""
    return daily.groupBy(*keys).agg(*(F.max(F.col(f).isNotNull()).alias(f"has_{f}") for f in fields))


def best_price(daily: DataFrame, keys: list[str], priority=PRICE_PRIORITY) -> DataFrame:
    """``daily`` with ``price`` and ``price_field``: the first field in order of priority that the *entity* has any value of.

    ``synthetic_mid`` is the mean of bid and ask.  The choice is made per entity, not per row.
    """
    rows = daily.withColumn("synthetic_mid", (F.col("bid") + F.col("ask")) / 2)
    has = field_presence(rows, keys, list(priority))
    field = reduce(lambda other, f: F.when(F.col(f"has_{f}"), F.lit(f)).otherwise(other), reversed(priority), F.lit(None).cast("string"))
    chosen = has.select(*keys, field.alias("price_field"))
    price = F.coalesce(*(F.when(F.col("price_field") == f, F.col(f)) for f in priority))
    return rows.join(chosen, keys, "left").withColumn("price", price)


def guard_known(panel: DataFrame, available: str, asof: str) -> DataFrame:
    """Rows whose newest input was available on their date; no input at all counts as known."""
    return panel.filter(F.col(available).isNull() | (F.col(available) <= F.col(asof)))


def carry_and_basis(panel: DataFrame, bill: str = "tbill") -> DataFrame:
    """``carry`` (per cent) and ``cds_bond_basis`` (basis points)."""
    return panel.withColumn("carry", F.col("us_10y") + F.col("yield_spread_bps") / 100 - F.col(bill)).withColumn(
        "cds_bond_basis", F.col("cds_5y") - F.col("yield_spread_bps")
    )


def quarterly_risk_free(percent: Column) -> Column:
    return percent / 4 / 100


def horizon_risk_free(percent: Column, days: Column) -> Column:
    return percent / 100 * days / 365


def excess_return(before: Column, after: Column, risk_free: Column) -> Column:
    """Simple return less the risk-free return; NULL if any part is."""
    return simple_return(before, after) - risk_free


def with_target(panel: DataFrame, excess: str = "excess_return") -> DataFrame:
    """``excess_return_binary`` (NULL where unknown) and ``target_realized``."""
    return panel.withColumn("excess_return_binary", F.col(excess) > 0).withColumn("target_realized", F.col(excess).isNotNull())
