"""Filling cells without an observation by sequential hot-deck.

Similar records are sorted by date within their issuer.  Donors are first reduced
to one per issuer and date (map-side), so the ordered scans run over the calendar
of an issuer and not over its rows.  A cell takes the nearest observed donor of the
same issuer (the earlier one at equal distance); where the issuer has none, the
donor of the same kind and the nearest date; else the donor of the nearest date
of the whole panel.
Every filled cell carries its donor's row and the distance in days.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What stands in a cell that holds no observation.
NUMERIC_PLACEHOLDERS = {
    "yield_spread_bps": (-9999.0, -999.0, 99999.0),
    "fx_reserves_mo": (-99.0, -1.0, 999.9),
    "cds_5y": (-999.0, -1.0, 88888.0),
}
TEXT_PLACEHOLDERS = ("", "-", "--", "?", ".", "n/a", "na", "n.a.", "nan", "none", "null", "nil", "unknown", "missing", "tbd")
FIELDS = ("yield_spread_bps", "fx_reserves_mo", "cds_5y", "coverage_tier")


def holds_number(value: Column, placeholders=()) -> Column:
    """True where a number was observed; a zero is an observation. Never NULL."""
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    if placeholders:
        ok = ok & ~value.isin(*placeholders)
    return F.coalesce(ok, F.lit(False))


def holds_text(value: Column, placeholders=TEXT_PLACEHOLDERS) -> Column:
    """True where a text states something. Never NULL."""
    return F.coalesce(~F.lower(F.regexp_replace(value, r"^\s+|\s+$", "")).isin(*placeholders), F.lit(False))


def cell_flags(fields=FIELDS, numeric_placeholders=NUMERIC_PLACEHOLDERS) -> dict[str, Column]:
    """Per field, whether its cell holds an observation."""
    return {
        f: holds_number(F.col(f).cast("double"), numeric_placeholders[f]) if f in numeric_placeholders else holds_text(F.col(f))
        for f in fields
    }


def _nearest(donors: DataFrame, keys: list[str], fields) -> DataFrame:
    """Per key and date of ``donors``, the previous-or-same and the next-or-same donor of each field."""
    w = Window.partitionBy(*keys).orderBy("date")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    out = donors
    for f in fields:
        out = out.withColumn(f"prev_{f}", F.last(f"donor_{f}", ignorenulls=True).over(back))
        out = out.withColumn(f"next_{f}", F.first(f"donor_{f}", ignorenulls=True).over(ahead))
    picks = []
    for f in fields:
        p, n = F.col(f"prev_{f}"), F.col(f"next_{f}")
        near = F.when(n.isNull() | (F.datediff("date", p["date"]) <= F.datediff(n["date"], F.col("date"))), p).otherwise(n)
        picks.append(near.alias(f"near_{f}"))
    return out.select(*keys, "date", *picks)


def _donors(rows: DataFrame, keys: list[str], fields) -> DataFrame:
    """One row per key and date, with the observed cell of the smallest row id as donor of each field."""
    return rows.groupBy(*keys, "date").agg(
        *(F.min(F.when(F.col(f"ok_{f}"), F.struct("id", "date", F.col(f).alias("value")))).alias(f"donor_{f}") for f in fields)
    )


def hot_deck(
    df: DataFrame,
    row_id: str = "panel_id",
    group: str = "country_code",
    kind: str = "dm_em_flag",
    date: str = "rebal_date",
    fields=FIELDS,
    numeric_placeholders=NUMERIC_PLACEHOLDERS,
) -> DataFrame:
    """The panel with each field filled: ``row_id, group, date`` and, per field, the value,
    ``<field>_filled``, ``<field>_donor`` (row id) and ``<field>_distance`` (days).

    A cell is filled where a donor was found; it stays NULL and unfilled only if no row of the whole
    panel observes the field.  A NULL group or kind is a group of its own; a NULL date lies before all dates, and a donor
    or cell without a date has a NULL distance.  Repeated rows are filled alike.  Empty tables stay
    empty; other columns are ignored.
    """
    rows = df.select(
        F.col(row_id).alias("id"), F.col(group).alias("grp"), F.col(kind).alias("kind"), F.col(date).cast("date").alias("date"),
        *(F.col(f) for f in fields), *(c.alias(f"ok_{f}") for f, c in cell_flags(fields, numeric_placeholders).items()),
    )
    by_group = _donors(rows, ["grp"], fields)
    kinds = _donors(rows, ["kind"], fields)
    near_group, near_kind = _nearest(by_group, ["grp"], fields), _nearest(kinds, ["kind"], fields)
    all_dates = kinds.groupBy("date").agg(*(F.min(f"donor_{f}").alias(f"donor_{f}") for f in fields)).withColumn("all", F.lit(1))
    near_all = _nearest(all_dates, ["all"], fields).drop("all")

    def prefixed(t: DataFrame, p: str, key: str | None) -> DataFrame:
        names = {"date": f"{p}_date"} | ({key: f"{p}_key"} if key else {})
        return t.select(*(F.col(c).alias(names.get(c, f"{p}_{c}")) for c in t.columns))

    a, b, c = prefixed(near_group, "g", "grp"), prefixed(near_kind, "k", "kind"), prefixed(near_all, "a", None)
    joined = (
        rows.join(a, F.col("grp").eqNullSafe(F.col("g_key")) & F.col("date").eqNullSafe(F.col("g_date")), "left")
        .join(b, F.col("kind").eqNullSafe(F.col("k_key")) & F.col("date").eqNullSafe(F.col("k_date")), "left")
        .join(c, F.col("date").eqNullSafe(F.col("a_date")), "left")
    )
    out = [F.col("id").alias(row_id), F.col("grp").alias(group), F.col("date").alias(date)]
    for f in fields:
        donor = F.coalesce(F.col(f"g_near_{f}"), F.col(f"k_near_{f}"), F.col(f"a_near_{f}"))
        out += [
            F.when(F.col(f"ok_{f}"), F.col(f)).otherwise(donor["value"]).alias(f),
            (~F.col(f"ok_{f}") & donor["id"].isNotNull()).alias(f"{f}_filled"),
            F.when(~F.col(f"ok_{f}"), donor["id"]).alias(f"{f}_donor"),
            F.when(~F.col(f"ok_{f}"), F.abs(F.datediff("date", donor["date"]))).alias(f"{f}_distance"),
        ]
    return joined.select(*out)


def filled_cells(panel: DataFrame, row_id: str = "panel_id", fields=FIELDS) -> DataFrame:
    """The marks of :func:`hot_deck`, one row per cell that took a donor's value."""
    marks = F.array(*(F.when(F.col(f"{f}_filled"), F.lit(f)) for f in fields))
    return panel.select(row_id, F.explode(F.array_compact(marks)).alias("field_name"))
