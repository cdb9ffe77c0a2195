"""Ordered scans and ranks that no hot key can stall: ranges of the whole order, with their states carried over.

A window over a key sorts all rows of the key in one task.  Here rows are cut into ranges of (key, order) instead, each small
whatever the keys hold: rows are range-partitioned, written once with their range's number, scanned within their range, and
what a range must know of those before it in the same key (counts, last values) is a scan over one short row per range and key.
Where no key holds more rows than ``PLAIN_ROWS``, which one count per key tells, the plain window gives the same result with one
shuffle, and is used.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_width, written

#: Rows of a key that one task may sort, and the estimated bytes of a whole input below which keys aren't even counted.
PLAIN_ROWS, PLAIN_BYTES = 1_000_000, 64 << 20


def largest_key(df: DataFrame, keys: list[str]) -> int:
    """Rows of the key that has most."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def _hot(df: DataFrame, keys: list[str], most: int) -> bool:
    """Whether some key holds more than ``most`` rows; the planner's estimate of the input's size spares small inputs the count."""
    if most >= PLAIN_ROWS and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= PLAIN_BYTES:
        return False
    return largest_key(df, keys) > most


def hot_keys(df: DataFrame, key: str, most: int = PLAIN_ROWS) -> DataFrame | None:
    """The keys that hold more than ``most`` rows, None if there are none; small inputs aren't counted (see ``PLAIN_BYTES``)."""
    if not _hot(df, [key], most):
        return None
    return cut_lineage(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(key))


def ranged(df: DataFrame, keys: list[str], order: list[Column], range_rows: int) -> DataFrame:
    """``df`` written with ``_range``, the number of its range of (keys, order): numbers rise with the order, ranges are of like size."""
    many = max(shuffle_width(df.sparkSession), -(-df.count() // range_rows))
    return written(df.repartitionByRange(many, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def scan(df: DataFrame, keys: list[str], order: list[Column], number: str | None = None, before: dict[str, Column] | None = None, filled: dict[str, Column] | None = None, total: str | None = None, most: int = PLAIN_ROWS) -> DataFrame:
    """``df`` with columns of an ordered scan per key.

    ``number``: the row's place in its key, from 1; ``total``: the key's rows; ``before``: per name the value of an expression in the previous row;
    ``filled``: per name the last value of an expression that isn't NULL, in the rows before this one.  NULL is a key like any other; the order
    is upwards, NULLs first, and must be total.
    """
    before, filled, given = before or {}, filled or {}, df.columns
    df = df.withColumns({f"_b{i}": c for i, c in enumerate(before.values())} | {f"_f{i}": c for i, c in enumerate(filled.values())})
    hot = _hot(df, keys, most)
    part = [*keys, "_range"] if hot else keys
    rows = ranged(df, keys, order, most) if hot else df
    w = Window.partitionBy(*part).orderBy(*order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    new = {"_n": F.row_number().over(w)}
    new |= {f"_pb{i}": F.lag(f"_b{i}").over(w) for i in range(len(before))} | {f"_pf{i}": F.last(f"_f{i}", ignorenulls=True).over(past) for i in range(len(filled))}
    out = rows.withColumns(new)
    if hot:
        # One row per range and key: what it holds, and its last row's values.
        last = F.struct(*order)
        ends = rows.groupBy(*part).agg(
            F.count(F.lit(1)).alias("_c"), *(F.max_by(F.col(f"_b{i}"), last).alias(f"_eb{i}") for i in range(len(before))),
            *(F.max_by(F.col(f"_f{i}"), F.when(F.col(f"_f{i}").isNotNull(), last)).alias(f"_ef{i}") for i in range(len(filled))),
        )
        over = Window.partitionBy(*keys).orderBy("_range")
        earlier = over.rowsBetween(Window.unboundedPreceding, -1)
        states = ends.select(
            *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_off"),
            F.sum("_c").over(Window.partitionBy(*keys)).alias("_total"), *(F.lag(f"_eb{i}").over(over).alias(f"_sb{i}") for i in range(len(before))),
            *(F.last(f"_ef{i}", ignorenulls=True).over(earlier).alias(f"_sf{i}") for i in range(len(filled))),
        )
        on = F.col("_range") == F.col("_r")
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        out = out.join(states, on)  # a short row per range and key: AQE broadcasts it by its size
        first = F.col("_n") == 1
        out = out.withColumns({f"_pb{i}": F.when(first, F.col(f"_sb{i}")).otherwise(F.col(f"_pb{i}")) for i in range(len(before))})
        out = out.withColumns({f"_pf{i}": F.coalesce(f"_pf{i}", f"_sf{i}") for i in range(len(filled))}).withColumn("_n", (F.col("_n") + F.col("_off")).cast("bigint"))
    elif total:
        out = out.withColumn("_total", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return out.select(
        *given, *([F.col("_n").cast("int").alias(number)] if number else []), *([F.col("_total").cast("bigint").alias(total)] if total else []),
        *(F.col(f"_pb{i}").alias(n) for i, n in enumerate(before)), *(F.col(f"_pf{i}").alias(n) for i, n in enumerate(filled)),
    )


def share_of(number: Column, total: Column, parts: int | Column) -> Column:
    """The part of ``parts`` parts of like size (the first ones larger) that the row of a number falls into, from 1."""
    small, larger = F.floor(total / parts), total % parts
    cut = larger * (small + 1)
    place = number - 1
    return F.when(place < cut, F.floor(place / (small + 1)) + 1).otherwise(larger + F.floor((place - cut) / F.greatest(small, F.lit(1))) + 1).cast("int")


def running_counts(counts: DataFrame, keys: list[str], value: str, n: str, most: int = PLAIN_ROWS) -> DataFrame:
    """``counts`` (one row per key and value) with ``below``: the sum of ``n`` over the key's smaller values."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    if not _hot(counts, keys, most):
        return counts.withColumn("below", F.coalesce(F.sum(n).over(w), F.lit(0)))
    rows = ranged(counts, keys, [F.col(value)], most)
    part = [*keys, "_range"]
    inside = F.coalesce(F.sum(n).over(Window.partitionBy(*part).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = rows.groupBy(*part).agg(F.sum(n).alias("_c"))
    over = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    states = ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), F.coalesce(F.sum("_c").over(over), F.lit(0)).alias("_off"))
    on = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.withColumn("_in", inside).join(states, on).withColumn("below", F.col("_in") + F.col("_off")).select(*counts.columns, "below")


def prefix_medians(df: DataFrame, known: str, columns: list[str], untils: list[int]) -> np.ndarray:
    """Exact medians of every column over the rows known by each of the days ``untils``: an array of (until, column), NaN without values.

    (column, value, day) counts are range-partitioned by column and value; counts per range and day tell in which range a median lies,
    and only those ranges are looked into. The driver gets a count per range and day, and the medians.
    """
    out = np.full((len(untils), len(columns)), np.nan)
    cell = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)))).alias("c")
    cells = df.select(F.col(known).alias("day"), cell).select("c.f", "c.v", "day").filter(F.col("v").isNotNull() & ~F.isnan("v") & F.col("day").isNotNull())
    counts = cells.groupBy("f", "v", "day").agg(F.count(F.lit(1)).alias("n"))
    rows = written(counts.repartitionByRange(4 * shuffle_width(df.sparkSession), "f", "v").withColumn("_range", F.spark_partition_id()), "medians")
    per = rows.groupBy("f", "_range", "day").agg(F.sum("n").alias("n")).toPandas()  # ranges x calendar
    wanted: dict[int, list[tuple[int, int, int, int]]] = {}
    for f, g in per.groupby("f"):
        parts = np.sort(g["_range"].unique())
        for t, until in enumerate(untils):
            known_by = g[g["day"] <= until]
            ends = known_by.groupby("_range")["n"].sum().reindex(parts, fill_value=0).to_numpy().cumsum()
            n = int(ends[-1])
            for rank in {(n - 1) // 2, n // 2} if n else ():
                i = int(np.searchsorted(ends, rank, side="right"))
                wanted.setdefault(int(parts[i]), []).append((int(f), t, until, rank - int(ends[i - 1] if i else 0)))
    if not wanted:
        return out

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        found, ordered = [], {f: g.sort_values("v") for f, g in pdf.groupby("f")}
        for f, t, until, rank in wanted[int(pdf["_range"].iloc[0])]:
            g = ordered[f]
            mine = g["day"].to_numpy() <= until
            ends = g["n"].to_numpy()[mine].cumsum()
            found.append((f, t, float(g["v"].to_numpy()[mine][np.searchsorted(ends, rank, side="right")])))
        return pd.DataFrame(found, columns=["f", "t", "v"])

    picked = rows.filter(F.col("_range").isin(list(wanted))).groupBy("_range").applyInPandas(pick, "f int, t int, v double").toPandas()
    for (f, t), v in picked.groupby(["f", "t"])["v"].mean().items():
        out[t, f] = v
    return out


def medians(df: DataFrame, columns: list[str]) -> list[float | None]:
    """Exact medians of whole columns, None without values."""
    found = prefix_medians(df.select(F.lit(0).alias("_day"), *columns), "_day", columns, [0])[0]
    return [None if np.isnan(v) else float(v) for v in found]
