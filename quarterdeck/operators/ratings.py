"""Rating logs: cleaning, forward fill, two-source reconciliation, inferred actions."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import outlooks as o
from ..functions.ratings import rating_ordinal
from .sharded import scan


def clean(raw: DataFrame) -> DataFrame:
    """Rating, outlook and source of a raw log in canonical form; not-rated and short-term entries dropped."""
    keep = raw.filter(~o.is_token(F.col("rating"), o.NOT_RATED) & ~o.is_token(F.col("rating"), o.SHORT_TERM))
    return (
        keep.withColumn("_rating", o.letters_of(F.col("rating")))
        .withColumn("outlook", o.outlook_of(F.col("rating"), F.col("outlook")))
        .withColumn("source", o.provenance(F.col("source"), F.col("rating")))
        .withColumn("rating", F.col("_rating")).drop("_rating")
    )


def forward_fill(log: DataFrame, keys: list[str], order: list[str], column: str = "rating") -> DataFrame:
    """Blank cells take the last value before them within their key; leading blanks are dropped."""
    rows = scan(log, keys, [F.col(c) for c in order], filled={"_last": F.col(column)})
    return rows.withColumn(column, F.coalesce(column, "_last")).drop("_last").filter(F.col(column).isNotNull())


def infer_actions(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``log`` with blank actions inferred; a lower number is a better rating."""
    explicit, outlook = o.stripped(F.col("action")), o.stripped(F.col("outlook"))
    rows = scan(log, keys, [F.col(c) for c in order], "_n", {"_prev": F.col("rating_numeric")}, {"_po": outlook})
    number = F.col("rating_numeric")
    action = (
        F.when(explicit.isNotNull(), explicit).when((F.col("_n") == 1) | F.col("_prev").isNull(), "initial").when(number < F.col("_prev"), "upgrade")
        .when(number > F.col("_prev"), "downgrade").when(outlook.isNotNull() & F.col("_po").isNotNull() & (outlook != F.col("_po")), "outlook_change").otherwise("affirm")
    )
    return rows.withColumn("inferred_action", action).drop("_prev", "_n", "_po")


def apply_corrections(log: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log with known wrong ratings replaced, and the corrections that match no row (which should be none)."""
    on = ["agency", "date"]
    hit = log.join(corrections.select(*on, F.trim("wrong_rating").alias("_wrong"), F.col("corrected_rating").alias("_right")), [*on], "left")
    right = F.when(F.trim("rating") == F.col("_wrong"), F.col("_right"))
    fixed = hit.withColumn("rating", F.coalesce(right, F.col("rating"))).drop("_wrong", "_right")
    stale = corrections.select(*on, F.trim("wrong_rating").alias("wrong_rating"), "corrected_rating").join(log.select(*on, F.trim("rating").alias("wrong_rating")), [*on, "wrong_rating"], "left_anti")
    return fixed, stale


def corrected(log: DataFrame, corrections: DataFrame) -> DataFrame:
    """The log with known wrong ratings replaced; a correction that matches no row is an error when the log is read."""
    fixed, stale = apply_corrections(log, corrections)
    some = stale.agg(F.count(F.lit(1)).alias("_stale"), F.max(F.concat_ws(" ", "agency", "date", "wrong_rating")).alias("_which"))
    message = F.concat(F.lit("stale or mistyped correction: "), F.col("_which"))
    checked = fixed.crossJoin(F.broadcast(some))  # one row
    return checked.withColumn("rating", F.when(F.col("_stale") > 0, F.raise_error(message).cast("string")).otherwise(F.col("rating"))).drop("_stale", "_which")


def match_bucket(primary: list[tuple], secondary: list[tuple]) -> list[tuple[str, int | None, int | None]]:
    """Greedy one-to-one matching of one bucket's rows, (ordinal, ties) in date order, as positions.

    Each primary row takes the first free secondary row of equal ordinal and agreeing outlook.  What is left on both
    sides is paired by position as a conflict; what is left on one side stands alone.  Secondary rows alike in both wait in
    one queue, so a primary row looks at kinds of rows and not at rows.
    """
    queues: dict = {}
    for i, (ordinal, ties) in enumerate(secondary):
        queues.setdefault(ordinal, {}).setdefault(ties, deque()).append(i)
    out, taken, alone = [], set(), []
    for i, (ordinal, ties) in enumerate(primary):
        fits = [(q[0], q) for other, q in queues.get(ordinal, {}).items() if q and (not ties or not other or ties & other)]
        if not fits:
            alone.append(i)
            continue
        _, queue = min(fits, key=lambda f: f[0])
        taken.add(queue[0])
        out.append(("matched", i, queue.popleft()))
    rest = [i for i in range(len(secondary)) if i not in taken]
    n = min(len(alone), len(rest))
    out += [("conflict", p, s) for p, s in zip(alone[:n], rest[:n])]
    return out + [("primary_only", p, None) for p in alone[n:]] + [("secondary_only", None, s) for s in rest[n:]]


_PAIR = T.StructType([T.StructField("status", T.StringType()), T.StructField("p", T.IntegerType()), T.StructField("s", T.IntegerType())])


def _matched(buckets: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The pairs of buckets whose rows have side, ordinal and ties, the primary side first and both in date order."""
    for rows in buckets:
        out = []
        for bucket in rows:
            sides: tuple[list, list] = ([], [])
            for r in bucket:
                sides[r["side"]].append((r["ordinal"], frozenset(r["ties"])))
            first = len(sides[0])
            out.append([{"status": k, "p": p, "s": None if s is None else first + s} for k, p, s in match_bucket(*sides)])
        yield pd.Series(out)


_SIDE = ("row_id", "date", "rating", "outlook", "source")


def reconcile(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Per country, agency and month the pairs of both sources: ``country, agency, month, status`` and both rows, ``p`` and ``s``.

    Status: matched, conflict, primary_only, secondary_only.  Rows have ``row_id, country, agency, date, rating, outlook, source``.  Ordinals and what
    outlooks can agree by are columns; exact copies within a source are dropped first (map-side), so a bucket holds the distinct actions of one
    month, however often each was noted.  The greedy match depends on order (agreement isn't transitive), so a bucket is matched as one
    list, many buckets to an Arrow batch; rows stay where they are, only positions come back.
    """
    keys = ["country", "agency", "date", "rating", "outlook"]
    both = primary.select(*keys, "row_id", "source", F.lit(0).alias("side")).unionByName(secondary.select(*keys, "row_id", "source", F.lit(1).alias("side")))
    distinct = both.groupBy(*keys, "side").agg(F.min(F.struct("row_id", "source")).alias("f"))
    row = F.struct("side", "date", F.col("f.row_id").alias("row_id"), "rating", "outlook", F.col("f.source").alias("source"), rating_ordinal(F.col("rating")).alias("ordinal"), o.agreement_ties(F.col("outlook")).alias("ties"))
    lists = distinct.groupBy("country", "agency", F.trunc("date", "month").alias("month")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    slim = F.transform("rows", lambda r: F.struct(r["side"].alias("side"), r["ordinal"].alias("ordinal"), r["ties"].alias("ties")))
    pairs = lists.withColumn("m", F.pandas_udf(_matched, T.ArrayType(_PAIR))(slim)).select("country", "agency", "month", "rows", F.explode("m").alias("m"))

    def side(at: str) -> Column:
        r = F.element_at("rows", F.col(f"m.{at}") + 1)
        return F.when(F.col(f"m.{at}").isNotNull(), F.struct(*(r[c].alias(c) for c in _SIDE))).alias(at)

    return pairs.select("country", "agency", "month", F.col("m.status").alias("status"), side("p"), side("s"))


def adjudicated(pairs: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The conflicts with the first resolution (by ``entry``) of the same agency and dates.

    Adds ``resolution`` (resolved or OPEN), ``chosen_source`` and ``note``; resolutions have ``agency, p_date, s_date, chosen_source, note, entry``.
    """
    first = resolutions.groupBy("agency", "p_date", "s_date").agg(F.min_by(F.struct("chosen_source", "note"), "entry").alias("_r"))
    conflicts = pairs.filter("status = 'conflict'").withColumns({"p_date": F.col("p.date"), "s_date": F.col("s.date")})
    return conflicts.join(first, ["agency", "p_date", "s_date"], "left").select(
        *pairs.columns, F.when(F.col("_r").isNull(), "OPEN").otherwise("resolved").alias("resolution"),
        F.upper(F.trim("_r.chosen_source")).alias("chosen_source"), F.col("_r.note").alias("note"),
    )


def merged(pairs: DataFrame, defaults: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The reconciled log ``country, agency, date, rating, outlook, source``: default designations of the second source, matched rows by
    the second source with the preferred outlook, single rows as they are, and resolved conflicts by the chosen source; open ones are left out.
    """
    p, s = F.col("p"), F.col("s")

    def rows(df: DataFrame, row: Column, outlook: Column, source: Column) -> DataFrame:
        return df.select("country", "agency", row["date"].alias("date"), row["rating"].alias("rating"), outlook.alias("outlook"), source.alias("source"))

    confirmed = F.concat(s["source"], F.lit(" (confirmed by "), p["source"], F.lit(")"))
    matched = rows(pairs.filter("status = 'matched'"), s, o.preferred_outlook(s["outlook"], p["outlook"]), confirmed)
    alone = F.coalesce(p, s)
    single = rows(pairs.filter("status IN ('primary_only', 'secondary_only')"), alone, alone["outlook"], alone["source"])
    settled = adjudicated(pairs, resolutions).filter("resolution = 'resolved'")
    winner = F.when(F.col("chosen_source") == "CE", s).otherwise(p)
    resolved = rows(settled, winner, winner["outlook"], F.concat(winner["source"], F.lit(" (conflict resolved: "), F.coalesce("note", F.lit("")), F.lit(")")))
    note = F.concat("source", F.lit(" (default designation; omitted by the other source)"))
    return defaults.select("country", "agency", "date", "rating", "outlook", note.alias("source")).unionByName(matched).unionByName(single).unionByName(resolved)


def single_sourced(source: Column) -> Column:
    """Seen by one source alone: neither confirmed nor adjudicated."""
    return ~F.coalesce(source.contains("confirmed by") | source.contains("conflict resolved"), F.lit(False))


def month_precision(source: Column) -> Column:
    return source.contains("(month-precision)") & ~source.contains("confirmed by")
