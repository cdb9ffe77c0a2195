"""Queries of the rating logs, event windows, data quality, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import outlooks as o
from ..functions.ratings import RATING_ORDINALS, rating_ordinal
from ..operators import events as ev
from ..operators import quality as qu
from ..operators import ratings as ra
from ..operators import selection as se
from ..operators.pit import first_by
from ..operators.sharded import scan, share_of
from ..session import cut_lineage, load, place
from ..sources import files as fs
from .base import CTES, daily, macro, panel, query, r6, ratings, raw_log, signals

ORDER = ["date", "rating_numeric", "rating_id"]
KEYS = ["country", "agency"]
_W = "PARTITION BY country, agency ORDER BY date, rating_numeric, rating_id"
_MAP = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in RATING_ORDINALS.items()) + ") m(letters, ordinal)"

# SQL of the cleaning rules, step by step.
_BARE = "nullif(trim(rating), '')"
_PLAIN = f"trim(regexp_replace({_BARE}, '^\\(P\\)\\s*', '', 'i'))"
_LETTERS = f"nullif(trim(CASE WHEN regexp_matches({_PLAIN}, '^(.*?)\\s*\\(([^)]+)\\)\\s*$') THEN regexp_extract({_PLAIN}, '^(.*?)\\s*\\(([^)]+)\\)\\s*$', 1) ELSE {_PLAIN} END), '')"
_OUTLOOK = f"coalesce(nullif(trim(outlook), ''), nullif(trim(regexp_extract({_PLAIN}, '^(.*?)\\s*\\(([^)]+)\\)\\s*$', 2)), ''))"
_CLEAN = f"""SELECT raw_id, country, agency, date, {_LETTERS} AS rating, {_OUTLOOK} AS outlook,
    CASE WHEN regexp_matches({_BARE}, '^\\(P\\)\\s*.+$', 'i') THEN trim(coalesce(source, '') || ' (provisional)') ELSE source END AS source
    FROM rawlog WHERE coalesce(upper(trim(rating)) NOT IN ('NR', 'NP', 'P-1', 'P-2', 'P-3', 'P1', 'P2', 'P3'), true)"""


@query(_CLEAN, "rawlog")
def o109_clean_log(spark: SparkSession, d: str) -> DataFrame:
    """O-43, O-106, O-109, O-110: not-rated and short-term rows dropped, embedded outlooks and provisional prefixes taken apart."""
    return ra.clean(raw_log(spark, d)).select("raw_id", "country", "agency", "date", "rating", "outlook", "source")


@query(
    """SELECT outlook, trim(regexp_replace(regexp_replace(outlook, '\\b(under\\s+review|watch|review)\\b', '', 'gi'), '\\s+', ' ', 'g')) AS base, CASE WHEN upper(trim(outlook)) <> 'NR' THEN nullif(trim(outlook), '') END AS normal,
    coalesce(contains(lower(outlook), 'watch') OR contains(lower(outlook), 'review'), false) AS watched, count(*) AS n FROM rating_raw GROUP BY ALL"""
)
def o111_outlooks(spark: SparkSession, d: str) -> DataFrame:
    """O-107, O-111, O-112: outlook without qualifier, normal form, watch flag."""
    c = F.col("outlook")
    return load(spark, d, "rating_raw").groupBy("outlook").agg(F.count(F.lit(1)).alias("n")).select("outlook", o.base_direction(c).alias("base"), o.normal_outlook(c).alias("normal"), o.on_watch(c).alias("watched"), "n")


_NEXT_SQL = """WITH x AS (SELECT raw_id, outlook, lag(outlook) OVER (PARTITION BY country, agency ORDER BY date, raw_id) AS before FROM rawlog),
n AS (SELECT *, CASE WHEN upper(trim(outlook)) <> 'NR' THEN nullif(trim(outlook), '') END AS v, CASE WHEN upper(trim(before)) <> 'NR' THEN nullif(trim(before), '') END AS u FROM x),
k AS (SELECT *, coalesce(contains(lower(v), 'watch') OR contains(lower(v), 'review'), false) AS wv, coalesce(contains(lower(u), 'watch') OR contains(lower(u), 'review'), false) AS wu,
trim(regexp_replace(regexp_replace(lower(v), '\\b(under\\s+review|watch|review)\\b', '', 'gi'), '\\s+', ' ', 'g')) AS bv, trim(regexp_replace(regexp_replace(lower(u), '\\b(under\\s+review|watch|review)\\b', '', 'gi'), '\\s+', ' ', 'g')) AS bu FROM n)
SELECT raw_id, before AS first, outlook AS second, coalesce(u IS NULL OR v IS NULL OR lower(u) = lower(v) OR (wu AND wv) OR (bu <> '' AND bu = bv), true) AS agree, CASE WHEN wv AND NOT wu THEN v ELSE coalesce(u, v) END AS preferred FROM k"""


@query(_NEXT_SQL, "rawlog")
def o113_outlook_pairs(spark: SparkSession, d: str) -> DataFrame:
    """O-113, O-114: agreement and preference of every outlook with the one noted before it."""
    log = raw_log(spark, d).select("raw_id", *KEYS, "date", "outlook")
    pairs = scan(log, KEYS, [F.col("date"), F.col("raw_id")], before={"first": F.col("outlook")}).withColumnRenamed("outlook", "second")
    a, b = F.col("first"), F.col("second")
    return pairs.select("raw_id", "first", "second", o.outlooks_agree(a, b).alias("agree"), o.preferred_outlook(a, b).alias("preferred"))


@query(f"SELECT r.rating_id, r.rating, m.ordinal AS ordinal, r.rating_numeric, replace(r.country, '_', ' ') AS country_name FROM rating_panel r LEFT JOIN {_MAP} ON m.letters = trim(r.rating)")
def o117_rating_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """O-62, O-116, O-117: letters to ordinals, names normalised."""
    return load(spark, d, "rating_panel").select("rating_id", "rating", rating_ordinal(F.col("rating")).alias("ordinal"), "rating_numeric", F.translate("country", "_", " ").alias("country_name"))


@query(
    f"""WITH c AS ({_CLEAN}), f AS (SELECT country, agency, date, raw_id, last_value(rating IGNORE NULLS) OVER (PARTITION BY country, agency ORDER BY date, raw_id ROWS UNBOUNDED PRECEDING) AS rating, outlook FROM c) SELECT * FROM f WHERE rating IS NOT NULL""",
    "rawlog",
)
def o088_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    """O-88: blank ratings take the last one before them; leading blanks dropped."""
    return ra.forward_fill(ra.clean(raw_log(spark, d)), KEYS, ["date", "raw_id"]).select("country", "agency", "date", "raw_id", "rating", "outlook")


@query(
    f"""WITH x AS (SELECT *, nullif(trim(outlook), '') AS o FROM ratings), y AS (SELECT *, lag(rating_numeric) OVER ({_W}) AS p, row_number() OVER ({_W}) AS n, last_value(o IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS po FROM x)
    SELECT rating_id, CASE WHEN nullif(trim(action), '') IS NOT NULL AND contains(source, 'confirmed by') THEN trim(action) WHEN n = 1 OR p IS NULL THEN 'initial' WHEN rating_numeric < p THEN 'upgrade' WHEN rating_numeric > p THEN 'downgrade'
    WHEN o IS NOT NULL AND po IS NOT NULL AND o <> po THEN 'outlook_change' ELSE 'affirm' END AS inferred_action FROM y""",
    "ratings",
)
def o085_infer_actions(spark: SparkSession, d: str) -> DataFrame:
    """O-85: explicit actions kept where two sources confirm them, all others inferred."""
    t = ratings(spark, d).withColumn("action", F.when(F.col("source").contains("confirmed by"), F.col("action")))
    return ra.infer_actions(t, KEYS, ORDER).select("rating_id", "inferred_action")


@query(
    f"""WITH y AS (SELECT *, lag(rating_numeric) OVER ({_W}) AS p, lag(date) OVER ({_W}) AS date_from, lag(rating) OVER ({_W}) AS rating_from, lag(source) OVER ({_W}) AS source_from FROM ratings)
    SELECT country, agency, date_from, rating_from, source_from, date AS date_to, rating AS rating_to, source AS source_to, rating_numeric - p AS notch_jump FROM y WHERE abs(rating_numeric - p) > 4 ORDER BY abs(notch_jump) DESC""",
    "ratings",
)
def o086_notch_jumps(spark: SparkSession, d: str) -> DataFrame:
    """O-86, O-95: jumps of more than four notches, the largest first."""
    return qu.notch_jumps(ratings(spark, d), KEYS, ORDER, "rating_numeric", ["date", "rating", "source"]).orderBy(F.abs("notch_jump").desc())


@query(
    """WITH m AS (SELECT country, median(rating_numeric) AS median FROM ratings GROUP BY country), k AS (SELECT country, m.median, median(abs(rating_numeric - m.median)) AS mad FROM ratings JOIN m USING (country) GROUP BY ALL)
    SELECT r.rating_id, r.country, r.agency, r.date, k.median AS country_median, round(0.6745 * (rating_numeric - k.median) / mad, 2) AS modified_z_score FROM ratings r JOIN k USING (country) WHERE mad > 0 AND abs(0.6745 * (rating_numeric - k.median) / mad) > 3.5""",
    "ratings",
)
def o075_range_outliers(spark: SparkSession, d: str) -> DataFrame:
    """O-74, O-75, O-118: modified z-scores beyond 3.5 within a country."""
    t = qu.mad_outliers(ratings(spark, d), ["country"], "rating_numeric")
    return t.select("rating_id", "country", "agency", "date", F.col("median").alias("country_median"), F.round("modified_z", 2).alias("modified_z_score"))


@query(
    f"""WITH x AS (SELECT *, coalesce(contains(source, '(month-precision)') AND NOT contains(source, 'confirmed by'), false) AS rough FROM ratings),
    y AS (SELECT *, lag(date) OVER ({_W}) AS prev_date, lag(rating_numeric) OVER ({_W}) AS p, lag(rough) OVER ({_W}) AS pr FROM x)
    SELECT country, agency, date, rating_numeric, prev_date, CAST(date - prev_date AS INT) AS gap_days FROM y WHERE rating_numeric = p AND date - prev_date BETWEEN 1 AND 35 AND rough <> pr""",
    "ratings",
)
def o087_possible_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """O-87: neighbours that may be one action dated twice, once by month."""
    return qu.close_mixed_precision(ratings(spark, d), KEYS, ORDER, "date", "rating_numeric", ra.month_precision(F.col("source"))).select("country", "agency", "date", "rating_numeric", "prev_date", "gap_days")


@query(
    "SELECT country, agency, count(*) AS n_rows, CAST(sum((NOT coalesce(contains(source, 'confirmed by') OR contains(source, 'conflict resolved'), false))::INT) AS BIGINT) AS n_single_sourced, round(100 * sum((NOT coalesce(contains(source, 'confirmed by') OR contains(source, 'conflict resolved'), false))::INT) / count(*), 1) AS pct_single_sourced FROM ratings GROUP BY ALL",
    "ratings",
)
def o072_single_source(spark: SparkSession, d: str) -> DataFrame:
    """O-72, O-96: exposure to single-sourced rows."""
    t = qu.share_where(ratings(spark, d), KEYS, ra.single_sourced(F.col("source")), "single_sourced")
    return t.orderBy(F.desc("pct_single_sourced"), F.desc("n_rows"))


@query("SELECT country, agency, bool_and(coalesce(regexp_full_match(source, 'GE.*'), false)) AS first_source_only FROM ratings GROUP BY ALL", "ratings")
def o071_all_per_group(spark: SparkSession, d: str) -> DataFrame:
    """O-71, O-108: series of which every row comes from one source alone, by a full match."""
    return ratings(spark, d).groupBy("country", "agency").agg(F.bool_and(F.coalesce(F.col("source").rlike("^GE.*$"), F.lit(False))).alias("first_source_only"))


@query(
    "SELECT country, agency, date, rating, outlook, min(raw_id) AS raw_id FROM rating_raw GROUP BY ALL",
)
def o080_distinct_actions(spark: SparkSession, d: str) -> DataFrame:
    """O-80: exact duplicates dropped, the first kept; NULL equals NULL."""
    return first_by(load(spark, d, "rating_raw").select("country", "agency", "date", "rating", "outlook", "raw_id"), ["country", "agency", "date", "rating", "outlook"], ["raw_id"])


@query(
    f"""WITH c AS ({_CLEAN}) SELECT raw_id, upper(rating) IN ('SD', 'RD', 'D') AS is_default, CASE WHEN upper(rating) IN ('SD', 'RD', 'D') THEN source || ' (default designation; omitted by the other source)' ELSE source || ' (confirmed by other)' END AS provenance FROM c WHERE rating IS NOT NULL""",
    "rawlog",
)
def o044_default_split(spark: SparkSession, d: str) -> DataFrame:
    """O-44, O-115: default designations told apart, provenance composed."""
    t = ra.clean(raw_log(spark, d)).filter("rating IS NOT NULL")
    is_default = o.is_token(F.col("rating"), o.DEFAULTS)
    note = F.when(is_default, F.concat("source", F.lit(" (default designation; omitted by the other source)"))).otherwise(F.concat("source", F.lit(" (confirmed by other)")))
    return t.select("raw_id", is_default.alias("is_default"), note.alias("provenance"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cleaned actions of both sources, blanks filled within each, and the second one's default designations."""
    side = F.when(F.col("source").startswith("GE"), "GE").when(F.col("source").startswith("CE"), "CE")
    log = ra.clean(raw_log(spark, d)).withColumn("side", side).filter("side IS NOT NULL")
    is_default = (F.col("side") == "CE") & o.is_token(F.col("rating"), o.DEFAULTS)
    cols = [F.col("raw_id").alias("row_id"), "country", "agency", "date", "rating", "outlook", "source"]
    first = ["country", "agency", "date", "rating", "outlook"]
    defaults = first_by(log.filter(is_default).select(*cols), first, ["row_id"])
    filled = ra.forward_fill(log.filter(~is_default), [*KEYS, "side"], ["date", "raw_id"]).filter(rating_ordinal(F.col("rating")).isNotNull())
    return filled.filter("side = 'GE'").select(*cols), filled.filter("side = 'CE'").select(*cols), defaults


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    first, second, _ = _sides(spark, d)
    return ra.reconcile(first, second)


def _resolutions(spark: SparkSession, d: str) -> DataFrame:
    """Adjudications by agency and both dates: of every date of the first source, up to five days on, the second source wins on odd gaps; later entries never count."""
    dates = raw_log(spark, d).filter(F.col("source").startswith("GE") & F.col("date").isNotNull()).select("agency", F.col("date").alias("p_date")).distinct()
    gap = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("gap")
    rules = dates.select("agency", "p_date", gap, F.lit(1).alias("entry")).unionByName(dates.select("agency", "p_date", gap, F.lit(2).alias("entry")))
    wins = F.when((F.col("gap") + F.col("entry")) % 2 == 0, " ce").otherwise("GE ")
    return rules.select("agency", "p_date", F.date_add("p_date", F.col("gap")).alias("s_date"), wins.alias("chosen_source"), F.concat(F.lit("entry "), F.col("entry").cast("string")).alias("note"), "entry")


_SAME = "ps[k].n IS NULL OR ss[i].n IS NULL OR ps[k].n = ss[i].n OR (ps[k].w AND ss[i].w) OR (ps[k].b <> '' AND ps[k].b = ss[i].b)"
_GREEDY = f"""WITH RECURSIVE c AS ({_CLEAN}),
e AS (SELECT *, CASE WHEN source LIKE 'GE%' THEN 'GE' WHEN source LIKE 'CE%' THEN 'CE' END AS side FROM c WHERE source LIKE 'GE%' OR source LIKE 'CE%'),
df AS (SELECT country, agency, date, rating, outlook, arg_min(source, raw_id) AS source FROM e WHERE side = 'CE' AND upper(trim(rating)) IN ('SD', 'RD', 'D') GROUP BY country, agency, date, rating, outlook),
f AS (SELECT * REPLACE (last_value(rating IGNORE NULLS) OVER (PARTITION BY country, agency, side ORDER BY date, raw_id ROWS UNBOUNDED PRECEDING) AS rating) FROM e WHERE NOT coalesce(side = 'CE' AND upper(trim(rating)) IN ('SD', 'RD', 'D'), false)),
l AS (SELECT country, agency, date, rating, outlook, side, min(raw_id) AS id, arg_min(source, raw_id) AS src, lower(CASE WHEN upper(trim(outlook)) <> 'NR' THEN nullif(trim(outlook), '') END) AS n FROM f GROUP BY country, agency, date, rating, outlook, side),
x AS (SELECT l.*, m.ordinal AS o, coalesce(contains(n, 'watch') OR contains(n, 'review'), false) AS w, coalesce(trim(regexp_replace(regexp_replace(n, '\\b(under\\s+review|watch|review)\\b', '', 'gi'), '\\s+', ' ', 'g')), '') AS b FROM l JOIN {_MAP} ON m.letters = trim(l.rating)),
g AS (SELECT country, agency, CAST(date_trunc('month', date) AS DATE) AS month, coalesce(list(x ORDER BY date, id) FILTER (side = 'GE'), []) AS ps, coalesce(list(x ORDER BY date, id) FILTER (side = 'CE'), []) AS ss FROM x GROUP BY country, agency, CAST(date_trunc('month', date) AS DATE)),
step AS (SELECT *, 1::BIGINT AS k, []::BIGINT[] AS used, []::BIGINT[] AS hits FROM g
  UNION ALL SELECT country, agency, month, ps, ss, k + 1, CASE WHEN h IS NULL THEN used ELSE list_append(used, h) END, list_append(hits, h)
  FROM (SELECT *, list_filter(range(1, len(ss) + 1), lambda i: NOT list_contains(used, i) AND ss[i].o = ps[k].o AND ({_SAME}))[1] AS h FROM step WHERE k <= len(ps))),
r AS (SELECT *, list_filter(range(1, len(ps) + 1), lambda i: hits[i] IS NULL) AS lp, list_filter(range(1, len(ss) + 1), lambda i: NOT list_contains(used, i)) AS ls FROM step WHERE k = len(ps) + 1),
u AS (SELECT *, unnest(range(1, greatest(len(ps), len(ss)) + 1)) AS i FROM r),
pairs AS (SELECT country, agency, month, 'matched' AS status, ps[i] AS p, ss[hits[i]] AS s FROM u WHERE i <= len(ps) AND hits[i] IS NOT NULL
  UNION ALL SELECT country, agency, month, 'conflict', ps[lp[i]], ss[ls[i]] FROM u WHERE i <= least(len(lp), len(ls))
  UNION ALL SELECT country, agency, month, 'primary_only', ps[lp[i]], NULL FROM u WHERE i > len(ls) AND i <= len(lp)
  UNION ALL SELECT country, agency, month, 'secondary_only', NULL, ss[ls[i]] FROM u WHERE i > len(lp) AND i <= len(ls)),
ru AS (SELECT agency, date AS p_date, CAST(date + gap AS DATE) AS s_date, CASE WHEN gap % 2 = 1 THEN 'CE' ELSE 'GE' END AS chosen_source, 'entry 1' AS note FROM (SELECT DISTINCT agency, date FROM rawlog WHERE source LIKE 'GE%' AND date IS NOT NULL) CROSS JOIN (SELECT unnest(range(6))::INT AS gap)),
ad AS (SELECT k.*, CASE WHEN ru.note IS NULL THEN 'OPEN' ELSE 'resolved' END AS resolution, ru.chosen_source, ru.note FROM pairs k LEFT JOIN ru ON ru.agency = k.agency AND ru.p_date = k.p.date AND ru.s_date = k.s.date WHERE status = 'conflict')
"""
_PREFER = "CASE WHEN p.w AND NOT s.w THEN {p} ELSE coalesce({s}, {p}) END".format(p="CASE WHEN p.n IS NOT NULL THEN trim(p.outlook) END", s="CASE WHEN s.n IS NOT NULL THEN trim(s.outlook) END")


@query(_GREEDY + "SELECT country, agency, month, status, p.id AS p_id, s.id AS s_id FROM pairs", "rawlog")
def o058_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """O-58, O-100: greedy one-to-one matching of two sources per country, agency and month."""
    return _pairs(spark, d).select("country", "agency", "month", "status", F.col("p.row_id").alias("p_id"), F.col("s.row_id").alias("s_id"))


@query(
    _GREEDY + """SELECT country, agency, month, p.date AS ge_date, p.rating AS ge_rating, p.outlook AS ge_outlook, p.src AS ge_source, s.date AS ce_date, s.rating AS ce_rating, s.outlook AS ce_outlook, s.src AS ce_source, resolution AS status, chosen_source AS resolution_source, note AS resolution_note FROM ad""",
    "rawlog",
)
def o059_resolved_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """O-59: the conflicts table: both rows, and the first matching adjudication or OPEN."""
    t = ra.adjudicated(_pairs(spark, d), _resolutions(spark, d))
    both = [F.col(f"{side}.{c}").alias(f"{name}_{c}") for side, name in (("p", "ge"), ("s", "ce")) for c in ("date", "rating", "outlook", "source")]
    return t.select("country", "agency", "month", *both, F.col("resolution").alias("status"), F.col("chosen_source").alias("resolution_source"), F.col("note").alias("resolution_note"))


@query(
    _GREEDY + f"""SELECT country, agency, date, rating, outlook, source || ' (default designation; omitted by the other source)' AS source FROM df
UNION ALL SELECT country, agency, s.date, s.rating, {_PREFER}, s.src || ' (confirmed by ' || p.src || ')' FROM pairs WHERE status = 'matched'
UNION ALL SELECT country, agency, coalesce(p, s).date, coalesce(p, s).rating, coalesce(p, s).outlook, coalesce(p, s).src FROM pairs WHERE status IN ('primary_only', 'secondary_only')
UNION ALL SELECT country, agency, CASE WHEN chosen_source = 'CE' THEN s.date ELSE p.date END, CASE WHEN chosen_source = 'CE' THEN s.rating ELSE p.rating END, CASE WHEN chosen_source = 'CE' THEN s.outlook ELSE p.outlook END, CASE WHEN chosen_source = 'CE' THEN s.src ELSE p.src END || ' (conflict resolved: ' || note || ')' FROM ad WHERE resolution = 'resolved'""",
    "rawlog",
)
def o115_merged_log(spark: SparkSession, d: str) -> DataFrame:
    """O-58, O-59, O-114, O-115: the reconciled log with preferred outlooks and provenance."""
    first, second, defaults = _sides(spark, d)
    return ra.merged(cut_lineage(ra.reconcile(first, second)), defaults, _resolutions(spark, d))


_CORR = "SELECT DISTINCT agency, date, trim(rating) AS wrong_rating, 'BBB' AS corrected_rating FROM rawlog WHERE source = 'desk note' AND rating IS NOT NULL"


@query(
    f"""WITH c AS ({_CORR} QUALIFY row_number() OVER (PARTITION BY agency, date ORDER BY trim(rating)) = 1)
    SELECT r.raw_id, CASE WHEN trim(r.rating) = c.wrong_rating THEN c.corrected_rating ELSE r.rating END AS rating FROM rawlog r LEFT JOIN c ON c.agency = r.agency AND c.date = r.date""",
    "rawlog",
)
def o060_corrections(spark: SparkSession, d: str) -> DataFrame:
    """O-60: known wrong ratings replaced by agency, date and wrong value."""
    log = raw_log(spark, d)
    c = log.filter((F.col("source") == "desk note") & F.col("rating").isNotNull()).groupBy("agency", "date").agg(F.min(F.trim("rating")).alias("wrong_rating")).withColumn("corrected_rating", F.lit("BBB"))
    return ra.corrected(log, c).select("raw_id", "rating")


_EVENTS = """WITH e AS (SELECT rating_id, replace(country, '_', ' ') AS country_name, date FROM ratings WHERE action = 'downgrade'),
s AS (SELECT country_name, rebal_date, avg(yield_spread_bps) AS v FROM panel GROUP BY ALL),
j AS (SELECT e.rating_id, s.v, row_number() OVER (PARTITION BY e.rating_id ORDER BY s.rebal_date DESC) AS n FROM e JOIN s ON s.country_name = e.country_name AND s.rebal_date < e.date),
a AS (SELECT rating_id, count(*) FILTER (n <= 4) AS na, count(v) FILTER (n <= 4) AS nv, count(*) FILTER (n BETWEEN 5 AND 8) AS ba, count(v) FILTER (n BETWEEN 5 AND 8) AS bv, avg(v) FILTER (n <= 4) AS nm, avg(v) FILTER (n BETWEEN 5 AND 8) AS bm FROM j GROUP BY ALL),
t AS (SELECT e.*, coalesce(na, 0) AS na, coalesce(nv, 0) AS nv, coalesce(ba, 0) AS ba, coalesce(bv, 0) AS bv, nm, bm, CASE WHEN e.date > (SELECT max(rebal_date) FROM panel) THEN 'event_after_panel_end' WHEN coalesce(na, 0) = 0 THEN 'no_preceding_data' WHEN nv < 2 OR bv < 2 THEN 'insufficient_history' ELSE 'ok' END AS status FROM e LEFT JOIN a USING (rating_id))
"""


def _windows(spark: SparkSession, d: str) -> DataFrame:
    e = ratings(spark, d).filter("action = 'downgrade'").select("rating_id", F.translate("country", "_", " ").alias("country_name"), "date")
    return ev.event_windows(e, panel(spark, d, "country_name", "yield_spread_bps"), "rating_id", "country_name", "date", "rebal_date", "yield_spread_bps")


@query(
    _EVENTS + "SELECT rating_id, country_name, date, status, na AS n_near_available, nv AS n_near_valid, ba AS n_baseline_available, bv AS n_baseline_valid, round(CASE WHEN status = 'ok' THEN nm END, 6) AS near_mean, round(CASE WHEN status = 'ok' THEN bm END, 6) AS baseline_mean, round(CASE WHEN status = 'ok' THEN nm - bm END, 6) AS diff FROM t",
    "ratings", "panel",
)
def o089_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """O-61, O-89, O-90, O-98: four quarters before each downgrade against the four before those, with a status."""
    return _windows(spark, d).select("*", *[]).withColumns({c: r6(c) for c in ("near_mean", "baseline_mean", "diff")})


@query(_EVENTS + "SELECT status, count(*) AS n FROM t GROUP BY ALL", "ratings", "panel")
def o069_value_counts(spark: SparkSession, d: str) -> DataFrame:
    """O-69: events by status."""
    return _windows(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT dm_em_flag, " + ", ".join(f"count(*) FILTER (coverage_tier = '{t}') AS {t}" for t in ("full_dm", "dm_standard", "em_standard", "em_minimal")) + " FROM feature_panel GROUP BY ALL"
)
def o070_crosstab(spark: SparkSession, d: str) -> DataFrame:
    """O-70: flag against coverage tier."""
    tiers = ["full_dm", "dm_standard", "em_standard", "em_minimal"]
    return qu.two_way_counts(load(spark, d, "feature_panel"), "dm_em_flag", "coverage_tier", tiers)


@query(
    "SELECT c.country, k.series, round(coalesce(n, 0) / 21, 3) AS coverage_pct FROM (SELECT DISTINCT name AS country FROM universe WHERE name IS NOT NULL) c CROSS JOIN (SELECT DISTINCT series FROM macro) k LEFT JOIN (SELECT country, series, count(*) AS n FROM macro GROUP BY ALL) m USING (country, series)",
    "macro",
)
def o073_coverage_report(spark: SparkSession, d: str) -> DataFrame:
    """O-73: rows over expected years of every entity and series."""
    m = macro(spark, d)
    return qu.coverage_report(load(spark, d, "universe").select(F.col("name").alias("country")).dropna().distinct(), m.select("series").distinct(), m, 21)


@query(
    "SELECT country, series FROM (SELECT c.country, k.series, coalesce(n, 0) / 21 AS p FROM (SELECT DISTINCT name AS country FROM universe WHERE name IS NOT NULL) c CROSS JOIN (SELECT DISTINCT series FROM macro) k LEFT JOIN (SELECT country, series, count(*) AS n FROM macro GROUP BY ALL) m USING (country, series)) WHERE p < 0.5",
    "macro",
)
def o046_low_coverage(spark: SparkSession, d: str) -> DataFrame:
    """O-46: series below half of the expected rows."""
    return o073_coverage_report(spark, d).filter("coverage_pct < 0.5").select("country", "series")


@query("SELECT DISTINCT name FROM universe WHERE name IS NOT NULL AND name NOT IN (SELECT country FROM market_daily WHERE country IS NOT NULL)")
def o101_missing_entities(spark: SparkSession, d: str) -> DataFrame:
    """O-101, O-81: entities without any reading."""
    return qu.missing_keys(load(spark, d, "universe").select("name").dropna(), load(spark, d, "market_daily").select(F.col("country").alias("name")), ["name"])


@query("SELECT ric, min(date) AS first_date, max(date) AS last_date, count(*) AS n, count(DISTINCT date) AS n_dates, min(date) > DATE '2005-01-31' AS starts_late FROM daily GROUP BY ric", "daily")
def o076_series_span(spark: SparkSession, d: str) -> DataFrame:
    """O-68, O-76: span and counts of every series, late starts flagged."""
    return daily(spark, d, "mid_price").groupBy("ric").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n"), F.countDistinct("date").alias("n_dates"), (F.min("date") > F.lit("2005-01-31").cast("date")).alias("starts_late")
    )


@query("SELECT rebal_date, " + ", ".join(f"round(avg(({c} IS NOT NULL)::INT), 6) AS coverage_{c}" for c in ("yield_spread_bps", "debt_gdp", "cds_5y")) + ", round(avg(cds_5y), 6) AS mean_cds, CAST(count(*) AS BIGINT) AS n FROM panel GROUP BY ALL", "panel")
def o021_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """O-21, O-65, O-79: row counts, coverage and means that skip missing values, as a table."""
    t = panel(spark, d, "yield_spread_bps", "debt_gdp", "cds_5y")
    cover = qu.coverage(t, ["rebal_date"], ["yield_spread_bps", "debt_gdp", "cds_5y"])
    means = t.groupBy("rebal_date").agg(r6(F.avg("cds_5y")).alias("mean_cds"), F.count(F.lit(1)).alias("n"))
    return cover.withColumns({c: r6(c) for c in cover.columns if c != "rebal_date"}).join(means, "rebal_date")


@query(
    "WITH x AS (SELECT iso3, name, iso2, classification, bond_ric, cds_ric FROM universe QUALIFY row_number() OVER (PARTITION BY iso3 ORDER BY name NULLS FIRST, iso2 NULLS FIRST, classification NULLS FIRST, bond_ric NULLS FIRST, cds_ric NULLS FIRST) = 1) SELECT iso3, name, CASE WHEN upper(trim(classification)) IN ('DM', 'EM') THEN upper(trim(classification)) END AS classification, bond_ric FROM x"
)
def o001_universe(spark: SparkSession, d: str) -> DataFrame:
    """O-01: the dimension of entities, one row per code."""
    return _entities(load(spark, d, "universe"))


def _entities(universe: DataFrame) -> DataFrame:
    one = first_by(universe.select("iso3", "name", "iso2", "classification", "bond_ric", "cds_ric"), ["iso3"], ["name", "iso2", "classification", "bond_ric", "cds_ric"])
    c = F.upper(F.trim("classification"))
    return one.select("iso3", "name", F.when(c.isin("DM", "EM"), c).alias("classification"), "bond_ric")


@query(f"SELECT *, 'core' AS listing FROM ({CTES['entities']}) WHERE iso3 IS NOT NULL")
def o001_universe_yaml(spark: SparkSession, d: str) -> DataFrame:
    """O-01: the universe written as YAML, loaded from it, and reduced to one row per code."""
    path = place(spark, "universe")
    fs.write_universe_yaml(load(spark, d, "universe"), path)
    loaded = fs.universe_yaml(spark, path)
    return _entities(loaded).crossJoin(F.broadcast(loaded.agg(F.max("listing").alias("listing")))).filter("iso3 IS NOT NULL")  # one row


_BOND = "SELECT country AS entity, date, mid_price, bid, zspread FROM daily WHERE mid_price IS NOT NULL"


@query(_BOND, "daily")
def o002_entity_csvs(spark: SparkSession, d: str) -> DataFrame:
    """O-02, O-18, O-36: CSVs per entity written and scanned again by their headers, the entity from the files' places."""
    path = place(spark, "bonds")
    t = daily(spark, d, "country", "mid_price", "bid", "zspread").filter("mid_price IS NOT NULL").select("country", "date", "mid_price", "bid", "zspread")
    fs.write_entity_csvs(t, "country", path)
    return fs.entity_csvs(spark, path).select("entity", "date", "mid_price", "bid", "zspread")


@query("SELECT country, series, period_date, available_date, value, source FROM macro ORDER BY country, series, period_date", "macro")
def o003_macro_csv(spark: SparkSession, d: str) -> DataFrame:
    """O-03, O-18, O-94: tidy facts as CSV and back, sorted."""
    back = fs.write_csv(macro(spark, d).select("country", "series", "period_date", "available_date", "value", "source"), place(spark, "macro"))
    return back.orderBy("country", "series", "period_date")


@query("SELECT replace(country, '_', ' ') AS country, agency, date, rating, nullif(outlook, '') AS outlook, nullif(action, '') AS action, nullif(source, '') AS source FROM ratings WHERE agency IS NOT NULL", "ratings")
def o004_ratings_folder(spark: SparkSession, d: str) -> DataFrame:
    """O-04: a folder of rating files per country, scanned as one table, the country from the files' places."""
    path = place(spark, "ratings")
    t = ratings(spark, d).filter("agency IS NOT NULL").select("country", *fs.RATING_COLUMNS)
    fs.write_entity_csvs(t, "country", path)
    return fs.ratings_folder(spark, path)


_SHEET_SQL = "SELECT replace(country, '_', ' ') AS country, agency, rating, outlook, date, source, substr(source, 1, 2) AS sheet FROM rating_raw WHERE (source LIKE 'GE%' OR source LIKE 'CE%')"


@query(
    f"SELECT country, sheet, count(*) AS n, count(DISTINCT agency) AS n_agencies, count(nullif(rating, '')) AS n_rated, min(date) AS first_date, max(date) AS last_date FROM ({_SHEET_SQL}) GROUP BY country, sheet"
)
def o005_two_sheets(spark: SparkSession, d: str) -> DataFrame:
    """O-05: a workbook per country with the two sources as sheets, written and scanned, a workbook to a task."""
    path = place(spark, "books")
    t = load(spark, d, "rating_raw").withColumn("sheet", F.substring("source", 1, 2)).filter("sheet IN ('GE', 'CE')")
    t = t.select("country", "sheet", "agency", "rating", "outlook", F.col("date").cast("string").alias("date"), "source")

    def book(key, pdf):
        import pandas as pd

        sheets = {s: pdf[pdf["sheet"] == s][["agency", "rating", "outlook", "date", "source"]] for s in ("GE", "CE")}
        return pd.DataFrame({"country": [key[0]], "part": [key[1]], "book": [fs.write_workbook(sheets)]})

    # A workbook is written in one piece, so a country of very many rows gets several, told apart behind a tilde.
    largest = t.groupBy("country").count().agg(F.max("count")).first()[0] or 1
    part = F.pmod(F.xxhash64(*t.columns), F.lit(-(-largest // fs.BOOK_ROWS))).alias("part")
    books = t.groupBy("country", part).applyInPandas(book, "country string, part bigint, book binary")
    fs.write_binaries(books.withColumn("name", F.concat("country", F.lit("~"), "part", F.lit(".xlsx"))), "name", "book", path)
    first, second = fs.workbook_sheets(spark, path)
    both = first.withColumn("sheet", F.lit("GE")).unionByName(second.withColumn("sheet", F.lit("CE")))
    return both.groupBy("country", "sheet").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("agency").alias("n_agencies"), F.count(F.nullif("rating", F.lit(""))).alias("n_rated"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


@query("SELECT count(*) FILTER (source LIKE 'GE%') AS n_first, count(*) FILTER (source LIKE 'CE%') AS n_second FROM rating_raw")
def o005_two_sources(spark: SparkSession, d: str) -> DataFrame:
    """O-05: two sheets as two Parquet inputs with checked columns."""
    t = load(spark, d, "rating_raw")
    paths = []
    for s in ("GE", "CE"):
        paths.append(place(spark, s) + ".parquet")
        fs.write_parquet(t.filter(F.col("source").startswith(s)), paths[-1])
    a, b = fs.two_sources(spark, *paths)
    return a.agg(F.count(F.lit(1)).alias("n_first")).crossJoin(b.agg(F.count(F.lit(1)).alias("n_second")))  # one row each


@query("SELECT * FROM panel ORDER BY country_code, rebal_date", "panel")
def o006_parquet_sorted(spark: SparkSession, d: str) -> DataFrame:
    """O-06, O-17: Parquet written, read and sorted."""
    return fs.write_parquet(panel(spark, d), place(spark, "panel")).orderBy("country_code", "rebal_date")


@query("SELECT country AS iso3, series, year(period_date)::INT AS year, max(value) AS value FROM macro WHERE value IS NOT NULL AND source = 'world_bank' GROUP BY ALL", "macro")
def o010_world_bank(spark: SparkSession, d: str) -> DataFrame:
    """O-07, O-10: cached payloads of [meta, rows] flattened; rows without value dropped."""
    m = macro(spark, d).filter("source = 'world_bank'").groupBy("country", "series", F.year("period_date").alias("y")).agg(F.max("value").alias("value"))
    rows = F.collect_list(F.struct(F.col("country").alias("countryiso3code"), F.col("y").cast("string").alias("date"), "value"))
    payloads = m.groupBy("country", "series").agg(F.concat(F.lit('[{"page":1},'), F.to_json(rows), F.lit("]")).alias("payload")).drop("country")
    return fs.flatten_world_bank(payloads).select("iso3", "series", "year", "value")


@query("SELECT series AS indicator, country AS iso3, year(period_date)::INT AS year, max(value) AS value FROM macro WHERE source = 'imf_weo' AND year(period_date) BETWEEN 2005 AND 2025 GROUP BY ALL HAVING max(value) IS NOT NULL", "macro")
def o011_weo(spark: SparkSession, d: str) -> DataFrame:
    """O-07, O-11: nested maps indicator, code, year flattened; digit-only years within the range."""
    m = macro(spark, d).filter("source = 'imf_weo'").groupBy("series", "country", F.year("period_date").cast("string").alias("y")).agg(F.max("value").alias("v")).filter("v IS NOT NULL")
    codes = m.groupBy("series", "country").agg(F.map_from_entries(F.collect_list(F.struct("y", "v"))).alias("years"))
    # A payload holds a sixty-fourth of the countries: no cell grows with all of them.
    payloads = codes.groupBy("series", F.pmod(F.xxhash64("country"), F.lit(64)).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct("country", "years"))).alias("codes"))
    payloads = payloads.select(F.to_json(F.struct(F.create_map("series", "codes").alias("values"))).alias("payload"))
    return fs.flatten_weo(payloads)


def _served(texts: DataFrame, path: str) -> DataFrame:
    """Texts written one to a file, as the URLs behind which they can be fetched; the other columns stay beside them."""
    keys = [c for c in texts.columns if c != "payload"]
    fs.write_binaries(texts.select(F.concat(F.md5(F.concat_ws("|", *keys)), F.lit(".json")).alias("name"), F.col("payload").cast("binary").alias("content")), "name", "content", path)
    return texts.select(*keys, F.concat(F.lit(path.rstrip("/") + "/"), F.md5(F.concat_ws("|", *keys)), F.lit(".json")).alias("url"))


@query("SELECT country AS iso3, series, year(period_date)::INT AS year, max(value) AS value FROM macro WHERE value IS NOT NULL AND source = 'world_bank' GROUP BY ALL", "macro")
def o007_fetched_payloads(spark: SparkSession, d: str) -> DataFrame:
    """O-07, O-09, O-10: one request per country and series fetched by the executors with retries, cached, served from the cache, flattened."""
    served = place(spark, "served")
    if not served.startswith("file:"):
        return o010_world_bank(spark, d)  # no server here: only files can be fetched
    m = macro(spark, d).filter("source = 'world_bank'").groupBy("country", "series", F.year("period_date").alias("y")).agg(F.max("value").alias("value"))
    rows = F.collect_list(F.struct(F.col("country").alias("countryiso3code"), F.col("y").cast("string").alias("date"), "value"))
    texts = cut_lineage(m.groupBy("country", "series").agg(F.concat(F.lit('[{"page":1},'), F.to_json(rows), F.lit("]")).alias("payload")))
    requests, cache = cut_lineage(_served(texts, served)), place(spark, "cache")
    fs.cached_payloads(requests, cache)  # the first run fetches
    return fs.flatten_world_bank(fs.cached_payloads(requests, cache, _unreachable).drop("url")).select("iso3", "series", "year", "value")


def _unreachable(url: str) -> str:
    raise OSError(f"not in the cache: {url}")


@query("SELECT date, mid_price AS value, CAST(date + 1 AS DATE) AS available_date FROM daily WHERE mid_price IS NOT NULL AND date BETWEEN DATE '2005-01-01' AND DATE '2025-12-31'", "daily")
def o012_fred(spark: SparkSession, d: str) -> DataFrame:
    """O-08, O-12, O-104: daily text series: range, numeric values only, known one day later."""
    t = daily(spark, d, "mid_price").select(F.col("date").cast("string").alias("date"), F.coalesce(F.col("mid_price").cast("string"), F.lit(".")).alias("value"))
    return fs.fred_series(fs.write_csv(t, place(spark, "fred")), "2005-01-01", "2025-12-31", 1)


@query("SELECT CAST(c AS DATE) AS chunk_start, least(CAST(c + INTERVAL 2 YEAR - INTERVAL 1 DAY AS DATE), DATE '2025-12-31') AS chunk_end, (SELECT count(*) FROM daily WHERE date BETWEEN CAST(c AS DATE) AND least(CAST(c + INTERVAL 2 YEAR - INTERVAL 1 DAY AS DATE), DATE '2025-12-31')) AS n FROM (SELECT unnest(generate_series(DATE '2005-01-01', DATE '2025-12-31', INTERVAL 2 YEAR)) AS c)", "daily")
def o013_chunks(spark: SparkSession, d: str) -> DataFrame:
    """O-13: two-year chunks of a history, dates deduplicated keeping the first, rows per chunk."""
    chunks = F.broadcast(fs.date_chunks(spark, "2005-01-01", "2025-12-31"))  # a row per two years
    per_day = daily(spark, d, "mid_price").groupBy("date").agg(F.count(F.lit(1)).alias("k"))
    hit = per_day.join(chunks, F.col("date").between(F.col("chunk_start"), F.col("chunk_end")), "right")
    return hit.groupBy("chunk_start", "chunk_end").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))


_YEARS = 3


@query(
    "SELECT date, country AS instrument, round(avg(mid_price), 6) AS mid_price, round(avg(zspread), 6) AS zspread FROM daily WHERE country IN (SELECT country FROM daily WHERE country IS NOT NULL GROUP BY country ORDER BY country LIMIT 12) GROUP BY ALL HAVING avg(mid_price) IS NOT NULL OR avg(zspread) IS NOT NULL",
    "daily",
)
def o013_history(spark: SparkSession, d: str) -> DataFrame:
    """O-13: a wide vendor history of a request's instruments in overlapping chunks of dates, flattened, concatenated, of a date in two chunks the first kept.

    A request names its instruments (here the first twelve issuers): a vendor's wide table has a column per field and instrument.
    """
    t = daily(spark, d, "country", "mid_price", "zspread").filter("country IS NOT NULL")
    names = [r.country for r in t.select("country").distinct().orderBy("country").limit(12).collect()]  # the request
    cells = t.groupBy("date").pivot("country", names).agg(F.avg("mid_price").alias("mid_price"), F.avg("zspread").alias("zspread"))
    wide = cells.select("date", *(F.col(f"`{n}_{f}`").alias(f"{f}|{n}") for n in names for f in ("mid_price", "zspread")))
    chunks = fs.date_chunks(spark, "2005-01-01", "2025-12-31", _YEARS).orderBy("chunk_start").collect()  # a row per chunk
    parts = [wide.filter(F.col("date").between(F.date_sub(F.lit(c.chunk_start), 30), F.lit(c.chunk_end))) for c in chunks]
    out = fs.concatenated([fs.flattened(p) for p in parts], ["date", "instrument"])
    return out.withColumns({c: r6(c) for c in ("mid_price", "zspread")})


@query("SELECT 'none' AS agency, 0 AS n WHERE false")
def o016_optional_input(spark: SparkSession, d: str) -> DataFrame:
    """O-15, O-16: an absent side input is an empty frame of its schema."""
    t = fs.optional(spark, place(spark, "absent") + "/resolutions.csv", "agency string, ge_date date, ce_date date, chosen_source string, note string")
    return t.groupBy("agency").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("SELECT ric, count(*) AS n FROM daily GROUP BY ric", "daily")
def o019_write_once(spark: SparkSession, d: str) -> DataFrame:
    """O-19: written once; the second write changes nothing."""
    path = place(spark, "once")
    t = daily(spark, d, "mid_price").groupBy("ric").agg(F.count(F.lit(1)).alias("n"))
    fs.write_once(t, path)
    return fs.write_once(t.withColumn("n", F.lit(-1).cast("bigint")), path)


@query("SELECT reason, entity, item FROM (SELECT DISTINCT 'no readings' AS reason, name AS entity, 'bonds' AS item FROM universe WHERE name IS NOT NULL AND name NOT IN (SELECT country FROM market_daily WHERE country IS NOT NULL)) UNION ALL SELECT DISTINCT 'no period', country, series FROM macro_fact WHERE value IS NULL")
def o020_issue_log(spark: SparkSession, d: str) -> DataFrame:
    """O-20: issues appended to a pipe-delimited log, twice, and read back."""
    path = place(spark, "issues")
    fs.log_issues(o101_missing_entities(spark, d).select(F.lit("no readings").alias("reason"), F.col("name").alias("entity"), F.lit("bonds").alias("item")), path)
    gaps = load(spark, d, "macro_fact").filter("value IS NULL").select(F.lit("no period").alias("reason"), F.col("country").alias("entity"), F.col("series").alias("item")).distinct()
    return fs.log_issues(gaps, path)


@query(
    "SELECT run_id, rebal_date, country_code, CAST(CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY run_id, rebal_date ORDER BY score DESC NULLS LAST, country_code) END AS INT) AS rank_within_date, count(score) OVER (PARTITION BY run_id, rebal_date) AS n_scored_within_date, "
    + ", ".join(f"score IS NOT NULL AND row_number() OVER (PARTITION BY run_id, rebal_date ORDER BY score DESC NULLS LAST, country_code) <= {n} AS top_{n}" for n in (5, 10, 15)) + " FROM signals",
    "signals",
)
def o082_rank_within_date(spark: SparkSession, d: str) -> DataFrame:
    """O-82, O-83, O-84: rank, number scored, membership flags."""
    t = se.rank_within(signals(spark, d, "signal_id"), ["run_id", "rebal_date"], "score", ["country_code"])
    return t.select("run_id", "rebal_date", "country_code", "rank_within_date", "n_scored_within_date", "top_5", "top_10", "top_15")


@query("SELECT tier, algorithm, k_or_mcs, round(silhouette, 6) AS silhouette FROM (SELECT *, row_number() OVER (PARTITION BY tier, algorithm ORDER BY silhouette DESC, k_or_mcs) AS n FROM stage1_algorithm_comparison WHERE silhouette IS NOT NULL AND NOT isnan(silhouette)) WHERE n = 1")
def o077_best_per_group(spark: SparkSession, d: str) -> DataFrame:
    """O-77: the trial with the best silhouette per tier and algorithm."""
    t = load(spark, d, "stage1_algorithm_comparison").filter(~F.isnan("silhouette"))
    return se.best_of(t, ["tier", "algorithm"], "silhouette", "k_or_mcs").select("tier", "algorithm", "k_or_mcs", r6("silhouette").alias("silhouette"))


@query("SELECT signal_id, country_code, score FROM (SELECT * FROM signals WHERE score IS NOT NULL ORDER BY score DESC, signal_id LIMIT 20)", "signals")
def o097_head(spark: SparkSession, d: str) -> DataFrame:
    """O-97: the first rows of a sorted table (a report)."""
    return signals(spark, d, "signal_id").filter("score IS NOT NULL").orderBy(F.desc("score"), "signal_id").limit(20).select("signal_id", "country_code", "score")


_DIS = "SELECT rebal_date, country_code, dm_em_flag, tier FROM (SELECT *, ntile(3) OVER (PARTITION BY rebal_date ORDER BY yield_spread_bps, country_code) AS tier FROM panel WHERE yield_spread_bps IS NOT NULL) WHERE (dm_em_flag = 'EM' AND tier = 1) OR (dm_em_flag = 'DM' AND tier = 3)"


@query(_DIS, "panel")
def o045_disagreements(spark: SparkSession, d: str) -> DataFrame:
    """O-45: EM in the low tier or DM in the high one."""
    t = panel(spark, d, "dm_em_flag", "yield_spread_bps").filter("yield_spread_bps IS NOT NULL").select("rebal_date", "country_code", "dm_em_flag", "yield_spread_bps")
    t = scan(t, ["rebal_date"], [F.col("yield_spread_bps"), F.col("country_code")], "place", total="of").withColumn("tier", share_of(F.col("place"), F.col("of"), 3))
    return t.filter("(dm_em_flag = 'EM' AND tier = 1) OR (dm_em_flag = 'DM' AND tier = 3)").select("rebal_date", "country_code", "dm_em_flag", "tier").orderBy("rebal_date", "country_code")
