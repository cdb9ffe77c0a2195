"""Implausible readings, judged by each source's own normal behaviour.

Three rules flag a reading:

* **impossible**: the value lies outside the bounds that can exist;
* **spike**: it departs from the level on both sides (medians of the readings before and
  after, less the source's usual departure in that calendar month) in one direction, further than the source's tail cutoff.
  The cutoff is the quantile at a fixed risk of a generalised Pareto distribution over a threshold: its shape is
  fitted to the residuals of all sources together, in units of each source's usual move, its threshold and scale to the source's
  own, drawn towards the pool's by ``pool_weight`` peaks, so that a source with few peaks is judged mostly by the pool;
* **stuck**: the value stays the same longer than a run that the source's own share of
  unchanged steps makes credible, or (where a check value is given) while the check values move.

Readings are first reduced to distinct (field, source, date, value) rows (map-side) and written once, so a source
brings as many readings as its calendar has days and values, not as it has rows.  Normal behaviour is that of an era of at most
``SHARD_ROWS`` readings: a source with more is cut into time shards that see some hundred readings of their neighbours.
Sources and shards are hashed to buckets, a bucket is judged as one array: once for the pool's histogram of residuals,
once for the verdicts, which return to all rows, copies included, by an equi-join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, written

#: Distinct readings that a bucket should hold on average, and those beyond which a source is cut into time shards.
BUCKET_ROWS, SHARD_ROWS = 150_000, 200_000
#: Large sources that may be broadcast (their number is counted first); more are joined by a shuffle.
BROADCAST_SOURCES = 50_000
#: Readings of the neighbours that a shard sees on either side.
HALO_ROWS = 400


@dataclass(frozen=True)
class Rules:
    """Parameters of the three rules."""

    lowest: float = -np.inf  #: smallest and largest value that can exist
    highest: float = np.inf
    window: int = 5  #: readings on each side that make the level
    threshold: float = 0.90  #: quantile above which residuals are the tail
    risk: float = 1e-8  #: chance of a normal reading beyond the cutoff
    trim: float = 1e-5  #: chance of a normal reading left out of the pool's fit, with the spikes
    pool_weight: float = 30.0  #: peaks that the pool counts for beside a source's own
    own_threshold: int = 50  #: readings from which a source has a threshold of its own
    grid: float = 0.0  #: step of residuals that come in steps: each stands for its step's width
    by_moves: bool = True  #: False: residuals and cutoffs count in the value's own unit
    stuck_risk: float = 1e-5  #: expected number of natural runs of that length in a series
    stuck_least: int = 5  #: shortest run that can be stuck
    stuck_moving: int = 3  #: with check values: disagreeing readings that make a run stuck


#: Width of the pool's bins of residuals, and their upper end: what lies beyond is no tail of normal readings.
BIN, TOP = 0.02, 60.0
#: Peaks that the exponential tail (shape 0) counts for beside the pool's own: a shape told by a few peaks is chance.
SHAPE_PEAKS = 100


@dataclass(frozen=True)
class Tail:
    """A generalised Pareto tail: beyond ``threshold``, which the share ``beyond`` of the residuals exceeds."""

    threshold: float
    shape: float
    scale: float
    beyond: float

    def over(self, risk: float, scale: float | None = None) -> float:
        """How far over the threshold the quantile at ``risk`` lies."""
        s, m = self.scale if scale is None else scale, max(self.beyond / risk, 1.0)
        return s * np.log(m) if abs(self.shape) < 1e-9 else s / self.shape * (m**self.shape - 1)


def _side(v: np.ndarray, series: np.ndarray, k: int, ahead: bool) -> np.ndarray:
    """Median of the k readings before (after) each reading within its series; NaN without any."""
    n = len(v)
    at = np.arange(n)[:, None] + (np.arange(1, k + 1) if ahead else -np.arange(1, k + 1))[None, :]
    inside = (at >= 0) & (at < n)
    at = np.where(inside, at, 0)
    w = np.where(inside & (series[at] == series[:, None]), v[at], np.nan)
    w.sort(axis=1)  # NaN last
    c = (~np.isnan(w)).sum(axis=1)
    lo, hi = np.maximum((c - 1) // 2, 0), np.minimum(c // 2, k - 1)
    rows = np.arange(n)
    return np.where(c > 0, (w[rows, lo] + w[rows, hi]) / 2, np.nan)


def departures(v: np.ndarray, series: np.ndarray, month: np.ndarray, k: int) -> np.ndarray:
    """How far each reading lies beyond the levels of both sides, in one direction; 0 at an end, where one side is unknown."""
    before, after = v - _side(v, series, k, False), v - _side(v, series, k, True)
    both = np.where(np.sign(before) == np.sign(after), np.sign(before) * np.minimum(np.abs(before), np.abs(after)), 0.0)
    both = np.nan_to_num(both)
    cell = pd.Series(both).groupby([series, month])
    usual = np.where(cell.transform("size") >= 30, cell.transform("median"), 0.0)
    return np.abs(both - usual)


def _peaks(excess: np.ndarray, series: np.ndarray, k: int, share: float = 0.6) -> np.ndarray:
    """Readings over their cutoff that aren't overshadowed by a far larger departure within k readings: that one distorts their levels."""
    n = len(excess)
    top = excess.copy()
    for step in range(1, k + 1):
        same = series[step:] == series[:-step]
        top[step:] = np.maximum(top[step:], np.where(same, excess[:-step], 0))
        top[:-step] = np.maximum(top[:-step], np.where(same, excess[step:], 0))
    return (excess > 1) & (excess >= share * top) if n else np.zeros(0, bool)


def _from_normal(v: np.ndarray, series: np.ndarray, at: np.ndarray, normal: np.ndarray, k: int) -> np.ndarray:
    """How far the readings ``at`` lie beyond the levels of the k normal readings on either side, in one direction."""
    place = np.searchsorted(normal, at)
    sides = []
    for steps in (-np.arange(1, k + 1), np.arange(k)):
        i = place[:, None] + steps
        inside = (i >= 0) & (i < len(normal))
        who = normal[np.where(inside, i, 0)]
        w = np.where(inside & (series[who] == series[at][:, None]), v[who], np.nan)
        w.sort(axis=1)
        c = (~np.isnan(w)).sum(axis=1)
        row = np.arange(len(at))
        sides.append(v[at] - np.where(c > 0, (w[row, np.maximum((c - 1) // 2, 0)] + w[row, np.minimum(c // 2, k - 1)]) / 2, np.nan))
    a, b = sides
    return np.nan_to_num(np.where(np.sign(a) == np.sign(b), np.minimum(np.abs(a), np.abs(b)), 0.0))


def residual_bins(z: np.ndarray, grid: float) -> np.ndarray:
    """Histogram of residuals; the last bin holds what lies beyond ``TOP``. Histograms of parts add up to the whole's."""
    last = int(TOP / BIN)
    out = np.zeros(last + 1)
    if not grid:
        np.add.at(out, np.minimum((z / BIN).astype(int), last), 1.0)
        return out
    for v, n in zip(*np.unique(np.round(z / grid) * grid, return_counts=True)):
        lo, hi = round(max(v - grid / 2, 0.0) / BIN), round((v + grid / 2) / BIN)
        if hi <= last:
            out[lo:hi] += n / (hi - lo)
        else:
            out[last] += n
    return out


def pooled_tail(bins: np.ndarray, rules: Rules) -> Tail | None:
    """The tail of all sources' residuals, by probability-weighted moments; None without residuals above the threshold.

    A tail must not be widened by the spikes that it shall judge: the fit starts from the median excess, and
    leaves out what lies beyond its own quantile at ``trim`` until that stays.
    """
    total = bins.sum()
    if not total:
        return None
    at = int(np.searchsorted(np.cumsum(bins), rules.threshold * total))
    u, y = (at + 1) * BIN, (np.arange(at + 1, len(bins)) - at - 0.5) * BIN
    w = bins[at + 1 :]
    if not w.sum():
        return None
    half = float(y[min(np.searchsorted(np.cumsum(w), w.sum() / 2), len(y) - 1)])
    tail = Tail(u, 0.0, half / np.log(2), float(w.sum() / total))
    for _ in range(100):
        keep = (y <= tail.over(rules.trim)) & (np.arange(len(y)) < len(y) - 1)
        v, k = y[keep], w[keep]
        n = k.sum()
        if n < 5:
            break
        b0 = (k * v).sum() / n
        b1 = (k * v * (1 - (np.cumsum(k) - k / 2) / n)).sum() / n
        if b0 - 2 * b1 <= 0:
            break
        shape = float(2 - b0 / (b0 - 2 * b1)) * n / (n + SHAPE_PEAKS)
        new = Tail(u, shape, float(b0 * (1 - shape)), float(n / total))
        if abs(new.over(rules.trim) - tail.over(rules.trim)) < BIN / 2:
            return new
        tail = new
    return tail


def source_cutoff(z: np.ndarray, pool: Tail, rules: Rules) -> float:
    """A source's cutoff, in units of its usual move: own threshold and scale, the latter beside the pool's weight; the pool's shape."""
    own = len(z) >= rules.own_threshold
    u = float(np.quantile(z, rules.threshold)) if own else pool.threshold
    y = np.sort(z[z > u]) - u
    over = pool.over(rules.risk)
    for _ in range(100):
        n = int(np.searchsorted(y, over, side="right"))
        scale = (y[:n].sum() * (1 - pool.shape) + rules.pool_weight * pool.scale) / (n + rules.pool_weight)
        new = pool.over(rules.risk, scale)
        if abs(new - over) < 1e-9:
            break
        over = new
    return u + over


def _runs(v: np.ndarray, series: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values within series."""
    new = np.r_[True, (v[1:] != v[:-1]) | (series[1:] != series[:-1])]
    start = np.flatnonzero(new)
    return start, np.diff(np.r_[start, len(v)])


def _stuck(v: np.ndarray, series: np.ndarray, check: np.ndarray | None, rules: Rules) -> np.ndarray:
    out = np.zeros(len(v), bool)
    start, length = _runs(v, series)
    if check is not None:
        off = ~np.isnan(check) & (check != v)
        for s, n in zip(start[length > rules.stuck_moving], length[length > rules.stuck_moving]):
            wrong = np.flatnonzero(off[s : s + n])
            if len(wrong) >= rules.stuck_moving and len(np.unique(check[s : s + n][off[s : s + n]])) > 1:
                out[s + max(wrong[0], 1) : s + wrong[-1] + 1] = True
        return out
    runs = pd.DataFrame({"s": series[start], "start": start, "n": length})
    for _, r in runs.groupby("s", sort=False):
        n = r["n"].to_numpy()
        if n.max() < rules.stuck_least:
            continue
        total, odd = n.sum(), np.zeros(len(n), bool)
        for _ in range(len(n)):  # the longest run is judged by the rest; a stuck run leaves the rest, then the next
            rest = n[~odd]
            if len(rest) < 2:
                break
            longest = rest.max()
            others = rest.sum() - longest
            same = (others - (len(rest) - 1) + 0.5) / (others + 1)
            if longest < rules.stuck_least or total * same ** (longest - 1) >= rules.stuck_risk:
                break
            odd |= n == longest
        for s, k in zip(r["start"].to_numpy()[odd], n[odd]):
            out[s + 1 : s + k] = True
    return out


def _standard(x: np.ndarray, far: np.ndarray, s: np.ndarray, rules: Rules):
    """Per source of readings ordered by source: its slice, usual move and residuals in usual moves; sources that never move have none."""
    edge = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
    for a, b in zip(edge[:-1], edge[1:]):
        move = np.abs(np.diff(x[a:b]))
        move = move[move > 0]
        if b - a >= 3 and len(move):
            unit = float(np.median(move)) if rules.by_moves else 1.0
            yield slice(a, b), unit, far[a:b] / unit


def _certain(v: np.ndarray, series: np.ndarray, check: np.ndarray | None, rules: Rules) -> np.ndarray:
    """The reasons that need no tail: impossible and stuck."""
    reason = np.full(len(v), "", dtype=object)
    reason[(v < rules.lowest) | (v > rules.highest)] = "impossible"
    reason[_stuck(v, series, check, rules) & (reason == "")] = "stuck"
    return reason


def residuals(v: np.ndarray, series: np.ndarray, month: np.ndarray, check: np.ndarray | None, rules: Rules) -> np.ndarray:
    """Histogram of the residuals of readings that may be normal, for the pool."""
    keep = np.flatnonzero(_certain(v, series, check, rules) == "")
    x, s = v[keep], series[keep]
    if not len(x):
        return residual_bins(np.zeros(0), rules.grid)
    far = departures(x, s, month[keep], rules.window)
    parts = [z for _, _, z in _standard(x, far, s, rules)]
    return residual_bins(np.concatenate(parts) if parts else np.zeros(0), rules.grid)


def judge(v: np.ndarray, series: np.ndarray, month: np.ndarray, check: np.ndarray | None, rules: Rules, pool: Tail | None = None) -> np.ndarray:
    """Reason per reading ('' if believable); readings ordered by series and date. Without a pool these readings are their own."""
    reason = _certain(v, series, check, rules)
    pool = pool or pooled_tail(residuals(v, series, month, check, rules), rules)
    if pool is None:
        return reason
    spike, limit = np.zeros(len(v), bool), np.full(len(v), np.inf)
    while True:  # each round flags some reading, or is the last
        keep = np.flatnonzero((reason == "") & ~spike)  # what is wrong already makes no level
        if not len(keep):
            break
        x, s = v[keep], series[keep]
        far = departures(x, s, month[keep], rules.window)
        cut = np.full(len(x), np.inf)
        for part, unit, z in _standard(x, far, s, rules):
            cut[part] = unit * source_cutoff(z, pool, rules)
        limit[keep] = cut
        new = keep[_peaks(far / cut, s, rules.window)]
        if not len(new):
            break
        spike[new] = True
    # Flagged readings are held once more against what is left as normal, near and nearest: one beside a spike, or the
    # top of a slide up and down again, is none.
    for k in (rules.window, 2, rules.window, 2):
        at = np.flatnonzero(spike)
        normal = np.flatnonzero((reason == "") & ~spike)
        if len(at) and len(normal):
            spike[at[_from_normal(v, series, at, normal, k) <= limit[at]]] = False
    reason[spike] = "spike"
    return reason


def _sharded(readings: DataFrame, keys: list[str], most: int, halo: int) -> DataFrame:
    """Readings with ``shard``, ``part`` and ``own``: sources of more than ``most`` readings cut by days (a single overfull day by ids), others whole.

    The shards of such a source are equal spans of days; a reading near a border also goes to the neighbour, not its own.
    """
    big = readings.groupBy(*(F.col(k).alias(f"b_{k}") for k in keys)).agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("lo"), F.max("day").alias("hi")).filter(F.col("n") > most)
    big = cut_lineage(big)  # one row per large source
    large = big.count()
    if not large:
        return readings.withColumn("shard", F.lit(0).cast("bigint")).withColumn("own", F.lit(True)).withColumn("part", F.lit(0))
    if large <= BROADCAST_SOURCES:
        big = F.broadcast(big)
    same = F.col("b_" + keys[0]).eqNullSafe(F.col(keys[0]))
    for k in keys[1:]:
        same = same & F.col(f"b_{k}").eqNullSafe(F.col(k))
    span = F.col("hi") - F.col("lo") + 1
    length = F.greatest(F.ceil(span / F.ceil(F.col("n") / most)), F.lit(1))
    edge = F.ceil(halo * span / F.col("n"))
    at = F.col("day") - F.col("lo")
    home = F.floor(at / length)
    inside = at - home * length

    def place(shard, own: bool):
        return F.struct(shard.cast("bigint").alias("shard"), F.lit(own).alias("own"))

    whole = place(F.lit(0), True)
    places = F.array_compact(
        F.array(
            F.when(F.col("n").isNull(), whole).otherwise(place(home, True)),
            F.when(F.col("n").isNotNull() & (inside < edge) & (home > 0), place(home - 1, False)),
            F.when(F.col("n").isNotNull() & (length - inside <= edge), place(home + 1, False)),
        )
    )
    cut = readings.join(big, same, "left").withColumn("p", F.explode(places))
    cut = cut.select(*keys, "day", "value", "check", "first", "p.shard", "p.own", "n", length.alias("length"))
    # A day that alone exceeds a shard: equal shares by a hash of the id.
    crowded = F.greatest(F.ceil(F.col("n") / most), F.lit(1)).cast("int")
    part = F.when(F.col("n").isNotNull() & (F.col("length") == 1), F.pmod(F.xxhash64("first"), crowded)).otherwise(0)
    return cut.withColumn("part", part).drop("n", "length")


def implausible_fields(
    df: DataFrame, source: list[str], date: str, row_id: str, fields: dict[str, Rules], checks: dict[str, str] | None = None, bucket_rows: int = BUCKET_ROWS, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """``field_name, row_id, reason`` of every row and field whose value can't be right for its source.

    NULL and NaN values are missing, not implausible; rows with a NULL source part form a source with that part
    NULL, rows with a NULL date are judged for impossible values only.  Sources with fewer than three
    distinct readings get no spikes.  Copies are flagged together.  Empty tables give no rows; other columns are ignored.
    """
    keys, names, checks = ["field", *(f"k{i}" for i in range(len(source)))], list(fields), checks or {}
    cells = F.array(
        *(F.struct(F.lit(i).alias("field"), F.col(f).cast("double").alias("value"), (F.col(checks[f]).cast("double") if f in checks else F.lit(None).cast("double")).alias("check")) for i, f in enumerate(names))
    )
    seen = F.filter(cells, lambda c: c["value"].isNotNull() & ~F.isnan(c["value"]))
    rows = df.select(
        *(F.col(c).alias(k) for c, k in zip(source, keys[1:])), F.unix_date(F.col(date).cast("date")).alias("day"), F.col(row_id).cast("bigint").alias("id"), F.explode(seen).alias("c"),
    ).select("c.field", *keys[1:], "day", "c.value", "c.check", "id")
    readings = rows.filter("day IS NOT NULL").groupBy(*keys, "day", "value", "check").agg(F.min("id").alias("first"))
    readings = written(readings, "readings")  # read for the large sources, the pool and the verdicts
    buckets = max(8, -(-readings.count() // bucket_rows))  # footers only
    key = F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys), "shard", "part")
    dealt = _sharded(readings, keys, shard_rows, HALO_ROWS).withColumn("bucket", F.pmod(key, F.lit(buckets)))

    def arrays(pdf: pd.DataFrame):
        """The bucket in order, and per field its part, readings, series, months and check values."""
        pdf = pdf.sort_values([*keys, "shard", "part", "day", "first"], kind="stable", ignore_index=True)
        pdf["series"] = pdf.groupby([*keys, "shard", "part"], dropna=False, sort=False).ngroup()
        for i, part in pdf.groupby("field", sort=False):
            month = part["day"].to_numpy().astype("datetime64[D]").astype("datetime64[M]").astype(int) % 12
            yield int(i), part, (part["value"].to_numpy(), part["series"].to_numpy(), month, part["check"].to_numpy() if names[int(i)] in checks else None)

    def survey(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for i, _, readings_ in arrays(pdf):
            bins = residuals(*readings_, fields[names[i]])
            parts.append(pd.DataFrame({"field": i, "bin": np.flatnonzero(bins), "n": bins[bins > 0]}))
        return pd.concat(parts)

    pools: dict[int, Tail | None] = dict.fromkeys(range(len(names)))
    found = dealt.groupBy("bucket").applyInPandas(survey, "field int, bin int, n double").groupBy("field", "bin").agg(F.sum("n").alias("n")).toPandas()  # at most TOP / BIN rows a field
    for i, part in found.sort_values(["field", "bin"]).groupby("field"):
        bins = np.zeros(int(TOP / BIN) + 1)
        bins[part["bin"].to_numpy()] = part["n"].to_numpy()
        pools[int(i)] = pooled_tail(bins, fields[names[int(i)]])

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, part, readings_ in arrays(pdf):
            reason = judge(*readings_, fields[names[i]], pools[i])
            out.append(part.assign(reason=reason).loc[(reason != "") & part["own"].to_numpy(bool), [*keys, "day", "value", "check", "reason"]])
        return pd.concat(out)

    schema = ", ".join([*(f"{k} {readings.schema[k].dataType.simpleString()}" for k in keys), "day int, value double, check double, reason string"])
    flagged = dealt.groupBy("bucket").applyInPandas(work, schema)
    on = (F.col("r.day") == F.col("f.day")) & (F.col("r.field") == F.col("f.field")) & (F.col("r.value") == F.col("f.value"))
    for k in [*keys[1:], "check"]:
        on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}"))
    dated = rows.filter("day IS NOT NULL").alias("r").join(flagged.alias("f"), on).select("r.field", "r.id", "f.reason")
    low, high = (F.element_at(F.lit([float(getattr(fields[f], end)) for f in names]), F.col("field") + 1) for end in ("lowest", "highest"))
    undated = rows.filter(F.col("day").isNull() & ((F.col("value") < low) | (F.col("value") > high))).select("field", "id", F.lit("impossible").alias("reason"))
    name = F.element_at(F.lit(names), F.col("field") + 1)
    return dated.unionByName(undated).select(name.alias("field_name"), F.col("id").alias(row_id), "reason")


def implausible(df: DataFrame, source: list[str], date: str, value: str, row_id: str, rules: Rules, check: str | None = None, bucket_rows: int = BUCKET_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``row_id, reason`` of :func:`implausible_fields` for a single field."""
    return implausible_fields(df, source, date, row_id, {value: rules}, {value: check} if check else None, bucket_rows, shard_rows).drop("field_name")
