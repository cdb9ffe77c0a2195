"""Top N items of every group by merging sorted runs with a loser tree.

The items are written once as runs in the shared folder: a run is a partition of the input, ordered by group and
score where it lies.  A run keeps at most N items of a group (no later item can enter the top N), so nothing but candidates ever
moves, and however large a group is, it brings at most N items a run.  The stored items are then dealt to buckets of whole
groups, as many as their number asks for.  A run's items reach a bucket in their stored order, so a task merges the
bucket's runs with a loser tree as they are and, after N outputs of a group, seeks in every run to the next group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shuffle_width, written

#: Stored items that a bucket should hold on average.
BUCKET_ITEMS = 250_000


class LoserTree:
    """Tournament over the heads of k sorted runs; a head is any comparable, None when the run has ended."""

    def __init__(self, heads: list):
        self.k = len(heads)
        self.heads = heads
        self.losers = [0] * self.k
        winners = [0] * self.k + list(range(self.k))
        for i in range(self.k - 1, 0, -1):
            a, b = winners[2 * i], winners[2 * i + 1]
            winners[i], self.losers[i] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def replace(self, run: int, head) -> None:
        """The winner's run has a new head: replay its matches."""
        self.heads[run] = head
        w, i = run, (run + self.k) // 2
        while i:
            if self._before(self.losers[i], w):
                w, self.losers[i] = self.losers[i], w
            i //= 2
        self.winner = w


def _truncate(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The first n rows of every group of rows that arrive ordered by group."""
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("grp")
        at = np.arange(batch.num_rows)
        new = np.r_[True, pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)]
        start = np.maximum.accumulate(np.where(new, at, 0))
        place = at - start
        if key[0].as_py() == last:
            place[start == 0] += seen
        last, seen = key[-1].as_py(), int(place[-1]) + 1
        yield batch.filter(pa.array(place < n))


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[list[int], list[int], list[int]]:
    """Merge runs of (group, score, tie) ordered by (group, score desc, tie): run, position and rank of every output."""
    starts = []  # per run, where each group begins, and its end
    for g, _, _ in runs:
        cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
        starts.append((dict(zip(g[cut].tolist(), range(len(cut)))), np.r_[cut, len(g)]))
    lists = [(g.tolist(), (-s).tolist(), t.tolist()) for g, s, t in runs]
    pos = [0] * len(runs)

    def head(r: int):
        g, s, t = lists[r]
        return (g[pos[r]], s[pos[r]], t[pos[r]]) if pos[r] < len(g) else None

    tree = LoserTree([head(r) for r in range(len(runs))])
    out_run, out_pos, out_rank = [], [], []
    group, taken = None, 0
    while tree.heads[tree.winner] is not None:
        r = tree.winner
        g = tree.heads[r][0]
        if g != group:
            group, taken = g, 0
        if taken < n:
            taken += 1
            out_run.append(r)
            out_pos.append(pos[r])
            out_rank.append(taken)
            pos[r] += 1
        else:  # seek: the rest of this run's group can't come out
            where, cut = starts[r]
            pos[r] = int(cut[where[g] + 1])
        tree.replace(r, head(r))
    return out_run, out_pos, out_rank


def _in_order(grp: pa.Array, score: pa.Array, tie: pa.Array, h: pa.Array) -> bool:
    """Whether rows are ordered by group, score downwards, tie and hash."""
    equal, ok = None, None
    for c, upwards in ((grp, True), (score, False), (tie, True), (h, True)):
        before, after = (c[:-1], c[1:]) if upwards else (c[1:], c[:-1])
        less, same = pc.less(before, after), pc.equal(before, after)
        ok = less if ok is None else pc.or_(ok, pc.and_(equal, less))
        equal = same if equal is None else pc.and_(equal, same)
    return bool(pc.all(pc.or_(ok, equal), min_count=0).as_py())


def _merge_bucket(bucket: pa.Table, n: int) -> tuple[pa.Table, list[int]]:
    """The bucket's first n rows of every group, and their ranks.

    Runs are told apart by a stable partition that keeps the stored order; only a run that was read in pieces (a
    file of several splits) is sorted anew.
    """
    runs, parts = [], []
    for r in pc.unique(bucket["run"]).to_pylist():
        part = bucket.filter(pc.equal(bucket["run"], r)).combine_chunks()
        cols = [part[c].combine_chunks() if isinstance(part[c], pa.ChunkedArray) else part[c] for c in ("grp", "score", "tie", "h")]
        if not _in_order(*cols):
            part = part.sort_by([("grp", "ascending"), ("score", "descending"), ("tie", "ascending"), ("h", "ascending")])
        parts.append(part)
        runs.append((part["grp"].to_numpy(), part["score"].to_numpy(), part["tie"].to_numpy()))
    run, at, rank = merge_runs(runs, n)
    base = np.cumsum([0, *(len(p) for p in parts)])
    return pa.concat_tables(parts).take(pa.array(base[np.array(run, dtype=int)] + np.array(at, dtype=int))), rank


def top_n(df: DataFrame, group: list[str], score: str, tie: str, n: int, bucket_items: int = BUCKET_ITEMS) -> DataFrame:
    """The n rows of each group with the highest score, ties by ``tie`` upwards, with ``rank_in_group`` from 1.

    Rows with a NULL or NaN score don't take part.  NULL is a group value like any other; NULL ties come
    first; rows equal in score and tie keep an arbitrary but single place each, in order of the
    remaining columns' hash.  The columns of ``df`` come out as they are, with any names but
    ``rank_in_group``.  An empty table gives an empty result.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    spark = df.sparkSession
    payload = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    rows = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).select(
        F.to_json(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(group))), {"ignoreNullFields": "false"}).alias("grp"),
        F.col(score).cast("double").alias("score"), F.coalesce(F.col(tie).cast("string"), F.lit("")).alias("tie"), payload.alias("row"),
    )
    rows = rows.withColumn("h", F.xxhash64("row"))
    keyed = rows.sortWithinPartitions("grp", F.desc("score"), "tie", "h").withColumn("run", F.spark_partition_id())
    stored = written(keyed.mapInArrow(lambda b: _truncate(b, n), keyed.schema), "runs")
    buckets = max(shuffle_width(spark), -(-stored.count() // bucket_items))  # footers only

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            out, rank = _merge_bucket(pa.Table.from_batches(held), n)
            table = pa.table({"row": out["row"], "rank_in_group": pa.array(rank, pa.int32())})
            yield from table.to_batches()

    out = T.StructType([T.StructField("row", stored.schema["row"].dataType), T.StructField("rank_in_group", T.IntegerType())])
    merged = stored.repartition(buckets, "grp").mapInArrow(merge, out)  # the exchange appends a run's blocks as they were stored
    return merged.select(*(F.col(f"row.`{c}`") for c in df.columns), "rank_in_group")


def latest_scored(signals: DataFrame) -> DataFrame:
    """Per run, date and issuer the row scored last (then the smallest id), if it is scored at all.

    NULL scoring times count as the earliest.  Map-side combined: no group travels whole.
    """
    s = signals.select("run_id", "rebal_date", "country_code", "signal_id", "predicted_excess_return", "signal_status", "scored_at")
    return (
        s.groupBy("run_id", "rebal_date", "country_code")
        .agg(F.max(F.struct("scored_at", (-F.col("signal_id")).alias("neg_id"), "predicted_excess_return", "signal_status")).alias("l"))
        .filter(F.col("l.signal_status") == "scored")
        .select("run_id", "rebal_date", "country_code", (-F.col("l.neg_id")).alias("signal_id"), F.col("l.predicted_excess_return").alias("predicted_excess_return"))
    )
