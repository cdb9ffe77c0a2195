"""Fixed-capacity containers filled with items by swap-based local search.

Items are dealt into blocks of bounded size by a hash of their id and copy number, so blocks resemble each
other, none grows with the data, and the containers don't depend on partitioning.  A block starts from best fit
decreasing; then its underfull containers, the emptiest first, give items away: an item moves where it fits, one item goes against one
smaller item of another container, or two items against one, whenever that raises the sum of squared fills.
Containers empty out and vanish, until a round brings no gain.  The containers that stay underfull in
their blocks are taken apart and packed together once more in blocks of leftovers.

An item larger than a container is cut into full containers of its own and one remainder, which is packed like any item.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Items to a block, and containers filled less than that are packed again.
BLOCK_ITEMS = 4000
WELL_FILLED = 0.985
#: Capacities that may be asked for at once.
MOST_CAPACITIES = 1_000


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of every item: largest first, each into the fullest container that takes it."""
    bin_of = np.zeros(len(sizes), dtype=np.int64)
    gaps: list[tuple[int, int]] = []  # (gap, container), sorted
    n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(gaps, (size, -1))
        if at < len(gaps):
            gap, b = gaps.pop(at)
        else:
            gap, b = capacity, n
            n += 1
        bin_of[i] = b
        if gap > size:
            insort(gaps, (gap - size, b))
    return bin_of


def _pair_sums(sizes: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All different sums of two of the items ``mine``, upwards, and two items of each (items of one size are alike)."""
    distinct, first, count = np.unique(sizes[mine], return_index=True, return_counts=True)
    a, b = np.triu_indices(len(distinct))
    keep = (a != b) | (count[a] > 1)
    a, b = a[keep], b[keep]
    sums, at = np.unique(distinct[a] + distinct[b], return_index=True)
    i, k = mine[first[a[at]]], mine[first[b[at]]]
    for n in np.flatnonzero(i == k).tolist():  # twice one size: the next item of that size
        k[n] = mine[np.flatnonzero(sizes[mine] == sizes[i[n]])[1]]
    return sums, i, k


def local_search(sizes: np.ndarray, bin_of: np.ndarray, capacity: int) -> np.ndarray:
    """Raise the sum of squared fills by moves, one-for-one and two-for-one exchanges until none raises it.

    Every underfull container gives, against every item of the block, in each round; every accepted step raises the sum,
    which is bounded, so the search ends.
    """
    bin_of = bin_of.copy()
    fill = np.bincount(bin_of, weights=sizes).astype(np.int64)
    gained = True
    while gained:
        gained = False
        live = np.flatnonzero((fill > 0) & (fill < capacity))
        if len(live) < 2:
            break
        for donor in live[np.argsort(fill[live], kind="stable")].tolist():
            mine = np.flatnonzero((bin_of == donor) & (sizes > 0))
            for i in mine[np.argsort(-sizes[mine], kind="stable")].tolist():
                size = int(sizes[i])
                gap = capacity - fill
                fits = np.flatnonzero((gap >= size) & (fill > 0) & (fill + size > fill[donor]))
                fits = fits[fits != donor]
                if len(fits):  # move: into the container it fills best
                    to = int(fits[np.argmin(gap[fits])])
                    bin_of[i] = to
                    fill[to] += size
                    fill[donor] -= size
                    gained = True
                    continue
                up = size - sizes  # one for one: the other container gains up
                ok = (up > 0) & (sizes > 0) & (up <= gap[bin_of]) & (fill[bin_of] + up > fill[donor]) & (bin_of != donor)
                if ok.any():
                    j = int(np.argmax(np.where(ok, up, 0)))
                    to, d = int(bin_of[j]), int(up[j])
                    bin_of[i], bin_of[j] = to, donor
                    fill[to] += d
                    fill[donor] -= d
                    gained = True
            while True:  # two for one: the largest pair that fits in the place of an item elsewhere
                mine = np.flatnonzero((bin_of == donor) & (sizes > 0))
                if len(mine) < 2:
                    break
                sums, first, second = _pair_sums(sizes, mine)
                best = np.searchsorted(sums, sizes + (capacity - fill)[bin_of], side="right") - 1
                up = sums[np.maximum(best, 0)] - sizes
                ok = (best >= 0) & (up > 0) & (sizes > 0) & (fill[bin_of] + up > fill[donor]) & (bin_of != donor)
                if not ok.any():
                    break
                j = int(np.argmax(np.where(ok, up, 0)))
                to, d = int(bin_of[j]), int(up[j])
                bin_of[first[best[j]]] = bin_of[second[best[j]]] = to
                bin_of[j] = donor
                fill[to] += d
                fill[donor] -= d
                gained = True
    return bin_of


def pack_block(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Containers 0.. of one block; items without size join the first container."""
    sizes = sizes.astype(np.int64)
    bin_of = local_search(sizes, best_fit_decreasing(sizes, capacity), capacity)
    used = np.unique(bin_of[sizes > 0])
    out = np.searchsorted(used, bin_of)
    return np.where(sizes > 0, out, 0)


_OUT = "pack_id int, capacity int, id bigint, piece int, n_tokens int, block bigint, bin bigint, fill bigint"


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["id", "piece", "n_tokens"], kind="stable")
    sizes = pdf["n_tokens"].to_numpy()
    bins = pack_block(sizes, int(pdf["capacity"].iloc[0]))
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    return pdf.assign(bin=bins, fill=fill[bins])[["pack_id", "capacity", "id", "piece", "n_tokens", "block", "bin", "fill"]]


def pack(items: DataFrame, row_id: str, size: str, capacities: DataFrame, block_items: int = BLOCK_ITEMS, n_rows: int | None = None) -> DataFrame:
    """``pack_id, row_id, piece, n_tokens, container_id``: every item of ``items`` in a container of every capacity.

    ``capacities`` has pack_id and capacity_tokens (a table of parameters: its few rows are exploded onto the items); rows
    without a positive capacity are ignored.  Items with a NULL or negative size count as
    size 0; size 0 takes no room and joins the first container of its block.  Repeated rows are items of their own.
    Pieces count from 0.  Container ids are unique within a pack_id.
    """
    caps = capacities.filter("capacity_tokens > 0").select(F.col("pack_id").cast("int"), F.col("capacity_tokens").cast("int")).limit(MOST_CAPACITIES + 1).collect()
    if len(caps) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities: they are parameters, not data")
    n = items.count() if n_rows is None else n_rows
    blocks = max(1, -(-n // block_items))
    rows = items.select(F.col(row_id).cast("bigint").alias("id"), F.greatest(F.coalesce(F.col(size).cast("int"), F.lit(0)), F.lit(0)).alias("n"))
    # Repeated rows are alike, so their copies are counted and numbered: a key that no partitioning can change.
    copies = rows.groupBy("id", "n").agg(F.count(F.lit(1)).alias("c")).select("id", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("c"))).alias("copy"))
    rows = copies.withColumn("block", F.pmod(F.xxhash64("id", "copy", "n"), F.lit(blocks)))
    asked = F.array(*(F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(c).cast("int").alias("capacity")) for p, c in sorted(map(tuple, caps), key=str))).cast("array<struct<pack_id:int,capacity:int>>")
    per = rows.select("*", F.explode(asked).alias("a")).select(*rows.columns, "a.*")  # one row per item and capacity asked for
    whole = F.when(F.col("n") > F.col("capacity"), F.floor(F.col("n") / F.col("capacity"))).otherwise(0).cast("int")
    per = per.withColumn("whole", whole).withColumn("rest", F.col("n") - F.col("whole") * F.col("capacity"))
    full = per.filter("whole > 0").select(
        "pack_id", "id", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("piece"), F.col("capacity").alias("n_tokens"),
        F.concat_ws("-", F.lit("full"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.col("n").cast("string"), F.col("copy").cast("string")).alias("owner"),
    )
    rest = per.filter("whole = 0 OR rest > 0").select("pack_id", "capacity", "id", F.col("whole").alias("piece"), F.col("rest").cast("int").alias("n_tokens"), "block")
    first = cut_lineage(rest.groupBy("pack_id", "block").applyInPandas(_pack, _OUT))
    well = (F.col("fill") >= WELL_FILLED * F.col("capacity")) | (F.col("n_tokens") == 0)
    done = first.filter(well).select("pack_id", "id", "piece", "n_tokens", F.format_string("b%d-%d", "block", "bin").alias("owner"))
    left = first.filter(~well).select("pack_id", "capacity", "id", "piece", "n_tokens", F.pmod(F.col("block"), F.lit(max(1, blocks // 32))).alias("block"))
    again = left.groupBy("pack_id", "block").applyInPandas(_pack, _OUT).select("pack_id", "id", "piece", "n_tokens", F.format_string("l%d-%d", "block", "bin").alias("owner"))
    full = full.withColumn("owner", F.concat_ws("-", "owner", F.col("piece").cast("string")))
    return done.unionByName(again).unionByName(full).select(
        "pack_id", F.col("id").alias(row_id), "piece", "n_tokens", F.col("owner").alias("container_id")
    )


def fills(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per pack: containers, tokens, the least number of containers that could hold them, and the share of room used."""
    bins = packed.groupBy("pack_id", "container_id").agg(F.sum("n_tokens").alias("t"))
    total = bins.groupBy("pack_id").agg(F.sum(F.when(F.col("t") > 0, 1).otherwise(0)).alias("n_containers"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"))
    caps = capacities.select(F.col("pack_id").cast("int"), "capacity_tokens")
    return total.join(caps, "pack_id").select(
        "pack_id", "capacity_tokens", "n_containers", "n_tokens", "fullest",
        F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"),
        F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("share_used"),
    )
