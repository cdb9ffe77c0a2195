"""Groups of like records of any shape, by mergeable cluster-feature trees.

Every partition grows a cluster-feature tree, in any number of dimensions: a leaf sums up (count, sums, squared norms) the
records that it absorbs, those of one cell of side ``cell``; an inner node sums up the nodes below it, those of a cell of twice the
side.  Trees over the same nested cells merge by adding their nodes, so they are reduced by map-side combined aggregation, in
any order and with the same result.  If the leaves outgrow ``max_leaves`` the tree is cut at the lowest level that
fits, and lengths that its cells outgrow grow with them.

The driver, which receives at most ``max_leaves`` summaries, tells dense leaves from background (the background's own density is
estimated from the leaves, so the rule is the same at any number of rows), and works on the dense leaves in two steps.  Ward's
criterion agglomerates touching leaves to compact micro-clusters, until no merge stays within the radius ``grain``.
Ward alone splits rings and crescents, so micro-clusters are then joined over saddles: from the densest saddle down, two
parts in touch join unless the saddle between them is clearly emptier than the micro-clusters at both parts' peaks.
A full pass then assigns every record to its dense leaf's group, or to that of the nearest dense leaf within ``attach``.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.hot_deck import NUMERIC_PLACEHOLDERS, holds_number
from ..session import cut_lineage, written


@dataclass(frozen=True)
class Shape:
    """Lengths in the units of the coordinates."""

    cell: float = 0.2  #: side of a leaf's cell: what lies in it is absorbed
    reach: float = 0.35  #: radius in which the density of a leaf is counted
    contact: float = 0.55  #: distance of leaf centroids that touch
    attach: float = 0.5  #: farthest a record may lie from its nearest dense leaf
    grain: float = 1.0  #: largest radius (root mean square) of a micro-cluster
    saddle: float = 0.15  #: share of the lower peak below which a saddle is clearly emptier, if the difference is
    doubt: float = 4.0  #: more than so many standard deviations
    least: int = 10  #: records of the smallest group
    max_leaves: int = 60_000  #: leaves that the driver and a partition hold at most

    def at_level(self, level: int) -> Shape:
        """The shape for a tree cut at that level: no length is less, in cells, than the class's own lengths are."""
        side, own = self.cell * 2.0**level, Shape
        longer = {k: max(getattr(self, k), getattr(own, k) / own.cell * side) if level else getattr(self, k) for k in ("reach", "contact", "attach", "grain")}
        return replace(self, cell=side, **longer)


class FeatureTree:
    """A cluster-feature tree: level 0 holds the leaves, every level above it the sums of the cells of twice the side."""

    def __init__(self, cell: float, most: int):
        self.cell, self.most, self.cut = cell, most, 0
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def _sum(at: np.ndarray, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes of equal cells added up."""
        cells, where = np.unique(at, axis=0, return_inverse=True)
        where = where.ravel()
        sums = np.stack([np.bincount(where, c, len(cells)) for c in ls.T], axis=1) if len(cells) else ls[:0]
        return cells, np.bincount(where, n, len(cells)).astype(np.int64), sums, np.bincount(where, ss, len(cells))

    def _grow(self, leaves: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> None:
        """The inner nodes above new leaves, up to a level that the limit of leaves allows, and the cut below it."""
        self.levels = [leaves]
        while len(self.levels[-1][0]) > self.most:
            at, n, ls, ss = self.levels[-1]
            self.levels.append(self._sum(at >> 1, n, ls, ss))
        self.cut += len(self.levels) - 1
        self.levels = self.levels[-1:]

    def insert(self, x: np.ndarray) -> None:
        """Absorb records."""
        at = np.floor(x / self.cell).astype(np.int64) >> self.cut
        self.merge(at, np.ones(len(x), np.int64), x, (x**2).sum(axis=1))

    def merge(self, at: np.ndarray, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> None:
        """Add the leaves of another tree of the same cells."""
        if self.levels:
            at, n, ls, ss = (np.concatenate([a, b]) for a, b in zip(self.levels[0], (at, n, ls, ss)))
        self._grow(self._sum(at, n, ls, ss))


_CF = "level int, at array<bigint>, n bigint, ls array<double>, ss double"


def _points(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["x"].tolist(), dtype=float)


def _leaves(batches: Iterator[pd.DataFrame], cell: float, most: int) -> Iterator[pd.DataFrame]:
    """The cluster-feature tree of a partition, as its leaves and the level it is cut at."""
    tree = FeatureTree(cell, most)
    for pdf in batches:
        if len(pdf):
            tree.insert(_points(pdf))
    if tree.levels:
        at, n, ls, ss = tree.levels[0]
        yield pd.DataFrame({"level": tree.cut, "at": at.tolist(), "n": n, "ls": ls.tolist(), "ss": ss})


def reduce_leaves(points: DataFrame, shape: Shape) -> tuple[pd.DataFrame, int]:
    """All partitions' trees merged: at most ``max_leaves`` leaves, and the level of their cells."""
    parts = cut_lineage(points.mapInPandas(lambda b: _leaves(b, shape.cell, shape.max_leaves), _CF))
    level = parts.agg(F.max("level")).first()[0] or 0
    dims = (parts.agg(F.max(F.size("ls"))).first()[0]) or 0
    while True:
        up = (F.lit(level) - F.col("level")).cast("int")
        node = F.transform("at", lambda c: F.floor(c / F.pow(F.lit(2.0), up)))
        merged = parts.groupBy(node.alias("at")).agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("ls")[i]) for i in range(dims))).alias("ls"), F.sum("ss").alias("ss"))
        leaves = merged.limit(shape.max_leaves + 1).toPandas()
        if len(leaves) <= shape.max_leaves:
            order = sorted(range(len(leaves)), key=lambda i: tuple(leaves["at"].iloc[i]))
            return leaves.iloc[order].reset_index(drop=True), level
        level += 1


class Grid:
    """Points by cells, to find all that lie in the cells around a place."""

    def __init__(self, cells: np.ndarray, margin: int):
        self.low = cells.min(axis=0) - margin
        self.size = cells.max(axis=0) - self.low + 1 + margin
        self.step = np.r_[np.cumprod(self.size[::-1].astype(object))[::-1][1:], 1]
        self.wide = int(np.prod(self.size.astype(object))) >= 2**62  # keys beyond 64 bits are compared as Python numbers
        key = self.key(cells)
        self.order = np.argsort(key, kind="stable")
        self.ranked = key[self.order]

    def key(self, cells: np.ndarray) -> np.ndarray:
        inside = ((cells >= self.low) & (cells < self.low + self.size)).all(axis=1)
        moved = np.where(inside[:, None], cells - self.low, 0)
        k = (moved.astype(object) * self.step).sum(axis=1) if self.wide else (moved * self.step.astype(np.int64)).sum(axis=1)
        return np.where(inside, k, -1)

    def span(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the points of these cells begin and end in ``order``."""
        k = self.key(cells)
        return np.searchsorted(self.ranked, k, "left"), np.where(k == -1, 0, np.searchsorted(self.ranked, k, "right"))


def _offsets(dims: int, reach: int) -> list[np.ndarray]:
    return [np.array(o) for o in itertools.product(range(-reach, reach + 1), repeat=dims)]


def _pairs(xy: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ordered pairs of different points within reach, and their distances."""
    if not len(xy):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    cell = np.floor(xy / reach).astype(np.int64)
    grid = Grid(cell, 1)
    out_a, out_b = [], []
    for offset in _offsets(xy.shape[1], 1):
        lo, hi = grid.span(cell + offset)
        size = np.maximum(hi - lo, 0)
        a = np.repeat(np.arange(len(xy)), size)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out_a.append(a)
        out_b.append(grid.order[np.repeat(lo, size) + within])
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    d = np.sqrt(((xy[a] - xy[b]) ** 2).sum(axis=1))
    ok = (a != b) & (d <= reach)
    return a[ok], b[ok], d[ok]


def dense_leaves(n: np.ndarray, xy: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, float]:
    """Which leaves lie in dense regions, the records within reach of every leaf, and the size of the lumps in which they come.

    The background's density is what the leaves outside dense regions hold on the volume outside; a leaf is
    dense if its neighbourhood holds more than six standard deviations (and three records) beyond that.  Copies make the
    background lumpy: its records count as arriving in lumps of the size that the leaves' second moment shows.
    """
    if not len(n):
        return np.zeros(0, bool), np.zeros(0), 1.0
    a, b, _ = _pairs(xy, shape.reach)
    count = n + np.bincount(a, n[b], minlength=len(n))
    dims = xy.shape[1]
    ball, cell = math.pi ** (dims / 2) / math.gamma(dims / 2 + 1) * shape.reach**dims, shape.cell**dims
    order = np.argsort(xy, axis=0)
    spans = []
    for k in range(dims):  # the volume that all but the outermost thousandths of the records span
        w = np.cumsum(n[order[:, k]]) / n.sum()
        spans.append(max(xy[order[min(np.searchsorted(w, 0.999), len(n) - 1), k], k] - xy[order[np.searchsorted(w, 0.001), k], k], shape.cell))
    volume = max(float(np.prod(spans)), cell)
    rate, lump, dense = n.sum() / volume, 1.0, np.zeros(len(n), bool)
    for _ in range(20):
        now = count >= rate * ball + 6 * np.sqrt(rate * ball * lump) + 3 * lump
        if (now == dense).all():
            break
        out = n[~now].astype(float)
        dense, rate = now, out.sum() / max(volume - now.sum() * cell, 0.05 * volume)
        lump = max(1.0, (out**2).sum() / out.sum() - rate * cell) if len(out) else 1.0
    return dense, count, lump


def ward(n: np.ndarray, ls: np.ndarray, ss: np.ndarray, a: np.ndarray, b: np.ndarray, grain: float) -> np.ndarray:
    """Micro-cluster of every leaf: touching groups merged by least Ward loss, while the merged radius stays within ``grain``."""
    size, sums, norms = n.astype(float).tolist(), [np.asarray(v) for v in ls], ss.tolist()
    near: list[set[int]] = [set() for _ in range(len(n))]
    for i, j in zip(a.tolist(), b.tolist()):
        near[i].add(j)

    def offer(i: int, j: int) -> None:
        gap = sums[i] / size[i] - sums[j] / size[j]
        total = size[i] + size[j]
        both = sums[i] + sums[j]
        if (norms[i] + norms[j]) / total - float(both @ both) / total**2 <= grain**2:
            heapq.heappush(heap, (size[i] * size[j] / total * float(gap @ gap), i, j))

    heap: list[tuple[float, int, int]] = []
    for i, j in zip(a.tolist(), b.tolist()):
        if i < j:
            offer(i, j)
    parent = list(range(len(n)))
    while heap:
        _, i, j = heapq.heappop(heap)
        if parent[i] != i or parent[j] != j:
            continue
        k = len(parent)  # a new node of the dendrogram
        parent[i] = parent[j] = k
        parent.append(k)
        size.append(size[i] + size[j])
        sums.append(sums[i] + sums[j])
        norms.append(norms[i] + norms[j])
        around = {m for m in near[i] | near[j] if parent[m] == m and m not in (i, j)}
        near.append(around)
        near[i] = near[j] = set()
        for m in around:
            near[m] -= {i, j}
            near[m].add(k)
            offer(m, k)

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    return np.array([root(i) for i in range(len(n))], dtype=np.int64)


def join_over_saddles(micro: np.ndarray, n: np.ndarray, count: np.ndarray, a: np.ndarray, b: np.ndarray, lump: float, shape: Shape) -> np.ndarray:
    """Group of every leaf: micro-clusters joined over saddles, the densest first.

    The level of a micro-cluster is the mean neighbourhood of its records, a saddle the densest contact between two. Two parts
    stay apart where the saddle lies below the share ``saddle`` of the lower of both parts' highest levels, and significantly so.
    """
    if not len(n):
        return micro
    level = pd.Series(n * count, dtype=float).groupby(micro).sum() / pd.Series(n, dtype=float).groupby(micro).sum()
    cross = micro[a] < micro[b]
    edges = pd.DataFrame({"i": micro[a[cross]], "j": micro[b[cross]], "s": np.minimum(count[a[cross]], count[b[cross]])})
    edges = edges.groupby(["i", "j"], as_index=False)["s"].max().sort_values(["s", "i", "j"], ascending=[False, True, True])
    parent = {m: m for m in level.index.tolist()}
    peak = level.to_dict()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j, s in edges.itertuples(index=False):
        p, q = root(int(i)), root(int(j))
        if p == q:
            continue
        low = min(peak[p], peak[q])
        if s < shape.saddle * low and low - s > shape.doubt * math.sqrt(lump * (low + s)):
            continue
        parent[q] = p
        peak[p] = max(peak[p], peak[q])
    return np.array([root(int(m)) for m in micro.tolist()], dtype=np.int64)


def assign(x: np.ndarray, leaf_x: np.ndarray, leaf_cell: np.ndarray, leaf_group: np.ndarray, side: float, attach: float) -> np.ndarray:
    """Group of every record: that of its own cell's dense leaf, else of the nearest dense leaf within attach, else -1."""
    out = np.full(len(x), -1, dtype=np.int64)
    if not len(x) or not len(leaf_x):
        return out
    grid, own = Grid(leaf_cell, 0), np.floor(x / side).astype(np.int64)

    def find(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = grid.span(cells)
        return hi > lo, grid.order[np.minimum(lo, len(grid.order) - 1)]

    hit, leaf = find(own)
    out[hit] = leaf_group[leaf[hit]]
    rest = np.flatnonzero(~hit)
    best = np.full(len(rest), attach)
    for offset in _offsets(x.shape[1], int(np.ceil(attach / side)) + 1):
        hit, leaf = find(own[rest] + offset)
        d = np.where(hit, np.sqrt(((x[rest] - leaf_x[leaf]) ** 2).sum(axis=1)), np.inf)
        nearer = d <= best
        best[nearer] = d[nearer]
        out[rest[nearer]] = leaf_group[leaf[nearer]]
    return out


def group_leaves(leaves: pd.DataFrame, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, centroids, cells and groups of the dense leaves; ``shape`` has the lengths of the leaves' level."""
    if not len(leaves):
        return np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros((0, 1), np.int64), np.zeros(0, np.int64)
    n = leaves["n"].to_numpy(dtype=np.int64)
    ls = np.array(leaves["ls"].tolist(), dtype=float).reshape(len(n), -1)
    ss, cells = leaves["ss"].to_numpy(dtype=float), np.array(leaves["at"].tolist(), dtype=np.int64).reshape(len(n), -1)
    dense, count, lump = dense_leaves(n, ls / np.maximum(n, 1)[:, None], shape)
    n, ls, ss, cells, count = n[dense], ls[dense], ss[dense], cells[dense], count[dense]
    x = ls / np.maximum(n, 1)[:, None]
    a, b, _ = _pairs(x, shape.contact)
    group = join_over_saddles(ward(n, ls, ss, a, b, shape.grain), n, count, a, b, lump, shape)
    return n, x, cells, group


def cluster(df: DataFrame, row_id: str, coordinates: list[Column], shape: Shape = Shape()) -> DataFrame:
    """``row_id, cluster_id, x, from_centre`` of every record that belongs to a cluster; ``x`` is the array of its coordinates.

    ``cluster_id`` is the smallest row id of the cluster.  Records with a NULL or NaN coordinate don't take part, nor do records
    outside dense regions.  Groups of fewer than ``least`` records are no clusters.  Repeated records count
    each.  An empty table has no clusters.  Other columns are ignored.
    """
    points = df.select(F.col(row_id).cast("bigint").alias("id"), F.array(*(c.cast("double") for c in coordinates)).alias("x"))
    points = points.filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e12)))
    leaves, level = reduce_leaves(points.select("x"), shape)
    shape = shape.at_level(level)
    n, x, cells, group = group_leaves(leaves, shape)
    weight = pd.Series(n, dtype=float).groupby(group)
    centre = {g: np.average(x[i], axis=0, weights=n[i]) for g, i in weight.indices.items()} if len(n) else {}

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = _points(pdf).reshape(len(pdf), -1)
            g = assign(at, x, cells, group, shape.cell, shape.attach)
            keep = g >= 0
            pdf, g, at = pdf[keep], g[keep], at[keep]
            mid = np.array([centre[k] for k in g.tolist()]).reshape(at.shape)
            yield pdf.assign(label=g, from_centre=np.sqrt(((at - mid) ** 2).sum(axis=1)))

    # The one assignment pass, written: the groups' least ids and sizes and the answer are read from it.
    labelled = written(points.mapInPandas(label, "id bigint, x array<double>, label bigint, from_centre double"), "labels")
    groups = labelled.groupBy("label").agg(F.min("id").alias("cluster_id"), F.count(F.lit(1)).alias("size")).filter(F.col("size") >= shape.least)
    # At most one row per group of leaves, so never more than max_leaves rows.
    return labelled.join(F.broadcast(groups.select("label", "cluster_id")), "label").select(F.col("id").alias(row_id), "cluster_id", "x", "from_centre")


def describe(members: DataFrame, row_id: str, typical: int = 5) -> DataFrame:
    """``cluster_id, size, centre, typical`` (the mean coordinates, and the rows nearest to the centre, nearest first)."""

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in batches:
            best = pdf if best is None else pd.concat([best, pdf])
            best = best.sort_values(["cluster_id", "from_centre", row_id]).groupby("cluster_id").head(typical)
        if best is not None:
            yield best

    slim = members.select("cluster_id", "from_centre", row_id)
    few = slim.mapInPandas(nearest, slim.schema)  # at most `typical` rows per cluster leave a partition
    w = Window.partitionBy("cluster_id").orderBy("from_centre", row_id)
    top = few.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= typical)
    lists = top.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("k", F.col(row_id).alias("row")))).alias("t"))
    axes = members.select("cluster_id", F.posexplode("x").alias("axis", "v")).groupBy("cluster_id", "axis").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("size"))
    sizes = axes.groupBy("cluster_id").agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("axis", "mean"))).alias("c"))
    return sizes.join(lists, "cluster_id").select("cluster_id", "size", F.col("c.mean").alias("centre"), F.col("t.row").alias("typical"))


def debt_and_spread(panel: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The panel rows with both observations, and the coordinates: debt_gdp / 10, and ln(spread + 200) / 0.2."""
    spread = F.col("yield_spread_bps").cast("double")
    ok = holds_number(F.col("debt_gdp").cast("double")) & holds_number(spread, NUMERIC_PLACEHOLDERS["yield_spread_bps"]) & (spread > -200)
    return panel.filter(ok), [F.col("debt_gdp") / 10, F.log(spread + 200) / 0.2]
