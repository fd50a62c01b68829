"""Groups of alike records: density clustering on grids, cell labels propagated in SQL."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import broadcast_checked, cut, release, table

AXES = 2


@dataclass(frozen=True)
class Grid:
    """``width`` of a cell in ranks along a direction; a dense cell holds at least ``dense`` records and a part ``share`` of
    those of its grid; the tree of grids is fitted on all records, those of a part of at most ``gathered`` in one task; a part of fewer than ``least`` records is
    not looked at, and one of which ``whole`` lies under one label is not split. A record is near a mean within ``near``
    times the median distance of records of about its length, one alike to no other within ``border`` times; two records are alike
    within ``alike`` times what their lengths let expect. A piece whose median distance from its mean is more than ``tight`` of a
    random one holds several compositions; typical distances are at most ``radius`` of a random one. More than ``centres`` labels are refused."""

    dims: int = 136
    width: float = 60.0
    dense: int = 3
    share: float = 0.01
    gathered: int = 32_768
    least: int = 8
    whole: float = 0.7
    tight: float = 0.53
    near: float = 1.25
    radius: float = 0.58
    border: float = 1.4
    alike: float = 1.15
    centres: int = 20_000

    @property
    def random(self) -> float:
        """The distance of a random rank vector from the middle of all."""
        return (self.dims * (self.dims**2 - 1) / 12) ** 0.5


def propagated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each connected component. ``edges`` (``a, b``, a table) stand in both
    directions. Each step spreads minimum labels along the edges and jumps to the label's label; it ends when nothing
    changes."""
    labels = cut(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        far = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = cut(far.join(up, "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "old"))
        changed = new.where("label <> old").limit(1).count()
        release(labels)
        labels = new
        if not changed:
            return labels.select("node", "label")


def cell_labels(cells: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """For each cell of one part (a row of integer coordinates, with its count) the index of its label's cell. Dense cells, with
    at least ``least`` records, that differ by at most one along every axis have one label; another cell takes the label
    of the fullest dense cell beside it; those without one are joined among themselves. Minimum labels spread along
    these links and jump to their label's label until none changes."""
    shifted = cells - cells.min(0) + 1
    radix = np.cumprod(np.r_[1, (shifted.max(0) + 2)[:-1]]).astype(np.int64)
    key = shifted @ radix
    order = np.argsort(key)
    key = key[order]
    dense = n[order] >= least
    pairs = []
    for step in np.ndindex(*[3] * cells.shape[1]):
        by = int((np.array(step) - 1) @ radix)
        if by > 0:  # each pair once
            at = np.minimum(np.searchsorted(key, key + by), len(key) - 1)
            hit = np.flatnonzero(key[at] == key + by)
            pairs.append((hit, at[hit]))
    a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    a, b = np.r_[a, b], np.r_[b, a]
    lean = np.full(len(key), -1)
    side = np.flatnonzero(~dense[a] & dense[b])
    side = side[np.lexsort((-b[side], n[order][b[side]]))]
    lean[a[side]] = b[side]  # the last one written is the fullest
    alone = ~dense & (lean < 0)
    link = (dense[a] & dense[b]) | (alone[a] & alone[b])
    a, b = a[link], b[link]
    label = np.arange(len(key))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    label[lean >= 0] = label[lean[lean >= 0]]
    out = np.empty(len(key), np.int64)
    out[order] = order[label]
    return out


#: The child of a cell whose part has no grid.
GONE = -(1 << 40)


@dataclass
class Node:
    """A grid: its centre and axes, the keys of its labelled cells and those beside them in order, the child of each (a node, a leaf
    as -1 - leaf, or ``GONE``), and which cells are labelled themselves (``inner``)."""

    centre: np.ndarray
    axes: np.ndarray
    width: float
    keys: np.ndarray
    children: np.ndarray
    inner: np.ndarray

    def cells(self, r: np.ndarray) -> np.ndarray:
        return np.floor((r - self.centre) @ self.axes.T / self.width).astype(np.int64)


def cell_keys(cells: np.ndarray) -> np.ndarray:
    """Cells as numbers; rank vectors reach less than 2**12 cells from their centre along an axis."""
    return (cells + (1 << 12)) @ (1 << 13) ** np.arange(cells.shape[1])


def widened_cells(cells: np.ndarray, n: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and labels of the cells with a label (not -1) and of those beside them, which take that of the fullest, and which are the former."""
    known = np.flatnonzero(label >= 0)
    steps = np.array(list(np.ndindex(*[3] * cells.shape[1]))) - 1
    near = (cells[known][:, None] + steps).reshape(-1, cells.shape[1])
    own = np.tile((steps == 0).all(1), len(known))
    keys, which = cell_keys(near), np.repeat(known, len(steps))
    order = np.lexsort((-n[which], ~own, keys))
    keys, first = np.unique(keys[order], return_index=True)
    return keys, label[which[order][first]], own[order][first]


def dense_labels(cells: np.ndarray, n: np.ndarray, grid: Grid) -> np.ndarray:
    """``cell_labels`` where a cell that is neither dense nor beside a dense one has -1."""
    least = max(grid.dense, int(np.ceil(grid.share * n.sum())))
    label = cell_labels(cells, n, least)
    return np.where(n[label] >= least, label, -1)


def directions(n: int, total: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean of ``n`` rank vectors and their directions of variance, the most first, from their sum and the sum of their products."""
    centre = total / n
    return centre, np.linalg.eigh(outer / n - np.outer(centre, centre))[1].T[::-1]


def tries(grid: Grid, axes: int) -> list[tuple[float, int]]:
    """Widths and first directions of the grids that a part may have, in the order in which they are tried."""
    return [(width, k) for width in (grid.width, 0.7 * grid.width, 0.5 * grid.width) for k in range(0, min(6, axes - AXES + 1), AXES)]


Cells = tuple[np.ndarray, np.ndarray]


def grid_by(count: Callable[[int], Cells], spread: float, centre: np.ndarray, axes: np.ndarray, grid: Grid) -> tuple[int, Node, np.ndarray, np.ndarray, np.ndarray] | None:
    """A grid that cuts the records of a part apart: on the two directions of most variance; if that leaves records in one piece that
    scatter more than those of one composition do, on the next directions, and in narrower cells. ``count`` gives the cells of a try
    with their counts. The number of the try, its node (its children index the labels), the labels, how many records lie under
    each, and the label of each cell. None for a piece that scatters so and cannot be cut, and if no cell is dense."""
    out = None
    for t, (width, k) in enumerate(tries(grid, len(axes))):
        cells, n = count(t)
        label = dense_labels(cells, n, grid)
        names = np.unique(label[label >= 0])
        if len(names) and (out is None or len(names) > 1):
            keys, label_of, inner = widened_cells(cells, n, label)
            node = Node(centre, axes[k : k + AXES].copy(), width, keys, np.searchsorted(names, label_of), inner)
            out = t, node, names, np.array([n[label == x].sum() for x in names]), label
        if len(names) > 1 or spread <= grid.tight * grid.random:
            return out
    return None


class Tree:
    """Grids, the first of them the root, and numbered parts: the leaves. Part 0 are all records; a part is open until it is ``put``."""

    def __init__(self, grid: Grid):
        self.grid, self.nodes, self.over, self.parts = grid, [], {0: -1}, 1

    def hang(self, part: int, child: int) -> None:
        over = self.over.pop(part)
        if over >= 0:
            children = self.nodes[over].children
            children[children == -1 - part] = child

    def put(self, part: int, found: tuple[Node, np.ndarray] | None, n: int) -> list[int]:
        """Give the part of ``n`` records its grid (none: it has no leaf). The numbers of the parts under the labels, in their order,
        none if one label holds nearly all, which then is a leaf."""
        self.hang(part, len(self.nodes) if found else GONE)
        if not found:
            return []
        node, sizes = found
        numbers = self.parts + np.arange(len(sizes))
        node.children = -1 - numbers[node.children]
        self.nodes.append(node)
        self.parts += len(sizes)
        if len(sizes) == 1 and sizes[0] >= self.grid.whole * n:
            return []
        self.over |= {int(p): len(self.nodes) - 1 for p in numbers}
        return numbers.tolist()

    def graft(self, part: int, nodes: list[Node]) -> None:
        """Give the part a tree of its own (none: it has no leaf)."""
        self.hang(part, len(self.nodes) if nodes else GONE)
        at, base = len(self.nodes), self.parts
        for node in nodes:
            child = node.children
            node.children = np.where(child > 0, child + at, np.where(child == GONE, GONE, child - base))
            self.parts = max(self.parts, base + 1 + int(-child.min(initial=0, where=child != GONE)))
        self.nodes += nodes


def grids_of(r: np.ndarray, grid: Grid) -> list[Node]:
    """A tree of grids for rank vectors: the records under each label of a grid's dense cells have a grid of their own, and so
    on until one label holds nearly all. The first node is the root; leaves are numbered; no node if there is nothing dense."""
    tree, todo = Tree(grid), [(r, 0)]
    while todo:
        part, number = todo.pop()
        found = at = None
        if len(part) >= grid.least:
            centre, axes = directions(len(part), part.sum(0), part.T @ part)
            axes = axes[: min(len(part), grid.dims)]
            spots = {}

            def count(t: int) -> Cells:
                width, k = tries(grid, len(axes))[t]
                cells, spots[t], n = np.unique(np.floor((part - centre) @ axes[k : k + AXES].T / width).astype(np.int64), axis=0, return_inverse=True, return_counts=True)
                return cells, n

            found = grid_by(count, np.median(distances(part, centre[None])), centre, axes, grid)
        if found:
            t, node, names, sizes, label = found
            at = label[spots[t].ravel()]
        for name, p in zip(names if found else [], tree.put(number, (node, sizes) if found else None, len(part))):
            todo.append((part[at == name], p))
    return tree.nodes


def walked(r: np.ndarray, nodes: list[Node], *, inner: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The leaf of each rank vector (-1 for those that leave the labelled cells and those beside them, or, with ``inner``, the
    labelled ones) and its cell on the leaf's grid."""
    at, leaf = np.zeros(len(r), np.int64), np.full(len(r), -1, np.int64)
    cell = np.zeros((len(r), AXES), np.int64)
    for k, node in enumerate(nodes):  # parents come before their children
        here = np.flatnonzero(at == k)
        if not len(here):
            continue
        cells = node.cells(r[here])
        cell[here] = cells
        keys = cell_keys(cells)
        spot = np.minimum(np.searchsorted(node.keys, keys), len(node.keys) - 1)
        child = np.where((node.keys[spot] == keys) & (node.inner[spot] | (not inner)), node.children[spot], GONE)
        at[here] = np.where(child > 0, child, -1)
        leaf[here] = np.where((child < 0) & (child > GONE), -1 - child, -1)
    return leaf, cell


def parts_of(r: np.ndarray, nodes: list[Node]) -> np.ndarray:
    """The part in which each rank vector is counted."""
    return walked(r, nodes, inner=True)[0] if nodes else np.zeros(len(r), np.int64)


def frames(rows: DataFrame, nodes: list[Node], parts: list[int], grid: Grid) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The mean and the directions of most variance of each part, over all its rows: sums, added up in the tasks first."""
    shared, dims = rows.sparkSession.sparkContext.broadcast((nodes, np.sort(parts))), grid.dims
    upper = np.triu_indices(dims)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        tree, wanted = shared.value

        def short(outer: np.ndarray) -> bytes:
            flat = outer[upper]
            return flat.astype("<u4" if flat.max() < 2**32 else "<f8").tobytes()

        def sums() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([n for n, _, _ in held.values()], pa.int64()), pa.array([t.tobytes() for _, t, _ in held.values()], pa.binary()), pa.array([short(o) for _, _, o in held.values()], pa.binary())], names=["part", "n", "total", "outer"])

        for batch in batches:
            r = matrix(batch.column(0), dims).astype(float)
            of = parts_of(r, tree)
            for p in np.intersect1d(of, wanted).tolist():
                x = r[of == p]
                n, total, outer = held.get(p, (0, 0, 0))
                held[p] = (n + len(x), total + x.sum(0), outer + x.T @ x)
            if len(held) > 256:
                yield sums()
                held.clear()
        yield sums()

    def frame(pdf: pd.DataFrame) -> pd.DataFrame:
        flat = sum(np.frombuffer(x, "<u4" if len(x) == 4 * len(upper[0]) else "<f8").astype(float) for x in pdf.outer)
        outer = np.zeros((dims, dims))
        outer[upper] = flat
        outer.T[upper] = flat
        centre, axes = directions(int(pdf.n.sum()), sum(np.frombuffer(x) for x in pdf.total), outer)
        return pd.DataFrame({"part": [pdf.part.iloc[0]], "frame": [np.r_[centre[None], axes[: 6 + AXES]].tobytes()]})

    got = rows.select("ranks").mapInArrow(partial, "part bigint, n bigint, total binary, outer binary").groupBy("part").applyInPandas(frame, "part bigint, frame binary").collect()
    both = {r.part: np.frombuffer(r.frame).reshape(-1, dims) for r in got}
    return {p: (x[0], x[1:]) for p, x in both.items()}


#: Bits of a cell's coordinate, and of the number of a try, in a key; distances are counted in steps of 1 / FINE.
SPOT, TRY, FINE = 20, 4, 16


def part_grids(rows: DataFrame, nodes: list[Node], parts: dict[int, tuple[np.ndarray, np.ndarray]], grid: Grid) -> dict[int, tuple[Node, np.ndarray]]:
    """The grid of each part that has one, with the sizes of its labels, from the counts of the cells of all tries and of the distances
    from the mean over all the part's rows."""
    names = sorted(parts)
    shared = rows.sparkSession.sparkContext.broadcast((nodes, names, parts))
    mid, mask = 1 << (SPOT - 1), (1 << SPOT) - 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, known, frame = shared.value
        keys, counts, pending = [], [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            every, at = np.unique(np.concatenate(keys), return_inverse=True)
            return every, np.bincount(at, np.concatenate(counts), len(every)).astype(np.int64)

        def out(every: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(known)[every >> (2 * SPOT + TRY)]), pa.array(every & ((1 << (2 * SPOT + TRY)) - 1)), pa.array(n)], names=["part", "key", "n"])

        for batch in batches:
            r = matrix(batch.column(0), grid.dims).astype(float)
            of = parts_of(r, tree)
            for p in np.intersect1d(of, known).tolist():
                centre, axes = frame[p]
                x = r[of == p] - centre
                base, along = known.index(p) << TRY, x @ axes.T
                # the number after the last try's holds the distances
                spots = [np.c_[np.floor(np.sqrt((x**2).sum(1)) * FINE), np.zeros(len(x))], *(np.floor(along[:, k : k + AXES] / width) for width, k in tries(grid, grid.dims))]
                for t, spot in enumerate(spots):
                    cell = np.clip(spot.astype(np.int64) + mid, 0, mask)
                    key, n = np.unique(((base + t) << SPOT | cell[:, 0]) << SPOT | cell[:, 1], return_counts=True)
                    keys.append(key)
                    counts.append(n)
                    pending += len(key)
            if pending > 1 << 20:
                every, n = summed()
                keys, counts, pending = [every], [n], 0
                if len(every) > 1 << 19:
                    yield out(every, n)
                    keys, counts = [], []
        if keys:
            yield out(*summed())

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        key, n, part = pdf.key.to_numpy(), pdf.n.to_numpy(), int(pdf.part.iloc[0])
        t, cells = key >> (2 * SPOT), np.c_[(key >> SPOT) & mask, key & mask] - mid
        far, held = cells[t == 0, 0], n[t == 0]
        order = np.argsort(far)
        spread = far[order][np.searchsorted(np.cumsum(held[order]), held.sum() / 2)] / FINE
        centre, axes = shared.value[2][part]
        axes = np.r_[axes, np.zeros((grid.dims - len(axes), grid.dims))]  # only the first are used
        found = grid_by(lambda k: (cells[t == 1 + k], n[t == 1 + k]), spread, centre, axes, grid)
        return pd.DataFrame({"part": [part], "found": [pickle.dumps((found[1], found[3]) if found else None)]})

    counted = rows.select("ranks").mapInArrow(partial, "part bigint, key bigint, n bigint").groupBy("part", "key").agg(F.sum("n").alias("n"))
    got = counted.groupBy("part").applyInPandas(choose, "part bigint, found binary").collect()
    return {r.part: found for r in got if (found := pickle.loads(r.found))}


def fitted(rows: DataFrame, n: int, grid: Grid) -> list[Node]:
    """``grids_of`` for all the ``n`` rows of a table (``ranks``). A level of the tree at a time, the directions and cells of the parts with more than
    ``grid.gathered`` records are counted by Spark; the records of a smaller part, and all its levels, are one task's."""
    tree, level, small = Tree(grid), {0: n}, []
    while level:
        small += [p for p, m in level.items() if grid.least <= m <= grid.gathered]
        big = {p: m for p, m in level.items() if m > grid.gathered}
        for p in level.keys() - big.keys() - set(small):
            tree.put(p, None, level[p])
        level = {}
        if not big:
            break
        found = part_grids(rows, tree.nodes, frames(rows, tree.nodes, list(big), grid), grid)
        for p, m in big.items():
            level |= dict(zip(tree.put(p, found.get(p), m), found[p][1].tolist() if p in found else []))
    if small:
        shared = rows.sparkSession.sparkContext.broadcast((tree.nodes, np.array(small)))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nodes, wanted = shared.value
            for batch in batches:
                of = parts_of(matrix(batch.column(0), grid.dims).astype(float), nodes)
                yield pa.RecordBatch.from_arrays([pa.array(of), batch.column(0)], names=["part", "ranks"]).filter(pa.array(np.isin(of, wanted)))

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": [pdf.part.iloc[0]], "nodes": [pickle.dumps(grids_of(stacked(pdf.ranks, grid.dims), grid))]})

        got = rows.select("ranks").mapInArrow(place, "part bigint, ranks binary").groupBy("part").applyInPandas(fit, "part bigint, nodes binary").collect()
        for r in sorted(got, key=lambda r: r.part):
            tree.graft(r.part, pickle.loads(r.nodes))
    return tree.nodes


def distances(r: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances of rank vectors (rows) and centres (columns)."""
    square = (r**2).sum(1)[:, None] - 2 * r @ centres.T + (centres**2).sum(1)
    return np.sqrt(np.maximum(0, square))


RANK = np.dtype("<u2")
#: Ranks leave every second byte empty, which the session's codec may not see.
CODEC = "zstd"


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A column of packed rank vectors, without nulls, as rows of numbers."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(RANK).reshape(len(column), dims)


def stacked(column: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), RANK).reshape(len(column), dims).astype(float)


def packed(records: DataFrame, dims: int) -> DataFrame:
    """``id, ranks, length`` with the ranks packed into two bytes each: half of what arrays of integers take to shuffle."""
    rows = records.select(F.col("id").cast("bigint").alias("id"), "ranks", F.col("length").cast("double").alias("length"))
    if records.schema["ranks"].dataType.simpleString() == "binary":
        return rows.where("id IS NOT NULL AND ranks IS NOT NULL")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), binaries(flat.reshape(-1, dims)), batch.column(2)], names=["id", "ranks", "length"])

    return rows.where(F.col("id").isNotNull() & (F.size("ranks") == dims)).mapInArrow(pack, "id bigint, ranks binary, length double")


def binaries(ranks: np.ndarray) -> pa.Array:
    ends = np.arange(len(ranks) + 1, dtype=np.int32) * (RANK.itemsize * ranks.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(ranks), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(ranks, RANK).tobytes())])


def bounded(rows: DataFrame, most: int, what: str) -> list:
    """The rows, at most ``most``; more are refused, not cut off."""
    out = rows.limit(most + 1).collect()
    if len(out) > most:
        raise ValueError(f"more than {most} {what}")
    return out


ROW = "id bigint, ranks binary, length double"
CELL = [f"x{k}" for k in range(AXES)]


def on_grids(rows: DataFrame, nodes: list[Node], grid: Grid) -> DataFrame:
    """``id, ranks, length, leaf, x0, ...``: the leaf's grid and cell of every record."""
    shared = rows.sparkSession.sparkContext.broadcast(nodes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, cell = walked(matrix(batch.column(1), grid.dims).astype(float), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), *(pa.array(cell[:, k]) for k in range(AXES))], names=["id", "ranks", "length", "leaf", *CELL])

    return rows.select("id", "ranks", "length").mapInArrow(place, f"{ROW}, leaf bigint, " + ", ".join(f"{x} bigint" for x in CELL))


def labelled(placed: DataFrame, turn: int, grid: Grid) -> DataFrame:
    """``id, ranks, length, label, held``: the label of each record's cell (null for a cell that is not dense nor beside a dense
    one) and how many records the cell holds. Spark counts the cells; the cells of one leaf, few whatever the number of its
    records (rank vectors lie within 458 of their mean, so an axis has at most 32 cells), are labelled in one task."""
    cells = placed.where("leaf >= 0").groupBy("leaf", *CELL).agg(F.count(F.lit(1)).alias("held"))

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        found = dense_labels(pdf[CELL].to_numpy().astype(np.int64), pdf.held.to_numpy(), grid)
        return pdf.assign(label=found)[["leaf", *CELL, "held", "label"]]

    labels = cut(cells.groupBy("leaf").applyInPandas(label, "leaf bigint, " + ", ".join(f"{x} bigint" for x in CELL) + ", held bigint, label bigint"))
    joined = placed.join(broadcast_checked(labels, 200_000), ["leaf", *CELL], "left")
    return joined.select("id", "ranks", "length", F.when(F.col("label") >= 0, F.xxhash64(F.lit(turn), "leaf", "label")).alias("label"), "held")


def label_means(rows: DataFrame, label: str, grid: Grid) -> DataFrame:
    """``label, n, mean`` of the rank vectors under each label, summed up in the tasks first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def sums() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([x.tobytes() for _, x in held.values()], pa.binary())], names=["label", "n", "mean"])

        for batch in batches:
            names, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            r, order = matrix(batch.column(1), grid.dims), np.argsort(at, kind="stable")
            if not len(names):
                continue
            starts = np.searchsorted(at[order], np.arange(len(names)))
            total = np.add.reduceat(r[order].astype(np.int64), starts)
            for name, n, x in zip(names.tolist(), np.diff(np.r_[starts, len(r)]).tolist(), total):
                n0, x0 = held.get(name, (0, 0))
                held[name] = (n0 + n, x0 + x)
            if len(held) > 4096:
                yield sums()
                held.clear()
        yield sums()

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf.n.sum())
        return pd.DataFrame({"label": [pdf.label.iloc[0]], "n": [n], "mean": [(sum(np.frombuffer(x, np.int64) for x in pdf["mean"]) / n).tobytes()]})

    kinds = "label bigint, n bigint, mean binary"
    return rows.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), "ranks").mapInArrow(partial, kinds).groupBy("label").applyInPandas(total, kinds)


def measured(rows: DataFrame, names: np.ndarray, centres: np.ndarray, grid: Grid) -> DataFrame:
    """``id, ranks, length, label, held, part, distance``: the mean of the record's label, or the nearest one for a record
    without, as an index into ``names``, and how far it is."""
    shared = rows.sparkSession.sparkContext.broadcast((names, centres))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, means = shared.value
            d = distances(matrix(batch.column(1), grid.dims).astype(float), means)
            label = batch.column(3)
            order = np.argsort(known, kind="stable")
            mine = label.fill_null(0).to_numpy()
            spot = order[np.minimum(np.searchsorted(known[order], mine), len(known) - 1)]
            own = (known[spot] == mine) & label.is_valid().to_numpy(zero_copy_only=False)
            part = np.where(own, spot, d.argmin(1)) if len(d) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part), pa.array(d[np.arange(len(d)), part])], names=["id", "ranks", "length", "label", "held", "part", "distance"])

    return rows.select("id", "ranks", "length", "label", "held").mapInArrow(measure, f"{ROW}, label bigint, held bigint, part bigint, distance double")


def bucket() -> Column:
    return F.coalesce(F.round(F.log2("length") * 2), F.lit(-1.0)).alias("bucket")


def length_medians(rows: DataFrame, grid: Grid) -> tuple[DataFrame, int]:
    """``bucket, typical``: the median distance among records of about one length (shorter ones scatter more; null lengths have
    a median of their own), at most ``grid.radius`` of a random distance; and how many rows there are. A few hundred
    rows whatever the table: lengths are rounded to half powers of two."""
    got = rows.groupBy(bucket()).agg(F.percentile_approx("distance", 0.5, 1000).alias("typical"), F.count(F.lit(1)).alias("n")).collect()
    most = grid.radius * grid.random
    return rows.sparkSession.createDataFrame([(r.bucket, min(r.typical, most)) for r in got], "bucket double, typical double").coalesce(1), sum(r.n for r in got)


def typical_of(rows: DataFrame, medians: DataFrame, grid: Grid) -> DataFrame:
    """``rows`` with the ``typical`` distance for their length."""
    known = rows.withColumn("bucket", bucket()).join(F.broadcast(medians), "bucket", "left").drop("bucket")
    return known.withColumn("typical", F.coalesce("typical", F.lit(grid.radius * grid.random)))


def one_composition(n: np.ndarray, means: np.ndarray, scatter: float) -> np.ndarray:
    """For each mean the one that stands for its composition, from the largest on: two are one if they are no further
    apart than means of so many records of one composition, which scatter by ``scatter``, may be."""
    to, kept = np.arange(len(n)), np.empty(0, np.int64)
    for k in np.argsort(-n, kind="stable"):
        if len(kept):
            ratio = ((means[kept] - means[k]) ** 2).sum(1) / (scatter**2 * (0.25 + 1.3 * (1 / n[kept] + 1 / n[k])))
            j = int(ratio.argmin())
            if ratio[j] < 1:
                to[k] = kept[j]
                continue
        kept = np.append(kept, k)
    return to


def groups(records: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """``id, part, group, size, distance, held, how``: records (``id, ranks, length``, distinct ids) in a group of two or more:
    the group's number and smallest id, its size, the distance from its mean, how many records the record's cell holds, and
    whether the record is a member by its ``cell``, as one at the ``border``, or in a group of the ``rest``.

    Rounds over the records that have no group yet. A tree of grids, fitted on all of them (``fitted``), quantises them; their
    cells are counted, adjacent dense cells have one label, and a record whose cell has a label is in that label's group, if it
    is no further from the label's mean than records of its length are (an exact check). Records near to such a mean are
    not looked at again, and rounds end when one finds fewer than ``grid.least`` members. Labels of one composition are then
    joined. A record outside the labelled cells lies at the border of the nearest group if it is near enough for its length and
    for how far the group's members scatter. The rest is compared among itself (``alike_rest``).

    Defined results: null ids and rank vectors of another size are left out; a null length is a length of its own; records alike
    to no other have no row; an empty table gives none.
    """
    spark = records.sparkSession
    loose = cut(packed(records, grid.dims), CODEC)
    n_loose = loose.count()
    names, sizes, means, near = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, grid.dims)), []
    tables: list[DataFrame] = []
    while n_loose >= grid.least:
        nodes = fitted(loose, n_loose, grid)
        if not nodes:
            break
        placed = cut(on_grids(loose, nodes, grid), CODEC)
        release(loose)
        marked = labelled(placed, len(near), grid)
        found = bounded(label_means(marked, "label", grid).where("n >= 4"), grid.centres - len(names), "labels")
        if not found:
            loose = placed.select("id", "ranks", "length")
            break
        names, sizes = np.r_[names, [r.label for r in found]].astype(np.int64), np.r_[sizes, [r.n for r in found]].astype(np.int64)
        means = np.concatenate([means, np.array([np.frombuffer(r["mean"]) for r in found])])
        seen = cut(measured(marked, names, means, grid), CODEC)
        release(placed)
        medians, _ = length_medians(seen, grid)
        judged = typical_of(seen, medians, grid).withColumn("close", F.col("distance") <= grid.near * F.col("typical"))
        # the members stay where they are, in one copy; only the records still to be looked at are written again
        near.append(judged.where("close").select("id", "ranks", "length", "label", "held"))
        tables.append(seen)
        counts = judged.agg(F.count_if("close"), F.count_if(F.col("close") & F.col("label").isNotNull())).first()
        loose, n_loose = cut(judged.where("NOT coalesce(close, false)").select("id", "ranks", "length"), CODEC), n_loose - counts[0]
        if counts[1] < grid.least:
            break
    last = loose.select("id", "ranks", "length", F.lit(None).cast("bigint").alias("label"), F.lit(None).cast("bigint").alias("held"))
    if not len(names):
        rest = cut(last.withColumns({"part": F.lit(None).cast("bigint"), "distance": F.lit(None).cast("double"), "typical": F.lit(grid.radius * grid.random), "usual": F.lit(grid.radius * grid.random)}))
        return with_sizes(alike_rest(rest, np.empty((0, grid.dims)), 0.0, grid))
    return with_sizes(members(reduce(DataFrame.unionByName, [*near, last]), [*tables, loose], names, sizes, means, grid))


def members(rows: DataFrame, tables: list[DataFrame], names: np.ndarray, sizes: np.ndarray, means: np.ndarray, grid: Grid) -> DataFrame:
    """``id, part, distance, held, how`` for rows with the ``label`` of their cell, or none. The ``tables`` behind the rows are deleted
    when they have been read."""
    spark = rows.sparkSession
    scatter = cut(measured(rows.where("label IS NOT NULL"), names, means, grid).select("length", "distance"))
    scatter_ = scatter.agg(F.percentile_approx("distance", 0.5, 1000)).first()[0] or 0.0
    to = one_composition(sizes, means, scatter_)
    heads, part = np.unique(to, return_inverse=True)
    weight = np.zeros((len(heads), 1))
    np.add.at(weight, part, sizes[:, None])
    joined = np.zeros((len(heads), grid.dims))
    np.add.at(joined, part, sizes[:, None] * means)
    joined /= weight
    as_part = spark.createDataFrame([(int(a), int(p)) for a, p in zip(names, part)], "label bigint, number bigint").coalesce(1)
    numbered = rows.join(F.broadcast(as_part), "label", "left").withColumn("label", F.col("number"))
    seen = cut(measured(numbered, np.arange(len(heads)), joined, grid), CODEC)
    release(*(t for t in tables if hasattr(t, "_cut_path")))
    medians, _ = length_medians(seen.where("label IS NOT NULL"), grid)
    known = typical_of(seen, medians, grid)
    wide = cut(known.where("label IS NOT NULL").groupBy("part").agg(F.greatest(F.lit(1.0), F.percentile_approx(F.col("distance") / F.col("typical"), 0.5, 1000)).alias("wide"), F.count(F.lit(1)).alias("n")))
    wide = broadcast_checked(wide.select("part", F.when(F.col("n") >= 3, F.col("wide")).alias("wide")), grid.centres)
    known = known.join(wide, "part", "left").withColumn("usual", F.col("typical")).withColumn("typical", F.col("typical") * F.coalesce("wide", F.lit(1.0)))
    how = F.when(F.col("label").isNotNull(), "cell").when(F.col("distance") <= grid.near * F.col("typical"), "border")
    judged = known.select("id", "ranks", "label", "held", "part", "distance", "typical", "usual", how.alias("how"))
    inside = cut(judged.where("how IS NOT NULL").select("id", "part", "distance", "held", "how"))
    rest = cut(judged.where("how IS NULL"), CODEC)
    release(seen)
    return inside.unionByName(alike_rest(rest, joined, scatter_, grid))


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs that join the same nodes as the pairs of ``a`` and ``b``: each node, but for one of a component, with the component's smallest."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    more = label != np.arange(len(nodes))
    return np.c_[nodes[label[more]], nodes[more]]


def alike_rest(loose: DataFrame, means: np.ndarray, scatter: float, grid: Grid) -> DataFrame:
    """``id, part, distance, held, how``: small groups among the records (``id, ranks, part, distance, typical, usual``) far from every
    mean. They meet in the same or adjacent cells of one grid, and are linked by an exact distance of at most ``grid.alike`` times
    what their two lengths let expect; linked ones are a group, minimum labels propagated until none changes. A group whose mean is
    a known one (of which it is the fringe) belongs to that, and so does a record alike to no other within ``grid.border``.

    The cells are 4.5 standard deviations of the difference of two alike records wide, so records further apart than adjacent
    cells are alike once in a hundred thousand axes. Cells are dealt out to tasks by pairs of chunks of about 2048 records."""
    spark = loose.sparkSession
    n = loose.count()
    none = loose.limit(0).select("id", F.col("part"), "distance", F.lit(0).cast("bigint").alias("held"), F.lit("rest").alias("how"))
    if n == 0:
        return none
    centre, axes = frames(loose, [], [0], grid)[0]
    widest = loose.agg(F.max("usual")).first()[0]
    width = 4.5 * (2 / grid.dims) ** 0.5 * widest
    node = Node(centre, axes[:AXES].copy(), width, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
    shared = spark.sparkContext.broadcast(node)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = shared.value.cells(matrix(batch.column(1), grid.dims).astype(float))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cell[:, k]) for k in range(AXES))], names=["id", "ranks", "usual", *CELL])

    placed = cut(loose.select("id", "ranks", "usual").mapInArrow(place, "id bigint, ranks binary, usual double, " + ", ".join(f"{x} bigint" for x in CELL)))
    cells = cut(placed.groupBy(*CELL).agg(F.ceil(F.count(F.lit(1)) / 2048).alias("chunks")))
    steps = [s for s in np.ndindex(*[3] * AXES) if s >= (1,) * AXES]  # each pair of cells once
    away = F.explode(F.array(*(F.struct(*(F.lit(x - 1).alias(f"d{k}") for k, x in enumerate(s))) for s in steps))).alias("d")
    beside = cells.select(*(F.col(x).alias("a" + x) for x in CELL), F.col("chunks").alias("n1"), away)
    beside = beside.select("*", *((F.col(f"a{x}") + F.col(f"d.d{k}")).alias(x) for k, x in enumerate(CELL)))
    met = beside.join(cells, CELL).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n1") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    same = F.lit(True)
    for x in CELL:
        same = same & (F.col("a" + x) == F.col(x))
    met = broadcast_checked(cut(met.where(~same | (F.col("i") <= F.col("j"))).select(F.monotonically_increasing_id().alias("meeting"), *CELL, *("a" + x for x in CELL), "i", "j")))
    chunked = placed.join(broadcast_checked(cells), CELL).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    one = chunked.select(*(F.col(x).alias("a" + x) for x in CELL), F.col("chunk").alias("i"), "id", "ranks", "usual").join(met.select("meeting", *("a" + x for x in CELL), "i"), ["a" + x for x in CELL] + ["i"])
    other = chunked.select(*CELL, F.col("chunk").alias("j"), "id", "ranks", "usual").join(met.select("meeting", *CELL, "j"), [*CELL, "j"])
    sides = one.select("meeting", F.lit(0).alias("side"), "id", "ranks", "usual").unionByName(other.select("meeting", F.lit(1).alias("side"), "id", "ranks", "usual"))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf.side == k] for k in (0, 1))
        if not len(a) or not len(b):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        far = distances(stacked(a.ranks, grid.dims), stacked(b.ranks, grid.dims))
        i, j = np.nonzero((far <= grid.alike * np.hypot(a.usual.to_numpy()[:, None], b.usual.to_numpy())) & (a.id.to_numpy()[:, None] != b.id.to_numpy()))
        return pd.DataFrame(spanning(a.id.to_numpy()[i], b.id.to_numpy()[j]), columns=["a", "b"])

    linked = sides.groupBy("meeting").applyInPandas(link, "a bigint, b bigint")
    edges = cut(linked.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct())
    small = propagated(edges.select(F.col("a").alias("node")).distinct(), edges).withColumnsRenamed({"node": "id", "label": "small"})
    rows = cut(loose.select("id", "ranks", "part", "distance", "typical").join(small, "id", "left"))
    if not len(means):
        return rows.where("small IS NOT NULL").select("id", F.col("small").alias("part"), "distance", F.lit(0).cast("bigint").alias("held"), F.lit("rest").alias("how"))
    known = spark.sparkContext.broadcast(means)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mean = np.frombuffer(b"".join(batch.column(2).to_pylist())).reshape(-1, grid.dims)
            d, size = distances(mean, known.value), batch.column(1).to_numpy()
            near = d.argmin(1) if len(d) else np.empty(0, np.int64)
            fringe = d[np.arange(len(d)), near] ** 2 < scatter**2 * (0.25 + 1.3 / size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, mask=~fringe)], names=["small", "known"])

    fringes = label_means(rows, "small", grid).mapInArrow(compare, "small bigint, known bigint")
    out = rows.join(fringes, "small", "left")
    out = out.where(F.col("small").isNotNull() | (F.col("distance") <= grid.border * F.col("typical")))
    part = F.when(F.col("small").isNull(), F.col("part")).otherwise(F.coalesce("known", -1 - F.abs("small")))
    return out.select("id", part.alias("part"), "distance", F.lit(0).cast("bigint").alias("held"), F.when(F.col("small").isNull() | F.col("known").isNotNull(), "border").otherwise("rest").alias("how"))


def with_sizes(found: DataFrame) -> DataFrame:
    """Members of groups of two or more, with the group's smallest id and size."""
    found = cut(found)
    sizes = cut(found.groupBy("part").agg(F.min("id").alias("group"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    return found.join(broadcast_checked(sizes), "part").select("id", "part", "group", "size", "distance", "held", "how")


def packed_vectors(vectors: DataFrame, *, dims: int = 136) -> DataFrame:
    """``id, ranks, length``: one row for each seq_id with a usable row, the latest loaded of those, ranks packed. Ranks are
    those of ``vals`` if all its entries are numbers, else the given ranks if they are whole, else those of ``vals`` with NaN
    last."""
    stamp = vectors.schema["loaded_at"].dataType

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vals, given = (whole_lists(batch.column(k), dims) for k in (1, 2))
            numbers = ~np.isnan(vals[1]).any(1)
            out = np.zeros((batch.num_rows, dims), RANK)
            out[vals[0]] = np.argsort(np.argsort(vals[1], axis=1, kind="stable"), axis=1, kind="stable")
            clean = np.zeros(batch.num_rows, bool)
            clean[vals[0][numbers]] = True
            by_given = ~clean[given[0]]
            out[given[0][by_given]] = given[1][by_given]
            some = np.zeros(batch.num_rows, bool)
            some[vals[0]] = some[given[0]] = True
            keep = pa.array(some)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), binaries(out[some]), batch.column(3).filter(keep), batch.column(4).filter(keep)], names=["id", "ranks", "length", "loaded_at"])

    rows = vectors.where("seq_id IS NOT NULL").select(F.col("seq_id").cast("bigint"), F.col("vals").cast("array<double>"), F.col("ranks").cast("array<int>"), F.col("seq_len").cast("double"), "loaded_at")
    ranked = rows.mapInArrow(usable, f"{ROW}, loaded_at {stamp.simpleString()}")
    return ranked.groupBy("id").agg(F.max_by(F.struct("ranks", "length"), F.struct(F.col("loaded_at").isNotNull(), "loaded_at")).alias("s")).select("id", "s.*")


def whole_lists(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The places and values of lists of ``dims`` entries without null."""
    fits = pc.equal(pc.list_value_length(column), dims).fill_null(False)
    at, flat = np.flatnonzero(fits.to_numpy(zero_copy_only=False)), column.filter(fits).flatten()
    if flat.null_count:
        full = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dims).all(1)
        return at[full], flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, dims)[full]
    return at, flat.to_numpy(zero_copy_only=False).reshape(-1, dims)


def usable_vectors(vectors: DataFrame, *, dims: int = 136) -> DataFrame:
    """``packed_vectors`` with the ranks as arrays."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = matrix(batch.column(1), dims).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ranks) + 1, dtype=np.int32) * dims), pa.array(ranks.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2)], names=["id", "ranks", "length"])

    return packed_vectors(vectors, dims=dims).mapInArrow(unpack, "id bigint, ranks array<int>, length double")


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``group_id`` (its smallest seq_id), ``seq_id, size, distance, held, how`` of the records that are in a group."""
    found = groups(packed_vectors(table(spark, sf_dir, "kmer_vectors")))
    return found.select(F.col("group").alias("group_id"), F.col("id").alias("seq_id"), "size", F.round("distance", 1).alias("distance"), "held", "how")


def p2_groups(spark: SparkSession, sf_dir: str, *, typical: int = 3) -> DataFrame:
    """Each group with its size and its most typical records: those in its densest cell, of these the nearest to the mean."""
    order = Window.partitionBy("group_id").orderBy(F.desc_nulls_last("held"), F.col("distance").asc_nulls_last(), "seq_id")
    first = cut(p2_members(spark, sf_dir)).withColumn("k", F.row_number().over(order)).where(F.col("k") <= typical)
    return first.groupBy("group_id", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "seq_id"))), lambda s: s["seq_id"]).alias("typical"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_members(spark, sf_dir).where("seq_id <> group_id").select(F.col("group_id").alias("seq_id_a"), F.col("seq_id").alias("seq_id_b"))


QUERIES = {"p2_members": p2_members, "p2_groups": p2_groups, "p2_found": p2_found}
ORACLE: dict[str, str] = {}
