"""Hard negatives: close to an anchor, of another label, but not as close as its positives.

Rows are integer vectors; a score is an inner product. For each anchor and each of its best
rows of its own label (positives), the best rows of other labels are wanted whose score lies
in a window of shares of the positive's score.

With r the largest norm of all rows, a row x is the point (x, sqrt(r*r - x*x)) and an anchor q
the point (q, 0). The squared distance of the two is q*q + r*r - 2*score, so the best rows are
the nearest ones and a window of scores is an annulus of distances. Rows are indexed in a
multiway hyperplane tree in the manner of GNAT: a node has split points, far from each other,
and a row goes down to the nearest of them; for every split point and every child the node
keeps the range of distances from the one to the rows below the other. A child is passed over
when, for any split point, that range does not meet what the anchor's distance to the point
and its annulus allow. Leaves are searched exactly, in integers, so the result is exact; how
much the tree spares depends on the data. Ranges cover all rows, with some slack for rounding.

The tree's split points come from a bounded sample (`sample` rows with the smallest hashes),
so it is small at any size and is sent along with tasks; every row is indexed. Leaves are cut
into blocks of about `block_rows` rows and anchors into blocks of about `block_anchors`, each a row
of a written table; leaves of equal rows, too, which no split point can part. Pairs of blocks
with the anchors that visit the block are dealt over the tasks, in runs of one anchor block,
and only the best few rows of an anchor in a run are passed on. Anchors are a stated share of
the rows, so the work is anchors times visited rows; that is quadratic where the tree spares
nothing.

Rows with a null label or id, a null vector, or a null or not finite component take no part;
nor do those with a component of 2**18 or more, whose integers could not be multiplied exactly.
Vectors of unequal lengths are filled up with zeros. Rows with the anchor's own id are never
its positives or negatives; a repeated id is a row of its own (and an anchor of its own).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ship

SAMPLE, SPLITS, LEAF_ROWS = 20_000, 12, 1024
BLOCK_ROWS, BLOCK_ANCHORS, RUN_BLOCKS = 2048, 8192, 16
POSITIVES, NEGATIVES = 5, 3
#: The window in hundredths of the positive's score.
LOW, HIGH = 50, 95
LARGEST = 1 << 26
#: Anchors whose scores a task holds at once.
SLICE = 256
_NONE = np.iinfo(np.int64).min


def integer_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, floor(256 * component) as bytes of 32-bit integers, squared norm; only of rows that take part."""
    for batch in batches:
        vectors = batch.column(1)
        lengths = np.asarray(vectors.value_lengths().fill_null(0)).astype(np.int64)
        values = np.floor(256.0 * vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
        bad = ~(np.abs(values) < LARGEST)  # nulls are NaN here
        owner = np.repeat(np.arange(len(lengths)), lengths)
        ok = np.bincount(owner, weights=bad, minlength=len(lengths)) == 0
        for i in (0, 1, 2):
            ok &= np.asarray(batch.column(i).is_valid())
        whole = values[ok[owner]].astype("<i4")
        rows, lengths = np.flatnonzero(ok), lengths[ok]
        norms = np.bincount(np.repeat(np.arange(len(rows)), lengths), weights=whole.astype(np.float64) ** 2, minlength=len(rows))
        offsets = np.concatenate([[0], np.cumsum(lengths * 4)]).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(whole.tobytes())])
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), packed, pa.array(norms)], ["vec_id", "label", "vector", "norm"])


def unpack(vectors: pa.Array, dims: int) -> np.ndarray:
    """Vectors of bytes as the rows of an integer matrix, filled up with zeros."""
    out = np.zeros((len(vectors), dims), dtype=np.int32)
    sizes = np.asarray(pc.binary_length(vectors)) // 4
    if len(vectors) and (sizes == dims).all():
        raw = b"".join(vectors.to_pylist())
        return np.frombuffer(raw, dtype=np.int32).reshape(len(vectors), dims)
    for i, v in enumerate(vectors.to_pylist()):
        out[i, : sizes[i]] = np.frombuffer(v, dtype=np.int32)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices, as 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


class Tree:
    """A multiway hyperplane tree over points (x, rest); rest lifts all of them to one norm.

    nodes: for each inner node its split points (rows of a matrix with the rest as last column)
    and its children: another node (>= 0) or ~leaf. ranges[node][i, j]: least and most distance
    from split point i to the rows below child j.
    """

    def __init__(self, radius: float, dims: int):
        self.radius, self.dims, self.leaves = radius, dims, 0
        self.nodes: list[tuple[np.ndarray, list[int]]] = []
        self.ranges: list[np.ndarray] = []

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(self.radius - (x * x).sum(1), 0.0))])

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
        return np.sqrt(np.maximum(square, 0.0))

    def grow(self, points: np.ndarray, splits: int, leaf: int) -> int:
        """Builds the tree over lifted sample points; the root, or ~0 if one leaf is enough."""
        chosen = self._spread(points, splits) if len(points) > leaf else points[:1]
        if len(chosen) < 2:
            self.leaves += 1
            return ~(self.leaves - 1)
        nearest = self.distances(points, chosen).argmin(1)
        own = len(self.nodes)
        self.nodes.append((chosen, []))
        self.ranges.append(np.stack([np.full((len(chosen), len(chosen)), np.inf), np.full((len(chosen), len(chosen)), -np.inf)], axis=2))
        for j in range(len(chosen)):
            self.nodes[own][1].append(self.grow(points[nearest == j], splits, leaf))
        return own

    def _spread(self, points: np.ndarray, splits: int) -> np.ndarray:
        """Split points: each is the candidate farthest from those before it."""
        candidates = points[np.linspace(0, len(points) - 1, min(len(points), 3 * splits)).astype(np.int64)]
        taken, away = [0], self.distances(candidates, candidates[:1])[:, 0]
        while len(taken) < splits and away.max() > 1e-3:
            taken.append(int(away.argmax()))
            away = np.minimum(away, self.distances(candidates, candidates[taken[-1:]])[:, 0])
        return candidates[taken]

    def descend(self, points: np.ndarray, seen: Callable[[int, int, np.ndarray], None] = lambda node, child, d: None) -> np.ndarray:
        """The leaf of each lifted point; `seen` gets every node, child and the distances of the points that go there to the node's split points."""
        out = np.zeros(len(points), dtype=np.int64)
        todo = [(0, np.arange(len(points)))] if self.nodes else []
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            splits, children = self.nodes[node]
            d = self.distances(points[rows], splits)
            nearest = d.argmin(1)
            for j, child in enumerate(children):
                at = np.flatnonzero(nearest == j)
                if len(at):
                    seen(node, j, d[at])
                    if child >= 0:
                        todo.append((child, rows[at]))
                    else:
                        out[rows[at]] = ~child
        return out

    def visits(self, anchors: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Which leaves (columns) may hold a row within any of an anchor's annuli; near, far: anchors x annuli distances."""
        points = np.column_stack([anchors.astype(np.float64), np.zeros(len(anchors))])
        out = np.zeros((len(anchors), max(self.leaves, 1)), dtype=bool)
        slack = 1e-6 * (1.0 + math.sqrt(self.radius))
        wanted = (near <= far).any(1)
        if not self.nodes:
            out[wanted] = True
            return out
        todo = [(0, np.flatnonzero(wanted))]
        while todo:
            node, rows = todo.pop()
            splits, children = self.nodes[node]
            d = self.distances(points[rows], splits)
            low, high = near[rows] - slack, far[rows] + slack
            for j, child in enumerate(children):
                least, most = self.ranges[node][:, j, 0], self.ranges[node][:, j, 1]
                # nearest and farthest that a row of the child can be, as each split point tells
                at_least = np.maximum(d - most, least - d).max(1)
                at_most = (d + most).min(1)
                alive = rows[((at_least[:, None] <= high) & (at_most[:, None] >= low) & (near[rows] <= far[rows])).any(1)]
                if len(alive):
                    if child >= 0:
                        todo.append((child, alive))
                    else:
                        out[alive, ~child] = True
        return out


def leaf_batches(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points = tree.lift(unpack(batch.column("vector"), tree.dims))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.descend(points))], [*batch.schema.names, "leaf"])


def range_batches(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    """Least and most distance by node, split point and child over a partition's rows."""
    low = [np.full(r.shape[:2], np.inf) for r in tree.ranges]
    high = [np.full(r.shape[:2], -np.inf) for r in tree.ranges]

    def seen(node: int, child: int, d: np.ndarray) -> None:
        low[node][:, child] = np.minimum(low[node][:, child], d.min(0))
        high[node][:, child] = np.maximum(high[node][:, child], d.max(0))

    for batch in batches:
        tree.descend(tree.lift(unpack(batch.column("vector"), tree.dims)), seen)
    rows = [(n, i, j, low[n][i, j], high[n][i, j]) for n in range(len(low)) for i, j in zip(*np.nonzero(np.isfinite(low[n])), strict=True)]
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:3]), *(pa.array(c, pa.float64()) for c in columns[3:])], ["node", "i", "j", "low", "high"])


def pack_block(key: tuple, rows: pa.Table, dims: int) -> pa.Table:
    """The rows of a block, by id, in one row."""
    order = np.argsort(rows.column("vec_id").to_numpy(), kind="stable")
    rows = rows.take(pa.array(order))
    vectors = unpack(rows.column("vector").combine_chunks(), dims)
    leaf = rows.column("leaf").to_numpy()
    return pa.table(
        {
            "block": [key[0].as_py()], "leaf": [int(leaf[0])], "leaves": pa.array([leaf.astype("<i8").tobytes()], pa.binary()), "ids": pa.array([rows.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()),
            "labels": pa.array([rows.column("label").to_numpy().astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([vectors.astype("<i2" if np.abs(vectors).max(initial=0) < 1 << 15 else "<i4").tobytes()], pa.binary()),
        }
    )


_BLOCK = "block long, leaf long, leaves binary, ids binary, labels binary, vectors binary"


def matrix(ids: np.ndarray, vectors: bytes, dims: int) -> np.ndarray:
    kind = "<i2" if dims and len(vectors) == 2 * dims * len(ids) else "<i4"
    return np.frombuffer(vectors, dtype=kind).reshape(len(ids), dims).astype(np.int32)


def longs(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", dtype="<i8")


def best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best allowed columns of each row, ties by the column's place (ids ascend): scores (_NONE where there are fewer) and ids."""
    n = scores.shape[1]
    k_in = min(k, n)
    if np.abs(scores).max(initial=0) < 1 << 40:
        key = np.where(allowed, scores * n + (n - 1 - np.arange(n)), _NONE)
        at = np.argpartition(key, n - k_in, axis=1)[:, n - k_in :]
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(key, at, 1).astype(np.float64), axis=1, kind="stable"), 1)
    else:
        at = np.argsort(np.where(allowed, -scores, np.iinfo(np.int64).max), axis=1, kind="stable")[:, :k_in]
    ok = np.take_along_axis(allowed, at, 1)
    found, who = np.where(ok, np.take_along_axis(scores, at, 1), _NONE), np.where(ok, ids[at], 0)
    fill = ((0, 0), (0, k - k_in))
    return np.pad(found, fill, constant_values=_NONE), np.pad(who, fill)


def merge(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, their: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best of two lists along the last axis, ties by smaller id."""
    k = scores.shape[-1]
    both, who = np.concatenate([scores, more], -1), np.concatenate([ids, their], -1)
    order = np.lexsort((who, -np.maximum(both, _NONE + 1)), axis=-1)[..., :k]
    return np.take_along_axis(both, order, -1), np.take_along_axis(who, order, -1)


def window(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and most integer score in the window of each positive score; empty (1, 0) where there is no positive."""
    none = scores == _NONE
    s = np.where(none, 0, scores)
    least, most = -((-low * s) // 100), high * s // 100
    return np.where(none, 1, least), np.where(none, 0, most)


def search_batches(batches: Iterator[pa.RecordBatch], dims: int, k: int, limits: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    """Best rows of anchors over the row blocks of their run; an anchor block comes before its row blocks.

    Without limits: the k best of the anchor's own label with a score of its bound or more. With them:
    for each of the anchor's positives, the k best of other labels in the window.
    """
    now, state = None, None

    def told() -> pa.RecordBatch:
        scores, found = state
        at = np.argwhere(scores != _NONE)
        columns = [np.full(len(at), now), at[:, 0], ids[at[:, 0]], at[:, 1], scores[tuple(at.T)], found[tuple(at.T)]]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["block", "place", "anchor_id", "slot", "score", "vec_id"])

    for batch in batches:
        for r in batch.to_pylist():
            if r["members"] is None:
                if now is not None:
                    yield told()
                now, ids, labels = r["a_block"], longs(r["ids"]), longs(r["labels"])
                bounds, anchors = longs(r["bounds"]).reshape(len(ids), -1), matrix(ids, r["vectors"], dims)
                shape = (len(ids), bounds.shape[1] if limits else 1, k)
                state = (np.full(shape, _NONE), np.zeros(shape, dtype=np.int64))
                continue
            own, theirs = longs(r["ids"]), longs(r["labels"])
            rows = matrix(own, r["vectors"], dims)
            members = np.frombuffer(r["members"], dtype="<i4")
            for lo in range(0, len(members), SLICE):
                some = members[lo : lo + SLICE]
                s = products(anchors[some], rows)
                alike, other = labels[some][:, None] == theirs[None, :], own[None, :] != ids[some][:, None]
                if limits:
                    least, most = window(bounds[some], *limits)
                    fits = [~alike & other & (s >= least[:, p : p + 1]) & (s <= most[:, p : p + 1]) for p in range(bounds.shape[1])]
                else:
                    fits = [alike & other & (s >= bounds[some][:, :1])]
                for p, fit in enumerate(fits):
                    live = np.flatnonzero(fit.any(1))
                    if len(live):
                        found = best(s[live], own, fit[live], k)
                        state[0][some[live], p], state[1][some[live], p] = merge(state[0][some[live], p], state[1][some[live], p], *found)
    if now is not None:
        yield told()


_FOUND = "block long, place int, anchor_id long, slot int, score long, vec_id long"


def home_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each leaf of an anchor block with the places of its anchors."""
    for batch in batches:
        for block, leaves in zip(batch.column("block").to_pylist(), batch.column("leaves").to_pylist(), strict=True):
            own = longs(leaves)
            found = np.unique(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * len(found), pa.int64()), pa.array(found, pa.int64()), pa.array([np.flatnonzero(own == f).astype("<i4").tobytes() for f in found], pa.binary())],
                ["a_block", "leaf", "members"],
            )


def visit_batches(batches: Iterator[pa.RecordBatch], tree: Tree, limits: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    """Each leaf that anchors of a block must visit, with their places."""
    for batch in batches:
        for r in batch.select(["block", "ids", "vectors", "bounds"]).to_pylist():
            ids = longs(r["ids"])
            anchors = matrix(ids, r["vectors"], tree.dims)
            bounds = longs(r["bounds"]).reshape(len(ids), -1)
            square = (anchors.astype(np.float64) ** 2).sum(1)[:, None] + tree.radius
            distance = lambda s: np.sqrt(np.maximum(square - 2.0 * s, 0.0))  # noqa: B023, E731
            if limits:
                least, most = window(bounds, *limits)
                near, far = np.where(least <= most, distance(most), 1.0), np.where(least <= most, distance(least), 0.0)
            else:
                near, far = np.zeros(bounds.shape), np.where(bounds == _NONE, np.inf, distance(bounds))
            wanted = tree.visits(anchors, near, far)
            leaves = np.flatnonzero(wanted.any(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["block"]] * len(leaves), pa.int64()), pa.array(leaves, pa.int64()), pa.array([np.flatnonzero(wanted[:, f]).astype("<i4").tobytes() for f in leaves], pa.binary())],
                ["a_block", "leaf", "members"],
            )


def bound_block(blocks: pa.Table, found: pa.Table, slots: int, last: bool) -> pa.Table:
    """An anchor block with `bounds`: the scores found in `slots` slots of each place, or only that of the last slot."""
    n = len(longs(blocks.column("ids")[0].as_py()))
    bounds = np.full((n, slots), _NONE)
    bounds[found.column("place").to_numpy(), found.column("slot").to_numpy()] = found.column("score").to_numpy()
    return blocks.append_column("bounds", pa.array([(bounds[:, -1:] if last else bounds).astype("<i8").tobytes()], pa.binary()))


class Miner:
    """The index of the rows and the searches over it; see `hard_negatives`."""

    def __init__(self, rows: DataFrame, is_anchor: Column, sample: int, splits: int, leaf_rows: int, block_rows: int, block_anchors: int, run_blocks: int):
        self.spark, self.run_blocks = rows.sparkSession, run_blocks
        ship(self.spark)
        self.scratch = Scratch(self.spark, "negatives")
        picked = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("long"))
        clean = self.scratch.keep(picked.mapInArrow(integer_batches, "vec_id long, label long, vector binary, norm double"), "clean")
        n, radius, dims = clean.agg(F.count(F.lit(1)), F.max("norm"), F.max(F.length("vector"))).first()
        self.dims = (dims or 0) // 4
        # a sample of the rows whatever their order: those with the smallest hashes
        key = F.xxhash64("vec_id", "label", "vector")
        share = min(1.0, 1.5 * sample / max(n, 1))
        drawn = clean.where(F.pmod(key, F.lit(1 << 20)) < math.ceil(share * (1 << 20))).orderBy(key, "vec_id").limit(sample).select("vector").toArrow()
        self.tree = Tree(float(radius or 0.0), self.dims)
        points = self.tree.lift(unpack(drawn.column("vector").combine_chunks(), self.dims)) if drawn.num_rows else np.zeros((0, self.dims + 1))
        self.tree.grow(points, splits, max(2, int(leaf_rows * min(1.0, sample / max(n, 1)))))
        tree = self.tree
        placed = self.scratch.keep(clean.mapInArrow(lambda it: leaf_batches(it, tree), "vec_id long, label long, vector binary, norm double, leaf long"), "placed")
        ranges = placed.mapInArrow(lambda it: range_batches(it, tree), "node int, i int, j int, low double, high double").groupBy("node", "i", "j").agg(F.min("low"), F.max("high"))
        for node, i, j, low, high in ranges.collect():  # as many as split points squared for each node of the tree
            tree.ranges[node][i, j] = low, high
        self.rows = self._blocks(placed, "leaf", block_rows, "row_blocks")
        self.anchors = self._blocks(placed.where(is_anchor), None, block_anchors, "anchor_blocks")

    def _blocks(self, rows: DataFrame, within: str | None, size: int, name: str) -> DataFrame:
        """Blocks of about `size` rows of one leaf, or of leaves that follow each other."""
        counts = sorted(rows.groupBy("leaf").count().collect())  # leaves are bounded by the sample
        before, layout = 0, []
        for leaf, n in counts:
            parts = -(-n // size)
            layout.append((leaf, before, parts if within else n))
            before += parts if within else n
        table = F.broadcast(self.spark.createDataFrame(layout, "_leaf long, _before long, _parts long"))
        place = F.pmod(F.xxhash64("vec_id", "label", "vector", F.monotonically_increasing_id()), F.col("_parts")) + F.col("_before")
        block = place if within else F.floor(place / size).cast("long")
        dealt = rows.join(table, F.col("leaf") == F.col("_leaf")).withColumn("block", block).select("vec_id", "label", "vector", "leaf", "block")
        dims = self.dims
        return self.scratch.keep(dealt.groupBy("block").applyInArrow(lambda key, group: pack_block(key, group, dims), _BLOCK), name)

    def _search(self, anchors: DataFrame, leaves: DataFrame, rows: DataFrame, k: int, limits: tuple[int, int] | None, name: str) -> DataFrame:
        """The k best rows of each anchor and slot, by `slot` and `rank` from 1. leaves: a_block, leaf and members; anchors: with bounds."""
        dims, run = self.dims, self.run_blocks
        narrow = leaves.join(rows.select("leaf", "block"), "leaf").withColumn("run", F.expr(f"block div {run}"))
        pairs = narrow.select("a_block", "run", "block", "members").join(rows.select("block", "ids", "labels", "vectors"), "block").drop("block").withColumn("bounds", F.lit(None).cast("binary"))
        heads = narrow.select("a_block", "run").distinct().join(anchors.select(F.col("block").alias("a_block"), "ids", "labels", "vectors", "bounds"), "a_block").withColumn("members", F.lit(None).cast("binary"))
        dealt = heads.unionByName(pairs).repartition("a_block", "run").sortWithinPartitions("a_block", "run", F.col("members").isNotNull())
        found = dealt.mapInArrow(lambda it: search_batches(it, dims, k, limits), _FOUND)
        order = Window.partitionBy("block", "place", "slot").orderBy(F.desc("score"), "vec_id")
        return self.scratch.keep(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), name)

    def _bounded(self, found: DataFrame, slots: int, name: str, last: bool = False) -> DataFrame:
        """The anchor blocks with what was found as bounds."""
        own = found.select("block", "place", (F.col("rank") - 1).alias("slot"), "score")
        return self.scratch.keep(self.anchors.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(lambda blocks, rows: bound_block(blocks, rows, slots, last), f"{_BLOCK}, bounds binary"), name)

    def positives(self, k: int) -> DataFrame:
        """block, place, anchor_id, rank, vec_id, score: the k best rows of each anchor's label."""
        free = self._bounded(self.spark.createDataFrame([], f"{_FOUND}, rank int"), 1, "free")
        # one block of the anchor's own leaf gives a bound for all others
        homes = self.rows.join(self.rows.groupBy("leaf").agg(F.min("block").alias("block")), ["leaf", "block"], "left_semi")
        near = self._search(free, free.mapInArrow(home_batches, _VISITS), homes, k, None, "near")
        bounded = self._bounded(near, k, "bounded", last=True)
        return self._search(bounded, self._visited(bounded, None), self.rows, k, None, "positives")

    def negatives(self, positives: DataFrame, k: int, per: int, limits: tuple[int, int]) -> DataFrame:
        """block, place, anchor_id, slot (of the positive, from 0), rank, vec_id, score."""
        bounded = self._bounded(positives, per, "windows")
        return self._search(bounded, self._visited(bounded, limits), self.rows, k, limits, "negatives")

    def _visited(self, bounded: DataFrame, limits: tuple[int, int] | None) -> DataFrame:
        tree = self.tree
        return self.scratch.keep(bounded.mapInArrow(lambda it: visit_batches(it, tree, limits), _VISITS), "visits-windows" if limits else "visits-near")


_VISITS = "a_block long, leaf long, members binary"


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    sample: int = SAMPLE, splits: int = SPLITS, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS, run_blocks: int = RUN_BLOCKS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor.

    rows: vec_id, embedding, label; is_anchor: a condition on vec_id. The window of a negative's
    score is low to high hundredths of the positive's, both ends included.
    """
    miner = Miner(rows, is_anchor, sample, splits, leaf_rows, block_rows, block_anchors, run_blocks)
    near = miner.positives(positives)
    found = miner.negatives(near, negatives, positives, (low, high))
    own = near.select("block", "place", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(own, ["block", "place", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The registered query on the table `embeddings`.
ORACLE_SQL = """
WITH fit AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM fit a JOIN fit b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""
