"""Near-duplicate vectors by an exact metric range join over pivot cells.

Cosine similarity of at least c is Euclidean distance of at most r = sqrt(2 - 2c) between unit
vectors. Pivots, drawn by hash order, cut space into cells by nearest pivot. The axis between the
pivots of two cells bounds distances from below: two vectors are at least as far apart as their
projections on it. Vectors of two cells are sorted by their places on their axis, and only
those within r of each other there are compared: first on a part of their dimensions, where the
lengths of the rest bound what it can add.

Vectors are not copied to other cells. Each is written once, in blocks of bounded size that hold
whole cells where they can; a range partitioning by cell deals them, so a cell with very many
vectors fills many blocks. Every two blocks meet in a Cartesian product of the written blocks,
which shuffles nothing. Disk thus grows with the input, while compute grows with the square of the
number of vectors, less what the axes rule out.

Equal vectors of a block form one class. A task counts each class's partners over all blocks it
sees and emits one link for each class that its union-find ties to another, not all pairs.

Single precision only proposes; every pair within a margin of the threshold is decided in
double precision.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link
with nothing, and vectors of different lengths don't link; a null vec_id counts as a partner
and is never the name of a component; rows that repeat a vec_id count as separate vectors;
other columns (label) are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, looked_up, materialize, release, tune

COSINE = 0.95
CELL_ROWS = 2048  # vectors aimed at for each cell
FAN = 4096  # pivots at most, over all vector lengths
PIVOT_BYTES = 8 << 20  # and their size: they are sent to every task
RECUT = 8  # vectors of a length are cut into cells from so many times CELL_ROWS
BLOCK_ROWS, BLOCK_BYTES = 32_768, 8 << 20  # classes of a block at most
CHUNK_ROWS = 131_072  # vectors of a block at most, copies counted
LEAST_PARTS = 16  # blocks aimed at for small tables
DEAL_ROWS = 4096  # rows that are dealt to cells at once
STEP_ROWS = 65_536  # pairs decided in double precision at once
TILE_ROWS, TILE_COLUMNS = 128, 4096  # rows of two cells compared at once
HEAD = 3 / 8  # part of the dimensions that is multiplied first
MARGIN = 1e-4
NARROW = 0.01  # pivots that are nearer to each other have no axis

CELLS = "vec_id long, dim int, cell int, vec binary"
BLOCKS = "block long, dim int, vec binary, cell binary, copies binary, ids array<long>, slots array<int>"
MEMBERS = "vec_id long, rep long, copies long, low long"
#: A class is named by its block and its place in it.
SLOT_BITS = 18


def units(values: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision of finite rows that are not zero."""
    v = values.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=-1)


def by_length(column: pa.Array):
    """(rows, their values) of each vector length in an Arrow list column, for rows that can link."""
    lens = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)  # a null is NaN
    starts = np.cumsum(lens) - lens
    for dim in np.unique(lens[lens > 0]).tolist():
        rows = np.flatnonzero(lens == dim)
        v = flat[starts[rows][:, None] + np.arange(dim)]
        good = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
        if good.any():
            yield dim, rows[good], np.ascontiguousarray(v[good])


def _deal(pivots: dict[int, np.ndarray], kind: type):
    """Each row's vector as bytes and its cell; those that can't link have length 0."""

    def run(batches):
        for b in batches:
            dims, cells, vecs = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int32), np.full(b.num_rows, b"", object)
            for dim, rows, v in by_length(b.column(1)):
                v = v.astype(kind)
                dims[rows] = dim
                for k in range(0, len(rows), DEAL_ROWS):
                    at = rows[k : k + DEAL_ROWS]
                    vecs[at] = [x.tobytes() for x in v[k : k + DEAL_ROWS]]
                    if dim in pivots:
                        cells[at] = (units(v[k : k + DEAL_ROWS]).astype(np.float32) @ pivots[dim].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims), pa.array(cells), pa.array(vecs, pa.binary())], names=["vec_id", "dim", "cell", "vec"])

    return run


def _pack(parts: int, kind: type):
    """Blocks of rows that come sorted by (dim, cell)."""
    size = np.dtype(kind).itemsize

    def run(batches):
        block, dim, slots = TaskContext.get().partitionId(), None, {}
        vecs, cells, copies, ids, places = [], [], [], [], []

        def packed():
            columns = [[block], [dim], [b"".join(vecs)], [np.array(cells, np.int32).tobytes()], [np.array(copies, np.int64).tobytes()]]
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*columns, [ids], [places]], kinds, strict=True)], names=["block", "dim", "vec", "cell", "copies", "ids", "slots"])

        for b in batches:
            vec_id, length, cell, vec = (b.column(c).to_pylist() for c in ("vec_id", "dim", "cell", "vec"))
            start = 0
            while start < len(vec):
                end = start
                while end < len(vec) and length[end] == length[start]:
                    end += 1
                d = length[start]
                keys = units(np.frombuffer(b"".join(vec[start:end]), kind).reshape(end - start, d)) if d else None
                most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (size * max(d, 1))))
                for i in range(start, end):
                    if ids and (d != dim or len(vecs) >= most or len(ids) >= CHUNK_ROWS):
                        yield packed()
                        block += parts
                        slots, vecs, cells, copies, ids, places = {}, [], [], [], [], []
                    dim = d
                    ids.append(vec_id[i])
                    if not d:
                        places.append(-1)
                        continue
                    key = keys[i - start].tobytes()
                    if (slot := slots.get(key)) is None:
                        slot = slots[key] = len(vecs)
                        vecs.append(vec[i])
                        cells.append(cell[i])
                        copies.append(0)
                    copies[slot] += 1
                    places.append(slot)
                start = end
        if ids:
            yield packed()

    return run


class Block:
    """A block's classes: vectors, weights, and the cells they are sorted by."""

    def __init__(self, columns, row: int, kind: type) -> None:
        block, dim, vec, cell, copies = (c[row] for c in columns)
        self.block, self.dim = block.as_py(), (dim := dim.as_py())
        self.raw = np.frombuffer(vec.as_buffer(), kind).reshape(-1, dim)
        self.thin = np.empty(self.raw.shape, np.float32)
        for k in range(0, len(self.raw), DEAL_ROWS):
            self.thin[k : k + DEAL_ROWS] = units(self.raw[k : k + DEAL_ROWS])
        # The rest of two vectors adds at most the product of its lengths to their dot.
        m = int(np.ceil(HEAD * dim))
        self.head = np.column_stack([self.thin[:, :m], np.linalg.norm(self.thin[:, m:], axis=1)])
        self.copies = np.frombuffer(copies.as_buffer(), np.int64).astype(np.float64)
        cells = np.frombuffer(cell.as_buffer(), np.int32)
        starts = np.flatnonzero(np.diff(cells, prepend=-1))
        self.runs = list(zip(cells[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(cells)], strict=True))
        self.dots = None

    def own(self, p: np.ndarray) -> np.ndarray:
        """Each vector's dot with the pivot of its cell."""
        if self.dots is None:
            self.dots = np.concatenate([self.thin[s:e] @ p[c] for c, s, e in self.runs])
        return self.dots


def _near(x: Block, y: Block, pivots: dict[int, np.ndarray], threshold: float):
    """Pairs of places (in x, in y) that link, a tile at a time; within one block, each once."""
    p, radius = pivots.get(x.dim), np.sqrt(2 - 2 * threshold)
    # Rounding of single precision: of a sum of products, and of one over a short axis.
    margin, slack = max(MARGIN, x.dim * 2.5e-7), 1e-3 + x.dim * 5e-5
    if p is not None:
        to_y = p[[c for c, *_ in y.runs]] @ x.thin.T
        to_x = p[[c for c, *_ in x.runs]] @ y.thin.T
    for i, (a, a0, a1) in enumerate(x.runs):
        for j, (b, b0, b1) in enumerate(y.runs):
            if x.block == y.block and i > j:
                continue
            left, right, sx, sy = np.arange(a0, a1), np.arange(b0, b1), None, None
            gap = 0 if p is None or a == b else float(np.linalg.norm(p[a] - p[b]))
            if gap > NARROW:
                # Along the axis from pivot to pivot, with its bisector at 0: x's side and y's.
                sx = (x.own(p)[a0:a1] - to_y[j, a0:a1]) / gap
                sy = (y.own(p)[b0:b1] - to_x[i, b0:b1]) / gap
                reach = radius + slack
                left, right = left[sx <= reach - sy.min()], right[sy <= reach - sx.min()]
                if not len(left) or not len(right):
                    continue
                sx, sy = sx[left - a0], sy[right - b0]
                to_left, to_right = np.argsort(sx), np.argsort(sy)
                left, right, sx, sy = left[to_left], right[to_right], sx[to_left], sy[to_right]
            others = np.ascontiguousarray(y.head[right].T)
            for k in range(0, len(left), TILE_ROWS):
                n = len(right) if sx is None else int(np.searchsorted(sy, reach - sx[k], "right"))
                if not n:
                    break
                for c in range(0, n, TILE_COLUMNS):
                    g, h = _links(x, y, left[k : k + TILE_ROWS], right[c : min(n, c + TILE_COLUMNS)], others[:, c : min(n, c + TILE_COLUMNS)], threshold, margin)
                    if x.block == y.block and i == j:
                        g, h = g[g < h], h[g < h]
                    if len(g):
                        yield g, h


def _links(x: Block, y: Block, left: np.ndarray, right: np.ndarray, heads: np.ndarray, threshold: float, margin: float):
    """Pairs of places, of left in x and of right in y, that link."""
    n, low = len(right), threshold - margin
    hits = np.flatnonzero(x.head[left] @ heads >= low)
    if len(hits) * 32 > len(left) * n:
        dots = (x.thin[left] @ y.thin[right].T).ravel()
        hits = np.flatnonzero(dots >= low)
        near, g, h = dots[hits], left[hits // n], right[hits % n]
    else:
        g, h = left[hits // n], right[hits % n]
        near = np.einsum("ij,ij->i", x.thin[g], y.thin[h])
        some = near >= low
        near, g, h = near[some], g[some], h[some]
    keep = near >= threshold + margin
    step = max(1, STEP_ROWS * 64 // max(64, x.dim))
    for k in range(0, len(unsure := np.flatnonzero(~keep)), step):
        some = unsure[k : k + step]
        u, w = units(x.raw[g[some]]), units(y.raw[h[some]])
        keep[some] = (cosine(u, w) >= threshold) | (u == w).all(axis=1)
    return g[keep], h[keep]


def _roots(up: np.ndarray, at: np.ndarray) -> np.ndarray:
    roots, far = up[at], False
    while ((above := up[roots]) != roots).any():
        roots, far = above, True
    if far:
        up[at] = roots
    return roots


def _tie(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of each of a with its b. Roots are the smallest members."""
    while True:
        ra, rb = _roots(up, a), _roots(up, b)
        if not (apart := np.flatnonzero(ra != rb)).size:
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        up[np.maximum(ra, rb)] = np.minimum(ra, rb)


def _join(threshold: float, pivots: dict[int, np.ndarray], kind: type):
    """Over pairs of blocks: how many partners each class has there, and spanning links."""

    def run(batches):
        at, names, links, up = {}, [], np.zeros(0), np.zeros(0, np.int64)
        x = None
        for batch in batches:
            for r in range(batch.num_rows):
                # The product goes through all right blocks for each left one.
                if x is None or x.block != batch.column(0)[r].as_py():
                    x = Block(batch.columns[:5], r, kind)
                y = x if batch.column(5)[r].as_py() == x.block else Block(batch.columns[5:], r, kind)
                for s in (x, y):
                    if s.block not in at:
                        at[s.block] = len(up)
                        names.append((s.block << SLOT_BITS) + np.arange(len(s.raw)))
                        links, up = np.append(links, np.zeros(len(s.raw))), np.append(up, len(up) + np.arange(len(s.raw)))
                ox, oy = at[x.block], at[y.block]
                for a, b in _near(x, y, pivots, threshold):
                    links[ox : ox + len(x.raw)] += np.bincount(a, weights=y.copies[b], minlength=len(x.raw))
                    links[oy : oy + len(y.raw)] += np.bincount(b, weights=x.copies[a], minlength=len(y.raw))
                    _tie(up, ox + a, oy + b)
                del y, s
        if not names:
            return
        names, linked = np.concatenate(names), np.flatnonzero(links)
        roots = _roots(up, linked)
        for k in range(0, len(linked), 50_000):
            some = linked[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(links[some].astype(np.int64)), pa.array(names[roots[k : k + 50_000]])], names=["rep", "links", "root"])

    return run


def _members(batches):
    """The rows of blocks: vec_id, class (negative: links with nothing), the class's size and its
    smallest vec_id."""
    for b in batches:
        for block, ids, slots, copies in zip(*(b.column(c) for c in ("block", "ids", "slots", "copies")), strict=True):
            name, slot, n = block.as_py() << SLOT_BITS, slots.values.to_numpy().astype(np.int64), np.frombuffer(copies.as_py(), np.int64)
            vec_id, none = ids.values, ids.values.is_null().to_numpy(zero_copy_only=False)
            value = pc.fill_null(vec_id, 0).to_numpy()
            if not len(n):
                count, reps, low, lows = np.ones(len(slot), np.int64), -1 - name - np.arange(len(slot)), value, none
            else:
                least, some = np.full(len(n), np.iinfo(np.int64).max), np.zeros(len(n), bool)
                np.minimum.at(least, slot[~none], value[~none])
                some[slot[~none]] = True
                count, reps, low, lows = n[slot], name + slot, least[slot], ~some[slot]
            yield pa.RecordBatch.from_arrays([vec_id, pa.array(reps), pa.array(count), pa.array(low, mask=lows)], names=["vec_id", "rep", "copies", "low"])


def _pivots(rows: DataFrame, kind: type) -> tuple[dict[int, np.ndarray], int]:
    """Pivots of each vector length with many vectors, and the number of blocks to aim at."""
    sizes = {r["dim"]: r["n"] for r in rows.groupBy(F.coalesce(F.size("embedding"), F.lit(0)).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(100).collect()}
    n, held = sum(sizes.values()), sum(max(0, d) * k for d, k in sizes.items()) * np.dtype(kind).itemsize
    parts = max(1, min(LEAST_PARTS, n // 1024), -(-4 * n // (3 * BLOCK_ROWS)), -(-4 * held // (3 * BLOCK_BYTES)))
    fans, left, room = {}, FAN, PIVOT_BYTES
    for dim, k in sizes.items():
        fan = min(-(-k // CELL_ROWS), left, room // (4 * dim)) if dim > 0 and k > RECUT * CELL_ROWS else 0
        if fan > 1:
            fans[dim], left, room = fan, left - fan, room - fan * 4 * dim
    if not fans:
        return {}, parts
    # The first by hash. Only hashes that may be among them are sorted.
    few = F.lit(False)
    for dim, fan in fans.items():
        few = few | ((F.size("embedding") == dim) & (F.pmod("h", F.lit(max(1, sizes[dim] // (8 * fan)))) == 0))
    fan_of = F.create_map(*(F.lit(x) for kv in fans.items() for x in kv))
    picked = rows.withColumn("h", F.xxhash64("embedding")).where(few).groupBy("h").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    picked = picked.withColumn("number", F.row_number().over(Window.partitionBy("dim").orderBy("h"))).where(F.col("number") <= F.element_at(fan_of, F.col("dim")))
    found = {}
    for r in picked.select("embedding").collect():
        for dim, _, v in by_length(pa.array([r["embedding"]], pa.list_(pa.float64()))):
            found.setdefault(dim, []).append(units(v)[0])
    return {d: np.array(sorted(map(tuple, v)), np.float32) for d, v in found.items()}, parts


def near_duplicates(table: DataFrame, threshold: float = COSINE) -> DataFrame:
    """Per row of table (vec_id, embedding): vec_id, n_links, component_id, kept."""
    spark = table.sparkSession
    tune(spark)
    given = table.schema["embedding"].dataType
    kind, item = (np.float32, "float") if isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType) else (np.float64, "double")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{item}>").alias("embedding"))
    pivots, parts = _pivots(rows, kind)
    dealt = rows.mapInArrow(_deal(pivots, kind), CELLS)
    # Many vectors of one cell, and those that can't link, are cut by their vec_id.
    dealt = dealt.repartitionByRange(parts, "dim", "cell", F.xxhash64("vec_id")).coalesce(parts).sortWithinPartitions("dim", "cell")
    blocks, _ = materialize(dealt.mapInArrow(_pack(parts, kind), BLOCKS), "blocks")
    one = blocks.where("dim > 0").select("block", "dim", "vec", "cell", "copies")
    x, y = one, one.select(*(F.col(c).alias(f"{c}_") for c in one.columns)).hint("shuffle_replicate_nl")
    # Each two blocks once, in turns as the left one; a condition with equal keys would shuffle them.
    turn = (F.col("block") == F.col("block_")) | ((F.col("block") < F.col("block_")) == (F.pmod(F.col("block") + F.col("block_"), F.lit(2)) == 0))
    pairs = x.join(y, (F.abs(F.col("dim") - F.col("dim_")) < 1) & turn)
    joined, joined_at = materialize(pairs.mapInArrow(_join(threshold, pivots, kind), "rep long, links long, root long"), "joined")
    ties, ties_at = components(joined.where("root <> rep").select("rep", "root"))
    # Components are found on names of the classes and then named by their smallest vec_id.
    members = blocks.select("block", "ids", "slots", "copies").mapInArrow(_members, MEMBERS)
    tied = ties.select(F.col("v").alias("rep"), F.col("r").alias("root"))
    tied = tied.unionByName(tied.select(F.col("root").alias("rep"), "root").distinct())
    lows = tied.join(members.groupBy("rep").agg(F.min("low").alias("low")), "rep").groupBy("root").agg(F.min("low").alias("name"))
    named = looked_up(tied, lows, "root", "rep", tied.count()).select("rep", "name")
    counted, _ = materialize(joined.groupBy("rep").agg(F.sum("links").alias("links")).join(named, "rep", "left"), "counted")
    release(spark, joined_at, *ties_at)
    out = members.join(counted, "rep", "left")
    root = F.when(F.col("vec_id").isNotNull(), F.coalesce("name", "low"))
    links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    return out.select("vec_id", links.cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(F.col("vec_id") == root, F.lit(True)).alias("kept"))
