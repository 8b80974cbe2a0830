"""Embedding near-duplicates by counting collisions of one-dimensional projections.

At a cosine of 0.95 a window on one projection passes a pair at the limit at most 4.5 times as readily as any other pair, so
windows on single projections alone leave a share of all pairs to be counted, however many there are. Vectors are therefore
dealt out first: in each of several tables by the cells of a few projections together, as many as keep a cell small at the
number of vectors there is, and as many tables as find a pair at the limit together. Within a cell vectors are sorted by a
further projection, each query meets the run in its window, collisions in the windows of many more projections are counted,
and pairs that reach the calibrated count are verified in double precision. A pair counts in the first table in which it
meets. Link counts and spanning links leave a task, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import columns, connected_components, dropped, matched, written
from pixelloom.llm.minhash import _letters, mix

COSINE = 0.95
#: Projections counted, half a window in standard deviations of a projected difference at the limit, recall of the count.
PROJECTIONS, HALF_WINDOW, RECALL = 24, 1.5, 0.998
#: The same for the projection by which a cell is sorted: misses 0.1 % of pairs at the limit.
LEAD_WINDOW = 3.3
#: Width of a cell on one projection, in the same unit; vectors that a cell should hold; share of pairs at the limit that meet in some table; tables at most.
CELL, ROWS, MEET, TABLES = 4.0, 512, 0.98, 128
#: Projections on which the crowding of cells is measured.
MEASURED = 8
#: A cell of more vectors is compared block by block.
BLOCK = 1024
TILE = 256
SEED = 7


def directions(dim: int, n: int) -> np.ndarray:
    """``n`` random directions, orthogonal as far as the dimension allows."""
    rng = np.random.default_rng(SEED)
    found = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-n // dim))]
    return np.concatenate(found, axis=1)[:, :n]


def deviation(dim: int, cosine: float = COSINE) -> float:
    """Of the projection, on a random direction, of the difference of two unit vectors at the limit."""
    return math.sqrt(2 - 2 * cosine) / math.sqrt(dim)


def least_count(n: int = PROJECTIONS, half: float = HALF_WINDOW, recall: float = RECALL) -> int:
    """The largest count that a pair at the limit reaches with the probability ``recall``."""
    p = math.erf(half / math.sqrt(2))
    reached, count = 0.0, n
    while True:
        reached += math.comb(n, count) * p**count * (1 - p) ** (n - count)
        if reached >= recall or count == 0:
            return count
        count -= 1


def usable(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & F.coalesce(sound, F.lit(False)))


def meeting() -> float:
    """The chance that a pair at the limit shares a cell of one projection, cells being placed at random."""
    return math.erf(CELL / math.sqrt(2)) - math.sqrt(2 / math.pi) / CELL * (1 - math.exp(-CELL * CELL / 2))


def plan(n: int, crowding: float) -> tuple[int, int]:
    """Projections a table and tables, for ``n`` vectors, if any two share a cell of one projection with the chance ``crowding``."""
    if n <= ROWS:
        return 0, 1
    width = max(1, math.ceil(math.log(n / ROWS) / -math.log(min(crowding, 0.9))))
    while True:
        tables = max(1, math.ceil(math.log(1 - MEET) / math.log(1 - meeting() ** width)))
        if tables <= TABLES:
            return width, tables
        width -= 1


_directions: dict[tuple[int, int], np.ndarray] = {}


def directions_of(dim: int, n: int = PROJECTIONS + 1) -> np.ndarray:
    if (dim, n) not in _directions:
        _directions[dim, n] = directions(dim, n)
    return _directions[dim, n]


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def cells_on(units: np.ndarray, n: int) -> np.ndarray:
    """The cell of each vector on each of ``n`` projections, whose cells begin at random places."""
    dim = units.shape[1]
    shift = np.random.default_rng(SEED + 1).random(n)
    return np.floor(units @ directions_of(dim, PROJECTIONS + 1 + n)[:, PROJECTIONS + 1 :] / (CELL * deviation(dim)) + shift).astype(np.int64)


def by_dimension(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, places and unit vectors of the rows of a batch."""
    lists = batch.column(column)
    sizes, flat, starts = np.diff(lists.offsets.to_numpy()), lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield int(dim), at, unit(flat[starts[at][:, None] + np.arange(dim)])


def crowding(distinct: DataFrame, n: int) -> float:
    """The chance that two of ``n`` vectors share a cell of one projection: counted over all vectors, the mean of some projections."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, units in by_dimension(batch, 0):
                found = cells_on(units, MEASURED)
                for k in range(MEASURED):
                    cell, count = np.unique(found[:, k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), dim), pa.int32()), pa.array(np.full(len(cell), k), pa.int32()), pa.array(cell), pa.array(count, pa.int64())], names=["dim", "k", "cell", "n"])

    counted = distinct.select("embedding").mapInArrow(place, "dim int, k int, cell long, n long").groupBy("dim", "k", "cell").agg(F.sum("n").alias("n"))
    shares = counted.groupBy("k").agg((F.sum(F.col("n") * F.col("n").cast("double")) / float(n) ** 2).alias("p")).collect()
    return math.exp(sum(math.log(max(r.p, 1e-9)) for r in shares) / len(shares))


def placed(distinct: DataFrame, width: int, tables: int) -> DataFrame:
    """``distinct`` with its dimension and its cell in each table."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                dims, codes = np.zeros(batch.num_rows, np.int32), np.zeros((batch.num_rows, tables), np.int32)
                for dim, at, units in by_dimension(batch, 2):
                    dims[at] = dim
                    if width:
                        found = cells_on(units, width * tables).reshape(len(at), tables, width).astype(np.uint64)
                        mixed = mix((mix(found) * _letters[:width]).sum(axis=2, dtype=np.uint64))
                        codes[at] = (mixed & np.uint64(0x7FFFFFFF)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), lists], names=["head", "copies", "embedding", "dim", "codes"])

    kind = distinct.schema["embedding"].dataType.simpleString()
    return distinct.mapInArrow(place, f"head long, copies long, embedding {kind}, dim int, codes array<int>")


def linked(units_a: np.ndarray, units_b: np.ndarray, same: bool, cosine: float = COSINE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the rows of two blocks that are found and verified; of one block with itself, each pair once.

    Windows of the projection by which a block is sorted bound the rows that meet, collisions in the others are counted.
    """
    dim = units_a.shape[1]
    sigma, need = deviation(dim, cosine), least_count()
    scale = min(32000.0, 2000.0 / sigma)
    sides = []
    for units in (units_a, units_b):
        projected = units @ directions_of(dim)
        order = np.argsort(projected[:, 0], kind="stable")
        sides.append((order, projected[order, 0], np.clip(np.round(projected[order, 1:].T * scale), -32000, 32000).astype(np.int32)))
    (order_a, lead_a, counted_a), (order_b, lead_b, counted_b) = sides
    reach, half = LEAD_WINDOW * sigma, math.ceil(HALF_WINDOW * sigma * scale) + 1
    for start in range(0, len(order_a), TILE):
        rows = slice(start, min(start + TILE, len(order_a)))
        lo, hi = np.searchsorted(lead_b, lead_a[rows][0] - reach), np.searchsorted(lead_b, lead_a[rows][-1] + reach, side="right")
        if same:
            lo = max(lo, start)
        if lo >= hi:
            continue
        met = (np.abs(lead_a[rows][:, None] - lead_b[None, lo:hi]) <= reach).astype(np.uint8) * np.uint8(200)
        for a, b in zip(counted_a, counted_b, strict=True):
            met += np.abs(a[rows][:, None] - b[None, lo:hi]) <= half
        i, j = np.nonzero(met >= 200 + need)
        if same:
            keep = lo + j > start + i
            i, j = i[keep], j[keep]
        for k in range(0, len(i), 65536):
            x, y = order_a[start + i[k : k + 65536]], order_b[lo + j[k : k + 65536]]
            close = np.einsum("ij,ij->i", units_a[x], units_b[y]) >= cosine
            yield x[close], y[close]


def blocks_of(vectors: DataFrame) -> DataFrame:
    """(dim, t, code, sub, heads, copies, data, codes): the vectors of each cell with two or more, in blocks."""
    each = vectors.select("dim", F.posexplode("codes").alias("t", "code"), "head", "copies", "embedding", "codes")
    sizes = written(vectors.select("dim", F.posexplode("codes").alias("t", "code")).groupBy("dim", "t", "code").agg(F.count("*").alias("n")).where("n > 1"), "cells")
    cut = matched(each, sizes, ["dim", "t", "code"], "n").withColumn("sub", F.pmod(F.xxhash64("head"), F.ceil(F.col("n") / BLOCK)).cast("int"))
    rows = cut.groupBy("dim", "t", "code", "sub").agg(F.collect_list(F.struct("head", "copies", "embedding", "codes")).alias("rows"))
    return rows.select("dim", "t", "code", "sub", F.col("rows.head").alias("heads"), F.col("rows.copies").alias("copies"), F.flatten("rows.embedding").alias("data"), F.flatten("rows.codes").alias("codes"))


def compared(blocks: DataFrame, tables: int, cosine: float) -> DataFrame:
    """(head, links, label): links of the vectors of each block, with itself and with others of its cell, and the least id they reach there."""
    sides = ("heads", "copies", "data", "codes")
    names = blocks.select("dim", "t", "code", "sub")
    pairs = names.join(names.withColumnRenamed("sub", "sub2"), ["dim", "t", "code"]).where("sub < sub2")
    left = pairs.join(blocks, ["dim", "t", "code", "sub"])
    both = left.join(blocks.select("dim", "t", "code", F.col("sub").alias("sub2"), *(F.col(c).alias(c + "2") for c in sides)), ["dim", "t", "code", "sub2"])
    alone = blocks.select("dim", "t", *sides, *(F.lit(None).cast(blocks.schema[c].dataType).alias(c + "2") for c in sides))
    both = alone.union(both.select("dim", "t", *sides, *(c + "2" for c in sides)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for k in range(batch.num_rows):
                dim, t, same = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), not batch.column(6)[k].is_valid
                found = []
                for at in (2, 2 if same else 6):
                    heads, copies, data, codes = (batch.column(at + i)[k].values.to_numpy(zero_copy_only=False) for i in range(4))
                    found.append((heads, copies, unit(data.reshape(-1, dim)), codes.reshape(-1, tables)[:, :t]))
                (ha, ca, ua, ka), (hb, cb, ub, kb) = found
                na, nb = np.zeros(len(ha), np.int64), np.zeros(len(hb), np.int64)
                forest = Forest(np.concatenate([ha, hb]))
                for x, y in linked(ua, ub, same, cosine):
                    new = ~(ka[x] == kb[y]).any(axis=1)  # a pair that met in an earlier table is counted there
                    x, y = x[new], y[new]
                    np.add.at(na, x, cb[y])
                    np.add.at(nb, y, ca[x])
                    forest.join(x, y + len(ha))
                heads, counts, labels = np.concatenate([ha, hb]), np.concatenate([na, nb]), forest.labels()
                some = np.flatnonzero(counts)
                out.append((heads[some], counts[some], labels[some]))
                if len(out) > 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i in range(3)], names=["head", "links", "label"])
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i in range(3)], names=["head", "links", "label"])

    return both.mapInArrow(compare, "head long, links long, label long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Null, zero and non-finite vectors and those with null components link with nothing; nor do vectors of different
    dimensions. Rows with equal vectors count as links of each other. Rows that repeat a vec_id are one vector if they agree,
    else their links are counted together and their components joined. Null vec_ids link with nothing.
    Further columns are ignored; an empty table gives no rows.
    """
    floats = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    vectors = columns(vectors, "vec_id", "embedding").withColumn("embedding", F.col("embedding").cast("array<float>" if floats else "array<double>"))
    sound = usable(vectors).distinct()
    distinct = written(sound.groupBy("embedding").agg(F.min("vec_id").alias("head"), F.count("*").alias("copies")).select("head", "copies", "embedding"), "distinct")
    n = distinct.count()
    width, tables = plan(n, crowding(distinct, n) if n > ROWS else 1.0)
    dealt = written(placed(distinct, width, tables), "cells")
    found = written(compared(written(blocks_of(dealt), "blocks"), tables, cosine), "links")
    dropped(dealt)
    links = found.groupBy("head").agg(F.sum("links").alias("links"))
    shared = sound.groupBy("vec_id").agg(F.count("*").alias("c")).where("c > 1")
    groups = connected_components(found.select("head", "label").union(sound.join(shared, "vec_id").join(distinct, "embedding").select("head", F.col("vec_id").alias("label"))))
    heads = distinct.join(links, "head", "left").join(groups, distinct["head"] == groups["id"], "left").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "head").alias("component"))
    per_id = sound.join(heads, "embedding").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    out = vectors.select("vec_id").join(per_id, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


class Forest:
    """Least ids reachable among the rows of two blocks."""

    def __init__(self, ids: np.ndarray):
        _, first, self.node = np.unique(ids, return_index=True, return_inverse=True)
        self.ids = ids[first]
        self.root = np.arange(len(self.ids))

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        a, b = self.node[x], self.node[y]
        while True:
            ra, rb = self.root[a], self.root[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            if (low == high).all():
                return
            np.minimum.at(self.root, high, low)
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def labels(self) -> np.ndarray:
        return self.ids[self.root[self.node]]
