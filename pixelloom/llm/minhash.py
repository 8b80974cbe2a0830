"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

Documents with equal shingle sets are one class from the start. Of each bucket, only a star goes on to the exact check: the
member that shares most buckets with others is its centre. Where a bucket's members are not yet connected after that,
members of different components are compared too, so that a star's choice of centre loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import columns, connected_components, matched, rows_of, written

WORDS = 5
#: 128 bins in 32 bands of 4: a pair at similarity 0.75 meets in no band once in 190,000 times.
BINS, BAND = 128, 4
#: Links need 100 * intersection >= 75 * union.
PERCENT = 75
#: Open buckets of more members than SMALL are compared block by block.
SMALL, BLOCK = 64, 1024
#: A block holds at most so many bytes of hashes, or one set.
BLOCK_BYTES = 1 << 23
#: Bytes of text hashed at a time.
CHUNK = 1 << 21

_rng = np.random.default_rng(20240607)
_letters = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_places = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_lanes = _rng.integers(0, 1 << 63, BAND + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_base = 0x9E3779B97F4A7C15
_inverse = pow(_base, -1, 1 << 64)
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[32, *range(9, 14)]] = True
_edges = np.arange(BINS, dtype=np.uint64) << np.uint64(57)
#: For each empty bin, the bins it tries in turn until one is not empty: optimal densification.
_probes = np.array([_rng.permutation(BINS) for _ in range(BINS)])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: int, name: str) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        with np.errstate(over="ignore"):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers[name][:n]


def word_hashes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of lower-cased text; a letter's part in a hash depends only on its place in the word."""
    gap = _space[buffer]
    edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_letters[buffer] * powers(len(buffer), _base, "up"), out=total[1:])
    return starts, mix((total[ends] - total[starts]) * powers(len(buffer) + 1, _inverse, "down")[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted hashes of the distinct five-word shingles of each text; a shorter text is one shingle, an empty or null one none."""
    raw = [(x.as_py() or "").encode() for x in texts]
    k = 0
    while k < len(raw):
        took, n = k, 0
        while took < len(raw) and (took == k or n + len(raw[took]) < CHUNK):
            n += len(raw[took]) + 1
            took += 1
        buffer = _lower[np.frombuffer(b" ".join(raw[k:took]) + b" ", np.uint8)]
        starts, hashes = word_hashes(buffer)
        first = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in raw[k:took])]))
        rolled = sum((hashes[i : len(hashes) - WORDS + 1 + i] * _places[i] for i in range(WORDS)), np.zeros(max(0, len(hashes) - WORDS + 1), np.uint64)) if len(hashes) >= WORDS else hashes[:0]
        rolled = mix(rolled)
        for a, b in zip(first, first[1:], strict=False):
            if b - a >= WORDS:
                yield np.unique(rolled[a : b - WORDS + 1])
            elif b > a:
                yield mix(np.array([(hashes[a:b] * _places[: b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield hashes[:0]
        k = took


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least hash in each bin; bins are ranges of the hash, so that one sorted set gives all of them."""
    at = np.searchsorted(shingles, _edges)
    filled = np.append(at[1:], len(shingles)) > at
    least = shingles[np.minimum(at, len(shingles) - 1)]
    if not filled.all():
        empty = np.flatnonzero(~filled)
        probes = _probes[empty]
        least[empty] = least[probes[np.arange(len(empty)), filled[probes].argmax(axis=1)]]
    return least


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, bands): size and fingerprint of the shingle set, and its band keys."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = np.arange(BINS // BAND, dtype=np.uint64) * _lanes[BAND]
        with np.errstate(over="ignore"):
            for batch in batches:
                sizes, prints, bands = [], [], []
                for s in shingle_sets(batch.column(1)):
                    sizes.append(len(s))
                    prints.append((s.sum(dtype=np.uint64), mix(s ^ np.uint64(_base)).sum(dtype=np.uint64)))
                    bands.append(mix((signature(s).reshape(-1, BAND) * _lanes[:BAND]).sum(axis=1, dtype=np.uint64) + lanes).view(np.int64) if len(s) else ())
                f = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "f1", "f2", "bands"])

    return columns(docs, "doc_id", "text").mapInArrow(sketch, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>")


def verified(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those pairs (a, b) whose full shingle sets are similar enough."""
    texts = columns(docs, "doc_id", "text").where("doc_id is not null")
    left = pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
    both = left.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b").select("a", "b", "text_a", "text_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                new = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else b
                centres = list(shingle_sets(batch.column(3).take(pa.array(new, pa.int64()))))
                owner = np.searchsorted(new, np.arange(len(b)), side="right") - 1
                keep = []
                for x, at in zip(shingle_sets(batch.column(2)), owner, strict=True):
                    y = centres[at]
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return both.mapInArrow(compare, "a long, b long")


def star_pairs(buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b): each member of a bucket with the bucket's centre, the member that shares most buckets with others; and the buckets."""
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = buckets.join(sizes, "key")
    weight = shared.groupBy("id").agg(F.sum("n").alias("weight"))
    weighed = written(shared.select("key", "id").join(weight, "id"), "buckets")
    centres = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("c")).select("key", (-F.col("c.id")).alias("b"))
    return weighed.join(centres, "key").where("id != b").select(F.col("id").alias("a"), "b").distinct(), weighed


def links(docs: DataFrame, heads: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, component) of the class heads that have links."""
    buckets = heads.select(F.col("head").alias("id"), F.explode("bands").alias("key"))
    pairs, weighed = star_pairs(buckets)
    stars = written(pairs, "stars")
    # The texts that any comparison needs, so that all others are shuffled once.
    docs = written(rows_of(columns(docs, "doc_id", "text"), weighed.select(F.col("id").alias("doc_id")).distinct(), "doc_id"), "texts")
    edges = written(verified(stars, docs, percent), "links")
    groups = connected_components(edges)
    placed = weighed.join(groups, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    open_keys = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key", "n")
    rest = written(placed.join(open_keys, "key"), "open")
    few = rest.where(F.col("n") <= SMALL)
    x, y = few.alias("x"), few.alias("y")
    across = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component")))
    across = across.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = across.union(across_blocks(rest.where(F.col("n") > SMALL), docs, percent)).distinct().join(tried, ["a", "b"], "left_anti")
    more = written(verified(across, docs, percent), "links")
    if more.isEmpty():
        return groups
    return connected_components(edges.union(more))


def across_blocks(rest: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): of members of a large open bucket that belong to different components, the nearest pair of each two components.

    A bucket is dealt into blocks, and each two blocks meet in a task, which counts the shared shingles of all their members
    at once, by the same 64-bit hashes as the check of single pairs: a pair that comes up to the similarity here is a link.
    One for each two components leaves the task: no task holds a bucket, and no row is made for a pair of its members. A
    component that fills blocks of its own has them to itself, and those don't meet each other.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                made = [s.tobytes() for s in shingle_sets(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["id", "s"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at, part, size = None, 0, 0

        def block() -> pa.RecordBatch:
            _, ids, components, sets = zip(*held, strict=True)
            head = np.array([len(held), *ids, *components, *map(len, sets)], np.int64)
            blob = zstandard.compress(head.tobytes() + b"".join(sets))
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.string()), pa.array([part], pa.int32()), pa.array([held[0][0]], pa.int64()), pa.array([blob], pa.binary())], names=["key", "sub", "part", "own", "blob"])

        for batch in batches:
            for key, sub, own, i, component, s in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if held and (at != (key, sub) or size > BLOCK_BYTES):
                    yield block()
                    part = part + 1 if at == (key, sub) else 0
                    held, size = [], 0
                at = key, sub
                held.append((own, i, component, s))
                size += len(s)
        if held:
            yield block()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides = [unpacked(batch.column(i)[row].as_py()) for i in range(2) if batch.column(i)[row].is_valid]
                (ids, components, *left), (others, theirs, *right) = sides[0], sides[-1]  # a block may meet itself
                shared, sizes = shared_counts(left, right)
                i, j = np.nonzero(100 * shared >= percent * np.maximum(1, sizes - shared))
                i, j = (x[components[i] != theirs[j]] for x in (i, j))
                low, high = np.minimum(components[i], theirs[j]), np.maximum(components[i], theirs[j])
                _, one = np.unique(np.stack([low, high]), axis=1, return_index=True)
                a, b = ids[i[one]], others[j[one]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    ids = rest.select("id").distinct()
    sets = columns(docs, "doc_id", "text").join(ids, F.col("doc_id") == F.col("id")).select("id", "text").mapInArrow(hashes, "id long, s binary")
    sizes = written(rest.groupBy("key", "component").agg(F.count("*").alias("size")), "sizes")
    own = F.when(F.col("size") >= BLOCK, F.col("component"))
    deal = matched(rest, sizes, ["key", "component"], "size")
    sub = F.concat_ws(" ", own.cast("string"), F.pmod(F.xxhash64("id"), F.ceil(F.coalesce(F.when(own.isNotNull(), F.col("size")), F.col("n")) / BLOCK)).cast("string"))
    cut = deal.select("key", "id", "component", own.alias("own"), sub.alias("sub")).join(sets, "id").select("key", "sub", "own", "id", "component", "s")
    blocks = cut.repartition("key", "sub").sortWithinPartitions("key", "sub", "id").mapInArrow(pack, "key long, sub string, part int, own long, blob binary")
    blocks = written(blocks, "blocks")
    names = blocks.select("key", "sub", "part", "own")
    different = ((F.col("x.sub") < F.col("y.sub")) | (F.col("x.sub") == F.col("y.sub")) & (F.col("x.part") < F.col("y.part"))) & ~F.coalesce(F.col("x.own") == F.col("y.own"), F.lit(False))
    met = names.alias("x").join(names.alias("y"), (F.col("x.key") == F.col("y.key")) & different).select("x.key", "x.sub", "x.part", F.col("y.sub").alias("sub2"), F.col("y.part").alias("part2"))
    both = met.join(blocks.drop("own"), ["key", "sub", "part"]).withColumnRenamed("blob", "left")
    other = blocks.select("key", F.col("sub").alias("sub2"), F.col("part").alias("part2"), F.col("blob").alias("right"))
    both = both.join(other, ["key", "sub2", "part2"]).select("left", "right").union(blocks.where("own is null").select("blob", F.lit(None).cast("binary")))
    return both.mapInArrow(meet, "a long, b long")


def unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    """Ids, components, all hashes one after another and sizes of the sets of a block."""
    data = zstandard.decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ids, components, sizes = np.frombuffer(data, np.int64, 3 * n, 8).reshape(3, n)
    return ids, components, np.frombuffer(data, np.uint64, -1, 8 + 24 * n), sizes // 8


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 1 << 12) -> tuple[np.ndarray, np.ndarray]:
    """How many hashes each set of one block shares with each of the other, and the sums of their sizes."""
    flat, lengths = zip(left, right, strict=True)
    owner = [np.repeat(np.arange(len(n)), n) for n in lengths]
    both = np.intersect1d(*map(np.unique, flat), assume_unique=True)
    places = []
    for values in flat:
        at = np.minimum(np.searchsorted(both, values), max(0, len(both) - 1))
        hit = np.flatnonzero(both[at] == values) if len(both) else at[:0]
        order = hit[np.argsort(at[hit], kind="stable")]
        places.append((at[order], order))
    total = np.zeros((len(lengths[0]), len(lengths[1])), np.float32)
    for start in range(0, len(both), width):
        dense = []
        for (at, order), rows, n in zip(places, owner, lengths, strict=True):
            some = slice(*np.searchsorted(at, [start, start + width]))
            m = np.zeros((len(n), min(width, len(both) - start)), np.float32)
            m[rows[order[some]], at[some] - start] = 1
            dense.append(m)
        total += dense[0] @ dense[1].T
    return total, np.add.outer(*lengths)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Null and empty texts, and those of white space alone, have no shingles and are alone. Rows that repeat a doc_id get the
    least component of any of them. A null doc_id is linked with nothing and kept. Further columns are ignored; an empty
    table gives an empty result.
    """
    found = written(sketches(docs), "sketches")
    known = found.where("doc_id is not null and n_shingles > 0")
    classes = written(known.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("head"), F.first("bands").alias("bands")), "classes")
    groups = links(docs, classes.select("head", "bands"), percent)
    heads = classes.drop("bands").join(groups, classes["head"] == groups["id"], "left").select("n_shingles", "f1", "f2", F.coalesce("component", "head").alias("component_id"))
    return found.drop("bands").join(heads, ["n_shingles", "f1", "f2"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
