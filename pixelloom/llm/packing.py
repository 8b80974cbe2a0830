"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

The plan needs only how many pieces of each length there are: best-fit decreasing runs over those counts, not over
documents, and hands out runs of equal slots. Each piece then finds its slot by its rank among the pieces of its length.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.common import columns, written
from pixelloom.llm.vocabulary import byte_bpe, encode_to_array

CAPACITY = 2048
END_ID = 0
#: Ranks are counted in parts of a length, so many that each holds about so many pieces even if one length has all of them.
PART_ROWS = 50_000


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over counts: rows (length, first rank, first sequence, per sequence, offset), by length and rank.

    Sequences with the same space left form ranges; items of one length fill the fullest range that still takes them. A
    length splits at most one range and adds at most three, so there are at most a few thousand ranges for any corpus.
    """
    space: dict[int, list[tuple[int, int]]] = defaultdict(list)
    runs, opened = [], 0

    def fill(length: int, rank: int, count: int, left: int, base: int, n: int) -> int:
        each = left // length
        used = min(n, math.ceil(count / each))
        placed = min(count, used * each)
        runs.append((length, rank, base, each, capacity - left))
        full, rest = divmod(placed, each)
        for at, many, after in ((base, full, left - each * length), (base + full, 1 if rest else 0, left - rest * length), (base + used, n - used, left)):
            if many and after:
                space[after].append((at, many))
        return placed

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        for left in sorted(x for x in space if x >= length):
            while count and space[left]:
                placed = fill(length, rank, count, left, *space[left].pop())
                rank, count = rank + placed, count - placed
            if not space[left]:
                del space[left]
            if not count:
                break
        if count:
            n = math.ceil(count / (capacity // length))
            fill(length, rank, count, capacity, opened, n)
            opened += n
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: a document's ids and the end id, cut only where they exceed ``capacity``; the first piece is the shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_bpe(vocabulary)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode_to_array(encoding, text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    for column, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return columns(docs, "doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Packs whole documents into sequences of at most ``capacity`` tokens.

    Null and empty texts are one end id. Repeated rows and repeated or null doc_ids are packed as rows of their own. An
    empty table gives no rows. Further columns are ignored.
    """
    cut = written(pieces(docs, vocabulary, capacity), "pieces")
    salts = 1 + cut.count() // PART_ROWS
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    parts = written(cut.groupBy("length", "salt").count(), "lengths")
    plan = plan_slots({r.length: r.n for r in parts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity)
    before = parts.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    ranked = cut.withColumn("at", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("at") + F.col("before")).alias("rank"))
    length, rank, base, each, offset = plan.T if len(plan) else np.zeros((5, 0), np.int64)
    key = length << 48 | rank

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, r = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            run = np.searchsorted(key, n << 48 | r, side="right") - 1
            k = r - rank[run]
            found = [base[run] + k // each[run], offset[run] + k % each[run] * n]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, found)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
