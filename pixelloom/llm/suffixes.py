"""Repeated passages through enhanced suffix arrays, dealt out by content-chosen anchors.

Every 200-byte window has an anchor: the 32 bytes within it whose hash is least. Equal windows have equal anchors at equal
places, so that all occurrences of a passage meet at its anchors. The suffixes (and prefixes) of one anchor's occurrences
make up a suffix array of their own; a stack scan over its common-prefix intervals, each split by how far its members agree
to the left, gives the maximal repeats with all their occurrences. Occurrences with equal surroundings are merged first.

The suffix array of an anchor with very many surroundings is split by the bytes next to the anchor: two suffixes that share
200 bytes with what precedes them meet in exactly one of the parts, by how many of the bytes stand to the right.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pixelloom.llm.common import aside, columns, dropped, matched, with_text, written
from pixelloom.llm.minhash import _base, _inverse, _letters, mix, powers

WINDOW, ANCHOR = 200, 32
CHUNK = 1 << 21
#: A suffix array of more entries than this is split: at first by so many lengths of the bytes to the right, then by each length.
SPLIT, PARTS = 4096, 8


def chunks(raw: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    k = 0
    while k < len(raw):
        took, n = k, 0
        while took < len(raw) and (took == k or n + len(raw[took]) <= size):
            n += len(raw[took])
            took += 1
        yield k, raw[k:took]
        k = took


def sums(buffer: np.ndarray) -> np.ndarray:
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_letters[buffer] * powers(len(buffer), _base, "up"), out=total[1:])
    return total


def spans_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((total[end] - total[start]) * powers(len(total), _inverse, "down")[start] + (end - start).astype(np.uint64))


def window_anchors(raw: list[bytes], window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Per run of windows with one anchor: text number, hash of the anchor, hash of the run's bytes, first and last window, anchor."""
    edges = np.cumsum([0, *map(len, raw)])
    n = int(edges[-1])
    if n < window:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    buffer = np.frombuffer(b"".join(raw), np.uint8)
    total, span = sums(buffer), window - anchor + 1
    at = np.arange(n - anchor + 1)
    grams = spans_hash(total, at, at + anchor)
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    padded = np.full(-(-len(keys) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - window + 1], ahead[span - 1 : n - window + span])
    least = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(raw)), np.diff(edges))
    valid = owner[: n - window + 1] == owner[window - 1 :]
    new = np.append(True, (least[1:] != least[:-1]) | (owner[1 : n - window + 1] != owner[: n - window])) | np.append(True, valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n - window + 1) - 1
    first, last = first[valid[first]], last[valid[first]]
    doc, place = owner[first], least[first]
    return doc, grams[place].view(np.int64), spans_hash(total, first, last + window).view(np.int64), first - edges[doc], last - edges[doc], place - edges[doc]


def row_key():
    """Stands for a row by its id and text; rows that agree in both are treated alike."""
    return F.xxhash64("doc_id", "text").alias("key")


def anchors(docs: DataFrame) -> DataFrame:
    """(key, h, c, p1, p2, m): see ``window_anchors``; key stands for the row's id and text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                key = batch.column(0).to_numpy()
                raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
                for at, some in chunks(raw):
                    doc, h, c, p1, p2, m = window_anchors(some)
                    yield pa.RecordBatch.from_arrays([pa.array(key[at + doc]), pa.array(h), pa.array(c), *(pa.array(x, pa.int32()) for x in (p1, p2, m))], names=["key", "h", "c", "p1", "p2", "m"])

    return docs.select(row_key(), "text").mapInArrow(find, "key long, h long, c long, p1 int, p2 int, m int")


def common(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many bytes each row shares with the row before it."""
    differ = rows[1:] != rows[:-1]
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(n, np.minimum(lengths[1:], lengths[:-1]))


def padded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([*map(len, strings)])
    width = max(1, int(lengths.max()))
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width), lengths


def intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """The common-prefix intervals (length, first, last) of a suffix array, inner ones before outer ones."""
    stack = [(0, 0)]
    for i, depth in enumerate([*lcp.tolist(), 0], 1):
        first = i - 1
        while stack and stack[-1][0] > depth:
            length, first = stack.pop()
            yield length, first, i - 1
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))


def maximal_repeats(left: list[bytes], right: list[bytes], least: int = WINDOW, depths: tuple[int, int] | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Maximal repeats among occurrences of one anchor, of at least ``least`` bytes.

    ``left`` holds what precedes each occurrence, read backwards, ``right`` what begins with it, in sorted order. Each
    interval of the right sides is sorted by its left sides. Where neighbours agree far enough, they belong to one repeat;
    where they don't, the interval is left-diverse. Yields: bytes shared to the left by all members and to the right, the
    members, and how far each agrees to the left with the member nearest to it. ``depths`` bounds the bytes shared to the
    right, for a part of a suffix array.
    """
    rights, right_n = padded(right)
    lefts, left_n = padded(left)
    order = np.array(sorted(range(len(left)), key=left.__getitem__))
    rank = np.empty(len(left), np.int64)
    rank[order] = np.arange(len(left))
    for length, first, last in intervals(common(rights, right_n)):
        if depths and not depths[0] <= length < depths[1]:
            continue
        members = order[np.sort(rank[first : last + 1])] if last - first + 1 < len(left) else order
        agree = common(lefts[members], left_n[members])
        near = np.maximum(np.append(0, agree), np.append(agree, 0))
        ends = np.append(np.flatnonzero(agree < least - length), len(agree))
        start = 0
        for end in ends:
            if end > start:
                yield int(agree[start:end].min()), length, members[start : end + 1], near[start : end + 1]
            start = end + 1


def surroundings(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(h, c, kinds, key, m, before, after): the bytes around the anchor of one occurrence of each class."""
    wanted = classes.groupBy("key").agg(F.collect_list(F.struct("h", "c", "kinds", "p1", "p2", "m")).alias("at"))
    texts = docs.select(row_key(), "text").join(wanted, "key").dropDuplicates(["key"]).select("key", "text", "at")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for key, text, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.encode()
                for x in at:
                    m = x["m"]
                    for column, value in zip(out, (x["h"], x["c"], x["kinds"], key, m, raw[x["p1"] : m][::-1], raw[m : x["p2"] + WINDOW]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["h", "c", "kinds", "key", "m", "before", "after"])

    return texts.mapInArrow(slices, AROUND)


AROUND_COLUMNS = ["h", "c", "kinds", "key", "m", "before", "after"]
AROUND = "h long, c long, kinds long, key long, m int, before binary, after binary"


def parted(around: DataFrame, parts: int) -> DataFrame:
    """``around`` with new (g, low, high): the part of the anchor's suffix array, and which lengths to the right it is for.

    Of two suffixes that share 200 bytes or more, r of them to the right with low <= r < high, each has the same first low
    bytes to the right and the same 201 - high to the left: they are in one part, and no others need be. Suffixes too short
    for a part aren't in it.
    """
    cuts = [ANCHOR + (WINDOW + 1 - ANCHOR) * i // parts for i in range(parts + 1)]
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("low"), F.lit(b if b <= WINDOW else 1 << 30).alias("high"), F.lit(WINDOW + 1 - b).alias("back")) for a, b in zip(cuts, cuts[1:], strict=False))))
    within = (F.col("cut.low") >= F.col("low")) & (F.col("cut.low") < F.col("high"))
    long_enough = around.select("*", each.alias("cut")).where(within & (F.length("after") >= F.col("cut.low")) & (F.length("before") >= F.col("cut.back")))
    part = F.xxhash64("h", "cut.low", F.expr("substring(after, 1, cut.low)"), F.expr("substring(before, 1, cut.back)"))
    return long_enough.select(*AROUND_COLUMNS, part.alias("g"), F.col("cut.low").alias("low"), F.col("cut.high").alias("high"))


def suffix_arrays(around: DataFrame, split: int) -> tuple[DataFrame, DataFrame]:
    """Suffix arrays of at most ``split`` entries, as ``parted`` makes them; and what shares 200 bytes at one place in larger groups.

    The latter are intervals of a depth that is known, whose members need no scan.
    """
    around = around.select("*", F.col("h").alias("g"), F.lit(ANCHOR).alias("low"), F.lit(1 << 30).alias("high"))
    every, large = around.where(F.col("kinds") <= split), around.where(F.col("kinds") > split)
    for parts in (PARTS, WINDOW + 1 - ANCHOR):
        large = written(parted(large, parts), "parts")
        sizes = written(large.groupBy("g").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        large = matched(large, sizes, ["g"], "size")
        if parts == PARTS:
            every = every.union(large.where(F.col("size") <= split).drop("size"))
            large = large.where(F.col("size") > split).drop("size")
    return every, large


REPEATS = "repeat long, key long, m int, h long, c long, back int, ahead int, whole int"


def groups_of_repeats(arrays: DataFrame) -> DataFrame:
    """(repeat, key, m, h, c, back, ahead, whole): the maximal repeats of each suffix array with all their classes.

    ``back`` and ``ahead`` bound what an occurrence shares with its nearest fellow, from the anchor at m on; ``whole`` is
    what all of them share.
    """
    names = ["repeat", "key", "m", "h", "c", "back", "ahead", "whole"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[list] = [[] for _ in names]

        def one_array() -> None:
            g, low, high = held[0][:3]
            found = maximal_repeats([x[7] for x in held], [x[8] for x in held], depths=(low, high))
            for k, (shared, length, members, near) in enumerate(found):
                repeat = int(mix(np.array([g, k], np.int64).view(np.uint64) * _letters[:2]).sum().view(np.int64))
                for i, l in zip(members.tolist(), near.tolist(), strict=True):
                    key, m, h, c = held[i][3:7]
                    for column, value in zip(out, (repeat, key, m, h, c, l, length, shared + length), strict=True):
                        column.append(value)

        def flushed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)
            for column in out:
                column.clear()
            return made

        with np.errstate(over="ignore"):
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                    if held and held[-1][0] != row[0]:
                        one_array()
                        held.clear()
                    held.append(row)
                if len(out[0]) > 10_000:
                    yield flushed()
            if held:
                one_array()
        yield flushed()

    near = arrays.select("g", "low", "high", "key", "m", "h", "c", "before", "after").repartition("g").sortWithinPartitions("g", "after", "before")
    return near.mapInArrow(scan, REPEATS)


def classed(docs: DataFrame, split: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Anchors that stand twice or more, with n, how many have the same surroundings; classes of those; groups of classes that repeat each other."""
    docs = columns(docs, "doc_id", "text")
    found = written(anchors(docs), "all")
    met = written(found.groupBy("h").agg(F.count("*").alias("total")).where("total > 1"), "met")
    rows = written(matched(found, met, ["h"], "total").drop("total"), "anchors")
    dropped(found)
    classes = written(rows.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("key", "p1", "p2", "m")).alias("one")), "classes")
    kinds = written(classes.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    around = written(surroundings(matched(classes, kinds, ["h"], "kinds").select("h", "c", "kinds", "one.*"), docs), "surroundings")
    arrays, known = suffix_arrays(around, split)
    certain = known.select(F.col("g").alias("repeat"), "key", "m", "h", "c", (F.lit(WINDOW) - F.col("low")).alias("back"), F.col("low").alias("ahead"), F.lit(WINDOW).alias("whole"))
    return rows, classes, written(groups_of_repeats(arrays).union(certain), "repeats")


def repeated(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Occurrences whose surroundings stand elsewhere just the same."""
    return matched(rows, written(classes.where("n > 1").select("h", "c", "n"), "alike"), ["h", "c"], "n")


def repeats(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """Spans (key, start, end) of bytes in windows that stand elsewhere too."""
    rows, classes, groups = classed(docs, split)
    whole = repeated(rows, classes).select("key", F.col("p1").alias("start"), (F.col("p2") + WINDOW).alias("end"))
    return whole.union(groups.select("key", F.col("m") - F.col("back"), F.col("m") + F.col("ahead")))


def repeat_groups(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """(repeat, key, start, end, whole): maximal repeats of 200 bytes or more around each anchor, with all their occurrences.

    ``key`` stands for the row, see ``row_key``; ``whole`` is what all occurrences share. Occurrences with equal
    surroundings are a group of their own, and belong to the larger groups that their surroundings are in.
    """
    rows, classes, groups = classed(docs, split)
    alike = repeated(rows, classes).select(F.xxhash64("h", "c").alias("repeat"), "key", F.col("p1").alias("start"), (F.col("p2") + WINDOW).alias("end"), (F.col("p2") + WINDOW - F.col("p1")).alias("whole"))
    sizes = written(classes.select("h", "c", "n"), "counts")
    members = written(matched(rows, sizes, ["h", "c"], "n").select("h", "c", "key", "m").join(groups.select("h", "c", "repeat", "back", "ahead", "whole"), ["h", "c"]), "members")
    return alike.union(members.select("repeat", "key", F.col("m") - F.col("back"), F.col("m") + F.col("ahead"), "whole"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def with_spans(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, put aside, with text and spans, what repeats take from them."""
    each = repeats(docs).distinct().groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return docs.select(*aside(docs), row_key(), "text").join(each, "key", "left").drop("key")


def digests(docs: DataFrame) -> DataFrame:
    """What repeated passages take from each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null and empty texts have no bytes. Repeated rows repeat each other and lose all that is long enough. Null doc_ids stay.
    Further columns are ignored; an empty table gives no rows.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for text, spans in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, found = (text or "").encode(), merged(spans)
                kept = cut(raw, found)
                for column, value in zip(out, (len(raw), len(raw) - len(kept), len(found), hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(docs.select("doc_id", "text")).select("text", "__0", "spans").mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def removed(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages taken out of text, and n_chars, whatever its type, to match; letters cut in two go as well.

    Null texts stay null. Repeated rows repeat each other. Further columns stay, whatever their names; an empty table gives
    no rows.
    """

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else cut(t.encode(), merged(s)).decode("utf-8", "ignore") if s else t for t, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(texts, pa.string())], names=[*batch.schema.names[2:], "said"])

    rows = with_spans(docs)
    others = [f"__{i}" for i, c in enumerate(docs.columns) if c not in ("text", "n_chars")]
    made = rows.select("text", "spans", *others).mapInArrow(strip, StructType([*(rows.schema[c] for c in others), StructField("said", StringType())]))
    return with_text(made, docs)
