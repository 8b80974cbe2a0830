"""Byte-pair encoding through a table of distinct words, and decoding through a table of pieces.

Words are cut where no token can cross: before a run of white space that follows something else, and before a comma or
full stop that ends a word. Every distinct word of the corpus is encoded once, and decoded once: its ids are joined with the
table of pieces, and the pieces put together by position. A bounded number of the commonest go to all tasks; ids and decoded
bytes of the others are joined back by document and position, so no size of vocabulary is assumed.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pixelloom.llm.common import columns, dropped, matched, written
from pixelloom.llm.vocabulary import byte_bpe, encode_to_array, piece_table

#: At most so many words, of at most so many letters each, are sent to all tasks.
COMMON_WORDS, COMMON_LETTERS = 1 << 19, 40
#: So many of them are sent with a comma and with a full stop at their end too.
ENDED_WORDS = 1 << 16
#: Letters whose words are counted at a time.
COUNTED = 1 << 23
#: Marks a word that stands as it is; other words have a space before them, or begin with a line feed.
BARE = "\n\n"

# \x1c to \x1f are white space for Python, not for the vocabulary.
_two_spaces = re.compile("[^\\S\x1c-\x1f]{2}").search
_doubles, _odd_spaces = ("  ", "\n\n", " \n", "\n "), "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n\x1c\x1d\x1e\x1f")
_runs = re.compile("[^\\S\x1c-\x1f]*[\\S\x1c-\x1f]+|[^\\S\x1c-\x1f]+").findall


def single_spaced(text: str) -> bool:
    """Whether no white space follows other white space; searches for fixed strings, as most texts have no odd ones."""
    if any(map(text.__contains__, _doubles)):
        return False
    return not any(map(text.__contains__, _odd_spaces)) or not _two_spaces(text)


def split_words(text: str) -> list[str]:
    """The words of a text, as keys; ``word_text`` gives their texts, which make up the whole text in order."""
    if not text:
        return []
    if not single_spaced(text):
        return [BARE + run for run in _runs(text)]
    words = text.replace("\n", " \n").split(" ")
    words[0] = BARE + words[0]
    return words


def word_text(key: str) -> str:
    return key[2:] if key.startswith(BARE) else key if key.startswith("\n") else " " + key


def stem(key: str) -> str | None:
    """A word without the comma or full stop at its end, if it is a letter of Latin script that stands before it."""
    if len(key) > 1 and key[-1] in ",." and key[-2].isalpha() and key[-2] < "ɐ":
        return key[:-1]
    return None


def distinct_words(docs: DataFrame) -> DataFrame:
    """(word, n): every distinct word and how often it stands in the corpus; counted within tasks first."""

    def counted(texts: list[str]) -> pa.RecordBatch:
        plain, other = [], []
        for text in texts:
            if text:
                (plain if single_spaced(text) else other).append(text)
        lists = pc.split_pattern(pc.replace_substring(pa.array(plain, pa.large_string()), "\n", " \n"), " ")
        first = lists.offsets.to_numpy()[:-1]
        rest = np.ones(len(lists.values), bool)
        rest[first] = False
        raw: Counter[str] = Counter(BARE + w for w in lists.values.take(pa.array(first)).to_pylist())
        for text in other:
            raw.update(split_words(text))
        found: Counter[str] = Counter()
        some = pc.value_counts(lists.values.filter(pa.array(rest)))
        for key, n in itertools.chain(raw.items(), zip(some.field(0).to_pylist(), some.field(1).to_pylist(), strict=True)):
            found[stem(key) or key] += n
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        size = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(text or "")
                size += len(held[-1])
                if size > COUNTED:
                    yield counted(held)
                    held, size = [], 0
        yield counted(held)

    return columns(docs, "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode_words(words: DataFrame, vocabulary: str) -> DataFrame:
    """(word, n, ids): ids as little-endian unsigned 32-bit integers."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_bpe(vocabulary)
        for batch in batches:
            ids = [encode_to_array(encoding, word_text(w)).astype("<u4").tobytes() for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=["word", "n", "ids"])

    return words.mapInArrow(encode, "word string, n long, ids binary")


def decode_words(words: DataFrame, vocabulary: str) -> DataFrame:
    """(word, n, ids, decoded): decoded holds the bytes that the ids stand for, null where these are the word's own.

    Ids are joined with the table of pieces, whose size the vocabulary fixes, and pieces put together by position.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").view("<i4") for x in batch.column(1).to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, "<i4")])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["word", "ids"])

    pieces = F.broadcast(piece_table(words.sparkSession, vocabulary))
    said = words.select("word", "ids").mapInArrow(each, "word string, ids array<int>").select("word", F.posexplode("ids").alias("at", "id")).join(pieces, "id")
    made = said.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("pieces"))
    text = F.when(F.col("word").startswith(BARE), F.substring("word", 3, 1 << 30)).when(F.col("word").startswith("\n"), F.col("word")).otherwise(F.concat(F.lit(" "), "word"))
    joined = F.aggregate("pieces", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["piece"]))
    decoded = made.select("word", joined.alias("decoded")).where(F.col("decoded") != F.encode(text, "utf-8"))
    return words.join(decoded.hint("merge"), "word", "left")


def ipc(top: pa.Table, vocabulary: str) -> tuple[bytes, dict[str, bytes]]:
    """The common words, commonest first, as they are sent to the tasks, and the ids of the ends of words; the driver makes no table of them."""
    encoding = byte_bpe(vocabulary)
    top = top.sort_by([("n", "descending"), ("word", "ascending")]).select(["word", "ids", "decoded"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, top.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_table(top)
    return sink.getvalue().to_pybytes(), {BARE + c: encode_to_array(encoding, c).astype("<u4").tobytes() for c in ",."}


def commonest(words: DataFrame, most: int) -> DataFrame:
    """At most about ``most`` of the commonest words of at most COMMON_LETTERS letters, without a sort.

    Words are counted by how often they stand, in steps of a sixteenth of an octave; the steps from the top on that fit are
    taken whole, and of the next one a share, by ranges of hashes.
    """
    short = words.where(F.length("word") <= COMMON_LETTERS).withColumn("step", F.floor(16 * F.log2("n")))
    steps = {r.step: r["count"] for r in short.groupBy("step").count().collect()}
    taken, cut, share = 0, min(steps, default=0), 1 << 20
    for step in sorted(steps, reverse=True):
        if taken + steps[step] > most:
            cut, share = step, int((1 << 20) * 0.98 * (most - taken) / steps[step])
            break
        taken += steps[step]
    return short.where((F.col("step") > cut) | (F.col("step") == cut) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < share)).drop("step")


_tables: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {}


@dataclass
class CommonWords:
    token: str
    sent: Broadcast

    def table(self) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """Ids by word, and bytes by word where these aren't the word's own; made once in each Python worker."""
        if self.token not in _tables:
            data, ends = self.sent.value
            table = dict(ends)
            rows = pa.ipc.open_stream(data).read_all()
            other: dict[str, bytes] = {}
            for k, (word, ids, said) in enumerate(zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True)):
                table[word] = ids
                if said is not None:
                    other[word] = said
                if k < ENDED_WORDS and stem(word + ","):
                    table |= {word + c: ids + table[BARE + c] for c in ",."}
            _tables.clear()
            _tables[self.token] = table, other
        return _tables[self.token]


@dataclass
class Encoded:
    """``rows`` (doc_id, packed, answers, other): compressed texts with the ids of their words that aren't common, by place, and the bytes of those that aren't decoded to themselves."""

    rows: DataFrame
    common: CommonWords
    vocabulary: str


def look_up(text: str, found: dict[str, bytes]) -> tuple[list, list[tuple[int, str, str]]]:
    """Ids of each word; and place, word and end of those that aren't common. Ends are commas and full stops."""
    keys = split_words(text)
    ids = list(map(found.get, keys))
    missing = []
    at = -1
    for _ in range(ids.count(None)):
        at = ids.index(None, at + 1)
        key = keys[at]
        base = stem(key)
        end = key[-1] if base else ""
        known = found.get(base) if base else None
        if known is None:
            missing.append((at, base or key, end))
        else:
            ids[at] = known + found[BARE + end]
    return ids, missing


def encode(docs: DataFrame, vocabulary: str, common: int = COMMON_WORDS) -> Encoded:
    """Encodes whole texts through the table of distinct words.

    Null texts are empty. Repeated rows give repeated rows; null doc_ids stay. Further columns are ignored.
    """
    encoded = written(encode_words(distinct_words(docs), vocabulary), "encoded")
    words = written(decode_words(encoded, vocabulary), "words")
    dropped(encoded)
    top = commonest(words, common).select("word", "n", "ids", "decoded").toArrow()
    known = CommonWords(uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(ipc(top, vocabulary)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = known.table()[0]
        for batch in batches:
            counts, asked = [], []
            for text in batch.column(2).to_pylist():
                missing = look_up(text or "", found)[1]
                counts.append(len(missing))
                asked += [word for _, word, _ in missing]
            row = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(row)) - np.repeat(np.cumsum([0, *counts])[:-1], counts)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(place, pa.int32()), pa.array(asked, pa.string())], names=["doc_id", "mark", "k", "word"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            made = pa.array([compress((t or "").encode()) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], names=["doc_id", "mark", "packed"])

    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    asked = marked.mapInArrow(ask, "doc_id long, mark long, k int, word string")
    each = matched(asked, words, ["word"], "n").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("k", "ids")).alias("answers"), F.collect_set(F.when(F.col("decoded").isNotNull(), F.struct("k", "decoded"))).alias("other"))
    # Places are 0, 1, 2 and so on, so that ids in their order need no places.
    found_ids = written(each.select("doc_id", "mark", F.transform(F.sort_array("answers"), lambda x: x["ids"]).alias("answers"), F.when(F.size("other") > 0, F.col("other")).alias("other")), "answers")
    dropped(words)
    answers = found_ids.alias("a")
    texts = marked.mapInArrow(packed, "doc_id long, mark long, packed binary").alias("d")
    joined = texts.join(answers, F.col("d.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("d.mark") == F.col("a.mark")), "left")
    return Encoded(joined.select("d.doc_id", "packed", "answers", "other"), known, vocabulary)


def assemble(text: str, answers: list[bytes] | None, decoded: list[dict] | None, known: tuple[dict[str, bytes], dict[str, bytes]]) -> tuple[bytes, bytes]:
    """The ids of one document and the bytes they stand for, the joined ones put in their places."""
    found, other = known
    ids, missing = look_up(text, found)
    for (at, _, end), answer in zip(missing, answers or (), strict=True):
        ids[at] = answer + found[BARE + end] if end else answer
    if not other and not decoded:
        return b"".join(ids), text.encode()
    said = [word_text(w).encode() if (base := other.get(stem(w) or w)) is None else base + w[len(stem(w) or w) :].encode() for w in split_words(text)]
    for x in decoded or ():
        at, _, end = missing[x["k"]]
        said[at] = x["decoded"] + end.encode()
    return b"".join(ids), b"".join(said)


def assembled(batch: pa.RecordBatch, known: tuple[dict[str, bytes], dict[str, bytes]]) -> Iterator[tuple[bytes, bytes]]:
    """Ids and decoded text, in UTF-8, of each document."""
    unpack = zstandard.ZstdDecompressor().decompress
    for t, a, d in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
        ids, said = assemble(unpack(t).decode(), a, d, known)
        yield ids, said if d is None and not known[1] else said.decode("utf-8", "replace").encode()


def decode(rows: DataFrame, vocabulary: str) -> DataFrame:
    """(key, decoded) of rows (key, ids) with any ids, not only those of this module: the same join, ids taken for a word's.

    Keys are unique; null ids are left out, those that the vocabulary hasn't stand for nothing. Empty or null lists give an
    empty text.
    """
    key, ids = rows.columns
    said = rows.select(key, F.posexplode(ids).alias("at", "id")).join(F.broadcast(piece_table(rows.sparkSession, vocabulary)), "id")
    made = said.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("pieces"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"".join(x["piece"] for x in p or ()).decode("utf-8", "replace") for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "decoded"])

    return rows.select(key).join(made, key, "left").select(key, "pieces").mapInArrow(join, StructType([rows.schema[key], StructField("decoded", StringType())]))


def digests(encoded: Encoded) -> DataFrame:
    """Counts and hashes of the ids and of the text decoded from them."""
    common = encoded.common

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(said).hexdigest()) for ids, said in assembled(batch, common.table())]
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.rows.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def texts(encoded: Encoded) -> DataFrame:
    """(doc_id, ids, decoded): the ids themselves and the text they stand for."""
    common = encoded.common

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(assembled(batch, common.table()))
            ids = pa.array([np.frombuffer(x, "<u4").tolist() for x, _ in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([said.decode() for _, said in rows], pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.rows.mapInArrow(full, "doc_id long, ids array<int>, decoded string")
