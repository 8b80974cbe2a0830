"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

The lexicon is learned from labelled rows: beginnings of words and whole words that stand in far more toxic than clean
texts. Of those, only the ones needed to cover the toxic texts are taken, so that words which merely come along with them
(as in copies of one text) stay out. Phrases around an entry that clean texts have are exceptions.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import columns, rows_of, written

#: So many labelled rows of each class are expected in the sample to choose and calibrate on.
SAMPLE = 10_000
#: A toxic text is covered by so many entries, if it has them; an entry must stand in so large a share of the toxic texts, and cover as large a one of the sample's.
COVER, LEAST_SHARE = 3, 0.002
LEAST_ODDS, LEAST_TEXTS = 3.0, 3
PREFIXES = range(3, 8)

#: Letters that look like Latin ones, and signs that stand for letters within words.
HOMOGLYPHS = str.maketrans("авекмнорстухіјѕԁɡһԛԝαβεικνορτυχℓ", "abekmhopctyxijsdghqwabeikvoptuxl") | {ord(c): None for c in "​‌‍⁠﻿­"} | {0xFEE0 + c: chr(c) for c in range(0x21, 0x7F)}
DIGITS = str.maketrans("0134578@$!|+", "oieastbasiit")

_words = re.compile(r"[^\W_][\w@$!|+]*").findall
_mixed = re.compile(r"[\d@$!|+]").search
_letter = re.compile(r"[^\W\d_]").search


def folded_words(text: str | None) -> list[str]:
    """Words in lower case, with look-alike letters replaced, and digits and signs too in words that have letters."""
    words = _words((text or "").lower().translate(HOMOGLYPHS))
    return [w.rstrip("!|+").translate(DIGITS) if _mixed(w) and _letter(w) else w for w in words]


def entries(words: list[str]) -> set[str]:
    """What may become an entry: the beginnings of words, and whole words, which end in a space."""
    found = {" " + w + " " for w in set(words)}
    return found | {w[: n + 1] for w in found for n in PREFIXES if len(w) > n + 1}


def curve_features(total: float, n: int) -> list[float]:
    """Of the sum of weights and the number of words: a constant, the sum, the sum by root of length and by length."""
    n = max(1, n)
    return [1.0, min(total, 60.0) / 10, min(total / math.sqrt(n), 30.0), min(100 * total / n, 300.0) / 30]


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    #: Of the logistic curve: constant, sum of weights, sum by root of length, sum by length.
    curve: tuple[float, ...] = (-8.0, 0.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        made = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            made.add_word(entry, (entry, weight))
        if self.weights:
            made.make_automaton()
        return made

    def matches(self, automaton, words: list[str]) -> dict[int, float]:
        """The best weight at each word that matches and isn't part of an exception phrase."""
        if not self.weights or not words:
            return {}
        text = " " + " ".join(words) + " "
        at: dict[int, float] = {}
        for end, (entry, weight) in automaton.iter(text):
            start = end - len(entry) + 1
            at[start] = max(at.get(start, 0.0), weight)
        if not at:
            return {}
        place = {}
        offset = 0
        for i, w in enumerate(words):
            if offset in at:
                place[i] = at[offset]
            offset += len(w) + 1
        return {i: w for i, w in place.items() if " ".join(words[max(0, i - 1) : i + 1]) not in self.exceptions and " ".join(words[i : i + 2]) not in self.exceptions}

    def features(self, automaton, words: list[str]) -> list[float]:
        return curve_features(sum(self.matches(automaton, words).values()), len(words))

    def score(self, automaton, words: list[str]) -> float:
        z = sum(c * f for c, f in zip(self.curve, self.features(automaton, words), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def counted(texts: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(entry, n): in how many texts each entry stands; only those in ``wanted``, if given."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                found.update(entries(folded_words(text)))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["entry", "n"])

    found = texts.select("text").mapInArrow(count, "entry string, n long")
    if wanted is not None:
        found = rows_of(found, wanted.select("entry"), "entry")
    return found.groupBy("entry").agg(F.sum("n").alias("n"))


def telling(rows: DataFrame, n: dict[int, int]) -> dict[str, float]:
    """The odds of every entry that stands in enough toxic texts and in far more of them than of the clean ones.

    Counts of both classes meet in Spark. What comes to the driver is bounded by the share: a text has only so many entries.
    """
    toxic = written(counted(rows.where("toxic = 1")).where(F.col("n") >= max(LEAST_TEXTS, LEAST_SHARE * n[1])), "entries")
    clean = counted(rows.where("toxic = 0"), toxic).withColumnRenamed("n", "clean")
    odds = F.log((F.col("n") + 0.5) / (n[1] + 1)) - F.log((F.coalesce("clean", F.lit(0)) + 0.5) / (n[0] + 1))
    return {r.entry: r.odds for r in toxic.join(clean, "entry", "left").select("entry", odds.alias("odds")).where(F.col("odds") >= LEAST_ODDS).collect()}


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, text, toxic) of the rows to learn from: crc32 of the id mod 5 is not 0; equal texts once per label."""
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    marks = labels.where(learn & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = columns(docs, "doc_id", "text").where(learn & F.col("text").isNotNull())
    hashed = texts.select("doc_id", F.xxhash64("text").alias("row")).join(marks, "doc_id")
    heads = written(hashed.groupBy("row", "toxic").agg(F.min("doc_id").alias("doc_id")), "heads")
    found = rows_of(texts, heads, "doc_id")
    return found.where(F.xxhash64("text") == F.col("row")).select("row", "toxic", "text")


def chosen(toxic: list[list[str]], odds: dict[str, float]) -> list[str]:
    """Entries that cover the toxic texts of a sample, given by their candidates, the one that covers most first; of equals the shorter."""
    where: dict[str, set[int]] = {}
    for i, found in enumerate(toxic):
        for entry in found:
            where.setdefault(entry, set()).add(i)
    need = [COVER] * len(toxic)
    open_in = {e: len(rows) for e, rows in where.items()}
    out: list[str] = []
    while open_in:
        best = max(open_in, key=lambda e: (open_in[e] * odds[e], -len(e), e))
        if open_in.pop(best) < max(LEAST_TEXTS, LEAST_SHARE * len(toxic)):
            break
        if any(best.startswith(e) or e.startswith(best) for e in out):  # a shorter beginning of a taken word only adds clean words
            continue
        out.append(best)
        for i in where[best]:
            need[i] -= 1
            if need[i] == 0:
                for e in toxic[i]:
                    if e in open_in:
                        open_in[e] -= 1
    return out


def candidates_in(texts: DataFrame, odds: dict[str, float]) -> list[list[str]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(entries(folded_words(t)) & odds.keys()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["found"])

    return [r.found for r in texts.select("text").mapInArrow(find, "found array<string>").collect()]


def matched_phrases(texts: DataFrame, lexicon: Lexicon) -> list:
    """Rows (toxic, n, weights, before, after): length, and weight and phrases of each match."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for words in map(folded_words, batch.column(1).to_pylist()):
                at = lexicon.matches(automaton, words)
                for column, value in zip(out, (len(words), list(at.values()), [" ".join(words[max(0, i - 1) : i + 1]) for i in at], [" ".join(words[i : i + 2]) for i in at]), strict=True):
                    column.append(value)
            kinds = (pa.int32(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=["toxic", "n", "weights", "before", "after"])

    return texts.select("toxic", "text").mapInArrow(find, "toxic int, n int, weights array<double>, before array<string>, after array<string>").collect()


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, ...]:
    """Coefficients by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from the labelled rows. Counts cover all of them; only the choice of entries and the curve use a bounded sample."""
    rows = written(labelled(docs, labels), "labelled")
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Lexicon()
    odds = telling(rows, n)
    # Row hashes are spread evenly, so a share of their range is a sample of the expected size, found without a sort.
    some = [rows.where((F.col("toxic") == mark) & (F.col("row") <= min((1 << 63) - 1, int(min(1.0, sample / n[mark]) * (1 << 64)) - (1 << 63)))) for mark in (0, 1)]
    lexicon = Lexicon({e: odds[e] for e in chosen(candidates_in(some[1], odds), odds)})
    matched = matched_phrases(some[0].union(some[1]), lexicon)
    phrases: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
    for r in matched:
        phrases[r.toxic].update({p for p in [*r.before, *r.after] if " " in p})
    lexicon.exceptions = {p for p, c in phrases[0].items() if c >= LEAST_TEXTS and c > 9 * phrases[1][p]}
    sums = [sum(w for w, p, q in zip(r.weights, r.before, r.after, strict=True) if p not in lexicon.exceptions and q not in lexicon.exceptions) for r in matched]
    x = np.array([curve_features(total, r.n) for total, r in zip(sums, matched, strict=True)])
    lexicon.curve = logistic(x, np.array([float(r.toxic) for r in matched]))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    Null and empty texts score as texts without a match. Null doc_ids aren't held out. Repeated rows are scored one by one.
    """

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            scores = [lexicon.score(automaton, folded_words(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rated = columns(docs, "doc_id", "text").mapInArrow(rate, "doc_id long, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return rated.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
