"""Public vocabularies, loaded once in each Python worker from a path that callers pass."""

from __future__ import annotations

import functools
import json

import numpy as np


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def id_pieces(path: str) -> list[bytes]:
    """The bytes of each id; added tokens as their text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_alphabet()
    found = {i: bytes(letters[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    found |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [found.get(i, b"") for i in range(max(found) + 1)]


def piece_table(spark, path: str):
    """(id, piece): the pieces of a vocabulary as a table, of as many rows as it has ids."""
    return spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(id_pieces(path))], "id int, piece binary")


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str):
    """The vocabulary of a tokenizers file as a tiktoken encoding: the same ids, several times faster on one core."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    letters = byte_alphabet()
    # An id's rank is its place in the merges: single bytes first, then merges in order, which is the order of the ids.
    ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), path


@functools.lru_cache(maxsize=2)
def reference_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encode_to_array(encoding, text: str) -> np.ndarray:
    """Ids of a whole text. A text on which the fast encoder gives up goes through the tokenizers library itself."""
    fast, path = encoding
    try:
        return fast.encode_to_numpy(text, allowed_special="all")
    except Exception:  # the pattern's backtracking limit on very long runs of spaces
        return np.array(reference_tokenizer(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
