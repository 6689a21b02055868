"""Byte-level BPE encoding by tree reduction, and decoding.

A piece of a text (a match of the vocabulary's pattern) is encoded as a monoid
reduction. Halves are encoded recursively; two neighbouring encodings join by
re-encoding a window of tokens at their boundary, which grows until the pair of
tokens at each edge of the window is stable, that is, until encoding the two
tokens' bytes by themselves gives the same two tokens.

Why that is enough: merges run by rank, so a merge across the place between two
tokens happens or not by what those two tokens' bytes hold. A sequence of tokens
is the encoding of its bytes exactly if every adjacent pair is stable. Inside
the left encoding, inside the right one and inside the window all pairs are
stable already; the two edges are what is checked.

Decoding concatenates the tokens' bytes up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import byte_view, map_texts, read

#: Bytes of the tree's leaves, which are merged directly. Few enough that leaves repeat often.
LEAF = 8
#: Stretches of at most so many bytes whose direct encodings are kept.
KEPT_BYTES = 16
#: Encodings of pieces that a worker process keeps, in each of two generations (some 300 bytes each), and
#: encodings of stretches and stable pairs.
CACHE_PIECES, CACHE = 200_000, 60_000
#: Bytes of text whose pieces are held at once.
PART = 2 << 20
#: Pieces of at most so many characters are kept.
KEPT_PIECE = 64


def narrow(pattern: str):
    """``findall`` of an expression of the standard library that equals ``pattern`` on U+0000 to
    U+00FF: letters, numbers and white space are listed from the character database. None where
    the pattern has other properties."""
    listed = {"L": "", "N": "", "s": "\\t-\\r \\x85\\xa0"}
    for code in range(256):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LN":
            listed[kind] += f"\\x{code:02x}"
    out, inside, i = "", False, 0
    while i < len(pattern):
        if m := re.compile(r"\\p\{([LN])\}|\\(s)").match(pattern, i):
            chars = listed[m[1] or m[2]]
            out += chars if inside else f"[{chars}]"
            i = m.end()
        elif pattern.startswith("\\S", i) and not inside:
            out += f"[^{listed['s']}]"
            i += 2
        elif pattern[i] == "\\":
            return None
        else:
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out += pattern[i]
            i += 1
    try:
        return re.compile(out).findall
    except re.error:
        return None


class Recent:
    """A bounded mapping of what was used lately: two generations, of which the older goes when the
    younger is full and what is asked for in the older moves to the younger. None is no value."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self[key] = value
        return value

    def __setitem__(self, key, value):
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young
        self.young[key] = value


class Vocabulary:
    """Ranks of byte strings and the operations on sequences of them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self._split = regex.compile(pattern).findall
        self._split_narrow = narrow(pattern)
        self._none = max(ranks.values(), default=0) + 1  # ranks after all others: no merge
        self._stable: Recent = Recent(CACHE)
        self._merged: Recent = Recent(CACHE)

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}, pattern)

    def split(self, text: str) -> list[str]:
        """Matches of the pattern; texts of U+0000 to U+00FF go by an equal, cheaper expression."""
        if self._split_narrow is not None:
            try:
                text.encode("latin-1")
                return self._split_narrow(text)
            except UnicodeEncodeError:
                pass
        return self._split(text)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Direct merging: the lowest rank first, the leftmost of equals."""
        rank, none = self.ranks.get, self._none
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (lowest := min(pairs)) != none:
            at = pairs.index(lowest)
            whole = parts[at] + parts[at + 1]
            parts[at : at + 2] = [whole]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = rank(whole + parts[at + 1], none)
            if at:
                pairs[at - 1] = rank(parts[at - 1] + whole, none)
        return tuple([self.ranks[p] for p in parts])

    def direct(self, data: bytes) -> tuple[int, ...]:
        """``merge``, kept for short stretches."""
        known = self._merged.get(data)
        if known is None:
            known = self.merge(data)
            if len(data) <= KEPT_BYTES:
                self._merged[data] = known
        return known

    def stable(self, a: int, b: int) -> bool:
        known = self._stable.get((a, b))
        if known is None:
            known = self._stable[a, b] = self.direct(self.bytes_of[a] + self.bytes_of[b]) == (a, b)
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of both."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i, j, step = len(left) - 1, 1, 1
        while True:
            inside = b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j]))
            window = self.direct(inside) if len(inside) <= 4 * KEPT_BYTES else self.reduce(inside)
            left_ok = i == 0 or self.stable(left[i - 1], window[0])
            right_ok = j == len(right) or self.stable(window[-1], right[j])
            if left_ok and right_ok:
                return left[:i] + window + right[j:]
            if not left_ok:
                i = max(0, i - step)
            if not right_ok:
                j = min(len(right), j + step)
            step *= 2

    def reduce(self, data: bytes) -> tuple[int, ...]:
        """Leaves of the tree are merged directly, then neighbours join level by level."""
        level = [self.direct(data[i : i + LEAF]) for i in range(0, len(data), LEAF)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else ()

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        return self.reduce(data)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.split(text):
            out.extend(self.encode_piece(piece.encode()))
        return out

    def decode(self, ids: Sequence[int]) -> bytes:
        level = list(map(self.bytes_of.__getitem__, ids))
        while len(level) > 64:
            level = [b"".join(level[i : i + 64]) for i in range(0, len(level), 64)]
        return b"".join(level)


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One per worker process; the file is read where the worker runs."""
    return Vocabulary.load(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids array<int>`` for every row; null and empty texts have no ids."""

    def begin():
        vocab = vocabulary(path, pattern)
        return lambda texts: [[vocab.encode(t) for t in texts]]

    return map_texts(docs, {"ids": "array<int>"}, begin)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give the empty text, bytes that aren't UTF-8 replacement signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            texts = [vocab.decode(ids or []).decode(errors="replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


class Digester:
    """Counts and hashes of the ids of texts and of what they decode to.

    The pieces of some texts become a dictionary array; each distinct one is encoded once, or not at all where
    it was met lately. What the texts' pieces give is then laid end to end, and each text is a slice of that.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.known = Recent(CACHE_PIECES)
        self.written = {i: f"{i}," for i in vocab.bytes_of}

    def piece(self, piece: str) -> tuple[int, str, bytes]:
        """Number of ids, the ids written with a comma after each, and the bytes that they decode to."""
        got = self.known.get(piece)
        if got is None:
            ids = self.vocab.encode_piece(piece.encode())
            got = len(ids), "".join(map(self.written.__getitem__, ids)), self.vocab.decode(ids)
            if len(piece) <= KEPT_PIECE:
                self.known[piece] = got
        return got

    def __call__(self, texts: list[str]):
        pieces, ends = [], []
        for text in texts:
            pieces += self.vocab.split(text)
            ends.append(len(pieces))
        coded, lately = pa.array(pieces, pa.string()).dictionary_encode(), self.known.young.get
        n, ids, data = zip(*[lately(p) or self.piece(p) for p in coded.dictionary.to_pylist()], strict=True) if pieces else ((), (), ())
        at = np.array([0, *ends])
        total = np.r_[0, np.cumsum(np.array(n, np.int64)[coded.indices.to_numpy()])][at]
        written, decoded = (byte_view(pa.array(column, pa.large_binary()).take(coded.indices)) for column in ([i.encode() for i in ids], data))
        out = []
        for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            ids_of, bytes_of = (raw[cuts[a] : cuts[b]] for raw, cuts in (written, decoded))
            out.append((int(total[i + 1] - total[i]), hashlib.sha256(ids_of[:-1]).hexdigest(), hashlib.sha256(bytes_of).hexdigest()))
        return list(zip(*out, strict=True))


@lru_cache(maxsize=2)
def digester(path: str, pattern: str) -> Digester:
    """One per worker process, so that tasks find what earlier ones encoded."""
    return Digester(vocabulary(path, pattern))


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row; null and empty texts have no tokens."""
    return map_texts(docs, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, lambda: digester(path, pattern), part=PART)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return digest(read(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
