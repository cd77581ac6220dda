"""Byte-level BPE in linear time: longest matches of an Aho-Corasick automaton, backtracked by pair compatibility."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewright.llm.common import fresh, map_batches, text_or_empty

#: A space before a character that is no white space starts a new piece under the split pattern, whatever stands around it.
BREAK = re.compile(r"(?= \S)")
LOOSE_SPACE = re.compile(r" \s")


class BytePairCodec:
    """Encodes as the rank file's merges would, and decodes.

    The automaton sees bytes as Latin-1 characters. Of a piece it gives the
    longest token at every place. Encoding appends that token if it may follow
    the last one, else tries its next shorter prefix, else steps back and marks
    the place as dead; a place is left for good at most once, so the time is
    linear in the piece. Two tokens may stand together if merging their bytes
    gives just these two; that is memoised.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = 300_000):
        self.ranks, self.remember = ranks, remember
        self.pattern = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}  # how a token's last merge made it
        self.merged: dict[tuple[int, int], int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        reachable = set()
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                reachable.add(i)
                continue
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None and a in reachable and b in reachable and a < i and b < i and self._stand(a, b):
                    self.parts[i], self.merged[a, b] = (a, b), i
                    reachable.add(i)
                    break
        self.automaton = ahocorasick.Automaton()
        for i in reachable:
            self.automaton.add_word(self.bytes_of[i].decode("latin-1"), (self.length[i], i))
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}  # the longest token that is a proper prefix
        for i in reachable:
            b = self.bytes_of[i]
            self.shorter[i] = next((j for n in range(len(b) - 1, 0, -1) if (j := ranks.get(b[:n])) is not None and j in reachable), None)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _stand(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b ends with a and b: no merge over the border comes before the merges beside it.

        Undoes the merges of both sides from the latest on. A merge over the
        border would have come first if its rank is below the one just undone.
        """
        limit = 1 << 62
        while True:
            over = self.merged.get((a, b))
            if over is not None and over < limit:
                return False
            left, right = self.parts.get(a), self.parts.get(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and a > b:
                limit, a = a, left[1]
            else:
                limit, b = b + 1, right[0]  # of equal ranks the left one merges first

    def may_follow(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= self.remember:
                self.pairs.clear()
            known = self.pairs[a, b] = self._stand(a, b)
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """The tokens of one match of the split pattern."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        longest: list[int | None] = [None] * (len(word) + 1)
        for end, (n, i) in self.automaton.iter(word.decode("latin-1")):
            start = end - n + 1
            if longest[start] is None or self.length[longest[start]] < n:
                longest[start] = i
        dead, out, at, now = set(), [], 0, longest[0]
        while at < len(word):
            end = at + self.length[now]
            if end not in dead and (not out or self.may_follow(out[-1], now)):
                out.append(now)
                at, now = end, longest[end]
            elif (less := self.shorter[now]) is not None:
                now = less
            elif not out:
                raise ValueError("no encoding: a byte is missing from the vocabulary")
            else:
                dead.add(at)
                now = out.pop()
                at -= self.length[now]
        return out

    def _word(self, word: str) -> bytes:
        packed = self.words.get(word)
        if packed is None:
            packed = array("I", self.encode_word(word.encode())).tobytes()
            if len(word) <= 64:
                if len(self.words) >= self.remember:
                    self.words.clear()
                self.words[word] = packed
        return packed

    def _piece(self, piece: str) -> bytes:
        packed = b"".join(map(self._word, self.pattern.findall(piece)))
        if len(piece) <= 64:
            if len(self.pieces) >= self.remember:
                self.pieces.clear()
            self.pieces[piece] = packed
        return packed

    def encode_packed(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        if LOOSE_SPACE.search(text):
            parts = BREAK.split(text)
        else:
            first, *rest = text.split(" ")
            parts = [first, *[" " + x for x in rest]] if rest else [first]
        known = self.pieces.get
        return b"".join([known(p) or self._piece(p) for p in parts])

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_packed(text)).tolist()

    def decode_packed(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", packed)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _codec(data: bytes, pattern: str, remember: int) -> BytePairCodec:
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}
    return BytePairCodec(ranks, pattern, remember)


def bpe_encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", remember: int = 300_000, columns: tuple[str, ...] = ("ids",)) -> DataFrame:
    """``docs`` with columns of ``columns``, from whole texts: ``ids array<int>``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, ``decoded binary``.

    The rank file is read on the driver and travels as a broadcast (a
    vocabulary has a fixed size). ``remember`` bounds each of a worker's
    caches; a full one starts anew. A null text is empty; empty texts have no
    tokens. Repeated rows stay rows. Columns of ``docs`` with a name among
    ``columns`` are replaced.
    """
    with open(rank_file, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    kinds = {"ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "decoded": "binary"}
    if unknown := set(columns) - kinds.keys():
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    rest = [c for c in docs.columns if c not in columns]
    rows = docs.select(*rest, text_or_empty(text_col).alias(fresh(rest, "__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data.value, pattern, remember)
        make = {
            "ids": lambda p, d: array("I", p).tolist(),
            "n_tokens": lambda p, d: len(p) // 4,
            "ids_sha256": lambda p, d: hashlib.sha256(p).hexdigest(),
            "decoded_sha256": lambda p, d: hashlib.sha256(d).hexdigest(),
            "decoded": lambda p, d: d,
        }
        kind = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "decoded": pa.binary()}
        decodes = any(c.startswith("decoded") for c in columns)
        for b in batches:
            made = {c: [] for c in columns}
            for t in b.column(len(rest)):
                packed = codec.encode_packed(t.as_py())
                plain = codec.decode_packed(packed) if decodes else b""
                for c in columns:
                    made[c].append(make[c](packed, plain))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *(pa.array(made[c], kind[c]) for c in columns)], names=[*rest, *columns])

    from pyspark.sql import types as T

    schema = T.StructType(rows.schema.fields[:-1])
    for c in columns:
        schema = schema.add(c, T._parse_datatype_string(kinds[c]))
    return map_batches(rows, run, schema)


def bpe_decode(df: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its token ids; null ids give null."""
    with open(rank_file, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())
    rest = [c for c in df.columns if c != out_col]
    rows = df.select(*rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data.value, pattern, 1)
        for b in batches:
            made = [None if x.as_py() is None else codec.decode(x.as_py()) for x in b.column(rest.index(ids_col))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=[*rest, out_col])

    from pyspark.sql import types as T

    return map_batches(rows, run, T.StructType([*rows.schema.fields, T.StructField(out_col, T.BinaryType())]))


def bpe_digest(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    columns = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe_encode(docs.select("doc_id", "text"), rank_file, pattern, columns=columns).select("doc_id", *columns)
