"""Byte-level BPE encoding and decoding with padded numpy matrices.

A text is cut before a single space, and around a single line break, between two characters that are not
white space. No match of the splitting pattern crosses such a place, so the parts can be encoded apart; their ids are
remembered in a bounded cache. The parts that are new in a batch are split by the pattern, and the
distinct pieces are merged together: pieces of similar length form one padded matrix of ids, and in
each round every row merges its leftmost pair of least rank. Pairs are looked up in a hash table;
finished rows leave the matrix (compaction). Pieces of more than `LONG` bytes are merged one by one with a heap,
because a matrix needs a round for each merge.

Defined cases: null and empty texts give no ids and decode to nothing; rows are independent, so
repeated rows and ties of doc_id give equal results; columns beside the text aren't read.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from lodestone.llm.common import lean_workers

#: A piece longer than this is merged alone.
LONG = 1024
NONE = np.iinfo(np.int32).max


def _ranges(kinds: str, space: bool = False) -> str:
    """The inside of a character class for all characters of these major categories, or for white space."""
    if space:
        return "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    out, start = [], None
    for i in range(sys.maxunicode + 2):
        inside = i <= sys.maxunicode and unicodedata.category(chr(i))[0] == kinds
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{i - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(4)
def splitter(pattern: str):
    """The pattern for `re`, whose explicit classes are faster than properties; `regex` for patterns with more of them."""
    import regex

    parts = re.sub(r"\\p\{[LN]\}|\\s|\\S", "", pattern)
    if "\\p" in parts or re.search(r"\[[^\]]*\\S", pattern):
        return regex.compile(pattern)
    letters, numbers, white = _ranges("L"), _ranges("N"), _ranges("", True)
    out, inside = [], False
    for t in re.findall(r"\\p\{.\}|\\.|.", pattern, re.S):
        inside = inside or t == "["
        if t in ("\\p{L}", "\\p{N}", "\\s"):
            chars = {"\\p{L}": letters, "\\p{N}": numbers, "\\s": white}[t]
            t = chars if inside else f"[{chars}]"
        elif t == "\\S":
            t = f"[^{white}]"
        inside = inside and t != "]"
        out.append(t)
    return re.compile("".join(out))


class Pairs:
    """Hash table from a pair of ids to the id of the joined bytes; open addressing, numpy arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.keys, self.values, self.steps = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32), 0
        left = np.arange(len(keys))
        while len(left):
            at = self._slot(keys[left]) + self.steps & (1 << self.bits) - 1
            free = np.flatnonzero(self.keys[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = keys[left[put]], values[left[put]]
            left = np.delete(left, put)
            self.steps += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for step in range(1, self.steps):
            if not len(open_):
                break
            k = keys[open_]
            slot = at[open_] + step & (1 << self.bits) - 1
            found = self.keys[slot]
            hit = found == k
            out[open_[hit]] = self.values[slot[hit]]
            open_ = open_[~hit & (found != -1)]
        return out


class Vocabulary:
    """Ranks of a file in tiktoken's form, with the tables for merging and decoding."""

    def __init__(self, path: str, pattern: str, cache: int = 150_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split, self.most = splitter(pattern).findall, cache
        n = max(self.ranks.values()) + 1
        self.bytes_of = [b""] * n
        for b, r in self.ranks.items():
            self.bytes_of[r] = b
        self.length = np.array([len(b) for b in self.bytes_of], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.single = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        if (self.single < 0).any():
            raise ValueError("every byte needs a rank")
        pairs = [(self.ranks[b[:i]], self.ranks[b[i:]], r) for b, r in self.ranks.items() for i in range(1, len(b)) if b[:i] in self.ranks and b[i:] in self.ranks]
        a = np.array(pairs, np.int64).reshape(-1, 3)
        self.pairs = Pairs((a[:, 0] << 32) | a[:, 1], a[:, 2].astype(np.int32))
        self.parts: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces of at most LONG bytes and similar length, each as int32 bytes."""
        size = np.array([len(p) for p in pieces], np.int64)
        ids = np.zeros((len(pieces), int(size.max())), np.int32)
        ids[np.arange(ids.shape[1]) < size[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        row, out = np.arange(len(pieces)), [b""] * len(pieces)
        ranks = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        ranks[np.arange(ranks.shape[1]) >= size[:, None] - 1] = NONE
        while len(row):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            best = ranks[np.arange(len(row)), at] if ranks.shape[1] else np.full(len(row), NONE, np.int32)
            if (best == NONE).any():
                for i in np.flatnonzero(best == NONE):
                    out[row[i]] = ids[i, : size[i]].tobytes()
                keep = best != NONE
                row, ids, ranks, size, at, best = row[keep], ids[keep], ranks[keep], size[keep], at[keep], best[keep]
                if not len(row):
                    break
                if (w := int(size.max())) < ids.shape[1]:
                    ids, ranks = ids[:, :w], ranks[:, : w - 1]
            w, every = ids.shape[1], np.arange(len(row))
            later = np.arange(w - 1)[None, :] > at[:, None]
            ids = np.where(later, ids[:, 1:], ids[:, :-1])
            ids[every, at] = best
            ranks = np.where(later[:, : w - 2], ranks[:, 1:], ranks[:, :-1])
            size = size - 1
            if w > 2:
                for p in (at - 1, at):
                    ok = np.flatnonzero((p >= 0) & (p < size - 1))
                    q = p[ok]
                    ranks[ok, q] = self.pairs(ids[ok, q], ids[ok, q + 1])
                ranks[every[at >= size - 1], at[at >= size - 1].clip(max=w - 3)] = np.where(at[at >= size - 1] <= w - 3, NONE, ranks[every[at >= size - 1], at[at >= size - 1].clip(max=w - 3)])
        return out

    def _merge_long(self, piece: bytes) -> bytes:
        """One piece of any length, by a heap of (rank, place) over a linked list."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n, ranks, joined = len(ids), self.ranks, self.bytes_of
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        look = lambda i: ranks.get(joined[ids[i]] + joined[ids[after[i]]]) if after[i] < n else None
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := look(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (q := look(k)) is not None:
                    heapq.heappush(heap, (q, k, ids[k], ids[after[k]]))
        return np.array([i for i in ids if i >= 0], np.int32).tobytes()

    def _learn_pieces(self, pieces: set[bytes]) -> None:
        new = []
        for p in pieces:
            if (r := self.ranks.get(p)) is not None:
                self.pieces[p] = r.to_bytes(4, sys.byteorder)
            elif len(p) > LONG:
                self.pieces[p] = self._merge_long(p)
            else:
                new.append(p)
        new.sort(key=len)
        i = 0
        while i < len(new):  # buckets: lengths within a quarter of each other, at most about two million cells
            j, most = i, max(len(new[i]) + 2, len(new[i]) * 5 // 4)
            while j < len(new) and len(new[j]) <= most and (j - i) * most < 2_000_000:
                j += 1
            j = max(j, i + 1)
            self.pieces.update(zip(new[i:j], self._merge(new[i:j]), strict=True))
            i = j

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids begin and end."""
        cut = [_parts(t) for t in texts]
        met = {p for c in cut for p in c}
        if len(self.parts) > self.most:  # only what this batch needs stays
            self.parts = {p: self.parts[p] for p in met if p in self.parts}
        if len(self.pieces) > self.most:
            self.pieces.clear()
        known = self.parts
        new = met.difference(known)
        if new:
            split = {p: [x.encode("utf-8", "surrogatepass") for x in self.split(p)] for p in new}
            self._learn_pieces({x for s in split.values() for x in s}.difference(self.pieces))
            get = self.pieces.__getitem__
            for p, s in split.items():
                known[p] = b"".join(map(get, s))
        get = known.__getitem__
        ids = [b"".join(map(get, c)) for c in cut]
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
        return np.frombuffer(b"".join(ids), np.int32), ends

    def forget(self) -> None:
        """Empties the caches."""
        self.parts, self.pieces = {}, {}

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, in a row."""
        size = self.length[ids]
        total = int(size.sum())
        place = np.repeat(self.offset[ids] - np.cumsum(size) + size, size) + np.arange(total)
        return self.blob[place]


_GLUED = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)")


def _parts(text: str | None) -> list[str]:
    """Cuts before single spaces and around single line breaks between characters that aren't white space.

    The parts join to the text, and no match of the pattern crosses a cut."""
    if not text:
        return []
    if _GLUED.search(text) or text[0].isspace() or text[-1].isspace():
        return _CUT.split(text)
    return text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00") if "\x00" not in text else _CUT.split(text)


@lru_cache(2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One for each worker process. A path that starts with files: names a file given by SparkContext.addFile."""
    return Vocabulary(SparkFiles.get(path[6:]) if path.startswith("files:") else path, pattern)


def encode(text: Column, path: str, pattern: str) -> Column:
    """array<int> of the ids of a text column; no ids for null."""

    @F.arrow_udf(ArrayType(IntegerType(), False))
    def ids(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(path, pattern)
        for col in cols:
            out = []
            for i, j in _column_slices(col):
                values, ends = v.encode_batch(col.slice(i, j - i).to_pylist())
                out.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values)))
            yield pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))
        v.forget()  # workers outlive their tasks, and what comes next needs the memory

    return ids(text)


def _column_slices(col: pa.Array, most: int = 4_000_000):
    """Ranges of rows with about `most` bytes of text each."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def decode(ids: Column, path: str, pattern: str) -> Column:
    """binary: the bytes that ids stand for; empty for null."""

    @F.arrow_udf(BinaryType())
    def data(col: pa.Array) -> pa.Array:
        v, out = vocabulary(path, pattern), []
        for x in col:
            a = x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0, np.int32)
            out.append(v.decode(a).tobytes())
        return pa.array(out, pa.binary())

    return data(ids)


def encode_and_decode(text: Column, path: str, pattern: str) -> Column:
    """struct<ids, data>: the ids of a text column and the bytes that they decode to, in one worker for each task."""
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("data", pa.binary())])

    @F.arrow_udf(StructType([StructField("ids", ArrayType(IntegerType(), False), False), StructField("data", BinaryType(), False)]))
    def both(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(path, pattern)
        for col in cols:
            out = []
            for i, j in _column_slices(col):
                values, ends = v.encode_batch(col.slice(i, j - i).to_pylist())
                data = [v.decode(values[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
                out.append(pa.StructArray.from_arrays([ids, pa.array(data, pa.binary())], fields=list(kind)))
            yield pa.concat_arrays(out) if out else pa.array([], kind)
        v.forget()  # workers outlive their tasks, and what comes next needs the memory

    return both(text)


def round_trip(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and the bytes they decode to, for each row with a doc_id and a text."""
    lean_workers(df.sparkSession)
    return df.select("doc_id", encode_and_decode(F.col("text"), path, pattern).alias("c")).select("doc_id", "c.ids", "c.data")


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """The query's columns: counts and digests of ids and decoded bytes."""
    both = round_trip(df, path, pattern)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("data"), 256).alias("decoded_sha256"),
    )
