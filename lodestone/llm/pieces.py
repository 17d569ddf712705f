"""Encoding and decoding by the pieces of a BPE model with byte fallback, in the form that sentencepiece reads.

A space before the text and every space is a marker (U+2581). No piece of the model crosses the edge of a marked word, which is
checked when it is read, so each distinct marked word of a batch is segmented once: adjacent symbols are merged, those with the
best score first and the leftmost on ties, and what is no piece in the end falls back to its bytes. Ids are joined back by position
(chunks.py). Decoding lays the bytes of pieces in a row.

Defined cases: null and empty texts have no pieces, only the end id if one is asked for, and decode to the empty text; U+2581 in a text counts
as a space; strings of control pieces in a text are plain text; words of any length are merged in n log n; each row stands alone, so
repeated rows and ties of doc_id give equal results; no rows give no rows; columns beside the text and the key aren't read.
"""

from __future__ import annotations

import codecs
import struct
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lodestone.llm.chunks import LONG, ChunkTable, Laid, distinct, joined, merge_rows, merged, pair_table, per_text, slices, spread
from lodestone.llm.common import lean_workers

MARK = "▁"
#: Kinds of pieces in a model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a message's fields."""
    i = 0

    def number() -> int:
        nonlocal i
        out = shift = 0
        while True:
            c = data[i]
            i, out, shift = i + 1, out | (c & 127) << shift, shift + 7
            if c < 128:
                return out

    while i < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else number()
            yield key >> 3, data[i : i + size]
            i += size


class Pieces:
    """The pieces of a model. Models that this can't represent raise: other kinds than BPE, other normal forms than the identity with a
    leading space, pieces that users have defined, and pieces that cross the edge of a marked word."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        trainer = {k: v for n, b in top if n == 2 for k, v in _fields(b)}
        normal = {k: v for n, b in top if n == 3 for k, v in _fields(b)}
        rows = [{1: b"", 2: b"\0" * 4, 3: NORMAL} | dict(_fields(b)) for n, b in top if n == 1]
        self.text, self.kind = [r[1].decode() for r in rows], [r[3] for r in rows]
        score = [struct.unpack("<f", r[2])[0] for r in rows]
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0):
            raise ValueError("not a BPE model with byte fallback and leading markers")
        if normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or not normal.get(5, 1):
            raise ValueError("texts must stay as they are but for a leading space and marked spaces")
        if USER in self.kind or UNUSED in self.kind:
            raise ValueError("pieces of users and unused ones aren't known here")
        if any(a != MARK and b == MARK for p, k in zip(self.text, self.kind, strict=True) if k == NORMAL for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece crosses the edge of a marked word")
        self.id_of = {p: i for i, (p, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == NORMAL}
        self.rank = {p: -score[i] for p, i in self.id_of.items()}
        # numbers in the order of scores, so that a number is a rank; pieces that tie are told apart by their place in the text, in segment()
        order = sorted(self.rank, key=lambda p: (self.rank[p], self.id_of[p]))
        number = {p: k for k, p in enumerate(order)}
        if any(a.strip(MARK) and b.strip(MARK) and self.rank[a] == self.rank[b] for a, b in zip(order, order[1:], strict=False)):
            raise ValueError("scores of pieces tie")
        self.pairs = pair_table(order, number)
        self.id_at = np.array([self.id_of[p] for p in order], np.int32)
        self.single = np.full(sys.maxunicode + 1, -1, np.int32)
        for p, k in number.items():
            if len(p) == 1:
                self.single[ord(p)] = k
        self.single[0x20] = self.single[ord(MARK)]
        self.byte = [-1] * 256
        self.surface = [p.replace(MARK, " ").encode() for p in self.text]
        for i, (p, k) in enumerate(zip(self.text, self.kind, strict=True)):
            if k == BYTE:
                self.byte[int(p[3:5], 16)] = i
                self.surface[i] = bytes([int(p[3:5], 16)])
            elif k == CONTROL:
                self.surface[i] = b""
            elif k == UNKNOWN:
                self.surface[i] = trainer.get(44, " ⁇ ".encode())
        if min(self.byte) < 0:
            raise ValueError("every byte needs a piece")
        self.end = next((i for i, (p, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == CONTROL and p == trainer.get(47, b"</s>").decode()), -1)
        self.length = np.array([len(b) for b in self.surface], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(self.surface), np.uint8)
        self.raw = np.array([k == BYTE for k in self.kind])
        self.silent = np.array([k == CONTROL for k in self.kind])
        self.marked = np.array([k == NORMAL and p.startswith(MARK) for p, k in zip(self.text, self.kind, strict=True)])
        self.table = ChunkTable(self.segment)

    def segment_one(self, chunk: str) -> list[int]:
        out: list[int] = []
        for s in merged(list(chunk.replace(" ", MARK)), lambda a, b: self.rank.get(a + b)):
            i = self.id_of.get(s)
            if i is None:
                out += [self.byte[b] for b in s.encode()]
            else:
                out.append(i)
        return out

    def segment(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks in a row, and how many each has. Long chunks and runs of spaces, whose pieces have equal scores, go one by one.
        A character that is no piece has a number that no pair has, and becomes its bytes in the end."""
        text = "".join(words := [c.decode("utf-8", "each_byte") for c in chunks])
        point = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(size) - size
        fast = size <= LONG
        fast &= ~((size > 1) & (point[np.minimum(first + 1, len(point) - 1)] == 0x20))
        point = point[spread(first[fast], size[fast])]
        number = self.single[point]
        strange = number < 0
        flat, n = merge_rows(np.where(strange, len(self.id_at), number).astype(np.int32), size[fast], self.pairs)
        ids = self.id_at[flat.clip(max=len(self.id_at) - 1)]
        if strange.any():
            point, there = point[strange], flat == len(self.id_at)
            width = np.ones(len(flat), np.int64)
            width[there] += (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000)
            start = np.cumsum(width) - width
            ids = np.repeat(ids, width)
            ids[spread(start[there], width[there])] = np.array(self.byte, np.int32)[np.frombuffer("".join(map(chr, point)).encode(), np.uint8)]
            n = np.add.reduceat(width, np.cumsum(n) - n)
        return joined(ids, n, fast, [self.segment_one(words[i]) for i in np.flatnonzero(~fast)])

    def encode(self, laid: Laid, words: tuple[list[bytes], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, in a row, and where each text's begin, and the end; words: the distinct chunks, if they are there already."""
        ids, size = self.table(*(words or distinct(laid.chunks)))
        return ids, per_text(size, laid.first)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts of ids that lie in a row. The space of the first piece that can be seen goes if its marker was the leading one."""
        size, first = self.length[ids], self.offset[ids]
        seen = np.flatnonzero(~self.silent[ids])
        k = np.searchsorted(seen, bounds[:-1])
        has = k < len(seen)
        lead = seen[k[has]]
        lead = lead[(lead < bounds[1:][has]) & self.marked[ids[lead]]]
        size[lead] -= 1
        first[lead] += 1
        data = self.blob[spread(first, size)]
        ends = np.concatenate([[0], np.cumsum(size)])[bounds].astype(np.int64)
        out = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])
        parted = self.silent[ids[1:-1]] & self.raw[ids[:-2]] & self.raw[ids[2:]]
        try:
            if not parted.any():
                return out.cast(pa.string())
        except pa.ArrowInvalid:
            pass
        return pa.array([self._decode_one(b, ids[i:j]) for b, i, j in zip(out.to_pylist(), bounds[:-1], bounds[1:], strict=True)], pa.string())

    def _decode_one(self, data: bytes, ids: np.ndarray) -> str:
        """For ids that no text has: bytes that are no characters, each of which becomes U+FFFD, and characters that a control piece parts."""
        size = self.length[ids]
        at = np.cumsum(size)[self.silent[ids]] - (int(size.sum()) - len(data))  # a space that went was the first byte
        edges = [0, *at.clip(0).tolist(), len(data)]
        return "".join(data[a:b].decode("utf-8", "each_byte") for a, b in zip(edges, edges[1:], strict=False))


@lru_cache(2)
def pieces(path: str) -> Pieces:
    """One for each worker process. A path that starts with files: names a file given by SparkContext.addFile."""
    return Pieces(SparkFiles.get(path[6:]) if path.startswith("files:") else path)


def unmarked(texts: pa.Array) -> pa.Array:
    return pc.replace_substring(texts, MARK, " ")


def _with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, bounds[1:], end), bounds + np.arange(len(bounds))


def encode(text: Column, path: str, end: bool = False) -> Column:
    """array<int>: the ids of a text column, with `end` followed by the end id."""

    @F.arrow_udf(ArrayType(IntegerType(), False))
    def ids(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = pieces(path)
        for col in cols:
            out = []
            for part in slices(col):
                values, bounds = p.encode(Laid(unmarked(part)))
                if end:
                    values, bounds = _with_end(values, bounds, p.end)
                out.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values)))
            yield pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """The text that ids stand for; empty for null. Ids must be those of the model."""

    @F.arrow_udf(StringType())
    def texts(col: pa.Array) -> pa.Array:
        p = pieces(path)
        if not len(col):
            return pa.array([], pa.string())
        size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
        return p.decode(pc.list_flatten(col).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]))

    return texts(ids)


def encode_and_decode(text: Column, path: str, end: bool = True) -> Column:
    """struct<ids, text>: the ids of a text column and the text that they decode to, in one worker for each task."""
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("text", pa.string())])

    @F.arrow_udf(StructType([StructField("ids", ArrayType(IntegerType(), False), False), StructField("text", StringType(), False)]))
    def both(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = pieces(path)
        for col in cols:
            out = []
            for part in slices(col):
                values, bounds = p.encode(Laid(unmarked(part)))
                if end:
                    values, bounds = _with_end(values, bounds, p.end)
                ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
                out.append(pa.StructArray.from_arrays([ids, p.decode(values, bounds)], fields=list(kind)))
            yield pa.concat_arrays(out) if out else pa.array([], kind)

    return both(text)


def round_trip(df: DataFrame, path: str, end: bool = True) -> DataFrame:
    """doc_id, ids and the text that they decode to, for each row with a doc_id and a text."""
    lean_workers(df.sparkSession)
    return df.select("doc_id", encode_and_decode(F.col("text").cast("string"), path, end).alias("c")).select("doc_id", "c.ids", "c.text")


def digests(df: DataFrame, path: str) -> DataFrame:
    """The query's columns: counts and digests of ids, with the end id, and of the decoded text."""
    return round_trip(df, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
