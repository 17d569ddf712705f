"""Distinct-chunk tables: texts as runs of marked words, each distinct one segmented once.

A chunk is a run of spaces with the characters up to the next such run. Where no piece of a vocabulary holds a space after another
character, no piece crosses the edge of a chunk, so a text's ids are those of its chunks in a row. The chunks of a batch are encoded
as a dictionary by Arrow; only distinct ones that the table of the worker lacks are segmented, and ids are joined back to the
texts by position, with numpy. The table is bounded: it starts anew beyond `MOST` chunks or `MOST_BYTES` bytes of them.

The table belongs to a worker and not to the corpus, because a table of all chunks of a corpus would have to meet every occurrence of a
word in a shuffle, which is several times the size of the texts."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestone.llm.bpe import Pairs

#: Chunks and bytes of chunks that a worker remembers.
MOST, MOST_BYTES = 300_000, 12_000_000
#: Bytes of text that are laid in a row.
SLICE = 4_000_000
#: Runs of more symbols are merged one by one, with a heap.
LONG = 48
NONE = np.iinfo(np.int32).max


def merged(symbols: list, rank: Callable) -> list:
    """Joins the adjacent pair of least rank, the leftmost on ties, until rank(a, b) is None for all neighbours: a heap of
    (rank, place) over a linked list."""
    out, n = list(symbols), len(symbols)
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    heap = [(r, i, out[i], out[i + 1]) for i in range(n - 1) if (r := rank(out[i], out[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if out[i] != a or j >= n or out[j] != b:  # one of the two is gone, or has grown
            continue
        out[i], out[j], after[i] = a + b, None, after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (r := rank(out[k], out[after[k]])) is not None:
                heapq.heappush(heap, (r, k, out[k], out[after[k]]))
    return [x for x in out if x is not None]


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (size[i] of them) for each i, in a row."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(first - (ends - size), size) + np.arange(total)


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[pa.Array]:
    """Parts of an array of texts with about `most` bytes each; nulls become empty."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield texts.slice(i, j - i)
        i = j


class Laid:
    """Texts laid in a row, each that isn't empty behind a space, and cut into chunks.

    raw: their bytes; bounds: where texts begin, and the end; chunks: one binary array; first: the number of each text's first chunk,
    and the end. With `unicode`, a space behind white space of any kind begins no chunk."""

    def __init__(self, texts: pa.Array, unicode: bool = False):
        empty = pc.equal(pc.binary_length(texts), 0)
        laid = pa.concat_arrays([pc.binary_join_element_wise(pc.if_else(empty, "", " "), texts, "").cast(pa.large_binary())])
        self.bounds = np.frombuffer(laid.buffers()[1], np.int64)[laid.offset : laid.offset + len(laid) + 1]
        data = laid.buffers()[2]
        self.raw = np.frombuffer(data, np.uint8)[: self.bounds[-1]] if data is not None and self.bounds[-1] else np.empty(0, np.uint8)
        self.bounds = self.bounds - self.bounds[0]
        space = self.raw == 0x20
        cut = space.copy()
        cut[1:] &= ~(white(self.raw)[:-1] if unicode else space[:-1])
        cut[self.bounds[:-1][np.diff(self.bounds) > 0]] = True
        start = np.flatnonzero(cut)
        self.first = np.searchsorted(start, self.bounds)
        offsets = np.append(start, len(self.raw)).astype(np.int64)
        self.chunks = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(self.raw)])


def white(raw: np.ndarray) -> np.ndarray:
    """Which bytes end a character of Unicode's white space."""
    out = (raw == 0x20) | ((raw >= 9) & (raw <= 13))
    at = np.flatnonzero(raw >= 0x80)
    at = at[at >= 1]
    c, b, a = raw[at], raw[at - 1], raw[np.maximum(at - 2, 0)]
    two = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
    general = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    three = general | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    out[at[two | (three & (at >= 2))]] = True
    return out


def merge_rows(flat: np.ndarray, size: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """The same for many short runs together: those of similar length form a padded matrix, and in each round every row joins its
    leftmost pair of least id; rows that are done leave it.

    flat: the ids of all runs in a row; size: how many each has; pairs: the joined id of two ids, which is its rank. Returns the same of
    what is left."""
    first, left = np.cumsum(size) - size, size.copy()
    order, out = np.argsort(size, kind="stable"), flat.copy()
    i = 0
    while i < len(order):  # lengths within a quarter of each other, at most about two million cells
        n = int(size[order[i]])
        most = max(n + 2, n * 5 // 4)
        j = min(int(np.searchsorted(size[order], most, "right")), i + max(1, 2_000_000 // most))
        _merge_block(out, left, order[i:j], first, pairs)
        i = j
    return out[spread(first, left)], left


def _merge_block(out: np.ndarray, left: np.ndarray, rows: np.ndarray, first: np.ndarray, pairs: Pairs) -> None:
    """Merges some rows and writes what is left of each to `out`, from its first place on."""
    n = left[rows]
    w = int(n.max(initial=0))
    if w < 2:
        return
    ids = np.zeros((len(rows), w), np.int32)
    ids[np.arange(w) < n[:, None]] = out[spread(first[rows], n)]
    rank = pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), w - 1)
    rank[np.arange(w - 1) >= n[:, None] - 1] = NONE
    while len(rows):
        at = rank.argmin(1)
        every = np.arange(len(rows))
        best = rank[every, at]
        done = best == NONE
        if done.any():
            k = np.flatnonzero(done)
            out[spread(first[rows[k]], n[k])] = ids[k][np.arange(ids.shape[1]) < n[k][:, None]]
            left[rows[k]] = n[k]
            keep = ~done
            rows, n, at, best = rows[keep], n[keep], at[keep], best[keep]
            if not len(rows):
                break
            w = int(n.max())
            ids, rank = ids[keep, :w], rank[keep, : w - 1]
            every = np.arange(len(rows))
        later = np.arange(ids.shape[1] - 1) > at[:, None]
        ids = np.where(later, ids[:, 1:], ids[:, :-1])
        ids[every, at] = best
        n = n - 1
        rank = np.concatenate([np.where(later[:, :-1], rank[:, 1:], rank[:, :-1]), np.full((len(rows), 1), NONE, np.int32)], 1)[:, : max(ids.shape[1] - 1, 1)]
        for p in (at - 1, at):
            ok = np.flatnonzero((p >= 0) & (p < n - 1))
            rank[ok, p[ok]] = pairs(ids[ok, p[ok]], ids[ok, p[ok] + 1])
        over = np.flatnonzero((at >= n - 1) & (at < rank.shape[1]))
        rank[over, at[over]] = NONE


def pair_table(parts: list, number: dict) -> Pairs:
    """The joined id of each pair of `parts` whose concatenation is one; number: the id of each."""
    rows = [(number[p[:i]], number[p[i:]], number[p]) for p in parts for i in range(1, len(p)) if p[:i] in number and p[i:] in number]
    a = np.array(rows, np.int64).reshape(-1, 3)
    return Pairs((a[:, 0] << 32) | a[:, 1], a[:, 2].astype(np.int32))


def joined(flat: np.ndarray, size: np.ndarray, fast: np.ndarray, rest: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs in their order: those that `fast` marks lie in a row in flat, the others in rest."""
    whole, n = np.empty(len(fast), np.int64), np.fromiter(map(len, rest), np.int64, len(rest))
    whole[fast], whole[~fast] = size, n
    first, out = np.cumsum(whole) - whole, np.empty(int(whole.sum()), np.int32)
    out[spread(first[fast], size)] = flat
    out[spread(first[~fast], n)] = np.fromiter((i for x in rest for i in x), np.int32, int(n.sum()))
    return out, whole


class ChunkTable:
    """Ids of distinct chunks. segment: gives the ids of chunks (bytes) in a row, and how many each has."""

    def __init__(self, segment: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.segment = segment
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.bytes, self.ids, self.size = 0, np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int64)
        self.start, self.used = np.zeros(1 << 14, np.int64), 0

    def _learn(self, words: list[bytes]) -> None:
        flat, size = self.segment(words)
        n = len(self.known)
        while n + len(words) > len(self.size):
            self.size, self.start = np.concatenate([self.size, self.size]), np.concatenate([self.start, self.start])
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.ids[self.used : self.used + len(flat)] = flat
        self.size[n : n + len(words)] = size
        self.start[n : n + len(words)] = self.used + np.cumsum(size) - size
        self.used += len(flat)
        self.bytes += sum(map(len, words))
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def __call__(self, words: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in a row, and how many each has; chunk i is words[codes[i]]."""
        if len(self.known) > MOST or self.bytes > MOST_BYTES:
            self.clear()
        if new := [w for w in words if w not in self.known]:
            self._learn(new)
        row = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[codes]
        size = self.size[row]
        return self.ids[spread(self.start[row], size)], size


def distinct(chunks: pa.Array) -> tuple[list[bytes], np.ndarray]:
    coded = chunks.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def per_text(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the counts of chunks from each text's first on: where its ids begin, and the end."""
    return np.concatenate([[0], np.cumsum(counts)])[first]
