"""Searches inside one task, on graphs whose size the caller has bounded: stars, components of cycles, breadth-first search.

Nodes are numbers; their numbers follow the order of their names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def numbered(*columns: pa.Array) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct names of all columns in order, and each column as places among them (-1 for null)."""
    names = pc.unique(pa.concat_arrays([c.cast(pa.large_string()) for c in columns])).drop_null()
    names = names.take(pc.sort_indices(names))
    place = lambda c: pc.fill_null(pc.index_in(c.cast(pa.large_string()), value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return names, [place(c) for c in columns]


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each node is connected with, whatever the direction."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        np.minimum.at(new, label, new)  # hooks the old root to what its nodes have met
        new = new[new]
        if (new == label).all():
            return label
        label = new


def rows_of(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct targets of all nodes in a row, in order, and where those of each begin, and the end."""
    pairs = np.unique(a * n + b) if len(a) else np.empty(0, np.int64)
    return pairs % max(n, 1), np.searchsorted(pairs // max(n, 1), np.arange(n + 1))


def cyclic(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's strongly connected component (Tarjan's algorithm without recursion)."""
    flat, first = (x.tolist() for x in rows_of(n, a, b))
    index, low, root = [-1] * n, [0] * n, np.full(n, -1)
    open_, count = [], 0
    for start in range(n):
        if index[start] >= 0:
            continue
        todo = [(start, 0)]
        while todo:
            v, i = todo.pop()
            if i == 0:
                index[v] = low[v] = count
                count += 1
                open_.append(v)
            for j in range(first[v] + i, first[v + 1]):
                w = flat[j]
                if index[w] < 0:
                    todo += [(v, j + 1 - first[v]), (w, 0)]
                    break
                if root[w] < 0:
                    low[v] = min(low[v], index[w])
            else:
                if low[v] == index[v]:
                    members = []
                    while not members or members[-1] != v:
                        members.append(open_.pop())
                    root[members] = min(members)
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[v])
    return root


#: Seeds that are searched together, a bit of each node's set for each.
TOGETHER = 512


def reached(flat: np.ndarray, start: np.ndarray, seeds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(seed, node, depth) of all nodes that distinct seeds reach, themselves included, with the fewest steps; see rows_of.

    Many seeds go together, so they share each step over an edge: a node's set has a bit for each of them, and a step unites the sets
    of those that an edge leads from and keeps what is new."""
    # one table of sets for all parts; rows that a part has used are emptied after it, so a part costs what it reaches
    seen = np.zeros((len(start) - 1, -(-min(len(seeds), TOGETHER) // 64)), np.uint64)
    for k in range(0, len(seeds), TOGETHER):
        part = seeds[k : k + TOGETHER]
        used = [part]
        bit = np.arange(len(part))
        seen[part, bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
        front, new, depth = part, seen[part], 0
        while len(front):
            on = np.unpackbits(np.ascontiguousarray(new).view(np.uint8), axis=1, bitorder="little")
            i, j = np.nonzero(on)
            yield part[j], front[i], np.full(len(i), depth)
            size = start[front + 1] - start[front]
            ends = np.cumsum(size)
            to = flat[np.repeat(start[front] - (ends - size), size) + np.arange(int(ends[-1]))]
            order = np.argsort(to, kind="stable")
            nodes, first = np.unique(to[order], return_index=True)
            if not len(nodes):
                break
            met = np.bitwise_or.reduceat(np.repeat(new, size, axis=0)[order], first, axis=0) & ~seen[nodes]
            some = met.any(1)
            front, new, depth = nodes[some], met[some], depth + 1
            seen[front] |= new
            used.append(front)
        for rows in used:
            seen[rows] = 0


def shortest(flat: list[int], start: list[int], seed: int, wanted: set[int] | None) -> Iterator[list[int]]:
    """The first shortest path, in the order of the nodes, from a seed to each wanted node that it reaches (None: to all); see rows_of."""
    before, front = {seed: -1}, [seed]
    left = None if wanted is None else wanted - {seed}
    while front and (left is None or left):
        new = []
        for x in front:  # in the order of their paths, so the first to meet a node has the first path to it
            for y in flat[start[x] : start[x + 1]]:
                if y not in before:
                    before[y] = x
                    new.append(y)
        if left is not None:
            left.difference_update(new)
        front = new
    for x in before if wanted is None else [w for w in wanted if w in before]:
        path = []
        while x >= 0:
            path.append(x)
            x = before[x]
        yield path[::-1]
