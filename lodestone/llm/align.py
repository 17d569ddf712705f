"""Alignment of two tokenisations of the same texts by bytes, and how often pairs of ids meet in a corpus.

A is a byte-level BPE over a space and the text, B the pieces of a model that adds that space itself. Both are encoded by tables of distinct
chunks (chunks.py). In each batch an asof join by document finds, for the start of each token of A, the token of B that covers
it, and the other way round; the union of both holds every overlap once. Ends that both sides share cut the tokens into groups.

How many documents hold a pair is counted from each document's distinct pairs, with partial results in tasks. The counts come
back in two joins: the pairs that have more than 1 / `HEAVY` of all these rows, of which there are fewer than `HEAVY`, are broadcast; the
others are shuffled, and none of them can fill a task.

Defined cases: null and empty texts, and those with U+2581, whose pieces read as spaces, have no tokens: zeros and the empty text. Each
row is a document, also where rows repeat a doc_id or a text. Long texts are encoded whole, in a batch of their own. No rows give no
rows. Other columns than doc_id and text aren't read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import Pairs, splitter
from lodestone.llm.chunks import LONG, ChunkTable, Laid, distinct, joined, merge_rows, merged, slices, spread
from lodestone.llm.common import lean_workers, materialise
from lodestone.llm.pieces import MARK, pieces

#: Fewer pairs than this are broadcast.
HEAVY = 200_000
#: Bytes of text that are aligned together.
BATCH = 1_000_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes stand for themselves, the others for U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def strange(text: str) -> bool:
    """Whether a text has characters that Python's tables don't know; a tokenizer's newer tables may."""
    return any(unicodedata.category(c) == "Cn" for c in set(text))


class ByteLevel:
    """A byte-level BPE from the JSON file of a tokenizer, without special tokens."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        pre, model = model["pre_tokenizer"], model["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"]:
            raise ValueError("not a byte-level BPE without a prefix")
        byte = byte_letters()
        of = lambda s: bytes(byte[c] for c in s)
        self.id_of = {of(s): i for s, i in model["vocab"].items()}
        merges = [tuple(map(of, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        ids = [self.id_of[a + b] for a, b in merges]
        if any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
            raise ValueError("ids must have the order of the merges")
        self.rank = {m: i for m, i in zip(merges, ids, strict=True)}
        keys = np.array([(self.id_of[a] << 32) | self.id_of[b] for a, b in merges], np.int64)
        self.pairs = Pairs(keys, np.array(ids, np.int32))
        self.single = np.array([self.id_of[bytes([b])] for b in range(256)], np.int32)
        self.length = np.zeros(max(self.id_of.values()) + 1, np.int64)
        for b, i in self.id_of.items():
            self.length[i] = len(b)
        self.split = splitter(pattern).findall
        self.library = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.table = ChunkTable(self.segment)

    def words(self, chunks: list[str]) -> tuple[list[str], np.ndarray]:
        """The parts that are merged apart, in a row, and how many each chunk has. A chunk begins with a space, so no part crosses its beginning
        if the one before ends without white space. Characters newer than Python's tables are left to the library's."""
        text = "".join(chunks)
        if strange(text):
            found = [[c[a:b] for _, (a, b) in self.library(c)] if strange(c) else self.split(c) for c in chunks]
        elif any(c[-1].isspace() for c in chunks):  # only the last one of a text
            found = list(map(self.split, chunks))
        else:
            words = self.split(text)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
            edges = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
            return words, np.diff(np.searchsorted(ends, edges, "right"), prepend=0)
        return [w for f in found for w in f], np.fromiter(map(len, found), np.int64, len(found))

    def segment(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [c.decode("utf-8", "replace") for c in chunks]
        last = [i for i, c in enumerate(texts) if c[-1].isspace()]  # few: they end a text
        rest = sorted({*range(len(texts))}.difference(last)) if last else range(len(texts))
        parts = [self.words([texts[i] for i in k]) for k in (rest, last)]
        words = pa.array(parts[0][0] + parts[1][0], pa.large_string()).dictionary_encode()
        flat, size = self._merge([w.encode() for w in words.dictionary.to_pylist()])
        n = np.zeros(len(chunks), np.int64)
        for k, (_, m) in zip((rest, last), parts, strict=True):
            n[np.fromiter(k, np.int64, len(k))] = m
        at = np.empty(int(n.sum()), np.int64)  # the words of each chunk, in the order of chunks
        first, code, used = np.cumsum(n) - n, words.indices.to_numpy(zero_copy_only=False), 0
        for k, (_, m) in zip((rest, last), parts, strict=True):
            at[spread(first[np.fromiter(k, np.int64, len(k))], m)] = code[used : used + int(m.sum())]
            used += int(m.sum())
        first = np.cumsum(size) - size
        return flat[spread(first[at], size[at])], np.add.reduceat(size[at], np.cumsum(n) - n)

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        number = self.single[np.frombuffer(b"".join(words), np.uint8)]
        fast, first = size <= LONG, np.cumsum(size) - size
        flat, n = merge_rows(number[spread(first[fast], size[fast])], size[fast], self.pairs)
        slow = [[self.id_of[t] for t in merged([words[i][k : k + 1] for k in range(len(words[i]))], lambda a, b: self.rank.get((a, b)))] for i in np.flatnonzero(~fast)]
        return joined(flat, n, fast, slow)


@lru_cache(2)
def byte_level(path: str, pattern: str) -> ByteLevel:
    """One for each worker process. A path that starts with files: names a file given by SparkContext.addFile."""
    return ByteLevel(SparkFiles.get(path[6:]) if path.startswith("files:") else path, pattern)


def overlaps(start_a: np.ndarray, doc_a: np.ndarray, start_b: np.ndarray, doc_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the tokens of all overlapping pairs. Starts ascend; both sides cover the same bytes of each document."""
    a = pd.DataFrame({"at": start_a, "doc": doc_a, "a": np.arange(len(start_a))})
    b = pd.DataFrame({"at": start_b, "doc": doc_b, "b": np.arange(len(start_b))})
    over_a = pd.merge_asof(a, b, on="at", by="doc")
    over_b = pd.merge_asof(b, a, on="at", by="doc", allow_exact_matches=True)
    later = start_a[over_b["a"].to_numpy()] != start_b  # pairs that start together are in the first join already
    return np.concatenate([over_a["a"].to_numpy(), over_b["a"].to_numpy()[later]]), np.concatenate([over_a["b"].to_numpy(), over_b["b"].to_numpy()[later]])


@lru_cache(2)
def _decimals(n: int) -> pa.Array:
    """The decimal forms of 0 to n - 1, each followed by nothing, a comma, a bar or a semicolon."""
    return pa.array([f"{i}{s}" for i in range(n) for s in ("", ",", "|", ";")], pa.large_string())


ALIGNED = "struct<n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups: string, pairs: array<bigint>, times: array<int>>"
_KIND = pa.struct([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])


def _aligned_slice(texts: pa.Array, a: ByteLevel, length_b: np.ndarray, table_b: ChunkTable) -> pa.Array:
    laid = Laid(pc.if_else(pc.match_substring(texts, MARK), "", texts), unicode=True)
    chunks = distinct(laid.chunks)
    (ids_a, n_a), (ids_b, n_b) = a.table(*chunks), table_b(*chunks)
    size_a, size_b = a.length[ids_a], length_b[ids_b]
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    if end_a[-1:].sum() != len(laid.raw) or end_b[-1:].sum() != len(laid.raw):
        raise ValueError("tokens don't cover their texts")
    bounds_a, bounds_b = (np.concatenate([[0], np.cumsum(n)])[laid.first] for n in (n_a, n_b))
    docs = np.arange(len(texts))
    doc_a, doc_b = np.repeat(docs, np.diff(bounds_a)), np.repeat(docs, np.diff(bounds_b))
    common = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
    n_groups = np.diff(np.searchsorted(common, laid.bounds, "right"))
    # groups as text: tokens in the order of groups, A before B, each with what follows it
    last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
    final = np.zeros(len(ids_b), bool)
    final[bounds_b[1:][np.diff(bounds_b) > 0] - 1] = True
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    order[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)] = ids_a.astype(np.int64) * 4 + np.where(last_a, 2, 1)
    order[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")] = ids_b.astype(np.int64) * 4 + np.where(final, 0, np.where(last_b, 3, 1))
    said = _decimals(max(len(a.length), len(length_b))).take(pa.array(order))
    ends = np.frombuffer(said.buffers()[1], np.int64)[said.offset : said.offset + len(said) + 1][bounds_a + bounds_b]
    groups = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(ends.copy()), said.buffers()[2]]).cast(pa.string())
    # links, and each document's distinct pairs
    x, y = overlaps(end_a - size_a, doc_a, end_b - size_b, doc_b)
    n_links = np.bincount(doc_a[x], minlength=len(texts))
    keys, times = np.unique((doc_a[x] << 32) | (ids_a[x].astype(np.int64) << 16) | ids_b[y], return_counts=True)
    at = np.searchsorted(keys, np.arange(len(texts) + 1) << 32).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v)) for v in (keys & 0xFFFFFFFF, times.astype(np.int32))]
    counts = [pa.array(v.astype(np.int64)) for v in (np.diff(bounds_a), np.diff(bounds_b), n_groups, n_links)]
    return pa.StructArray.from_arrays([*counts, groups, *lists], fields=list(_KIND))


def alignment(text: Column, path_a: str, pattern: str, path_b: str) -> Column:
    """ALIGNED of each text: numbers of tokens, groups and links; groups as a1,a2|b1;a3|b2 with decimal ids in order; and the distinct pairs
    of linked ids, a * 65536 + b, with how often each is linked."""

    @F.arrow_udf(ALIGNED)
    def one(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a, b = byte_level(path_a, pattern), pieces(path_b)
        length = b.length.copy()
        if len(a.length) > 1 << 16 or len(length) > 1 << 16:
            raise ValueError("ids must be below 65,536")
        for col in cols:
            out = [_aligned_slice(part, a, length, b.table) for part in slices(col, BATCH)]
            yield pa.concat_arrays(out) if out else pa.array([], _KIND)

    return one(text)


def aligned(docs: DataFrame, path_a: str, pattern: str, path_b: str) -> DataFrame:
    """doc_id and the fields of ALIGNED for each row with a doc_id and a text."""
    lean_workers(docs.sparkSession)
    return docs.select("doc_id", alignment(F.col("text").cast("string"), path_a, pattern, path_b).alias("c")).select("doc_id", "c.*")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n_docs, best): how many rows hold each pair of ids, and whether no other pair with its id of A is in more.

    links: rows with pairs, distinct in each."""
    counts = materialise(links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs")))
    a = F.shiftright("pair", 16)
    most = counts.groupBy(a.alias("a")).agg(F.max("n_docs").alias("most"))  # a row for each id of a vocabulary at most
    return counts.join(F.broadcast(most), a == F.col("a")).select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def with_counts(links: DataFrame, counts: DataFrame, row: str, heavy: int = HEAVY) -> DataFrame:
    """(row, n_best, count_sum) of the rows that have links: how many of their links are best, and the sum of all their counts.

    links: a staged table of row, pairs, times; counts: a staged table as of pair_counts."""
    each = links.select(row, F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(row, "p.pairs", "p.times").withColumnRenamed("pairs", "pair")
    total = counts.agg(F.sum("n_docs")).first()[0] or 0
    common = F.col("n_docs") * heavy > total
    sums = lambda x: x.groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n_docs") * F.col("times")).alias("count_sum"))
    held = each.join(F.broadcast(counts.filter(common)), "pair", "left")
    # rows that meet a broadcast pair are summed at once; for the others the pairs are shuffled
    known = held.filter(F.col("n_docs").isNotNull())
    rest = held.filter(F.col("n_docs").isNull()).select(row, "pair", "times").join(counts.filter(~common).hint("shuffle_hash"), "pair")
    both = known.select(row, "times", "n_docs", "best").unionByName(rest.select(row, "times", "n_docs", "best"))
    return sums(both)


def reported(docs: DataFrame, path_a: str, pattern: str, path_b: str) -> DataFrame:
    """The query's columns: counts of tokens, groups and links, best links, the sum of the counts of pairs, and the digest of the groups."""
    x = aligned(docs, path_a, pattern, path_b)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    rows = materialise(x.select(F.monotonically_increasing_id().alias("__row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"))
    counts = materialise(pair_counts(rows))
    sums = with_counts(rows.filter("n_links > 0"), counts, "__row")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = rows.drop("pairs", "times").join(sums, "__row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
