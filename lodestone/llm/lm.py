"""Language-model scoring with a log-frequency Bloom filter.

Counting: each task hashes the words of its texts, adds up its unigrams and bigrams and sends them,
packed by hash range, to the range's merger. A merger adds equal hashes. Unigram ranges keep exact
counts. Bigram ranges become filters: a count is quantised to a level of a half-octave scale, and the
pairs (bigram, 1) to (bigram, level) are inserted. The number of ranges grows with the corpus, so a
range's size doesn't.

Scoring: the ranges are broadcast; the level of a bigram is found by repeated membership probes, until
one fails. Beyond `LIMIT` bytes the ranges are broadcast in several passes. Then the texts are dealt into parts of
about `PART` bytes, and the distinct hashes of each part are written once, laid out by the pass that knows them; a pass
reads its own hashes and writes their counts and levels, and at the end each part is scored with all of them. So texts
are read twice and hashes once, however many passes there are; the results are the same. A filter has about 10
bits for each level of each bigram, so LIMIT bytes serve some tens of millions of distinct bigrams a pass, and the disk
of an executor must hold one pass.

Model: P(w | v) = (c~(v w) + MU * P1(w)) / (c(v) + MU), with P1 the smoothed unigram of the base score, c~ the
quantised count (never over the true one, but for the filter's false positives of about 1 %), so the
probabilities of a context add up to at most about 1. A text's first context is the beginning.

Words are told apart by 64-bit hashes; with ten million distinct words the chance of any collision is
about 3 in a million. Counts cover all training texts; nothing is pruned.

Defined cases: a null text is an empty one, its only token is the end; rows that repeat a doc_id are
texts of their own; without training texts N = V = 0, c = 0; no rows give no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import fold, hash_words, lean_workers, materialise, mix, text_slices

MU = 300.0
#: Text bytes of a range at least, bits of the filter for each insertion, probes for each membership test.
RANGE_BYTES, BITS, PROBES = 16_000_000, 10, 4
#: Bytes broadcast at once, and text bytes of a part where that takes several passes.
LIMIT, PART = 200_000_000, 4_000_000
END, BEGIN = np.uint64(0x0E0D), np.uint64(0xBE91)
#: Counts that a level stands for: 1, 2, 3, 4, 6, 8, 12, ...
VALUES = np.array([1] + [x for i in range(1, 62) for x in (1 << i, 3 << (i - 1))], np.int64)
VALUES = VALUES[: np.searchsorted(VALUES, 1 << 61)]
_P = np.uint64(0xD6E8FEB86659FD93)


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(VALUES, counts, "right")


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens (each text's words and its end), of the bigrams that end there, and each text's tokens."""
    words, n = hash_words([t.encode("utf-8", "surrogatepass").lower() for t in texts])
    size = n + 1
    ends = np.cumsum(size) - 1
    tok = np.empty(int(size.sum()), np.uint64)
    is_end = np.zeros(len(tok), bool)
    is_end[ends] = True
    tok[is_end], tok[~is_end] = END, words
    before = np.concatenate([[BEGIN], tok[:-1]]).astype(np.uint64)
    before[ends[:-1] + 1] = BEGIN
    with np.errstate(over="ignore"):
        return tok, mix(before * _P + tok), size


def _packed(kind: int, h: np.ndarray, n_ranges: int):
    """One row for each range met: its distinct hashes and their counts."""
    keys, n = np.unique(h, return_counts=True)
    at = range_of(keys, n_ranges)
    cut = np.flatnonzero(np.diff(at, prepend=-1))
    for i, j in zip(cut, [*cut[1:], len(keys)], strict=True):
        yield kind, int(at[i]), keys[i:j].tobytes(), n[i:j].astype(np.int64).tobytes()


def range_of(h: np.ndarray, n_ranges: int) -> np.ndarray:
    """Ascending with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)


def _places(h: np.ndarray, level: np.ndarray | int, bits: np.ndarray | int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        a = mix(h + np.asarray(level).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
        b = (a >> np.uint64(32)) | np.uint64(1)
        return [(a + np.uint64(i) * b) % np.asarray(bits, np.uint64) for i in range(PROBES)]


def filter_of(keys: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """Bits and bytes of the filter of a range's n-grams."""
    level = level_of(counts)
    bits = (int(level.sum()) * BITS + 71) // 64 * 64
    on = np.zeros(bits, bool)
    for k in range(1, int(level.max()) + 1 if len(level) else 0):
        some = keys[level >= k]
        for p in _places(some, k, bits):
            on[p] = True
    return bits, np.packbits(on, bitorder="little").tobytes()


RANGE = "kind int, at int, n long, total long, bits long, keys binary, data binary"


def _merge(t: pa.Table) -> pa.Table:
    """All packed rows of one range as one row."""
    kind, at = t["kind"][0].as_py(), t["at"][0].as_py()
    keys = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in t["keys"]])
    counts = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in t["counts"]])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1)))
    keys, counts = keys[first], np.add.reduceat(counts, first)
    bits, data, names = 0, counts.tobytes(), keys.tobytes()
    if kind == 1:
        bits, data = filter_of(keys, counts)
        names = b""
    return pa.table({"kind": pa.array([kind], pa.int32()), "at": pa.array([at], pa.int32()), "n": [len(keys)], "total": [int(counts.sum())], "bits": [bits], "keys": pa.array([names], pa.binary()), "data": pa.array([data], pa.binary())})


def count_ranges(training: DataFrame) -> tuple[DataFrame, int]:
    """The merged ranges of unigrams (kind 0) and bigrams (kind 1) of a column `text`, and how many there are of each."""
    size = training.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = max(48, size // RANGE_BYTES)

    def run(batches):
        for b in batches:
            for part in text_slices(b["text"]):
                tok, pair, _ = tokens_of([t for _, t in part])
                rows = [*_packed(0, tok, n_ranges), *_packed(1, pair, n_ranges)]
                kind, at, keys, counts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(at, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["kind", "at", "keys", "counts"])

    packed = training.select("text").mapInArrow(run, "kind int, at int, keys binary, counts binary")
    return materialise(packed.groupBy("kind", "at").applyInArrow(_merge, RANGE)), n_ranges


class Ranges:
    """Some ranges, ready for probing."""

    def __init__(self, sizes: list, n_ranges: int):
        """sizes: rows with kind, at, bits and n of the ranges that will be put in, in any order."""
        self.n_ranges = n_ranges
        self.place = {}
        ends = [0, 0]
        for r in sorted(sizes, key=lambda r: (r["kind"], r["at"])):
            self.place[r["kind"], r["at"]] = ends[r["kind"]]
            ends[r["kind"]] += r["bits"] // 8 if r["kind"] else r["n"]
        self.bits, self.offset = np.zeros(n_ranges, np.int64), np.zeros(n_ranges, np.int64)
        self.keys, self.counts, self.data = np.empty(ends[0], np.uint64), np.empty(ends[0], np.int64), np.empty(ends[1], np.uint8)

    def put(self, r) -> None:
        i = self.place[r["kind"], r["at"]]
        if r["kind"]:
            self.bits[r["at"]], self.offset[r["at"]] = r["bits"], 8 * i
            self.data[i : i + r["bits"] // 8] = np.frombuffer(r["data"], np.uint8)
        else:
            self.keys[i : i + r["n"]] = np.frombuffer(r["keys"], np.uint64)
            self.counts[i : i + r["n"]] = np.frombuffer(r["data"], np.int64)

    def unigrams(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(h), np.int64)
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[i] == h, self.counts[i], 0)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Of bigrams: probes level after level until one is not there."""
        out = np.zeros(len(h), np.uint8)
        at = range_of(h, self.n_ranges)
        alive = np.flatnonzero(self.bits[at] > 0)
        bits, offset = self.bits[at], self.offset[at].astype(np.uint64)
        for level in range(1, len(VALUES) + 1):
            if not len(alive):
                break
            alive = self._there(h, alive, bits, offset, level)
            out[alive] = level
        return out

    def _there(self, h: np.ndarray, alive: np.ndarray, bits: np.ndarray, offset: np.ndarray, level: int) -> np.ndarray:
        """Those of `alive` for which all probes of the level are set; the later probes only see who passed the earlier."""
        places = [*_places(h[alive], level, bits[alive])]
        left = np.arange(len(alive))
        for p in places:
            p = p[left] + offset[alive[left]]
            left = left[(self.data[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            if not len(left):
                break
        return alive[left]


def _fill(r: Ranges, tok: np.ndarray, pair: np.ndarray, c: np.ndarray, lv: np.ndarray) -> None:
    """Adds what these ranges know; what others know is 0 here."""
    keys, back = np.unique(tok, return_inverse=True)
    c += r.unigrams(keys)[back]
    keys, back = np.unique(pair, return_inverse=True)
    lv += r.levels(keys)[back]


def _finish(c: np.ndarray, lv: np.ndarray, size: np.ndarray, n: int, v: int, n_texts: int, mu: float) -> list[np.ndarray]:
    """n_tokens, n_known, base_score, score of each text."""
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    p1 = (c + 0.5) / (n + 0.5 * (v + 1))
    before = np.concatenate([[0], c[:-1]])
    before[first] = n_texts
    seen = np.concatenate([[0], VALUES])[lv]
    p = (seen + mu * p1) / (before + mu)
    return [size, np.add.reduceat((c > 0).astype(np.int64), first), np.add.reduceat(np.log10(p1), first), np.add.reduceat(np.log10(p), first)]


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score_texts(docs: DataFrame, training: DataFrame, mu: float = MU, limit: int = LIMIT) -> DataFrame:
    """doc_id, held_out and the scores of every row of docs (doc_id, text, held_out)."""
    spark = docs.sparkSession
    lean_workers(spark)
    ranges, n_ranges = count_ranges(training)
    total = {r["kind"]: r for r in ranges.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum(F.octet_length("keys") + F.octet_length("data")).alias("bytes")).collect()}
    n, v, n_texts = (total[0]["total"], total[0]["n"], training.count()) if 0 in total else (0, 0, 0)
    passes = max(1, -(-sum(r["bytes"] for r in total.values()) // limit))
    width = -(-n_ranges // passes)

    def shared(k: int):
        rows = ranges.filter((F.col("at") >= k * width) & (F.col("at") < (k + 1) * width))
        r = Ranges(rows.select("kind", "at", "bits", "n").collect(), n_ranges)
        for row in rows.select("kind", "at", "bits", "n", "keys", "data").toLocalIterator():  # one range after another
            r.put(row)
        return spark.sparkContext.broadcast(r)

    def rows_of(b, part):
        return pa.array([i for i, _ in part])

    def finished(b, part, c, lv, size):
        cols = _finish(c, lv, size, n, v, n_texts, mu)
        at = rows_of(b, part)
        return pa.RecordBatch.from_arrays([b["doc_id"].take(at), b["held_out"].take(at), *(pa.array(x) for x in cols)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    def one_pass(s):
        def run(batches):
            r = s.value
            for b in batches:
                for part in text_slices(b["text"]):
                    tok, pair, size = tokens_of([t for _, t in part])
                    c, lv = np.zeros(len(tok), np.int64), np.zeros(len(tok), np.uint8)
                    _fill(r, tok, pair, c, lv)
                    yield finished(b, part, c, lv, size)

        return run

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "held_out")
    if passes == 1:
        s = shared(0)
        out = materialise(x.mapInArrow(one_pass(s), OUT))
        s.destroy()  # workers let go of it with their next task
    else:
        out = _in_passes(x, shared, passes, width, n_ranges, lambda c, lv, size: _finish(c, lv, size, n, v, n_texts, mu))
    return out.withColumn("train_tokens", F.lit(n).cast("long"))


def _in_passes(x: DataFrame, shared: Callable, passes: int, width: int, n_ranges: int, finish: Callable) -> DataFrame:
    """score_texts with the ranges of one pass after another; shared(k) broadcasts those of a pass."""
    size = x.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # parts are drawn, so that no text or doc_id makes one large; the table fixes the draw
    x = materialise(x.withColumn("part", F.floor(F.rand(11) * max(1, size // PART)).cast("int")))

    def distinct(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Distinct hashes and their places in the texts, of tokens and of bigrams."""
        tok, pair, sizes = tokens_of(texts)
        return [np.unique(h, return_inverse=True) for h in (tok, pair)], sizes

    def met(key: tuple, t: pa.Table) -> pa.Table:
        rows = []
        for kind, (h, _) in enumerate(distinct([y or "" for y in t["text"].to_pylist()])[0]):
            owner = range_of(h, n_ranges) // width  # ascending with the hash
            cut = np.flatnonzero(np.diff(owner, prepend=-1))
            rows += [(key[0].as_py(), kind, int(owner[i]), h[i:j].tobytes()) for i, j in zip(cut, [*cut[1:], len(h)], strict=True)]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["part", "kind", "pass", "hashes"])

    wanted = x.select("part", "text").groupBy("part").applyInArrow(met, "part int, kind int, pass int, hashes binary")
    wanted = materialise(wanted, by=["pass"])

    def probed(s):
        def run(batches):
            r = s.value
            for b in batches:
                values = []
                for kind, h in zip(b["kind"].to_pylist(), b["hashes"].to_pylist(), strict=True):
                    h = np.frombuffer(h, np.uint64)
                    values.append((r.levels(h).astype(np.int64) if kind else r.unigrams(h)).tobytes())
                yield pa.RecordBatch.from_arrays([b["part"], b["kind"], b["pass"], pa.array(values, pa.binary())], names=["part", "kind", "pass", "n"])

        return run

    known = None
    for k in range(passes):
        s = shared(k)
        got = materialise(wanted.filter(F.col("pass") == k).select("part", "kind", "pass", "hashes").mapInArrow(probed(s), "part int, kind int, pass int, n binary"))
        s.destroy()
        known = got if known is None else known.unionByName(got)

    def scored_part(docs: pa.Table, counts: pa.Table) -> pa.Table:
        found, sizes = distinct([y or "" for y in docs["text"].to_pylist()])
        per = []
        for kind, (h, back) in enumerate(found):
            mine = sorted((p, n) for q, p, n in zip(counts["kind"].to_pylist(), counts["pass"].to_pylist(), counts["n"].to_pylist(), strict=True) if q == kind)
            n = np.frombuffer(b"".join(n for _, n in mine), np.int64)
            per.append(n[back])
        cols = finish(per[0], per[1].astype(np.uint8), sizes)
        return pa.table([docs["doc_id"], docs["held_out"], *(pa.array(c) for c in cols)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return materialise(x.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(scored_part, OUT))


def scored(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    x = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (fold("doc_id", 5) == 1).alias("held_out"))
    out = score_texts(x, x.filter(~F.col("held_out")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
