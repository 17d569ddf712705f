"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.tables import stage as materialise
from lodestone.sources.tables import table

__all__ = ["WHITE", "WordHashes", "crc_of", "fold", "hash_words", "lean_workers", "lookup", "materialise", "mix", "table", "text_slices", "uniform"]

#: Word separators of the contracts: space and U+0009 to U+000D, which is what bytes.split() uses.
WHITE = b" \t\n\x0b\x0c\r"


def lookup(rows: DataFrame, small: DataFrame, keys: list[str], spread: Column, most: int = 200_000, salts: int = 32) -> DataFrame:
    """rows joined with `small`, a materialised table of one row for each value of the keys.

    Up to `most` rows it is broadcast, so rows aren't shuffled. Beyond, both sides are shuffled by the keys and a
    salt, a hash of `spread`, so a value that holds a third of all rows is dealt over `salts` tasks."""
    if small.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(small), keys)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    dealt = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(dealt, [*keys, "__salt"]).drop("__salt")


#: Settings of a session that runs these operators, and Spark's defaults, which they replace; what a user has set stays.
WORKERS = {
    # bytes of an Arrow batch: a batch of whole texts is held several times over, off the heap of the executor, in the
    # buffers of its Python worker and as Python strings
    "spark.sql.execution.arrow.maxBytesPerBatch": ("4m", ("67108864b",)),
    # Spark keeps a pool of Python workers for each environment, and this setting reaches only some kinds of Python
    # stages: with it an executor holds twice as many workers as it has cores
    "spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled": ("false", ("true",)),
}


def lean_workers(spark: SparkSession) -> None:
    """Applies WORKERS. The settings stay, because the DataFrames that operators return run later."""
    for key, (value, defaults) in WORKERS.items():
        if spark.conf.get(key, defaults[0]) in defaults:
            spark.conf.set(key, value)


def crc_of(col: str) -> Column:
    """crc32 of a column as text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))


def fold(col: str, k: int) -> Column:
    return F.pmod(crc_of(col), F.lit(k))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") * F.lit(2.0**-53)


class WordHashes:
    """64-bit hashes of words, remembered for the words met lately.

    The memory is bounded: beyond `most` words it starts anew."""

    def __init__(self, most: int = 200_000, seed: int = 0):
        self.most, self.seed, self.known = most, seed, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.most:
                known.clear()
            seed = self.seed
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w, seed)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True
_PRIME = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant modulo 2^64 and their inverses; kept for the sizes in use."""
    if not _powers or len(_powers[0]) < m:
        n = max(m, 1 << 16)
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(np.full(n, p, np.uint64)) for p in (_PRIME, pow(_PRIME, -1, 1 << 64))]
    return _powers[0], _powers[1]


def hash_words(parts: list[bytes], block: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (between ASCII white space) of all parts in a row, and the words of each part.

    Computed from prefix sums over the bytes, in blocks that end between words."""
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    inside = ~_IS_WHITE[raw]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = np.empty(len(start), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + block, "right")))
            a, b = start[i], end[j - 1]
            power, back = _power_tables(b - a + 1)
            c = np.zeros(b - a + 1, np.uint64)
            np.cumsum((raw[a:b].astype(np.uint64) + np.uint64(1)) * power[: b - a], out=c[1:])
            out[i:j] = mix((c[end[i:j] - a] - c[start[i:j] - a]) * back[start[i:j] - a])
            i = j
    ends = np.cumsum([len(p) + 1 for p in parts])
    return out, np.diff(np.searchsorted(start, ends), prepend=0)


def text_slices(texts, most: int = 2_000_000):
    """Lists of (row, text) with about `most` characters each."""
    now, n = [], 0
    for i, t in enumerate(texts):
        t = t.as_py() or ""
        now.append((i, t))
        n += len(t)
        if n >= most:
            yield now
            now, n = [], 0
    if now:
        yield now
