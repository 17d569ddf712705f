"""Language identification: script ranges narrow the candidates of a word, then a Viterbi search over
per-word scores with a switching penalty labels the spans of mixed-language text.

A word's score for a language is learned from byte n-grams and the word itself (hashed, smoothed log
ratios against the mean of all languages), from a sample of at most about `most` documents of each
language, chosen by a hash of doc_id. The switching penalty is the same between all languages, so a
step of the search needs only the best state and each state's own past. The texts of a batch are
sorted by length and searched together, one word of each at a time.

The model's size is fixed by `BITS` and the number of languages, which is taken to be small (codes).

Defined cases: null texts and texts without a letter are `und` with score 0; ties go to the language
that sorts first; without any labelled row every text is `und`; rows are labelled one by one, so
repeated rows get equal results; inputs keep all their columns (only __lid is taken).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import _ranges
from lodestone.llm.common import fold, lean_workers, materialise, mix, uniform

MOST, BITS, LONGEST = 4_000, 17, 4
#: Nats that a change of language costs.
PENALTY = 6.0
#: First code points of blocks and their scripts (fixed values of the Unicode standard).
SCRIPTS = (
    (0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"),
    (0x780, "other"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "indic"), (0xE00, "thai"), (0xE80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
)
_NAMES = sorted({s for _, s in SCRIPTS})
_STARTS = np.array([a for a, _ in SCRIPTS])
_SCRIPT = np.array([_NAMES.index(s) for _, s in SCRIPTS])
_LETTERS = _ranges("L")
#: Runs of letters (Unicode category L; fractions, superscripts and other numbers aren't letters) in texts of ASCII, of two-byte and of
#: any characters: `re` tests the ranges beyond two bytes one by one, for each character that is no letter.
_ASCII, _WORD = re.compile("[a-zA-Z]+"), re.compile(f"[{_LETTERS}]+")
_SHORT = re.compile("[" + "".join(r for r in re.findall(r"\\U.{8}-\\U.{8}", _LETTERS) if int(r[2:10], 16) <= 0xFFFF) + "]+")


def words_of(text: str) -> list[str]:
    """The runs of letters of a text in lower case."""
    low = text.lower()
    if low.isascii():
        return _ASCII.findall(low)
    short = len(low.encode("utf-16-le", "surrogatepass")) == 2 * len(low)
    return (_SHORT if short else _WORD).findall(low)


_P = np.uint64(0x100000001B3)
_P_INV = np.uint64(pow(0x100000001B3, -1, 1 << 64))


class Words:
    """Distinct words as one row of bytes, with the hashes of their features."""

    def __init__(self, words: pa.Array):
        data = words.cast(pa.binary()).cast(pa.large_binary())
        n = len(data)
        ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]] if n and ends[-1] > ends[0] else np.empty(0, np.uint8)
        self.start, self.end, self.raw = ends[:-1] - ends[0], ends[1:] - ends[0], raw
        self.n = n

    def script(self) -> np.ndarray:
        if not self.n:
            return np.empty(0, np.int64)
        at = lambda i: self.raw[np.minimum(self.start + i, len(self.raw) - 1)].astype(np.int64)
        a, b, c, d = (at(i) for i in range(4))
        low = 0x3F
        cp = np.select([a < 0x80, a < 0xE0, a < 0xF0], [a, (a & 0x1F) << 6 | b & low, (a & 0x0F) << 12 | (b & low) << 6 | c & low], (a & 0x07) << 18 | (b & low) << 12 | (c & low) << 6 | d & low)
        return _SCRIPT[np.searchsorted(_STARTS, cp, "right") - 1]

    def grams(self, bits: int):
        """For each n: buckets of the n-grams that begin at each byte, and whether they lie in their word."""
        m = len(self.raw)
        first = np.zeros(m, bool)
        first[self.start] = True
        stop = np.repeat(self.end, self.end - self.start)
        x = self.raw.astype(np.uint64)
        h = np.zeros(m, np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, LONGEST + 1):
                y = np.zeros(m, np.uint64)
                y[: m - n + 1] = x[n - 1 :] if m >= n else 0
                h = h * _P + y + np.uint64(1)
                end = np.arange(m) + n
                tag = np.uint64(n) + first.astype(np.uint64) * np.uint64(16) + (end == stop).astype(np.uint64) * np.uint64(32)
                yield (mix(h ^ (tag << np.uint64(56))) >> np.uint64(64 - bits)).astype(np.int64), end <= stop

    def whole(self, bits: int) -> np.ndarray:
        m = len(self.raw)
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.full(m + 1, _P, np.uint64))
            back = np.multiply.accumulate(np.full(m + 1, _P_INV, np.uint64))
            c = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * power[:m], dtype=np.uint64)])
            return (mix((c[self.end] - c[self.start]) * back[self.start]) >> np.uint64(64 - bits)).astype(np.int64)


def _distinct(lists: list[list[str]]) -> tuple[np.ndarray, Words]:
    coded = pa.array([w for x in lists for w in x], pa.large_string()).dictionary_encode()
    return coded.indices.to_numpy(), Words(coded.dictionary)


class Model:
    """Tables of log ratios: (2^bits, languages) for n-grams and for whole words, and the scripts of each language."""

    def __init__(self, langs: list[str], grams: np.ndarray, whole: np.ndarray, scripts: np.ndarray, bits: int):
        self.langs, self.bits = langs, bits

        if not langs:
            return

        def ratios(c: np.ndarray, a: float) -> np.ndarray:
            p = np.log((c + a) / (c.sum(0) + a * len(c)))
            return np.clip(p - p.mean(1, keepdims=True), -4, 4).astype(np.float32)

        self.grams, self.whole = ratios(grams, 0.5), np.where(whole.sum(1, keepdims=True) >= 3, ratios(whole, 0.5), 0).astype(np.float32)
        share = scripts / np.maximum(1, scripts.sum(0))
        allowed = share >= 0.01
        self.barred = np.where(allowed.any(1, keepdims=True) & ~allowed, -8.0, 0.0).astype(np.float32)

    def scores(self, w: Words) -> np.ndarray:
        """(words, languages)"""
        total, n = np.zeros((w.n, len(self.langs))), np.zeros(w.n)
        for bucket, inside in w.grams(self.bits):
            c = np.zeros((len(bucket) + 1, len(self.langs)))
            np.cumsum(self.grams[bucket] * inside[:, None], axis=0, out=c[1:])
            total += c[w.end] - c[w.start]
            n += np.concatenate([[0], np.cumsum(inside)])[w.end] - np.concatenate([[0], np.cumsum(inside)])[w.start]
        s = 2 * total / np.maximum(1, n)[:, None] + self.whole[w.whole(self.bits)]
        return np.clip(s, -6, 6).astype(np.float32) + self.barred[w.script()]

    def label(self, lists: list[list[str]]) -> list[np.ndarray]:
        """The language of each word of each text, as places in langs. The lists come longest first."""
        index, w = _distinct(lists)
        s = self.scores(w)
        size = np.array([len(x) for x in lists], np.int64)
        base = np.concatenate([[0], np.cumsum(size)[:-1]])
        active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
        v = np.zeros((len(lists), len(self.langs)), np.float32)
        stay, best = np.zeros((len(index), len(self.langs)), bool), np.zeros(len(index), np.uint16)
        for t, a in enumerate(active):
            at = base[:a] + t
            old = v[:a]
            b = old.argmax(1)
            top = old[np.arange(a), b] - PENALTY
            keep = old >= top[:, None]
            stay[at], best[at] = keep, b
            v[:a] = np.where(keep, old, top[:, None]) + s[index[at]]
            if t % 512 == 511:
                v[:a] -= v[:a].max(1, keepdims=True)
        out, now = np.zeros(len(index), np.int64), v.argmax(1)
        for t in range(len(active) - 1, -1, -1):
            at = base[: active[t]] + t
            out[at] = now[: active[t]]
            now[: active[t]] = np.where(stay[at, out[at]], out[at], best[at])
        return np.split(out, np.cumsum(size)[:-1]) if len(size) else []

    def predict(self, texts: list[str | None], spans: bool = False) -> list[tuple]:
        """(language, score, spans) of each text; a span is (language, first word, words)."""
        out: list[tuple] = [("und", 0.0, [])] * len(texts)
        if not self.langs:
            return out
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i] or ""))
        i = 0
        while i < len(order):
            j, n = i, 0
            while j < len(order) and n < 1_000_000:
                n += len(texts[order[j]] or "")
                j += 1
            rows = [(k, x) for k in order[i:j] if texts[k] and (x := words_of(texts[k]))]
            rows.sort(key=lambda r: -len(r[1]))
            for (k, words), path in zip(rows, self.label([x for _, x in rows]), strict=True):
                weight = np.bincount(path, np.fromiter(map(len, words), np.int64, len(words)), len(self.langs))
                top = int(weight.argmax())
                runs = []
                if spans:
                    cut = np.flatnonzero(np.diff(path)) + 1
                    runs = [(self.langs[path[a]], int(a), int(b - a)) for a, b in zip([0, *cut], [*cut, len(path)], strict=True)]
                out[k] = (self.langs[top], float(weight[top] / weight.sum()), runs)
            i = j
        return out


def train(docs: DataFrame, most: int = MOST, bits: int = BITS, seed: int = 3) -> Model:
    """Learns from documents with a language whose crc32(doc_id as text) mod 3 is not 1."""
    lean_workers(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & (F.col("lang") != "und") & F.col("text").isNotNull() & (fold("doc_id", 3) != 1))
    n = {r["lang"]: r["count"] for r in known.groupBy(F.col("lang").cast("string").alias("lang")).count().collect()}
    langs = sorted(n)
    if not langs:
        return Model([], np.zeros((1, 0)), np.zeros((1, 0)), np.zeros((len(_NAMES), 0)), 0)
    share = F.lit(0.0)
    for k in langs:
        share = F.when(F.col("lang") == k, min(1.0, most / n[k])).otherwise(share)
    sample = known.filter(uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed) < share).select("lang", "text")

    def counted(batches):
        tables: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            by: dict[str, list[list[str]]] = {}
            for lang, text in zip(b["lang"], b["text"], strict=True):
                by.setdefault(str(lang.as_py()), []).append(words_of(text.as_py()))
            for lang, lists in by.items():
                index, w = _distinct(lists)
                if not w.n:
                    continue
                c = np.bincount(index, minlength=w.n)
                for kind in (0, 1, 2):
                    tables.setdefault((lang, kind), np.zeros(1 << bits if kind < 2 else len(_NAMES), np.int64))
                per_byte = np.repeat(c, w.end - w.start)
                for bucket, inside in w.grams(bits):
                    tables[lang, 0] += np.bincount(bucket, per_byte * inside, 1 << bits).astype(np.int64)
                tables[lang, 1] += np.bincount(w.whole(bits), c, 1 << bits).astype(np.int64)
                tables[lang, 2] += np.bincount(w.script(), c, len(_NAMES)).astype(np.int64)
        for (lang, kind), a in tables.items():
            at = np.flatnonzero(a)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "kind": pa.array([kind] * len(at), pa.int32()), "bucket": pa.array(at), "n": pa.array(a[at])})

    counts = materialise(sample.mapInArrow(counted, "lang string, kind int, bucket long, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")))
    code = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1
    got = counts.select(code.alias("lang"), "kind", F.col("bucket").cast("int").alias("bucket"), "n").toArrow()  # at most (2 * 2^bits + scripts) * languages rows of 20 bytes
    lang, kinds, bucket, n = (c.to_numpy() for c in got.columns)
    tables = []
    for kind, rows in ((0, 1 << bits), (1, 1 << bits), (2, len(_NAMES))):
        a, here = np.zeros((rows, len(langs))), kinds == kind
        a[bucket[here], lang[here]] = n[here]
        tables.append(a)
    return Model(langs, *tables, bits)


def label_column(spark, text: Column, model: Model, spans: bool = False) -> Column:
    """struct<lang, score, spans>; the model goes to the workers as a broadcast of fixed size."""
    shared = spark.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())])))])

    @F.arrow_udf("struct<lang: string, score: double, spans: array<struct<lang: string, first_word: bigint, n_words: bigint>>>")
    def label(col: pa.Array) -> pa.Array:
        rows = shared.value.predict(col.to_pylist(), spans)
        return pa.array([{"lang": a, "score": b, "spans": [dict(zip(("lang", "first_word", "n_words"), s, strict=True)) for s in c]} for a, b, c in rows], kind)

    return label(text)


def with_languages(docs: DataFrame, spans: bool = True) -> DataFrame:
    """docs with __lid: the language, its share of the letters, and the labelled spans."""
    return docs.withColumn("__lid", label_column(docs.sparkSession, F.col("text").cast("string"), train(docs), spans))


def predicted(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    out = with_languages(docs.select("doc_id", "text", "lang"), spans=False)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("__lid.lang").alias("lang_pred"), F.col("__lid.score").alias("score"))


def with_a_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs of which one language has at least `least` of the letters, with all their columns."""
    out = with_languages(docs, spans=False)
    return out.filter((F.col("__lid.lang") != "und") & (F.col("__lid.score") >= least)).drop("__lid")
