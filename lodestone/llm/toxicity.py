"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learned from a bounded sample of labelled rows (words that occur in far more toxic than
clean documents), features are computed from whole texts, MLlib's boosted trees learn from the larger
part of the sample and an isotonic regression of their probability from the rest. The sample takes
about `most` rows of each class, chosen by a hash of doc_id; its weights restore the classes' shares.

Defined cases: null and empty texts have features of zero and a score like any other text; rows are
scored one by one, so repeated rows get equal scores; several labels of a doc_id count as their
maximum, null labels as none; without labels of both classes the score is the mean label (0 without
any); inputs keep all their columns, whatever their names (only names that start with __tox_ are taken).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lodestone.llm.common import fold, lean_workers, materialise, uniform

#: Rows of each class in the sample, and words in the lexicon.
MOST, LEXICON = 8_000, 300
#: Words between an insult and a second person, at most.
NEAR = 5
#: Letters of a stem; the lexicon also holds stems, as "stem-".
STEM = 5
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes ti tus vosotros".split())
#: Characters that stand for letters in obfuscated words.
LOOKS_LIKE = str.maketrans("013457@$!*", "oieastasi_")
FEATURES = ("hits", "log_hits", "log_distinct", "worst", "near_you", "you", "capitals", "shouted", "exclaimed", "punctuation", "symbols", "obfuscated", "obfuscated_hits", "stretched")

_WORD = re.compile(r"[^\W_]+")
# each run is tried from its first character only and never given back, so a text is read in linear time
_MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$!*]++[^\W\d_]++)++|(?<![@$!013457])[@$!013457]++[^\W\d_]{2}\S*+")
_STRETCH = re.compile(r"([^\W\d_])\1{3,}")
_SHOUT = re.compile(r"\b[^\W\d_a-z]{3,}\b")


def features_of(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """FEATURES of one text."""
    if not text:
        return [0.0] * len(FEATURES)
    low = text.lower()
    words = _WORD.findall(low)
    n, chars = max(1, len(words)), len(text)
    kinds = set(words)
    found = {w for w in kinds if w in lexicon or w[:STEM] + "-" in lexicon}
    hits, near, worst = 0, 0, 0.0
    you = kinds & SECOND_PERSON
    n_you = sum(w in you for w in words) if you else 0
    if found:
        at = [i for i, w in enumerate(words) if w in found]
        hits, worst = len(at), max(max(lexicon.get(w, 0.0), lexicon.get(w[:STEM] + "-", 0.0)) for w in found)
        if you:
            persons = np.array([i for i, w in enumerate(words) if w in you])
            a = np.array(at)
            j = np.searchsorted(persons, a - NEAR)
            near = int(((j < len(persons)) & (persons[np.minimum(j, len(persons) - 1)] <= a + NEAR)).sum())
    masked = _MASKED.findall(low) if any(c in low for c in "013457@$!*") else []
    hidden = 0
    for w, times in Counter(masked).items():
        plain = w.translate(LOOKS_LIKE).strip(".,;:?\"'()_")
        if plain in lexicon or ("*" in w and any(_same(plain, x) for x in lexicon)):
            hidden += times
    raw = text.encode("utf-8", "surrogatepass")
    count = lambda s: len(raw) - len(raw.translate(None, s))
    letters = sum(map(len, words)) or 1
    capitals = chars - sum(map(len, re.split("[A-Z]", text))) if chars < 64 else count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return [
        hits / n, float(np.log1p(hits)), float(np.log1p(len(found))), worst, near / n, n_you / n,
        capitals / letters, len(_SHOUT.findall(text)) / n, count(b"!?") / n, count(b".,;:'\"()-") / chars,
        count(b"#*$%&|<>@^~") / chars, len(masked) / n, float(np.log1p(hidden)), len(_STRETCH.findall(low)) / n,
    ]


def _same(masked: str, word: str) -> bool:
    """Whether a word in which _ stands for any letter can be `word`."""
    return len(masked) == len(word) and "_" in masked and all(a in ("_", b) for a, b in zip(masked, word, strict=True)) and sum(a != "_" for a in masked) * 2 >= len(word)


def feature_column(text: Column, lexicon: dict[str, float]) -> Column:
    @F.arrow_udf(ArrayType(DoubleType(), False))
    def features(col: pa.Array) -> pa.Array:
        rows = [features_of(t.as_py(), lexicon) for t in col]
        flat = pa.array([x for r in rows for x in r], pa.float64())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)), flat)

    return features(text)


def learn_lexicon(sample: DataFrame, size: int) -> dict[str, float]:
    """word -> log odds of the documents with it, for the words that mark toxic documents most."""

    def counted(batches):
        counts: dict[str, list[int]] = {}
        for b in batches:
            for text, y in zip(b["text"], b["__tox_y"], strict=True):
                words = set(_WORD.findall((text.as_py() or "").lower()))
                for w in words | {w[:STEM] + "-" for w in words if len(w) > STEM}:
                    counts.setdefault(w, [0, 0])[y.as_py()] += 1
        yield pa.RecordBatch.from_pydict({"word": [*counts], "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]}, pa.schema([("word", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())]))

    n = {r["__tox_y"]: r["count"] for r in sample.groupBy("__tox_y").count().collect()}
    words = sample.select("text", "__tox_y").mapInArrow(counted, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / n[1]) - F.log((F.col("clean") + 0.5) / n[0])
    least = max(3, n[1] // 200)
    # the odds must be high beyond chance: many words are tried
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    marked = words.filter(F.col("toxic") >= least).withColumn("odds", odds).filter((F.col("odds") >= 2.0) & (F.col("odds") - 2.5 * error >= 0.7))
    return {r["word"]: r["odds"] for r in marked.orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "word").limit(size).collect()}


@dataclass
class Model:
    """What was learned; `trees` is None if there was nothing to learn from."""

    lexicon: dict[str, float]
    trees: Any
    calibration: Any
    mean: float

    def add_score(self, docs: DataFrame) -> DataFrame:
        """docs with __tox_score, a double from 0 to 1."""
        if self.trees is None:
            return docs.withColumn("__tox_score", F.lit(self.mean))
        kept = docs.columns
        x = docs.withColumn("__tox_features", array_to_vector(feature_column(F.col("text"), self.lexicon)))
        x = self.trees.transform(x).withColumn("__tox_raw_p", vector_to_array("__tox_p").getItem(1))
        x = self.calibration.transform(x)
        return x.select(*[F.col(f"`{c}`") for c in kept], F.least(F.greatest(F.col("__tox_calibrated"), F.lit(0.0)), F.lit(1.0)).alias("__tox_score"))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST, lexicon_size: int = LEXICON, trees: int = 20, depth: int = 3, seed: int = 5) -> Model:
    """Learns from the documents whose crc32(doc_id as text) mod 5 is not 0."""
    lean_workers(docs.sparkSession)
    y = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("__tox_y"))
    y = y.filter(F.col("__tox_y").isin(0, 1))
    n = {r["__tox_y"]: r["count"] for r in y.groupBy("__tox_y").count().collect()}
    mean = n.get(1, 0) / max(1, sum(n.values()))
    if len(n) < 2:
        return Model({}, None, None, mean)
    share = {k: min(1.0, most / v) for k, v in n.items()}
    wanted = F.when(F.col("__tox_y") == 1, share[1]).otherwise(share[0])
    y = y.filter(uniform(F.col("doc_id"), seed) < wanted).withColumn("__tox_w", 1 / wanted)
    # at most about 2 * `most` rows of 20 bytes
    sample = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")
    sample = materialise(sample)
    both = {r["__tox_y"] for r in sample.select("__tox_y").distinct().collect()}
    if len(both) < 2:
        return Model({}, None, None, mean)
    lexicon = learn_lexicon(sample, lexicon_size)
    x = materialise(sample.select("doc_id", "__tox_w", F.col("__tox_y").cast("double").alias("__tox_y"), feature_column(F.col("text"), lexicon).alias("f")))
    x = x.select("*", array_to_vector("f").alias("__tox_features")).drop("f")
    later = uniform(F.col("doc_id"), seed + 1) < 0.3
    fit = GBTClassifier(featuresCol="__tox_features", labelCol="__tox_y", weightCol="__tox_w", predictionCol="__tox_class", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed)
    fit = fit.setProbabilityCol("__tox_p").setRawPredictionCol("__tox_raw")
    parts = [x.filter(~later), x.filter(later)]
    if any(len(p.select("__tox_y").distinct().head(2)) < 2 for p in parts):
        parts = [x, x]  # too few rows to keep some back
    learned = parts[0].coalesce(4).persist()
    model = fit.fit(learned)
    learned.unpersist()
    p = model.transform(parts[1]).select("__tox_y", "__tox_w", vector_to_array("__tox_p").getItem(1).alias("__tox_raw_p"))
    iso = IsotonicRegression(featuresCol="__tox_raw_p", labelCol="__tox_y", weightCol="__tox_w", predictionCol="__tox_calibrated")
    return Model(lexicon, model, iso.fit(p), mean)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns."""
    out = train(docs, labels).add_score(docs.select("doc_id", "text"))
    score = F.col("__tox_score")
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """The rows of docs that score under `most`, with all their columns."""
    return train(docs, labels).add_score(docs).filter(F.col("__tox_score") < most).drop("__tox_score")
