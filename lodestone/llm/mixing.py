"""Mixing sources to target weights by iterative proportional fitting.

Rows are counted into cells of source, language and topic; the cells' token weights are raked to target
marginals (weights that the caller gives, or each category's tokens to a power, so small categories gain), and each
row is taken with a probability calibrated so that the expected tokens of the sample are the wanted share: p = min(1, k *
raked / own tokens of the cell), where k makes up for the cells whose probability is 1. A row's chance
is decided by a hash of its doc_id, so a lost task decides the same again.

Topics are the nearest of `TOPICS` centroids of hashed word counts, fitted by spherical k-means on all rows
that have a word. Profiles and centres are whole numbers, so sums and products are exact and the fit is the
same in every run, however the rows are partitioned. At most `SMALL` cells are raked on the driver and broadcast
to the rows; beyond that they stay distributed and are joined by cell and salt.

Defined cases: a null source or language is a category of its own; null and empty texts have 0 words
and weigh 1 token, like their end; rows that repeat a doc_id share its chance; no rows give no rows;
inputs keep all their columns (only names that start with __mix_ are taken).
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import hash_words, lean_workers, lookup, materialise, text_slices, uniform

TOPICS, WIDTH, STEPS = 8, 64, 10
#: The length of profiles and centres, whose numbers are rounded to whole ones.
LENGTH = 1 << 14
DIMS = ("source", "lang", "topic")
#: The target of a category is its tokens to this power, scaled to all tokens.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
#: A sweep adjusts every dimension once; the last is reached only by targets that the cells can't meet or hardly can.
TOLERANCE, SWEEPS = 1e-6, 160
#: Cells that the driver takes (some 10 MB); more are raked on the executors.
SMALL = 100_000
KEYS = [f"__mix_{d}" for d in DIMS]
#: A power, or weights by category (None: no category given).
Goal = float | Mapping[str | None, float]


def _profiles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of `LENGTH` of hashed word counts (square roots, so frequent words don't outweigh all), and the words."""
    h, n = hash_words([t.lower().encode("utf-8", "surrogatepass") for t in texts])
    row = np.repeat(np.arange(len(texts)), n)
    x = np.bincount(row * WIDTH + (h >> np.uint64(58)).astype(np.int64), minlength=len(texts) * WIDTH).reshape(-1, WIDTH)
    return np.rint(LENGTH * np.sqrt(x / np.maximum(1, n)[:, None])), n


def _centre(total: np.ndarray) -> np.ndarray:
    """The vector of `LENGTH` in the direction of a sum of profiles."""
    total = [int(v) for v in total]
    length = math.isqrt(sum(v * v for v in total))
    return np.array([(2 * LENGTH * v + length) // (2 * length) for v in total], np.float64)


def _topic_column(text: Column, centres: np.ndarray | None) -> Column:
    """struct<topic, n_tokens>, or the profile itself as 16-bit numbers (null without a word) if there are no centres yet."""
    if centres is None:

        @F.arrow_udf("binary")
        def profile(col: pa.Array) -> pa.Array:
            parts = (_profiles([t for _, t in part]) for part in text_slices(col))
            return pa.array([v.tobytes() if k else None for x, n in parts for v, k in zip(x.astype("<i2"), n, strict=True)], pa.binary())

        return profile(text)

    @F.arrow_udf("struct<topic: int, n_tokens: bigint>")
    def topic(col: pa.Array) -> pa.Array:
        topics, tokens = [], []
        for part in text_slices(col):
            x, n = _profiles([t for _, t in part])
            topics.append((x @ centres.T).argmax(1) if len(centres) else np.zeros(len(n), np.int64))
            tokens.append(n)
        cat = lambda a, k: pa.array(np.concatenate(a).astype(k) if a else np.empty(0, k))
        return pa.StructArray.from_arrays([cat(topics, np.int32), cat(tokens, np.int64)], names=["topic", "n_tokens"])

    return topic(text)


def _vectors(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<i2").reshape(-1, WIDTH).astype(np.float64)


def _next_start(x: DataFrame, centres: np.ndarray) -> np.ndarray | None:
    """A profile drawn with a chance that grows with its squared distance from the centres: that of the least
    u / distance over all rows, the smaller profile on ties. None if no row is away from all centres."""

    def least(batches):
        best = None
        for b in batches:
            v, u = _vectors(b["v"]), b["u"].to_numpy()
            far = 2.0 * (LENGTH * LENGTH - ((v @ centres.T).max(1) if len(centres) else 0)) + np.zeros(len(v))
            far[(v[:, None] == centres).all(2).any(1)] = 0
            ok = np.flatnonzero(far > 0)
            if len(ok):
                race = u[ok] / far[ok]
                low = race.min()
                best = min([(low, b["v"][int(i)].as_py()) for i in ok[race == low]] + ([best] if best else []))
        if best:
            yield pa.RecordBatch.from_pydict({"race": [best[0]], "v": [best[1]]}, pa.schema([("race", pa.float64()), ("v", pa.binary())]))

    got = x.mapInArrow(least, "race double, v binary").agg(F.min(F.struct("race", "v"))["v"]).first()[0]
    return None if got is None else np.frombuffer(got, "<i2").astype(np.float64)


def _sums(x: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The sum of the profiles nearest to each centre, over all rows."""

    def added(batches):
        out = np.zeros(centres.shape, np.int64)
        for b in batches:
            v = _vectors(b["v"])
            near = (v @ centres.T).argmax(1)
            for k in range(len(centres)):
                out[k] += v[near == k].sum(0).astype(np.int64)
        i, j = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(out[i, j])], names=["i", "j", "s"])

    out = np.zeros(centres.shape, object)
    for i, j, total in x.mapInArrow(added, "i int, j int, s long").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)"))).collect():
        out[i, j] = int(total)
    return out


def fit_topics(docs: DataFrame, topics: int = TOPICS, seed: int = 23) -> np.ndarray:
    """Centres of topics, from the profiles of all rows that have a word."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    x = docs.select(_topic_column(F.col("text").cast("string"), None).alias("v"), key.alias("key"))
    x = materialise(x).filter(F.col("v").isNotNull())  # a filter below the table would have the profiles computed twice
    centres = np.empty((0, WIDTH))
    for k in range(topics):
        drawn = x.select("v", uniform(F.concat("key", F.lit("\x01"), F.hex("v")), seed + k).alias("u"))
        start = _next_start(drawn, centres)
        if start is None:
            break
        centres = np.vstack([centres, start])
    for _ in range(STEPS if len(centres) else 0):
        new = np.array([_centre(t) if any(t) else c for t, c in zip(_sums(x.select("v"), centres), centres, strict=True)])
        if (new == centres).all():
            break
        centres = new
    return centres


def with_cells(docs: DataFrame, centres: np.ndarray) -> DataFrame:
    """docs with KEYS and __mix_tokens."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    x = docs.withColumn("__mix_t", _topic_column(F.col("text").cast("string"), centres))
    # never null, or a join by it would filter nulls first and so have the topics computed twice
    topic = F.concat(F.lit("="), F.coalesce(F.col("__mix_t.topic").cast("string"), F.lit("")))
    return x.withColumns({KEYS[0]: name("source"), KEYS[1]: name("lang"), KEYS[2]: topic, "__mix_tokens": F.col("__mix_t.n_tokens") + 1}).drop("__mix_t")


def _names(goal: Goal) -> dict[str, float]:
    """A goal given by category, under the names that cells use."""
    return {"" if c is None else f"={c}": float(w) for c, w in goal.items()}


def _rake_small(cells: DataFrame, keys: list[str], goals: list[Goal], tolerance: float) -> tuple[DataFrame, float]:
    """The same in numpy, for at most `SMALL` cells."""
    x = cells.orderBy(*keys).toPandas()
    t = x["t"].to_numpy(np.float64)
    w, codes, wanted = t.copy(), [], []
    for k, a in zip(keys, goals, strict=True):
        code, names = x[k].factorize()
        goal = np.array([_names(a).get(n, 0.0) for n in names]) if isinstance(a, Mapping) else np.bincount(code, t, len(names)) ** a
        if not goal.sum() > 0:
            raise ValueError(f"no category of {k} has a weight")
        codes.append(code)
        wanted.append(goal * (t.sum() / goal.sum()))
    gap = 0.0
    for _ in range(SWEEPS):
        gap = 0.0
        for code, goal in zip(codes, wanted, strict=True):
            now = np.bincount(code, w, len(goal))
            gap = max(gap, float(np.abs(now - goal).max(initial=0, where=goal == 0) / t.sum()), float(np.abs(now / np.where(goal > 0, goal, 1) - 1).max(initial=0, where=goal > 0)))
            w *= np.divide(goal, now, out=np.zeros(len(goal)), where=now > 0)[code]
        if gap <= tolerance:
            break
    x["w"] = w
    return cells.sparkSession.createDataFrame(x), gap


def _rake_large(cells: DataFrame, keys: list[str], goals: list[Goal], tolerance: float) -> tuple[DataFrame, float]:
    """The same over distributed cells: a weight is t times one factor for each key, and only the tables of factors change.

    A step adds up the cells by one key, with partial sums before the shuffle, so no category is summed in one task."""
    total = float(cells.agg(F.sum("t")).first()[0] or 0)
    factors = {}
    for k, a in zip(keys, goals, strict=True):
        x = cells.groupBy(k).agg(F.pow(F.sum("t"), F.lit(1.0 if isinstance(a, Mapping) else a)).alias("x"))
        if isinstance(a, Mapping):
            given = cells.sparkSession.createDataFrame([*_names(a).items()], f"{k} string, given double")
            x = x.join(given, k, "left").select(k, F.coalesce("given", F.lit(0.0)).alias("x"))
        scale = x.agg(F.sum("x")).first()[0]
        if cells.limit(1).count() and not (scale or 0) > 0:
            raise ValueError(f"no category of {k} has a weight")
        factors[k] = materialise(x.select(k, (F.col("x") * (total / (scale or 1.0))).alias("goal"), F.lit(1.0).alias("f")))

    def weighted() -> DataFrame:
        x = cells.withColumn("w", F.col("t").cast("double"))
        for k in keys:
            x = lookup(x, factors[k].select(k, F.col("f").alias("__mix_f")), [k], F.struct(*keys)).withColumn("w", F.col("w") * F.col("__mix_f")).drop("__mix_f")
        return x

    gap = 0.0
    for _ in range(SWEEPS):
        gap = 0.0
        for k in keys:
            now = weighted().groupBy(k).agg(F.sum("w").alias("now"))
            off = F.when(F.col("goal") > 0, F.abs(F.col("now") / F.col("goal") - 1)).otherwise(F.col("now") / (total or 1.0))
            ratio = F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0)
            step = materialise(factors[k].join(now, k).select(k, "goal", (F.col("f") * ratio).alias("f"), off.alias("off")))
            gap = max(gap, step.agg(F.max("off")).first()[0] or 0.0)
            factors[k] = step.drop("off")
        if gap <= tolerance:
            break
    return weighted().select(*keys, "t", "w"), gap


def rake(cells: DataFrame, keys: list[str], goals: list[Goal], tolerance: float = TOLERANCE, small: int | None = None, strict: bool = False) -> tuple[DataFrame, float]:
    """cells (keys, t; materialised) with the raked weight w, and the largest gap between a marginal and its target.

    A goal is a power (the target of a category is its tokens to this power) or the weights of the categories; those that
    are not named get none, those without cells are left out, and the rest is scaled to all tokens. The gap is relative to
    the target (to all tokens where that is 0). Targets that the cells can't meet leave a gap over the tolerance: that is
    an error if strict, else a warning. Few cells are raked on the driver, more of them distributed."""
    small = SMALL if small is None else small
    n = cells.limit(small + 1).count()
    out, gap = (_rake_small if 0 < n <= small else _rake_large)(cells, keys, goals, tolerance)
    if gap > tolerance:
        said = f"raking stopped with a gap of {gap:.3g} after {SWEEPS} sweeps"
        if strict:
            raise RuntimeError(said)
        warnings.warn(said, stacklevel=2)
    return out, gap


def calibrate(cells: DataFrame, share: float) -> float:
    """k such that the sum of t * min(1, k * w / t) is `share` of all t."""
    total = cells.agg(F.sum("t")).first()[0] or 0
    k = 0.0
    for _ in range(100):
        full = F.col("w") * k >= F.col("t")
        free, sure = cells.agg(F.sum(F.when(~full, F.col("w"))), F.sum(F.when(full, F.col("t")))).first()
        if not free:
            break
        new = (share * total - (sure or 0)) / free
        if abs(new - k) <= 1e-12 * max(new, 1e-300):
            break
        k = new
    return k


def chances(docs: DataFrame, share: float, targets: Mapping[str, Goal] | None = None, strict: bool = False) -> tuple[DataFrame, np.ndarray, float]:
    """KEYS and each cell's raked weight, tokens and probability; the centres of the topics; and the gap of the raking."""
    lean_workers(docs.sparkSession)
    centres = fit_topics(docs)
    rows = with_cells(docs.select("doc_id", "text", "source", "lang"), centres)
    cells = materialise(rows.groupBy(*KEYS).agg(F.sum("__mix_tokens").alias("t")))
    raked, gap = rake(cells, KEYS, [{**POWERS, **(targets or {})}[d] for d in DIMS], strict=strict)
    raked = materialise(raked)
    k = calibrate(raked, share)
    chance = F.least(F.lit(1.0), F.lit(k) * F.col("w") / F.col("t"))
    return materialise(raked.select(*KEYS, F.col("t").alias("__mix_cell"), F.col("w").alias("__mix_w"), chance.alias("__mix_p"))), centres, gap


def _joined(docs: DataFrame, share: float, seed: int, targets: Mapping[str, Goal] | None, strict: bool) -> tuple[DataFrame, float]:
    cells, centres, gap = chances(docs, share, targets, strict)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return lookup(with_cells(docs, centres), cells, KEYS, key, SMALL).withColumn("__mix_u", uniform(key, seed)), gap


def mixed(docs: DataFrame, share: float = 0.5, seed: int = 29, targets: Mapping[str, Goal] | None = None, strict: bool = False) -> DataFrame:
    """The query's columns: the cell, tokens, weight, probability and decision of every row of docs, and the raking's gap.

    targets: for `source`, `lang` or `topic` (as text) the weights of its categories, or a power; by default POWERS."""
    x, gap = _joined(docs.select("doc_id", "text", "source", "lang"), share, seed, targets, strict)
    return x.select(
        "doc_id", "source", "lang", F.col(KEYS[2]).substr(2, 9).cast("int").alias("topic"), F.col("__mix_tokens").alias("n_tokens"),
        (F.col("__mix_w") / F.col("__mix_cell")).alias("weight"), F.col("__mix_p").alias("probability"), (F.col("__mix_u") < F.col("__mix_p")).alias("kept"), F.lit(gap).alias("raking_gap"),
    )


def sample(docs: DataFrame, share: float = 0.5, seed: int = 29, targets: Mapping[str, Goal] | None = None, strict: bool = False) -> DataFrame:
    """The rows of docs that the mixture takes, with all their columns."""
    kept = docs.columns
    return _joined(docs, share, seed, targets, strict)[0].filter(F.col("__mix_u") < F.col("__mix_p")).select(*[F.col(f"`{c}`") for c in kept])
