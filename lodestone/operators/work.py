"""Jobs, quotas, latencies, answer streams and removal, as batch operators over event tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalars import chars_per_second, citations
from lodestone.sources.tables import stage

#: Stages of a job under way, of one that failed, and the progress of each (fixed values).
UNDER_WAY, FAILED = ("cloning", "parsing", "embedding"), "failed"
PROGRESS = {"cloning": 5, "parsing": 20, "embedding": 60, "complete": 100, "failed": 0}
#: Requests of each kind that are let through, and the length of their window (fixed values); windows begin at multiples of their length.
LIMITS = {"auth": (5, "15 minutes"), "import": (10, "1 hour"), "chat": (30, "1 hour"), "oauth": (10, "1 hour")}


def latest(events: DataFrame, key: str, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")).select(key, "__last.*").select(*events.columns)


def history(events: DataFrame, key: str, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """events with version: 1 for the last of each key, and so on back."""
    return events.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])))


def progress(stage: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, n in PROGRESS.items():
        out = F.when(stage == name, n).otherwise(out)
    return out


def is_stale(now: Column, minutes: int = 10, attempts: int = 3) -> Column:
    """Whether a job (stage, failure, attempts, ts) may be claimed: it is under way, or failed for a reason that may pass, has
    attempts left, and was last heard of more than `minutes` ago."""
    open_ = F.col("stage").isin(*UNDER_WAY) | ((F.col("stage") == FAILED) & (F.col("failure") == "retryable"))
    return open_ & (F.col("attempts") < attempts) & (F.col("ts") < now - F.expr(f"interval {minutes} minutes"))


def claimed(jobs: DataFrame, now: DataFrame, minutes: int = 10, attempts: int = 3, most: int = 1000) -> DataFrame:
    """(job_id, event_id, stage, ts, attempts, claimed_at): the stale jobs that a sweep claims, oldest first and `most` at once, with the attempt counted.

    jobs: the latest row of each job; now: one row (now). A claim is written back as an event of its job, so the next sweep sees it."""
    x = jobs.join(F.broadcast(now)).filter(is_stale(F.col("now"), minutes, attempts))  # one row
    x = x.orderBy("ts", "job_id").limit(most)
    return x.select("job_id", "event_id", "stage", "ts", (F.col("attempts") + 1).alias("attempts"), F.col("now").alias("claimed_at"))


def _floor(ts: str, length: str) -> Column:
    """The start of the window of a time."""
    n, unit = length.split()
    us = int(n) * {"minutes": 60, "hour": 3600}[unit] * 1_000_000
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    return F.timestamp_micros(t - F.pmod(t, F.lit(us))).cast("timestamp_ntz")


def with_windows(requests: DataFrame) -> DataFrame:
    """requests (kind, ts) of known kinds with window_start and limit."""
    start, most = F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("int")
    for name, (n, length) in LIMITS.items():
        start, most = F.when(F.col("kind") == name, _floor("ts", length)).otherwise(start), F.when(F.col("kind") == name, n).otherwise(most)
    return requests.filter(F.col("kind").isin(*LIMITS)).withColumns({"window_start": start, "limit": most})


def quota_windows(requests: DataFrame) -> DataFrame:
    """(key, kind, window_start, n, n_over): the requests of each key, kind and window, and how many of them are over the limit."""
    return quota_sums(requests.withColumn("n", F.lit(1)))


def quota_sums(steps: DataFrame) -> DataFrame:
    """The same of counts n (key, kind, ts, n) that no window parts."""
    x = with_windows(steps).groupBy("key", "kind", "window_start").agg(F.sum("n").cast("long").alias("n"), F.max("limit").alias("limit"))
    return x.select("key", "kind", "window_start", "n", F.greatest(F.col("n") - F.col("limit"), F.lit(0)).alias("n_over"))


def over_limit(requests: DataFrame) -> DataFrame:
    """requests (key, kind, ts, event_id) of known kinds with over_limit: whether the limit was used up before them."""
    w = Window.partitionBy("key", "kind", "window_start").orderBy("ts", "event_id")
    return with_windows(requests).withColumn("over_limit", F.row_number().over(w) > F.col("limit"))


#: Ranges that the values of a key are counted in at once, values of a key that one task sorts, and fewer keys than this have more.
RANGES, SORTED, LARGE = 2048, 100_000, 50_000


def quantiles(rows: DataFrame, key: str, value: str, at: list[float]) -> DataFrame:
    """(key, n, lo, hi, q0, q1, ...): exact quantiles of a value, with linear interpolation between neighbours, as Spark's percentile gives them.

    The values of a key with up to `SORTED` of them, or 1 / `LARGE` of all rows, are sorted in a task. Those of a larger key, of which there are
    fewer than `LARGE`, are never together: they are counted in equal ranges between the key's extremes, and the ranges that hold a wanted
    place are counted anew in finer ones, until each holds few values, which are sorted, or a single one. Null values don't
    count in quantiles; a key with none has null ones; null keys are a key. NaN counts as the largest value."""
    v = stage(rows.select(F.col(key).alias("__k"), F.col(value).cast("double").alias("__v")))
    ends = stage(v.groupBy("__k").agg(F.count("__v").alias("__m"), F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")))
    most = max(SORTED, (ends.agg(F.sum("__m")).first()[0] or 0) // LARGE)
    large = ends.filter(F.col("__m") > most).select(F.col("__k").alias("__j"), "__m", "lo", "hi")
    same = F.col("__k").eqNullSafe(F.col("__j"))
    q = [F.percentile("__v", p).alias(f"q{i}") for i, p in enumerate(at)]
    done = v.join(F.broadcast(large.select("__j")), same, "left_anti").groupBy("__k").agg(*q)
    if not large.isEmpty():
        done = done.unionByName(_refined(v, large, at, most))
    done = done.withColumnRenamed("__k", "__j")
    return ends.join(done, same).select(F.col("__k").alias(key), "n", "lo", "hi", *[f"q{i}" for i in range(len(at))])


def _refined(v: DataFrame, large: DataFrame, at: list[float], most: int) -> DataFrame:
    """(__k, q0, q1, ...) of the large keys (__j, __m, lo, hi); v: staged values (__k, __v)."""
    # the two places around each quantile, each in an open range: values from lo to hi, `below` of them before it, `held` in it
    place = lambda p: F.array(F.floor((F.col("__m") - 1) * F.lit(p)), F.ceil((F.col("__m") - 1) * F.lit(p)))
    places = F.array_distinct(F.flatten(F.array(*map(place, at))))
    ranges = stage(large.select("__j", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("__m").alias("held"), F.explode(places).alias("place")))
    found = []
    inside = F.col("__k").eqNullSafe(F.col("__j")) & F.col("__v").between(F.col("lo"), F.col("hi"))
    while not ranges.isEmpty():
        found.append(ranges.filter("lo = hi").select("__j", "place", F.col("lo").alias("x")))
        few = ranges.filter((F.col("lo") < F.col("hi")) & (F.col("held") <= most))
        mine = v.join(F.broadcast(few.groupBy("__j", "lo", "hi", "below").agg(F.collect_set("place").alias("places"))), inside)  # a few ranges of each large key
        rank = (F.row_number().over(Window.partitionBy("__j", "below").orderBy("__v")) - 1 + F.col("below")).alias("place")
        sorted_ = mine.select("__j", "places", F.col("__v").alias("x"), rank)
        found.append(sorted_.filter(F.array_contains("places", F.col("place"))).select("__j", "place", "x"))
        wide = ranges.filter((F.col("lo") < F.col("hi")) & (F.col("held") > most)).groupBy("__j", "lo", "hi", "below").agg(F.collect_set("place").alias("places"))
        step = F.col("hi") / RANGES - F.col("lo") / RANGES
        r = F.least(F.greatest(F.floor((F.col("__v") - F.col("lo")) / step), F.lit(0)), F.lit(RANGES - 1))
        # the extremes are ranges of their own, so each round has fewer values between them, infinite ones too
        r = F.when(F.col("__v") == F.col("hi"), RANGES).when(F.col("__v") == F.col("lo"), -1).otherwise(r)
        counted = v.join(F.broadcast(wide), inside).select("__j", "below", "places", r.alias("r"), "__v")
        counted = counted.groupBy("__j", "below", "r").agg(F.count("*").alias("held"), F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.first("places").alias("places"))
        before = F.col("below") + F.sum("held").over(Window.partitionBy("__j", "below").orderBy("r")) - F.col("held")  # RANGES + 2 rows at most
        counted = counted.withColumn("below", before).withColumn("place", F.explode("places"))
        ranges = stage(counted.filter((F.col("place") >= F.col("below")) & (F.col("place") < F.col("below") + F.col("held"))).select("__j", "lo", "hi", "below", "held", "place"))
    values = reduce(DataFrame.unionByName, found).groupBy("__j").agg(F.map_from_entries(F.collect_set(F.struct("place", "x"))).alias("x"))
    spot = lambda p: (F.col("__m") - 1) * F.lit(p)
    a, b = (lambda p: F.element_at("x", F.floor(spot(p)))), (lambda p: F.element_at("x", F.ceil(spot(p))))
    q = [F.when(a(p) == b(p), a(p)).otherwise((F.ceil(spot(p)) - spot(p)) * a(p) + (spot(p) - F.floor(spot(p))) * b(p)).alias(f"q{i}") for i, p in enumerate(at)]
    both = large.withColumnRenamed("__j", "__k").join(values, F.col("__k").eqNullSafe(F.col("__j")))
    return both.select("__k", *q)


def latency(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, lo, hi, median, p95) of a value."""
    kind = rows.schema[value].dataType
    x = quantiles(rows, key, value, [0.5, 0.95])
    return x.select(key, "n", F.col("lo").cast(kind).alias("lo"), F.col("hi").cast(kind).alias("hi"), F.round("q0", 6).alias("median"), F.round("q1", 6).alias("p95"))


def assembled(events: DataFrame) -> DataFrame:
    """(answer_id, n_tokens, text, state, first_token_ms, streaming_ms, n_chars, chars_per_second, n_citations) of the events of answers.

    events: answer_id, seq, ts, kind (start, token, done, error), text. The text joins the tokens by seq; the state is error or
    done as the events say, else open; an error counts over a done. Times are null without a start or a token."""
    token = F.col("kind") == "token"
    at = lambda f, c: f(F.when(c, F.unix_micros(F.col("ts").cast("timestamp"))))
    x = events.groupBy("answer_id").agg(
        F.count_if(token).alias("n_tokens"), F.array_sort(F.collect_list(F.when(token, F.struct("seq", "text")))).alias("x"),  # one answer's tokens
        F.max(F.when(F.col("kind") == "error", 2).when(F.col("kind") == "done", 1).otherwise(0)).alias("s"),
        at(F.min, F.col("kind") == "start").alias("begun"), at(F.min, token).alias("first"), at(F.max, F.col("kind") != "start").alias("last"),
    )
    state = F.when(F.col("s") == 2, "error").when(F.col("s") == 1, "done").otherwise("open")
    ms = lambda a, b: F.expr(f"({b} - {a}) div 1000").cast("long")
    x = x.select("answer_id", "n_tokens", F.array_join(F.transform("x", lambda t: t["text"]), "").alias("text"), state.alias("state"), ms("begun", "first").alias("first_token_ms"), ms("first", "last").alias("streaming_ms"))
    n = F.length("text").cast("long")
    return x.withColumns({"n_chars": n, "chars_per_second": chars_per_second(n, F.col("streaming_ms")), "n_citations": F.size(citations(F.col("text")))})


def turn_metrics(events: DataFrame) -> DataFrame:
    """(answer_id, retrieval_ms, first_token_ms, streaming_ms, n_chars, chars_per_second, n_citations) of chat turns.

    events: as of assembled(), with the kinds asked and retrieved besides, between which the context was looked up; null without one of the two."""
    at = lambda kind: F.min(F.when(F.col("kind") == kind, F.unix_micros(F.col("ts").cast("timestamp"))))
    asked = events.groupBy("answer_id").agg(F.floor((at("retrieved") - at("asked")) / 1000).cast("long").alias("retrieval_ms"))
    x = assembled(events.filter(~F.col("kind").isin("asked", "retrieved"))).join(asked, "answer_id")
    return x.select("answer_id", "retrieval_ms", "first_token_ms", "streaming_ms", "n_chars", "chars_per_second", "n_citations")


#: Tables that hang on a repository and the column that names their parent, children first (fixed order).
CASCADE = (("messages", "conv_id", "chats"), ("chats", "repository_id", None), ("jobs", "repository_id", None), ("chunks", "repository_id", None), ("checkpoints", "repository_id", None), ("graphs", "repository_id", None), ("repositories", "repository_id", None))


def purged(tables: dict[str, DataFrame], gone: DataFrame, write: Callable[[str, DataFrame], None] | None = None) -> dict[str, DataFrame]:
    """What is left of each table when repositories (repository_id) go with all that hangs on them; tables that aren't given are passed over.

    write(name, rows) gets each table's rest, children before parents, so a run that fails leaves no child without its parent."""
    left = {}
    for name, key, parent in CASCADE:
        if name in tables:
            lost = gone.select("repository_id").distinct()
            if parent:
                lost = tables[parent].join(lost, "repository_id", "left_semi").select(key).distinct()
            left[name] = tables[name].join(lost, key, "left_anti")
            if write:
                write(name, left[name])
    return left


def unexpired(rows: DataFrame, now: DataFrame, days: int = 30) -> DataFrame:
    """The rows (ts) that haven't expired; now: one row (now)."""
    return rows.join(F.broadcast(now)).filter(F.col("ts") + F.expr(f"interval {days} days") > F.col("now")).drop("now")  # one row
