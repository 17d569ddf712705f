"""Structured Streaming forms of the event jobs. Each runs over the files that are there and stops.

State is bounded: windows and keys leave it once the watermark, `late` behind the latest event, has passed them, and jobs once
they are complete or have been silent too long. Rows that come later than that are dropped and counted by the query's progress."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.operators import work
from lodestone.sources.tables import shared_dir, table, written

#: Event types and the stages of a job that they stand for.
STAGES = {"signup": "cloning", "view": "parsing", "click": "embedding", "purchase": "complete", "error": "failed"}
#: Event types and the kinds of requests that they stand for.
KINDS = {"signup": "auth", "view": "chat", "click": "import", "purchase": "oauth"}
LATE = "10 minutes"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream; a table is a file or a folder of files."""
    whole = table(spark, sf_dir, name)
    single = whole.select("_metadata.file_path").head()
    if single is None or single[0].endswith(f"/{name}.parquet"):
        return spark.readStream.schema(whole.schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return spark.readStream.schema(whole.schema).parquet(f"{sf_dir}/{name}.parquet")


def named(column: str, names: dict[str, str]):
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def _with_batch(df: DataFrame) -> StructType:
    return StructType([*df.schema.fields, StructField("batch", LongType())])


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Holds settings of the session while a query starts, which keeps them."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def finished(result: DataFrame, mode: str, keys: list[str] | None = None, conf: dict[str, str] | None = None) -> DataFrame:
    """Runs a stream to its end and rereads what it wrote: every batch, or with keys the latest row of each key.

    A batch that runs again after a failure overwrites its own folder, so no row comes twice."""
    path = f"{shared_dir(result.sparkSession)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    with settings(result.sparkSession, conf or {}):
        q = result.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = written(result.sparkSession, f"{path}/out", _with_batch(result))
    if keys:
        rest = [c for c in result.columns if c not in keys]
        out = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__last")).select(*keys, "__last.*")
    return out.select(*result.columns)


#: The window of the quota stream's state, of which every window of a limit is made.
QUOTA_STEP = "15 minutes"


def quota_stream(spark: SparkSession, sf_dir: str, late: str = LATE) -> DataFrame:
    """(key, kind, window_start, n, n_over): see work.quota_windows. One scan serves all kinds: the stream counts by the step that all windows
    are made of, so its state is one row for each key, kind and open step; the steps of a window are added where they are read."""
    x = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), named("event_type", KINDS).alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    steps = x.filter(F.col("kind").isin(*work.LIMITS)).withWatermark("ts", late).groupBy("key", "kind", F.window("ts", QUOTA_STEP).alias("w")).agg(F.count("*").alias("n"))
    done = finished(steps.select("key", "kind", F.col("w.start").alias("ts"), "n"), "update", ["key", "kind", "ts"])
    return work.quota_sums(done)


JOB = "job_id long, event_id long, stage string, ts timestamp, attempts int, failure string, claimed_ms long"
_STATE = "event_id long, stage string, ts timestamp, attempts int, failure string, claims int"


def _follow(silence_ms: int, attempts: int):
    """Keeps the latest event of a job; a timer fires once the watermark is `silence_ms` past it, and claims the job."""

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        now = state.get if state.exists else None
        if state.hasTimedOut:
            event_id, stage, ts, tried, failure, claims = now
            out.append((key[0], event_id, stage, ts, tried + 1, failure, state.getCurrentWatermarkMs()))
            if tried + 1 < attempts:
                state.update((event_id, stage, ts, tried + 1, failure, claims + 1))
                state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + silence_ms)
            else:
                state.remove()
        else:
            for df in rows:
                r = df.iloc[np.lexsort((df["event_id"].to_numpy(), df["ts"].to_numpy()))[-1]]  # the latest, ties to the larger event_id
                if now is None or (r.ts, r.event_id) > (pd.Timestamp(now[2]), now[0]):
                    now = (int(r.event_id), r.stage, r.ts, int(r.attempts), r.failure, 0)
            event_id, stage, ts, tried, failure, _ = now
            out.append((key[0], event_id, stage, ts, tried, failure, -1))  # not a claim
            waits = (stage in work.UNDER_WAY or (stage == work.FAILED and failure == "retryable")) and tried < attempts
            if waits:
                state.update(now)
                state.setTimeoutTimestamp(max(int(pd.Timestamp(ts).timestamp() * 1000) + silence_ms, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["job_id", "event_id", "stage", "ts", "attempts", "failure", "claimed_ms"])

    return run


def _jobs(spark: SparkSession, sf_dir: str, minutes: int, attempts: int, late: str) -> DataFrame:
    failure = F.when(F.col("event_id") % 3 == 0, "permanent").otherwise("retryable")
    x = read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", named("event_type", STAGES).alias("stage"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 4).cast("int").alias("attempts"), failure.alias("failure"))
    keyed = x.withWatermark("ts", late).groupBy("job_id")
    return keyed.applyInPandasWithState(_follow(minutes * 60_000, attempts), JOB, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def job_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, event_id, stage): the latest stage of each job, ties to the larger event_id. The state holds the jobs under way and
    those that may be tried again; a complete job leaves it, and what comes of it later begins anew, as do its results here."""
    states = finished(_jobs(spark, sf_dir, 10, 3, LATE), "update").filter("claimed_ms < 0")
    return work.latest(states, "job_id").select("job_id", "event_id", "stage")


def stale_job_stream(spark: SparkSession, sf_dir: str, minutes: int = 10, attempts: int = 3) -> DataFrame:
    """(job_id, event_id, stage, ts): the jobs that the timers of the stream claimed, each with the event it was last heard of.

    A timer claims a job that is under way, or failed for a reason that may pass, and has attempts left, once the watermark is
    `minutes` past its last event. A claim counts as an attempt and sets the next timer; an event of the job, such as a
    heartbeat, sets it back. A job that uses up its attempts leaves the state."""
    claims = finished(_jobs(spark, sf_dir, minutes, attempts, LATE), "update").filter("claimed_ms >= 0")
    return claims.select("job_id", "event_id", "stage", F.col("ts").cast("timestamp_ntz").alias("ts")).distinct()


#: Keeps keyed state in a store that reads only the keys of a batch, and writes only what a batch changes.
KEYED = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def first_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A stream's first row of each key, which its state holds for good; run it with the settings KEYED.

    Keys are hash-partitioned over the stores of executors, on disk; a batch looks up its own keys, so its work doesn't grow with what came
    before. Null keys are keys like others."""
    return rows.dropDuplicates(keys)


def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repository_id, content_hash): each distinct content of a repository once, whichever batch it comes in first."""
    key = ["repository_id", "content_hash"]
    new = read(spark, sf_dir, "documents").select(F.col("source").alias("repository_id"), F.sha2("text", 256).alias("content_hash"))
    return finished(first_of_each(new, key), "append", conf=KEYED)


#: Elements of the lists of a state: the events, or tokens, that a key got at once, as one value.
_EVENTS = "seq array<long>, at array<long>, kind array<int>, text array<string>"
_TOKENS = "seq array<long>, text array<string>"
ANSWER = "answer_id long, session_start timestamp_ntz, n_tokens long, n_chars long, state string, text string"
TOKEN, DONE, ERROR = 0, 1, 2


def _packed(rows: list[tuple]) -> tuple:
    return tuple(map(list, zip(*rows, strict=True)))


def _unpacked(values: Iterator[tuple]) -> list[tuple]:
    return [r for v in values for r in zip(*v, strict=True)]


class AnswerProcessor(StatefulProcessor):
    """Assembles answers from their events (answer_id, seq, at in microseconds, kind, text).

    Events wait in a list until the watermark has passed them, so their order is that of their times, then seq, however they arrive. Those that it
    has passed go to the open answer: its tokens are another list, and its bounds a value. A done or error event closes it, as does a
    pause of `gap_ms` without events; what follows opens the next. Timers fire for the first event that waits and for the end of the pause."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EVENTS)
        self.tokens = handle.getListState("tokens", _TOKENS)
        self.open = handle.getValueState("open", "start long, last long")

    def _timers(self, waiting: list[tuple], open_: tuple | None, watermark: int) -> None:
        """One timer: for the earliest of what may happen next."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        times = [min(e[1] for e in waiting) // 1000 + 1] if waiting else []
        if open_:
            times.append((open_[1] + self.gap) // 1000 + 1)
        if times:
            self.handle.registerTimer(max(min(times), watermark + 1))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        return self._passed(key, timerValues.getCurrentWatermarkInMs(), [(r.seq, r.at, r.kind, r.text) for r in rows])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        return self._passed(key, timerValues.getCurrentWatermarkInMs(), [])

    def _passed(self, key: tuple, watermark: int, arrived: list[tuple]) -> Iterator[Row]:
        """Takes the events that the watermark has passed. Each access to the state is a call to the JVM, so it is read once before them and
        written once after them, however many there are; each value of a list is serialised by itself, so events go together in one."""
        now = watermark * 1000
        waiting = _unpacked(self.waiting.get()) + arrived
        due = sorted((e for e in waiting if e[1] <= now), key=lambda e: (e[1], e[0]))
        waiting = [e for e in waiting if e[1] > now]
        before = tuple(self.open.get()) if self.open.exists() else None
        open_, held, new, out = before, before is not None, [], []  # held: tokens of the open answer may be in the state

        def end(state: str) -> None:
            nonlocal open_, held, new
            texts = [t for _, t in sorted(_unpacked(self.tokens.get()) + new if held else new)]
            start = datetime(1970, 1, 1) + timedelta(microseconds=open_[0])
            out.append(Row(answer_id=key[0], session_start=start, n_tokens=len(texts), n_chars=sum(map(len, texts)), state=state, text="".join(texts)))
            open_, held, new = None, False, []

        for seq, at, kind, text in due:
            if open_ and at - open_[1] >= self.gap:
                end("open")
            open_ = (open_[0] if open_ else at, at)
            if kind == TOKEN:
                new.append((seq, text))
            else:
                end("error" if kind == ERROR else "done")
        if open_ and open_[1] + self.gap <= now:
            end("open")
        if before and not held:
            self.tokens.clear()
        if new:
            self.tokens.appendValue(_packed(new))
        if open_ and open_ != before:
            self.open.update(open_)
        elif before and not open_:
            self.open.clear()
        if due:
            self.waiting.put([_packed(waiting)]) if waiting else self.waiting.clear()
        elif arrived:
            self.waiting.appendValue(_packed(arrived))
        self._timers(waiting, open_, watermark)
        return iter(out)

    def close(self) -> None:
        pass


def answers_of(events: DataFrame, late: str = LATE, gap_minutes: int = 30) -> DataFrame:
    """ANSWER of a stream of (answer_id, seq, kind, text, ts): each answer once it is closed by a done or error event (kind 1 or 2), or by a gap
    without events; tokens (kind 0) that come after that are those of a new answer. The text is joined in the order of seq."""
    x = events.withWatermark("ts", late).select("answer_id", "seq", F.unix_micros("ts").alias("at"), "kind", F.coalesce("text", F.lit("")).alias("text"), "ts")
    return x.groupBy("answer_id").transformWithState(AnswerProcessor(gap_minutes * 60_000), ANSWER, "append", "eventTime")


def token_stream(spark: SparkSession, sf_dir: str, late: str = LATE, gap_minutes: int = 30) -> DataFrame:
    """ANSWER of the events of users, which stand for those of an answer: signup for done, error for error, all others for tokens, whose text is their type."""
    kind = F.when(F.col("event_type") == "error", ERROR).when(F.col("event_type") == "signup", DONE).otherwise(TOKEN)
    x = read(spark, sf_dir, "events").select(F.col("user_id").alias("answer_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_type").alias("text"), F.col("ts").cast("timestamp").alias("ts"))
    return finished(answers_of(x, late, gap_minutes), "append", conf=KEYED)
