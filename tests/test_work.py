import datetime as dt
import os
import time

import numpy as np
import pytest
from lodestone.functions import scalars
from lodestone.operators import chunking, repositories, work
from lodestone.sources import trees
from lodestone.sources.tables import release, scope, stage
from lodestone.streaming import jobs
from pyspark.sql import Row
from pyspark.sql import functions as F


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 10, 0) + dt.timedelta(minutes=minute, seconds=second)


def test_stale_jobs(spark):
    rows = [
        (1, 1, at(0), "parsing", 0, None), (2, 2, at(55), "parsing", 0, None), (3, 3, at(0), "cloning", 3, None), (4, 4, at(0), "complete", 0, None), (5, 5, at(0), "failed", 0, "permanent"),
        (6, 6, at(1), "failed", 2, "retryable"), (7, 7, at(50), "failed", 0, "retryable"), (8, 8, at(0), "queued", 0, None), (9, 9, at(0), "failed", 0, None),
    ]
    x = spark.createDataFrame(rows, "job_id int, event_id int, ts timestamp_ntz, stage string, attempts int, failure string")
    now = spark.createDataFrame([(at(60),)], "now timestamp_ntz")
    assert [(r["job_id"], r["attempts"]) for r in work.claimed(x, now).collect()] == [(1, 1), (6, 3)]
    assert [r["job_id"] for r in work.claimed(x, now, most=1).collect()] == [1]
    assert work.latest(x.unionAll(x.withColumn("ts", F.lit(at(99)))), "job_id").filter(F.col("ts") == F.lit(at(99))).count() == 9
    assert {r[0]: r[1] for r in x.select("stage", work.progress(F.col("stage"))).collect()} == {"parsing": 20, "cloning": 5, "complete": 100, "failed": 0, "queued": None}


def test_quotas(spark):
    rows = [(1, at(i), i, "auth") for i in range(7)] + [(1, at(15 + i), 100 + i, "auth") for i in range(2)] + [(1, at(i), 200 + i, "import") for i in range(12)] + [(2, at(1), 300, "chat"), (2, at(1), 301, "other")]
    x = spark.createDataFrame(rows, "key int, ts timestamp_ntz, event_id int, kind string")
    got = {(r["key"], r["kind"], r["window_start"]): (r["n"], r["n_over"]) for r in work.quota_windows(x).collect()}
    assert got == {(1, "auth", at(0)): (7, 2), (1, "auth", at(15)): (2, 0), (1, "import", at(0)): (12, 2), (2, "chat", at(0)): (1, 0)}
    assert {r["event_id"] for r in work.over_limit(x).filter("over_limit").collect()} == {5, 6, 210, 211}


def test_answers_of_streams(spark):
    rows = [(1, 0, at(0), "start", None), (1, 2, at(0, 3), "token", "b [a.ts:1-2]"), (1, 1, at(0, 2), "token", "a "), (1, 3, at(0, 6), "done", None), (2, 1, at(0), "token", "x"), (2, 2, at(0), "error", None), (2, 3, at(0), "done", None), (3, 0, at(0), "start", None)]
    x = spark.createDataFrame(rows, "answer_id int, seq int, ts timestamp_ntz, kind string, text string")
    got = {r["answer_id"]: tuple(r)[1:] for r in work.assembled(x).collect()}
    assert got == {1: (2, "a b [a.ts:1-2]", "done", 2000, 4000, 14, 4, 1), 2: (1, "x", "error", None, 0, 1, None, 0), 3: (0, "", "open", None, None, 0, None, 0)}


def test_purge(spark):
    made = []
    tables = {"repositories": spark.createDataFrame([("a",), ("b",)], "repository_id string"), "chats": spark.createDataFrame([(1, "a"), (2, "b")], "conv_id int, repository_id string"), "messages": spark.createDataFrame([(1, "x"), (2, "y"), (9, "z")], "conv_id int, text string")}
    left = work.purged(tables, spark.createDataFrame([("a",), ("none",)], "repository_id string"), lambda name, df: made.append((name, df.count())))
    assert made == [("messages", 2), ("chats", 1), ("repositories", 1)] and {r["text"] for r in left["messages"].collect()} == {"y", "z"}


def test_trees(spark, tmp_path):
    files = {"src/__init__.py": "x = 1\r\n", "src/_a.PY": "é", ".eslintrc.json": "{}", "node_modules/a.js": "no", ".git/b.py": "no", "src/big.md": "y" * 200, "src/bad.ts": None, "notes.txt": "no", "empty.go": ""}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"\xff\xfe\xff" if text is None else text.encode())
    os.symlink(tmp_path / "src", tmp_path / "link")
    got = trees.scan(spark, {"r": str(tmp_path), "s": str(tmp_path / "src")}, 100)
    mine = {r["path"]: (r["ext"], r["size"], r["content"]) for r in got.filter("repository_id = 'r'").collect()}
    assert mine == {"src/__init__.py": (".py", 7, "x = 1\r\n"), "src/_a.PY": (".py", 2, "é"), ".eslintrc.json": (".json", 2, "{}"), "src/bad.ts": (".ts", 3, "\ufffd" * 3), "empty.go": (".go", 0, "")}
    assert trees.readable(got).count() == 8 and {tuple(r) for r in trees.accepted(got, 3).collect()} == {("r", 5, True), ("s", 3, False)}
    (tmp_path / "q.json").write_text('{"question_id": "1", "repository_id": "r", "text": "why", "expected": "hybrid", "entities": ["a"]}\n')
    q = trees.questions(spark, str(tmp_path / "q.json")).first()
    assert q["entities"] == ["a"] and q["hint"] is None


def test_turn_metrics(spark):
    rows = [(1, 0, at(0), "asked", None), (1, 0, at(0, 4), "retrieved", None), (1, 1, at(0, 5), "start", None), (1, 2, at(0, 6), "token", "see [a.ts:1-2] [a.ts:1-2] [b:3-4]"), (1, 3, at(0, 8), "done", None), (2, 0, at(0), "asked", None), (2, 1, at(1), "token", "x")]
    x = spark.createDataFrame(rows, "answer_id int, seq int, ts timestamp_ntz, kind string, text string")
    assert {tuple(r) for r in work.turn_metrics(x).collect()} == {(1, 4000, 1000, 2000, 33, 17, 2), (2, None, None, 0, 1, None, 0)}


def test_large_trees_are_listed_by_many_tasks(spark, tmp_path, monkeypatch):
    want = set()
    for i in range(40):
        for j in range(5):
            path = f"d{i % 4}/e{i}/" + ("deep/" * (i % 3)) + f"f{j}.py"
            (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / path).write_text(f"{i} {j}")
            want.add(path)
    monkeypatch.setattr(trees, "LISTED", 10)
    tasks = trees.listing(spark, {"r": str(tmp_path)}).select("path", F.input_file_name().alias("f"))
    assert {r["path"] for r in tasks.collect()} == want and tasks.select("f").distinct().count() > 3  # staged by the tasks that listed them
    uri = trees.scan(spark, {"r": f"file://{tmp_path}", "none": str(tmp_path / "d0" / "e0")}, 100)
    assert {r["path"] for r in uri.filter("repository_id = 'r'").collect()} == want and uri.filter("repository_id = 'r' and path = 'd1/e1/deep/f3.py'").first()["content"] == "1 3"
    assert uri.filter("repository_id = 'none'").count() == 5


def test_chunks(spark, tmp_path):
    lines = "\n".join(map(str, range(100)))
    files = spark.createDataFrame([("r", "a", lines, 1), ("r", "b", "x", 2), ("r", "c", " \n ", 3), ("r", "d", None, 4), ("s", "a", "x\n\n \ny\nz", 5)], "repository_id string, path string, content string, n int")
    got = [(r["repository_id"], r["path"], r["start_line"], r["end_line"], r["n"]) for r in chunking.line_windows(files).orderBy("repository_id", "path", "start_line").collect()]
    assert got == [("r", "a", 1, 40, 1), ("r", "a", 36, 75, 1), ("r", "a", 71, 100, 1), ("r", "b", 1, 1, 2), ("s", "a", 1, 5, 5)]
    ranges = spark.createDataFrame([("s", "a", 1, 1), ("s", "a", 4, 4), ("r", "a", 90, 100), ("r", "a", 10, 95)], "repository_id string, path string, start_line int, end_line int")
    assert {tuple(r) for r in chunking.coverage_gaps(ranges, files).collect()} == {("s", "a", 5, 5), ("r", "a", 1, 9), ("r", "b", 1, 1)}
    batch = spark.createDataFrame([("r", "h", 2), ("r", "h", 1), (None, "h", 3), ("r", "i", 4)], "repository_id string, hash string, n int")
    held = spark.createDataFrame([("r", "i")], "repository_id string, hash string")
    assert {tuple(r) for r in chunking.new_chunks(batch, held, ["repository_id", "hash"], ["n"]).collect()} == {("r", "h", 1), (None, "h", 3)}
    assert tuple(chunking.ingest_counts(batch, held, ["repository_id", "hash"], ["n"]).first()) == (2, 2)
    path = str(tmp_path / "saved")
    chunking.save_checkpoint(path, batch.withColumn("commit_sha", F.lit("c")).filter("repository_id is not null"), ["repository_id", "commit_sha"])
    chunking.save_checkpoint(path, batch.withColumns({"repository_id": F.lit("s"), "commit_sha": F.lit("c")}), ["repository_id", "commit_sha"])
    chunking.drop_checkpoint(path, spark.createDataFrame([("r", "c")], "repository_id string, commit_sha string"), ["repository_id", "commit_sha"])
    assert {r["repository_id"] for r in spark.read.parquet(path).collect()} == {"s"}


def test_checkpoints_of_any_key_are_dropped(spark, tmp_path):
    keys, path = ["repository_id", "commit_sha"], str(tmp_path / "saved")
    rows = [("own/repo", "c", "1"), ("r:2", "c", "2"), (None, "c", "3"), ("", "c", "4"), ("a=b %20", "c", "5"), ("stays", "c", "6"), ("own/repo", "other", "7"), ("é#?", None, "8")]
    chunks = spark.createDataFrame(rows, "repository_id string, commit_sha string, chunk string")
    chunking.save_checkpoint(path, chunks, keys)
    left = lambda: {r["chunk"] for r in spark.read.parquet(path).collect()}
    assert chunking.drop_checkpoint(path, chunks.filter("chunk in ('1', '2', '5', '8')"), keys) == 4 and left() == {"3", "4", "6", "7"}
    assert chunking.drop_checkpoint(path, chunks.filter("chunk = '3'"), keys) == 1 and left() == {"6", "7"}  # null and empty keys share a partition
    assert chunking.drop_checkpoint(path, spark.createDataFrame([("never", "c")], "repository_id string, commit_sha string"), keys) == 0 and left() == {"6", "7"}


def test_scalars(spark):
    one = lambda f, *values: spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(f(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]
    kind = lambda t: tuple(one(scalars.question_class, t))
    assert kind("Éwhy does it depend") == ("hybrid", None, None) and kind("whys depend") == ("pure_graph", "direct", None) and kind("éimports é") == ("pure_graph", "direct", None)
    assert kind("what does a import, all of it") == ("pure_graph", "transitive", "outgoing") and kind("from a to b the path") == ("pure_graph", "path", None) and kind("pathé from") == ("pure_graph", "path", None)
    assert one(scalars.citations, "see [a/b.ts:1-2] and [a/b.ts:1-2] [c:d:1-2] [x [y:3-4] [z]:5-6]") == ["a/b.ts:1-2", "x [y:3-4"]
    assert one(scalars.normal_url, "https://github.com/A/B.git/") == "https://github.com/a/b.git" and one(scalars.email_key, " A@B.C\n") == "a@b.c"
    assert one(scalars.is_category, "hybrid") and not one(scalars.is_category, "error") and not one(scalars.is_category, None)
    assert one(scalars.symbol_label, "f", "function") == "f (function)" and one(scalars.symbol_label, None, "window") == "window" and one(scalars.location_label, "a.ts", "1", "2") == "a.ts:1-2"
    log = '{"user":{"password":"x","n":1},"token":"top","req":{"headers":{"cookie":"c","z":2},"url":"u"}}'
    assert one(scalars.redacted_fields, log) == '{"req":{"headers":{"cookie":"[Redacted]","z":2},"url":"u"},"token":"top","user":{"n":1,"password":"[Redacted]"}}'
    assert one(scalars.redacted_fields, "no json") == "no json" and one(scalars.redacted_fields, None) is None and one(scalars.redacted_fields, "[1]") == "[1]"
    event = lambda t: one(scalars.stream_event, t)
    assert tuple(event('event: token\ndata: {"token":"hi"}')) == ("token", "hi") == tuple(event('data: {"token":"hi"}')) and tuple(event("event: done\ndata: {}")) == ("done", None)
    assert tuple(event("event: error\ndata: {}")) == ("error", scalars.INTERRUPTED) and event("event: token\ndata: {") is None and event('data: {"token":5}') is None and event("event: done") is None and event(None) is None


def test_staged_tables_are_removed(spark):
    x = stage(spark.range(5))
    folder = x.inputFiles()[0].removeprefix("file:").rpartition("/")[0]
    assert x.count() == 5 and os.path.isdir(folder)
    assert release(spark) > 0 and not os.path.exists(folder) and release(spark) == 0


def test_scopes_remove_only_their_own(spark):
    before = stage(spark.range(3))
    with scope(spark):
        inner = stage(spark.range(4))
        folder = inner.inputFiles()[0].removeprefix("file:").rpartition("/")[0]
        with scope(spark):
            deeper = stage(spark.range(5)).inputFiles()[0].removeprefix("file:")
        assert not os.path.exists(deeper) and inner.count() == 4
        after = stage(spark.range(6))
        release(spark)  # leaves what open scopes have staged
        assert after.count() == 6
    assert not os.path.exists(folder)
    with pytest.raises(Exception, match="exist"):  # removed by release()
        spark.read.parquet(before.inputFiles()[0].rpartition("/")[0]).count()


def test_repositories(spark):
    r = spark.createDataFrame([(1, "o", "https://github.com/a/b", "ready", 1), (2, "o", "x", "parsing", 2), (3, "p", "https://github.com/a/b", "failed", 3)], "repository_id int, owner string, url string, status string, created_at int")
    assert [(x["repository_id"], x["in_progress"], x["place"]) for x in repositories.listing(r).orderBy("repository_id").collect()] == [(1, False, 2), (2, True, 1), (3, False, 1)]
    q = spark.createDataFrame([("o", " HTTPS://github.com/A/B.git"), ("p", "https://github.com/a/b"), ("o", "x")], "owner string, url string")
    assert {(x["owner"], x["url"][:2]): x["found"] for x in repositories.owned(q, r).collect()} == {("o", " H"): True, ("p", "ht"): False, ("o", "x"): False}
    assert repositories.found(r, owner="o", status="ready").count() == 1 and repositories.found(r, repository_id=9).count() == 0 and repositories.found(r, owner=None).count() == 0
    assert repositories.by_owner(r, q.filter("owner = 'p'")).count() == 1


@pytest.fixture
def arrivals(spark, tmp_path):
    """Events of two files, so of at least two batches."""
    e = lambda rows: spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    path = str(tmp_path / "events.parquet")
    e([(4, at(0), 1, "view", 0.0, ""), (5, at(1), 2, "view", 0.0, ""), (8, at(2), 3, "purchase", 0.0, ""), (7, at(2), 4, "error", 0.0, ""), (9, at(0), 5, "error", 0.0, "")]).coalesce(1).write.parquet(path)
    e([(12, at(30), 2, "view", 0.0, ""), (13, at(45), 6, "signup", 0.0, "")]).coalesce(1).write.mode("append").parquet(path)
    return str(tmp_path)


def test_streams(spark, arrivals):
    got = {(r["job_id"], r["event_id"]) for r in jobs.stale_job_stream(spark, arrivals).collect()}
    # 1 is silent since 10:00; 2 since 10:30, and the watermark is 10:35; 3 is complete, 5 failed for good; 4 has no attempts left
    assert got == {(1, 4)}
    states = {r["job_id"]: r["stage"] for r in jobs.job_state_stream(spark, arrivals).collect()}
    assert states == {1: "parsing", 2: "parsing", 3: "complete", 4: "failed", 5: "failed", 6: "cloning"}
    quota = {(r["key"], r["kind"]): r["n"] for r in jobs.quota_stream(spark, arrivals).collect()}
    assert quota == {(1, "chat"): 1, (2, "chat"): 2, (3, "oauth"): 1, (6, "auth"): 1}


def test_answers_close_by_events(spark, tmp_path):
    """Events come late, out of order, after the end, and in several batches; the text follows their numbers."""
    kind = "answer_id long, seq long, kind int, text string, ts timestamp"
    batches = [
        [(1, 2, 0, "b", at(1)), (1, 1, 0, "a", at(0)), (2, 1, 0, "x", at(0)), (3, 1, 2, None, at(2))],
        [(1, 4, 1, None, at(3)), (1, 3, 0, None, at(2)), (2, 2, 0, "y", at(40)), (1, 5, 0, "n", at(4))],
        [(1, 6, 2, "failed", at(6)), (2, 3, 0, "z", at(41)), (4, 1, 0, "q", at(50)), (1, 0, 0, "late", at(5))],
        [(9, 1, 0, "far", at(120))],
    ]
    path = str(tmp_path / "in")
    for rows in batches:
        time.sleep(1.1)  # files are read in the order of their times
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = jobs.finished(jobs.answers_of(stream, "40 minutes"), "append", conf=jobs.KEYED)
    got = {(r["answer_id"], r["session_start"].minute, r["n_tokens"], r["state"], r["text"]) for r in out.collect()}
    # the token after done is that of a new answer; the pause of answer 2 parts it; the others aren't over when the stream ends
    assert got == {(1, 0, 3, "done", "ab"), (1, 4, 2, "error", "laten"), (2, 0, 1, "open", "x"), (2, 40, 2, "open", "yz"), (3, 2, 0, "error", ""), (4, 50, 1, "open", "q")}
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")  # the session is as before


def test_ingest_finds_duplicates_of_old_batches(spark, tmp_path):
    path, kind = str(tmp_path / "in"), "repository_id string, content_hash string"
    batches = [[("r", f"h{i}") for i in range(50)], [("r", "h3"), ("s", "h3"), ("r", None), ("r", "h60"), ("r", "h60")], [("r", None), ("r", "h0")], [("s", "h3"), ("t", "h1")]]
    for rows in batches:
        time.sleep(1.1)
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
    x = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)
    changed = []
    with jobs.settings(spark, jobs.KEYED):
        q = jobs.first_of_each(x, ["repository_id", "content_hash"]).writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    changed = [s["numRowsUpdated"] for p in q.recentProgress for s in p["stateOperators"]]
    new = [{tuple(r) for r in spark.read.schema(kind).parquet(f"{tmp_path}/out/{n}").collect()} for n in range(4)]
    assert len(new[0]) == 50 and new[1:] == [{("s", "h3"), ("r", None), ("r", "h60")}, set(), {("t", "h1")}]
    assert changed[:4] == [50, 3, 0, 1]  # a batch writes only what is new, whatever came before


def test_quantiles(spark, monkeypatch):
    """Whole keys in a task and refined ranges give what numpy gives; one key has most rows."""
    rng = np.random.default_rng(3)
    values = {"hot": rng.normal(size=3000), "ties": rng.integers(0, 3, 700).astype(float), "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "wide": np.array([-1e300, 0.0, 1e-300, 5.0, 1e300] * 30), "inf": np.array([-np.inf] * 40 + [1.0, 2.0, 3.0] * 20 + [np.inf] * 10), "flat": np.full(500, 2.5)}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [(None, 1.0), (None, 4.0), ("null", None), ("hot", None)]
    x = spark.createDataFrame(rows, "k string, v double").repartition(5)
    at = [0.0, 0.5, 0.95, 1.0]
    want = {r["k"]: tuple(r)[1:] for r in x.groupBy("k").agg(F.count("*"), F.min("v"), F.max("v"), *[F.percentile("v", q) for q in at]).collect()}
    for most, ranges in ((100_000, 2048), (20, 4), (1, 3)):
        monkeypatch.setattr(work, "SORTED", most)
        monkeypatch.setattr(work, "RANGES", ranges)
        got = {r["k"]: tuple(r)[1:] for r in work.quantiles(x, "k", "v", at).collect()}
        assert got.keys() == want.keys()
        for k, row in want.items():
            assert all(a == b or abs(a - b) < 1e-12 * max(1, abs(b)) for a, b in zip(got[k], row, strict=True)), (k, got[k], row)
    assert work.quantiles(x.limit(0), "k", "v", at).count() == 0
    assert np.isclose(want["hot"][4], np.quantile(values["hot"], 0.5))


def test_streams_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    for run in (jobs.stale_job_stream, jobs.job_state_stream, jobs.quota_stream, jobs.token_stream, jobs.ingest_stream):
        assert run(spark, str(tmp_path)).collect() == []


class _Calls:
    """The state of one key, which counts how often it is asked for or changed."""

    def __init__(self):
        self.n, self.timers, self.held = 0, set(), {}

    def getListState(self, name, schema):  # noqa: N802
        return _Held(self, name)

    getValueState = getListState  # noqa: N815

    def listTimers(self):  # noqa: N802
        self.n += 1
        return list(self.timers)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.discard(t)

    def registerTimer(self, t):  # noqa: N802
        self.timers.add(t)


class _Held:
    def __init__(self, calls, name):
        self.calls, self.name = calls, name

    def _set(self, v):
        self.calls.n += 1
        self.calls.held[self.name] = v

    def exists(self):
        self.calls.n += 1
        return bool(self.calls.held.get(self.name))

    def get(self):
        self.calls.n += 1
        return self.calls.held.get(self.name) or []

    def clear(self):
        self._set(None)

    update = put = _set

    def appendList(self, v):  # noqa: N802
        self._set([*(self.calls.held.get(self.name) or []), *v])

    def appendValue(self, v):  # noqa: N802
        self.appendList([v])


def test_answers_ask_the_state_a_bounded_number_of_times():
    calls, times = _Calls(), type("T", (), {"getCurrentWatermarkInMs": lambda self: self.ms})()
    p = jobs.AnswerProcessor(60_000)
    p.init(calls)
    times.ms = 0
    rows = [Row(seq=i, at=1_000_000 * i, kind=jobs.DONE if i % 50 == 0 else jobs.TOKEN, text=f"t{i} ") for i in range(1, 121)]
    assert list(p.handleInputRows(("a",), iter(rows), times)) == []
    times.ms = 70_000  # events 1 to 70
    first = list(p.handleExpiredTimer(("a",), times, None))
    times.ms = 1_000_000
    rest = list(p.handleExpiredTimer(("a",), times, None))
    assert [(r.n_tokens, r.state, r.session_start.second + 60 * r.session_start.minute) for r in first + rest] == [(49, "done", 1), (49, "done", 51), (20, "open", 101)]
    assert rest[0].text == "".join(f"t{i} " for i in range(51, 100)) and not any(calls.held.values()) and not calls.timers
    assert calls.n < 40
