import random
import pytest
from lodestone.functions import scalars
from lodestone.operators import answers, chunking, evaluation, retrieval
from pyspark.sql import functions as F

EDGES = [("r", "a", "b"), ("r", "b", "c"), ("r", "c", "d"), ("r", "a", "d"), ("r", "x", "y"), ("s", "a", "z"), ("s", "z", "a"), ("s", "z", "z")]
KIND = "repository_id string, source string, target string"


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, KIND)


def test_answers(spark, edges):
    rows = [
        ("r", 1, "What does it depend on?", "a", None), ("r", 2, "What imports it?", "d", None), ("r", 3, "its dependencies", "b", None), ("r", 4, "all its dependencies", "c", None), ("r", 5, "who imports it indirectly", "d", None),
        ("r", 6, "path from here to there", "b", "d"), ("r", 7, "path from here to there", "d", "a"), ("r", 8, "path from here to there", "d", "d"), ("r", 9, "what does it import", "none", None), ("r", 10, "is there a cycle", None, None), ("r", 11, "why", "b", "d"), ("r", 12, None, "a", "b"),
        ("s", 13, "What does it depend on?", "a", None), ("s", 14, "cycles?", None, None), ("t", 15, "What does it depend on?", "a", None), ("s", 16, "why", "b", "d"), ("s", 17, "why", None, None),
    ]
    q = spark.createDataFrame(rows, "repository_id string, question_id int, text string, node string, target string")
    got = {}
    for r in answers.answer_rows(q, edges).orderBy("question_id", "position", "node").collect():
        got.setdefault(r["question_id"], []).append(r["node"])
    assert got == {1: ["b", "d"], 2: ["a", "c"], 3: ["a", "c"], 4: ["a", "b", "d"], 5: ["a", "b", "c"], 6: ["b", "c", "d"], 8: ["d"], 13: ["z"]}
    s = {r["question_id"]: (r["category"], r["algorithm"], r["found"]) for r in answers.answer_summary(q, edges).collect()}
    assert s[7] == ("pure_graph", "dependency-analysis", 0) and s[10] == ("intelligence", "cycle-detection", 0) and s[14] == ("intelligence", "cycle-detection", 1) and s[11] == s[12] == ("hybrid", None, None) and s[15][2] == 0
    names = spark.createDataFrame([("r", "b", "Bee"), ("s", "a", "Ay"), ("r", "d", "Dee")], "repository_id string, node string, label string")
    texts = {r["question_id"]: r["answer"] for r in answers.answer_texts(q, edges, names).collect()}
    assert texts[6] == "Bee → c → Dee" and texts[7] == answers.NO_PATH and texts[8] == "Dee" and texts[1] == "Bee, Dee" and texts[9] == texts[15] == answers.NONE_FOUND
    assert texts[10] == "No circular dependencies found in this repository." and texts[14] == "1 circular dependency found:\nAy → z" and 11 not in texts and 12 not in texts
    two = spark.range(1).select(answers.cycle_text(F.lit(2), F.lit("x\ny")).alias("t")).first()["t"]
    assert two == "2 circular dependencies found:\nx\ny"
    facts = answers.graph_facts(q, edges)
    assert {(r["question_id"], r["fact"], r["position"], r["node"]) for r in facts.collect()} == {(11, "neighbours", None, "a"), (11, "neighbours", None, "c"), (11, "path", 0, "b"), (11, "path", 1, "c"), (11, "path", 2, "d"), (12, "neighbours", None, "b"), (12, "neighbours", None, "d"), (12, "path", 0, "a"), (12, "path", 1, "b")}
    lines = {r["question_id"]: r["lines"] for r in answers.fact_lines(q, facts).collect()}
    assert lines[11] == "Direct dependencies/dependents of b: a, c\nDependency path from b to d: b, c, d" and lines[16] == "Direct dependencies/dependents of b: (none found)\nDependency path from b to d: (none found)" and 17 not in lines
    key = ["repository_id", "question_id"]
    blocks = spark.createDataFrame([("r", 11, 1, "a.ts:1-2", "function", "x")], "repository_id string, question_id int, rank int, location string, label string, content string")
    prompts = {r["question_id"]: r["prompt"] for r in retrieval.hybrid_prompts(q.filter("question_id in (11, 16, 17)"), blocks, answers.fact_lines(q, facts), key, "<", ">").collect()}
    plain = {r["question_id"]: r["prompt"] for r in retrieval.system_prompts(q.filter("question_id in (11, 16, 17)"), blocks, key).collect()}
    assert prompts[11] == f"<\n{lines[11]}\n\n>\n\n{plain[11]}" and prompts[17] == plain[17] == retrieval.REFUSAL and prompts[16].endswith(retrieval.REFUSAL)
    assert answers.answer_rows(q.limit(0), edges).count() == 0 and answers.answer_rows(q, edges.limit(0)).select("question_id").distinct().count() == 1


def test_evaluation_run(spark, edges, tmp_path):
    kind = "question_id int, repository_id string, text string, expected string, hint string, entities array<string>"
    rows = [(1, "r", "what does it import", "pure_graph", "A.ts", ["b.ts", "zz"]), (2, "r", "why", "hybrid", None, ["One"]), (3, "r", "why", "hybrid", "a", ["one"]), (4, "t", "cycle?", "intelligence", None, ["x"]), (5, "s", "cycles", "hybrid", None, None), (6, "r", "what does it import", "pure_graph", "nowhere", None)]
    q = spark.createDataFrame(rows, kind)
    states = spark.createDataFrame([("r", "ready"), ("s", "ready"), ("t", "failed")], "repository_id string, status string")
    nodes = spark.createDataFrame([(r, i, "file", n, f"{n}.ts") for r in "rs" for i, n in enumerate("abcdz")], "repository_id string, ordinal int, type string, id string, label string")
    labels = nodes.select("repository_id", F.col("id").alias("node"), "label")
    told = spark.createDataFrame([("r", 2, "that is one"), ("r", 1, "not a hybrid question")], "repository_id string, question_id int, answer string")
    run = answers.evaluation_run(q, states, nodes, edges, labels, told)
    got = {r["question_id"]: (r["actual"], r["found"], r["missing"]) for r in run.collect()}
    assert got == {1: ("pure_graph", ["b.ts"], ["zz"]), 2: ("hybrid", ["One"], []), 3: ("error", [], ["one"]), 4: ("error", [], ["x"]), 5: ("intelligence", [], []), 6: ("pure_graph", [], [])}
    summary = evaluation.write_report(str(tmp_path / "report"), run).first()
    assert (summary["n"], summary["routing_accuracy"], summary["entity_recall"]) == (6, 0.5, 0.375)
    assert spark.read.json(str(tmp_path / "report" / "confusion")).filter("actual = 'error'").count() == 2


def test_hints_by_their_rarest_piece(spark, monkeypatch):
    """Against plain code: hints that begin alike, short ones, and lists that are split."""
    rng = random.Random(6)
    labels = [f"src/{''.join(rng.choices('abc/', k=rng.randint(1, 8)))}.TS" for _ in range(300)] + ["x", "", "É"]
    nodes = [(f"r{i % 2}", f"n{i}", i, t, "file") for i, t in enumerate(labels)]
    wanted = [f"src/{''.join(rng.choices('abc', k=rng.randint(0, 4)))}" for _ in range(60)] + ["s", "sr", ".t", "", "é", "zzz", "src/zq", "x", None, "TS"]
    hints = spark.createDataFrame([(f"r{i % 3}", i, h) for i, h in enumerate(wanted)], "repository_id string, question_id int, hint string")
    n = spark.createDataFrame(nodes, "repository_id string, id string, ordinal int, label string, type string")
    want = {}
    for i, h in enumerate(wanted):
        names = {}
        for r, node, _, label, _ in nodes:  # a label keeps its first place and takes its last id
            if r == f"r{i % 3}":
                names[label] = node
        want[i] = next((node for label, node in names.items() if h is not None and h.lower() in label.lower()), None)
    for frequent in (10_000, 3):
        monkeypatch.setattr(answers, "FREQUENT", frequent)
        assert {r["question_id"]: r["id"] for r in answers.resolved_hints(hints, n).collect()} == want
    assert answers.resolved_hints(hints.limit(0), n).count() == 0 and answers.resolved_hints(hints, n.limit(0)).filter("id is not null").count() == 0


def test_hints(spark):
    nodes = [("r", 0, "repository", "root", "Top"), ("r", 1, "file", "f1", "User.ts"), ("r", 2, "file", "f2", "user.ts"), ("r", 3, "file", "f3", "User.ts"), ("s", 0, "file", "g", "user.ts")]
    n = spark.createDataFrame(nodes, "repository_id string, ordinal int, type string, id string, label string")
    hints = [("r", 1, "USER"), ("r", 2, "user.ts"), ("r", 3, "repository"), ("r", 4, "none"), ("r", 5, ""), ("r", 6, None), ("r", 7, "s"), ("s", 8, "er.t"), ("t", 9, "user")]
    got = answers.resolved_hints(spark.createDataFrame(hints, "repository_id string, question_id int, hint string"), n).collect()
    assert {r["question_id"]: r["id"] for r in got} == {1: "f3", 2: "f3", 3: "root", 4: None, 5: "root", 6: None, 7: "root", 8: "g", 9: None}


def test_hierarchy_and_flags(spark, edges):
    nodes = [("r", "repository"), ("d", "folder"), ("f", "file"), ("c", "class"), ("m", "method"), ("n", "method"), ("p", "package"), ("odd", "thing"), ("leaf", "file")]
    inside = [(1, "r", "d"), (2, "r", "f"), (3, "d", "f"), (4, "f", "c"), (5, "c", "m"), (6, "m", "n"), (7, "odd", "leaf")]
    n = spark.createDataFrame([(g, i, a, b) for g in "xy" for i, (a, b) in enumerate(nodes)], "repository_id string, ordinal int, id string, type string")
    e = spark.createDataFrame([(g, *x) for g in "xy" for x in inside if g == "x" or x[0] not in (1, 2)], "repository_id string, ordinal int, source string, target string")
    got = {(r["repository_id"], r["id"]): (r["parent"], r["container"], r["role"]) for r in answers.hierarchy(n, e).collect()}
    one = {"r": (None, None, "hierarchy_root"), "p": (None, None, "standalone"), "odd": (None, None, "standalone"), "d": ("r", "r", None), "f": ("d", "d", None), "c": ("f", "d", None), "m": ("c", "d", None), "n": ("m", "d", None), "leaf": ("odd", None, None)}
    assert {k[1]: v for k, v in got.items() if k[0] == "x"} == one
    assert got["y", "r"] == (None, None, "standalone") and got["y", "d"] == (None, None, "hierarchy_root") and got["y", "n"] == ("m", "d", None)
    with pytest.raises(ValueError, match="cycle"):
        answers.hierarchy(n, e.filter("ordinal > 3").unionByName(e.filter("ordinal = 6").withColumns({"ordinal": F.lit(9), "source": F.lit("n"), "target": F.lit("c")})))
    # the only container of a repository, whatever its type
    odd = answers.hierarchy(n.filter("id in ('odd', 'leaf')"), e.filter("source = 'odd'")).filter("id = 'leaf'").first()
    assert odd["container"] == "odd"
    x = edges.unionByName(spark.createDataFrame([("r", "d", "c")], KIND))
    chosen = spark.createDataFrame([("r", "b")], "repository_id string, node string")
    flags = {(r["repository_id"], r["id"]): tuple(r)[2:] for r in answers.display_flags(x.select("repository_id", F.explode(F.array("source", "target")).alias("id")), x, chosen).collect()}
    assert flags["r", "c"] == (True, True, False) and flags["r", "d"] == (True, False, True) and flags["r", "b"] == (False, False, False) and flags["r", "a"] == (False, True, False) and flags["s", "a"] == (True, False, False)


def test_retrieval(spark):
    c = spark.createDataFrame([("r", 1, "red Fox"), ("r", 2, "red red fox"), ("r", 3, None), ("r", 4, "?!"), ("s", 5, "red fox")], "repository_id string, chunk_id int, content string")
    q = spark.createDataFrame([("r", 1, "RED fox"), ("r", 2, ""), ("t", 3, "red")], "repository_id string, query_id int, text string")
    v = {r["chunk_id"]: r["v"] for r in retrieval.embedded(c).collect()}
    assert v[3] == v[4] == [] and abs(sum(x * x for x in v[2]) - 1) < 1e-12 and v[1] == v[5]
    got = [tuple(r) for r in retrieval.retrieved(q, c).orderBy("rank").collect()]
    assert [(r[1], r[2], r[4]) for r in got] == [(1, 1, 1), (1, 2, 2)] and got[0][3] == 1.0
    many = spark.createDataFrame([("r", i, "red fox" if i % 2 else f"red fox w{i}") for i in range(40)], c.schema)
    old, retrieval.TILE = retrieval.TILE, 7
    try:
        tiles = [tuple(r)[1:] for r in retrieval.retrieved(q.filter("query_id = 1"), many, 5).orderBy("rank").collect()]
    finally:
        retrieval.TILE = old
    assert tiles == [(1, 2 * i + 1, 1.0, i + 1) for i in range(5)]
    model = lambda: lambda texts: [[len(t), 1.0] for t in texts]
    v = {r["chunk_id"]: r["v"] for r in retrieval.embedded_by(c, model).collect()}
    assert v[3] == [] and abs(v[1][0] - 7 / 50**0.5) < 1e-9
    blocks = spark.createDataFrame([(1, 1, "a.ts:1-2", "function", "x")], "question_id int, rank int, location string, label string, content string")
    p = {r[0]: r[1] for r in retrieval.system_prompts(q.withColumnRenamed("query_id", "question_id"), blocks, refusal="no", rules="yes").collect()}
    assert p == {1: "yes\n\n--- Context 1: a.ts:1-2 - function ---\nx", 2: "no", 3: "no"}


def test_scalars_and_checkpoint(spark):
    urls = ["https://github.com/o/r.git", " https://github.com/o.x/r-1/ ", "https://github.com/o/r/t", "http://github.com/o/r", None]
    x = spark.createDataFrame([(u,) for u in urls], "u string").select(scalars.repository_name(F.col("u")).alias("r"))
    assert [r[0] and tuple(r[0]) for r in x.collect()] == [("o", "r"), ("o.x", "r-1"), None, None, None]
    m = spark.createDataFrame([("Repository not found",), ("Permission DENIED",), ("timeout",), (None,)], "m string").select(scalars.failure_class(F.col("m")))
    assert [r[0] for r in m.collect()] == ["permanent", "permanent", "retryable", "retryable"]
    s = spark.createDataFrame([(100, 50), (1, 0), (None, 5)], "c int, ms int").select(scalars.chars_per_second(F.col("c"), F.col("ms")))
    assert [r[0] for r in s.collect()] == [2000, None, None]
    files = spark.createDataFrame([("r", "a"), ("s", "b")], "repository_id string, path string")
    saved = spark.createDataFrame([("r", "old"), ("gone", "z")], "repository_id string, path string")
    got = chunking.with_checkpoint(files, saved, ["repository_id"], lambda f: f)
    assert {tuple(r) for r in got.collect()} == {("r", "old", True), ("s", "b", False)}


def test_texts_about_cycles_are_made_beside_their_questions(spark, edges, monkeypatch):
    """A text is copied for parts of the questions, and isn't made where the caller leaves those questions out."""
    monkeypatch.setattr(answers, "SHARED", 3)
    q = spark.createDataFrame([(g, i, "cycles?", "intelligence", None, ["z", "no"]) for g in "srt" for i in range(8)], "repository_id string, question_id int, text string, expected string, hint string, entities array<string>")
    names = edges.select("repository_id", F.col("source").alias("node"), F.upper("source").alias("label")).distinct()
    texts = answers.answer_texts(q.withColumns({"node": F.lit(None).cast("string"), "target": F.lit(None).cast("string")}), edges, names).collect()
    assert len(texts) == 24 and {(r[0], r[2]) for r in texts} == {("s", "1 circular dependency found:\nA → Z"), *((g, "No circular dependencies found in this repository.") for g in "rt")}
    states = spark.createDataFrame([("r", "ready"), ("s", "ready")], "repository_id string, status string")
    nodes = spark.createDataFrame([("r", 0, "file", "a", "a.ts")], "repository_id string, ordinal int, type string, id string, label string")
    run = answers.evaluation_run(q, states, nodes, edges, names, spark.createDataFrame([], "repository_id string, question_id int, answer string"))
    assert {(r[0], r[3], tuple(r[4])) for r in run.collect()} == {("s", "intelligence", ("z",)), ("r", "intelligence", ("no",)), ("t", "error", ())}
    assert "circular dependenc" not in run.filter("actual <> 'intelligence'")._jdf.queryExecution().optimizedPlan().toString()


def test_checkpoints_of_few_keys_shuffle_no_files(spark):
    files = spark.createDataFrame([("r", "a"), ("s", "b")], "repository_id string, path string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = chunking.with_checkpoint(files, files.filter("repository_id = 'r'"), ["repository_id"], lambda f: f)
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and {tuple(r) for r in got.collect()} == {("r", "a", True), ("s", "b", False)}


def test_evaluation_covers_questions_about_cycles(spark, tmp_path):
    """The registered query has a row for each question; those about cycles are scored by the names in the list of cycles."""
    import __spark_entry__

    part = [(i, f"part {i}", "Brand#1", "SMALL", 1 if i == 9 else 10 if i in (3, 5, 7, 9, 10, 11, 12) else 20, 1.0) for i in range(13)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r["question_id"]: (r["repository_id"], r["actual"], r["n_found"]) for r in __spark_entry__.queries()["evaluation_run"](spark, str(tmp_path)).collect()}
    # r1 has the cycles p/0 and p/3 with p/9, r2 has p/0
    assert len(got) == 13
    assert {i: got[i] for i in (3, 5, 7, 10, 11, 12)} == {3: ("r1", "intelligence", 1), 5: ("r3", "error", 0), 7: ("r1", "intelligence", 0), 10: ("r1", "intelligence", 1), 11: ("r1", "intelligence", 1), 12: ("r2", "intelligence", 0)}


def test_names_in_long_texts(spark, monkeypatch):
    """Against plain code: texts cut into blocks, names that cross pieces and blocks, and names dealt into parts."""
    rng = random.Random(9)
    texts = {r: [rng.choice(["é", "", "b\n", " → a", "ab", "cab "]) for _ in range(n)] for r, n in (("r", 60), ("s", 7), ("t", 1))}
    whole = {r: "".join(p) for r, p in texts.items()}
    names = {(r, t) for r in (*texts, "none") for t in ("", "a", "x", "é → ", "b\nb", whole["r"][20:60], whole["s"], whole["r"] + "x")}
    names |= {(r, "".join(rng.choices("ab é\n", k=rng.randint(1, 5)))) for r in texts for _ in range(30)}
    pieces = [(r, sum(len(x.encode()) for x in p[:i]), x) for r, p in texts.items() for i, x in enumerate(p)]
    n = spark.createDataFrame(sorted(names), "repository_id string, name string")
    p = spark.createDataFrame(pieces, "repository_id string, at long, piece string")
    want = {(r, t) for r, t in names if t in whole.get(r, "")} - {(r, "") for r in ("none", *(r for r in texts if not whole[r]))}
    for block, together in ((1_000_000, 200_000), (10, 7)):
        monkeypatch.setattr(evaluation, "BLOCK", block)
        monkeypatch.setattr(evaluation, "NAMES", together)
        assert {tuple(r) for r in evaluation.contained(n, p).collect()} == want
    assert evaluation.contained(n.limit(0), p).count() == evaluation.contained(n, p.limit(0)).count() == 0


def test_questions_about_cycles_name_several(spark, edges):
    """Names in any case, twice, null, across lines and in the first line; equal questions stay two."""
    more = edges.unionByName(spark.createDataFrame([("s", "b", "b"), ("r", "d", "c")], KIND))
    names = ["A → Z", "z\nB", "CIRCULAR", "2 circular dependencies found:\na", "zb", None, "b", "b", ""]
    q = spark.createDataFrame([(g, 1, "cycles?", "intelligence", None, e) for g, e in (("s", names), ("s", names), ("r", names), ("s", None))], "repository_id string, question_id int, text string, expected string, hint string, entities array<string>")
    x = q.select("repository_id", "question_id", "expected", F.coalesce("entities", F.array().cast("array<string>")).alias("names"))
    labels = spark.createDataFrame([("s", "a", "A")], "repository_id string, node string, label string")
    got = sorted((r["repository_id"], r["found"], r["missing"]) for r in answers._named_in_cycles(x, more, labels).collect())
    all_of_s = [n for n in names if n not in ("zb", None)]
    assert got == [("r", ["CIRCULAR", ""], ["A → Z", "z\nB", "2 circular dependencies found:\na", "zb", "b", "b"]), ("s", [], []), ("s", all_of_s, ["zb"]), ("s", all_of_s, ["zb"])]


def test_long_texts_about_cycles_are_written_once(spark, monkeypatch, tmp_path):
    """Texts are broadcast or, where they are too many, copied for parts of the questions; a writer looks at a page's size early and keeps equal texts once."""
    keys = ["parquet.page.size.row.check.min", "parquet.dictionary.page.size", "parquet.column.statistics.enabled#answer"]
    pair = spark.range(20_000).select(F.lit("s").alias("repository_id"), F.concat(F.lit("some/long/folder/of/files/a"), "id").alias("a"), F.concat(F.lit("some/long/folder/of/files/b"), "id").alias("b"))
    loops = pair.select("repository_id", F.col("a").alias("source"), F.col("b").alias("target")).unionByName(pair.select("repository_id", F.col("b").alias("source"), F.col("a").alias("target")))
    q = spark.range(300).select(F.element_at(F.array(F.lit("s"), F.lit("t")), (F.col("id") % 2 + 1).cast("int")).alias("repository_id"), F.col("id").alias("question_id"), F.lit("cycles?").alias("text"), F.lit(None).cast("string").alias("node"), F.lit(None).cast("string").alias("target"))
    names = spark.createDataFrame([], "repository_id string, node string, label string")
    try:
        got = answers.answer_texts(q, loops, names)
        assert "BroadcastHashJoin" in got.filter("answer like '%circular%'")._jdf.queryExecution().executedPlan().toString()
        assert [spark.conf.get(k, None) for k in keys][::2] == ["10", "false"]
        got.write.parquet(str(tmp_path / "out"))
        sizes = [p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")]
        back = spark.read.parquet(str(tmp_path / "out"))
        text = back.filter("question_id = 0").first()["answer"]
        assert len(text) > 1_200_000 and text.startswith("20000 circular dependencies found:\nsome/long/folder/of/files/a0 → some/long/folder/of/files/b0\n")
        assert sum(sizes) < 5 * len(text)  # 150 copies before
        counts = {(r[0], r[1]): r[2] for r in back.groupBy("repository_id", F.crc32("answer")).count().collect()}
        assert sorted(counts.values()) == [150, 150]
        monkeypatch.setattr(answers, "TEXTS", 0)
        dealt = answers.answer_texts(q, loops, names)
        assert {(r[0], r[1]): r[2] for r in dealt.groupBy("repository_id", F.crc32("answer")).count().collect()} == counts
    finally:
        for k in keys:
            spark.conf.unset(k)
