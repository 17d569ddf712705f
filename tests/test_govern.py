from concurrent.futures import ThreadPoolExecutor

import pytest
from lodestone.functions import scalars
from lodestone.operators import evaluation, govern, graph
from lodestone.sources import commits
from pyspark.sql import functions as F

NODE = "repository_id string, ordinal long, type string, parts array<string>, label string, producer string, certainty string"
EDGE = "repository_id string, ordinal long, type string, source_type string, source_parts array<string>, target_type string, target_parts array<string>, producer string, certainty string"
D, I = "deterministic", "inferred"


def test_violations(spark):
    nodes = [(r, r, "repository", D) for r in "abcde"] + [(r, f"{r}1", "file", I) for r in "abcde"]
    nodes += [("b", "b2", "file", D), ("c", "c1", "file", D), ("c", "c1", "file", None)]
    edges = [(r, f"{r}>", r, f"{r}1", D) for r in "abce"] + [("d", "d>", "d", "d1", None), ("e", "e?", "e", "no", D), ("e", "e?", "gone", "no", D)]
    n = spark.createDataFrame(nodes, "repository_id string, id string, type string, certainty string")
    e = spark.createDataFrame(edges, "repository_id string, id string, source string, target string, certainty string")
    c = spark.createDataFrame([("a", "f00"), ("b", "f00"), ("c", "f00"), ("d", "f00"), ("e", " \n"), ("f", "f00")], "repository_id string, commit_sha string")
    want = [("b", "orphan_node", "b2"), ("c", "duplicate_node", "c1"), ("c", "duplicate_node", "c1"), ("c", "node_certainty", "c1"), ("d", "edge_certainty", "d>")]
    want += [("e", "commit", None), ("e", "missing_target", "e?"), ("e", "missing_target", "e?"), ("e", "missing_source", "e?"), ("e", "orphan_edge", "e?"), ("e", "duplicate_edge", "e?"), ("f", "root_count", "0")]
    assert sorted(map(tuple, govern.violations(n, e, c).collect()), key=str) == sorted(want, key=str)
    two = n.filter("repository_id = 'a'").unionByName(spark.createDataFrame([("a", "a9", "repository", D)], n.schema))
    assert {tuple(r)[1:] for r in govern.violations(two, e.filter("repository_id = 'a'"), c.filter("repository_id = 'a'")).collect()} == {("root_count", "2"), ("orphan_node", "a9")}


def candidates(spark):
    nodes = [
        ("r", 2, "file", ["src\\a.ts"], "second", "model", I), ("r", 1, "file", ["src/a.ts"], "first", "model", I), ("r", 3, "file", ["/src//a.ts"], "sure", "scan", D),
        ("r", 4, "package", ["p"], "p", "scan", D), ("bad", 1, "file", ["alone"], "x", "scan", D), ("odd", 1, "gadget", ["x"], "x", "scan", D), ("odd", 2, "class", ["x"], "x", "scan", D), ("old", 1, "gadget", ["x"], "x", "scan", D),
    ]
    edges = [("r", 1, "contains", "repository", ["r"], "file", ["src/a.ts"], "scan", D), ("r", 2, "imports", "file", ["src/a.ts"], "package", ["p"], "scan", D), ("r", 3, "imports", "file", ["src\\a.ts"], "package", ["p"], "model", I)]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def test_publish(spark, tmp_path):
    nodes, edges = candidates(spark)
    asked = spark.createDataFrame([("r", "c1"), ("bad", "c1"), ("odd", "c1"), ("old", "c1"), ("empty", "c1"), ("blank", "")], "repository_id string, commit_sha string")
    versions, n, e, why = govern.publish(asked, asked.filter("repository_id = 'old'"), nodes, edges)
    got = {r["repository_id"]: (r["status"], r["n_nodes"], r["n_edges"], r["n_violations"]) for r in versions.collect()}
    assert got == {"r": ("ready", 3, 2, 0), "bad": ("failed", 0, 0, 1), "odd": ("failed", 0, 0, 2), "old": ("already_exists", 0, 0, 0), "empty": ("ready", 1, 0, 0), "blank": ("failed", 0, 0, 1)}
    assert {(r["id"], r["label"], r["certainty"], r["producer"], r["verified"]) for r in n.filter("repository_id = 'r'").collect()} == {("repository:r", "Repository", D, "pipeline", False), ("file:src/a.ts", "sure", D, "scan", True), ("package:p", "p", D, "scan", False)}
    assert {(r["id"], r["source"], r["verified"]) for r in e.collect()} == {("edge:repository:r->contains->file:src/a.ts", "repository:r", False), ("edge:file:src/a.ts->imports->package:p", "file:src/a.ts", True)}
    assert {(r["repository_id"], r["invariant"], r["subject"]) for r in why.collect()} == {("bad", "orphan_node", "file:alone"), ("odd", "identity", "node 1"), ("odd", "identity", "node 2"), ("blank", "commit", None)}
    assert why.filter("message is null").count() == 0 and n.filter("repository_id = 'bad'").count() == 0
    path = str(tmp_path / "store")
    first = {r["repository_id"]: r["status"] for r in govern.publish_to(path, asked, nodes, edges).collect()}
    second = {r["repository_id"]: r["status"] for r in govern.publish_to(path, asked.unionByName(spark.createDataFrame([("r", "c2")], asked.schema)).filter("repository_id <> 'r' or commit_sha = 'c2'"), nodes, edges).collect()}
    assert first["r"] == second["r"] == "ready" and first["old"] == "failed" and set(v for k, v in second.items() if k != "r") == {"already_exists"}
    held = govern.published(spark, path)
    assert held.count() == 7 and govern.published(spark, path, "graph_nodes").filter("repository_id = 'r'").count() == 6
    states = {r["repository_id"]: (r["status"], r["commit_sha"]) for r in govern.graph_of(asked, held).collect()}
    assert states["r"] == ("ready", "c2") and states["bad"] == ("not_generated", None)


def test_several_publishers(spark, tmp_path, monkeypatch):
    """Writers that meet leave one version of each commit; those of other commits all count; a run that fails is never seen."""
    nodes, edges = candidates(spark)
    ask = lambda *rows: spark.createDataFrame(list(rows), "repository_id string, commit_sha string")
    path = str(tmp_path / "store")
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda rows: {tuple(r)[:3] for r in govern.publish_to(path, ask(*rows), nodes, edges).collect()}, [[("r", "c1")], [("r", "c1")], [("empty", "c1"), ("r", "c1")], [("other", "c9")]]))
    versions = [(r["repository_id"], r["commit_sha"]) for r in govern.published(spark, path).collect()]
    assert sorted(versions) == [("empty", "c1"), ("other", "c9"), ("r", "c1")]
    assert sorted(s for one in got for r, c, s in one if r == "r") == ["already_exists", "already_exists", "ready"]
    n = len(commits.log(spark, path))  # two or three, as one writer may have added two commits
    assert govern.published(spark, path, "graph_nodes").filter("repository_id = 'r'").count() == 3 and [e["version"] for e in commits.log(spark, path)] == [*range(1, n + 1)] and n in (2, 3)

    def fails(*_):
        raise OSError("no more")

    monkeypatch.setattr(commits, "add", fails)
    with pytest.raises(OSError, match="no more"):
        govern.publish_to(path, ask(("r", "c2")), nodes, edges)
    monkeypatch.undo()
    assert govern.published(spark, path).filter("commit_sha = 'c2'").count() == 0 and govern.published(spark, path, "graph_nodes").filter("repository_id = 'r'").count() == 3
    assert {r["status"] for r in govern.publish_to(path, ask(("r", "c2")), nodes, edges).collect()} == {"ready"} and govern.published(spark, path).count() == 4
    assert not commits.add(spark, path, 2, {}) and len(commits.log(spark, path)) == n + 1 and len(commits.log(spark, path, n)) == 1
    assert govern.published(spark, str(tmp_path / "none")).count() == 0


def test_tiers_and_identities(spark):
    nodes, _ = candidates(spark)
    a, b = nodes.filter("certainty = 'inferred'"), nodes.filter("certainty = 'inferred'").withColumns({"ordinal": F.lit(0), "label": F.lit("later")}).drop("producer")
    both = govern.tiers(a, b)
    assert govern.identified(both, False).first()["label"] == "first" and both.filter("producer is null").count() == 2
    assert govern.tiers(a, b.limit(0)).count() == 2
    with pytest.raises(Exception, match="no identity"):
        nodes.select(scalars.node_id(F.col("type"), F.col("parts"), strict=True)).collect()
    ids = {r[0] for r in govern.node_ids(spark.createDataFrame([("r", 1, "route", ["get", "/x"], "", "", "")], NODE)).select("id").collect()}
    assert ids == {"route:GET:/x"}


def test_sanitised(spark):
    n = spark.createDataFrame([("r", "a", "file", "", D), ("r", "b", "file", None, D), ("r", "", "file", "x", D), ("r", "c", "file", "x", "maybe"), ("r", "d", "file", "x", I), ("s", "b", "file", "x", D)], "repository_id string, id string, type string, label string, certainty string")
    e = spark.createDataFrame([("r", "1", "a", "d", "contains", D), ("r", "2", "a", "b", "imports", D), ("r", "", "a", "d", "imports", D), ("r", "4", "a", "d", "", D), ("r", "5", "a", "d", "imports", None), ("r", "6", "d", "a", "imports", I)], "repository_id string, id string, source string, target string, type string, certainty string")
    good, kept, counts = evaluation.sanitised(n, e)
    assert {r["id"] for r in good.filter("repository_id = 'r'").collect()} == {"a", "d"} and {r["id"] for r in kept.collect()} == {"1", "6"}
    assert {tuple(r) for r in counts.collect()} == {("r", 2, 2, 1, 3, 4), ("s", 1, 0, 0, 0, 0)}


def test_small_repositories_are_checked_without_rounds(spark, monkeypatch):
    """Whole repositories meet in tasks, whatever they hold; larger ones go by joins, with the same rows."""
    nodes = [(r, r, "repository") for r in range(6)] + [(r, r * 100 + i, "file") for r in range(7) for i in range(1, 8)] + [(1, 103, "file"), (2, None, "file"), (3, 1, "repository"), (None, 5, "file"), (4, 9, None)]
    edges = [(r, f"e{r}-{i}", r if i == 1 else r * 100 + i - 1, r * 100 + i) for r in range(7) for i in range(1, 5)] + [(1, "x", 1, 77), (1, "x", 78, 77), (2, "y", None, 207), (None, "z", 5, 5), (0, None, 8, 8), (5, "t", 505, 999), (5, "u", 999, 501)]
    n = spark.createDataFrame(nodes, "repository_id long, id string, type string")
    e = spark.createDataFrame(edges, "repository_id long, id string, source string, target string")
    rows = lambda: sorted((tuple(r) for r in graph.checked(n, e).collect()), key=str)
    with monkeypatch.context() as m:
        m.setattr(graph, "WHOLE", 1)
        far = rows()
    monkeypatch.setattr(graph, "labels_of", lambda pairs: pytest.fail("labelled by rounds"))
    near = rows()
    assert near == far and {r[1] for r in near} == {"missing_source", "missing_target", "orphan_edge", "orphan_node"}
    assert (2, "orphan_node", "207") in near and (5, "orphan_node", "505") not in near and (None, "orphan_edge", "z") in near
    c = spark.createDataFrame([(0, "c")], "repository_id long, commit_sha string")
    assert govern.violations(n.withColumn("certainty", F.lit(D)), e.withColumn("certainty", F.lit(D)), c).count() > len(near)


def test_only_asked_repositories_are_looked_at(spark, monkeypatch):
    df = spark.createDataFrame([(r, i) for r in ("a", "b", None) for i in range(3)], "repository_id string, n int")
    new = spark.createDataFrame([("b", "c1")], "repository_id string, commit_sha string")
    for most in (0, 10):
        monkeypatch.setattr(govern, "HASHES", most)
        assert sorted(map(tuple, govern._chosen(new)(df).collect())) == [("b", 0), ("b", 1), ("b", 2)]
