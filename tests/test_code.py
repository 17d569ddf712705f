import json

from lodestone.operators import annotations, chunking, evaluation, govern, imports, structure
from pyspark.sql import functions as F

FLAGS = ("isRoute", *annotations.FLAGS)


def test_specifiers_and_resolution(spark):
    files = [
        ("r", "src/a.ts", 'import x, { y } from "./b";\nimport "../lib";\n// import "./c"\nconst q = require("pkg/sub");\nexport { z } from "./b";\nobj.require("no");'),
        ("r", "src/b.tsx", None), ("r", "lib/index.js", ""), ("r", "src/m.py", "import os, sys as s\nfrom .n import k\nfrom a.b import c  # import z\nfrom ..lib.u import w\nfrom .p import q\nfrom . import z"), ("r", "notes.md", 'import "./b"'), ("r", "src/a.ts", ""),
        ("r", "src/n.py", ""), ("r", "lib/u.py", ""), ("r", "src/p/__init__.py", ""), ("s", "src/a.ts", 'import "./b"; import "./only";'), ("s", "src/only.ts", ""), ("s", "top.py", "from . import a"), ("r", "src/only.ts", "")
    ]
    x = spark.createDataFrame(files, "repository_id string, path string, content string")
    specs = imports.specifiers(x)
    got = {(r["repository_id"], r["path"], r["specifier"]) for r in specs.collect()}
    assert got == {("r", "src/a.ts", s) for s in ("./b", "../lib", "pkg/sub")} | {("r", "src/m.py", s) for s in ("os", "sys", ".n", "a.b", "..lib.u", ".p", ".")} | {("s", "src/a.ts", "./b"), ("s", "src/a.ts", "./only"), ("s", "top.py", ".")}
    # the repository s has no src/b
    want = {("r", "src/a.ts", "./b", "src/b.tsx"), ("r", "src/a.ts", "../lib", "lib/index.js"), ("r", "src/m.py", ".n", "src/n.py"), ("r", "src/m.py", "..lib.u", "lib/u.py"), ("r", "src/m.py", ".p", "src/p/__init__.py"), ("s", "src/a.ts", "./only", "src/only.ts")}
    assert {tuple(r) for r in imports.resolved(specs, x).collect()} == want
    ends = {(r["repository_id"], r["source"], r["target"]) for r in imports.import_edges(specs, x).collect()}
    assert ("r", "file:src/a.ts", "package:pkg") in ends and ("r", "file:src/m.py", "package:a") in ends and len(ends) == 10
    assert {(r["repository_id"], r["id"]) for r in imports.package_nodes(specs).collect()} == {("r", f"package:{p}") for p in ("pkg", "os", "sys", "a")}
    assert imports.specifiers(x.limit(0)).count() == 0


def test_normal_path(spark):
    x = spark.createDataFrame([("a/./b/../c//d",), ("../x",), ("",), (None,)], "p string")
    assert [r[0] for r in x.select(imports.normal_path(F.col("p"))).collect()] == ["a/c/d", "x", "", None]


def test_annotations(spark):
    flags = dict.fromkeys(FLAGS, False)
    route = flags | {"isRoute": True, "isCache": True, "httpMethod": "post", "httpPath": "/x", "entityName": "Box"}
    rows = [
        (1, "a", 200, "```json\n" + json.dumps(route) + "\n```"), (2, "b", 200, json.dumps(flags | {"isRoute": True, "httpMethod": None})), (3, "c", 200, json.dumps(flags | {"isEvent": "true"})),
        (4, "d", 200, "{"), (5, "e", 429, None), (6, "f", 429, None), (7, "g", 500, None), (8, "h", 200, json.dumps(flags | {"isQueue": True})),
    ]
    x = spark.createDataFrame(rows, "ordinal int, path string, status int, answer string").withColumn("repository_id", F.lit("r"))
    assert {(r["id"], r["label"]) for r in annotations.nodes(x).collect()} == {("route:POST:/x", "post /x"), ("cache:a", "Box"), ("queue:h", "h")}
    assert {(r["source"], r["target"], r["type"]) for r in annotations.edges(x).collect()} == {("file:a", "route:POST:/x", "defines"), ("file:a", "cache:a", "defines"), ("file:h", "queue:h", "defines")}
    r = annotations.coverage(x.withColumn("k", F.lit(1)), "k").first()
    assert (r["attempted"], r["succeeded"], r["quota_exhausted"], r["failed"], r["percent"], r["first_over"]) == (8, 3, 2, 3, 37.5, "e")


def test_reports(spark):
    x = spark.createDataFrame([(True, ["a"], ["b"]), (False, [], [])], "correct boolean, found array<string>, missing array<string>")
    assert tuple(evaluation.report(x).first()) == (2, 0.5, 0.5) and tuple(evaluation.report(x.limit(0)).first()) == (0, 0.0, 0.0)
    repos = spark.createDataFrame([(1, "o", "u", "ready"), (2, "o", "v", "failed"), (3, "o", "w", "ready")], "repository_id int, owner string, url string, status string")
    wanted = spark.createDataFrame([("o", " U.git"), ("o", "v/"), ("o", "w"), ("p", "u")], "owner string, url string")
    plan = evaluation.import_plan(wanted, repos, spark.createDataFrame([(1,), (1,), (2,)], "repository_id int"))
    assert {(r["owner"], r["url"]): r["action"] for r in plan.collect()} == {("o", " U.git"): "reuse", ("o", "v/"): "restart", ("o", "w"): "restart", ("p", "u"): "create"}


def test_structure(spark):
    py = "import os\n\n@deco\ndef f():\n    def inner():\n        pass\n\nclass A:\n    x = 1\n\n    def m(self):\n        return 1\n\nclass B:\n    y = 2\n"
    js = "// class No {\nclass A extends B {\n  constructor(a) { this.s = '}'; }\n  async run() {\n    if (a) { b(); }\n  }\n}\nclass E {\n}\nfunction* g(a, b) {\n  return () => {};\n}\n"
    assert structure.of_python(py) == [("function", "f", 3, 6), ("method", "A.m", 11, 12), ("class", "B", 14, 15)]
    assert structure.of_script(js) == [("method", "A.constructor", 3, 3), ("method", "A.run", 4, 6), ("class", "E", 8, 9), ("function", "g", 10, 12)]
    long = "\n".join(f"x{i} = {i}" for i in range(90))
    rows = [("a.py", py), ("b.ts", js), ("c.js", "function x() {"), ("d.py", "def ("), ("e.py", long + "\ndef f():\n    pass"), ("f.md", long), ("g.py", None), ("h.ts", " \n")]
    x = spark.createDataFrame(rows, "path string, content string").withColumn("repository_id", F.lit("r"))
    got = structure.chunks(x)
    by = {}
    for r in got.collect():
        by.setdefault(r["path"], []).append((r["kind"], r["start_line"], r["end_line"]))
        assert r["chunk"] == "\n".join(dict(rows)[r["path"]].split("\n")[r["start_line"] - 1 : r["end_line"]])
    assert by["c.js"] == [("window", 1, 1)] == by["d.py"] and "g.py" not in by and "h.ts" not in by
    assert by["e.py"] == [("window", 1, 40), ("window", 41, 80), ("window", 81, 90), ("function", 91, 92)]
    assert [r[1:] for r in by["f.md"]] == [(r["start_line"], r["end_line"]) for r in chunking.line_windows(x.filter("path = 'f.md'")).collect()]
    assert structure.chunks(x.limit(0)).count() == 0
    nodes, edges = govern.symbols(got)
    assert {r["id"] for r in nodes.filter("path in ('a.py', 'b.ts')").collect()} == {"function:a.py#f", "method:a.py#A.m", "class:a.py#B", "method:b.ts#A.constructor", "method:b.ts#A.run", "class:b.ts#E", "function:b.ts#g"}
    assert edges.filter("source = 'file:b.ts' and type = 'contains'").count() == 4


def test_files_of_one_partition_are_dealt(spark):
    files = spark.createDataFrame([("r", f"src/m{i}.{e}", text) for i in range(50) for e, text in (("py", "import x"), ("ts", 'import "x"'))], "repository_id string, path string, content string").coalesce(1)
    for found in (imports.specifiers(files), structure.chunks(files)):
        assert found.count() == 100
        assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
