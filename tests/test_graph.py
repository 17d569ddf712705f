import numpy as np
import random

import pytest
from lodestone.operators import graph, local, retrieval
from pyspark.sql import functions as F

KIND = "repository_id string, source string, target string, type string"


def edges(spark, pairs, repository="r", kind="imports"):
    return spark.createDataFrame([(repository, a, b, kind) for a, b in pairs], KIND)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["repository_id"], r["cycle_id"]), set()).add(r["node"])
    return out


def in_r(want):
    return {("r", k): v for k, v in want.items()}


@pytest.fixture(params=["in tasks", "by rounds"])
def way(request, monkeypatch):
    """Components are searched in tasks, or by rounds of joins as large ones are."""
    if request.param == "by rounds":
        monkeypatch.setattr(graph, "LOCAL", 0)
        monkeypatch.setattr(graph, "STARS", 0)
        monkeypatch.setattr(graph, "FOLD", 3)
    return request.param


CASES = [
    ([("A", "B"), ("B", "C")], {}),
    ([("A", "B"), ("B", "A")], {"A": {"A", "B"}}),
    ([("A", "A")], {"A": {"A"}}),
    ([("A", "B"), ("B", "A"), ("X", "Y"), ("Y", "Z"), ("Z", "X"), ("B", "X")], {"A": {"A", "B"}, "X": {"X", "Y", "Z"}}),
    ([], {}),
]


@pytest.mark.parametrize("pairs,want", CASES)
def test_cycles(spark, pairs, want):
    assert found(graph.cycles(edges(spark, pairs))) == in_r(want)


def closure(after, n):
    seen, todo = set(), [n]
    while todo:
        for m in after.get(todo.pop(), set()) - seen:
            seen.add(m)
            todo.append(m)
    return seen


def test_random_graphs_of_two_repositories_with_equal_names(spark, way):
    rng = random.Random(4)
    pairs = {r: {(f"n{rng.randrange(14):02}", f"n{rng.randrange(14):02}") for _ in range(k)} for r, k in (("r", 22), ("s", 15))}
    e = edges(spark, pairs["r"]).unionByName(edges(spark, pairs["s"], "s")).unionByName(edges(spark, [("n00", f"n{i:02}") for i in range(25)], "s", "contains"))
    seeds = [(r, n) for r in pairs for n in sorted({x for p in pairs[r] for x in p} | {"alone"})]
    got = graph.reach(spark.createDataFrame(seeds, "repository_id string, seed string"), e, "imports").collect()
    paths = graph.shortest_paths(spark.createDataFrame([(*s, None) for s in seeds], "repository_id string, seed string, node string"), e, "imports").collect()
    asked = [(r, s, f"n{rng.randrange(14):02}") for r, s in seeds] + [("r", "alone", "alone"), ("r", "n00", "nowhere")]
    some = graph.shortest_paths(spark.createDataFrame(asked, "repository_id string, seed string, node string"), e, "imports").collect()
    want_reach, want_paths, want_cycles = set(), {}, {}
    for r in pairs:
        after = {}
        for a, b in pairs[r]:
            after.setdefault(a, set()).add(b)
        for _, seed in [x for x in seeds if x[0] == r]:
            best, front = {seed: (seed,)}, [(seed,)]
            while front:
                new = {}
                for p in front:
                    for m in after.get(p[-1], ()):
                        if m not in best:
                            new[m] = min(new.get(m, (*p, m)), (*p, m))
                best |= new
                front = [*new.values()]
            want_reach |= {(r, seed, n, len(p) - 1) for n, p in best.items()}
            want_paths |= {(r, seed, n): list(p) for n, p in best.items()}
        to = {n: closure(after, n) for n in {x for p in pairs[r] for x in p}}
        for n in to:
            if n in to[n]:
                want_cycles.setdefault((r, min(m for m in to if m == n or (m in to[n] and n in to[m]))), set()).add(n)
    assert len(got) == len(want_reach) and {tuple(x) for x in got} == want_reach
    assert len(paths) == len(want_paths) and {(x[0], x[1], x[2]): x[3] for x in paths} == want_paths
    assert {(x[0], x[1], x[2]): x[3] for x in some} == {k: want_paths[k] for k in set(asked) if k in want_paths}
    assert found(graph.cycles(e, "imports")) == want_cycles


def test_components(spark, way):
    rng = random.Random(7)
    pairs = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(45)]
    names = {x: x for p in pairs for x in p}
    for _ in names:
        for a, b in pairs:
            names[a] = names[b] = min(names[a], names[b])
    got = graph.components(edges(spark, pairs).unionByName(edges(spark, [("n00", "n01")], "s"))).collect()
    assert {(r["repository_id"], r["node"], r["component"]) for r in got} == {("r", n, c) for n, c in names.items()} | {("s", "n00", "n00"), ("s", "n01", "n00")}
    assert len(got) == len(names) + 2


def test_a_chain_of_2000_nodes(spark):
    chain = edges(spark, [(f"{i:04}", f"{i + 1:04}") for i in range(1999)])
    seed = spark.createDataFrame([("r", "0000")], "repository_id string, seed string")
    got = graph.reach(seed, chain)
    assert got.count() == 2000 and got.agg(F.max("depth")).first()[0] == 1999
    path = graph.shortest_paths(seed.withColumn("node", F.lit("1999")), chain).first()["path"]
    assert len(path) == 2000 and path[:2] == ["0000", "0001"]
    assert graph.components(chain).select("component").distinct().count() == 1
    ring = chain.unionByName(edges(spark, [("1999", "0000")]))
    assert {k: len(v) for k, v in found(graph.cycles(ring)).items()} == {("r", "0000"): 2000} and graph.cycles(chain).count() == 0


def test_long_components_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "LOCAL", 0)
    monkeypatch.setattr(graph, "STARS", 0)
    chain = edges(spark, [(f"{i * 37 % 300:03}", f"{(i + 1) * 37 % 300:03}") for i in range(299)])
    assert graph.components(chain).select("component").distinct().count() == 1
    monkeypatch.setattr(graph, "FOLD", 3)
    # A reaches all of its cycle in one round, but only the last node leads back to it
    wheel = [("A", f"v{i}") for i in range(12)] + [(f"v{i}", f"v{i + 1}") for i in range(11)] + [("v11", "A")]
    assert found(graph.cycles(edges(spark, wheel))) == in_r({"A": {"A"} | {f"v{i}" for i in range(12)}})
    # a chain of components, named in the order in which one leads to the next
    pairs = [(f"{i:02}{x}", f"{i:02}{y}") for i in range(5) for x, y in ("ab", "ba")] + [(f"{i:02}a", f"{i + 1:02}a") for i in range(4)]
    assert found(graph.cycles(edges(spark, pairs))) == in_r({f"{i:02}a": {f"{i:02}a", f"{i:02}b"} for i in range(5)})


def test_many_groups(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELLS", 40)  # the seeds of one component go to several tasks
    monkeypatch.setattr(local, "TOGETHER", 4)
    pairs = [(f"a{i:02}", f"a{i + 1:02}") for i in range(30)] + [(f"b{i}", f"b{i + 1}") for i in range(5)]
    e = edges(spark, pairs)
    seeds = e.select("repository_id", F.col("source").alias("seed")).distinct()
    got = graph.reach(seeds, e).collect()
    assert len(got) == sum(31 - i for i in range(30)) + sum(6 - i for i in range(5)) == len({tuple(r) for r in got})


def test_dependencies_and_algorithms_by_name(spark):
    e = edges(spark, [("A", "B"), ("B", "C"), ("C", "A"), ("D", "D")]).unionByName(edges(spark, [("A", "Z")], "r", "contains")).unionByName(edges(spark, [("A", "X")], "s"))
    seeds = spark.createDataFrame([("r", "A"), ("r", "D"), ("r", None), ("r", "none")], "repository_id string, seed string")
    run = lambda **p: {(r["seed"], r["node"]) for r in graph.run_algorithm("dependency-analysis", None, e, params=seeds, **p).collect()}
    assert run(edge_type="imports") == {("A", "B"), ("A", "C"), ("D", "D")} and run(direction="outgoing") == {("A", "B"), ("A", "Z"), ("D", "D")}
    assert run(direction="incoming", edge_type="imports") == {("A", "C"), ("D", "D")}
    assert run(mode="transitive", direction="outgoing", edge_type="imports") == {("A", "B"), ("A", "C")} == run(mode="transitive", direction="incoming")
    assert run(mode="transitive") == {("A", "B"), ("A", "C"), ("A", "Z")}
    pair = spark.createDataFrame([("r", "A", "C"), ("s", "A", "C"), ("r", "C", "C")], "repository_id string, seed string, node string")
    assert {(r[0], r[1], tuple(r[3])) for r in graph.run_algorithm("dependency-analysis", None, e, params=pair, mode="path").collect()} == {("r", "A", ("A", "B", "C")), ("r", "C", ("C",))}
    assert found(graph.run_algorithm("cycle-detection", None, e)) == in_r({"A": {"A", "B", "C"}, "D": {"D"}})
    assert {(r["repository_id"], r["node"], r["fan_out"], r["fan_in"]) for r in graph.run_algorithm("degree-profile", None, e).collect()} >= {("r", "A", 2, 1), ("s", "A", 1, 0), ("r", "D", 1, 0)}
    with pytest.raises(KeyError, match="cycle-detection"):
        graph.run_algorithm("none", None, None)
    with pytest.raises(ValueError, match="params"):
        graph.run_algorithm("dependency-analysis", None, e)
    with pytest.raises(ValueError, match="direction"):
        graph.run_algorithm("dependency-analysis", None, e, params=seeds, direction="up")


def test_graph_prompt(spark):
    r = graph.first_relations(edges(spark, [("A", x) for x in "BCD"] + [("A", "A")]), 2)
    q = spark.createDataFrame([("r", 1, "A", "why?"), ("r", 2, "Z", None), ("r", 3, "Z", "how?"), ("s", 4, "A", "x")], "repository_id string, question_id int, node string, text string")
    got = {x["question_id"]: x["prompt"] for x in retrieval.graph_prompt(q, r).collect()}
    assert got == {1: "Graph facts:\n- incoming: A\n- outgoing: A\n- outgoing: B\n\nwhy?", 2: None, 3: "how?", 4: "x"}


def test_null_and_empty_repositories_are_two(spark):
    e = spark.createDataFrame([(None, "a", "q", "imports"), ("", "a", "w", "imports"), ("", "w", "a", "imports")], "repository_id string, source string, target string, type string")
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(graph.components(e)) == {(None, "a", "a"), (None, "a", "q"), ("", "a", "a"), ("", "a", "w")}
    assert rows(graph.reach(e.select("repository_id", F.col("source").alias("seed")).distinct(), e)) == {(None, "a", "a", 0), (None, "a", "q", 1), ("", "a", "a", 0), ("", "a", "w", 1), ("", "w", "w", 0), ("", "w", "a", 1)}


def test_seeds_searched_together_reach_what_each_reaches(monkeypatch):
    """More seeds than go together, against a search from each."""
    rng = np.random.default_rng(2)
    n = 300
    for edges in (150, 700, 3000):
        a, b = rng.integers(0, n, edges), rng.integers(0, n, edges)
        to = {i: set(b[a == i].tolist()) for i in range(n)}
        want = set()
        for s in range(n):
            depth, front, seen = 0, {s}, set()
            while front:
                want |= {(s, x, depth) for x in front}
                seen |= front
                front, depth = set().union(*(to[x] for x in front)) - seen, depth + 1
        for many in (1, 70, 512):
            monkeypatch.setattr(local, "TOGETHER", many)
            got = [t for part in local.reached(*local.rows_of(n, a, b), np.arange(n)) for t in zip(*(x.tolist() for x in part), strict=True)]
            assert len(got) == len(want) and set(got) == want
    assert list(local.reached(*local.rows_of(2, np.array([], int), np.array([], int)), np.array([], int))) == []


def test_what_many_seeds_depend_on(spark, way, monkeypatch):
    """A cycle, ways into it and out of it, and a component of its own, with more seeds than a block holds; against a search from each."""
    # blocks, the nodes of a cycle and those of a component are split, and small tables aren't broadcast
    monkeypatch.setattr(graph, "BUCKET", 70)
    monkeypatch.setattr(graph, "MEMBERS", 4)
    monkeypatch.setattr(graph, "ASKERS", 9)
    monkeypatch.setattr("lodestone.sources.tables.FEW", 0)
    rng = random.Random(11)
    pairs = [(f"c{i:03}", f"c{(i + 1) % 9:03}") for i in range(9)] + [(f"in{i:03}", f"c{rng.randrange(9):03}") for i in range(75)]
    pairs += [(f"c{rng.randrange(9):03}", f"out{i}") for i in range(5)] + [(f"in{i:03}", f"in{i + 1:03}") for i in range(4)] + [("x", "y"), ("y", "x"), ("y", "z"), ("z", "z")]
    e = edges(spark, pairs).unionByName(edges(spark, [("c000", "only here")], "s")).unionByName(edges(spark, [("c000", "not this")], "r", "contains"))
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    nodes = sorted({x for p in pairs for x in p})
    to = {n: closure(after, n) - {n} for n in nodes}
    seeds = spark.createDataFrame([("r", n) for n in [*nodes, nodes[0], "alone", None]], "repository_id string, seed string")
    rows = lambda direction: sorted(map(tuple, graph.dependencies(e, seeds, direction, "transitive", "imports").collect()))
    assert rows("outgoing") == sorted(("r", n, m) for n in nodes for m in to[n])
    assert rows("incoming") == sorted(("r", m, n) for n in nodes for m in to[n])
    of = lambda n: n[0] in "xyz"
    assert rows("both") == sorted(("r", n, m) for n in nodes for m in nodes if n != m and of(n) == of(m))
    got = sorted(map(tuple, graph.closure(seeds, e, "imports").collect()))
    assert got == sorted([("r", n, m) for n in nodes for m in to[n] | {n}] + [("r", "alone", "alone")])


def test_copies_of_a_component_are_bounded(spark, monkeypatch):
    """The seeds of a component are dealt over a bounded number of copies of its edges, however many of its nodes they might reach."""
    monkeypatch.setattr(graph, "CELLS", 20)
    pairs = [(f"a{i:03}", f"a{i // 3:03}") for i in range(1, 200)]
    g = graph.prepared(edges(spark, pairs))
    asked = spark.createDataFrame([(f"r{graph.MARK}{a}", None) for a, _ in pairs], "a string, b string")
    rows = graph._units(asked, g)[0].groupBy("kind").count()
    assert {r["kind"]: r["count"] for r in rows.collect()} == {0: graph.COPIES * len(pairs), 1: len(pairs)}


def test_labels_of_nodes_that_leave(spark, monkeypatch):
    """Rounds that leave nodes out, until few edges are left, against plain code."""
    rng = random.Random(3)
    pairs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(0, 120)] + [(f"m{rng.randrange(150):03}", f"m{rng.randrange(150):03}") for _ in range(110)] + [("x", "y"), ("z", "z")]
    names = {x: x for p in pairs for x in p}
    for _ in names:
        for a, b in pairs:
            names[a] = names[b] = min(names[a], names[b])
    monkeypatch.setattr(graph, "STARS", 30)
    got = graph.labels_of(spark.createDataFrame(pairs, "a string, b string").repartition(6)).collect()
    want = {(n, c) for n, c in names.items() if any(n in p and p[0] != p[1] for p in pairs)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_cycles_label_only_what_is_left_after_trimming(spark, monkeypatch):
    """Chains and trees leave before components are labelled; cycles between them, and loops, stay."""
    rows = [("r", f"n{i}", f"n{i // 3}") for i in range(1, 90)] + [("r", "n1", "n4"), ("r", "n30", "n30"), ("s", "a", "b"), ("s", "b", "a"), ("s", "b", "c"), ("t", "x", "y")]
    e = spark.createDataFrame(rows, "repository_id string, source string, target string")
    want = {("r", "n1", "n1"), ("r", "n1", "n4"), ("r", "n30", "n30"), ("s", "a", "a"), ("s", "a", "b")}
    assert set(map(tuple, graph.cycles(e).collect())) == want
    labelled = []
    monkeypatch.setattr(graph, "SHARE", 5)
    whole = graph.labels_of
    monkeypatch.setattr(graph, "labels_of", lambda pairs: labelled.append(pairs.count()) or whole(pairs))
    assert set(map(tuple, graph.cycles(e).collect())) == want
    assert labelled and max(labelled) < 20
    shared = graph.prepared(e)
    assert shared.labels.count() and set(map(tuple, graph.cycles(shared).collect())) == want


@pytest.mark.parametrize("bounds", [{"SHARE": 5}, {"ROUNDS": 2}])
def test_asked_paths_need_no_components(spark, monkeypatch, bounds):
    r = random.Random(5)
    pairs = {(f"n{r.randrange(9):02}", f"n{r.randrange(9):02}") for _ in range(16)} | {(f"c{i:02}", f"c{i + 1:02}") for i in range(4)}
    e = edges(spark, sorted(pairs)).unionByName(edges(spark, [("n01", "n02"), ("n02", "n01"), ("n01", None)], None)).unionByName(edges(spark, [("n03", "n04")], "s"))
    names = sorted({x for p in pairs for x in p})
    rows = [("r", r.choice(names), r.choice(names)) for _ in range(60)] + [("r", "c00", "c04"), ("r", "n05", "n05"), ("r", "none", "none"), ("r", "none", "n01"), ("s", "n03", "n04"), ("s", "n04", "n03"), (None, "n01", "n02"), ("r", None, "n01")]
    asked = spark.createDataFrame(rows, "repository_id string, seed string, node string")
    of = lambda a: sorted((str(x["repository_id"]), x["seed"], x["node"], *x["path"]) for x in graph.shortest_paths(a, e).collect())
    every = asked.unionByName(spark.createDataFrame([("r", "c02", None), ("r", "c02", "c03")], asked.schema))
    want, want_every = of(asked), of(every)
    assert ("r", "c00", "c04", *[f"c{i:02}" for i in range(5)]) in want and ("None", "n01", "n02", "n01", "n02") in want and len(want) > 20
    monkeypatch.setattr(graph, "FIRST", 0, raising=False)
    for k, v in bounds.items():
        monkeypatch.setattr(graph, k, v, raising=False)
    if "ROUNDS" in bounds:  # what is left open goes on inside components
        assert of(every) == want_every
        return
    monkeypatch.setattr(graph, "labels_of", lambda pairs: pytest.fail("components were labelled"))
    assert of(asked) == want


def test_neighbours_are_made_distinct_for_seeds_alone(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("c", "a"), ("a", "a"), ("d", "e"), ("a", None)]).unionByName(edges(spark, [("a", "b")], kind="contains"))
    seeds = spark.createDataFrame([("r", "a"), ("r", "a"), ("r", "none"), ("s", "a")], "repository_id string, seed string")
    got = {way: sorted(str(x["node"]) for x in graph.dependencies(e, seeds, way).collect()) for way in graph.DIRECTIONS}
    assert got == {"outgoing": ["None", "a", "b"], "incoming": ["a", "b", "c"], "both": ["None", "a", "b", "c"]}
