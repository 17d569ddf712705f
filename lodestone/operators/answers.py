"""Answers to questions about a graph: hints, batches of answers, their texts, suggestions and evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalars import question_class
from lodestone.operators import graph
from lodestone.operators.evaluation import contained, entities
from lodestone.sources.tables import few, lean_pages, stage

#: Questions suggested for a node of each type, and for any other type (fixed values).
SUGGESTIONS = {
    "service": ["Why does this service depend on Redis?", "Who calls this service?", "Explain this service's responsibilities."],
    "controller": ["Who calls this controller?", "Which services does this rely on?", "Explain what this controller does."],
    "route": ["What happens when this endpoint is called?", "Which service handles this route?", "Which database tables does this endpoint touch?"],
    "dbModel": ["Which services depend on this database?", "Which APIs write to this database?"],
    "package": ["Where is this package used?", "Why is this dependency required?"],
    "class": ["Explain what this class does.", "Who depends on this class?", "What does this class depend on?"],
    "function": ["Explain what this function does.", "Who calls this function?"],
    "method": ["Explain what this method does.", "Who calls this method?"],
}
SUGGESTIONS_ELSE = ["Explain this component.", "What does this depend on?", "What depends on this?"]
#: Texts of answers (fixed values).
NO_PATH, NONE_FOUND = "No path exists between these components.", "None found."
#: Characters of the pieces that hints are looked up by, and what bounds the entries of one that aren't split.
GRAM, FREQUENT = 3, 10_000
#: Questions about cycles that are one part of their repository's, parts of a repository and tasks at most, and bytes of texts that are broadcast.
SHARED, PARTS, TEXTS = 100, 1000, 64_000_000


def suggestions(nodes: DataFrame) -> DataFrame:
    """(repository_id, id, rank, question): the questions suggested for each node (repository_id, id, type)."""
    texts = lambda t: F.array(*map(F.lit, t))
    listed = texts(SUGGESTIONS_ELSE)
    for kind, questions in SUGGESTIONS.items():
        listed = F.when(F.col("type") == kind, texts(questions)).otherwise(listed)
    return nodes.select("repository_id", "id", F.posexplode(listed).alias("rank", "question"))


def labelled(nodes: DataFrame) -> DataFrame:
    """(repository_id, label, position, id): each label at the ordinal that it first has, with the id that it last has.

    The root (type repository) has the label repository besides, just after its own."""
    root = nodes.filter("type = 'repository'").select("repository_id", F.lit("repository").alias("label"), (F.col("ordinal") + 0.5).alias("ordinal"), "id")
    all_nodes = nodes.select("repository_id", "label", F.col("ordinal").cast("double").alias("ordinal"), "id").unionByName(root)
    return all_nodes.groupBy("repository_id", "label").agg(F.min("ordinal").alias("position"), F.max_by("id", "ordinal").alias("id"))


def _pieces(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a text; none if it is shorter."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))


def resolved_hints(hints: DataFrame, nodes: DataFrame) -> DataFrame:
    """hints (repository_id, question_id, hint) with the id of the first label that contains the hint, whatever the case.

    Labels are listed under their pieces of GRAM characters, and under shorter ones only as far as there are such hints. A hint is looked up by
    that piece of its own which the fewest labels of its repository hold, so hints that begin alike meet few labels, and a hint with a piece that
    no label holds meets none. Pieces with more than 1 / FREQUENT of all entries, of which there are fewer than FREQUENT, have their lists split. An empty
    hint takes the first label; a null hint and one that no label contains get a null id."""
    key, low = ["repository_id", "piece"], F.lower("label")
    wanted = stage(hints.select("repository_id", F.lower("hint").alias("low_hint")).filter("low_hint is not null").distinct())
    size = F.least(F.length("low_hint"), F.lit(GRAM))
    lengths = sorted(r[0] for r in wanted.select(size).distinct().collect())  # GRAM + 1 at most
    parts = F.concat(F.array().cast("array<string>"), *[_pieces(low, n) if n else F.array(F.lit("")) for n in lengths])
    names = labelled(nodes)
    listed = stage(names.select("repository_id", low.alias("low"), "position", "id", F.explode(parts).alias("piece")))
    counts = stage(listed.groupBy(*key).agg(F.count("*").alias("n")))
    own = F.lit(None).cast("array<string>")
    for n in lengths:
        own = F.when(size == n, _pieces(F.col("low_hint"), n) if n else F.array(F.lit(""))).otherwise(own)
    # a hint that has a piece without a list is in no label, so all its pieces must be there
    asked = wanted.withColumn("own", own).select("repository_id", "low_hint", F.size("own").alias("n_own"), F.explode("own").alias("piece")).join(counts, key)
    rarest = asked.groupBy("repository_id", "low_hint", "n_own").agg(F.min(F.struct("n", "piece")).alias("r"), F.count("*").alias("met")).filter("met = n_own")
    rarest = stage(rarest.select("repository_id", "low_hint", "r.piece", "r.n"))
    each = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // FREQUENT)
    split = F.broadcast(rarest.filter(F.col("n") > each).select(*key, F.ceil(F.col("n") / each).cast("int").alias("blocks")).distinct())
    block = lambda df, spread: df.join(split, key, "left").withColumn("block", spread(F.coalesce("blocks", F.lit(1))))
    entries = block(listed, lambda n: F.pmod(F.xxhash64("low", "id"), n).cast("int"))
    dealt = block(rarest, lambda n: F.explode(F.sequence(F.lit(0), n - 1)))
    met = dealt.select(*key, "block", "low_hint").join(entries.select(*key, "block", "low", "position", "id"), [*key, "block"]).filter(F.col("low").contains(F.col("low_hint")))
    first = met.groupBy("repository_id", "low_hint").agg(F.min_by("id", F.struct("position", "low", "id")).alias("id"))
    return hints.withColumn("low_hint", F.lower("hint")).join(first, ["repository_id", "low_hint"], "left").drop("low_hint")


def classified(questions: DataFrame) -> DataFrame:
    """questions with category, mode and direction, which replace columns of these names."""
    kept = [c for c in questions.columns if c not in ("category", "mode", "direction")]
    return questions.withColumn("__class", question_class(F.col("text"))).select(*kept, "__class.*")


QUESTION = ["repository_id", "question_id"]


def answer_rows(questions: DataFrame, edges: graph.Edges, modes: tuple[str, ...] = ("direct", "transitive", "path"), edge_type: str | None = None) -> DataFrame:
    """(repository_id, question_id, mode, position, node): what each dependency question of these modes finds, one row a node.

    questions: repository_id, question_id, text, node, target. Each algorithm runs once, for the distinct nodes of all its
    questions; paths are searched for the asked pairs only. Positions count along a path from 0; the nodes of other modes
    have none, since their number isn't bounded."""
    edges = graph.prepared(edges, edge_type)
    x = stage(classified(questions).filter(F.col("mode").isin(*modes)).select(*QUESTION, "mode", "direction", F.col("node").alias("seed"), "target"))
    none = F.lit(None).cast("int").alias("position")
    out = x.limit(0).select(*QUESTION, "mode", none, F.col("seed").alias("node"))
    asked = {(r["mode"], r["direction"]) for r in x.select("mode", "direction").distinct().collect()}  # at most nine
    for mode, way in sorted(asked, key=str):
        mine = x.filter((F.col("mode") == mode) & F.col("direction").eqNullSafe(way))
        if mode == "path":
            pairs = mine.select(*QUESTION, "mode", "seed", F.col("target").alias("node")).filter("node is not null")
            found = pairs.join(graph.shortest_paths(pairs.select("repository_id", "seed", "node"), edges), ["repository_id", "seed", "node"])
            out = out.unionByName(found.select(*QUESTION, "mode", F.posexplode("path").alias("position", "node")))
        else:
            got = graph.dependencies(edges, mine.select("repository_id", "seed"), way or "both", mode)
            out = out.unionByName(mine.select(*QUESTION, "mode", "seed").join(got, ["repository_id", "seed"]).select(*QUESTION, "mode", none, "node"))
    return out


def answer_summary(questions: DataFrame, edges: graph.Edges, edge_type: str | None = None) -> DataFrame:
    """(repository_id, question_id, category, algorithm, mode, found): how much the algorithm of each question finds; null for hybrid
    ones, which get a prompt instead. Questions about cycles find the number of cycles of their repository, which are searched once."""
    edges = graph.prepared(edges, edge_type)
    found = answer_rows(questions, edges).groupBy(*QUESTION).agg(F.count("*").alias("n"))
    n_cycles = graph.cycles(edges).groupBy("repository_id").agg(F.count_distinct("cycle_id").alias("c"))
    dependency, cycle = F.col("category") == "pure_graph", F.col("category") == "intelligence"
    x = classified(questions).join(found, QUESTION, "left").join(n_cycles, "repository_id", "left")
    return x.select(
        *QUESTION, "category", F.when(dependency, "dependency-analysis").when(cycle, "cycle-detection").alias("algorithm"), "mode",
        F.when(dependency, F.coalesce("n", F.lit(0))).when(cycle, F.coalesce("c", F.lit(0))).cast("long").alias("found"),
    )


def cycle_text(n: Column, lines: Column) -> Column:
    """The answer about n cycles: how many, and a line for each."""
    some = F.concat(n.cast("string"), F.when(n == 1, " circular dependency found:\n").otherwise(" circular dependencies found:\n"), lines)
    return F.when(n == 0, "No circular dependencies found in this repository.").otherwise(some)


def answer_texts(questions: DataFrame, edges: graph.Edges, labels: DataFrame, edge_type: str | None = None) -> DataFrame:
    """(repository_id, question_id, answer): the text of the answer to each question about dependencies or cycles.

    labels: repository_id, node, label; a node without a label shows its id. A path is joined by arrows, other nodes by commas in
    the order of their ids, and each cycle is a line in the order of its ids; cycles come by their smallest node. A text is one
    value, so an answer is as long as what it lists; answer_rows has the same as rows."""
    x, edges = classified(questions), graph.prepared(edges, edge_type)
    told = _beside_cycles(x.filter("category = 'intelligence'").select(*QUESTION), edges, labels)
    return _dependency_texts(x, edges, labels).unionByName(told)


def _shown(df: DataFrame, labels: DataFrame) -> DataFrame:
    return df.join(labels, ["repository_id", "node"], "left").withColumn("label", F.coalesce("label", "node"))


def _dependency_texts(x: DataFrame, edges: graph.Edges, labels: DataFrame) -> DataFrame:
    """answer_texts() of the classified questions about dependencies."""
    rows = _shown(answer_rows(x, edges), labels).groupBy(*QUESTION, "mode").agg(F.array_sort(F.collect_list(F.struct("position", "node", "label"))).alias("x"))
    joined = F.transform("x", lambda s: s["label"])
    rows = rows.select(*QUESTION, F.when(F.col("mode") == "path", F.array_join(joined, " → ")).otherwise(F.array_join(joined, ", ")).alias("found"))
    nothing = F.when(F.col("mode") == "path", NO_PATH).otherwise(NONE_FOUND)
    return x.filter("category = 'pure_graph'").join(rows, QUESTION, "left").select(*QUESTION, F.coalesce("found", nothing).alias("answer"))


def _beside_cycles(x: DataFrame, edges: graph.Edges, labels: DataFrame) -> DataFrame:
    """Questions with the answer about the cycles of their repository.

    The questions of a repository are dealt over tasks. Texts of up to `TEXTS` bytes in all are broadcast, so a text is copied only into its rows; others are
    copied for each part of the questions. A text beside a question isn't shuffled again."""
    joined = F.transform("x", lambda s: s["label"])
    lines = _shown(graph.cycles(edges), labels).groupBy("repository_id", "cycle_id").agg(F.array_sort(F.collect_list(F.struct("node", "label"))).alias("x"))
    lines = stage(lines.select("repository_id", "cycle_id", F.array_join(joined, " → ").alias("line")))
    total, longest = lines.groupBy("repository_id").agg(F.sum(F.octet_length("line") + 1).alias("n")).agg(F.sum("n"), F.max("n")).first()
    lean_pages(lines.sparkSession, "answer", longest or 0)
    texts = lines.groupBy("repository_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("cycle_id", "line"))).alias("x"))
    texts = texts.select("repository_id", cycle_text(F.col("n"), F.array_join(F.transform("x", lambda s: s["line"]), "\n")).alias("answer"))
    parts = stage(x.groupBy("repository_id").agg(F.least(F.ceil(F.count("*") / SHARED), F.lit(PARTS)).cast("int").alias("parts")))
    tasks = int(min(PARTS, max(1, parts.agg(F.sum("parts")).first()[0] or 0)))
    mine = x.join(few(parts), "repository_id", "left").withColumn("part", F.pmod(F.xxhash64("question_id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    mine = mine.repartition(tasks, "repository_id", "part")
    if (total or 0) <= TEXTS:
        # equal texts in a row: a writer keeps them once
        both = mine.drop("part").sortWithinPartitions("repository_id").join(F.broadcast(texts), "repository_id", "left")
    else:
        dealt = texts.join(few(parts), "repository_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        both = mine.join(dealt.hint("merge"), ["repository_id", "part"], "left").drop("part")
    return both.withColumn("answer", F.coalesce("answer", cycle_text(F.lit(0), F.lit(""))))


def _cycle_pieces(repositories: DataFrame, edges: graph.Edges, labels: DataFrame) -> DataFrame:
    """(repository_id, at, piece): the answer about the cycles of each repository in lower case, cut after its first line and after each label; at counts its bytes."""
    shown = _shown(graph.cycles(edges), labels).join(repositories, "repository_id", "left_semi").select("repository_id", "cycle_id", "node", "label")
    shown = stage(shown)
    n = shown.groupBy("repository_id").agg(F.count_distinct("cycle_id").alias("n"))
    none = F.lit(None).cast("string")
    heads = repositories.join(n, "repository_id", "left").select("repository_id", none.alias("cycle_id"), none.alias("node"), cycle_text(F.coalesce("n", F.lit(0)), F.lit("")).alias("label"))
    w = Window.partitionBy("repository_id").orderBy("cycle_id", "node", "label")  # the head comes first
    before = F.lag("cycle_id").over(w)
    piece = F.lower(F.concat(F.when(before.isNull(), "").when(before == F.col("cycle_id"), " → ").otherwise("\n"), "label"))
    cut = heads.unionByName(shown).select("*", piece.alias("piece"))
    at = F.sum(F.octet_length("piece")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return cut.select("repository_id", F.coalesce(at, F.lit(0)).alias("at"), "piece")


def _named_in_cycles(x: DataFrame, edges: graph.Edges, labels: DataFrame) -> DataFrame:
    """Questions with the names (found) that the answer about the cycles of their repository contains, whatever the case, and those it doesn't (missing).

    x: repository_id, question_id, expected, names. No question gets a copy of the text, which is searched once for the distinct names of all."""
    x = stage(x.withColumn("row", F.monotonically_increasing_id()))
    each = x.select("row", *QUESTION, "expected", F.posexplode_outer("names").alias("place", "name")).withColumn("low", F.lower("name"))
    wanted = stage(each.filter("low is not null").select("repository_id", F.col("low").alias("name")).distinct())
    pieces = stage(_cycle_pieces(wanted.select("repository_id").distinct(), edges, labels))
    hits = few(stage(contained(wanted, pieces).select("repository_id", F.col("name").alias("low"), F.lit(True).alias("hit"))))
    told = each.join(hits, ["repository_id", "low"], "left").withColumn("hit", F.when(F.col("low").isNotNull(), F.coalesce("hit", F.lit(False))))
    told = told.groupBy("row", *QUESTION, "expected").agg(F.array_sort(F.collect_list(F.struct("place", "name", "hit"))).alias("x"))
    those = lambda keep: F.transform(F.filter("x", keep), lambda s: s["name"])
    return told.select(*QUESTION, "expected", those(lambda s: s["hit"]).alias("found"), those(lambda s: ~s["hit"]).alias("missing"))


def graph_facts(questions: DataFrame, edges: graph.Edges, edge_type: str | None = None) -> DataFrame:
    """(repository_id, question_id, fact, position, node): the neighbours of the node of each hybrid question and, if it has a
    target, the path there.

    Facts are neighbours and path; neighbours have no position. A question without a node, or whose node is unknown, has no facts."""
    edges = graph.prepared(edges, edge_type)
    edges = graph.prepared(stage(edges.edges.select("repository_id", "source", "target"))) if "pairs" not in vars(edges) else edges  # both searches read them
    x = stage(classified(questions).filter("category = 'hybrid' and node is not null").select(*QUESTION, F.col("node").alias("seed"), "target"))
    near = x.select(*QUESTION, "seed").join(graph.dependencies(edges, x), ["repository_id", "seed"])
    near = near.select(*QUESTION, F.lit("neighbours").alias("fact"), F.lit(None).cast("int").alias("position"), "node")
    asked = x.filter("target is not null").select(*QUESTION, "seed", F.col("target").alias("node"))
    paths = asked.join(graph.shortest_paths(asked.select("repository_id", "seed", "node"), edges), ["repository_id", "seed", "node"])
    return near.unionByName(paths.select(*QUESTION, F.lit("path").alias("fact"), F.posexplode("path").alias("position", "node")))


def fact_lines(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """(repository_id, question_id, lines): what a prompt says of the graph for each hybrid question with a node: its neighbours and, if it
    has a target, the path, or that there are none."""
    x = classified(questions).filter("category = 'hybrid' and node is not null")
    listed = facts.groupBy(*QUESTION, "fact").agg(F.array_sort(F.collect_list(F.struct("position", F.col("node").alias("name")))).alias("x"))
    listed = listed.select(*QUESTION, "fact", F.array_join(F.transform("x", lambda s: s["name"]), ", ").alias("names"))
    of = lambda fact: listed.filter(F.col("fact") == fact).select(*QUESTION, F.col("names").alias(fact))
    x = x.join(of("neighbours"), QUESTION, "left").join(of("path"), QUESTION, "left")
    said = lambda c: F.coalesce(c, F.lit("(none found)"))
    first = F.concat(F.lit("Direct dependencies/dependents of "), "node", F.lit(": "), said("neighbours"))
    second = F.concat(F.lit("Dependency path from "), "node", F.lit(" to "), "target", F.lit(": "), said("path"))
    return x.select(*QUESTION, F.concat_ws("\n", first, F.when(F.col("target").isNotNull(), second)).alias("lines"))


def evaluation_run(questions: DataFrame, repositories: DataFrame, nodes: DataFrame, edges: DataFrame, labels: DataFrame, hybrid: DataFrame) -> DataFrame:
    """(repository_id, question_id, expected, actual, found, missing): every question resolved, answered and scored.

    questions: repository_id, question_id, text, expected, hint, entities (array<string> or null); repositories: repository_id,
    status; nodes: see labelled(); labels: see answer_texts(); hybrid: (repository_id, question_id, answer), what a model answered
    to hybrid questions. The hint gives the node. A question of a repository that isn't ready, or a hybrid one without an
    answer, is an error: its actual category is error, and all its entities are missing."""
    ready = repositories.filter("status = 'ready'").select("repository_id").distinct()
    asked = resolved_hints(questions.join(ready, "repository_id", "left_semi"), nodes).withColumnRenamed("id", "node").withColumn("target", F.lit(None).cast("string"))
    asked = stage(asked.select(*QUESTION, "text", "node", "target"))
    kinds = classified(asked).select(*QUESTION, "category")
    told = hybrid.select(*QUESTION, "answer").join(kinds.filter("category = 'hybrid'"), QUESTION, "left_semi")
    edges = graph.prepared(edges)
    x = questions.join(kinds, QUESTION, "left")
    names = F.coalesce("entities", F.array().cast("array<string>"))
    found, missing = entities(F.coalesce("answer", F.lit("")), names)
    scored = lambda df, actual: df.select(*QUESTION, "expected", actual.alias("actual"), found.alias("found"), missing.alias("missing"))
    # the long texts about cycles are searched once for all names, and never stand beside their questions
    about = _named_in_cycles(x.filter("category = 'intelligence'").select(*QUESTION, "expected", names.alias("names")), edges, labels)
    texts = _dependency_texts(classified(asked), edges, labels).unionByName(told)
    rest = x.filter("category is null or category <> 'intelligence'").join(texts, QUESTION, "left")
    rest = scored(rest, F.when(F.col("answer").isNotNull(), F.col("category")).otherwise("error"))
    return rest.unionByName(about.select(*QUESTION, "expected", F.lit("intelligence").alias("actual"), "found", "missing"))


def display_flags(nodes: DataFrame, edges: DataFrame, selected: DataFrame) -> DataFrame:
    """(repository_id, id, in_cycle, related, dimmed) of nodes (repository_id, id) when a node of each repository (repository_id,
    node) is selected: it and its neighbours aren't dimmed. Nothing is dimmed where nothing is selected."""
    inside = graph.cycles(edges).select("repository_id", F.col("node").alias("id")).distinct().withColumn("in_cycle", F.lit(True))
    one = selected.select("repository_id", F.col("node").alias("selected"))
    near = graph.direct(edges).join(one.withColumnRenamed("selected", "node"), ["repository_id", "node"]).select("repository_id", F.col("other").alias("id")).distinct().withColumn("near", F.lit(True))
    x = nodes.select("repository_id", "id").distinct().join(inside, ["repository_id", "id"], "left").join(near, ["repository_id", "id"], "left").join(F.broadcast(one) if one.count() < 100_000 else one, "repository_id", "left")
    off = F.lit(False)
    other = F.coalesce(F.col("id") != F.col("selected"), off)
    related = F.coalesce("near", off) & other
    return x.select("repository_id", "id", F.coalesce("in_cycle", off).alias("in_cycle"), related.alias("related"), (other & ~related).alias("dimmed"))


def hierarchy(nodes: DataFrame, edges: DataFrame, containers: tuple[str, ...] = ("repository", "folder")) -> DataFrame:
    """(repository_id, id, parent, container, role): the parent of each node, the nearest container above it, and what a node without
    a parent is: hierarchy_root (the first by ordinal that has children) or standalone.

    nodes: repository_id, id, type, ordinal; contains edges: repository_id, ordinal, source, target. The last edge gives the parent.
    Nodes under one that is no container belong to the nearest container above; the hierarchy root always is one. Pointers
    double, so a chain of n nodes takes about log2 n rounds; edges in a cycle are an error."""
    key = ["repository_id", "id"]
    parents = edges.groupBy("repository_id", F.col("target").alias("id")).agg(F.max_by("source", "ordinal").alias("parent"))
    above = edges.select("repository_id", F.col("source").alias("id")).distinct().withColumn("has", F.lit(True))
    all_nodes = nodes.select(*key, "type", "ordinal").groupBy(*key).agg(F.min_by("type", "ordinal").alias("type"), F.min("ordinal").alias("ordinal"))
    x = stage(all_nodes.join(parents, key, "left").join(above, key, "left"))
    first = x.filter("parent is null and has").groupBy("repository_id").agg(F.min_by("id", "ordinal").alias("root"))
    role = F.when(F.col("id") == F.col("root"), "hierarchy_root").when(F.col("parent").isNull(), "standalone")
    base = stage(x.join(first, "repository_id", "left").select(*key, "parent", (F.col("type").isin(*containers) | F.coalesce(F.col("id") == F.col("root"), F.lit(False))).alias("holds"), role.alias("role")))
    # a pointer rests on a container, or on nothing above a root
    sure = base.select("repository_id", F.col("id").alias("up"), F.col("holds").alias("fixed"))
    at = base.select(*key, F.col("parent").alias("up")).join(sure, ["repository_id", "up"], "left")
    at = stage(at.select(*key, "up", F.coalesce("fixed", F.lit(True)).alias("fixed")))
    open_ = at.filter("not fixed").count()
    while open_:
        jump = at.select("repository_id", F.col("id").alias("up"), F.col("up").alias("next"), F.col("fixed").alias("then"))
        moved = at.join(jump, ["repository_id", "up"], "left")
        at = stage(moved.select(*key, F.when(~F.col("fixed"), F.col("next")).otherwise(F.col("up")).alias("up"), (F.col("fixed") | F.coalesce("then", F.lit(True))).alias("fixed")))
        open_, before = at.filter("not fixed").count(), open_
        if open_ == before:
            raise ValueError("the contains edges form a cycle")
    return base.join(at.select(*key, F.col("up").alias("container")), key).select(*key, "parent", "container", "role")
