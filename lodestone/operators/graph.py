"""Algorithms over edge tables (repository_id, source, target, and type where one is asked for).

Nodes of different repositories never meet, even if their names are equal; the null repository is one of its own. `edge_type` restricts an algorithm to edges of
that type. Searches run inside components: connected components are labelled first, and those of up to `LOCAL` edges are
dealt to tasks, several small ones or a part of the seeds of one at a time, so a task's work is bounded. Larger components
are searched by rounds of joins, one for each step away from the seeds; both ways give the same rows. Where only the nodes are
asked for, not how far they are, cycles of larger components are condensed first, and sets of 64 seeds go along the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from lodestone.operators import local
from lodestone.sources.tables import few, stage

#: Edges of a component that a task takes at most, rows of results for which a task is made, and edges of stars that one task joins.
LOCAL, CELLS, STARS = 2_000_000, 1_000_000, 1_000_000
#: Copies of a component's edges that its seeds are dealt over at most, and edges for which a task is made where no seeds are asked for.
COPIES, SHARE = 32, 250_000
#: Rounds of a search between two stagings of all that it has found, and rows of a round that are broadcast.
FOLD, SMALL = 16, 10_000
#: Edges of a graph from which paths between two nodes go by rounds first, how many of those there are, and rows that a round may have for each
#: edge and question; what they leave open is searched inside components.
FIRST, ROUNDS, WIDE = 250_000, 24, 2
#: Seeds that are numbered together, nodes of a cycle or a component that meet a row together, and seeds that meet those.
BUCKET, MEMBERS, ASKERS = 4096, 10_000, 100
#: Between a repository and a node in the name of a node of all repositories.
MARK = "\u0001"
#: Stands for the null repository in such a name.
NO_REPOSITORY = "\u0002"


def of_type(edges: DataFrame, edge_type: str | None) -> DataFrame:
    return edges if edge_type is None else edges.filter(F.col("type") == edge_type)


def _named(node: str) -> Column:
    return F.concat(F.coalesce(F.col("repository_id").cast("string"), F.lit(NO_REPOSITORY)), F.lit(MARK), F.col(node))


def _split(df: DataFrame, kind: DataType, nodes: list[str], rest: list = ()) -> DataFrame:
    """repository_id and plain names instead of the names of all repositories; no name is null."""
    plain = lambda c: F.expr(f"substr(`{c}`, locate('{MARK}', `{c}`) + 1)").alias(c)
    return df.select(F.nullif(F.substring_index(nodes[0], MARK, 1), F.lit(NO_REPOSITORY)).cast(kind).alias("repository_id"), *map(plain, nodes), *rest)


class Prepared:
    """Edges of a type (None: of all types) with the components of their nodes, which several algorithms share.

    Every algorithm takes one in place of its edges. pairs: distinct edges (a, b) between names of all repositories, without
    those that lack an end; labels: see labels_of; inside: the pairs with their component; sizes: (component, n_edges, n_nodes)."""

    def __init__(self, edges: DataFrame, edge_type: str | None = None):
        self.edges, self.kind = of_type(edges, edge_type), edges.schema["repository_id"].dataType

    @cached_property
    def pairs(self) -> DataFrame:
        x = self.edges.select(_named("source").alias("a"), _named("target").alias("b"))
        return stage(x.filter("a is not null and b is not null").distinct())

    @cached_property
    def labels(self) -> DataFrame:
        return labels_of(self.pairs)

    @cached_property
    def inside(self) -> DataFrame:
        labels = self.labels.withColumnRenamed("node", "a")
        return stage(self.pairs.join(labels, "a", "left").select("a", "b", F.coalesce("label", "a").alias("component")))

    @cached_property
    def sizes(self) -> DataFrame:
        n_edges = self.inside.groupBy("component").agg(F.count("*").alias("n_edges"))
        n_nodes = self.labels.groupBy(F.col("label").alias("component")).agg(F.count("*").alias("n_nodes"))
        return stage(n_edges.join(n_nodes, "component", "left").select("component", "n_edges", F.coalesce("n_nodes", F.lit(1)).alias("n_nodes")))

    def turned(self) -> Prepared:
        """The same with each edge the other way."""
        out = Prepared.__new__(Prepared)
        swap = {"a": F.col("b"), "b": F.col("a")}
        out.edges = self.edges.withColumns({"source": F.col("target"), "target": F.col("source")})
        out.kind, out.labels, out.sizes = self.kind, self.labels, self.sizes
        out.pairs, out.inside = self.pairs.withColumns(swap), self.inside.withColumns(swap)
        return out


Edges = DataFrame | Prepared


def prepared(edges: Edges, edge_type: str | None = None) -> Prepared:
    return edges if isinstance(edges, Prepared) else Prepared(edges, edge_type)


def direct(edges: Edges, edge_type: str | None = None) -> DataFrame:
    """(repository_id, node, other, direction), distinct."""
    x = prepared(edges, edge_type).edges
    a = x.select("repository_id", F.col("source").alias("node"), F.col("target").alias("other"), F.lit("outgoing").alias("direction"))
    b = x.select("repository_id", F.col("target").alias("node"), F.col("source").alias("other"), F.lit("incoming").alias("direction"))
    return a.unionByName(b).distinct()


def degrees(edges: Edges, edge_type: str | None = None) -> DataFrame:
    """(repository_id, node, fan_out, fan_in); a self-loop counts as outgoing only."""
    x = prepared(edges, edge_type).edges
    a = x.select("repository_id", F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    b = x.filter("source <> target").select("repository_id", F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return a.unionAll(b).groupBy("repository_id", "node").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))


def first_relations(edges: Edges, most: int = 8, edge_type: str | None = None) -> DataFrame:
    """direct() with a rank: the first relations of each node in each direction, in the order of the other's name."""
    w = Window.partitionBy("repository_id", "node", "direction").orderBy("other")
    return direct(edges, edge_type).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


# Components


def _stars(batches: Iterator[pa.RecordBatch], roots: bool = False) -> Iterator[pa.RecordBatch]:
    """For each node of up to `STARS` edges at a time, an edge to the smallest node that they connect it with; that node is
    left out itself, unless roots are wanted as well."""

    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        names, (a, b) = local.numbered(*(t[c].combine_chunks() for c in ("a", "b")))
        root = local.least_labels(len(names), a, b)
        moved = np.arange(len(names)) if roots else np.flatnonzero(root != np.arange(len(names)))
        col = lambda i: names.take(pa.array(i)).cast(pa.string())
        return pa.RecordBatch.from_arrays([col(moved), col(root[moved])], names=["a", "b"])

    now, n = [], 0
    for b in batches:
        now.append(b)
        n += b.num_rows
        if n >= STARS:
            yield done(now)
            now, n = [], 0
    if now:
        yield done(now)


def labels_of(pairs: DataFrame) -> DataFrame:
    """(node, label): the smallest node of its component, for each node of staged pairs (a, b) with an edge to another.

    Tasks first reduce their edges to stars. While many are left, nodes that come after all their neighbours in the order of a hash follow one of
    them and leave, so a third of the nodes of a chain leave in a round, and all rounds together cost a few times the first. One task
    joins what remains, and those that left take the label of the node that they followed."""
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("name"))
    stars, left = stage(pairs.filter("a <> b").select("a", "b").mapInArrow(_stars, "a string, b string")), []
    while stars.limit(STARS + 1).count() > STARS:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(order("b")).alias("first"), F.max(order("b")).alias("last"))
        gone = stage(near.filter(order("a") > F.col("last")).select(F.col("a").alias("node"), F.col("first.name").alias("to")))
        left.append(gone)
        for c in ("a", "b"):  # one end of an edge leaves at most
            stars = stars.join(gone.select(F.col("node").alias(c), "to").hint("merge"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        stars = stage(stars.filter("a <> b").select("a", "b").distinct().mapInArrow(_stars, "a string, b string"))
    one = stars.coalesce(1).mapInArrow(lambda b: _stars(b, True), "a string, b string")
    labels = stage(one.select(F.col("a").alias("node"), F.col("b").alias("label")))
    if not left:
        return labels
    for gone in reversed(left):
        back = stage(gone.join(labels.select(F.col("node").alias("to"), "label").hint("merge"), "to", "left"))
        # one that was followed may have had no edge left
        ends = back.filter("label is null").select(F.col("to").alias("node"), F.col("to").alias("label")).distinct()
        labels = labels.unionByName(back.select("node", F.coalesce("label", "to").alias("label"))).unionByName(ends)
    labels = stage(labels)
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    return stage(labels.join(least.hint("merge"), "label").select("node", F.col("least").alias("label")))


def _placed(g: Prepared) -> DataFrame:
    """(component, node) of the nodes of edges, by their names of all repositories."""
    nodes = g.pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(g.labels, "node", "left").select(F.coalesce("label", "node").alias("component"), "node")


def components(edges: Edges, edge_type: str | None = None) -> DataFrame:
    """(repository_id, component, node) of the nodes of edges, whatever their direction; named by the smallest node."""
    g = prepared(edges, edge_type)
    return _split(_placed(g), g.kind, ["component", "node"])


# Searches from seeds


def _units(asked: DataFrame, graph: Prepared, together: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (g, kind, a, b) of the groups that tasks search: edges (kind 0) and what is asked (kind 1); and the edges and
    the questions of the components that are too large for that. A group has some components, or one and some of its seeds.

    asked: (a, b) seeds and targets, staged; the target is null for a search of everything. together: how many seeds share the steps of a
    search, so that fewer of them aren't worth a copy of their component's edges."""
    inside, sizes = graph.inside, graph.sizes
    where = inside.select(F.explode(F.array("a", "b")).alias("a"), "component").distinct()
    seeds = stage(asked.join(where, "a"))
    # the rows that a component's searches give, or pass at least
    work = F.greatest(F.col("n_edges"), F.col("n_seeds") * F.col("n_nodes"))
    busy = seeds.select("component", "a").distinct().groupBy("component").agg(F.count("*").alias("n_seeds")).join(sizes, "component")
    # seeds rarely reach all of their component, so work is far above what they find: a copy of the edges for each CELLS of it would outgrow the searches
    chunks = F.least(F.ceil(work / CELLS), F.ceil(F.col("n_seeds") / together), F.lit(COPIES)).cast("int")
    busy = stage(busy.withColumn("chunks", chunks).withColumn("work", work))
    total = busy.filter(F.col("n_edges") <= LOCAL).agg(F.sum(F.col("work") + F.col("chunks") * F.col("n_edges"))).first()[0] or 0
    n = int(max(1, total // CELLS))
    group = lambda chunk: F.pmod(F.xxhash64("component", chunk), F.lit(n)).alias("g")
    fits = busy.filter(F.col("n_edges") <= LOCAL).select("component", "chunks")
    dealt = fits.select("component", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).select("component", group(F.col("chunk"))).distinct()
    edges = inside.join(dealt, "component").select("g", F.lit(0).alias("kind"), "a", "b")
    mine = seeds.join(fits, "component").withColumn("chunk", F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int"))
    mine = mine.select(group(F.col("chunk")), F.lit(1).alias("kind"), "a", "b")
    large = busy.filter(F.col("n_edges") > LOCAL).select("component")
    far = inside.join(large, "component", "left_semi").select("a", "b"), seeds.join(large, "component", "left_semi").select("a", "b")
    return edges.unionByName(mine), *far


def _tables(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Array, tuple[list[int], list[int]], list[tuple[int, int]]]:
    """The names of a group, the targets of its edges (see local.rows_of), and what is asked."""
    t = pa.Table.from_batches(list(batches)).combine_chunks()
    names, (a, b) = local.numbered(t["a"].combine_chunks(), t["b"].combine_chunks())
    edge = t["kind"].to_numpy() == 0
    flat, start = local.rows_of(len(names), a[edge], b[edge])
    return names, (flat.tolist(), start.tolist()), list(zip(a[~edge].tolist(), b[~edge].tolist(), strict=True))


def _reach_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of reach(), split into repositories and plain names, each name once."""
    t = pa.Table.from_batches(list(batches)).combine_chunks()
    names, (a, b) = local.numbered(t["a"].combine_chunks(), t["b"].combine_chunks())
    edge = t["kind"].to_numpy() == 0
    parts = pc.list_flatten(pc.split_pattern(names.cast(pa.string()), MARK, max_splits=1))
    repository, plain = parts.take(pa.array(np.arange(0, len(parts), 2))), parts.take(pa.array(np.arange(1, len(parts), 2)))
    found = local.reached(*local.rows_of(len(names), a[edge], b[edge]), np.unique(a[~edge]))
    for seed, node, depth in found:
        for i in range(0, len(seed), 100_000):
            k = slice(i, i + 100_000)
            of = pa.array(seed[k])
            yield pa.RecordBatch.from_arrays([repository.take(of), plain.take(of), plain.take(pa.array(node[k])), pa.array(depth[k], pa.int32())], names=["repository_id", "seed", "node", "depth"])


def _paths_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, to, asked = _tables(batches)
    kind = pa.schema([("seed", pa.string()), ("node", pa.string()), ("path", pa.list_(pa.string()))])
    by: dict[int, set[int]] = {}
    for s, t in asked:
        by.setdefault(s, set()).add(t)
    now, n = [], 0

    def rows() -> pa.RecordBatch:
        flat = names.take(pa.array(np.concatenate(now))).cast(pa.string())
        ends = np.cumsum([0, *map(len, now)])
        path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        return pa.RecordBatch.from_arrays([flat.take(pa.array(ends[:-1])), flat.take(pa.array(ends[1:] - 1)), path], schema=kind)

    for s, targets in by.items():
        for path in local.shortest(*to, s, None if -1 in targets else targets):
            now.append(np.array(path))
            n += len(path)
            if n >= 100_000:
                yield rows()
                now, n = [], 0
    if now:
        yield rows()


def _front(df: DataFrame) -> tuple[DataFrame, bool]:
    """A staged table for a join, and whether it has rows. Spark would broadcast a far larger one, in each round anew and by the driver."""
    n = df.count()
    return (F.broadcast(df) if n <= SMALL else df.hint("merge")), n > 0


def _reach_far(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """(seed, node, depth) by rounds of joins."""
    front = stage(asked.select(F.col("a").alias("seed"), F.col("a").alias("node"), F.lit(0).alias("depth")).distinct())
    seen, depth = front, 0
    while (met := _front(front))[1]:
        depth += 1
        new = pairs.hint("merge").withColumnRenamed("a", "node").join(met[0], "node").select("seed", F.col("b").alias("node")).distinct()
        front = stage(new.join(seen.hint("merge"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(front)
        seen = stage(seen) if depth % FOLD == 0 else seen
    return seen


def _paths_far(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """(seed, node, path) by rounds of joins, until every seed has met its targets."""
    asked = stage(asked.select(F.col("a").alias("seed"), F.col("b").alias("node")).distinct())
    front = stage(asked.select("seed", F.col("seed").alias("node"), F.array("seed").alias("path")).distinct())
    seen, rounds = front, 0
    while True:
        open_ = asked.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").select("seed").distinct()
        front = front.join(open_, "seed", "left_semi")
        new = front.join(pairs.withColumnRenamed("a", "node"), "node").groupBy("seed", F.col("b").alias("node")).agg(F.min("path").alias("path"))
        new = new.join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        front = stage(new.select("seed", "node", F.concat("path", F.array("node")).alias("path")))
        if front.isEmpty():
            break
        seen, rounds = seen.unionByName(front), rounds + 1
        seen = stage(seen) if rounds % FOLD == 0 else seen
    some = asked.filter("node is not null")
    return seen.join(asked.filter("node is null").select("seed").distinct(), "seed", "left_semi").unionByName(seen.join(some, ["seed", "node"], "left_semi")).distinct()


def _leaner(pairs: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The n pairs without those that begin where none ends, and their number: after k calls, the ones that a k-th step may have led to."""
    out = stage(pairs.join(pairs.select(F.col("b").alias("a")).distinct().hint("merge"), "a", "left_semi").select("a", "b"))
    return out, out.count()


def _paths_first(pairs: DataFrame, n: int, asked: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(seed, node, path) of what is asked of n pairs, by rounds of joins without components, and the questions (a, b) that are left open, if any.

    Most paths that are asked for are short or end soon, so no task needs a whole component for them. A round is one step of all seeds that still
    miss a target; pairs that later steps can't use leave meanwhile. A round that grows too wide, or one after `ROUNDS`, isn't taken."""
    pairs = pairs.filter("a <> b").select("a", "b")
    found = asked.filter("a = b").select(F.col("a").alias("seed"), F.col("b").alias("node"), F.array("a").alias("path"))
    open_ = stage(asked.filter("a <> b").select(F.col("a").alias("seed"), F.col("b").alias("node")))
    front = stage(open_.select("seed", F.col("seed").alias("node"), F.array("seed").alias("path")).distinct())
    seen, most, rounds, last = front, WIDE * (n + open_.count()), 0, 0
    rows = lambda df, path, old, wanted: df.select("seed", "node", path.alias("path"), F.lit(old).alias("old"), F.lit(wanted).alias("wanted"))
    none = F.lit(None).cast("array<string>")
    while (size := front.count()) and size <= most and rounds < ROUNDS:
        front = F.broadcast(front) if size <= SMALL else front.hint("merge")
        met = pairs.join(front.withColumnRenamed("node", "a"), "a").select("seed", F.col("b").alias("node"), "path")
        # one shuffle tells what is new, what was met before and what is asked for
        every = rows(met, F.col("path"), False, False).unionAll(rows(seen, none, True, False)).unionAll(rows(open_, none, False, True))
        every = every.groupBy("seed", "node").agg(F.min("path").alias("path"), F.max("old").alias("old"), F.max("wanted").alias("wanted"))
        at = stage(every.select("seed", "node", F.when(~F.col("old"), F.concat("path", F.array("node"))).alias("path"), "old", "wanted"))
        found = found.unionByName(at.filter("wanted and path is not null").select("seed", "node", "path"))
        open_ = at.filter("wanted and path is null").select("seed", "node")
        live = open_.select("seed").distinct()
        front = stage(at.filter("path is not null").select("seed", "node", "path").join(live, "seed", "left_semi"))
        seen = at.filter("old or path is not null").select("seed", "node").join(live, "seed", "left_semi")
        rounds += 1
        if n > SHARE and (not last or n < 0.8 * last):
            last = n
            pairs, n = _leaner(pairs, n)
    return found, open_.join(front.select("seed").distinct(), "seed", "left_semi").select(F.col("seed").alias("a"), F.col("node").alias("b")) if size else None


def _alone(asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """What is asked of seeds without an edge."""
    return asked.join(pairs.select(F.explode(F.array("a", "b")).alias("a")).distinct(), "a", "left_anti")


def _closure_far(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """(seed, node) of all that seeds reach, themselves included, by rounds of joins over the graph of its cycles.

    A cycle is one node, so no round goes around it. Seeds are numbered in blocks of 64, those of a cycle side by side, and a row says which of a
    block have reached a node: they share each step over an edge, and pass it on only while it is new."""
    pairs = stage(pairs.filter("a <> b"))
    cycle = stage(_cycles_far(pairs).select("node", F.col("cycle_id").alias("g")))
    at = few(cycle)
    group = lambda df, c: df.join(at.select(F.col("node").alias(c), F.col("g").alias("__g")), c, "left").withColumn(c, F.coalesce("__g", c)).drop("__g")
    dag = stage(group(group(pairs, "a"), "b").filter("a <> b").distinct())
    seeds = asked.select(F.col("a").alias("g"), F.col("a").alias("seed")).distinct()
    bucket = F.pmod(F.xxhash64("seed"), F.lit(-(-seeds.count() // BUCKET) or 1))
    row = F.row_number().over(Window.partitionBy("bucket").orderBy("g", "seed")) - 1
    seeds = group(seeds, "g").withColumn("bucket", bucket).withColumn("row", row)
    seeds = stage(seeds.select("seed", "g", F.struct("bucket", F.floor(F.col("row") / 64).alias("part")).alias("block"), (F.col("row") % 64).alias("bit")))
    united = lambda df: df.groupBy("block", "g").agg(F.bit_or("bits").alias("bits"))
    front = stage(united(seeds.select("block", "g", F.expr("shiftleft(1L, bit)").alias("bits"))))
    seen, rounds = front, 0
    while not front.isEmpty():
        met = united(front.join(dag.withColumnRenamed("a", "g"), "g").select("block", F.col("b").alias("g"), "bits"))
        new = met.join(united(seen).withColumnRenamed("bits", "had"), ["block", "g"], "left")
        front = stage(new.select("block", "g", F.expr("bits & ~coalesce(had, 0L)").alias("bits")).filter("bits <> 0"))
        seen, rounds = seen.unionByName(front), rounds + 1
        seen = stage(united(seen)) if rounds % FOLD == 0 else seen
    # the nodes of large cycles are dealt, so no task takes all of one
    parts = few(stage(cycle.groupBy("g").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")).filter("parts > 1")))
    members = cycle.join(parts, "g", "left").select("g", "node", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).alias("part"))
    dealt = united(seen).join(parts, "g", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1)))
    rows = dealt.join(members, ["g", "part"], "left").select("block", "bits", F.coalesce("node", "g").alias("node"))
    blocks = seeds.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("bit", "seed"))), lambda x: x["seed"]).alias("seeds"))
    rows = rows.join(few(stage(blocks)), "block")
    return rows.select(F.explode(F.expr("filter(seeds, (x, i) -> (shiftrightunsigned(bits, i) & 1L) = 1L)")).alias("seed"), "node")


def _search(seeds: DataFrame, g: Prepared, far: Callable[[DataFrame, DataFrame], DataFrame], rest: list[str]) -> DataFrame:
    """Seeds, the nodes that they reach, and the columns of the rest; components that are too large for a task go by `far`."""
    asked = stage(seeds.select(_named("seed").alias("a"), F.lit(None).cast("string").alias("b")).filter("a is not null").distinct())
    near, pairs, far_asked = _units(asked, g, local.TOGETHER)
    found = near.groupBy("g").applyInArrow(_reach_locally, "repository_id string, seed string, node string, depth int")
    found = found.select(F.nullif("repository_id", F.lit(NO_REPOSITORY)).cast(g.kind).alias("repository_id"), "seed", "node", *rest)
    alone = _alone(asked, g.pairs).select(F.col("a").alias("seed"), F.col("a").alias("node"), F.lit(0).alias("depth"))
    found = found.unionByName(_split(alone, g.kind, ["seed", "node"], rest))
    return found if far_asked.isEmpty() else found.unionByName(_split(far(pairs, far_asked), g.kind, ["seed", "node"], rest))


def reach(seeds: DataFrame, edges: Edges, edge_type: str | None = None) -> DataFrame:
    """(repository_id, seed, node, depth): all nodes reached from each seed (repository_id, seed) along edges, with the
    fewest steps; the seed has depth 0, even on a cycle or without an edge."""
    return _search(seeds, prepared(edges, edge_type), _reach_far, ["depth"])


def closure(seeds: DataFrame, edges: Edges, edge_type: str | None = None) -> DataFrame:
    """(repository_id, seed, node): reach() without the steps, for which cycles of large components needn't be walked."""
    return _search(seeds, prepared(edges, edge_type), _closure_far, [])


def shortest_paths(asked: DataFrame, edges: Edges, edge_type: str | None = None) -> DataFrame:
    """(repository_id, seed, node, path): the nodes of a shortest path, both ends included, for each row of asked
    (repository_id, seed, node) whose node the seed reaches; a null node stands for all nodes. Of several shortest
    paths the first in the order of the nodes counts. A node's path to itself is itself.

    In graphs of over `FIRST` edges, paths to a node are searched by rounds first; components are labelled only for what is open then."""
    g = prepared(edges, edge_type)
    named = stage(asked.select(_named("seed").alias("a"), _named("node").alias("b")).filter("a is not null").distinct())
    n, found = g.pairs.count(), []
    if n > FIRST:
        every = named.filter("b is null")
        some = stage(named.filter("b is not null").join(every.select("a"), "a", "left_anti"))
        if not some.isEmpty():
            done, left = _paths_first(g.pairs, n, some)
            found, named = [done], every if left is None else stage(every.unionByName(left))
    if not found or not named.isEmpty():
        near, far, far_asked = _units(named, g)
        found.append(near.groupBy("g").applyInArrow(_paths_locally, "seed string, node string, path array<string>"))
        found.append(_alone(named, g.pairs).filter("b is null or a = b").select(F.col("a").alias("seed"), F.col("a").alias("node"), F.array("a").alias("path")).distinct())
        if not far_asked.isEmpty():
            found.append(_paths_far(far, far_asked))
    plain = F.transform("path", lambda x: F.element_at(F.split(x, MARK, 2), 2)).alias("path")
    return _split(reduce(DataFrame.unionByName, found), g.kind, ["seed", "node"], [plain])


# Cycles


def _cycles_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(list(batches)).combine_chunks()
    names, (a, b) = local.numbered(t["a"].combine_chunks(), t["b"].combine_chunks())
    root = local.cyclic(len(names), a, b)
    some = np.flatnonzero(np.bincount(root, minlength=len(names))[root] > 1)
    col = lambda i: names.take(pa.array(i)).cast(pa.string())
    yield pa.RecordBatch.from_arrays([col(root[some]), col(some)], names=["cycle_id", "node"])


def _spread(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """The smallest label that reaches each node (node, label) along pairs; labels only fall, so this ends."""
    while True:
        best = pairs.join(labels.withColumnRenamed("node", "a").hint("merge"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("got"))
        new = stage(labels.join(best, "node", "left").select("node", F.least("label", F.coalesce("got", "label")).alias("new"), "label"))
        labels = new.select("node", F.col("new").alias("label"))
        if new.filter("new <> label").isEmpty():
            return labels


def _cycles_far(left: DataFrame) -> DataFrame:
    """(cycle_id, node) of the strongly connected components of several nodes, by rounds of joins over pairs (a, b).

    Nodes without a way in or out are trimmed. Then the smallest label spreads forward; within a label the nodes that
    reach its owner are a component. Found components leave, until none is left. Labels start with a hash, so a chain
    of many components loses many in a round, whatever the order of their names. No search stops before its end."""
    found: DataFrame | None = None
    name = lambda c: F.concat(F.hex(F.xxhash64(c)), F.lit(":"), F.col(c))
    left = stage(left)
    while True:
        n = left.count()
        while n > LOCAL:  # trimming
            left = stage(left.join(left.select(F.col("a").alias("b")).distinct().hint("merge"), "b", "left_semi").join(left.select(F.col("b").alias("a")).distinct().hint("merge"), "a", "left_semi"))
            n, before = left.count(), n
            if n == before:
                break
        if not n:
            break
        if n <= LOCAL:  # a task takes what is left
            rest = left.coalesce(1).mapInArrow(_cycles_locally, "cycle_id string, node string")
            rest = rest.select(F.col("cycle_id").alias("seed"), "node")
            found = rest if found is None else found.unionByName(rest)
            break
        nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        colour = _spread(nodes.withColumn("label", name("node")), left)
        inside = left.join(colour.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(colour.select(F.col("node").alias("b"), F.col("label").alias("y")), "b").filter("x = y")
        inside = stage(inside.select("a", "b", F.col("x").alias("seed")))
        front = stage(colour.filter(F.col("label") == name("node")).select(F.col("label").alias("seed"), "node"))
        scc, rounds = front, 0
        while True:  # backwards from the owner of the label
            new = inside.join(front.withColumnRenamed("node", "b"), ["b", "seed"]).select("seed", F.col("a").alias("node")).distinct()
            front = stage(new.join(scc, ["seed", "node"], "left_anti"))
            if front.isEmpty():
                break
            scc, rounds = scc.unionByName(front), rounds + 1
            scc = stage(scc) if rounds % FOLD == 0 else scc
        scc = stage(scc)
        found = scc if found is None else stage(found.unionByName(scc))
        gone = scc.select("node")
        left = stage(left.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti"))
    if found is None:
        return left.select(F.col("a").alias("cycle_id"), F.col("b").alias("node"))
    named = found.groupBy("seed").agg(F.count("*").alias("n"), F.min("node").alias("cycle_id")).filter("n > 1")
    return found.join(named, "seed").select("cycle_id", "node")


def _trimmed(g: Prepared) -> Prepared:
    """The same without edges that begin where none ends or end where none begins: those are in no cycle. Goes on while many leave, so what is left
    to label is often a small part."""
    out = Prepared.__new__(Prepared)
    out.edges, out.kind, out.pairs = g.edges, g.kind, g.pairs.filter("a <> b").select("a", "b")
    n, before = out.pairs.count(), 0
    while n > SHARE and (not before or n < 0.8 * before):
        ends = lambda c, of: out.pairs.select(F.col(c).alias(of)).distinct().hint("merge")
        out.pairs = stage(out.pairs.join(ends("b", "a"), "a", "left_semi").join(ends("a", "b"), "b", "left_semi").select("a", "b"))
        n, before = out.pairs.count(), n
    return out


def cycles(edges: Edges, edge_type: str | None = None) -> DataFrame:
    """(repository_id, cycle_id, node): strongly connected components of several nodes or a self-loop; cycle_id is the smallest member."""
    g = prepared(edges, edge_type)
    loops = g.pairs.filter("a = b").select(F.col("a").alias("cycle_id"), F.col("a").alias("node"))
    if "labels" not in vars(g):  # no other algorithm has labelled all edges
        g = _trimmed(g)
    total, most = g.sizes.agg(F.sum("n_edges"), F.max("n_edges")).first()
    n = int(max(1, (total or 0) // SHARE))
    ways = g.inside.filter("a <> b")
    large = g.sizes.filter(F.col("n_edges") > LOCAL).select("component")
    fits = ways.join(large, "component", "left_anti") if (most or 0) > LOCAL else ways
    found = fits.select(F.pmod(F.xxhash64("component"), F.lit(n)).alias("g"), "a", "b").groupBy("g").applyInArrow(_cycles_locally, "cycle_id string, node string")
    if (most or 0) > LOCAL:
        found = found.unionByName(_cycles_far(ways.join(large, "component", "left_semi").select("a", "b")))
    found = stage(found)
    return _split(found.unionByName(loops.join(found, "node", "left_anti").select("cycle_id", "node")), g.kind, ["cycle_id", "node"])


#: Nodes and edges of a repository that a task checks as a whole at most, and those of several for which a task is made.
WHOLE = 500_000


def _checked_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of checked() of whole repositories, from rows (repository_id, kind, a, b, id): nodes (kind 0), roots (1) and edges (2)."""
    parts = list(batches)
    if not parts:
        return
    t = pa.Table.from_batches(parts).combine_chunks()
    of = t["repository_id"].combine_chunks().dictionary_encode()
    repo, kind = of.indices.to_numpy().astype(np.int64), t["kind"].to_numpy()
    names = pa.concat_arrays([t[c].combine_chunks().cast(pa.large_string()) for c in "ab"]).dictionary_encode()
    code = pc.fill_null(names.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    known, placed = np.unique(np.tile(repo, 2)[code >= 0] * max(len(names.dictionary), 1) + code[code >= 0], return_inverse=True)
    at = np.full(2 * len(repo), -1)
    at[code >= 0] = placed
    a, b = at[: len(repo)], at[len(repo) :]
    edge = kind == 2
    node = ~edge & (a >= 0)
    there = np.zeros(len(known) + 1, bool)  # the last stands for null
    there[a[node]] = True
    lacks = {"missing_source": edge & ~there[a], "missing_target": edge & ~there[b]}
    both = edge & (a >= 0) & (b >= 0)
    label = local.least_labels(len(known), a[both], b[both])
    least: dict[int, tuple[str, int]] = {}
    roots = np.flatnonzero(node & (kind == 1))
    for r, name, i in zip(repo[roots].tolist(), t["a"].combine_chunks().take(pa.array(roots)).to_pylist(), a[roots].tolist(), strict=True):
        least[r] = min(least.get(r, (name, i)), (name, i))
    reached = np.full(len(of.dictionary), -1)
    reached[list(least)] = label[[i for _, i in least.values()]] if least else -1
    loose = np.flatnonzero(node & (reached[repo] >= 0))
    loose = loose[label[a[loose]] != reached[repo[loose]]]
    loose = loose[np.unique(a[loose], return_index=True)[1]]
    lost = np.flatnonzero(lacks["missing_source"] | lacks["missing_target"])
    ids = t["id"].combine_chunks().take(pa.array(lost)).dictionary_encode()
    each = repo[lost] * (len(ids.dictionary) + 1) + pc.fill_null(ids.indices, -1).to_numpy(zero_copy_only=False) + 1
    found = [(name, "id", np.flatnonzero(x)) for name, x in lacks.items()] + [("orphan_edge", "id", lost[np.unique(each, return_index=True)[1]]), ("orphan_node", "a", loose)]
    for name, column, rows in found:
        for k in range(0, len(rows), 100_000):
            i = pa.array(rows[k : k + 100_000])
            values = [t["repository_id"].combine_chunks().take(i), pa.array([name] * len(i)), t[column].combine_chunks().take(i).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(values, names=["repository_id", "invariant", "subject"])


def checked(nodes: DataFrame, edges: Edges) -> DataFrame:
    """(repository_id, invariant, subject) of what a repository's nodes (repository_id, id, type) and edges (repository_id, id, source, target) lack.

    missing_source and missing_target: an edge without that end; orphan_edge: an edge without one or both, once for each id; orphan_node: a node that
    the root doesn't reach in either direction, once; edges whose ends are no nodes connect as well, and of several roots the first by name counts.

    Repositories of up to `WHOLE` nodes and edges are shuffled once and checked as a whole, many in a task; larger ones by joins."""
    edges = prepared(edges).edges
    edges = edges.select("repository_id", F.col("id").cast("string").alias("id") if "id" in edges.columns else F.lit(None).cast("string").alias("id"), "source", "target")
    none = F.lit(None).cast("string")
    points = nodes.select("repository_id", F.when(F.col("type") == "repository", 1).otherwise(0).alias("kind"), F.col("id").alias("a"), none.alias("b"), none.alias("id"))
    rows = points.unionByName(edges.select("repository_id", F.lit(2).alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), "id")).filter("repository_id is not null")
    sizes = stage(rows.groupBy("repository_id").agg(F.count("*").alias("n")))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    large = F.broadcast(sizes.filter(F.col("n") > WHOLE).select("repository_id"))  # fewer than all rows / WHOLE
    far = (most or 0) > WHOLE
    small = rows.join(large, "repository_id", "left_anti") if far else rows
    kind = StructType([StructField("repository_id", rows.schema["repository_id"].dataType), StructField("invariant", StringType()), StructField("subject", StringType())])
    found = small.repartition(int(max(1, (total or 0) // WHOLE)), "repository_id").mapInArrow(_checked_locally, kind)
    found = found.unionByName(_lacking(nodes.limit(0), edges.filter("repository_id is null")))  # it has no nodes
    if not far:
        return found
    of = lambda df: df.join(large, "repository_id", "left_semi")
    lost = _lacking(of(nodes), of(edges))
    return found.unionByName(lost).unionByName(_orphans_far(of(nodes), of(edges)).select("repository_id", F.lit("orphan_node").alias("invariant"), F.col("id").alias("subject")))


def _lacking(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of checked() about edges, by a join of their ends with the nodes."""
    end = lambda c: F.struct(F.lit(f"missing_{c}").alias("invariant"), F.col(c).alias("end"))
    ends = edges.select("repository_id", "id", F.explode(F.array(end("source"), end("target"))).alias("x")).select("repository_id", "id", "x.*")
    lost = stage(ends.join(nodes.select("repository_id", F.col("id").alias("end")), ["repository_id", "end"], "left_anti").select("repository_id", "invariant", F.col("id").alias("subject")))
    return lost.unionByName(lost.select("repository_id", F.lit("orphan_edge").alias("invariant"), "subject").distinct())


def orphans(nodes: DataFrame, edges: Edges) -> DataFrame:
    """(repository_id, id): nodes that the root doesn't reach in either direction; a repository without a root has none. See checked()."""
    return checked(nodes, edges).filter("invariant = 'orphan_node'").select("repository_id", F.col("subject").alias("id"))


def _orphans_far(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """orphans() by the components of all edges."""
    roots = few(stage(nodes.filter(F.col("type") == "repository").groupBy("repository_id").agg(F.min("id").alias("root"))))
    rooted = nodes.join(roots, "repository_id").select("repository_id", "id", "root", _named("id").alias("node"))
    x = stage(rooted.join(prepared(edges).labels, "node", "left").select("repository_id", "id", "root", "label"))
    reached = few(stage(x.filter(F.col("id") == F.col("root")).select("repository_id", F.col("label").alias("reached")).distinct()))  # a row for each root
    x = x.filter(F.col("id") != F.col("root")).join(reached, "repository_id", "left")
    return x.filter(~F.coalesce(F.col("label") == F.col("reached"), F.lit(False))).select("repository_id", "id").distinct()


# Algorithms by name

DIRECTIONS, MODES = ("outgoing", "incoming", "both"), ("direct", "transitive", "path")


def dependencies(edges: Edges, seeds: DataFrame, direction: str = "both", mode: str = "direct", edge_type: str | None = None) -> DataFrame:
    """(repository_id, seed, node): what each seed (repository_id, seed) depends on, is depended on by, or either; the seed itself
    isn't among them, unless it is a direct neighbour of itself. For mode path see shortest_paths."""
    if direction not in DIRECTIONS or mode not in MODES[:2]:
        raise ValueError(f"direction must be one of {DIRECTIONS} and mode one of {MODES}")
    seeds, g = seeds.select("repository_id", "seed").filter("seed is not null").distinct(), prepared(edges, edge_type)
    if mode == "direct":
        # the neighbours of seeds alone are made distinct
        ways = {"outgoing": ("source", "target"), "incoming": ("target", "source")}
        ways = [g.edges.select("repository_id", F.col(a).alias("seed"), F.col(b).alias("node")) for way, (a, b) in ways.items() if direction in ("both", way)]
        return reduce(DataFrame.unionByName, ways).join(seeds, ["repository_id", "seed"]).distinct()
    if direction == "both":  # the rest of the component
        at = _placed(g)
        mine = stage(seeds.select(_named("seed").alias("seed")).filter("seed is not null").join(at.withColumnRenamed("node", "seed"), "seed"))
        busy = mine.groupBy("component").agg(F.ceil(F.count("*") / ASKERS).cast("int").alias("q")).join(g.sizes, "component")
        busy = few(stage(busy.select("component", "q", F.ceil(F.col("n_nodes") / MEMBERS).cast("int").alias("p"))))
        # seeds and nodes of a component are dealt, and each part of one meets each of the other
        dealt = lambda df, c, mine, other: df.join(busy, "component").withColumns({f"{mine}s": F.pmod(F.xxhash64(c), mine), f"{other}s": F.explode(F.sequence(F.lit(0).cast("long"), F.col(other).cast("long") - 1))}).drop("p", "q")
        x = dealt(mine, "seed", "q", "p").join(dealt(at, "node", "p", "q"), ["component", "ps", "qs"]).filter("seed <> node")
        return _split(x, g.kind, ["seed", "node"])
    return closure(seeds, g if direction == "outgoing" else g.turned()).filter("seed <> node").select("repository_id", "seed", "node")


def _dependency_analysis(nodes: DataFrame, edges: DataFrame, params: DataFrame | None = None, mode: str = "direct", direction: str = "both", edge_type: str | None = None) -> DataFrame:
    if params is None:
        raise ValueError("dependency-analysis needs params: repository_id and seed, and node for mode path")
    if mode == "path":
        return shortest_paths(params, edges, edge_type)
    return dependencies(edges, params, direction, mode, edge_type)


#: name -> (nodes, edges, params, ...) -> DataFrame
ALGORITHMS: dict[str, Callable[..., DataFrame]] = {
    "cycle-detection": lambda nodes, edges, edge_type="imports": cycles(edges, edge_type),
    "dependency-analysis": _dependency_analysis,
    "degree-profile": lambda nodes, edges, edge_type=None: degrees(edges, edge_type),
    "orphans": lambda nodes, edges: orphans(nodes, edges),
}


def run_algorithm(name: str, nodes: DataFrame, edges: DataFrame, **params) -> DataFrame:
    """Runs an algorithm by its name; an unknown name is an error that lists the names there are."""
    if name not in ALGORITHMS:
        raise KeyError(f"unknown algorithm {name!r}; there are {', '.join(sorted(ALGORITHMS))}")
    return ALGORITHMS[name](nodes, edges, **params)
