"""Governed publishing of knowledge graphs: candidates get identities, are deduplicated, checked and published by commit.

Candidate nodes: repository_id, ordinal, type, parts (array<string>), label, file_path, producer, certainty.
Candidate edges: repository_id, ordinal, type, source_type, source_parts, target_type, target_parts, producer, certainty.
Ordinals order the candidates of a repository; tiers() gives them to several tables, one after another."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions.scalars import canonical_path, edge_id, node_id
from lodestone.operators import graph
from lodestone.sources import commits
from lodestone.sources.tables import few, stage

CERTAINTIES = ("deterministic", "inferred")
#: The producer and the label of a root that the engine adds (fixed value).
ROOT_PRODUCER, ROOT_LABEL = "pipeline", "Repository"


def containment(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folder and file nodes, and contains edges from each parent, of files (repository_id, path)."""
    x = files.select("repository_id", F.split(canonical_path(F.col("path")), "/").alias("p"))
    x = x.select("repository_id", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("i"))
    path = F.array_join(F.slice("p", 1, F.col("i")), "/")
    kind = lambda i: F.when(i == F.size("p"), "file:").otherwise("folder:")
    up = F.array_join(F.slice("p", 1, F.col("i") - 1), "/")
    parent = F.when(F.col("i") == 1, F.concat(F.lit("repository:"), "repository_id")).otherwise(F.concat(F.lit("folder:"), up))
    x = x.select("repository_id", F.concat(kind(F.col("i")), path).alias("id"), F.element_at("p", F.col("i")).alias("label"), parent.alias("parent")).distinct()
    nodes = x.select("repository_id", "id", F.substring_index("id", ":", 1).alias("type"), "label").distinct()
    edges = x.select("repository_id", edge_id(F.col("parent"), F.lit("contains"), F.col("id")).alias("id"), F.col("parent").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("type"))
    return nodes, edges


def symbols(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the named classes, methods and functions of chunks (repository_id, path, kind, name), and contains edges from their files."""
    x = chunks.filter(F.col("kind").isin("class", "method", "function") & (F.length("name") > 0))
    file, symbol = node_id(F.lit("file"), F.array("path")), node_id(F.col("kind"), F.array("path", "name"))
    x = x.select("repository_id", symbol.alias("id"), F.col("kind").alias("type"), F.col("name").alias("label"), "path", file.alias("file")).distinct()
    edges = x.select("repository_id", edge_id(F.col("file"), F.lit("contains"), F.col("id")).alias("id"), F.col("file").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("type"))
    return x.drop("file"), edges


def tiers(*candidates: DataFrame) -> DataFrame:
    """The candidates of several producers, those of an earlier table first; a table may be empty and may lack columns.

    Each has its own ordinals (long), which stay in order within it; columns that a table lacks are null."""
    step = F.lit(1 << 48).cast("long")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [c.withColumn("ordinal", F.col("ordinal").cast("long") + F.lit(i) * step) for i, c in enumerate(candidates)])


def govern(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One winner for each id: deterministic first, then the lowest ordinal; verified if several producers agree.

    candidates: the keys, ordinal, certainty, source (the producer) and any other columns; one shuffle, with partial results
    before it, so an id with very many candidates isn't gathered."""
    rest = [c for c in candidates.columns if c not in keys]
    order = F.struct(F.when(F.col("certainty") == "deterministic", 0).otherwise(1), F.col("ordinal"))
    best = F.min_by(F.struct(*rest), order).alias("__winner")
    x = candidates.groupBy(*keys).agg(best, F.coalesce(F.min("source") < F.max("source"), F.lit(False)).alias("__verified"))
    return x.select(*keys, "__winner.*", F.col("__verified").alias("verified"))


def node_ids(candidates: DataFrame) -> DataFrame:
    """candidates with `id`; null where the type is unknown or a part is missing."""
    return candidates.withColumn("id", node_id(F.col("type"), F.col("parts")))


def edge_ends(candidates: DataFrame) -> DataFrame:
    """Candidate edges with id, source and target from the identities of their ends; null where an end has none."""
    x = candidates.withColumns({"source": node_id(F.col("source_type"), F.col("source_parts")), "target": node_id(F.col("target_type"), F.col("target_parts"))})
    return x.withColumn("id", edge_id(F.col("source"), F.col("type"), F.col("target")))


def with_roots(candidates: DataFrame, repositories: DataFrame) -> DataFrame:
    """Candidate nodes with a root for each repository (repository_id), before all others."""
    root = repositories.select("repository_id").distinct()
    root = root.select(
        "repository_id", F.lit(-1).cast("long").alias("ordinal"), F.lit("repository").alias("type"), F.array(F.col("repository_id").cast("string")).alias("parts"),
        F.lit(ROOT_LABEL).alias("label"), F.lit(None).cast("string").alias("file_path"), F.lit(ROOT_PRODUCER).alias("producer"), F.lit("deterministic").alias("certainty"),
    )
    return root.unionByName(candidates.withColumn("ordinal", F.col("ordinal").cast("long")), allowMissingColumns=True)


def identified(candidates: DataFrame, ends: bool) -> DataFrame:
    """The governed nodes, or edges with both ends, of candidates; those without an identity are left out, see rejected()."""
    return _winners((edge_ends if ends else node_ids)(candidates), ends)


def _winners(x: DataFrame, ends: bool) -> DataFrame:
    """identified() of candidates that have their identities."""
    keys = ["repository_id", "id"]
    drop = ["parts", "source_parts", "target_parts", "source_type", "target_type"]
    x = x.filter(F.col("id").isNotNull()).drop(*drop)
    # the source of an edge is a node, so the producer goes by another name until the winner is known
    named = x.withColumnsRenamed({"source": "__from"} if ends else {}).withColumnRenamed("producer", "source")
    return govern(named, keys).withColumnRenamed("source", "producer").withColumnsRenamed({"__from": "source"} if ends else {})


def rejected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repository_id, kind, ordinal, type): candidates without an identity."""
    return _lost(node_ids(nodes), edge_ends(edges))


def _lost(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rejected() of candidates that have their identities."""
    lost = lambda df, kind: df.filter("id is null").select("repository_id", F.lit(kind).alias("kind"), F.col("ordinal").cast("long").alias("ordinal"), "type")
    return lost(nodes, "node").unionByName(lost(edges, "edge"))


def violations(nodes: DataFrame, edges: DataFrame, commits: DataFrame, governed: bool = False) -> DataFrame:
    """(repository_id, invariant, subject) of the eight checks of a graph, for each repository of commits (repository_id, commit_sha).

    missing_source and missing_target: an edge without that end; orphan_edge: an edge without one or both; node_certainty and
    edge_certainty: neither deterministic nor inferred, or null; duplicate_node and duplicate_edge: one row for each further
    occurrence of an id; root_count: not one root (subject: how many); commit: a blank or null commit (no subject);
    orphan_node: a node that the root doesn't reach in either direction, unless there is no root.

    Ends and ways to the root are checked by repository, see graph.checked(). governed: nodes and edges come from identified(), so no id occurs again."""
    row = lambda df, name, subject: df.select("repository_id", F.lit(name).alias("invariant"), subject.cast("string").alias("subject"))
    out = [graph.checked(nodes, edges)]
    for df, kind in ((nodes, "node"), (edges, "edge")):
        unsure = df.filter(~F.coalesce(F.col("certainty").isin(*CERTAINTIES), F.lit(False)))
        out.append(row(unsure, f"{kind}_certainty", F.col("id")))
        if not governed:
            extra = df.groupBy("repository_id", "id").count().filter("count > 1").withColumn("nth", F.explode(F.sequence(F.lit(2), F.col("count").cast("int"))))
            out.append(row(extra, f"duplicate_{kind}", F.col("id")))
    named = commits.select("repository_id", F.lit(0).alias("root"), F.coalesce(F.regexp_like("commit_sha", F.lit(r"\S")), F.lit(False)).alias("named"))
    roots = nodes.select("repository_id", F.coalesce((F.col("type") == "repository").cast("int"), F.lit(0)).alias("root"), F.lit(False).alias("named"))
    every = stage(named.unionAll(roots).groupBy("repository_id").agg(F.sum("root").alias("n"), F.max("named").alias("named")))
    out += [row(every.filter("n <> 1"), "root_count", F.col("n")), row(every.filter("not named"), "commit", F.lit(None))]
    return reduce(DataFrame.unionByName, out)


def message(invariant: Column, subject: Column) -> Column:
    """The reason that a failed graph is published with."""
    texts = {
        "missing_source": "edge {} has no source node", "missing_target": "edge {} has no target node", "orphan_edge": "edge {} lacks an end", "node_certainty": "node {} has no valid certainty",
        "edge_certainty": "edge {} has no valid certainty", "duplicate_node": "node id {} occurs again", "duplicate_edge": "edge id {} occurs again", "root_count": "{} roots instead of one",
        "orphan_node": "node {} can't be reached from the root", "commit": "no commit", "identity": "candidate {} has no identity",
    }
    out = F.lit(None).cast("string")
    for name, text in texts.items():
        out = F.when(invariant == name, F.replace(F.lit(text), F.lit("{}"), F.coalesce(subject, F.lit("")))).otherwise(out)
    return out


#: Repositories whose hashes are broadcast at most, 8 bytes each.
HASHES = 10_000_000


def _chosen(new: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Leaves the candidates of other repositories than those in new out before any shuffle. A repository whose hash is that of one in new may
    stay; what is made of it is joined with new, or with what came of it, later."""
    if new.count() > HASHES:
        return lambda df: df.join(new.select("repository_id"), "repository_id", "left_semi")
    hashes = F.broadcast(new.select(F.xxhash64("repository_id").alias("__hash")).distinct())
    return lambda df: df.filter("repository_id is not null").join(hashes, F.xxhash64("repository_id") == F.col("__hash"), "left_semi")


def publish(repositories: DataFrame, held: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The versions (repository_id, commit_sha, status, n_nodes, n_edges, n_violations), the nodes and edges of ready
    ones, and the violations (repository_id, commit_sha, invariant, subject, message) of failed ones.

    repositories: (repository_id, commit_sha) to publish, one commit each; held: those that are published already; nodes and
    edges: candidates. A commit that is held is already_exists, and nothing of it is looked at. A graph with a violation,
    or with a candidate that has no identity, is failed and has no nodes and edges."""
    keys = ["repository_id", "commit_sha"]
    asked = stage(repositories.select(*keys).distinct().join(held.select(*keys).distinct().withColumn("old", F.lit(True)), keys, "left"))
    new = few(asked.filter("old is null").select(*keys))  # a row for each repository
    only = _chosen(new)
    n, e = stage(node_ids(with_roots(only(nodes), new))), stage(edge_ends(only(edges)))  # read several times
    found_n, found_e = stage(_winners(n, False)), stage(_winners(e, True))
    no_name = _lost(n, e).select("repository_id", F.lit("identity").alias("invariant"), F.concat_ws(" ", "kind", F.col("ordinal").cast("string")).alias("subject"))
    bad = stage(violations(found_n, found_e, new, governed=True).unionByName(no_name).join(new, "repository_id"))
    counts = lambda df, name: df.groupBy("repository_id").agg(F.count("*").alias(name))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    x = asked.join(counts(bad, "v"), "repository_id", "left").join(counts(found_n, "n"), "repository_id", "left").join(counts(found_e, "e"), "repository_id", "left")
    status = F.when(F.col("old"), "already_exists").when(F.col("v") > 0, "failed").otherwise("ready")
    versions = x.select(*keys, status.alias("status"), "n", "e", "v")
    kept = lambda c: F.when(F.col("status") == "ready", zero(F.col(c))).otherwise(F.lit(0))
    versions = stage(versions.select(*keys, "status", kept("n").alias("n_nodes"), kept("e").alias("n_edges"), F.when(F.col("status") == "failed", zero(F.col("v"))).otherwise(0).alias("n_violations")))
    ready = few(versions.filter("status = 'ready'").select(*keys))
    reasons = bad.select(*keys, "invariant", "subject", message(F.col("invariant"), F.col("subject")).alias("message"))
    return versions, found_n.join(ready, "repository_id"), found_e.join(ready, "repository_id"), reasons


#: Tables of the append-only store.
TABLES = ("graph_versions", "graph_nodes", "graph_edges", "graph_violations")


VERSION = "repository_id string, commit_sha string, status string, n_nodes long, n_edges long, n_violations long, created_at timestamp"


def published(spark: SparkSession, path: str, name: str = TABLES[0], schema: str | StructType | None = None) -> DataFrame:
    """A table of the store at `path`: the rows that its log of commits names. schema: that of the rows; by default that of the versions, or of
    what is there."""
    entries = commits.log(spark, path)
    if schema is None and name != TABLES[0] and entries:
        schema = spark.read.parquet(f"{path}/{name}/commit={entries[0]['commit']}").schema
    if not isinstance(schema, StructType):
        schema = StructType.fromDDL(schema or VERSION)
    return commits.rows(spark, path, name, schema, entries)


def publish_to(path: str, repositories: DataFrame, nodes: DataFrame, edges: DataFrame, tries: int = 20) -> DataFrame:
    """publish() against what the store at `path` holds, and appends the results to it; returns the versions.

    Any number of writers may run at once. Each adds its rows as one commit of the log, so readers see all of them or none. A writer that finds its
    place in the log taken looks at what was added there: if that has none of its commits, it takes the next place, else it drops its
    rows and begins anew, and what another has published is already_exists."""
    spark = repositories.sparkSession
    keys = ["repository_id", "commit_sha"]
    for _ in range(tries):
        seen = commits.log(spark, path)
        version = seen[-1]["version"] if seen else 0
        parts = publish(repositories, commits.rows(spark, path, TABLES[0], StructType.fromDDL(VERSION), seen), nodes, edges)
        new = parts[0].filter("status <> 'already_exists'").withColumn("created_at", F.current_timestamp())
        if new.isEmpty():
            return parts[0]
        mine = commits.write(spark, path, dict(zip(TABLES, (new, *parts[1:]), strict=True)))
        for _ in range(tries):
            if commits.add(spark, path, version + 1, {"commit": mine, "tables": list(TABLES)}):
                return parts[0]
            later = commits.log(spark, path, version)
            version = later[-1]["version"]
            theirs = commits.rows(spark, path, TABLES[0], StructType.fromDDL(VERSION), later)
            if not new.join(theirs.select(*keys), keys, "left_semi").isEmpty():
                break
        commits.discard(spark, path, list(TABLES), mine)
    raise RuntimeError(f"the log at {path} was always taken")


def latest_ready(versions: DataFrame) -> DataFrame:
    """The latest ready version of each repository; versions: repository_id, commit_sha, status, created_at; ties to the larger commit."""
    x = versions.filter("status = 'ready'").groupBy("repository_id").agg(F.max(F.struct("created_at", "commit_sha")).alias("v"))
    return x.select("repository_id", "v.commit_sha", "v.created_at")


def graph_of(repositories: DataFrame, versions: DataFrame) -> DataFrame:
    """repositories (repository_id) with the commit and status of their graph: that of the latest ready version, else not_generated."""
    x = repositories.select("repository_id").distinct().join(latest_ready(versions), "repository_id", "left")
    return x.select("repository_id", "commit_sha", F.when(F.col("commit_sha").isNull(), "not_generated").otherwise("ready").alias("status"))
