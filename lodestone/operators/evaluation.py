"""Scores of answers, import plans and stage times."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from lodestone.functions.scalars import normal_url
from lodestone.sources.tables import dealt, few, stage

#: Bytes of a long text that are searched at once, and names that they are searched for together.
BLOCK, NAMES = 1_000_000, 200_000


def entities(answer: Column, expected: Column) -> tuple[Column, Column]:
    """The expected names that the answer contains, whatever the case, and those it doesn't."""
    low = F.lower(answer)
    return F.filter(expected, lambda e: low.contains(F.lower(e))), F.filter(expected, lambda e: ~low.contains(F.lower(e)))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(repository_id, name) of the names that a block of text holds, from rows (repository_id, block, part, at, value) in this order: the names of
    a block come first, without a place, then the pieces of its text."""
    unit, names, text = None, {}, []

    def rows() -> Iterator[pa.RecordBatch]:
        whole = b"".join(text)
        found = sorted({w for n, some in names.items() for i in range(len(whole) - n + 1) if (w := whole[i : i + n]) in some})
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([unit[0]] * len(found), kind), pa.array(found, pa.binary())], names=["repository_id", "name"])

    for batch in batches:
        kind = batch.schema.field("repository_id").type
        for *key, at, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != unit:
                yield from rows()
                unit, names, text = key, {}, []
            if at is None:
                names.setdefault(len(value), set()).add(value)
            else:
                text.append(value)
    yield from rows()


def contained(names: DataFrame, pieces: DataFrame) -> DataFrame:
    """names (repository_id, name), distinct, that the text of their repository contains, as they are written.

    pieces: (repository_id, at, piece), a text cut anywhere, with the place of each piece's first byte. Both are staged. A text is searched in blocks of
    `BLOCK` bytes, which share an end as long as the longest name, for `NAMES` names at a time: a window of each length that names have moves along
    it, so work grows with the texts and not with texts times names."""
    sized = names.select("repository_id", F.col("name").cast("binary").alias("value"))
    longest = sized.agg(F.max(F.octet_length("value"))).first()[0] or 0
    step, end = max(BLOCK, longest), F.col("at") + F.octet_length("piece") - 1
    first, last = F.greatest(F.floor((F.col("at") - longest + 1) / step), F.lit(0)), F.floor(end / step)
    cut = pieces.filter(F.octet_length("piece") > 0)
    blocks = few(stage(cut.groupBy("repository_id").agg((F.max(last) + 1).alias("blocks"))))
    parts = few(stage(sized.groupBy("repository_id").agg(F.ceil(F.count("*") / NAMES).alias("parts"))))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    cut = cut.join(parts, "repository_id").withColumn("block", F.explode(F.sequence(first, last))).withColumn("part", each("parts"))
    unit = ["repository_id", "block", "part", "at"]
    text = cut.select(*unit[:3], F.col("at").cast("long").alias("at"), F.col("piece").cast("binary").alias("value"))
    wanted = sized.join(blocks, "repository_id").join(parts, "repository_id").withColumn("part", F.pmod(F.xxhash64("value"), "parts")).withColumn("block", each("blocks"))
    wanted = wanted.select(*unit[:3], F.lit(None).cast("long").alias("at"), "value")
    kind = StructType([StructField("repository_id", names.schema["repository_id"].dataType), StructField("name", BinaryType())])
    found = dealt(text.unionByName(wanted), *unit[:3]).sortWithinPartitions(*unit).mapInArrow(_found, kind)
    return found.select("repository_id", F.col("name").cast("string").alias("name")).distinct()


def report(results: DataFrame) -> DataFrame:
    """One row: n, routing_accuracy and entity_recall (0 without rows, or without names), of results (correct, found, missing)."""
    n = F.size("found") + F.size("missing")
    recall = F.avg(F.when(n > 0, F.size("found") / n))
    return results.agg(F.count("*").alias("n"), F.coalesce(F.round(F.avg(F.col("correct").cast("int")), 6), F.lit(0.0)).alias("routing_accuracy"), F.coalesce(F.round(recall, 6), F.lit(0.0)).alias("entity_recall"))


def by_category(results: DataFrame) -> DataFrame:
    """(expected, total, correct, accuracy) of results (expected, actual)."""
    hit = F.count_if(F.col("expected") == F.col("actual"))
    return results.groupBy("expected").agg(F.count("*").alias("total"), hit.alias("correct"), F.round(hit / F.count("*"), 6).alias("accuracy"))


def confusion(results: DataFrame) -> DataFrame:
    """(expected, actual, n); error is an actual value like others."""
    return results.groupBy("expected", "actual").agg(F.count("*").alias("n"))


def import_plan(requests: DataFrame, repositories: DataFrame, jobs: DataFrame) -> DataFrame:
    """requests (owner, url) with repository_id and action: create, reuse (has a job, didn't fail) or restart.

    repositories: repository_id, owner, url, status. jobs: repository_id. Addresses meet in their normal form; of several
    repositories of one owner and address the smallest repository_id counts."""
    has = jobs.select("repository_id").distinct().withColumn("__has_job", F.lit(True))
    known = repositories.select("owner", normal_url(F.col("url")).alias("__url"), "repository_id", "status").join(has, "repository_id", "left")
    known = known.groupBy("owner", "__url").agg(F.min(F.struct("repository_id", "status", "__has_job")).alias("r"))
    x = requests.withColumn("__url", normal_url(F.col("url"))).join(known, ["owner", "__url"], "left")
    reuse = (F.col("r.status") != "failed") & F.col("r.__has_job")
    action = F.when(F.col("r").isNull(), "create").when(reuse, "reuse").otherwise("restart")
    return x.select("owner", "url", "r.repository_id", action.alias("action"))


def stage_seconds(events: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, stage, seconds, share): time from each event to the next of its key, by stage, and its share of the key's time."""
    nxt = F.lead("ts").over(Window.partitionBy(key).orderBy("ts", "event_id"))
    spent = F.unix_micros(nxt.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    by = events.select(key, "stage", spent.alias("us")).filter("us is not null").groupBy(key, "stage").agg(F.sum("us").alias("us"))
    total = F.sum("us").over(Window.partitionBy(key))  # a few stages
    return by.select(key, "stage", F.round(F.col("us") / 1e6, 3).alias("seconds"), F.round(F.col("us") / F.nullif(total, F.lit(0)), 6).alias("share"))


def stage_times(events: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, n_stages, total_seconds, bottleneck): time from each event to the next, by stage; ties go to the first name."""
    nxt = F.lead("ts").over(Window.partitionBy(key).orderBy("ts", "event_id"))
    spent = F.unix_micros(nxt.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    by = events.select(key, "stage", spent.alias("us")).filter("us is not null").groupBy(key, "stage").agg(F.sum("us").alias("us"))
    longest = F.min_by("stage", F.struct(-F.col("us"), "stage"))
    return by.groupBy(key).agg(F.count("*").alias("n_stages"), F.round(F.sum("us") / 1e6, 3).alias("total_seconds"), longest.alias("bottleneck"))


def sanitised(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with an id, a type, a label and a known certainty; edges with an id, a type and a known certainty whose two ends are
    among them; and (repository_id, n_nodes, n_edges, n_contains, dropped_nodes, dropped_edges).

    nodes: repository_id, id, type, label, certainty; edges: repository_id, id, source, target, type, certainty. Empty ids and types
    are missing ones; an empty label is a label. The contains edges are the edges of that type."""
    sure = F.coalesce(F.col("certainty").isin("deterministic", "inferred"), F.lit(False))
    there = lambda *names: reduce(lambda a, b: a & b, [F.coalesce(F.length(c) > 0, F.lit(False)) for c in names])
    good = nodes.filter(there("id", "type") & F.col("label").isNotNull() & sure)
    ids = good.select("repository_id", "id").distinct()
    kept = edges.filter(there("id", "type", "source", "target") & sure)
    for end in ("source", "target"):
        kept = kept.join(ids.withColumnRenamed("id", end), ["repository_id", end], "left_semi")
    one = lambda df, name, keep=F.lit(True): df.groupBy("repository_id").agg(F.count_if(keep).alias(name))
    counts = one(nodes, "__nodes")
    for df in (one(edges, "__edges"), one(good, "n_nodes"), one(kept, "n_edges"), one(kept, "n_contains", F.col("type") == "contains")):
        counts = counts.join(df, "repository_id", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return good, kept, counts.select("repository_id", *[zero(c).alias(c) for c in ("n_nodes", "n_edges", "n_contains")], (zero("__nodes") - zero("n_nodes")).alias("dropped_nodes"), (zero("__edges") - zero("n_edges")).alias("dropped_edges"))


def write_report(path: str, results: DataFrame) -> DataFrame:
    """Writes the report of results (question_id, expected, actual, found, missing) as JSON folders summary, categories, confusion
    and results below path, and returns the summary."""
    summary = report(results.withColumn("correct", F.col("expected").eqNullSafe(F.col("actual"))))
    for name, df in (("summary", summary), ("categories", by_category(results)), ("confusion", confusion(results)), ("results", results)):
        df.write.mode("overwrite").json(f"{path}/{name}")
    return summary
