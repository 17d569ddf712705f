"""Listings, ownership and counts of repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalars import normal_url

#: States of a repository whose import is under way (fixed values).
IN_PROGRESS = ("queued", "cloning", "parsing", "embedding")
READY, FAILED = "ready", "failed"


def in_progress(status: Column) -> Column:
    return status.isin(*IN_PROGRESS)


def listing(repositories: DataFrame) -> DataFrame:
    """repositories (owner, created_at, status, ...) with in_progress and place: 1 for the newest of each owner, and so on."""
    w = Window.partitionBy("owner").orderBy(F.desc("created_at"), F.desc("repository_id"))
    return repositories.withColumns({"in_progress": in_progress(F.col("status")), "place": F.row_number().over(w)})


def found(rows: DataFrame, **keys) -> DataFrame:
    """The rows with these values, such as repository_id=7 or owner="o", url=...; a filter, so a scan of a table that is laid out by
    the keys reads only their part. None finds rows without a value."""
    out = rows
    for name, value in keys.items():
        out = out.filter(F.col(name).eqNullSafe(F.lit(value)))
    return out


def by_owner(repositories: DataFrame, owners: DataFrame) -> DataFrame:
    """The repositories of some owners (owner)."""
    return repositories.join(owners.select("owner").distinct(), "owner", "left_semi")


def owned(requests: DataFrame, repositories: DataFrame) -> DataFrame:
    """requests (owner, url) with repository_id and found: whether the owner has a ready repository of that address. One that
    belongs to another owner, or isn't ready, isn't found. Of several the smallest repository_id counts."""
    ready = repositories.filter(F.col("status") == READY).groupBy("owner", normal_url(F.col("url")).alias("__url")).agg(F.min("repository_id").alias("repository_id"))
    x = requests.withColumn("__url", normal_url(F.col("url"))).join(ready, ["owner", "__url"], "left")
    return x.drop("__url").withColumn("found", F.col("repository_id").isNotNull())


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """(repository_id, n_chunks, n_paths)."""
    by_path = chunks.groupBy("repository_id", "path").agg(F.count("*").alias("n"))  # paths are counted before they meet
    return by_path.groupBy("repository_id").agg(F.sum("n").alias("n_chunks"), F.count("path").alias("n_paths"))


def type_rollup(nodes: DataFrame) -> DataFrame:
    """(repository_id, type, n, n_ids): nodes and distinct ids by repository and type, with the totals; null stands for all."""
    by_id = nodes.groupBy("repository_id", "type", "id").agg(F.count("*").alias("n"))
    totals = by_id.rollup("repository_id", "type").agg(F.sum("n").alias("n"), F.count_distinct("id").alias("n_ids"))
    return totals.select("repository_id", "type", "n", "n_ids")
