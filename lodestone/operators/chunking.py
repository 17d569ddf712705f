"""Chunking of files by line windows, the gaps between ranges, and the store of chunks. Files are told apart by repository_id and path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalars import language_label
from lodestone.sources.tables import few, stage

FILE = ["repository_id", "path"]


def line_windows(files: DataFrame, window: int = 40, overlap: int = 5) -> DataFrame:
    """files (path, content, ...) with start_line, end_line and chunk, which replace columns of these names; blank files and chunks give none."""
    step = max(window - overlap, 1)
    lines, n, s = F.split("content", "\n", -1), F.size("__lines"), F.col("__start")
    x = files.filter(F.col("content").rlike(r"\S")).withColumn("__lines", lines)
    x = x.withColumn("__start", F.explode(F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))))
    x = x.withColumns({"start_line": s + 1, "end_line": F.least(s + window, n), "chunk": F.array_join(F.slice("__lines", s + 1, window), "\n")})
    return x.filter(F.col("chunk").rlike(r"\S")).drop("__lines", "__start")


def enriched(chunks: DataFrame) -> DataFrame:
    """chunks with content_hash and language."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return chunks.withColumns({"content_hash": F.sha2("chunk", 256), "language": language_label(ext)})


def numbered(chunks: DataFrame) -> DataFrame:
    """chunks (repository_id, path, start_line, end_line, ...) with place: their number within the file, by start and end."""
    return chunks.withColumn("place", F.row_number().over(Window.partitionBy(*FILE).orderBy("start_line", "end_line")))


def coverage_gaps(ranges: DataFrame, files: DataFrame) -> DataFrame:
    """(repository_id, path, gap_start, gap_end): the lines of each file that no range covers; gaps of blank lines alone are left out.

    ranges: repository_id, path, start_line, end_line; files: repository_id, path, content."""
    w = Window.partitionBy(*FILE).orderBy("start_line", "end_line")
    before = F.coalesce(F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = ranges.select(*FILE, (before + 1).alias("gap_start"), (F.col("start_line") - 1).alias("gap_end"))
    lines = files.filter("content is not null").select(*FILE, F.split("content", "\n", -1).alias("__lines"))
    tail = lines.select(*FILE, F.size("__lines").alias("gap_end")).join(ranges.groupBy(*FILE).agg(F.max("end_line").alias("last")), FILE, "left")
    gaps = inner.unionByName(tail.select(*FILE, (F.coalesce("last", F.lit(0)) + 1).alias("gap_start"), "gap_end")).filter("gap_start <= gap_end")
    text = F.slice("__lines", F.col("gap_start"), F.col("gap_end") - F.col("gap_start") + 1)
    return gaps.join(lines, FILE).filter(F.exists(text, lambda line: line.rlike(r"\S"))).select(*FILE, "gap_start", "gap_end")


def new_chunks(batch: DataFrame, target: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Idempotent ingest: the first row of each key, by order, that the target doesn't hold yet. Null keys are keys like others."""
    rest = [c for c in batch.columns if c not in keys]
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")).select(*keys, "__first.*").select(*batch.columns)
    held = target.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return first.join(held, same, "left_anti")


def ingest_counts(batch: DataFrame, target: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row: inserted, and skipped_duplicates (rows of the batch that new_chunks leaves out)."""
    new = new_chunks(batch, target, keys, order).agg(F.count("*").alias("inserted"))
    return batch.agg(F.count("*").alias("__n")).join(F.broadcast(new)).select("inserted", (F.col("__n") - F.col("inserted")).alias("skipped_duplicates"))  # one row each


def with_checkpoint(files: DataFrame, saved: DataFrame, keys: list[str], chunk: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The chunks of all files with `reused`: those saved for their keys if there are any, else chunked anew."""
    # few keys may have very many files, which would meet in a task each if they were shuffled by key
    held, wanted = few(stage(saved.select(*keys).distinct())), few(stage(files.select(*keys).distinct()))
    old = saved.join(wanted, keys, "left_semi").withColumn("reused", F.lit(True))
    return old.unionByName(chunk(files.join(held, keys, "left_anti")).withColumn("reused", F.lit(False)))


def save_checkpoint(path: str, chunks: DataFrame, keys: list[str]) -> None:
    """Appends chunks to a checkpoint folder, laid out by the keys (as a rule repository_id, commit_sha), so one import reads and drops its own."""
    chunks.write.mode("append").partitionBy(*keys).parquet(path)


def drop_checkpoint(path: str, done: DataFrame, keys: list[str]) -> int:
    """Removes from a checkpoint folder the chunks of finished imports, and returns how many partitions went. The rest of the folder isn't read.

    done: the keys of finished imports, whose number is that of imports under way. Their partitions are those that Spark's own writer
    names, so keys of any kind are found: with / or :, empty or null (which Spark lays in one partition)."""
    spark = done.sparkSession
    jvm = spark._jvm
    named = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    removed = 0
    for row in done.select(*[F.col(k).cast("string").alias(k) for k in keys]).distinct().toLocalIterator():
        folder = jvm.org.apache.hadoop.fs.Path(path)
        for k in keys:
            folder = jvm.org.apache.hadoop.fs.Path(folder, named(k, row[k]))
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        removed += bool(fs.exists(folder) and fs.delete(folder, True))
    return removed
