"""Source trees as tables of files, and datasets of questions."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.tables import IGNORED, LANGUAGES, scan_filter, stage

#: Bytes of a batch of contents, and entries of folders that a task lists before it hands on the folders that are left.
BATCH, LISTED = 8 << 20, 10_000
_FOUND = "repository_id string, root string, path string, size long, folder boolean"


def _entries(root: str, folder: str) -> Iterator[tuple[str, int, bool]]:
    """(path below the root, size, whether it is a folder) of a folder's entries; links aren't followed. A root with a scheme is read by Arrow's
    file systems, which know HDFS and object stores."""
    place = f"{root}/{folder}" if folder else root
    if "://" in root:
        store, path = fs.FileSystem.from_uri(place)
        for e in store.get_file_info(fs.FileSelector(path)):
            yield f"{folder}/{e.base_name}".lstrip("/"), e.size or 0, e.type == fs.FileType.Directory
        return
    with os.scandir(place) as entries:
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                yield f"{folder}/{e.name}".lstrip("/"), 0, True
            elif e.is_file(follow_symlinks=False):
                yield f"{folder}/{e.name}".lstrip("/"), e.stat(follow_symlinks=False).st_size, False


def _content(root: str, path: str) -> str | None:
    try:
        if "://" in root:
            store, place = fs.FileSystem.from_uri(f"{root}/{path}")
            with store.open_input_stream(place) as f:
                return f.read().decode("utf-8", "replace")
        with open(f"{root}/{path}", "rb") as f:
            return f.read().decode("utf-8", "replace")
    except OSError:
        return None


def listing(spark: SparkSession, roots: dict[str, str], ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(repository_id, root, path, size) of the files with a kept extension below each root; ignored and dotted folders aren't entered.

    Folders are a frontier that is dealt over all tasks. A task lists its folders and what is below them until it has met `LISTED` entries; the
    folders that are left are the next frontier, so a large tree is listed by many tasks and a small one in a single round."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, met = [], 0
        for b in batches:
            for repository, root, path in zip(*(b[c].to_pylist() for c in ("repository_id", "root", "path")), strict=True):
                todo = [path]
                while todo:
                    if met >= LISTED:
                        out += [(repository, root, p, 0, True) for p in todo]
                        break
                    for p, size, folder in _entries(root, todo.pop()):
                        met += 1
                        name = p.rpartition("/")[2]
                        if folder and name not in ignored and not name.startswith("."):
                            todo.append(p)
                        elif not folder and os.path.splitext(name)[1].lower() in LANGUAGES:
                            out.append((repository, root, p, size, False))
                        if len(out) >= 10_000:
                            yield rows(out)
                            out = []
        yield rows(out)

    def rows(found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["repository_id", "root", "path", "size", "folder"])

    front = spark.createDataFrame([(k, v.rstrip("/") or "/", "") for k, v in roots.items()], "repository_id string, root string, path string").repartition(max(1, len(roots)), "repository_id")
    found = None
    while True:
        now = stage(front.mapInArrow(listed, _FOUND))
        found = now if found is None else found.unionByName(now)
        front = now.filter("folder").select("repository_id", "root", "path")
        if front.isEmpty():
            return found.filter(~F.col("folder")).drop("folder")
        front = front.repartition(F.xxhash64("root", "path"))


def scan(spark: SparkSession, roots: dict[str, str], most_bytes: int, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(repository_id, path, ext, size, content) of source trees; roots: repository_id -> folder, which all executors see, or its URI.

    See listing() for how trees are listed. Files are dealt over all tasks by path, and contents are read in tasks in bounded
    batches. Files whose names start with _ or . are read like others. Bytes that aren't UTF-8 become U+FFFD; a file that can't be read at all has
    a null content; a folder that can't be listed fails the job."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, held, texts = 0, 0, []
            for i, (root, path, size) in enumerate(zip(b["root"].to_pylist(), b["path"].to_pylist(), b["size"].to_pylist(), strict=True)):
                texts.append(_content(root, path))
                held += size
                if held >= BATCH or i == b.num_rows - 1:
                    part = b.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([part[c] for c in ("repository_id", "path", "ext", "size")] + [pa.array(texts, pa.string())], names=["repository_id", "path", "ext", "size", "content"])
                    start, held, texts = i + 1, 0, []

    dealt = scan_filter(listing(spark, roots, ignored), most_bytes, ignored).repartition("repository_id", "path")
    return dealt.mapInArrow(read, "repository_id string, path string, ext string, size long, content string")


def readable(files: DataFrame) -> DataFrame:
    """The files with a content: those that couldn't be read drop out, and the import goes on."""
    return files.filter(F.col("content").isNotNull())


def accepted(files: DataFrame, most: int) -> DataFrame:
    """(repository_id, n_files, rejected): a repository of more than `most` files is rejected as a whole."""
    return files.groupBy("repository_id").agg(F.count("*").alias("n_files")).withColumn("rejected", F.col("n_files") > most)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, repository_id, text, expected, hint, entities) of a dataset in JSON lines."""
    return spark.read.schema("question_id string, repository_id string, text string, expected string, hint string, entities array<string>").json(path)
