"""Tables that several writers append to at once: a log of commits decides what counts.

A writer puts its rows into folders of its own, then adds the next file of the log, which only one writer can create; who comes second sees what
the first has added and decides anew. Readers take the folders that the log names, so a run that fails leaves nothing that anyone sees.

    path/_log/00000000000000000001.json    {"commit": id, ...}
    path/<table>/commit=<id>/...           Parquet"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _path(spark: SparkSession, path: str):
    out = spark._jvm.org.apache.hadoop.fs.Path(path)
    return out, out.getFileSystem(spark._jsc.hadoopConfiguration())


def log(spark: SparkSession, path: str, after: int = 0) -> list[dict]:
    """The entries of the log with their version, in order; only those later than a version are read."""
    folder, fs = _path(spark, f"{path}/_log")
    if not fs.exists(folder):
        return []
    names = sorted(f.getPath().getName() for f in fs.listStatus(folder))
    late = [n for n in names if n.endswith(".json") and not n.startswith(".") and int(n[:-5]) > after]
    jvm = spark._jvm
    read = lambda p: jvm.org.apache.commons.io.IOUtils.toString(fs.open(p), "UTF-8")
    return [json.loads(read(jvm.org.apache.hadoop.fs.Path(folder, n))) | {"version": int(n[:-5])} for n in late]


def write(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> str:
    """Writes rows that don't count yet; returns the name of their commit."""
    commit = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}/commit={commit}")
    return commit


def add(spark: SparkSession, path: str, version: int, entry: dict) -> bool:
    """Adds an entry as this version; False if another writer has been first.

    The file is complete when it appears: it is written under another name, then linked (local files) or renamed without overwriting, which
    must be atomic, as on HDFS. Stores that can't do that need a log elsewhere."""
    target, fs = _path(spark, f"{path}/_log/{version:020d}.json")
    draft, _ = _path(spark, f"{path}/_log/.{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(draft.toUri().getPath(), target.toUri().getPath())
            return True
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), options)
        return True
    except FileExistsError:
        return False
    except Exception:
        if fs.exists(target):
            return False
        raise
    finally:
        fs.delete(draft, False)


def discard(spark: SparkSession, path: str, tables: list[str], commit: str) -> None:
    """Removes the rows of a commit that was never added."""
    for name in tables:
        folder, fs = _path(spark, f"{path}/{name}/commit={commit}")
        fs.delete(folder, True)


def rows(spark: SparkSession, path: str, name: str, schema: StructType, entries: list[dict]) -> DataFrame:
    """The rows of a table that these entries of the log have added."""
    folders = [f"{path}/{name}/commit={e['commit']}" for e in entries]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)
