"""Reading tables and staging intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Extensions of source files that are kept, with their labels (fixed values).
LANGUAGES = {
    ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".py": "Python",
    ".go": "Go", ".rs": "Rust", ".java": "Java", ".rb": "Ruby", ".php": "PHP", ".c": "C", ".cpp": "C++", ".cs": "C#",
    ".json": "JSON", ".yaml": "YAML", ".yml": "YAML", ".md": "Markdown",
}
#: Directories that hold no sources (fixed values); dotted ones are left out besides.
IGNORED = ("node_modules", ".git", "dist", "build", ".next", "vendor", "__pycache__", ".venv", "venv", "target")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only for a local master."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at a path; empty while nothing has been written there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path)


#: Folders that this process has staged, for release(): the session's application, the scope that was open, and the path.
_STAGED: list[tuple[str, int, str]] = []
_SCOPES: list[int] = []


def stage(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and rereads it: computed once, lineage cut, and any executor can read it
    again after another was lost. The table is laid out by the columns `by`, so a filter on them reads only its part.
    It stays until release() or the end of its scope(), because DataFrames that are returned still read it."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    _STAGED.append((df.sparkSession.sparkContext.applicationId, _SCOPES[-1] if _SCOPES else 0, path))
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a small table that is broadcast.
FEW = 100_000


def few(df: DataFrame) -> DataFrame:
    """A staged table, broadcast in joins as long as it has up to FEW rows: the other side then isn't shuffled, whatever its keys hold."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


#: Rows after which a Parquet writer first looks how large a page is, and bytes of its dictionary at most.
CHECKED, DICTIONARY = 10, 256_000_000


def lean_pages(spark: SparkSession, column: str, longest: int) -> None:
    """Settings of the session's Parquet writers for a column with values of up to `longest` bytes, where a user has set none; nothing for short ones.

    By default a page has 100 rows before its size is looked at, and several copies of them are held, for each task; values over 1 MB have no dictionary, so
    equal ones are written again and again; and each is compared with the least and the greatest, which aren't kept at such lengths. The settings stay,
    because the DataFrames that operators return are written later."""
    needed = {"parquet.page.size.row.check.min": CHECKED, "parquet.dictionary.page.size": min(4 * longest, DICTIONARY), f"parquet.column.statistics.enabled#{column}": "false"}
    if 4 * longest > 1 << 20:
        for key, value in needed.items():
            if spark.conf.get(key, None) is None:
                spark.conf.set(key, str(value))


def _remove(spark: SparkSession, paths: list[str]) -> int:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)


def release(spark: SparkSession) -> int:
    """Removes the tables that this application has staged outside scopes that are still open, once their results are written elsewhere; returns
    how many there were."""
    app = spark.sparkContext.applicationId
    gone = [p for a, s, p in _STAGED if a == app and s not in _SCOPES]
    _STAGED[:] = [x for x in _STAGED if x[2] not in gone]
    return _remove(spark, gone)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are removed at its end, and no others: results that are read outside it live on. Write results that read them before it ends.

        with scope(spark):
            operator(...).write.parquet(path)"""
    mine = uuid.uuid4().int
    _SCOPES.append(mine)
    try:
        yield
    finally:
        _SCOPES.remove(mine)
        gone = [p for _, s, p in _STAGED if s == mine]
        _STAGED[:] = [x for x in _STAGED if x[1] != mine]
        _remove(spark, gone)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys that few rows share, so work that is far above a row's size is spread over all cores, however few partitions a small table comes in."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def scan_filter(files: DataFrame, most_bytes: int, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """Files with a kept extension and size, outside ignored and dotted directories."""
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    pruned = F.exists(folders, lambda x: x.isin(*ignored) | x.startswith("."))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.withColumn("ext", ext).filter(F.col("ext").isin(*LANGUAGES) & ~pruned & (F.col("size") <= most_bytes))
