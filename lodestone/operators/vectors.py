"""An inverted-file index of chunk vectors: built once, appended to, and probed inside a repository.

Unit vectors are dealt to cells by their nearest centroid, which k-means finds on a bounded sample; every vector is in the index, also those
that came later. A query looks into the `probes` cells whose centroids are nearest to it, and scores there as the exact search does
(retrieval.top_chunks), so it only ever misses chunks of other cells; with all cells probed it is exact. Vectors of another length than the
centroids lie in cell -1, where all queries of another length look. Cells that hold very many chunks of a repository are dealt
into tiles, so none of them fills a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import retrieval
from lodestone.sources.tables import stage

#: Cells at most, and vectors that k-means learns from for each cell.
CELLS, LEARNT = 4_096, 64


def _cells(v: Column, centres: np.ndarray, spark: SparkSession, n: Column) -> Column:
    """array<int>: the n cells nearest to a unit vector, nearest first; cell -1 for vectors of another length."""
    held = spark.sparkContext.broadcast(centres)  # CELLS vectors at most

    @F.arrow_udf("array<int>")
    def nearest(vectors: pa.Array, many: pa.Array) -> pa.Array:
        c = held.value
        k = many.to_numpy(zero_copy_only=False)
        fits = pc.equal(pc.list_value_length(vectors), c.shape[1]).to_numpy(zero_copy_only=False).astype(bool)
        out: list[list[int]] = [[-1]] * len(vectors)
        at = np.flatnonzero(fits)
        for i in range(0, len(at), 4_096):
            rows = at[i : i + 4_096]
            x = pc.list_flatten(vectors.take(pa.array(rows))).to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            near = np.argsort((c * c).sum(1) - 2 * (x @ c.T), axis=1, kind="stable")
            for r, row in zip(rows, near, strict=True):
                out[r] = row[: k[r]].tolist()
        return pa.array(out, pa.list_(pa.int32()))

    return nearest(v, n)


def _rows(chunks: DataFrame) -> DataFrame:
    return chunks.select("repository_id", F.col("chunk_id").alias("id"), retrieval._unit("v").alias("v")).filter("v is not null")


def build(chunks: DataFrame, path: str, cells: int | None = None, seed: int = 1) -> int:
    """Writes an index of chunks (repository_id, chunk_id, v) to a new folder; returns the number of cells, by default the square root of the
    number of vectors, at most CELLS.

    The centroids are those of the commonest length of vectors, learnt from up to LEARNT vectors for each cell, chosen by hash."""
    spark, x = chunks.sparkSession, stage(_rows(chunks))
    most = x.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    d, n = most or (0, 0)
    cells = max(1, min(cells or round(n**0.5), CELLS, n or 1))
    centres = np.zeros((1, d))
    if n:
        share = min(1.0, cells * LEARNT / n)
        mine = x.filter((F.size("v") == d) & (F.pmod(F.xxhash64("repository_id", "id"), F.lit(1 << 30)) <= int(share * (1 << 30)))).select(array_to_vector("v").alias("features"))
        model = KMeans(k=cells, seed=seed, maxIter=10).fit(mine) if cells > 1 else None
        centres = np.array(model.clusterCenters()) if model else np.array([x.filter(F.size("v") == d).first()["v"]])
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, v array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    append(chunks, path)
    return len(centres)


def append(chunks: DataFrame, path: str) -> None:
    """Adds chunks to an index: they go to the cells that there are, in files sorted by cell, so a search reads few parts of each."""
    spark = chunks.sparkSession
    x = _rows(chunks)
    x = x.withColumn("cell", F.element_at(_cells(F.col("v"), _centres(spark, path), spark, F.lit(1)), 1))
    x.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell").write.mode("append").parquet(f"{path}/lists")


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # CELLS at most
    return np.array([r["v"] for r in rows], np.float64).reshape(len(rows), -1)


def search(queries: DataFrame, path: str, k: int = 8, probes: int = 8) -> DataFrame:
    """(repository_id, query_id, chunk_id, score, rank): like retrieval.top_chunks, of the chunks in the nearest `probes` cells of each query
    (repository_id, query_id, q)."""
    spark, key = queries.sparkSession, ["repository_id", "cell"]
    lists = spark.read.parquet(f"{path}/lists")
    q = stage(queries.select("repository_id", F.col("query_id").alias("id"), retrieval._unit("q").alias("v"))).filter("v is not null")
    q = stage(q.withColumn("cell", F.explode(_cells(F.col("v"), _centres(spark, path), spark, F.lit(probes)))))
    wanted = q.select("cell").distinct().limit(1001).collect()
    if len(wanted) <= 1000:  # the scan then leaves out parts of files by their least and greatest cell
        lists = lists.filter(F.col("cell").isin([r[0] for r in wanted]))
    size = lists.groupBy(*key).agg(F.ceil(F.count("*") / retrieval.TILE).cast("int").alias("tiles"))
    deals = stage(size.join(q.groupBy(*key).agg(F.ceil(F.count("*") / retrieval.QUERIES).cast("int").alias("parts")), key))
    deals = F.broadcast(deals) if deals.limit(retrieval.QUERIES + 1).count() <= retrieval.QUERIES else deals
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = q.join(deals, key).withColumn("part", place("parts")).withColumn("tile", every("tiles"))
    b = lists.join(deals, key).withColumn("tile", place("tiles")).withColumn("part", every("parts"))
    side = lambda df, kind: df.select(*key, F.size("v").alias("d"), "tile", "part", F.lit(kind).alias("kind"), "id", "v")
    rows = side(a, 0).unionByName(side(b, 1))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = rows.groupBy("repository_id", "cell", "d", "tile", "part").applyInArrow(lambda k_, t: retrieval._best(k_, t, k), f"repository_id {kinds['repository_id']}, query_id {kinds['id']}, chunk_id {kinds['id']}, score double")
    found = found.withColumns({"query_id": F.col("query_id").cast(queries.schema["query_id"].dataType), "chunk_id": F.col("chunk_id").cast(lists.schema["id"].dataType)})
    w = Window.partitionBy("repository_id", "query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("repository_id", "query_id", "chunk_id", "score", "rank")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the rows of an exact search (repository_id, query_id, chunk_id) that another one has found; 1 if there are none."""
    key = ["repository_id", "query_id", "chunk_id"]
    return exact.join(found.select(*key).withColumn("hit", F.lit(1.0)), key, "left").agg(F.avg(F.coalesce("hit", F.lit(0.0)))).first()[0] or 1.0
