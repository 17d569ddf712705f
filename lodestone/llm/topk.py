"""Exact top-k search by integer inner product.

Queries and candidates are dealt into blocks by a hash of their id. A tile is a block of queries with
a block of candidates; its scores come from matrix products over bounded pieces, and each query keeps
its best k of the tile. The lists are then merged in a tree, `FAN` lists at a time. Every query meets every
candidate. Blocks are as large as `BLOCK_BYTES` allow, since each candidate is copied once for each block of
queries and each query once for each block of candidates; a task's memory doesn't grow with the tables. Few
candidates are dealt into smaller blocks, so that all cores have a tile.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do empty
vectors; only vectors of equal length have a score; components beyond the range of long are clamped
to it, and scores wrap as 64-bit integers do; rows that repeat a vec_id (null vec_ids too: they take
no part) count once, with the smallest vector; ties of scores go to the smaller vec_id; no queries or
no candidates give no rows; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialise

#: Lists merged at once.
FAN = 16
#: Bytes of the vectors of a block at most, and the rows below which a block isn't cut to make more tasks.
BLOCK_BYTES, LEAST_ROWS = 16 << 20, 4_096
#: Cells of a score matrix at once.
CELLS = 4_000_000


def whole_vectors(df: DataFrame, scale: int) -> DataFrame:
    """vec_id, v: floor(scale * component) of each vector that takes part; one row for each vec_id."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    ok = df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)
    return ok.select("vec_id", v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their vectors."""
    t = t.combine_chunks()
    ids = t["vec_id"].to_numpy()
    v = t["v"].combine_chunks()
    v = v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    return ids[order], v[order]


def tile_best(queries: pa.Table, cands: pa.Table, k: int) -> pa.Table:
    """The best k candidates of a tile for each of its queries; exact, ties to the smaller id."""
    out: list[list[np.ndarray]] = [[], [], []]
    if queries.num_rows and cands.num_rows:
        qi, q = _matrix(queries)
        ci, c = _matrix(cands)
        top = lambda a: max(abs(float(a.min())), abs(float(a.max())))
        exact = top(q) * top(c) * q.shape[1] < 2.0**52  # then the products are exact in doubles, which are faster
        kind = np.float64 if exact else np.int64
        q, ct = q.astype(kind), c.astype(kind).T.copy()
        step = max(1, CELLS // len(ci))
        for i in range(0, len(qi), step):
            with np.errstate(over="ignore"):
                s = (q[i : i + step] @ ct).astype(np.int64)
            own = ci[None, :] == qi[i : i + step, None]
            n = min(k + 1, len(ci))  # one more, as the query itself may be among them
            if n < len(ci):
                edge = np.partition(s, len(ci) - n, 1)[:, len(ci) - n]
                over, at = s > edge[:, None], s == edge[:, None]
                room = n - over.sum(1)
                take = over | (at & (np.cumsum(at, 1) <= room[:, None]))
            else:
                take = np.ones_like(own)
            r, j = np.nonzero(take & ~own)
            out[0].append(qi[i + r])
            out[1].append(ci[j])
            out[2].append(s[r, j])
    cols = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
    return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(x, pa.int64()) for x in cols), strict=True)))


def blocks(queries: int, candidates: int, dims: int, cores: int) -> tuple[int, int]:
    """Numbers of blocks of queries and of candidates."""
    most = max(1, BLOCK_BYTES // (8 * max(1, dims)))
    by_cores = min(cores, -(-candidates // LEAST_ROWS))
    return max(1, -(-queries // most)), max(1, -(-candidates // most), by_cores)


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, dealt: tuple[int, int] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the best k of all other vectors for each query; dealt: numbers of blocks, else blocks()."""
    v = materialise(whole_vectors(vectors, scale).withColumn("d", F.size("v")))
    q = v.filter(is_query)
    n, m, dims = v.agg(F.count("*"), F.count_if(is_query), F.coalesce(F.max("d"), F.lit(1))).first()
    n_q, n_c = dealt or blocks(m, n, dims, v.sparkSession.sparkContext.defaultParallelism)
    deal = lambda df, name, k: df.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(k)).cast("int"))
    every = lambda df, name, k: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    q, c = every(deal(q, "qb", n_q), "cb", n_c), every(deal(v, "cb", n_c), "qb", n_q)

    def best(key: tuple, t: pa.Table) -> pa.Table:
        out = tile_best(t.filter(t["query"]), t.filter(pc.invert(t["query"])), k)
        return out.append_column("cb", pa.array([key[2].as_py()] * out.num_rows, pa.int32()))

    side = lambda df, is_q: df.select("d", "qb", "cb", "vec_id", "v", F.lit(is_q).alias("query"))
    lists = side(q, True).unionAll(side(c, False)).groupBy("d", "qb", "cb").applyInArrow(best, "query_id long, vec_id long, score long, cb int")
    order = [F.desc("score"), F.asc("vec_id")]
    while n_c > FAN:
        lists = lists.withColumn("cb", F.expr(f"cb div {FAN}").cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "cb").orderBy(*order))).filter(F.col("rank") <= k).drop("rank")
        n_c = -(-n_c // FAN)
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
