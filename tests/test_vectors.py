"""The inverted-file index against the exact search."""

import numpy as np
import pytest
from lodestone.operators import retrieval, vectors

CHUNK, QUERY = "repository_id string, chunk_id long, v array<float>", "repository_id string, query_id long, q array<float>"


@pytest.fixture(scope="module")
def clouds(spark):
    """Chunks around a hundred points, three quarters of them in one repository, and queries near some."""
    rng = np.random.default_rng(1)
    points = rng.normal(size=(100, 24))
    rows = [("hot" if i % 4 else f"r{i % 8}", i, (points[i % 100] + 0.5 * rng.normal(size=24)).tolist()) for i in range(3000)]
    rows += [("hot", 5000, None), ("hot", 5001, []), ("hot", 5002, [0.0] * 24), ("hot", 5003, [1.0, 2.0]), ("hot", 5004, [1.0, 1.0])]
    asked = [("hot" if i % 3 else "r0", i, (points[i] + 0.5 * rng.normal(size=24)).tolist()) for i in range(60)] + [("hot", 100, [2.0, 1.0]), ("hot", 101, None), ("nowhere", 102, points[0].tolist())]
    return spark.createDataFrame(rows, CHUNK), spark.createDataFrame(asked, QUERY)


def test_recall_and_exactness(spark, clouds, tmp_path, monkeypatch):
    chunks, queries = clouds
    exact = retrieval.top_chunks(queries, chunks, 8)
    path = str(tmp_path / "index")
    first, later = chunks.filter("chunk_id % 5 <> 0"), chunks.filter("chunk_id % 5 = 0")
    assert vectors.build(first, path) == 49  # the square root of 2,400
    vectors.append(later, path)
    lists = spark.read.parquet(f"{path}/lists")
    assert lists.count() == 3002 and lists.filter("cell = -1").count() == 2  # every vector that has a direction
    got = vectors.search(queries, path, 8, 8)
    assert vectors.recall(got, exact) >= 0.9
    rows = lambda df: {tuple(r) for r in df.collect()}
    every = vectors.search(queries, path, 8, vectors.CELLS)
    assert rows(every) == rows(exact)
    monkeypatch.setattr(retrieval, "TILE", 7)  # cells in many tiles
    assert rows(vectors.search(queries, path, 8, vectors.CELLS)) == rows(exact)
    assert {r["chunk_id"] for r in got.filter("query_id = 100").collect()} == {5003, 5004}


def test_empty_index(spark, clouds, tmp_path):
    chunks, queries = clouds
    path = str(tmp_path / "index")
    assert vectors.build(chunks.limit(0), path) == 1 and vectors.search(queries, path).count() == 0
