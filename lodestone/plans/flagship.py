"""The flagship query: what each component depends on, with its degree profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators import graph
from lodestone.plans.registry import fixture


def dependency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = fixture(spark, sf_dir, "graph")
    return graph.direct(edges).join(graph.degrees(edges), ["repository_id", "node"])
