"""Annotations of files by a language model: parsing of the answers, the nodes they give, and how many came through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import edge_id, node_id
from lodestone.operators.imports import FILE

#: Flags of an answer and the node types they stand for (fixed values); isRoute needs a method and a path.
FLAGS = {
    "isService": "service", "isController": "controller", "isDbModel": "dbModel", "isCache": "cache", "isQueue": "queue", "isEvent": "event",
    "isConfiguration": "configuration", "isAuthComponent": "authComponent",
}
TEXTS = ("httpMethod", "httpPath", "entityName")
_KIND = "struct<" + ", ".join([f"{f}: boolean" for f in ("isRoute", *FLAGS)] + [f"{t}: string" for t in TEXTS]) + ">"


def _whole(answer: Column) -> Column:
    """An array of the answer's struct, empty unless all nine flags are booleans. Being tested inside a lambda, the
    answer is parsed once and not once for each flag."""
    bare = F.trim(F.regexp_replace(answer, r"^\s*```(?:json)?\s*|\s*```\s*$", ""))

    def good(x: Column) -> Column:
        ok = F.lit(True)
        for f in ("isRoute", *FLAGS):
            ok = ok & x[f].isNotNull()
        return ok

    return F.filter(F.array(F.from_json(bare, _KIND)), good)


def parsed(answer: Column) -> Column:
    """The struct of an answer with or without a code fence; null unless all nine flags are booleans."""
    return F.get(_whole(answer), F.lit(0))


def nodes(answers: DataFrame) -> DataFrame:
    """(repository_id, id, type, label, path) of answers (repository_id, path, answer): one node for each flag, and a route if its
    method and path are known. Several files can name the same route."""
    x = answers.select(*FILE, F.explode(_whole(F.col("answer"))).alias("a"))
    label = F.coalesce("a.entityName", "path")
    flagged = F.array_compact(F.array(*[F.when(F.col(f"a.{f}"), F.lit(t)) for f, t in FLAGS.items()]))
    plain = x.select(*FILE, label.alias("label"), F.explode(flagged).alias("type"))
    plain = plain.select("repository_id", node_id(F.col("type"), F.array("path")).alias("id"), "type", "label", "path")
    method, way = F.col("a.httpMethod"), F.col("a.httpPath")
    routes = x.filter(F.col("a.isRoute") & (F.length(method) > 0) & (F.length(way) > 0))
    kind = F.lit("route")
    routes = routes.select("repository_id", node_id(kind, F.array(method, way)).alias("id"), kind.alias("type"), F.concat_ws(" ", method, way).alias("label"), "path")
    return plain.unionByName(routes)


def edges(answers: DataFrame) -> DataFrame:
    """(repository_id, id, source, target, type): a defines edge from each file to each of its nodes(); distinct."""
    file, kind = node_id(F.lit("file"), F.array("path")), F.lit("defines")
    x = nodes(answers).select("repository_id", file.alias("source"), F.col("id").alias("target")).distinct()
    return x.select("repository_id", edge_id(F.col("source"), kind, F.col("target")).alias("id"), "source", "target", kind.alias("type"))


def coverage(answers: DataFrame, key: str) -> DataFrame:
    """Per key: attempted, succeeded, quota_exhausted (status 429), failed otherwise, percent, and the first file over quota.

    answers: key, ordinal, path, status, answer. A file whose answer can't be parsed failed otherwise."""
    over, good = F.col("status") == 429, (F.col("status") == 200) & parsed(F.col("answer")).isNotNull()
    x = answers.select(key, "ordinal", "path", over.alias("__over"), good.alias("__good"))
    return x.groupBy(key).agg(
        F.count("*").alias("attempted"), F.count_if("__good").alias("succeeded"), F.count_if("__over").alias("quota_exhausted"),
        F.count_if(~F.col("__good") & ~F.col("__over")).alias("failed"), F.round(100 * F.count_if("__good") / F.count("*"), 1).alias("percent"),
        F.min_by("path", F.when(F.col("__over"), F.col("ordinal"))).alias("first_over"),
    )


def prompts(files: DataFrame, most: int = 4000) -> DataFrame:
    """(repository_id, path, excerpt): the first characters of each file, as the request asks for."""
    return files.select(*FILE, F.substring("content", 1, most).alias("excerpt"))
