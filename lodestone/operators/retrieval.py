"""Similarity search within repositories and prompt assembly."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import stage


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Rows of queries that are broadcast, and chunks that a task scores at once.
QUERIES, TILE = 20_000, 8_192


def _unit(v: str) -> Column:
    """The vector scaled to length 1; null if it is null, empty or has no length."""
    n = F.sqrt(dot(v, v))
    return F.when(F.size(v) > 0, F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)))


def _best(key: tuple, t: pa.Table, k: int) -> pa.Table:
    """The k chunks of highest score for each query of a tile: its rows are queries (kind 0) and chunks (kind 1) of one length."""
    kinds = t["kind"].to_numpy()
    ids = {i: t.filter(pa.array(kinds == i)).combine_chunks() for i in (0, 1)}
    out: list[list] = [[], [], []]
    if ids[0].num_rows and ids[1].num_rows:
        q, c = (x["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(x.num_rows, -1) for x in (ids[0], ids[1]))
        q_ids, by_id = (ids[i]["id"].combine_chunks() for i in (0, 1))
        order = np.asarray(pc.sort_indices(by_id))
        for i in range(0, len(q), 256):
            s = np.round(q[i : i + 256] @ c.T, 6)[:, order]
            m = min(k, s.shape[1])
            edge = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m, None]
            over, level = s > edge, s == edge
            r, j = np.nonzero(over | (level & (np.cumsum(level, 1) <= m - over.sum(1, keepdims=True))))  # ties to the smaller id
            out[0].append(q_ids.take(pa.array(i + r)))
            out[1].append(by_id.take(pa.array(order[j])))
            out[2].append(s[r, j])
    join = lambda x, kind: pa.concat_arrays(x) if x else pa.array([], kind)
    score = np.concatenate(out[2]) if out[2] else np.empty(0)
    n = len(score)
    return pa.table({"repository_id": pa.array([key[0].as_py()] * n, t.schema.field("repository_id").type), "query_id": join(out[0], t.schema.field("id").type), "chunk_id": join(out[1], t.schema.field("id").type), "score": score})


def top_chunks(queries: DataFrame, chunks: DataFrame, k: int = 8) -> DataFrame:
    """(repository_id, query_id, chunk_id, score, rank): the k chunks of highest cosine for each query of the same repository.

    queries: repository_id, query_id, q; chunks: repository_id, chunk_id, v; both ids are of one type. Scores are rounded to six
    places, ties go to the smaller chunk_id. Vectors that are null, empty or zero take no part, and only vectors of equal length meet.
    The chunks of a repository are dealt into tiles of about `TILE` rows, and each tile gets the queries of its repository, in
    parts of at most `QUERIES`; a tile's scores are matrix products, and only its best k for each query are shuffled again, so a
    repository of a third of all chunks is dealt over many tasks."""
    key = ["repository_id"]
    # filtered after they are staged, or the filter would have vectors computed twice
    q = stage(queries.select(*key, F.col("query_id").alias("id"), _unit("q").alias("v"))).filter("v is not null").withColumn("d", F.size("v"))
    c = stage(chunks.select(*key, F.col("chunk_id").alias("id"), _unit("v").alias("v"))).filter("v is not null").withColumn("d", F.size("v"))
    # how many tiles and parts each repository needs
    deals = c.groupBy(*key).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).join(q.groupBy(*key).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")), key)
    deals = stage(deals)
    deals = F.broadcast(deals) if deals.limit(QUERIES + 1).count() <= QUERIES else deals
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = q.join(deals, key).withColumn("part", place("parts")).withColumn("tile", every("tiles"))
    b = c.join(deals, key).withColumn("tile", place("tiles")).withColumn("part", every("parts"))
    side = lambda df, kind: df.select(*key, "d", "tile", "part", F.lit(kind).alias("kind"), "id", "v")
    rows = side(a, 0).unionAll(side(b, 1))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = rows.groupBy("repository_id", "d", "tile", "part").applyInArrow(lambda k_, t: _best(k_, t, k), f"repository_id {kinds['repository_id']}, query_id {kinds['id']}, chunk_id {kinds['id']}, score double")
    found = found.withColumns({"query_id": F.col("query_id").cast(queries.schema["query_id"].dataType), "chunk_id": F.col("chunk_id").cast(chunks.schema["chunk_id"].dataType)})
    w = Window.partitionBy("repository_id", "query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("repository_id", "query_id", "chunk_id", "score", "rank")


def top_scores(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """(repository_id, query_id, top_score): the highest score of each query, null for one that found nothing."""
    best = ranked.groupBy("repository_id", "query_id").agg(F.max("score").alias("top_score"))
    return queries.select("repository_id", "query_id").join(best, ["repository_id", "query_id"], "left")


def centroids(chunks: DataFrame) -> DataFrame:
    """The mean vector of each repository."""
    x = chunks.select("repository_id", F.posexplode("v").alias("i", "x")).groupBy("repository_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    x = x.groupBy("repository_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))  # as many entries as dimensions
    return x.select("repository_id", F.col("repository_id").alias("query_id"), F.transform("s", lambda e: e["x"]).alias("q"))


Key = str | list[str]


def _keys(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else key


def context_prompt(ranked: DataFrame, key: Key = "question_id") -> DataFrame:
    """(key, prompt): the ranked blocks of each question; columns rank, location, label, content."""
    block = F.concat(F.lit("--- Context "), F.col("rank").cast("string"), F.lit(": "), "location", F.lit(" - "), "label", F.lit(" ---\n"), "content")
    x = ranked.groupBy(*_keys(key)).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("x"))
    return x.select(*_keys(key), F.array_join(F.transform("x", lambda e: e["b"]), "\n\n").alias("prompt"))


def graph_prompt(questions: DataFrame, relations: DataFrame) -> DataFrame:
    """(repository_id, question_id, prompt): the text of each question, after the relations of its node if there are any.

    questions: repository_id, question_id, node, text; relations: repository_id, node, direction, rank, other, a bounded number for each node."""
    line = F.concat(F.lit("- "), "direction", F.lit(": "), "other")
    facts = relations.groupBy("repository_id", "node").agg(F.array_sort(F.collect_list(F.struct("direction", "rank", line.alias("l")))).alias("x"))
    facts = facts.select("repository_id", "node", F.array_join(F.transform("x", lambda e: e["l"]), "\n").alias("facts"))
    x = questions.join(facts, ["repository_id", "node"], "left")
    return x.select("repository_id", "question_id", F.when(F.col("facts").isNull(), F.col("text")).otherwise(F.concat(F.lit("Graph facts:\n"), "facts", F.lit("\n\n"), "text")).alias("prompt"))


#: First lines of a prompt, with and without chunks; both are parameters of system_prompts.
RULES = "Answer from the code below only. Cite every claim as [path:start-end], with paths and lines as they are shown. Say so if the code doesn't tell."
REFUSAL = "No code was found for this question. Say so, suggest another wording, and don't answer from general knowledge."


#: Texts that a provider gets at once (fixed value).
BATCH = 32


def embedded_by(texts: DataFrame, provider: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "content") -> DataFrame:
    """texts with `v`: what a provider's model gives for each text, scaled to length 1; an empty array for a null or blank one.

    provider() loads the model, once for each task; the model takes up to `BATCH` texts and returns a row for each."""

    @F.arrow_udf("array<double>")
    def vectors(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = provider()
        for col in cols:
            full = [(i, t) for i, t in enumerate(col.to_pylist()) if t and t.strip()]
            out: list = [[]] * len(col)
            for k in range(0, len(full), BATCH):
                part = full[k : k + BATCH]
                m = np.asarray(model([t for _, t in part]), np.float64)
                m = m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)
                for (i, _), v in zip(part, m, strict=True):
                    out[i] = v
            yield pa.array(out, pa.list_(pa.float64()))

    return texts.withColumn("v", vectors(F.col(text)))


def embedded(texts: DataFrame, text: str = "content", dims: int = 64) -> DataFrame:
    """texts with `v`: the counts of the words of each text in up to 256 hashed dimensions, scaled to length 1.

    Words are runs of a-z and 0-9 in lower case; a null text or one without words gets an empty array. This is the offline
    default of the embedding job; embedded_by takes a model instead."""
    if not 1 <= dims <= 256:
        raise ValueError("dims must lie between 1 and 256")

    @F.arrow_udf("array<double>")
    def vectors(col: pa.Array) -> pa.Array:
        known: dict[str, int] = {}
        out = []
        for t in col:
            words = re.findall("[a-z0-9]+", t.as_py() or "")
            if len(known) > 200_000:
                known.clear()
            for w in set(words).difference(known):
                known[w] = hashlib.md5(w.encode()).digest()[0] % dims
            x = np.bincount([known[w] for w in words], minlength=dims) if words else np.zeros(0)
            out.append(x / np.sqrt((x * x).sum()) if words else x)
        return pa.array(out, pa.list_(pa.float64()))

    return texts.withColumn("v", vectors(F.lower(F.col(text))))


def retrieved(questions: DataFrame, chunks: DataFrame, k: int = 8) -> DataFrame:
    """top_chunks of the embedded questions (repository_id, query_id, text) and chunks (repository_id, chunk_id, content).

    The search is exact; texts without words take no part."""
    q = embedded(questions, "text").select("repository_id", "query_id", F.col("v").alias("q"))
    return top_chunks(q, embedded(chunks).select("repository_id", "chunk_id", "v"), k)


def system_prompts(questions: DataFrame, blocks: DataFrame, key: Key = "question_id", rules: str = RULES, refusal: str = REFUSAL) -> DataFrame:
    """(key, prompt): the rules and the ranked blocks of each question, or the refusal for one without blocks."""
    key = _keys(key)
    x = questions.select(*key).join(context_prompt(blocks, key).withColumnRenamed("prompt", "b"), key, "left")
    return x.select(*key, F.when(F.col("b").isNull(), refusal).otherwise(F.concat(F.lit(rules + "\n\n"), "b")).alias("prompt"))


#: What stands before and after the facts of a prompt; both are parameters of hybrid_prompts.
FACTS, AFTER_FACTS = "--- Facts of the graph; they are exact ---", "Explain these facts with the code below. Don't recompute or doubt them."


def hybrid_prompts(questions: DataFrame, blocks: DataFrame, facts: DataFrame, key: list[str], before: str = FACTS, after: str = AFTER_FACTS) -> DataFrame:
    """(key, prompt): system_prompts, after the facts about the graph for each question that has some.

    questions: key; blocks: key, rank, location, label, content; facts: key, lines (see answers.fact_lines). Facts and chunks
    meet by question, so a question may have either, both or none."""
    x = system_prompts(questions, blocks, key).join(facts.select(*key, "lines"), key, "left")
    section = F.concat(F.lit(before + "\n"), "lines", F.lit("\n\n" + after + "\n\n"), "prompt")
    return x.select(*key, F.coalesce(section, "prompt").alias("prompt"))
