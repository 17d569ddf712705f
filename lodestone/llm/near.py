"""Jaccard similarity join on word n-grams by MinHash banding, and groups of near copies.

1. Every text becomes the set of its n-grams of words (64-bit hashes; a text of fewer words is one
   n-gram) and a MinHash signature cut into bands; the numbers of bands and rows follow from the
   threshold and the wanted recall. Texts with equal sets form a class, of which one row goes on.
2. A shuffle on (band, hash) finds the buckets with several classes. Buckets with the same members
   are kept once.
3. Only classes in such buckets have their sets computed again, and each bucket is verified on the full
   sets. A bucket of more than `BLOCK` classes is dealt into blocks, and each pair of blocks is a task of
   its own. A pair counts in the first band that it shares, so no pair counts twice. A task returns for
   each class how many rows it is linked to and one edge to its group, never the pairs.
4. Groups are the connected components of these edges: tasks reduce them to stars, so the hub of a large group isn't
   joined with all its members, and the stars are joined by one task up to a million, by labels and pointer jumping beyond.

Defined cases: null texts and texts without a word have no n-grams; each such row is a class without
links. A class is its set of n-grams, whatever doc_ids its rows have: rows that repeat a doc_id, or have
none, are rows of their own that share a class only if their texts do. A class is shown by its smallest
doc_id (null if it has none) and a group by the smallest of its classes (null counts as the smallest), so
different classes can be shown alike. Texts shorter than n words are linked only if they are equal word
for word. No rows give no rows; other columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WordHashes, lean_workers, materialise, mix
from lodestone.operators.graph import labels_of

#: Classes in a block, and the most needed classes (of some 16 bytes) that are broadcast to find their texts.
BLOCK, BROADCAST_ROWS = 512, 2_000_000
_P = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, recall: float, hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows for which bands that reach the recall at the threshold need at most `hashes`."""
    best = None
    for rows in range(1, 33):
        p = threshold**rows
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - p))) if p < 1 else 1
        if bands * rows <= hashes or best is None:
            best = (bands, rows)
    return best


def _words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


class Shingler:
    def __init__(self, n: int, bands: int, rows: int, seed: int = 11):
        self.n, self.bands, self.rows, self.hashes = n, bands, rows, WordHashes(seed=seed)
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 63, bands * rows, np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, np.uint64)

    def grams(self, text: str | None) -> np.ndarray:
        """The sorted hashes of the text's n-grams."""
        words = _words(text) if text else []
        if not words:
            return np.empty(0, np.uint64)
        h, n = self.hashes(words), min(self.n, len(words))
        with np.errstate(over="ignore"):
            g = h[: len(h) - n + 1].copy()
            for i in range(1, n):
                g = g * _P + h[i : len(h) - n + 1 + i]
            g = mix(g + np.uint64(n))
        return np.unique(g)

    def signature(self, g: np.ndarray) -> np.ndarray:
        """One 64-bit hash for each band."""
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(0, len(g), 1024):
                np.minimum(low, (g[i : i + 1024, None] * self.a + self.b).min(0), out=low)
            low = mix(low >> np.uint64(16)).reshape(self.bands, self.rows)
            out = np.zeros(self.bands, np.uint64)
            for j in range(self.rows):
                out = mix(out * _P + low[:, j])
        return out


def _digest() -> Column:
    return F.unhex(F.md5(F.col("text").cast("string"))).alias("digest")


def _prepared(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, digest (of the text), key (of the set of n-grams; null without one), bands."""

    def run(batches):
        s = Shingler(n, bands, rows)
        for b in batches:
            keys, out = [], []
            for t in b["text"]:
                g = s.grams(t.as_py())
                keys.append(xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None)
                out.append(s.signature(g).view(np.int64) if len(g) else None)
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), b["digest"], pa.array(keys, pa.binary()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "digest", "key", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, digest binary, key binary, bands array<long>")


def pair_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of a block's sets."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[col] > 1
    _, col = np.unique(col[shared], return_inverse=True)
    owner = owner[shared]
    out = np.zeros((m, m), np.float32)
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    step = max(1, 4_000_000 // max(1, m))
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        i, j = np.searchsorted(col, [c, c + step])
        x = np.zeros((m, step), np.float32)
        x[owner[i:j], col[i:j] - c] = 1
        out += x @ x.T
    return out


def _linked(t: dict, threshold: float) -> list[tuple[bytes, bytes, int, int]]:
    """(class, root, linked rows, linked classes) for the classes of one tile that have links in it."""
    m = len(t["key"])
    sets, sig, left = t["grams"], np.array(t["bands"], np.int64), np.array(t["left"])
    size, copies, band = np.array([len(s) for s in sets]), np.array(t["copies"], np.int64), t["band"]
    if m == 2:
        both = np.array([[0, c := len(np.intersect1d(*sets, assume_unique=True))], [c, 0]], np.float32)
    else:
        both = pair_counts(sets)
    ok = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
    np.fill_diagonal(ok, False)
    if t["cross"]:  # within a block the pairs belong to the tile of that block alone
        ok &= left[:, None] != left[None, :]
    if band and ok.any():
        i, j = np.nonzero(ok)
        earlier = (sig[i, :band] == sig[j, :band]).any(1)
        ok[i[earlier], j[earlier]] = False
    has = np.flatnonzero(ok.any(1))
    root = np.arange(m)
    while len(has):  # components within the tile: minimum labels
        new = np.minimum(root, np.where(ok, root[None, :], m).min(1))
        new = new[new]
        if (new == root).all():
            break
        root = new
    key = t["key"]
    weight = ok @ copies
    return [(key[i], key[root[i]], int(weight[i]), int(ok[i].sum())) for i in has]


def _tiles(batches, threshold: float):
    """Gathers the rows of each tile from batches sorted by tile, and verifies one tile at a time."""
    kind = pa.schema([("key", pa.binary()), ("root", pa.binary()), ("n_rows", pa.int64()), ("n_classes", pa.int64())])
    now, tile = None, {}

    def ended():
        rows = _linked(tile, threshold) if tile and len(tile["key"]) > 1 else []
        return pa.RecordBatch.from_pydict(dict(zip(kind.names, zip(*rows, strict=True) if rows else [[]] * 4, strict=True)), kind)

    for b in batches:
        for r in b.to_pylist():
            at = (r["bucket"], r["lo"], r["hi"])
            if at != now:
                if tile:
                    yield ended()
                now, tile = at, {"key": [], "grams": [], "bands": [], "copies": [], "left": [], "band": r["band"], "cross": r["lo"] != r["hi"]}
            for k in ("key", "bands", "copies"):
                tile[k].append(r[k])
            tile["grams"].append(np.frombuffer(r["grams"], np.uint64))
            tile["left"].append(r["block"])
    if tile:
        yield ended()


def _components(edges: DataFrame) -> DataFrame:
    """key -> root (the smallest key of its component), for edges (key, root)."""
    pairs = materialise(edges.filter("key <> root").select(F.hex("key").alias("a"), F.hex("root").alias("b")).distinct())
    labels = labels_of(pairs)
    return labels.select(F.unhex("node").alias("key"), F.unhex("label").alias("root"))


def _classes(docs: DataFrame, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The rows of docs (_prepared), and the classes: key, root (key of the group), copies, copy_id, n_rows, n_classes."""
    lean_workers(docs.sparkSession)
    bands, rows = bands_for(threshold, recall)
    first = materialise(_prepared(docs, n, bands, rows))
    keyed = first.filter(F.col("key").isNotNull())
    classes = keyed.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("copy_id"))
    # equal sets have equal signatures, so any row of the class will do
    reps = keyed.join(classes, "key").filter(F.col("doc_id").eqNullSafe(F.col("copy_id"))).dropDuplicates(["key"])
    reps = materialise(reps.select("key", "copy_id", "digest", "copies", "bands"))
    every = reps.select("key", F.posexplode("bands").alias("band", "h"))
    shared = every.groupBy("band", "h").agg(
        F.count("*").alias("m"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("f"), F.bit_xor(F.xxhash64(F.lit(7), "key")).alias("g")
    ).filter("m > 1")
    kept = shared.groupBy("m", "f", "g").agg(F.min(F.struct("band", "h")).alias("x")).select("m", "x.band", "x.h")
    members = materialise(every.join(kept, ["band", "h"]))
    needed = members.select("key").distinct()
    wanted = reps.join(needed, "key", "left_semi")
    count = needed.count()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(), F.col("text").cast("string").alias("text"))
    narrow = wanted.select("copy_id", F.col("digest").alias("d"))
    narrow = F.broadcast(narrow) if count <= BROADCAST_ROWS else narrow
    found = texts.join(narrow, (texts["digest"] == narrow["d"]) & texts["doc_id"].eqNullSafe(narrow["copy_id"]), "left_semi").select("text")

    def regram(batches):
        s = Shingler(n, bands, rows)
        for b in batches:
            sets = [s.grams(t.as_py()) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(g.tobytes()) for g in sets], pa.binary()), pa.array([g.tobytes() for g in sets], pa.binary())], names=["key", "grams"])

    sets = found.mapInArrow(regram, "key binary, grams binary").join(wanted, "key").dropDuplicates(["key"])
    sets = materialise(sets.select("key", "copies", "bands", "grams"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "band", "block", F.xxhash64("band", "h").alias("bucket"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    tiles = dealt.join(sets, "key").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    links = materialise(tiles.mapInArrow(lambda b: _tiles(b, threshold), "key binary, root binary, n_rows long, n_classes long"))
    totals = links.groupBy("key").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_classes").alias("n_classes"))
    info = reps.select("key", "copies", "copy_id").join(totals, "key", "left").join(_components(links.select("key", "root")), "key", "left")
    return first, info.withColumn("root", F.coalesce("root", "key"))


def near_copies(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (its group of near copies), copy_id (its class of equal
    sets), n_copies (rows of that class), n_links (other rows of similarity `threshold` or more), n_linked_classes."""
    first, info = _classes(docs, n, threshold, recall)
    info = materialise(info)
    names = info.groupBy("root").agg(F.min(F.struct(F.col("copy_id").isNotNull(), "copy_id"))["copy_id"].alias("class_id"))
    out = first.select("doc_id", "key").join(info.join(names, "root"), "key", "left")
    none = F.col("copies").isNull()
    return out.select(
        "doc_id",
        F.when(none, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(none, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce(F.col("copies"), F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce(F.col("copies") - 1 + F.coalesce("n_rows", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_classes", F.lit(0)).cast("long").alias("n_linked_classes"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id (null counts as the largest;
    of several texts with that doc_id, the one of the smallest digest). Rows without n-grams stay.

    A row is known by its doc_id and the digest of its text. Of rows equal in both, one stays."""
    first, info = _classes(docs.select("doc_id", "text"), 5, 0.8, 0.9999)
    rows = materialise(first.filter(F.col("key").isNotNull()).groupBy("key", "doc_id", "digest").count().join(info.select("key", "root"), "key"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    best = rows.groupBy("root").agg(F.min(order).alias("best")).select("root", "best.doc_id", "best.digest")
    best = rows.join(best.withColumnsRenamed({"root": "r", "doc_id": "i", "digest": "d"}), (F.col("root") == F.col("r")) & (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("i")), "left")
    best = materialise(best.select(F.col("doc_id").alias("__near_id"), F.col("digest").alias("__near_digest"), F.col("r").isNull().alias("lost"), "count"))
    marks = best.columns[:2]
    x = docs.withColumn("__near_text", _digest())
    same = (F.col("__near_text") == F.col(marks[1])) & F.col("doc_id").cast("long").eqNullSafe(F.col(marks[0]))
    single = best.filter("not lost and count > 1").select(*marks)
    kept = x.join(best.filter("lost or count > 1").select(*marks), same, "left_anti").drop("__near_text")
    if not single.limit(1).count():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = x.join(single, same).groupBy(*marks).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("__near_row"))
    return kept.unionByName(again.select("__near_row.*"))


#: DuckDB's SQL for near_copies over documents: exact n-grams, a self-join on them, recursive components.
ORACLE_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as gram from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0)),
k as (select doc_id, list(gram order by gram) as grams, count(*) as n from g group by doc_id),
c as (select grams, min(doc_id) as copy_id, count(*) as copies, any_value(n) as n from k group by grams),
cg as (select copy_id, copies, n, unnest(grams) as gram from c),
p as (select a.copy_id as x, b.copy_id as y, count(*) as common, any_value(a.n) as nx, any_value(b.n) as ny, any_value(b.copies) as copies from cg a join cg b on a.gram = b.gram and a.copy_id <> b.copy_id group by 1, 2),
l as (select x, y, copies from p where common >= 0.8 * (nx + ny - common) - 1e-6),
r as (select copy_id as x, copy_id as y from c union select r.x, l.y from r join l on r.y = l.x),
comp as (select x, min(y) as class_id from r group by x),
deg as (select x, sum(copies) as n_rows, count(*) as n_classes from l group by x)
select w.doc_id, coalesce(comp.class_id, w.doc_id) as class_id, coalesce(c.copy_id, w.doc_id) as copy_id, coalesce(c.copies, 1)::bigint as n_copies,
  coalesce(c.copies - 1 + coalesce(deg.n_rows, 0), 0)::bigint as n_links, coalesce(deg.n_classes, 0)::bigint as n_linked_classes
from w left join k on k.doc_id = w.doc_id left join c on c.grams = k.grams left join comp on comp.x = c.copy_id left join deg on deg.x = c.copy_id"""
