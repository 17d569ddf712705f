"""The prefix trie of conversations, by truncation peeling.

A conversation is a path: a digest and a length for each turn. Equal paths are merged first. Then, from the greatest depth up, the
conversations that end at a depth are merged with the nodes that survive from below, each group is a node whose sums are
complete, and its path loses its last turn and is grouped anew. So nodes are found and summed in one pass.

Two ways peel alike. Below the depth `SHALLOW`, paths with the same first turns are peeled together inside a task, as long as they have up to
`MOST` turns; groups with more of them, and all nodes from `SHALLOW` up, take one Spark job for each depth, whose partial results keep a common
prefix from filling a task. Prefixes met by many are looked up in two joins: those with very many children are broadcast, and there
are fewer than `HEAVY` of them; the others are shuffled. Digests of the members that end at a node run over ids that tasks have sorted and joined.

Defined cases: rows without conv_id take no part; a null role or text counts as empty; turns come in order, null first, equal ones by role, then
by the digest of the text, and repeated rows are turns of their own; no rows give no rows, not even a root; columns beside
conv_id, turn, role and text aren't read. The digests of one conversation (24 bytes a turn) are held in a task, its texts aren't. Equality
of turns is that of 128-bit digests of role and text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import lean_workers, materialise
from lodestone.sources.tables import shared_dir

#: Depth from which each level is a Spark job; turns that one task peels together; fewer parents than this are broadcast.
SHALLOW, MOST, HEAVY = 6, 200_000, 50_000
#: Bytes of a path for each turn: the digest and the length in code points.
STEP = 20
_NODE = "path binary, key string, parent string, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def paths(conversations: DataFrame, heads: int = 6, block: int = 100) -> DataFrame:
    """(conv_id, path) of each conversation, rebuilt: its first h turns are those of the first conversation of its block, h = crc32(conv_id) % heads."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    code = F.concat(digest, F.lpad(F.lower(F.hex(F.length(text))), STEP * 2 - 32, "0"))
    c = F.col("conv_id").cast("long")
    x = conversations.filter(F.col("conv_id").isNotNull()).select(c.alias("conv_id"), (c - c % block).alias("__base"), F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), role.alias("role"), code.alias("code")).alias("t"))
    own = x.repartition("__base").groupBy("__base", "conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["code"]).alias("own"))
    first = own.filter(F.col("conv_id") == F.col("__base")).select("__base", F.slice("own", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    none = F.array().cast("array<string>")
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("own", h + 1, F.greatest(F.size("own"), F.lit(1))))
    return own.join(first, "__base", "left").select("conv_id", F.unhex(F.array_join(turns, "")).alias("path"))


def ended(rows: DataFrame) -> DataFrame:
    """(path, depth, n, conv_id): the distinct paths, how many conversations each is, and the smallest of them."""
    x = rows.groupBy("path").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    return x.select("path", F.floor(F.length("path") / STEP).cast("int").alias("depth"), "n", "conv_id")


def _start(paths_: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return paths_.select("path", "n", "conv_id", zero.alias("children"), zero.alias("leaves"), zero.alias("saved"))


def _stripped(nodes: DataFrame, depth: int) -> DataFrame:
    """The nodes of a depth with their last turn gone."""
    return nodes.select(F.substring("path", 1, (depth - 1) * STEP).alias("path"), F.col("n_convs").alias("n"), "conv_id", F.lit(1).cast("long").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))


def _level(x: DataFrame, depth: int) -> DataFrame:
    """The nodes of a depth, of paths that end there and of stripped ones."""
    g = x.groupBy("path").agg(*[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")], F.min("conv_id").alias("conv_id"))
    path = lambda d: F.substring("path", 1, d * STEP)
    size = F.conv(F.hex(F.substring("path", depth * STEP - 3, 4)), 16, 10).cast("long") if depth else F.lit(0).cast("long")
    return g.select(
        "path", F.md5("path").alias("key"), (F.md5(path(depth - 1)) if depth else F.lit(None).cast("string")).alias("parent"), F.lit(depth).alias("depth"), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"), (F.col("saved") + (F.col("n") - 1) * size).alias("saved_tokens"),
    )


def peel(rows: list[tuple[bytes, int, int]], above: int) -> Iterator[tuple]:
    """Nodes deeper than `above` of (path, n, conv_id), distinct paths that agree in their first `above` turns; the deepest first.

    Only nodes of depth above + 1 carry their path. The digest of a path grows turn by turn, so the work is linear in all turns."""
    keys, ends = [], {}
    for i, (path, _, _) in enumerate(rows):
        h = hashlib.md5(path[: above * STEP])
        chain = [h.hexdigest()]
        for k in range(above * STEP, len(path), STEP):
            h.update(path[k : k + STEP])
            chain.append(h.hexdigest())
        keys.append(chain)
        ends.setdefault(above + len(chain) - 1, []).append(i)
    level: dict[str, list[int]] = {}  # key: a row that has it, n_convs, conv_id, children, leaves, saved
    for depth in range(max(ends, default=above), above, -1):
        for i in ends.get(depth, ()):
            _, n, conv = rows[i]
            at = level.get(keys[i][depth - above])
            if at:
                at[1], at[2] = at[1] + n, min(at[2], conv)
            else:
                level[keys[i][depth - above]] = [i, n, conv, 0, 0, 0]
        up: dict[str, list[int]] = {}
        done = []
        for key, (i, n, conv, children, leaves, saved) in level.items():
            path = rows[i][0]
            leaves = leaves or 1
            saved += (n - 1) * int.from_bytes(path[depth * STEP - 4 : depth * STEP], "big")
            parent = keys[i][depth - 1 - above]
            at = up.get(parent)
            if at:
                at[1], at[2], at[3], at[4], at[5] = at[1] + n, min(at[2], conv), at[3] + 1, at[4] + leaves, at[5] + saved
            else:
                up[parent] = [i, n, conv, 1, leaves, saved]
            done.append((path[: depth * STEP] if depth == above + 1 else None, key, parent, depth, conv, n, children, leaves, saved))
        # conversations that end at the depth above are members of the parents as well
        for i in ends.get(depth - 1, ()):
            at = up.get(keys[i][depth - 1 - above])
            if at:
                at[2] = min(at[2], rows[i][2])
        for path, key, parent, d, conv, n, children, leaves, saved in done:
            yield path, key, parent, d, conv, None if d == above + 1 else up[parent][2], n, children, leaves, saved
        level = up


def _peeled_in_tasks(deep: DataFrame, above: int) -> DataFrame:
    """Nodes deeper than `above`: paths with the same first turns meet in a task, one such group after another."""
    schema = deep.sparkSession.createDataFrame([], _NODE).schema
    names, kinds = _NODE.split(", "), {"binary": pa.binary(), "string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    arrow = pa.schema([(n.split()[0], kinds[n.split()[1]]) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, out = None, [], []
        for b in batches:
            for base, path, n, conv in zip(*(b[c].to_pylist() for c in ("base", "path", "n", "conv_id")), strict=True):
                if base != group:
                    out += peel(held, above)
                    group, held = base, []
                    if len(out) > 20_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in out], arrow)
                        out = []
                held.append((path, n, conv))
        out += peel(held, above)
        for i in range(0, len(out), 20_000):
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in out[i : i + 20_000]], arrow)

    x = deep.select(F.substring("path", 1, above * STEP).alias("base"), "path", "n", "conv_id")
    return x.repartition("base").sortWithinPartitions("base").mapInArrow(run, schema)


def nodes(rows: DataFrame, shallow: int = SHALLOW, most: int = MOST) -> DataFrame:
    """All nodes of (conv_id, path); parent_conv_id is set where a task had the parent at hand. The result is a staged table."""
    spark = rows.sparkSession
    ends = materialise(ended(rows))
    out = f"{shared_dir(spark)}/trie-{uuid.uuid4().hex}"
    write = lambda df, name: df.write.parquet(f"{out}/part={name}")
    schema = spark.createDataFrame([], _NODE).schema
    read = lambda name: spark.read.schema(schema).parquet(f"{out}/part={name}")
    deep = ends.filter(F.col("depth") > shallow)
    base = F.substring("path", 1, shallow * STEP)
    turns = deep.groupBy(base.alias("base")).agg(F.sum(F.col("depth") - shallow).alias("turns"), F.max("depth").alias("deepest"))
    total, largest, deepest = turns.agg(F.sum("turns"), F.max("turns"), F.max("deepest")).first()
    most = max(most, (total or 0) // HEAVY)  # so that fewer groups than HEAVY are large
    hot = []
    if (largest or 0) > most:
        large = F.broadcast(turns.filter(F.col("turns") > most).select("base"))
        tagged = deep.withColumn("base", base)
        write(_peeled_in_tasks(tagged.join(large, "base", "left_anti"), shallow), "deep")
        mine = materialise(tagged.join(large, "base", "left_semi").drop("base"))
        for d in range(deepest, shallow, -1):
            x = _start(mine.filter(F.col("depth") == d))
            write(_level(x if d == deepest else x.unionByName(_stripped(read(f"hot{d + 1}"), d + 1)), d), f"hot{d}")
            hot.append(f"hot{d}")
    else:
        write(_peeled_in_tasks(deep, shallow), "deep")
    for d in range(shallow, -1, -1):
        x = _start(ends.filter(F.col("depth") == d))
        if d == shallow:
            below = read("deep").filter(F.col("depth") == d + 1)
            below = below.unionByName(read(hot[-1])) if hot else below
        else:
            below = read(f"at{d + 1}")
        write(_level(x.unionByName(_stripped(below, d + 1)), d), f"at{d}")
    return spark.read.schema(schema).option("basePath", out).parquet(out)


def with_parents(x: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Nodes with parent_conv_id. Parents with more than 1 / heavy of all nodes as children are broadcast, the others are shuffled."""
    known = x.filter(F.col("parent_conv_id").isNotNull() | F.col("parent").isNull())
    open_ = x.filter(F.col("parent_conv_id").isNull() & F.col("parent").isNotNull()).drop("parent_conv_id")
    total = x.agg(F.sum("n_children")).first()[0] or 0
    parents = x.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    common = F.col("n_children") * heavy > total
    held = open_.join(F.broadcast(parents.filter(common).drop("n_children")), "parent", "left")
    rest = held.filter(F.col("parent_conv_id").isNull()).drop("parent_conv_id").join(parents.filter(~common).drop("n_children").hint("shuffle_hash"), "parent")
    return known.unionByName(held.filter(F.col("parent_conv_id").isNotNull())).unionByName(rest)


def end_digests(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256): the SHA-256 of the ids, ascending and comma-joined, of the conversations that are a path as a whole.

    Ids are sorted over all tasks and joined to runs of up to 10,000, so many equal conversations are sorted and joined by many tasks. The last
    task of a node reads its runs in order and keeps only the state of the digest."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        for b in batches:
            out = []
            for k, i in zip(b["key"].to_pylist(), b["conv_id"].to_pylist(), strict=True):
                if ids and (k != key or len(ids) == 10_000):
                    out.append((key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = k
                ids.append(i)
            yield rows_of(out)
        yield rows_of([(key, ids[0], ",".join(map(str, ids)))] if ids else [])

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        k, f, s = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(f, pa.int64()), pa.array(s, pa.string())], names=["key", "first", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for b in batches:
            keys, sums = [], []
            for k, s in zip(b["key"].to_pylist(), b["ids"].to_pylist(), strict=True):
                if k == key:
                    h.update(b"," + s.encode())
                    continue
                if h:
                    keys.append(key)
                    sums.append(h.hexdigest())
                key, h = k, hashlib.sha256(s.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sums, pa.string())], names=["key", "ends_sha256"])
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], names=["key", "ends_sha256"])

    x = rows.select(F.md5("path").alias("key"), "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    runs = x.mapInArrow(joined, "key string, first long, ids string")
    return runs.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digested, "key string, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """The query's columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    lean_workers(conversations.sparkSession)
    rows = materialise(paths(conversations))
    x = with_parents(nodes(rows)).join(end_digests(rows), "key", "left")
    ends = F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256")
    return x.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)


#: The same in DuckDB's SQL: all prefixes of all conversations are grouped at once, and each node is added to its ancestors. The CRC-32 follows
#: from its polynomial.
ORACLE_SQL = """
with recursive t as (select range as i, range::bigint as c, 0 as k from range(256) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from t where k < 8),
crc as (select list(c order by i) as tab from t where k = 8),
turns as (select conv_id, turn, {'role': coalesce(role, ''), 'text': coalesce(text, '')} as x from conversations where conv_id is not null),
own as (select conv_id, list(x order by turn is not null, turn, x.role, md5(length(x.role)::varchar || ':' || x.role || x.text)) as own from turns group by conv_id),
hashed as (select conv_id, conv_id - conv_id % 100 as base, own, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(conv_id::varchar)), '..'), lambda y: ('0x' || y)::bigint)),
  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 6 as h from own, crc),
built as (select a.conv_id, list_concat(coalesce(b.own, [])[1:a.h], a.own[a.h + 1:]) as p from hashed a left join own b on b.conv_id = a.base),
prefix as (select conv_id, len(p) as n, d, p[1:d] as k from (select *, unnest(range(0, len(p) + 1)) as d from built)),
node as (select k, d, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = d), '')) as ends_sha256 from prefix group by k, d),
child as (select k[1:d - 1] as k, count(*) as n_children from node where d > 0 group by 1),
own_sums as (select node.k, d, coalesce(n_children, 0) as n_children, case when d = 0 then 0 else (n_convs - 1) * length(k[d].text) end as saved from node left join child using (k)),
below as (select k[1:a] as k, sum(saved)::bigint as saved_tokens, count(*) filter (where n_children = 0) as n_leaves from (select *, unnest(range(0, d + 1)) as a from own_sums) group by 1)
select node.conv_id, node.d::bigint as depth, parent.conv_id as parent_conv_id, node.n_convs, own_sums.n_children, below.n_leaves, below.saved_tokens, node.ends_sha256
from node join own_sums using (k) join below using (k) left join node parent on node.d > 0 and parent.k = node.k[1:node.d - 1]"""
