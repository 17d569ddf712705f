"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of each source are shuffled by a seeded hash and ranked; all rows are then sorted by fractional
rank, (rank - shift) / rows of the source, and the order is cut into shards whose row counts differ by
one at most. The shift, between 0 and 1, is a hash of the source: without it all sources of one row would
meet in the middle. Each shard so holds every source in proportion, to within about one row for each cut.

No source and no shard is ever ranked in one task: ranks are counted inside hash ranges of bounded
size, and the sums of the ranges before are added. The number of ranges is at most about 50,000,
so the tables of their counts stay small.

Defined cases: a null source is a source of its own; a null text has size 1 and crc32 0; a null doc_id is
hashed as an empty one; rows that repeat a doc_id each get a slot (equal rows can't be told apart, so either
may come first); ties of the hash are ordered by doc_id, checksum and size; no rows give no rows; other
columns aren't read. The law is `rows`, which doesn't keep equal texts together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialise

RANGES, SEED = 50_000, 17
#: Sources up to which the counts of sources and ranges are broadcast (some 10 MB); beyond, they are joined by shuffles.
SOURCES = 100_000
#: Hex digits of a hash: 52 bits, which a double holds exactly.
DIGITS = 13


def _hash(seed: int, key: Column) -> Column:
    """A whole number below 2^52 from the first digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, DIGITS), 16, 10).cast("long")


def _before(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds `before`: the sum of n over the smaller values of `order`."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def interleave(docs: DataFrame, n_shards: int, seed: int = SEED, least_range: int = 2_000) -> DataFrame:
    """doc_id, src, size, text_crc32, shard and slot of every row of docs (doc_id, text, source)."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    src = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("src")
    h = _hash(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h")
    unit = 2.0 ** (-4 * DIGITS)
    per_source = docs.select(src).groupBy("src").agg(F.count("*").alias("n_src"))
    per_source = materialise(per_source.withColumn("shift", _hash(seed, F.col("src")).cast("double") * unit))
    total, n_sources = per_source.agg(F.coalesce(F.sum("n_src"), F.lit(0)), F.count("*")).first()
    small = F.broadcast if n_sources <= SOURCES else (lambda df: df)
    width = max(least_range, total // RANGES)

    def ranged(df: DataFrame) -> DataFrame:
        """Adds the range of the hash within its source: as many equal ranges as the source needs."""
        return df.join(small(per_source), "src").withColumn("range", F.floor(F.col("h").cast("double") * unit * F.ceil(F.col("n_src") / width)))

    starts = _before(ranged(docs.select(src, h)).groupBy("src", "range").agg(F.count("*").alias("n")), ["src"], "range").drop("n")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = ranged(docs.select("doc_id", src, h, (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    inner = Window.partitionBy("src", "range").orderBy("h", "doc_id", "text_crc32", "size")
    # dealt by both, as a source alone may be a third of all rows
    ranked = rows.repartition("src", "range").withColumn("r", F.row_number().over(inner)).join(small(starts), ["src", "range"])
    frac = ((F.col("r") + F.col("before")).cast("double") - F.col("shift")) / F.col("n_src")
    ranked = ranked.select("doc_id", "src", "size", "text_crc32", frac.alias("frac"))
    ranked = materialise(ranked.withColumn("range", F.floor(F.col("frac") * max(1, -(-total // width)))))

    starts = _before(ranked.groupBy("range").agg(F.count("*").alias("n")), [], "range").drop("n")
    inner = Window.partitionBy("range").orderBy("frac", "src")
    # `starts` has at most RANGES + 1 rows
    place = ranked.withColumn("r", F.row_number().over(inner)).join(F.broadcast(starts), "range").withColumn("at", (F.col("r") + F.col("before") - 1).cast("long"))
    n = max(total, 1)
    placed = place.withColumn("shard", F.expr(f"cast(at * {n_shards}L div {n}L as int)"))
    return placed.select("doc_id", "src", "size", "text_crc32", "shard", F.expr(f"at - (shard * {n}L + {n_shards - 1}L) div {n_shards}L").alias("slot"))


def assignment(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """The query's columns."""
    out = interleave(docs, n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The same in DuckDB's SQL: whole sources and all rows are ranked by one window each, and the CRC-32 follows from its polynomial.
ORACLE_SQL = f"""
with recursive t as (select range as i, range::bigint as c, 0 as k from range(256) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from t where k < 8),
crc as (select list(c order by i) as tab from t where k = 8),
d as (select doc_id, coalesce('=' || source, '') as src, coalesce(text, '') as x, ('0x' || md5('{SEED}:' || coalesce(doc_id::varchar, ''))[1:{DIGITS}])::bigint as h from documents),
s as (select doc_id, src, h, octet_length(encode(x)) + 1 as size, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda y: ('0x' || y)::bigint)),
  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32 from d, crc),
r as (select *, row_number() over (partition by src order by h, doc_id nulls first, text_crc32, size) as r, count(*) over (partition by src) as n_src, ('0x' || md5('{SEED}:' || src)[1:{DIGITS}])::bigint::double / {2 ** (4 * DIGITS)}::double as shift from s),
o as (select *, row_number() over (order by (r::double - shift) / n_src::double, src) - 1 as pos, count(*) over () as n from r),
p as (select *, floor(pos * 16 / n)::int as shard from o)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'rows' as law, shard, (pos - floor((shard * n + 15) / 16))::bigint as slot, null::int as grown_shard from p"""
