"""Host-level quality rules.

Rules are counted for each whole text; their failures are aggregated by host (here `source`), the
rates are shrunk with a beta prior fitted to all hosts by moments, and the verdicts of the hosts are
joined back: broadcast while they are few, else by host and a salt, so a host of a third of all rows is
dealt over many tasks. A host fails if the shrunk rate of any rule is over `most`, or if it is at least `least` and the host is an outlier
against the prior: its posterior lies above OUTLIER times the mean of all hosts with a probability of 0.99 (by its mean and variance).

Defined cases: a null or empty text has no words, so it fails the base rule; a null host is a host of its
own; rows are judged one by one, so repeated rows count as often as they occur; no rows give no rows;
columns beside doc_id, text and the host aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.llm.common import WHITE, lean_workers, lookup, materialise

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = b"#*$%&|<>"
#: rule -> SQL over the counts; `base` is the contract's.
RULES = {
    "base": "n_words < 50 or 100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
}
#: Times the mean of all rows that an outlier's rate is above, and the standard deviations that a probability of 0.99 takes.
OUTLIER, SURE = 2.0, 2.326
#: The least and greatest share of the variance that differs between hosts.
RHO = (1e-6, 1 - 1e-6)


def counts_of(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    lines, seen, dup = text.split("\n"), set(), 0
    n_lines = 0
    for line in lines:
        if line and line.strip(" \t\n\x0b\x0c\r"):
            n_lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = 0
    if n > 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        m = len(number)
        if m < n:
            if m < 2_000_000:
                key = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
            else:
                _, pair = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)
                key = pair[:-1].astype(np.int64) * m + ids[2:]
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            if same.any():
                twice = np.zeros(n - 2, bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                cover = np.zeros(n, bool)
                cover[:-2] |= twice
                cover[1:-1] |= twice
                cover[2:] |= twice
                repeat = int(cover.sum())
    white = len(raw) - len(raw.translate(None, WHITE))
    return n, len(text) - white, len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeat, n_lines


def count_columns(text: Column) -> Column:
    """A struct of COUNTS for each text."""

    @F.arrow_udf(StructType([StructField(c, LongType(), False) for c in COUNTS]))
    def counts(col: pa.Array) -> pa.Array:
        rows = [counts_of(t.as_py()) for t in col]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))], names=list(COUNTS))

    return counts(text)


def host_rates(judged: DataFrame, rules: dict[str, str]) -> DataFrame:
    """host, n, and for each rule its shrunk failure rate `{rule}_rate`, and `{rule}_over`: whether the host's posterior is surely above OUTLIER
    times the mean."""
    hosts = materialise(judged.groupBy("host").agg(F.count("*").cast("double").alias("n"), *[F.sum(F.col(f"{r}_failed").cast("double")).alias(r) for r in rules]))
    prior = hosts.agg(F.sum("n").alias("all_n"), F.count("*").alias("hosts"), *[F.sum(r).alias(f"f_{r}") for r in rules], *[F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"q_{r}") for r in rules])
    out = hosts.join(F.broadcast(prior))  # one row
    for r in rules:
        mean = F.col(f"f_{r}") / F.col("all_n")
        spread = F.col(f"q_{r}") - F.col("all_n") * mean * mean  # sum of n (rate - mean)^2
        rho = F.when((mean > 0) & (mean < 1) & (F.col("all_n") > F.col("hosts")), (spread / (mean * (1 - mean)) - F.col("hosts")) / (F.col("all_n") - F.col("hosts"))).otherwise(0.0)
        strength = 1 / F.least(F.greatest(rho, F.lit(RHO[0])), F.lit(RHO[1])) - 1
        out = out.withColumn(f"{r}_rate", (F.col(r) + strength * mean) / (F.col("n") + strength))
        rate = F.col(f"{r}_rate")
        out = out.withColumn(f"{r}_over", rate - OUTLIER * mean >= SURE * F.sqrt(rate * (1 - rate) / (F.col("n") + strength + 1)))
    return out.select("host", "n", *[f"{r}_{c}" for r in rules for c in ("rate", "over")])


def verdicts(docs: DataFrame, host: str = "source", most: float = 0.5, least: float = 0.2, rules: dict[str, str] | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, kept, the host and its highest shrunk rate, for every row of docs."""
    rules = rules or RULES
    lean_workers(docs.sparkSession)
    key = F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))
    judged = docs.select("doc_id", key.alias("host"), count_columns(F.col("text")).alias("c")).select("doc_id", "host", "c.*")
    for r, rule in rules.items():
        judged = judged.withColumn(f"{r}_failed", F.expr(rule))
    judged = materialise(judged)
    rates = host_rates(judged, rules)
    bad = [(F.col(f"{r}_rate") > most) | ((F.col(f"{r}_rate") >= least) & F.col(f"{r}_over")) for r in rules]
    rates = materialise(rates.select("host", F.greatest(F.lit(0.0), *[f"{r}_rate" for r in rules]).alias("host_rate"), F.greatest(F.lit(False), *bad).alias("host_failed")))
    out = lookup(judged, rates, ["host"], F.col("doc_id"))
    return out.select("doc_id", *COUNTS[:5], F.col("base_failed"), (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), F.round("host_rate", 6).alias("host_rate"))


def oracle_sql(most: float = 0.5, least: float = 0.2) -> str:
    """The same in DuckDB's SQL, over documents."""
    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    rate = lambda r: f"""case when f_{r} > 0 and f_{r} < NN and NN > HH then least(greatest(((q_{r} - f_{r} * f_{r} / NN) / ((f_{r} / NN) * (1 - f_{r} / NN)) - HH) / (NN - HH), {RHO[0]}), {RHO[1]}) else {RHO[0]} end"""
    shrunk = lambda r: f"({r} + (1 / ({rate(r)}) - 1) * f_{r} / NN) / (n + (1 / ({rate(r)}) - 1))"
    over = lambda r: f"{r}_rate >= {least} and {r}_rate - {OUTLIER} * (f_{r} / NN) >= {SURE} * sqrt({r}_rate * (1 - {r}_rate) / (n + {r}_strength + 1))"
    failed = ", ".join(f"coalesce({x}, false) as {r}_failed" for r, x in RULES.items())
    return f"""
with w as (select doc_id, source, coalesce(text, '') as t, {words} as ws from documents),
win as (select doc_id, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) > 2),
key as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as k from win),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as c from key) where c > 1),
rep as (select doc_id, count(distinct i + d) as n_repeat_words from twice, (values (0), (1), (2)) as x(d) group by doc_id),
lines as (select doc_id, unnest(string_split(t, chr(10))) as line from w),
full_lines as (select doc_id, line from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from full_lines group by doc_id),
c as (select w.doc_id, source, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0) as n_lines
  from w left join rep using (doc_id) left join dup using (doc_id)),
j as (select *, {failed} from c),
h as (select source, count(*)::double as n, {", ".join(f"sum({r}_failed::int)::double as {r}" for r in RULES)} from j group by source),
p as (select sum(n) as NN, count(*)::double as HH, {", ".join(f"sum({r}) as f_{r}, sum({r} * {r} / n) as q_{r}" for r in RULES)} from h),
s as (select *, {", ".join(f"{shrunk(r)} as {r}_rate, 1 / ({rate(r)}) - 1 as {r}_strength" for r in RULES)} from h, p),
r as (select source, greatest(0.0, {", ".join(f"{r}_rate" for r in RULES)}) as host_rate, {" or ".join(f"{r}_rate > {most} or ({over(r)})" for r in RULES)} as host_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and not host_failed) as kept, round(host_rate, 6) as host_rate
from j join r on j.source is not distinct from r.source"""
