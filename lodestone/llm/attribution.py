"""Token counts of fields or sections by offset-mapped attribution.

A whole document is encoded once; the lengths of its tokens give their character spans, which are
joined to the spans of the sections. A token that overlaps several sections goes to the one with which
it shares most characters, the earlier one on a tie; a token that overlaps none goes to section -1. A
token that holds only some bytes of a character spans that character. So the counts of a document's
sections, with section -1, add up to its tokens.

Defined cases: null and empty texts have only the row of section -1, with 0 tokens; given spans must be
ascending and disjoint, empty ones get no tokens; rows are counted one by one, so repeated rows give
repeated results; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import Vocabulary, _column_slices, vocabulary
from lodestone.llm.common import lean_workers

COUNTS = "array<struct<section: int, start_char: bigint, end_char: bigint, n_tokens: bigint, n_crossing: bigint>>"


def line_spans(text: str) -> np.ndarray:
    """(start, end) of each line with a character."""
    ends = np.cumsum([len(x) + 1 for x in text.split("\n")]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    full = ends > starts
    return np.stack([starts[full], ends[full]], 1)


def token_spans(v: Vocabulary, raw: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens."""
    end = np.cumsum(v.length[ids])
    char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return char[end - v.length[ids]] - 1, char[end - 1]


def attribute_spans(start: np.ndarray, end: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token (-1: none) and whether it overlaps more than one."""
    if not len(spans):
        return np.full(len(start), -1), np.zeros(len(start), bool)
    a = np.searchsorted(spans[:, 1], start, "right")
    b = np.searchsorted(spans[:, 0], end, "left") - 1
    section, crossing = np.where(a <= b, a, -1), a < b
    for i in np.flatnonzero(crossing):
        s = spans[a[i] : b[i] + 1]
        shared = np.minimum(s[:, 1], end[i]) - np.maximum(s[:, 0], start[i])
        section[i] = a[i] + int(shared.argmax())
    return section, crossing


def counts_column(text: Column, path: str, pattern: str, spans: Column | None = None) -> Column:
    """COUNTS of each text: by lines, or by `spans` (array<struct<start, end>> in characters)."""

    def count(col: pa.Array, given: pa.Array | None) -> pa.Array:
        v, out = vocabulary(path, pattern), []
        for i, j in _column_slices(col):
            texts = [t or "" for t in col.slice(i, j - i).to_pylist()]
            ids, ends = v.encode_batch(texts)
            for k, t in enumerate(texts):
                start, end = token_spans(v, t.encode("utf-8", "surrogatepass"), ids[ends[k] : ends[k + 1]])
                if given is None:
                    s = line_spans(t)
                else:
                    s = np.array([(x["start"], x["end"]) for x in given[i + k].as_py() or []], np.int64).reshape(-1, 2)
                section, crossing = attribute_spans(start, end, s)
                n, c = np.bincount(section + 1, minlength=len(s) + 1), np.bincount(section[crossing] + 1, minlength=len(s) + 1)
                rows = [(-1, None, None, int(n[0]), int(c[0]))] + [(x, int(s[x, 0]), int(s[x, 1]), int(n[x + 1]), int(c[x + 1])) for x in range(len(s))]
                out.append([dict(zip(("section", "start_char", "end_char", "n_tokens", "n_crossing"), r, strict=True)) for r in rows])
        kind = pa.struct([("section", pa.int32()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])
        return pa.array(out, pa.list_(kind))

    if spans is None:

        @F.arrow_udf(COUNTS)
        def by_line(col: pa.Array) -> pa.Array:
            return count(col, None)

        return by_line(text)

    @F.arrow_udf(COUNTS)
    def by_span(col: pa.Array, given: pa.Array) -> pa.Array:
        return count(col, given)

    return by_span(text, spans)


def section_counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, section, start_char, end_char, n_tokens, n_crossing for each line of each row, and section -1."""
    lean_workers(docs.sparkSession)
    x = docs.select("doc_id", F.explode(counts_column(F.col("text").cast("string"), path, pattern)).alias("c"))
    return x.select("doc_id", "c.*")


def field_counts(df: DataFrame, fields: list[str], path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """key, field, n_tokens, n_crossing: tokens of the text that joins the fields with line breaks, by field."""
    lean_workers(df.sparkSession)
    value = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    spans, at = [], F.lit(0).cast("long")
    for v in value:
        spans.append(F.struct(at.alias("start"), (at + F.length(v)).alias("end")))
        at = at + F.length(v) + 1
    x = df.select(F.col(key), F.explode(counts_column(F.concat_ws("\n", *value), path, pattern, F.array(*spans))).alias("c"))
    name = F.when(F.col("c.section") >= 0, F.element_at(F.array(*map(F.lit, fields)), F.col("c.section") + 1))
    return x.select(key, name.alias("field"), "c.n_tokens", "c.n_crossing")
