"""What happens beyond the bounds of broadcasts, and with texts of over a megabyte."""

import base64
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from lodestone.llm import attribution, bpe, near, pieces, quality, queries, shards

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 7}", len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, t + " tail", "en", f"s{i % 3}", 1) for i, t in enumerate(texts[:12])] + [(200 + i, texts[0], "en", "s0", 1) for i in range(5)]
    return spark.createDataFrame(rows, KIND)


def test_near_copies_and_shards_beyond_their_broadcasts(docs, monkeypatch):
    rows = lambda df: Counter(tuple(r) for r in df.collect())
    links, placed = rows(near.near_copies(docs)), rows(shards.assignment(docs))
    monkeypatch.setattr(near, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(shards, "SOURCES", 1)
    assert rows(near.near_copies(docs)) == links and rows(shards.assignment(docs)) == placed


def test_one_doc_id_on_very_many_rows(spark):
    x = spark.createDataFrame([(7, f"t{i}", "en", "s", 1) for i in range(3000)] + [(8, "u", "en", "r", 1)], KIND)
    got = shards.assignment(x, 4).collect()
    assert sorted(Counter(r["shard"] for r in got).values()) == [750, 750, 750, 751]
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == [*range(sum(r["shard"] == s for r in got))] for s in range(4))


def test_texts_of_over_a_megabyte(spark):
    rng = random.Random(10)
    long = " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(220_000)) + "\n" + "x" * 50_000 + "\n" + "= " * 1000
    assert len(long) > 1_200_000
    x = spark.createDataFrame([(1, long, "en", "s", 1), (2, "short", "en", "s", 1)], KIND)
    ranks = {base64.b64decode(a): int(b) for a, b in (r.split() for r in open(queries.RANKS, "rb"))}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = e.encode_ordinary(long)
    got = {r["doc_id"]: r for r in bpe.round_trip(x, queries.RANKS, public_tokenizers.PATTERN).collect()}
    assert got[1]["ids"] == ids and bytes(got[1]["data"]) == long.encode()
    counts = attribution.section_counts(x, queries.RANKS, public_tokenizers.PATTERN).filter("doc_id = 1").collect()
    assert sum(r["n_tokens"] for r in counts) == len(ids) and len(counts) == 4
    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    mine = {r["doc_id"]: r for r in pieces.round_trip(x, queries.PIECES).collect()}
    assert mine[1]["ids"] == model.encode(long, add_eos=True) and mine[1]["text"] == long
    rule = {r["doc_id"]: r for r in quality.verdicts(x).collect()}
    assert rule[1]["n_words"] == len(long.split()) and rule[2]["base_failed"]
