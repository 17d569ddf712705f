"""Pieces and alignment against the libraries and plain code."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from lodestone.llm import align, chunks, pieces, queries
from tokenizers import Tokenizer

RNG = random.Random(5)
LETTERS = "ab the in \n\t é漢ข🙂\x00　\xa0</s><0x41>ingtion,.'1239's'll \x85\x1cᲉ▁"
TEXTS = [
    None, "", " ", "  a", "a b", "x" * 3000, "ab" * 300 + " " * 77 + "the" * 200, " lead", "trail  ", "<s> a </s> <|endoftext|> x", "a \xa0 b", "▁", "a▁b", "= " * 40 + "=" * 90, "same text", "same text", "\n", "a\n\n b",
    *("".join(RNG.choices(LETTERS, k=RNG.randint(1, 60))) for _ in range(400)),
    *("".join(chr(RNG.choice([RNG.randint(32, 126), RNG.randint(0xA0, 0x2FFF), RNG.randint(0x10000, 0x1FFFF), 32])) for _ in range(RNG.randint(1, 40))) for _ in range(200)),
]
SCHEMA = "doc_id long, text string, ids string, words long, `__row` string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 14 else 15, t, "x", 1, "y") for i, t in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


@pytest.fixture(scope="module")
def letters():
    t = Tokenizer.from_file(queries.BYTE_LEVEL)
    t.encode_special_tokens = True
    return t


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_pieces_equal_the_library(spark, docs, model):
    ids = [model.encode(t or "", add_eos=True) for t in TEXTS]
    want = Counter((i if i != 14 else 15, tuple(x), model.decode(x)) for i, x in enumerate(ids))
    got = pieces.round_trip(docs, queries.PIECES)
    assert Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in got.collect()) == want
    rows = Counter(tuple(r) for r in pieces.digests(docs, queries.PIECES).collect())
    assert rows == Counter((i, len(x), sha(" ".join(map(str, x))), sha(t)) for i, x, t in want.elements())
    assert pieces.digests(docs.limit(0), queries.PIECES).count() == 0
    x = got.select("ids", pieces.decode(got["ids"], queries.PIECES).alias("back"), "text").collect()
    assert all(r["back"] == r["text"] for r in x)


def test_pieces_decode_any_ids(model):
    p = pieces.Pieces(queries.PIECES)
    lists = [[RNG.choice([0, 1, 2, 259, 260, RNG.randint(3, 258), RNG.randint(3, 258), RNG.randint(259, 31999), 28705]) for _ in range(RNG.randint(0, 8))] for _ in range(3000)]
    ends = [0]
    for x in lists:
        ends.append(ends[-1] + len(x))
    import numpy as np

    assert p.decode(np.array([i for x in lists for i in x], np.int32), np.array(ends)).to_pylist() == [model.decode(x) for x in lists]


def test_small_tables_and_long_runs(monkeypatch, model):
    """The table starts anew, and runs of all lengths are merged both ways, with the same ids."""
    p, texts = pieces.Pieces(queries.PIECES), [t or "" for t in TEXTS]
    want = [model.encode(t) for t in texts]
    for most, long in ((5, 48), (500_000, 0), (500_000, 10_000)):
        monkeypatch.setattr(chunks, "MOST", most)
        monkeypatch.setattr(pieces, "LONG", long)
        p.table.clear()
        got = []
        for part in chunks.slices(pa.array(texts), 2000):
            ids, at = p.encode(chunks.Laid(pieces.unmarked(part)))
            got += [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
        assert got == want


def test_models_that_do_not_fit_raise(tmp_path):
    with open(queries.PIECES, "rb") as f:
        data = f.read()
    crossing = "ab▁c".encode()
    row = b"\x0a" + bytes([len(crossing)]) + crossing + b"\x15\x00\x00\x80\xbf"
    (tmp_path / "m").write_bytes(data + b"\x0a" + bytes([len(row)]) + row)
    with pytest.raises(ValueError, match="crosses"):
        pieces.Pieces(str(tmp_path / "m"))


def plain_alignment(text, letters, model):
    """Ids of both sides with byte ranges, token by token; groups and links by comparing all tokens."""
    if not text or "▁" in text:
        return [], [], [], []
    raw = (" " + text).encode()
    inverse, side = align.byte_letters(), []
    names = {i: t for t, i in letters.get_vocab().items()}
    one = [(i, bytes(inverse[c] for c in names[i])) for i in letters.encode(" " + text, add_special_tokens=False).ids]
    two = [(i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()) for i in model.encode(text) for p in [model.id_to_piece(i)]]
    for tokens in (one, two):
        at, out = 0, []
        for i, b in tokens:
            out.append((i, at, at + len(b)))
            at += len(b)
        assert b"".join(b for _, b in tokens) == raw
        side.append(out)
    a, b = side
    links = [(x, y) for x, s, e in a for y, u, v in b if s < v and u < e]
    cuts = sorted({e for *_, e in a} & {e for *_, e in b})
    groups, low = [], 0
    for c in cuts:
        groups.append([[x for x, _, e in t if low < e <= c] for t in (a, b)])
        low = c
    return a, b, groups, links


def test_alignment_equals_plain_code(spark, docs, letters, model, monkeypatch):
    plain = [plain_alignment(t, letters, model) for t in TEXTS]
    count = Counter(p for *_, links in plain for p in set(links))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    want = Counter()
    for i, (a, b, groups, links) in enumerate(plain):
        said = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        want[i if i != 14 else 15, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha(said) if a else ""] += 1
    assert want[0, 0, 0, 0, 0, 0, 0, ""] == 1
    args = (queries.BYTE_LEVEL, public_tokenizers.PATTERN, queries.PIECES)
    assert Counter(tuple(r) for r in align.reported(docs, *args).collect()) == want
    for heavy in (1, 30):  # no pair is broadcast, or only a few
        monkeypatch.setattr(align.with_counts, "__defaults__", (heavy,))
        assert Counter(tuple(r) for r in align.reported(docs, *args).collect()) == want
    assert align.reported(docs.limit(0), *args).count() == 0
    one = next(r for r in align.aligned(docs, *args).collect() if r["doc_id"] == 4)
    assert one["groups"] == ";".join("|".join(",".join(map(str, s)) for s in g) for g in plain[4][2])
