"""The prefix trie against plain code."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from lodestone.llm import trie

KIND = "conv_id long, turn long, role string, text string, path string, key int"


def rows_of():
    rng, rows = random.Random(4), []
    for c in [*range(0, 60), *range(100, 140), *range(300, 330), -7, -100, -130, 1000, 1001, 1002]:
        n = rng.choice([1, 2, 3, 5, 7, 9, 12])
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["a", "bé", "same 漢", "", "w x"][: 2 + c % 3])) for t in range(n)]
    rows += [(c, t, "user", f"long {min(t, 30)}") for c in (210, 211, 212) for t in range(40 if c == 212 else 31)]  # one is the beginning of another
    rows += [(c, t, "user", "copy") for c in range(400, 440) for t in range(9)]  # copies
    rows += [(500, None, "user", "before"), (500, 1, None, "x"), (500, 2, "user", None), (500, 2, "user", None), (500, 2, "assistant", "tie"), (501, 0, "", ""), (None, 0, "user", "nobody"), (None, None, None, None)]
    rows += [(600, 0, "user", "q" * 70_000), (600, 1, "ab", "c"), (600, 2, "a", "bc")]
    rng.shuffle(rows)
    return [(*r, "p", 1) for r in rows]


def plain(rows):
    """Nodes one by one, from the prefixes of all conversations."""
    own = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append(((t is not None, t or 0, role or "", hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    children = Counter(p[:-1] for p in members if p)
    out = Counter()
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in m if len(built[c]) == len(p))
        out[min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], sum(not children[q] for q in below), sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()] += 1
    return out


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame(rows_of(), KIND).repartition(3)


def test_trie_equals_plain_code(talks):
    assert Counter(tuple(r) for r in trie.trie(talks).collect()) == plain(rows_of())
    assert trie.trie(talks.limit(0)).count() == 0
    assert trie.trie(talks.filter("conv_id is null")).count() == 0


@pytest.mark.parametrize(("shallow", "most", "heavy"), [(2, 5, 3), (1, 200_000, 1), (0, 1, 50_000)])
def test_large_groups_and_many_children(talks, monkeypatch, shallow, most, heavy):
    """Levels in Spark, tasks and both kinds of lookup give the same rows."""
    monkeypatch.setattr(trie.nodes, "__defaults__", (shallow, most))
    monkeypatch.setattr(trie.with_parents, "__defaults__", (heavy,))
    monkeypatch.setattr(trie, "HEAVY", 10**9)
    assert Counter(tuple(r) for r in trie.trie(talks).collect()) == plain(rows_of())


def test_conversations_without_turns_end_at_the_root(spark):
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 1)
    x = spark.createDataFrame([(c, 0, "user", "only")], "conv_id int, turn int, role string, text string")
    assert [tuple(r) for r in trie.trie(x).collect()] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
