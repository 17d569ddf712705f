"""Small cases of the operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; brute force."""

import base64
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from lodestone.llm import attribution, bpe, langid, lm, mixing, near, quality, shards, topk, toxicity
from pyspark.sql import functions as F

KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def rows_of(n=40):
    rng = random.Random(2)
    word = lambda a: "".join(rng.choices(a, k=rng.randint(2, 7)))
    rows = []
    for i in range(n):
        text = "\n".join(" ".join(word("abcde" if i % 2 else "vwxyzé") for _ in range(30)) for _ in range(3))
        rows.append((i, text, "aa" if i % 2 else "zz", f"s{i % 3}", len(text), 1.0, 1))
    rows += [(100, None, None, None, None, None, None), (101, "", "aa", "s0", 0, 1.0, 1), (None, "some text here", "zz", None, 3, 1.0, 1), (102, "1 2 3 ###", None, "s1", 9, 1.0, 1)]
    rows += [(103, rows[0][1], "zz", "s0", 1, 1.0, 1), (0, *rows[0][1:]), (104, "漢字 " * 3000 + "x" * 3000, "zz", "s2", 1, 1.0, 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), KIND)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def test_bpe(docs, none):
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb"))}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    want = Counter((d, tuple(e.encode_ordinary(t or "")), (t or "").encode()) for d, t, *_ in rows_of())
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["data"])) for r in got) == want
    assert bpe.digests(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_attribution(docs, none):
    got = attribution.section_counts(docs, RANKS, public_tokenizers.PATTERN).collect()
    per = Counter()
    for r in got:
        per[r["doc_id"]] += r["n_tokens"]
    want = Counter()
    for r in bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect():
        want[r["doc_id"]] += len(r["ids"])
    assert per == want
    assert attribution.section_counts(none, RANKS, public_tokenizers.PATTERN).count() == 0
    section, crossing = attribution.attribute_spans(np.array([0, 3, 5, 9]), np.array([3, 5, 9, 10]), np.array([[0, 4], [4, 9]]))
    assert section.tolist() == [0, 0, 1, -1] and crossing.tolist() == [False, True, False, False]
    f = attribution.field_counts(docs, ["lang", "text"], RANKS, public_tokenizers.PATTERN)
    assert f.filter("field = 'lang' and n_tokens > 0").count() > 0


def test_near(spark, docs, none):
    base = [f"w{i}" for i in range(60)]
    more = [(200 + i, " ".join(base[:i] + ["new"] + base[i + 1 :])) for i in range(0, 60, 7)] + [(300, " ".join(base)), (301, " ".join(base))]
    x = docs.select("doc_id", "text").unionAll(spark.createDataFrame(more, "doc_id long, text string"))
    data = [(r["doc_id"], r["text"]) for r in x.collect()]

    def grams(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None

    g = [grams(t) for _, t in data]
    links = [sum(1 for j in range(len(g)) if j != i and g[i] and g[j] and len(g[i] & g[j]) >= 0.8 * len(g[i] | g[j]) - 1e-6) for i in range(len(g))]
    got = near.near_copies(x).collect()
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in got) == sorted((str(d), n) for (d, _), n in zip(data, links, strict=True))
    group = {r["doc_id"]: r["class_id"] for r in got}
    assert group[300] == group[301] == group[200] == 200 and group[103] == 0
    old, near.BLOCK = near.BLOCK, 3  # several blocks in a bucket
    try:
        again = near.near_copies(x).collect()
    finally:
        near.BLOCK = old
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert near.near_copies(none).count() == 0
    kept = [r["doc_id"] for r in near.one_of_each(docs).collect()]
    assert kept.count(0) == 1 and 103 not in kept and 100 in kept and None in kept
    bands, rows = near.bands_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_near_copies_of_rows_that_share_ids(spark):
    text = lambda k, i=None: " ".join("new" if j == i else f"{k}{j}" for j in range(60))
    # the ids 1 and 5 have several texts, a has near copies without an id, and the classes b and c have the same smallest id
    data = [(1, text("a")), (2, text("a", 30)), (None, text("a", 31)), (1, text("b")), (1, text("c")), (3, text("c", 9)), (5, text("b", 20)), (5, text("d"))]
    data += [(None, text("e")), (None, text("f")), (None, text("f", 5)), (1, None), (1, None), (7, text("g")), (7, text("g"))]
    x = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(data)], "doc_id long, text string, row long")
    g = [frozenset(tuple(t.split()[i : i + 5]) for i in range(56)) if t else None for _, t in data]
    alike = [[j for j in range(len(g)) if g[i] and g[j] and len(g[i] & g[j]) >= 0.8 * len(g[i] | g[j])] or [i] for i in range(len(g))]
    want = Counter((data[i][0], len(a) - 1, sum(g[j] != g[i] for j in a)) for i, a in enumerate(alike))
    assert Counter((r["doc_id"], r["n_links"], r["n_linked_classes"]) for r in near.near_copies(x).collect()) == want
    kept = near.one_of_each(x).collect()
    assert {len(a) for a in alike} == {1, 2, 3} and all(set(alike[j]) == set(a) for a in alike for j in a)
    assert Counter(min(alike[r["row"]]) for r in kept) == Counter(min(a) for a in {tuple(a) for a in alike})
    assert {r["row"] for r in kept} >= {0, 3, 4, 7, 8, 11, 12} and near.one_of_each(x).columns == x.columns


def test_topics_are_fitted_on_all_rows(spark):
    rng = random.Random(5)
    alphabets = ["abcd", "efgh", "ijkl"]
    word = lambda a: "".join(rng.choices(a, k=2))
    # one topic has 3 rows of 20,403, so a sample of 10,000 rows would have one or two of them or none
    data = [(i, " ".join(word(alphabets[i % 2]) for _ in range(12))) for i in range(20_400)] + [(None, "zz zz zz zz zz zz")] * 3 + [(-1, None), (-2, " ")]
    x = spark.createDataFrame(data, "doc_id long, text string")
    first, again = mixing.fit_topics(x.repartition(3)), mixing.fit_topics(x.orderBy(F.rand(1)).repartition(7))
    assert first.shape == (mixing.TOPICS, mixing.WIDTH) and (first == again).all()
    v, n = mixing._profiles([t or "" for _, t in data])
    sums = mixing._sums(spark.createDataFrame([(r.astype("<i2").tobytes(),) for r, k in zip(v, n, strict=True) if k], "v binary"), first)
    near = (v @ first.T).argmax(1)
    assert all(list(map(int, sums[k])) == v[(near == k) & (n > 0)].sum(0).astype(int).tolist() for k in range(len(first)))
    assert len(mixing.fit_topics(x.filter("doc_id < 0"))) == 0 and len(mixing.fit_topics(x.filter("doc_id is null"))) == 1


def test_topk(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 8)).round(1)
    v[7] = v[3]
    rows = [(i, [float(x) for x in v[i]]) for i in range(90)] + [(95, None), (96, [float("nan")] * 8), (97, [None] + [1.0] * 7), (98, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = np.floor(64 * v).astype(int)
    want = set()
    for i in range(0, 90, 20):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(90) if j != i)[:5]
        want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    twice = df.unionAll(df.filter("vec_id % 7 = 0"))  # rows that repeat a vec_id count once
    for x, dealt in ((df, None), (twice, (3, 20))):
        assert sorted(tuple(r) for r in topk.search(x, F.col("vec_id") % 20 == 0, 5, 64, dealt).collect()) == sorted(want)
    assert topk.blocks(10**6, 2 * 10**7, 64, 8) == (31, 611) and topk.blocks(500, 10_000, 64, 8) == (1, 3) and topk.blocks(0, 0, 1, 8) == (1, 1)
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_shards(docs, none):
    for least in (2000, 3):
        got = shards.interleave(docs, 4, least_range=least).collect()
        by = {}
        for r in got:
            by.setdefault(r["shard"], []).append(r)
        sizes = [len(x) for x in by.values()]
        assert sum(sizes) == len(rows_of()) and max(sizes) - min(sizes) <= 1
        assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
        n = Counter((r["shard"], r["src"]) for r in got if r["src"] == "=s0")
        assert max(n.values()) - min(n.values()) <= 2
    for r in got:
        if r["doc_id"] == 104:
            t = rows_of()[-1][1].encode()
            assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t)
    assert shards.assignment(none).count() == 0


def test_quality(docs, none):
    assert quality.counts_of("a b c a b c d\nx\nx")[:5] == (9, 9, 0, 1, 6)
    got = {r["doc_id"]: r for r in quality.verdicts(docs).collect()}
    assert got[100]["base_failed"] and got[101]["n_words"] == 0 and not got[1]["base_failed"]
    assert quality.verdicts(none).count() == 0


def test_lm(docs, none):
    got = lm.scored(docs).collect()
    train = [(d, t) for d, t, *_ in rows_of() if zlib.crc32(str(d if d is not None else "").encode()) % 5 != 1]
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for _, t in train for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = Counter((str(d), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok(t)), 6)) for d, t, *_ in rows_of())
    assert Counter((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    x = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("held_out"))
    once, thrice = (sorted(lm.score_texts(x, x, limit=k).collect(), key=str) for k in (10**8, 20_000))
    assert once == thrice
    assert lm.scored(none).count() == 0


def test_language(docs, none):
    got = {r["doc_id"]: r for r in langid.predicted(docs).collect()}
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == got[102]["lang_pred"] == "und"
    assert all(got[i]["lang_pred"] == ("aa" if i % 2 else "zz") for i in range(40))
    mixed = docs.sparkSession.createDataFrame([(1, rows_of()[1][1] + " " + rows_of()[0][1])], "doc_id long, text string")
    model = langid.train(docs)
    spans = model.predict([mixed.first()["text"]], spans=True)[0][2]
    assert [s[0] for s in spans] == ["aa", "zz"] and abs(spans[0][2] - 90) <= 3
    assert langid.predicted(none).count() == 0
    assert langid.with_a_language(docs).columns == docs.columns


def test_viterbi_equals_the_plain_search():
    rng = np.random.default_rng(3)
    for _ in range(20):
        s = rng.normal(size=(12, 3)).astype(np.float32) * 4
        m = langid.Model.__new__(langid.Model)
        m.langs, m.scores = ["a", "b", "c"], lambda w, s=s: s
        path = m.label([[f"{chr(97 + i)}" for i in range(12)]])[0]
        best, v = None, s[0].astype(float)
        back = []
        for t in range(1, 12):
            step = v[:, None] - langid.PENALTY * (1 - np.eye(3))
            back.append(step.argmax(0))
            v = step.max(0) + s[t]
        best = float(v.max())
        got = sum(float(s[t, p]) for t, p in enumerate(path)) - langid.PENALTY * sum(a != b for a, b in zip(path, path[1:], strict=False))
        assert abs(best - got) < 1e-3


def test_toxicity(spark, docs, none):
    kind = "doc_id long, toxic int, quality int"
    rng = random.Random(9)
    calm = ["sun", "river", "stone", "field", "cloud", "green"]
    data = [(i, " ".join(rng.choices(calm, k=40) + (["vile", "scummy"] if i % 4 == 0 else [])), "aa", "s", 1, 1.0, 1) for i in range(400)]
    x = spark.createDataFrame(data, KIND)
    y = spark.createDataFrame([(i, int(i % 4 == 0), None) for i in range(400)] + [(5, None, None), (None, 1, 1)], kind)
    got = toxicity.scored(x, y).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 40 and sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.without_toxic(x, y).columns == x.columns
    assert toxicity.scored(docs, y.limit(0)).filter("score <> 0").count() == 0
    assert toxicity.scored(none, y).count() == 0


def plain_raking(cells, goals, sweeps):
    """cells: {(category, ...): tokens}; goals: for each place of the key a power or weights."""
    total = sum(cells.values())
    w = {c: float(t) for c, t in cells.items()}
    for _ in range(sweeps):
        for d, g in enumerate(goals):
            mass, now = Counter(), Counter()
            for c, t in cells.items():
                mass[c[d]] += t
                now[c[d]] += w[c]
            want = {k: g.get(k, 0.0) if isinstance(g, dict) else m**g for k, m in mass.items()}
            scale = total / sum(want.values())
            w = {c: v * want[c[d]] * scale / now[c[d]] if now[c[d]] else 0.0 for c, v in w.items()}
    return w


def test_raking(spark, monkeypatch):
    plain = {("a", "x"): 5, ("a", "y"): 20, ("b", "x"): 70, ("b", "y"): 5, ("c", "y"): 9, (None, "x"): 11}
    cells = spark.createDataFrame([("" if k is None else f"={k}", f"={v}", t) for (k, v), t in plain.items()], "k string, l string, t long")
    given = {"a": 3.0, "b": 1.0, None: 2.0, "nowhere": 9.0}
    for goals in ([0.5, 0.5], [given, 0.7], [given, {"x": 1, "y": 1}]):
        want = plain_raking(plain, goals, 500)
        for small in (mixing.SMALL, 0) if goals[1] == 0.7 else (mixing.SMALL,):
            out, gap = mixing.rake(cells, ["k", "l"], goals, small=small)
            got = {((r["k"] or "=")[1:] or None if r["k"] == "" else r["k"][1:], r["l"][1:]): r["w"] for r in out.collect()}
            assert gap <= mixing.TOLERANCE and all(abs(got[c] - w) <= 1e-4 * max(1, w) for c, w in want.items())
    # no cell joins a and y, so these weights can't be met: they aren't taken for met
    apart = cells.filter("(k = '=a') = (l = '=x')")
    monkeypatch.setattr(mixing, "SWEEPS", 6)
    for small in (mixing.SMALL, 0):
        with pytest.warns(UserWarning, match="gap"):
            assert mixing.rake(apart, ["k", "l"], [{"a": 1, "b": 9}, {"x": 9, "y": 1}], small=small)[1] > 0.1
    with pytest.raises(RuntimeError, match="gap"):
        mixing.rake(apart, ["k", "l"], [{"a": 1, "b": 9}, {"x": 9, "y": 1}], strict=True)
    with pytest.raises(ValueError, match="weight"):
        mixing.rake(cells, ["k", "l"], [{"nowhere": 1}, 0.5])


@pytest.mark.parametrize("targets", [None, {"source": {"s0": 1.0, "s1": 5.0, "s2": 1.0, None: 0.5}, "lang": 1.0}])
@pytest.mark.filterwarnings("ignore:raking stopped")
def test_mixing(docs, none, targets, monkeypatch):
    monkeypatch.setattr(mixing, "SWEEPS", 2)
    got = mixing.mixed(docs, 0.5, targets=targets).collect()
    assert len(got) == len(rows_of())
    goals = [{**mixing.POWERS, **(targets or {})}[d] for d in mixing.DIMS]
    cells = Counter()
    for r in got:
        cells[r["source"], r["lang"], r["topic"]] += r["n_tokens"]
    want = plain_raking(cells, goals, 2)
    t = sum(cells.values())
    k = 1.0
    for _ in range(200):  # the share of tokens grows with k
        full = {c for c in cells if k * want[c] >= cells[c]}
        k = (0.5 * t - sum(cells[c] for c in full)) / sum(want[c] for c in cells if c not in full)
    assert abs(sum(r["n_tokens"] * r["probability"] for r in got) / t - 0.5) < 1e-6
    u = {r[0]: r[1] for r in docs.select("doc_id", mixing.uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 29)).collect()}
    assert len(set(u.values())) > 40 and all(0 <= v < 1 for v in u.values())
    for r in got:
        c = r["source"], r["lang"], r["topic"]
        assert abs(r["weight"] - want[c] / cells[c]) < 1e-6 * (1 + r["weight"]) and abs(r["probability"] - min(1, k * want[c] / cells[c])) < 1e-6
        assert r["kept"] == (u[r["doc_id"]] < r["probability"]) and r["raking_gap"] > mixing.TOLERANCE  # two sweeps are too few here
    assert mixing.mixed(none).count() == 0
    kept = mixing.sample(docs, targets=targets)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])
    monkeypatch.setattr(mixing, "SMALL", 1)  # many cells: raked and joined apart from the driver
    again = mixing.mixed(docs, 0.5, targets=targets).collect()
    assert sorted((str(r["doc_id"]), round(r["probability"], 4)) for r in again) == sorted((str(r["doc_id"]), round(r["probability"], 4)) for r in got)
