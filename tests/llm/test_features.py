"""Toxicity features against a plain computation, languages of texts without letters, and very long runs."""

import math
import random
import re
import time
import unicodedata

import numpy as np
import pytest
from lodestone.llm import langid, toxicity

LEXICON = {"scum": 3.0, "vile": 2.5, "idiot": 2.0, "idiot-": 2.0, "hateful": 4.0}


def plain_features(text):
    """The features of toxicity.FEATURES, one character and one word at a time."""
    if not text:
        return [0.0] * len(toxicity.FEATURES)
    low = text.lower()
    words, now = [], ""
    for c in low + " ":
        if c.isalnum():
            now += c
        elif now:
            words.append(now)
            now = ""
    n = max(1, len(words))
    odds = lambda w: max(LEXICON.get(w, 0.0), LEXICON.get(w[:5] + "-", 0.0))
    bad = [i for i, w in enumerate(words) if odds(w) > 0]
    persons = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    near = sum(any(abs(i - j) <= toxicity.NEAR for j in persons) for i in bad)
    masked = re.findall(r"[^\W\d_]+(?:[0-9@$!*]+[^\W\d_]+)+|[@$!013457]+[^\W\d_]{2,}[^\s]*", low)
    hidden = 0
    for w in masked:
        p = w.translate(toxicity.LOOKS_LIKE).strip(".,;:?\"'()_")
        same = [x for x in LEXICON if len(x) == len(p) and "_" in p and all(a in ("_", b) for a, b in zip(p, x, strict=True)) and 2 * sum(a != "_" for a in p) >= len(x)]
        hidden += p in LEXICON or ("*" in w and bool(same))
    letters = sum(map(len, words)) or 1
    ratio = lambda chars, d: sum(c in chars for c in text) / d
    shouted = len(re.findall(r"\b[^\W\d_a-z]{3,}\b", text))
    return [
        len(bad) / n, math.log1p(len(bad)), math.log1p(len({words[i] for i in bad})), max([odds(words[i]) for i in bad], default=0.0), near / n, len(persons) / n,
        sum("A" <= c <= "Z" for c in text) / letters, shouted / n, ratio("!?", n), ratio(".,;:'\"()-", len(text)),
        ratio("#*$%&|<>@^~", len(text)), len(masked) / n, math.log1p(hidden), len(re.findall(r"([^\W\d_])\1{3,}", low)) / n,
    ]


def test_features_equal_the_plain_ones():
    rng = random.Random(3)
    parts = ["you", "scum", "VILE", "idiotic", "sc*m", "v1le", "h@teful!", "$cum", "calm", "river,", "é½²", "Sooooo", "NOW!!!", "1234", "x", "漢字", "du", "\n", "a1b2", "##", ""]
    for text in [None, "", " ", "½", "you scum"] + [" ".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(300)]:
        assert np.allclose(toxicity.features_of(text, LEXICON), plain_features(text)), text


@pytest.mark.parametrize("text", ["x" * 10**6 + " !", "1" * 10**6, "X" * 10**6, "@" * 10**6, "x1" * 500_000, "a*b" * 300_000, "ab" * 500_000])
def test_long_runs_take_linear_time(text):
    start = time.perf_counter()
    toxicity.features_of(text, LEXICON)
    assert time.perf_counter() - start < 3


def test_words_are_runs_of_letters():
    rng = random.Random(2)
    for chars in ("ab C1_.", "aé ß½²Ⅷ漢ñ _İ", "a𐐨𠀀 😀é𝟘"):
        for _ in range(300):
            t = "".join(rng.choices(chars, k=rng.randint(0, 12)))
            want, now = [], ""
            for c in t.lower() + " ":
                if unicodedata.category(c)[0] == "L":
                    now += c
                elif now:
                    want.append(now)
                    now = ""
            assert langid.words_of(t) == want
    every = "".join(chr(i) + " " for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    assert "".join(langid.words_of(every)) == "".join(c for c in every.lower() if unicodedata.category(c)[0] == "L")


def test_texts_without_a_letter_have_no_language(spark):
    kind = "doc_id long, text string, lang string"
    rows = [(i, "the river and the field", "en") for i in range(20)] + [(100 + i, t, "en") for i, t in enumerate(["½ ² ① Ⅷ", "1 2 3", "#!?", "٣", "", None, "_"])] + [(200, "²river", "fr")]
    x = spark.createDataFrame(rows, kind)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predicted(x).collect()}
    assert all(got[i] == ("und", 0.0) for i in range(100, 107)) and got[200][0] == "en" and got[3] == ("en", 1.0)
    assert {r["lang_pred"] for r in langid.predicted(x.filter("doc_id < 0").unionAll(x.limit(3).selectExpr("doc_id", "text", "cast(null as string)"))).collect()} == {"und"}
