import random
import re
import zlib
from collections import Counter

import numpy as np

from quire.llm import langid as L

SYLLABLES = {"aa": ["the", "ing", "ed", "on", "ther", "an"], "bb": ["la", "que", "ciòn", "os", "mente", "ra"], "cc": ["sch", "ung", "heit", "ver", "ein", "ü"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def rows(rng, n):
    out = []
    for i in range(n):
        lang = rng.choice(["aa", "aa", "bb", "cc"])
        t = text(rng, lang, rng.choice([1, 3, 40, 200]))
        out.append((i, t.upper() + "!!" if i % 9 == 0 else t, lang if i % 17 else None, lang))
    return out


def test_accuracy_on_held_out_rows(spark):
    data = rows(random.Random(1), 600)
    df = spark.createDataFrame(data, "doc_id BIGINT, text STRING, lang STRING, score STRING")
    model = L.fit(df.where(~L.held_out()), sample_per_language=50)
    assert model.languages == ["aa", "bb", "cc"] or model.languages[0] == "aa"
    got = L.predict(df.withColumn("held", L.held_out()), model).collect()
    held = [r for r in got if r.held]
    truth = {i: lang for i, _, _, lang in data}
    assert 90 < len(held) < 210
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "theing theed on", "aa"), (2, "que la ciòn", "bb"), (3, "theing on an", "aa"), (4, "que os la", "bb")], "doc_id BIGINT, text STRING, lang STRING")
    model = L.fit(df)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "ΩΩΩ"), (None, "x" * 2_500_000), (6, "thé on"), (6, "thé on")], "doc_id BIGINT, text STRING")
    got = sorted(((str(r.doc_id), r.lang_pred, r.score) for r in L.predict(odd, model).collect()))
    assert [g[1:] for g in got if g[0] in "123"] == [("und", 0.0)] * 3
    assert all(g[1] in ("aa", "bb") for g in got if g[0] not in "123") and len(got) == 7
    assert L.predict(odd.limit(0), model).count() == 0
    none = L.fit(df.limit(0))
    assert {r.lang_pred for r in L.predict(df, none).collect()} == {"und"}


def test_filter_answers_every_language_that_has_a_gram():
    rng = np.random.default_rng(1)
    grams = [rng.integers(0, 2**63, 5000).astype(np.uint64) for _ in range(12)]
    f = L.BitmaskFilter([f"l{i}" for i in range(12)], slots=1 << 18)
    for i, g in enumerate(grams):
        f.add(g, i)
    f.settle()
    for i, g in enumerate(grams):
        assert f.has(f.languages_of(g), i).all()
    other = f.languages_of(rng.integers(0, 2**63, 50_000).astype(np.uint64))
    for i in range(12):
        assert abs(f.has(other, i).mean() - f.false_rate[i]) < 0.002


def test_long_texts_are_read_whole(monkeypatch):
    rng = random.Random(3)
    for t in (text(rng, "aa", 3000), "ab" + " .-" * 1_000 + "cd" + "-" * 999 + "e", "İΣ" * 700, "x" * 2_500, " " * 2_500, "a" + " " * 999 + "b"):
        for sizes in ((1,), (3,), (2, 3, 4)):
            monkeypatch.setattr(L, "CHUNK", 1 << 20)
            whole = np.sort(np.concatenate(list(L.ngram_hashes(t, sizes)) or [[]]))
            for chunk in (1, 2, 7, 1000):
                monkeypatch.setattr(L, "CHUNK", chunk)
                assert np.array_equal(whole, np.sort(np.concatenate(list(L.ngram_hashes(t, sizes)) or [[]])))


def test_more_languages_than_a_word_has_bits(spark):
    rng = random.Random(5)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for _ in range(150)]
    line = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    rows = [(i, line(i % 150, 30), f"l{i % 150}") for i in range(450)] + [(1000, line(0, 5) + " only once", "rare"), (1001, None, "never")]
    model = L.fit(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING"))
    assert len(model.languages) == 151 and model.masks.shape[0] == 3
    test = spark.createDataFrame([(k, line(k, 20)) for k in range(150)] + [(150, "only once only once")], "doc_id BIGINT, text STRING")
    assert all(r.lang_pred == (f"l{r.doc_id}" if r.doc_id < 150 else "rare") for r in L.predict(test, model).collect())


def brute(rows):
    """(held out, language, score) of (id, text, lang) rows by sets of n-grams."""
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows]

    def grams(t):
        s = " " + "".join(c if c.isalpha() else " " for c in (t or "").lower()) + " "
        s = re.sub(" +", " ", s)
        return [g for n in (2, 3, 4) for g in (s[k : k + n] for k in range(len(s) - n + 1)) if " " not in g[1:-1] and g.strip()] if s.strip() else []

    learn = [r for r, h in zip(rows, held) if not h and r[1] is not None and r[2] is not None]
    count = Counter(r[2] for r in learn)
    known = {}
    for lang in sorted(count, key=lambda k: (-count[k], k)):
        seen = Counter(g for r in learn if r[2] == lang for g in set(grams(r[1])))
        known[lang] = {g for g, n in seen.items() if n > 1 or count[lang] < 20}
    out = []
    for (_, t, _), h in zip(rows, held):
        g = grams(t)
        shares = {k: sum(x in v for x in g) / len(g) for k, v in known.items()} if g else {}
        best = max(shares, key=shares.get, default=None)
        out.append((h, best or "und", shares[best] if best else 0.0))
    return out


def test_the_query_against_brute_force(spark, tables):
    from quire.llm.queries import op4_language

    data = [(i, t, lang) for i, t, lang, _ in rows(random.Random(2), 500)] + [(900, None, "aa"), (901, "", "bb"), (902, "1 2 3", "bb"), (903, "the que", "dd"), (903, "the que", "dd")]
    path = tables(documents=([(*r, "x") for r in data], "doc_id BIGINT, text STRING, lang STRING, lang_pred STRING"))
    want = {r[0]: w for r, w in zip(data, brute(data))}
    got = op4_language(spark, path).collect()
    assert len(got) == len(data)
    for r in got:
        held, lang, score = want[r.doc_id]
        assert (r.held_out, r.lang_pred) == (held, lang) and abs(r.score - score) < 0.01, r
