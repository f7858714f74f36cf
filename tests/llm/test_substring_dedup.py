import hashlib
import random

import numpy as np
import pytest

from quire.llm import substring_dedup as S


def brute(texts, length):
    datas = [(t or "").encode() for t in texts]
    seen = {}
    for d in datas:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in datas:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(d), int(gone.sum()), len(S._runs(gone)), bytes(b for b, g in zip(d, gone) if not g)))
    return out


def texts(rng):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    passage = " ".join(word() for _ in range(30))
    long = " ".join(word() for _ in range(300))
    out = [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(20)]
    out += [f"{word()} {passage[rng.randrange(20):]} {word()}" for _ in range(25)]
    for _ in range(6):
        w = long.split()
        for _ in range(4):
            w[rng.randrange(300)] = word()
        out.append(" ".join(w))
    out += [long, long, None, "", "a" * 500, "a" * 300 + "b", "ab" * 200, "x" * 23, "x" * 24, "x" * 25, (passage + " ") * 3, "é" * 40]
    return out


@pytest.mark.parametrize("group_bytes", [1 << 18, 600])
def test_against_brute_force(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(S, "LONGEST", 40)
    rows = texts(random.Random(group_bytes))
    df = spark.createDataFrame([(i if i != 5 else None, t, "clash", 1) for i, t in enumerate(rows)], "doc_id BIGINT, text STRING, name STRING, n INT")
    got = sorted(S.drop_repeated_substrings(df, length=24, gram=8, group_bytes=group_bytes).collect(), key=lambda r: 5 if r.doc_id is None else r.doc_id)
    want = brute(rows, 24)
    assert [(r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got] == want
    assert sum(w[1] for w in want) > 3000


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "z" * 3 + "some long enough text here"), (1, "z" * 3 + "some long enough text here"), (2, "other")], "doc_id BIGINT, text STRING")
    got = sorted((r.doc_id, r.n_removed) for r in S.drop_repeated_substrings(df, length=20, gram=8).collect())
    assert got == [(1, 29), (1, 29), (2, 0)]
    assert S.drop_repeated_substrings(df.limit(0)).count() == 0


def test_windows_by_interval_expansion():
    rng = random.Random(9)
    for length in (1, 2, 5, 9):
        contents = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 60))).encode() for _ in range(7)] + [b"abababababab", b"a", b"\x00\xff\x00\xff\x00\xff"]
        count = {}
        for c in contents:
            for i in range(len(c) - length + 1):
                count[c[i : i + length]] = count.get(c[i : i + length], 0) + 1
        got = S.repeated_windows(contents, length)
        assert [g.tolist() for g in got] == [[count[c[i : i + length]] > 1 for i in range(len(c) - length + 1)] for c in contents]


def test_long_texts_are_cut_into_chunks(monkeypatch):
    data = bytes(random.Random(1).randrange(256) for _ in range(3000))
    covered = lambda: sorted((s + k, name) for s, n, name, _ in S.segments(data, 64, 16) for k in range(n))
    whole = covered()
    monkeypatch.setattr(S, "CHUNK", 100)
    assert covered() == whole and len(whole) == 3000 - 64 + 1


def test_equal_windows_have_equal_cores():
    rng = random.Random(4)
    text = ("".join(rng.choice("abcdefgh ") for _ in range(60)) + "ab" * 30 + "".join(rng.choice("ab") for _ in range(200))) * 2
    data, length = text.encode(), 40
    segments = S.segments(data, length, 8)
    contents = [data[s : s + n + length - 1] for s, n, _, _ in segments]
    for step in (16, 4, 1):
        key, around = {}, {}
        found = S.cores(contents, [S._signed(name) for *_, name, _ in segments], length, 8, step)
        assert sum(n for _, _, n, *_ in found) == len(data) - length + 1

        def check(window, core, around, at, step):
            assert key.setdefault(window, core) == core
            reduced = around[at : at + step - 1]
            assert texts.setdefault((core, reduced, before - at), window) == window

        texts = {}
        for i, s, n, one, two, before, around_, twice in found:
            if twice:
                continue
            for k in range(n):
                check(contents[i][s + k : s + k + length], (one, two), around_, k, step)
        if step == 16:
            fine, whole = {}, {}
            for i, s, n, one, two, before, around_, twice in found:
                if not twice:
                    finer = S.finer_cores(one, two, before, around_, 16, 4)
                    assert [a for a, *_ in finer] == np.cumsum([0, *[m for _, m, *_ in finer]])[:-1].tolist() and sum(m for _, m, *_ in finer) == n
                    for at, m, x, y, left, rest in finer:
                        assert len(rest) == m + 2 and 0 <= left < 4
                        for k in range(m):
                            window = contents[i][s + at + k : s + at + k + length]
                            assert fine.setdefault(window, (x, y)) == (x, y)
                            assert whole.setdefault((x, y, left - k, rest[k : k + 3]), window) == window


def test_the_query_against_brute_force(spark, tables):
    from quire.llm.queries import op3_substring_dedup

    rng = random.Random(7)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    hot, planted = words(90), words(75)
    rows = [f"{words(rng.randrange(20, 60))} {hot} {words(rng.randrange(20, 60))}" for _ in range(420)]  # over 256 KB of different contents
    rows += [f"{words(30)} {planted} {words(30)}" for _ in range(3)] + [words(80) for _ in range(20)] + ["", None, "z" * 2_000, "yx" * 700, planted[:399]]
    rows += [rows[0], rows[0]]
    want = brute(rows, 400)
    path = tables(documents=([(i, t, 7) for i, t in enumerate(rows)], "doc_id BIGINT, text STRING, n_bytes INT"))
    got = sorted(op3_substring_dedup(spark, path).collect())
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == [(a, b, c, hashlib.sha256(k).hexdigest()) for a, b, c, k in want]
    assert all(r.n_removed >= len(planted) for r in got[420:423]) and not any(r.n_removed for r in got[423:443])
