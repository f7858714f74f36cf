import random

import numpy as np
import xxhash

from quire.llm import simhash as S


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, radius=2):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, f in rows:
        for j, g in rows:
            if (f ^ g).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


TEXTS = ["", None, "  \t", "One", "one two", "One TWO three", "a b c d e f", "A\tb\x0bc\n d e  f", "ÄÖ é ü ß x", "same same same same same", "z" * 50_000, "w " * 30_000, "nb sp one two"]


def test_fingerprint_against_brute_force():
    for t in TEXTS:
        assert S.fingerprint(t)[0] == brute_fingerprint(t), t


def test_spark_xxhash64_is_the_same_hash(spark):
    got = spark.sql("select xxhash64('a b c') h").first().h
    assert got % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_rows_against_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(200)) for _ in range(10)]
    texts = [*TEXTS, *base, *base[:3]]
    for t in base[:6]:  # near copies, and copies of these
        w = t.split()
        for _ in range(4):
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    df = spark.createDataFrame([(i * 7 % 101, t, "x", 1) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, component_id STRING, fp INT")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect()}
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in df.collect()]
    want = brute_components(rows)
    assert got == {i: (f"{f:016x}", want[i]) for i, f in rows}
    kept = {r.doc_id for r in S.one_of_each(df).collect()}
    assert kept == set(want.values())
    assert S.one_of_each(df).columns == df.columns


def roots(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_links_span_chains_in_tiles_and_chunks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 2**63, 60)]
    for f in fps[:10]:
        g = f
        for _ in range(6):
            g ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
            fps.append(g)
    fps = sorted({f - 2**64 if f >= 2**63 else f for f in [*fps, 0, 1, 3, 7, 2**64 - 1]})
    want = roots(fps, [(a, b) for a in fps for b in fps if a < b and ((a ^ b) % 2**64).bit_count() <= 2])
    df = spark.createDataFrame([(f, f, 1 + i % 3) for i, f in enumerate(fps)], "node BIGINT, f0 BIGINT, size BIGINT")
    for rows in (16_384, 0.03):
        monkeypatch.setattr(S, "CHUNK_ROWS", rows)
        assert roots(fps, [(r.a, r.b) for r in S.links_by_counts(df, 2).collect()]) == want
    for rows in (16_384, 7):
        monkeypatch.setattr(S, "CHUNK_ROWS", rows)
        assert roots(fps, [(r.a, r.b) for r in S.links_by_size(df, 1, 2, 0.01).collect()]) == want
    got = {r.node: r.root for r in S.components(S.links_by_counts(df, 2)).collect()}
    assert got == {n: r for n, r in want.items() if n != r}


def test_a_group_of_near_copies_gives_a_forest():
    rows = (np.uint64(2**40 + 12345) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64)))[:, None]
    assert len(S.tile_links(rows, np.ones(64, bool), 2)) == 63


def test_wide_fingerprints_find_near_copies_by_similarity(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(8):
        w = [f"w{rng.randrange(5000)}" for _ in range(400)]
        texts.append(" ".join(w))
        w[100] = w[300] = "edited"
        texts.append(" ".join(w))
    texts += [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(8)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING")
    kept = sorted(r.doc_id for r in S.one_of_each(df, width=5, radius=24, words64=2, similarity=0.8).collect())
    assert kept == [*range(0, 16, 2), *range(16, 24)]


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "other words in here")], "doc_id BIGINT, text STRING")
    got = sorted((str(r.doc_id), r.component_id) for r in S.near_duplicates(df).collect())
    assert got == [("1", 1), ("1", 1), ("2", 2), ("None", 1)]
    assert S.near_duplicates(df.where("doc_id > 9")).count() == 0


def jaccard_texts(shared, own, name):
    """Two texts whose shingles of five words share ``shared`` and have ``own`` more each."""
    head = [f"{name}h{k}" for k in range(shared + 4)]
    return [" ".join([*head, *[f"{name}{side}{k}" for k in range(own)]]) for side in "ab"]


def test_the_similarity_decides_not_the_radius(spark):
    texts = []
    for k in range(40):  # 0.8 each, then 0.79 each, with repeated passages that change no set
        texts += jaccard_texts(80 + 8 * k, 10 + k, f"x{k}")
        a, b = jaccard_texts(79 + 8 * k, 11 + k, f"y{k}")
        texts += [a, f"{b} {b}"] if k % 2 else [a, b]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    similar = [len(a & b) >= 0.8 * len(a | b) - 1e-9 for a, b in zip(sets[::2], sets[1::2])]
    assert all(similar[::2]) and not any(similar[1::2])
    kept = {r.doc_id for r in S.one_of_each(df, width=5, radius=76, words64=4, similarity=0.8).collect()}
    assert kept == set(range(len(texts))) - {2 * k + 1 for k, s in enumerate(similar) if s}


def test_chains_of_similar_sets_in_chunks(spark, monkeypatch):
    rng = random.Random(4)
    texts = []
    for c in range(6):
        w = [f"c{c}w{k}" for k in range(150)]
        for _ in range(12):
            w = w[6 + rng.randrange(8) :] + [f"c{c}n{rng.randrange(10**9)}" for _ in range(9)]
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    n = range(len(texts))
    want = roots(n, [(i, j) for i in n for j in n if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9])
    assert len(set(want.values())) < len(texts)
    for rows in (1_024, 2):
        monkeypatch.setattr(S, "CLUSTER_ROWS", rows)
        got = {r.doc_id: r.component_id for r in S.near_duplicates(df, width=5, radius=76, words64=4, similarity=0.8).collect()}
        assert got == want


def test_tiles_of_any_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_ROWS", 30)
    rng = random.Random(12)
    fps = {rng.getrandbits(64) for _ in range(40)} | {0, 1, 3, 2**64 - 1, 2**63}
    for f in list(fps)[:30]:
        for _ in range(8):
            fps.add(f ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 4))}))
    fps = sorted(fps)
    df = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)], "node BIGINT, f0 BIGINT")
    want = roots(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    for parts in S.PARTS:
        assert roots(range(len(fps)), [(r.a, r.b) for r in S.links_by_counts(df, 2, parts).collect()]) == want


def test_recall_of_similar_texts(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rng.randrange(60, 300))]
        texts.append(base)
        for _ in range(6):  # similarities of about 0.7 to 0.95
            copy = list(base)
            for _ in range(max(1, int(len(base) * rng.uniform(0.005, 0.035)))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING")
    got = {r.doc_id: r.component_id for r in S.near_duplicates(df, width=5, words64=4, radius=76, similarity=0.8).collect()}
    caught = sum(got[i] == got[j] for i, j in pairs) / len(pairs)
    close = roots(range(len(texts)), pairs)
    assert len(pairs) > 300 and caught >= 0.99, caught
    assert all(close[i] == close[j] for i in got for j in [got[i]])  # nothing links below the similarity


def test_the_query_against_brute_force(spark, tables):
    import re

    import xxhash

    from quire.llm.queries import op8_simhash

    rng = random.Random(21)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(120)]
    for t in texts[:40]:
        w = t.split()
        texts += [t.upper(), " ".join([*w, "tail"]), "\t".join(w) + "\x0b"]
    texts += [None, "", " \n", "É é İ", "one", "one two"]

    def fingerprint(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [fingerprint(t) for t in texts]
    want = roots(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    path = tables(documents=([(i, t, "x") for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, fingerprint STRING"))
    got = sorted(tuple(r)[:3] for r in op8_simhash(spark, path).select("doc_id", "fingerprint", "component_id").collect())
    assert got == [(i, f"{fps[i]:016x}", want[i]) for i in range(len(fps))]
