import re

from quire.llm import decontaminate as D


def brute(docs, items, width=5, t=0.8):
    words = lambda x: re.findall(r"[^\W_]+", (x or "").lower())
    out = {}
    for item, text in items:
        w = words(text)
        k = min(width, len(w))
        s = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for doc, body in docs:
            b = words(body)
            n = len(s & {tuple(b[i : i + k]) for i in range(len(b) - k + 1)})
            if s and n >= t * len(s) - 1e-9:
                out[doc, item] = (len(s), max(n, out.get((doc, item), (0, 0))[1]))
    return sorted(((*k, *v) for k, v in out.items()), key=repr)


ITEM = "the quick brown fox jumps over the lazy dog and runs far away from all of them at once today"
ITEMS = [(1, ITEM), (2, "Just four words here"), (3, ""), (4, None), (5, "one"), (6, " ".join(f"w{i}" for i in range(300))), (7, "a a a a a a a a a"), (8, "ünïcode wörds ça et là, voilà tout!")]
LONG = " ".join(f"filler{i}" for i in range(20_000))
DOCS = [
    (10, f"{LONG} {ITEM} {LONG}"), (11, ITEM.upper().replace(" ", ",  ")), (12, " ".join(ITEM.split()[:-1])), (13, " ".join(ITEM.split()[:12])),
    (14, "x just FOUR words here y"), (15, None), (16, ""), (17, "someone"), (18, "one"), (19, " ".join(f"w{i}" for i in range(30, 300))),
    (20, " ".join(f"w{i}" for i in range(100, 300))), (21, "a " * 50), (22, "Ünïcode wörds ça et là voilà tout"), (None, ITEM), (10, ITEM), (23, "z" * 100_000),
]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(*r, "clash") for r in DOCS], "doc_id BIGINT, text STRING, item_id STRING")
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id BIGINT, text STRING, n INT")
    want = brute(DOCS, ITEMS)
    for rows in (1_000_000, 0):  # with and without broadcasts
        got = D.contaminated(docs, items, broadcast_bytes=rows)
        assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == want
    assert len(want) > 8
    kept = D.without_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect())) == sorted(i for i, _ in DOCS if i is not None and i not in {w[0] for w in want})


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id BIGINT, text STRING")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id BIGINT, text STRING")
    assert D.contaminated(docs.limit(0), items).count() == 0
    assert D.contaminated(docs, items.limit(0)).count() == 0
    assert D.contaminated(docs, items).count() == 1
