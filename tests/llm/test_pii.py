import hashlib
import random
import re

import regex
from pyspark.sql import functions as F

from quire.llm import pii as P


def brute(text):
    out = []
    for kind, pattern, good in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(re.sub(r"\D", "", v)) <= 19 and brute_luhn(re.sub(r"\D", "", v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub(r"[^0-9]", "", v)) <= 15),
    ):
        out += [(*m.span(), kind) for m in re.finditer(pattern, text) if good(m[0])]
    return sorted(out, key=lambda s: (s[0], P.KINDS.index(s[2])))


def brute_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (2 if i % 2 else 1)
        total += n // 10 + n % 10
    return total % 10 == 0


CASES = [
    "", "nothing here", "a@b.co x.y+z@mail-1.example.com, q@@b.c a@b@c.d.e @x.y -@-.-", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.002.3.4 1.2.3 9.9.9.9999",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 5500000000000004 79927398713 0000 0000 0000", "+1 (555) 010-9999 +49.89.1234567 +1 2 +12345678901234567 ++33 1 23 45 67 89",
    "mail me: jo@x.io +44 20 7946 0958 10.0.0.1 4012888888881881.", "1" * 4000, "1." * 2000, "a" * 5000 + "@", "@" * 3000, "+1" * 2000, "x@y.z" * 500, "١٢٣.١.١.١ é@ü.de 12 34",
    "1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6", "1 " * 3000, "+" + "1-" * 3000, "5 5  55 4111111111111111 4111111111111111",
]


def test_patterns_against_brute_force():
    for text in CASES:
        assert P.base_spans(text) == brute(text), text[:80]


def test_patterns_on_random_texts():
    import random

    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(["@", ".", "+", "-", " ", "(", "1", "25", "a", "x.y", "4111111111111111", "\n"]) for _ in range(rng.randrange(40)))
        assert P.base_spans(text) == brute(text), text


def test_long_runs_stay_linear():
    import time

    began = time.time()
    for text in ("a" * 300_000 + " ", "1" * 300_000, "@" * 300_000, "a@" * 200_000, "1." * 200_000, "+1" * 200_000, "x" * 200_000 + "@" + "y" * 200_000):
        P.base_spans(text)
    assert time.time() - began < 20


def rows(spark):
    fill = [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(600)]
    out = []
    for i in range(300):
        words = " ".join(fill[(i * 7 + k * 13) % 600] for k in range(30))
        out.append((i, f"common the {words}"))
    for i in range(6):  # the same person, in different surroundings
        out.append((1000 + i, f"the {fill[i * 50]} {fill[i * 40 + 3]} Zorblax the Magnificent zorb@example.com {fill[i * 30 + 7]} the {fill[i * 11 + 1]} common"))
    out += [(2000 + i, "one passage copied about Quux unique@example.org again and again") for i in range(5)]
    out += [(3000, None), (3001, ""), (None, "call +1 555 010 9999 now"), (3002, "x" * 200_000), (3003, "zorblax elsewhere without the address")]
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in out], "doc_id BIGINT, text STRING, term STRING, t INT")


def test_terms_that_disclose(spark):
    df = rows(spark)
    found = {r.doc_id: r for r in P.find(df).collect()}
    assert len(found) == df.count()
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    for i, r in found.items():
        assert [(s.start, s.end, s.kind) for s in r.base] == brute(texts[i])
        terms = {texts[i][s.start : s.end] for s in r.terms}
        assert terms == ({"Zorblax", "Magnificent"} if i is not None and 1000 <= i < 1006 else set()), i
    clean = {r.doc_id: r.text for r in P.sanitised(df).collect()}
    assert P.sanitised(df).columns == df.columns
    assert "[TERM] the [TERM] [EMAIL]" in clean[1000] and "example" not in clean[2000]
    assert clean[None] == "call [PHONE] now" and clean[3000] is None and clean[3002] == texts[3002]


def brute_terms(texts, reach=16, contexts=2, disclosure=0.8):
    """The (entity, term) pairs above the threshold, and each text's spans of them, from all words of all texts."""
    import math
    from collections import defaultdict

    holds, near, places = defaultdict(set), defaultdict(set), defaultdict(list)
    entities, pairs = defaultdict(set), defaultdict(set)
    for i, text in enumerate(texts):
        spans = brute(text)
        words = [m.span() for m in regex.finditer(r"\p{L}{3,}", text)]
        for a, b in words:
            holds[text[a:b].lower()].add(i)
        free = [(a, b) for a, b in words if not any(x < b and a < y for x, y, _ in spans)]
        for x, y, kind in spans:
            entity = P._entity(kind, text[x:y])
            by = [w for w in free if w[1] <= x][-reach:] + [w for w in free if w[0] >= y][:reach]
            mark = " ".join(text[a:b].lower() for a, b in by)
            for a, b in by:
                entities[entity].add(i)
                pairs[entity, text[a:b].lower()].add(i)
                near[entity, text[a:b].lower()].add(mark)
                places[entity, text[a:b].lower()].append((i, a, b))
    out = [set() for _ in texts]
    for (entity, term), docs in pairs.items():
        ic = math.log(len(texts) / len(entities[entity]))
        pmi = math.log(len(docs) * len(texts) / (len(entities[entity]) * len(holds[term])))
        if len(near[entity, term]) >= contexts and ic > 0 and pmi >= disclosure * ic - 1e-12:
            for i, a, b in places[entity, term]:
                out[i].add((a, b))
    return out


def test_the_query_against_brute_force(spark, tables):
    from quire.llm.queries import op2_pii

    rng = random.Random(8)
    fill = ["".join(rng.choice("abcdeéüß") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    words = lambda n: " ".join(rng.choice(fill) for _ in range(n))
    texts = [words(rng.randrange(50)) for _ in range(250)]
    for k in range(12):
        who, at = ["Zorb²lax", "İzmirli", "ΟΔΟΣ", "abcdefghijklmnopqrstuvwxyz" * 3, "Ⅷxenon", "x_tra"][k % 6], f"z{k % 6}@ex.com" if k % 2 else f"10.0.0.{k % 6}"
        texts += [f"{words(rng.randrange(20))} {who} {words(3)} {at} {words(rng.randrange(30))} {who.lower()}" for _ in range(3)]
    texts += ["", "10.0.0.7 " * 400, f"{'-' * 2_000} solitary {'7' * 500} z@ex.com", texts[260], "plain Zorb²lax " + words(5)]
    path = tables(documents=([(i, t or None, 1) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, spans INT"))
    want = brute_terms(texts)
    for r in op2_pii(spark, path).collect():
        base = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in base) for k in P.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        every = sorted([*base, *((a, b, "term") for a, b in want[r.doc_id])], key=lambda s: (s[0], [*P.KINDS, "term"].index(s[2]), s[1]))
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, b, k in every), r.doc_id
    assert sum(map(len, want)) > 30 and any(texts[250 + k][a:b] == "İzmirli" for k in range(36) for a, b in want[250 + k])


def test_many_spans_stay_linear():
    import time

    word, began = re.compile(r"[a-z]{3,}"), time.time()
    text = "1.2.3.4 " * 30_000 + "word " * 30_000 + "a@b.co " * 30_000
    assert len(P.contexts(text, P.base_spans(text), 16, word)) < 2_000_000 and time.time() - began < 20


def test_spans_as_text(spark):
    df = spark.createDataFrame([(1, "a@b.co 10.0.0.1")], "doc_id BIGINT, text STRING")
    row = P.find(df).select(P.spans_text(P.all_spans(F.col("base"), F.col("terms"))).alias("s")).first()
    assert row.s == "email:0:6,ip:7:15"
    assert P.find(df.limit(0)).count() == 0
