import random
import zlib

import numpy as np
import pytest

from quire.llm import tokens as T

ODD = ["", " ", "  ", "a  b", "a   b\n\n c", "\n", "x  y   z", "a  b", "don't  can't\t\tgo ", "1 234  5", "\x1c a\x1d\x1e b\x1f  c", "<|endoftext|>", "a <|endoftext|> b", "a  <|endoftext|>  ", "é́ ß　　字", "\x85\x85 x", "​ ​", "᠎  a", "q\r\n\r\nw", "!? ...  ,"]


ODD += [f"a{c}  b{c}{c} c {c}" for c in "\x85\xa0\u1680\u180e\u2000\u2007\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff\x1c\x1f"]


def test_pieces_give_the_library_s_ids():
    e = T.Encoder(T.default_tokenizer(), limit=50)
    rng = random.Random(1)
    texts = [*ODD, "z" * 30_000]
    for _ in range(1500):
        texts.append("".join(rng.choice([" ", "  ", "\n", "\t", "a", "the", "'s", "42", "!", " ", " ", "é", "\x1f", "\x0b", "<|endoftext|>", "字"]) for _ in range(rng.randrange(14))))
    got = e.encode(texts)
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("top,n", [(2, 50), (1, 9), (50_000, 5_000), (70_000, 3_000)])
def test_shard_answers(monkeypatch, top, n):
    monkeypatch.setattr(T, "BLOCK_BITS", 256)
    ids = np.random.default_rng(7).integers(0, top, n)
    ids[: n // 3] = ids[0]
    s = T.Shard(T.build_shard(ids, [5, None, 9], [1, 0, n - 1]))
    assert s.decode().tolist() == ids.tolist() and s.doc_ids() == [5, None, 9] and s.lengths().tolist() == [1, 0, n - 1]
    for i in range(0, n, max(1, n // 40)):
        assert s.access(i) == ids[i]
        v = int(ids[i])
        assert s.count(v, i // 2, i + 1) == int((ids[i // 2 : i + 1] == v).sum())
    v = int(ids[0])
    where = np.flatnonzero(ids == v)
    assert list(s.occurrences(v))[:30] == where[:30].tolist() if len(where) < 400 else s.select(v, len(where) - 1) == where[-1]
    assert s.count(top + 10**6) == 0 and s.count(-1) == 0
    for bad in (lambda: s.access(n), lambda: s.select(v, len(where)), lambda: s.select(1 << 40, 0)):
        with pytest.raises(IndexError):
            bad()


def test_empty_shard():
    s = T.Shard(T.build_shard(np.zeros(0, np.uint32), [], []))
    assert s.decode().tolist() == [] and s.count(0) == 0


def test_rows_against_the_library(spark):
    rng = random.Random(3)
    rows = [(i * 37 % 1009, "".join(rng.choice(["word ", "other  ", "\n", "más "]) for _ in range(rng.randrange(60))), "clash", 1) for i in range(150)]
    rows += [(2000, None, "x", 1), (2001, "", "x", 1), (2002, "w " * 40_000, "x", 1), (37, "again", "x", 1), (None, "no id", "x", 1), (2001, "", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, part STRING, file INT").repartition(5)
    got = T.token_rows(df, T.default_tokenizer(), shard_tokens=700).collect()
    tk = T.Encoder(T.default_tokenizer()).tokenizer
    at, want = 0, []
    for i, t in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*tk.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert T.token_rows(df.limit(0), T.default_tokenizer()).count() == 0


def test_the_query_against_the_library(spark, tables):
    import zlib

    from tokenizers import Tokenizer

    from quire.llm.queries import op7_tokens

    rows = [(7, "Hello, wörld! it's 3 o'clock\n\n  x"), (3, None), (5, ""), (9, "again and again " * 3_000), (1, "Ünïcode ½ 漢字 🙂 end")]
    path = tables(documents=([(i, t, 1) for i, t in rows], "doc_id BIGINT, text STRING, start INT"))
    library, start, want = Tokenizer.from_file(T.default_tokenizer()), 0, []
    for i, t in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, op7_tokens(spark, path).collect())) == want
