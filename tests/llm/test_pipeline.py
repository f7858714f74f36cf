import random
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quire.llm import tokens as T  # noqa: E402

SYLLABLES = {"en": ["the", "ing", "ed", "on", "ther", "an"], "es": ["la", "que", "ción", "os", "mente", "ra"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    items = [text(rng, "en", 25) for _ in range(3)]
    rows = [(i, text(rng, lang := rng.choice(["en", "en", "es"]), rng.randrange(60, 200)), lang, rng.choice(["a", "a", "b"])) for i in range(120)]
    near = rows[7][1].split()
    near[20] = "changed"
    rows += [(200, rows[3][1], "en", "a"), (201, rows[3][1], "en", "b"), (202, " ".join(near), rows[7][2], "a"), (203, "1234 !!", None, "a"), (204, None, "en", "a"), (205, "Ωψξ λμν " * 30, None, "b"),
             (206, f"{text(rng, 'en', 80)} {items[1]} {text(rng, 'en', 40)}", "en", "a"), (207, "", "es", "b")]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(i, t, lang, s, len(t or ""), "own", 7) for i, t, lang, s in rows], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, score STRING, kept INT").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id BIGINT, text STRING").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {r.doc_id for r in docs.collect()}
    gone = {"language": {203, 204, 205, 207}, "near_duplicates": {200, 201, 202}, "decontamination": {206}}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == columns and {(r.score, r.kept) for r in docs.collect()} == {("own", 7)}
        now = {r.doc_id for r in docs.collect()}
        if name in gone:
            assert kept - now == gone[name], name
        else:
            assert now < kept
        kept = now
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == kept
    encode = T.Encoder(T.default_tokenizer()).tokenizer.encode
    at = 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*encode(r.text, add_special_tokens=False).ids, 2]
        found = next(x for x in rows if x.doc_id == r.doc_id)
        assert (found.start, found.n_tokens, found.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_the_pipeline_is_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixture", "token_files"]


def test_empty_and_odd_tables(spark, tables):
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING"
    item = ([(1, "one two three four five six seven")], "item_id BIGINT, text STRING")
    assert corpus_pipeline.run(spark, tables(documents=([], schema), benchmark=item)).count() == 0


def test_odd_rows(spark, tables):
    long = " ".join(f"word{i % 977} and more" for i in range(60_000))
    rows = [(i, f"this is a plain text about thing{i} and other things of the kind number {i * 7}", "en", "a") for i in range(60)]
    rows += [(100, None, None, None), (101, "", "en", None), (102, long, None, "b"), (103, rows[3][1], "en", "a"), (3, rows[3][1], "en", "a"), (None, "another text of words that stands alone here", "en", "a")]
    path = tables(documents=(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING"), benchmark=([(1, None), (2, "")], "item_id BIGINT, text STRING"))
    got = [r.doc_id for r in corpus_pipeline.run(spark, path).collect()]
    assert 100 not in got and 101 not in got and 103 not in got and len(got) > 10
