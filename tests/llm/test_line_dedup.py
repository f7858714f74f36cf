from quire.llm import line_dedup as L


def brute(rows, min_docs, min_chars):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(strip))
    seen = {}
    for n, (_, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                seen.setdefault(key(line), set()).add(n)
    gone = {k for k, v in seen.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


ROWS = [
    (1, "Menu\nbody one\nmenu \n\nfooter"), (2, "\t MENU\r\nbody two\nFooter"), (3, "menu\nbody three\n"), (4, None), (5, ""), (6, "\n\n"),
    (7, "É menu\né menu"), (8, "x" * 100_000 + "\nmenu\n" + "y\n" * 20_000), (9, " menu"), (None, "menu\nrest"), (1, "Menu\nbody one\nmenu \n\nfooter"),
]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "clash", 2) for i, t in ROWS], "doc_id BIGINT, text STRING, h STRING, n INT")
    for batches, fanout, docs, chars in ((4, 2, 3, 1), (1, 2, 2, 1), (5, 3, 4, 5), (3, 2, 100, 1)):
        got = L.drop_repeated_lines(df, min_docs=docs, min_chars=chars, batches=batches, fanout=fanout)
        assert sorted(map(tuple, got.collect()), key=repr) == brute(ROWS, docs, chars)


def test_empty_table(spark):
    assert L.drop_repeated_lines(spark.createDataFrame([], "doc_id BIGINT, text STRING")).count() == 0


def test_levels_hold_few_runs(spark):
    runs = L.LineRuns(spark, saturate_at=3, fanout=2)
    batch = spark.sql("select struct(id as a, id as b) h from range(5)")
    for _ in range(6):
        runs.add(batch)
    assert [len(x) for x in runs.levels] == [0, 1, 1]
    assert runs.frequent().count() == 5
