import math
import random

from pyspark.sql import functions as F

from quire.llm import topk as T


def brute(rows, k, every):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in fine:
        if q % every:
            continue
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, score STRING"


def run(spark, rows, every=5, **how):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    return sorted(map(tuple, T.top_k(df, F.col("vec_id") % every == 0, **how).collect())), brute([(r.vec_id, r.embedding) for r in df.collect()], 5, every)


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(12)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 12) for i in range(40)]  # ties
    rows += [(2000, None), (2005, [1.0, None] + [0.0] * 10), (2010, [float("nan")] * 12), (2015, [float("inf")] * 12), (2020, []), (2025, [0.25] * 3)]
    got, want = run(spark, rows)
    assert got == want
    got, want = run(spark, rows, block=7)
    assert got == want


def test_small_tables(spark):
    got, want = run(spark, [(0, [1.0, 2.0]), (1, [3.0, -1.0])])
    assert got == want == [(0, 1, 1, 3 * 65536 - 2 * 65536)]
    assert run(spark, [(0, [1.0])])[0] == []
    assert run(spark, [])[0] == []


def test_repeated_ids(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [1.0]), (1, [1.0]), (None, [1.0])], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    got = sorted(map(tuple, T.top_k(df, F.col("vec_id") % 5 == 0).collect()))
    assert got == [(0, 1, 1, 65536), (0, 2, 1, 65536)]


def test_large_components(spark):
    df = spark.createDataFrame([(0, [2.0**50, 1.0]), (1, [2.0**50, 3.0]), (2, [-(2.0**50), 0.0]), (3, [2.0**-7, 0.0]), (4, [1e300, 0.0])], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    got = sorted(map(tuple, T.top_k(df, F.col("vec_id") == 0).collect()))
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 4, 2**63 - 1), (0, 3, 3, 2**59), (0, 4, 2, -(2**63) + 1)]


def test_the_plan_does_not_grow(spark):
    df = spark.range(400).selectExpr("id AS vec_id", "array(cast(id AS float)) AS embedding")
    plans = [T.top_k(df, F.col("vec_id") % 2 == 0, block=b)._jdf.queryExecution().optimizedPlan().toString().count("\n") for b in (1_000, 10)]
    assert plans[0] == plans[1]
