import random

import numpy as np
from pyspark.sql import functions as F

from quire.llm import mixing as M


def test_rake_meets_all_margins():
    rng = np.random.default_rng(2)
    shape = (4, 3, 5)
    tokens = rng.uniform(1, 100, shape).ravel()
    at = [x.ravel() for x in np.indices(shape)]
    goals = [rng.dirichlet(np.ones(n)) for n in shape]
    cells = M.rake(tokens, at, goals)
    for a, g in zip(at, goals):
        assert np.allclose(np.bincount(a, weights=cells), g, atol=1e-7)
    # raking keeps the cells' odds ratios
    c, t = cells.reshape(shape), tokens.reshape(shape)
    assert np.isclose(c[0, 0, 0] * c[1, 1, 0] / (c[0, 1, 0] * c[1, 0, 0]), t[0, 0, 0] * t[1, 1, 0] / (t[0, 1, 0] * t[1, 0, 0]))


def test_rake_with_missing_classes_and_empty_cells():
    cells = M.rake(np.array([10.0, 30.0]), [np.array([0, 1]), np.array([0, 0])], [np.array([0.25, 0.25, 0.5]), np.array([1.0])])
    assert np.allclose(cells, [0.5, 0.5])


def test_calibrated_probabilities_meet_the_budget():
    tokens, weights = np.array([10.0, 20.0, 70.0, 5.0]), np.array([5.0, 1.0, 0.5, 0.0])
    for budget in (1, 20, 50, 90):
        p = M.calibrated(tokens, weights, budget)
        assert np.isclose((p * tokens).sum(), budget) and p.max() <= 1 and p[3] == 0
    assert M.calibrated(tokens, weights, 500).tolist() == [1, 1, 1, 0]


def docs(spark):
    rows = []
    for i in range(3000):
        topic = i % 3
        rows.append((i, " ".join(f"t{topic}w{(i * 7 + k * k) % 40}" for k in range(20 + i % 9)), "en" if i % 5 else "de", "hot" if i % 3 else f"s{i % 7}", 1))
    rows += [(9000, None, None, None, 1), (9001, "", "en", "hot", 1), (None, "t0w1 t0w2", "en", None, 1), (9002, "t1w3 " * 30_000, "fr", "rare", 1), (5, rows[5][1], "de", rows[5][3], 1)]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, weight INT")


def test_expected_tokens_have_the_target_margins(spark):
    df = docs(spark)
    goal = {"source": {"hot": 0.4, **{f"s{k}": 0.08 for k in range(7)}, "rare": 0.02, M.NONE: 0.02}, "lang": {"en": 0.57, "de": 0.4, "fr": 0.02, M.NONE: 0.01}}
    out = M.mixed(df, targets=goal, keep=0.3, topics=3).toPandas()
    assert len(out) == df.count() and set(out.columns) == {*df.columns, "topic", "n_tokens", "prob", "kept"}
    total = out.n_tokens.sum()
    assert abs((out.prob * out.n_tokens).sum() / total - 0.3) < 1e-6
    weighted = out.weight * out.n_tokens
    by_lang = weighted.groupby(out.lang.astype(object).where(out.lang.notna(), "null")).sum() / weighted.sum()
    there = {k or "null": v for k, v in goal["lang"].items() if by_lang.get(k or "null", 0) > 0}
    for k, v in there.items():
        assert abs(by_lang[k] - v / sum(there.values())) < 0.02, k
    kept = out[out.kept].n_tokens.sum() / total
    assert 0.2 < kept < 0.7
    assert out[out.text.isna()].n_tokens.tolist() == [0] and (out[out.text.isna()].topic == -1).all()
    again = M.mixed(df, targets=goal, keep=0.3, topics=3).where("kept").count()
    assert again == int(out.kept.sum())


def test_topics_follow_the_words(spark):
    # Words are drawn at random: those of docs() depend on i so that a topic's even and odd rows can share none.
    rng = random.Random(2)
    rows = [(i, " ".join(f"t{i % 3}w{rng.randrange(40)}" for _ in range(20 + i % 9)), "en", "hot") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING")
    out = M.mixed(df, topics=3).groupBy((F.col("doc_id") % 3).alias("true"), "topic").count().toPandas()
    assert out.groupby("true")["count"].max().sum() > 0.95 * out["count"].sum()


def test_odd_targets_names_and_tables(spark):
    df = docs(spark)
    assert M.mixed(df.limit(0)).count() == 0
    rows = [(i, "a b c", None if i % 2 else "(none)", ["", "=", None, "(other)"][i % 4]) for i in range(400)]
    out = M.mixed(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING"), topics=2,
                  targets={"lang": {None: 0.75, "(none)": 0.25}, "source": {"nowhere": 1.0}}, keep=0.5).toPandas()
    share = (out.weight * out.n_tokens)[out.lang.isna()].sum() / (out.weight * out.n_tokens).sum()
    assert abs(share - 0.75) < 1e-6 and out.prob.notna().all() and abs((out.prob * out.n_tokens).sum() / out.n_tokens.sum() - 0.5) < 1e-6


def brute(rows, topics, keep, power):
    """Topics and probabilities of (id, text, lang, source, hash) rows, row by row."""
    dims = 512
    vectors = [M.hashed_words(r[1], dims) for r in rows]
    there = [i for i, (v, _) in enumerate(vectors) if v]
    x = np.array([list(vectors[i][0]) for i in there], float)
    x = x * np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0)))
    x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    centres = []
    for n in (1, topics, topics, topics):
        gap = 1 - np.max([x @ c for c in centres], axis=0) if centres else np.ones(len(x))
        gap[(gap < 1e-9) | ~x.any(axis=1)] = 0
        u = np.array([(rows[i][4] % 2**64 + 1) / 2**64 for i in there])
        score = np.array([-np.log(a) / g if g else np.inf for a, g in zip(u, gap)])
        drawn = {tuple(x[i]): (score[i], i) for i in np.argsort(-score, kind="stable") if np.isfinite(score[i])}
        centres += [x[i] for _, i in sorted(drawn.values())[:n]]
    weights = np.bincount(np.argmax([x @ c for c in centres], axis=0), minlength=len(centres))
    centres = list(M.chosen_centres(np.array(centres), weights, topics))
    for _ in range(10):
        near = np.argmax([x @ c for c in centres], axis=0)
        sums = [np.rint(x[near == k] * M.UNITS).sum(axis=0) for k in range(len(centres))]
        centres = [s / np.linalg.norm(s) if s.any() else c for s, c in zip(sums, centres)]
    topic = dict(zip(there, np.argmax([x @ c for c in centres], axis=0).tolist()))
    n = np.array([max(k, 0) for _, k in vectors], float)
    margins = [[r[3] for r in rows], [r[2] for r in rows], [topic.get(i, -1) for i in range(len(rows))]]
    cell = list(zip(*margins))
    share = {c: sum(t for t, d in zip(n, cell) if d == c) or 1e-9 for c in set(cell)}
    total, tokens = sum(share.values()), dict(share)
    goals = []
    for k in range(3):
        own = {m: sum(t for c, t in share.items() if c[k] == m) for m in set(margins[k])}
        goals.append({m: (t / total) ** power for m, t in own.items()})
    for _ in range(3000):
        for k, goal in enumerate(goals):
            now = {m: sum(t for c, t in share.items() if c[k] == m) for m in goal}
            share = {c: t * goal[c[k]] / sum(goal.values()) * total / now[c[k]] for c, t in share.items()}
    weight = {c: share[c] / tokens[c] for c in share}
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo * hi) ** 0.5 if lo else hi / 2
        lo, hi = (mid, hi) if sum(tokens[c] * min(1, mid * weight[c]) for c in share) < keep * total else (lo, mid)
    return [topic.get(i, -1) for i in range(len(rows))], [weight[c] for c in cell], [min(1, hi * weight[c]) for c in cell]


def test_the_query_against_brute_force(spark, tables):
    from quire.llm.queries import op5_mixing

    rng = random.Random(6)
    rows = []
    for i in range(400):
        t = rng.randrange(4)
        text = " ".join(f"t{t}w{rng.randrange(30)}" if rng.random() < 0.8 else f"w{rng.randrange(50)}" for _ in range(rng.randrange(5, 60)))
        rows.append((i, text, rng.choice(["en", "en", "de", "fr", None]), rng.choice(["hot", "hot", "hot", "a", "b", None])))
    rows += [(400, None, "en", "a"), (401, " ", None, "a"), (402, "w1 " * 5_000, "en", "b"), (402, "w1 " * 5_000, "en", "b")]
    path = tables(documents=(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING"))
    got = op5_mixing(spark, path).toPandas().sort_values("doc_id", kind="stable")
    place = {r.doc_id: r.p for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", F.xxhash64(F.lit(5), "doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).alias("p")).collect()}
    topic, weight, prob = brute([(*r, place[r[0]]) for r in rows], 8, 0.5, 0.5)
    assert got.topic.tolist() == topic and len(set(topic)) == 9
    assert np.allclose(got.weight, weight, rtol=1e-4) and np.allclose(got.prob, prob, rtol=1e-4)
    assert abs(got.kept.sum() - got.prob.sum()) < 60


def test_every_class_has_its_target_on_the_driver_and_as_frames(spark):
    rows = [(i, f"w{i % 3} x y", "en" if i < 300 else "de", f"s{min(i, 600 - i)}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING")
    goal = {"source": {f"s{k}": 1.0 + k % 2 for k in range(301)}}
    got = []
    for cells in (100_000, 0):
        out = M.mixed(df, targets=goal, keep=0.3, topics=1, driver_cells=cells).toPandas().sort_values("doc_id").reset_index(drop=True)
        weighted = (out.weight * out.n_tokens).groupby(out.source).sum() / (out.weight * out.n_tokens).sum()
        total = sum(goal["source"].values())
        assert all(abs(weighted[k] - v / total) < 1e-3 for k, v in goal["source"].items())
        assert abs((out.prob * out.n_tokens).sum() / out.n_tokens.sum() - 0.3) < 1e-6
        got.append(out)
    assert np.allclose(got[0].weight, got[1].weight, rtol=1e-5) and np.allclose(got[0].prob, got[1].prob, rtol=1e-5)
    assert (got[0].kept == got[1].kept).all()
