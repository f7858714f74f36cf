"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' tokens are raked: scaled to the target shares of
each margin in turn, until all three hold. A cell's weight is its raked tokens over its own; documents are then drawn
by probabilities ``min(1, l * weight)``, with ``l`` calibrated so that the expected tokens meet the budget.

Topics come from spherical k-means over hashed words, fitted on all rows: a text's words become a vector of bytes once;
document frequencies, the candidates for first centres (rounds of rows drawn in proportion to their distance from those
before, by an exponential race over all rows; the rows nearest to each weigh it) and each round's sums are distributed
aggregates, of which the driver gets some topics by dims numbers. Sums are
of integers, so the same rows give the same topics however they are dealt. All classes of all margins are raked: by the
driver where there are few cells, else as DataFrames, with the same results.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh_path, small_enough, text_key

#: The class of null sources and languages in targets.
NONE = None
#: Steps of a vector's byte for one of log1p(count); of a component in the sums of a centre.
STEPS, UNITS = 24, 1 << 24
#: Rounds in which as many candidates for first centres as topics are drawn.
DRAWS = 3


def hashed_words(text: str | None, dims: int) -> tuple[bytes | None, int]:
    """Dampened counts of a text's words by hash, a byte each (None without words), and the number of its words."""
    words = (text or "").lower().split()
    if not words:
        return None, 0
    seen = Counter(words)
    at = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % dims for w in seen), np.int64, len(seen))
    counts = np.bincount(at, weights=np.fromiter(seen.values(), np.float64, len(seen)), minlength=dims)
    return np.minimum(255, np.rint(STEPS * np.log1p(counts))).astype(np.uint8).tobytes(), len(words)


@dataclass
class TopicModel:
    weights: np.ndarray
    centres: np.ndarray

    def units(self, vectors: list[bytes]) -> np.ndarray:
        """Weighted vectors of length one, as float64 so that the same vector gives the same numbers in every batch."""
        x = np.frombuffer(b"".join(vectors), np.uint8).reshape(len(vectors), -1) * self.weights
        size = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.where(size > 0, size, 1)

    def nearness(self, x: np.ndarray) -> np.ndarray:
        """Products with all centres, one by one: those of a matrix product can depend on the other rows."""
        return np.stack([np.einsum("ij,j->i", x, c) for c in self.centres], axis=1)

    def topics(self, vectors: list[bytes]) -> np.ndarray:
        """The nearest centres' numbers (of equals the least)."""
        return self.nearness(self.units(vectors)).argmax(axis=1)


#: Vectors looked at together.
ROWS = 2_048


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            part = b.slice(lo, ROWS)
            if part.num_rows:
                yield part, part.column(0).to_pylist()


def fit_topics(rows: DataFrame, topics: int, dims: int, rounds: int) -> TopicModel:
    """Topics of ``(v, place)`` rows: vectors of hashed_words(), and a hash of the row."""
    rows = rows.where("v IS NOT NULL")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(dims, np.int64), 0
        for _, vs in _vectors(batches):
            seen += (np.frombuffer(b"".join(vs), np.uint8).reshape(len(vs), -1) > 0).sum(axis=0)
            n += len(vs)
        yield pa.RecordBatch.from_arrays([pa.array([*range(dims), -1], pa.int32()), pa.array([*seen.tolist(), n], pa.int64())], names=["dim", "n"])

    held = dict(rows.select("v").mapInArrow(frequencies, "dim INT, n BIGINT").groupBy("dim").agg(F.sum("n")).collect())
    total = held.pop(-1, 0)
    weights = np.log((1 + total) / (1 + np.array([held.get(d, 0) for d in range(dims)])))
    model = TopicModel(weights, np.zeros((0, dims)))

    def race(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[tuple] = []
            for b, vs in _vectors(batches):
                x = model.units(vs)
                gap = np.clip(1 - model.nearness(x).max(axis=1), 0, None) if len(model.centres) else np.ones(len(x))
                gap = np.where((gap > 1e-9) & x.any(axis=1), gap, 0.0)
                place = b.column(1).to_numpy().view(np.uint64)
                score = np.where(gap > 0, -np.log((place.astype(np.float64) + 1) / 2**64) / np.where(gap > 0, gap, 1), np.inf)
                bar = np.partition(score, min(len(score), n) - 1)[min(len(score), n) - 1]
                best = sorted({*best, *((score[i], vs[i]) for i in np.flatnonzero((score <= bar) & np.isfinite(score)).tolist())})[:n]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in best], pa.float64()), pa.array([v for _, v in best], pa.binary())], names=["score", "v"])

        return run

    for n in (1, *[topics] * DRAWS):
        drawn = {bytes(r["v"]): None for r in rows.select("v", "place").mapInArrow(race(n), "score DOUBLE, v BINARY").distinct().orderBy("score", "v").limit(n).collect()}
        if drawn:  # else all rows lie on a centre
            model.centres = np.concatenate([model.centres, model.units(list(drawn))])
    if not len(model.centres):
        return TopicModel(weights, np.zeros((1, dims)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(model.centres), np.int64)
        for _, vs in _vectors(batches):
            held += np.bincount(model.topics(vs), minlength=len(held))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int32()), pa.array(held)], names=["k", "n"])

    held = dict(rows.select("v").mapInArrow(weigh, "k INT, n BIGINT").groupBy("k").agg(F.sum("n")).collect())
    model = TopicModel(weights, chosen_centres(model.centres, np.array([held[k] for k in range(len(model.centres))]), topics))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = np.zeros(model.centres.shape, np.int64)
        for _, vs in _vectors(batches):
            x = model.units(vs)
            near, scaled = model.nearness(x).argmax(axis=1), np.rint(x * UNITS).astype(np.int64)
            for k in range(len(made)):
                made[k] += scaled[near == k].sum(axis=0)
        k, d = np.nonzero(made)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(d, pa.int32()), pa.array(made[k, d])], names=["topic", "dim", "n"])

    for _ in range(rounds):
        moved = np.zeros(model.centres.shape)
        for r in rows.select("v").mapInArrow(sums, "topic INT, dim INT, n BIGINT").groupBy("topic", "dim").agg(F.sum("n").alias("n")).collect():  # topics by dims at most
            moved[r["topic"], r["dim"]] = r["n"]
        size = np.sqrt((moved * moved).sum(axis=1, keepdims=True))
        moved = np.where(size > 0, moved / np.where(size > 0, size, 1), model.centres)
        if np.array_equal(moved, model.centres):
            break
        model.centres = moved
    return model


def chosen_centres(candidates: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """n of the candidates, each the one that leaves the least weighted distance."""
    gap = np.stack([np.clip(1 - (candidates * c).sum(axis=1), 0, None) for c in candidates], axis=1)
    left, chosen = np.ones(len(candidates)), []
    while len(chosen) < min(n, len(candidates)):
        sums = np.rint((np.minimum(left[:, None], gap) * weights[:, None]).sum(axis=0) * 2**20)
        sums[chosen] = np.inf
        chosen.append(int(sums.argmin()))
        left = np.minimum(left, gap[:, chosen[-1]])
    return candidates[chosen]


def word_column(text: Column, dims: int) -> Column:
    """hashed_words() of a text as a struct ``v, n_tokens``."""
    from pyspark.sql.functions import arrow_udf

    kind = pa.struct([("v", pa.binary()), ("n_tokens", pa.int64())])

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("v", "n_tokens"), hashed_words(t.as_py(), dims))) for t in texts], kind)

    return arrow_udf(run, "struct<v:binary,n_tokens:bigint>")(text)


def topic_column(model: TopicModel, v: Column) -> Column:
    """The topic of a vector of hashed_words(), -1 for null."""
    from pyspark.sql.functions import arrow_udf

    def run(vectors: pa.Array) -> pa.Array:
        held = vectors.to_pylist()
        out = np.full(len(held), -1, np.int32)
        at = [i for i, x in enumerate(held) if x is not None]
        for lo in range(0, len(at), ROWS):
            out[at[lo : lo + ROWS]] = model.topics([held[i] for i in at[lo : lo + ROWS]])
        return pa.array(out)

    return arrow_udf(run, "int")(v)


def tempered(shares: dict, power: float) -> dict:
    """Target shares: the shares there are, raised to a power below one, which lifts the rare ones."""
    raised = {k: v**power for k, v in shares.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def rake(tokens: np.ndarray, margins: list[np.ndarray], targets: list[np.ndarray], tolerance: float = 1e-9, rounds: int = 1_000) -> np.ndarray:
    """Cells' shares scaled until each margin has its targets.

    margins: for each margin the class of each cell; targets: for each margin the share of each class. Classes that
    no cell has are left out of a margin, with the rest of its targets scaled up; a margin of which nothing is left keeps
    its own shares. If the targets contradict each
    other (some cells are empty), the last round's shares are given, which meet the last margin.
    """
    cells = tokens / tokens.sum()
    goals = []
    for at, goal in zip(margins, targets):
        own = np.bincount(at, weights=cells, minlength=len(goal))
        goal = np.where(own > 0, goal, 0.0)
        goals.append(goal / goal.sum() if goal.sum() > 0 else own)
    for _ in range(rounds):
        worst = 0.0
        for at, goal in zip(margins, goals):
            now = np.bincount(at, weights=cells, minlength=len(goal))
            worst = max(worst, float(np.abs(now - goal).max()))
            cells = cells * np.where(now > 0, goal / np.where(now > 0, now, 1), 0.0)[at]
        if worst < tolerance:
            break
    return cells


def calibrated(tokens: np.ndarray, weights: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities ``min(1, l * weight)`` whose expected tokens are the budget (all that have weight, if that is too little)."""
    probs = np.zeros(len(weights))
    free, left = weights > 0, float(budget)
    while free.any():
        scale = left / float((tokens * weights)[free].sum())
        full = free & (weights * scale >= 1)
        if not full.any() or scale <= 0:
            probs[free] = np.clip(weights[free] * scale, 0, 1)
            break
        probs[full] = 1.0
        left -= float(tokens[full].sum())
        free &= ~full
    return probs


def _name(value) -> str:
    """How a class of a margin is written in cells, so that null is no value's name."""
    return "" if value is None else f"={value}"


def _class(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _goals(targets: dict[str, dict] | None, margin: str) -> dict[str, float] | None:
    return {_name(k): float(v) for k, v in targets[margin].items()} if (targets or {}).get(margin) else None


def plan(rows: DataFrame, margins: tuple[str, ...], targets: dict[str, dict] | None, keep: float, power: float) -> list[dict]:
    """Each cell's weight and probability; rows have the margins' columns and n_tokens."""
    cells = sorted(rows.groupBy(*margins).agg(F.sum("n_tokens").alias("tokens")).collect())
    if not cells:
        return []
    tokens = np.array([r["tokens"] for r in cells], np.float64)
    known = np.maximum(tokens, 1e-9)
    at, goals = [], []
    for m in margins:
        names = sorted({r[m] for r in cells})
        place = {n: k for k, n in enumerate(names)}
        where = np.array([place[r[m]] for r in cells])
        share = dict(zip(names, np.bincount(where, weights=known) / known.sum()))
        goal = _goals(targets, m) or tempered(share, power)
        at.append(where)
        goals.append(np.array([float(goal.get(n, 0.0)) for n in names]))
    raked = rake(known, at, goals)
    weights = raked * known.sum() / known
    probs = calibrated(known, weights, keep * known.sum())
    return [{**{m: r[m] for m in margins}, "weight": float(w), "prob": float(p)} for r, w, p in zip(cells, weights, probs)]


def plan_frame(rows: DataFrame, margins: tuple[str, ...], targets: dict[str, dict] | None, keep: float, power: float, tolerance: float = 1e-9, rounds: int = 1_000) -> DataFrame:
    """What plan() gives as a DataFrame of the margins, weight and prob, for any number of cells and classes.

    A margin's sums are joined to the cells, and the cells are checkpointed after each round.
    """
    spark, share = rows.sparkSession, F.col("share")
    cells = checkpointed(rows.groupBy(*margins).agg(F.greatest(F.sum("n_tokens").cast("double"), F.lit(1e-9)).alias("tokens")))
    total = cells.agg(F.sum("tokens")).first()[0]
    goals = {}
    for m in margins:
        goal = cells.groupBy(m).agg((F.sum("tokens") / total).alias("own"))
        if given := _goals(targets, m):
            goal = goal.join(spark.createDataFrame(list(given.items()), f"{m} string, goal double"), m, "left").select(m, "own", F.coalesce("goal", F.lit(0.0)).alias("goal"))
        else:
            goal = goal.select(m, "own", F.pow("own", F.lit(power)).alias("goal"))
        goal = checkpointed(goal)
        scale = goal.agg(F.sum("goal")).first()[0]
        goals[m] = goal.select(m, (F.col("goal") / scale if scale else F.col("own")).alias("goal"))
    now = cells.withColumn("share", F.col("tokens") / total)
    for _ in range(rounds):
        now = now.withColumn("gap", F.lit(0.0))
        for m in margins:
            sums = now.groupBy(m).agg(F.sum("share").alias("sum")).join(goals[m], m)
            now = now.join(sums, m).select(*margins, "tokens", F.when(F.col("sum") > 0, share * F.col("goal") / F.col("sum")).otherwise(0.0).alias("share"),
                                           F.greatest("gap", F.abs(F.col("sum") - F.col("goal"))).alias("gap"))
            now = checkpointed(now)
        if now.agg(F.max("gap")).first()[0] < tolerance:
            break
    weighted = checkpointed(now.select(*margins, "tokens", (share * total / F.col("tokens")).alias("weight")))
    scale, full = 0.0, -1
    while True:  # as calibrated(): the cells kept whole only become more
        whole = F.col("weight") * F.lit(scale) >= 1
        r = weighted.agg(F.count_if(whole).alias("n"), F.sum(F.when(whole, F.col("tokens")).otherwise(0.0)).alias("held"),
                         F.sum(F.when(~whole, F.col("tokens") * F.col("weight")).otherwise(0.0)).alias("free")).first()
        if r["n"] == full or r["free"] <= 0:
            break
        full, scale = r["n"], (keep * total - r["held"]) / r["free"]
    return weighted.select(*margins, "weight", F.least(F.lit(1.0), F.col("weight") * F.lit(scale)).alias("prob"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", targets: dict[str, dict] | None = None,
          keep: float = 0.5, power: float = 0.5, topics: int = 8, dims: int = 512, rounds: int = 10, seed: int = 1, driver_cells: int = 100_000) -> DataFrame:
    """``docs`` with ``topic``, ``n_tokens``, ``weight``, ``prob`` and ``kept``; columns of these names are replaced.

    targets: shares by class for the margins source, lang and topic, with the key None for null; a class that given
    targets leave out has the share 0, so its rows are not drawn; a margin without targets has its own shares raised to
    ``power``. keep: the budget, as a share of all tokens (words). Texts without words have the topic -1 and no tokens.
    A row is kept by a hash of its id and text, so repeated rows share their fate and a repeated run gives the same
    rows. An empty table gives no rows. The rows and their vectors are written to the shared folder once.
    """
    spark, names, own = docs.sparkSession, {"source": source_col, "lang": lang_col, "topic": "_topic"}, ("topic", "n_tokens", "weight", "prob", "kept")
    place = F.xxhash64(F.lit(5), F.col(id_col), text_key(F.col(text_col)))
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), text_key(F.col(text_col))), F.lit(1 << 53)) / float(1 << 53)
    path = fresh_path(spark, "mixing")
    word_rows = docs.drop(*own).select("*", place.alias("_place"), drawn.alias("_drawn"), word_column(F.col(text_col), dims).alias("_w"))
    word_rows.write.parquet(path)
    base = spark.read.schema(word_rows.schema).parquet(path)
    model = fit_topics(base.select(F.col("_w.v").alias("v"), F.col("_place").alias("place")), topics, dims, rounds)
    base = base.withColumn("_topic", topic_column(model, F.col("_w.v")))
    rows = checkpointed(base.select(*[_class(c).alias(m) for m, c in names.items()], F.col("_w.n_tokens").alias("n_tokens")).groupBy(*names).agg(F.sum("n_tokens").alias("n_tokens")))
    if small_enough(rows, driver_cells):
        cells = plan(rows, tuple(names), targets, keep, power)
        cells = cells or [{"source": "", "lang": "", "topic": "", "weight": 0.0, "prob": 0.0}]
        table = F.broadcast(spark.createDataFrame(cells, "source string, lang string, topic string, weight double, prob double"))
    else:
        table = plan_frame(rows, tuple(names), targets, keep, power)
    table = table.select(*[F.col(m).alias(f"_m_{m}") for m in names], "weight", "prob")
    labelled = base.select("*", F.col("_topic").alias("topic"), F.col("_w.n_tokens").alias("n_tokens"), *[_class(c).alias(f"_m_{m}") for m, c in names.items()])
    joined = labelled.join(table, [f"_m_{m}" for m in names], "left").withColumn("kept", F.col("_drawn") < F.coalesce("prob", F.lit(0.0)))
    return joined.select(*[c for c in docs.columns if c not in own], *own)
