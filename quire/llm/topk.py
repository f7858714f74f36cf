"""Exact top-k inner-product search, term at a time.

Vectors are integer rows: component x counts as ``floor(scale * x)``. A task turns its block of candidate rows into
postings, a list of (row, weight) for each dimension with weights that are not zero. For each dimension ("term")
the queries that have it scatter their weight times the postings into a dense array of scores (queries by rows of the
block). A partition selection keeps each query's k best of the block, and the blocks' selections merge in Spark by
a ranked window. Nothing is skipped or estimated.

Queries and candidates are dealt into blocks of about ``block`` rows by a hash of their ids, and a task compares one block
of either: a grid of rows, none of which passes through the driver. The plan is the same whatever the tables' sizes; work
and shuffled rows grow with queries times candidates, as an exhaustive search has to look at all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidate rows and queries whose scores are accumulated at once.
ROWS, STRIP = 1_024, 256


def quantised(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """A vector that is not null and has no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(values: pa.ListArray, width: int) -> np.ndarray:
    offsets = values.offsets.to_numpy()
    flat = values.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64)
    lengths = np.diff(offsets)
    width = max(width, int(lengths.max(initial=0)))
    out = np.zeros((len(values), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _kind(queries: np.ndarray, rows: np.ndarray) -> np.dtype:
    """The narrowest type that holds all inner products; Python's integers where 64 bits could not."""
    most = max(1, min(queries.shape[1], rows.shape[1])) * int(abs(int(queries.max(initial=0))) | abs(int(queries.min(initial=0)))) * int(abs(int(rows.max(initial=0))) | abs(int(rows.min(initial=0))))
    return np.dtype(np.int32 if most < 2**30 else np.int64 if most < 2**62 else object)


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, accumulated term at a time over postings; those beyond 64 bits are set to the largest or least."""
    kind = _kind(queries, rows)
    by_term, postings = (np.ascontiguousarray(x.T.astype(kind)) for x in (queries, rows))
    acc = np.zeros((len(queries), len(rows)), kind)
    part = np.empty_like(acc)
    for weight, values in zip(by_term, postings):
        having, posting = np.flatnonzero(weight), np.flatnonzero(values)
        if not len(having) or not len(posting):
            continue
        if 2 * len(posting) > len(values):  # a long list of postings: the rows left out add nothing
            if 2 * len(having) > len(weight):
                acc += np.multiply(weight[:, None], values[None, :], out=part)
            else:
                acc[having] += weight[having, None] * values[None, :]
        else:
            acc[np.ix_(having, posting)] += weight[having, None] * values[None, posting]
    if kind == object:
        acc = np.clip(acc, LEAST + 1, -(LEAST + 1)).astype(np.int64)
    return acc


#: Below every score.
LEAST = -(2**63)


class Best:
    """The k best candidates of each query so far: highest scores, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.order = np.argsort(ids, kind="stable")
        self.bar = np.full(len(ids), LEAST)
        self.held = (np.zeros(0, np.int64),) * 3

    def add(self, at: int, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries from ``at`` on with candidates of these ids, by partition selection; own ids take no part."""
        score = score.astype(np.int64)
        place = np.searchsorted(self.ids, ids, sorter=self.order)  # of each candidate, the query it is itself
        place = self.order[np.minimum(place, len(self.order) - 1)]
        own = (self.ids[place] == ids) & (place >= at) & (place < at + len(score))
        score[place[own] - at, np.flatnonzero(own)] = LEAST
        bar = self.bar[at : at + len(score)]
        hit = (score >= bar[:, None]) & (score > LEAST)
        if np.count_nonzero(hit) > 4 * self.k * len(score) and score.shape[1] > self.k:
            bar = np.maximum(bar, np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k])
            hit &= score >= bar[:, None]
        q, c = np.nonzero(hit)
        if not len(q):
            return
        query, id_, points = (np.concatenate(x) for x in zip(self.held, (q + at, ids[c], score[q, c])))
        order = np.lexsort((id_, -points, query))
        query, id_, points = query[order], id_[order], points[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.k - 1
        self.bar[query[last]] = points[last]
        self.held = tuple(x[rank < self.k] for x in (query, id_, points))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, block: int = 8_192) -> DataFrame:
    """``(query_id, rank, id, score)``: each query's k highest integer inner products with the rows of other ids.

    Fewer than k rows if there are fewer candidates; ties go to the smaller id. Vectors that are null or hold null
    or non-finite components take no part; of vectors of unequal length the missing components count as zero. Rows
    with a null id are left out. A repeated id that is a query is asked once (its first vector in Spark's order of
    arrays); repeated candidate rows count each. Components and scores beyond 64 bits count as the largest or least
    number of 64 bits. Extra columns are ignored; an empty table gives no rows.
    """
    base = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("raw"), is_query.alias("q"))
    rows = base.select("id", quantised(F.col("raw"), scale).alias("v"))
    asked = base.where("q").groupBy("id").agg(F.min("raw").alias("raw")).select("id", quantised(F.col("raw"), scale).alias("v"))
    counts = base.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q")).first()
    of = lambda n: max(1, -(-n // block))
    across, down = of(counts["n"]), of(counts["q"])
    tasks = min(4 * across * down, 16 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a task takes one pair of blocks after another
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    grid = asked.select(own(down).alias("i"), every(across).alias("j"), F.lit(0).alias("side"), "id", "v").unionByName(rows.select(every(down).alias("i"), own(across).alias("j"), F.lit(1).alias("side"), "id", "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked_, waiting, best = None, [], [], None

        def compared() -> None:
            nonlocal asked_, waiting, best
            if asked_ and waiting:
                if best is None:
                    ids = np.concatenate([i for i, _ in asked_])
                    width = max(m.shape[1] for _, m in asked_)
                    best = Best(ids, k), np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for _, m in asked_])
                for ids, m in waiting:
                    for lo in range(0, len(ids), ROWS):
                        for q in range(0, len(best[1]), STRIP):
                            best[0].add(q, scores(best[1][q : q + STRIP], m[lo : lo + ROWS]), ids[lo : lo + ROWS])
            waiting = []

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal asked_, best
            compared()
            if best is not None:
                q, ids, points = best[0].held
                yield pa.RecordBatch.from_arrays([pa.array(best[0].ids[q]), pa.array(ids), pa.array(points)], names=["query_id", "id", "score"])
            asked_, best = [], None

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy() for c in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:]):
                i, j, side = key[lo].tolist()
                if (i, j) != at:
                    yield from done()
                    at = i, j
                part = b.slice(lo, hi - lo)
                (waiting if side else asked_).append((part.column(3).to_numpy().astype(np.int64), _matrix(part.column(4), 0)))
                compared() if side else None
        yield from done()

    found = grid.repartition(tasks, "i", "j").sortWithinPartitions("i", "j", "side").mapInArrow(run, "query_id BIGINT, id BIGINT, score BIGINT")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
