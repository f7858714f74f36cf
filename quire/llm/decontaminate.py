"""Benchmark decontamination: short test items found inside long documents.

The search is a containment search with size-partitioned MinHash. Items are put into partitions by their
number of distinct shingles (bounds double). The bottom-k MinHash sketch of an item in a partition whose
largest item has ``u`` shingles holds ``2 * floor((1 - t) * u) + 4`` values (all, if it has fewer). A document
that contains at least the share ``t`` of an item's ``n`` shingles misses ``floor((1 - t) * n)`` at most, so of
``s`` sketch values it has ``s - floor((1 - t) * n)`` at least: looking for that many loses no document. What is
found is verified by exact containment of the shingles themselves, as text.

All of it is DataFrame code. The sketches (and the items' shingles) are broadcast only while they take at
most ``broadcast_bytes`` bytes; beyond that Spark shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, small_enough, text_key


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _windows(df: DataFrame, keep: list[str], size: int, shingle) -> DataFrame:
    """A row for each run of ``size`` entries of the array ``a``, as ``shingle(a, i)``."""
    at = df.where(F.size("a") >= size).select(*keep, "a", F.explode(F.sequence(F.lit(0), F.size("a") - size)).alias("i"))
    return at.select(*keep, shingle(F.col("a"), F.col("i"), size).alias("s"))


def _hashed(a: Column, i: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(a, i + k) for k in range(size)])


def _joined(a: Column, i: Column, size: int) -> Column:
    return F.concat_ws(" ", *[F.get(a, i + k) for k in range(size)])


def item_shingles(items: DataFrame, item_id: str, item_text: str, width: int) -> DataFrame:
    """``(item_id, width, s, h, n)``: an item's distinct shingles, their hashes and number.

    An item of fewer than ``width`` words is one shingle of all its words; one without words has none.
    """
    a = items.select(F.col(item_id).alias("item_id"), words_of(F.col(item_text)).alias("a")).where(F.size("a") > 0)
    per = None
    for size in range(1, width + 1):
        part = a.where(F.size("a") >= width) if size == width else a.where(F.size("a") == size)
        hashes = part.withColumn("w", F.transform("a", lambda w: F.xxhash64(w)))
        at = hashes.select("item_id", "a", "w", F.explode(F.sequence(F.lit(0), F.size("a") - size)).alias("i"))
        one = at.select("item_id", F.lit(size).alias("width"), _joined(F.col("a"), F.col("i"), size).alias("s"), _hashed(F.col("w"), F.col("i"), size).alias("h"))
        per = one if per is None else per.unionByName(one)
    per = per.distinct()
    return per.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("item_id")))


def sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """``(item_id, width, h, need)``: the MinHash sketch of each item, and the hits that a document must have."""
    missing = lambda n: F.floor((F.lit(1.0) - F.lit(threshold)) * n + 1e-9)
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.col("n")))).cast("long")
    size = F.least(F.col("n"), 2 * missing(upper) + 4)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.xxhash64("h"), "h"))
    return (shingles.withColumn("rank", rank).where(F.col("rank") <= size)
            .select("item_id", "width", "h", F.greatest(F.lit(1), size - missing(F.col("n"))).cast("long").alias("need")))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                 item_text: str = "text", width: int = 5, threshold: float = 0.8, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``(id, item_id, n_item, n_shared, containment)`` for each document that contains a test item.

    A document contains an item if it has at least the share ``threshold`` of the item's distinct shingles of
    ``width`` words (lower-cased runs of letters and digits). Null and empty texts, and items without words,
    match nothing. Rows that share an id give one row with the largest containment. A null id is kept as such.
    Extra columns are ignored; an empty table on either side gives no rows.
    """
    shingles = checkpointed(item_shingles(items, item_id, item_text, width))
    sketch = sketches(shingles, threshold)
    few = (shingles.agg(F.sum(F.octet_length("s") + 64)).first()[0] or 0) <= broadcast_bytes
    held = F.broadcast if few else (lambda df: df)
    widths = sorted(r["width"] for r in shingles.select("width").distinct().collect())  # width values at most

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = base.withColumn("t", text_key(F.col("text"))).withColumn("a", words_of(F.col("text"))).drop("text")
    hashed = keyed.withColumn("a", F.transform("a", lambda w: F.xxhash64(w)))
    hits = None
    for size in widths or [width]:
        found = _windows(hashed, ["id", "t"], size, _hashed).join(held(sketch.where(F.col("width") == size)), F.col("s") == F.col("h"))
        found = found.select("id", "t", "item_id", "h", "need")
        hits = found if hits is None else hits.unionByName(found)
    wanted = checkpointed(hits.distinct().groupBy("id", "t", "item_id", "need").agg(F.count(F.lit(1)).alias("hits"))
                          .where(F.col("hits") >= F.col("need")).select("id", "t", "item_id"))

    rows = wanted.select("id", "t").distinct()
    if small_enough(rows, broadcast_bytes // 128):
        rows = F.broadcast(rows)
    chosen = keyed.alias("d").join(rows.alias("c"), F.col("d.id").eqNullSafe(F.col("c.id")) & (F.col("d.t") == F.col("c.t")), "left_semi")
    shared = None
    for size in widths or [width]:
        part = shingles.where(F.col("width") == size).select("item_id", F.col("s").alias("item_s"), "n")
        one = _windows(chosen, ["id", "t"], size, _joined).join(held(part), F.col("s") == F.col("item_s")).select("id", "t", "item_id", "n", "s")
        shared = one if shared is None else shared.unionByName(one)
    exact = shared.distinct().groupBy("id", "t", "item_id", "n").agg(F.count(F.lit(1)).alias("n_shared")).alias("e")
    kept = exact.join(wanted.alias("w"), F.col("e.id").eqNullSafe(F.col("w.id")) & (F.col("e.t") == F.col("w.t")) & (F.col("e.item_id").eqNullSafe(F.col("w.item_id"))), "left_semi")
    return (kept.where(F.col("n_shared") >= F.lit(threshold) * F.col("n") - 1e-9)
            .groupBy(F.col("id").alias(id_col), "item_id").agg(F.max("n").cast("long").alias("n_item"), F.max("n_shared").cast("long").alias("n_shared"))
            .withColumn("containment", F.col("n_shared") / F.col("n_item")))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` whose id is not among the contaminated; all columns stay."""
    bad = contaminated(docs, items, id_col=id_col, **how).select(F.col(id_col).alias("_bad_id")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad_id"]), "left_anti")
