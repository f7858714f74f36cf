"""Matching of citations to targets: by key, by prefix key, by tokens in common, and chains of these.

targets: ``(doc_id, target_id, ord, text)``; citations: ``(doc_id, citation_id, text)``. Both sides meet by document and key,
so the joins are equi-joins that Spark can broadcast or shuffle as sizes ask.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import text as T


def _by_key(targets: DataFrame, key: Column) -> DataFrame:
    """One target for each key: of several, the last."""
    return targets.select("doc_id", key.alias("key"), "target_id", "ord").groupBy("doc_id", "key").agg(F.max_by("target_id", "ord").alias("found"))


def match_by_key(citations: DataFrame, targets: DataFrame, prefix: int = 1) -> DataFrame:
    """``(doc_id, citation_id, target_id)``: equal keys, else equal keys of words cut to ``prefix`` characters; null without."""
    exact = _by_key(targets, T.key_text("text")).withColumnRenamed("found", "exact")
    short = _by_key(targets, T.prefix_key("text", prefix)).withColumnRenamed("found", "short").withColumnRenamed("key", "short_key")
    keyed = citations.select("doc_id", "citation_id", T.key_text("text").alias("key"), T.prefix_key("text", prefix).alias("short_key"))
    joined = keyed.join(exact, ["doc_id", "key"], "left").join(short, ["doc_id", "short_key"], "left")
    return joined.select("doc_id", "citation_id", F.coalesce("exact", "short").alias("target_id"))


def match_by_tokens(citations: DataFrame, targets: DataFrame) -> DataFrame:
    """``(doc_id, citation_id, target_id)``: the target seen first among those that share tokens; null if the second one seen has as many.

    Tokens count as often as they occur, on both sides.
    """
    asked = citations.select("doc_id", "citation_id", F.posexplode(T.key_tokens("text")).alias("q", "key"))
    held = targets.select("doc_id", "target_id", "ord", F.posexplode(T.key_tokens("text")).alias("p", "key"))
    hits = asked.join(held, ["doc_id", "key"]).groupBy("doc_id", "citation_id", "target_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("q", "ord", "p")).alias("seen"))
    w = Window.partitionBy("doc_id", "citation_id").orderBy("seen")
    best = hits.select("doc_id", "citation_id", "target_id", "n", F.row_number().over(w).alias("r"), F.lead("n").over(w).alias("next")).where("r = 1")
    chosen = best.select("doc_id", "citation_id", F.when(F.coalesce(F.col("next") != F.col("n"), F.lit(True)), F.col("target_id")).alias("target_id"))
    return citations.select("doc_id", "citation_id").join(chosen, ["doc_id", "citation_id"], "left")


def chained(*found: DataFrame) -> DataFrame:
    """The first answer of several matches of the same citations."""
    out = found[0]
    for more in found[1:]:
        out = out.join(more.withColumnRenamed("target_id", "_more"), ["doc_id", "citation_id"], "left").select("doc_id", "citation_id", F.coalesce("target_id", "_more").alias("target_id"))
    return out


def authors_with_affiliations(authors: DataFrame, affiliations: DataFrame) -> DataFrame:
    """Each author with the affiliations of its markers, in order; authors ``(doc_id, author_id, markers)``."""
    each = authors.select("doc_id", "author_id", F.posexplode_outer("markers").alias("m", "marker"))
    return each.join(affiliations.select("doc_id", "marker", "affiliation_id"), ["doc_id", "marker"], "left")


def orphan_affiliations(authors: DataFrame, affiliations: DataFrame) -> DataFrame:
    """The affiliations whose marker no author of the document has."""
    used = authors.select("doc_id", F.explode("markers").alias("marker"))
    return affiliations.join(used, ["doc_id", "marker"], "left_anti")


def with_ids(df: DataFrame, prefix: str, partition: list[str], order: list[str], name: str = "content_id", buckets: int = 256) -> DataFrame:
    """Sequential ids prefix0, prefix1, ... in order.

    Where the first column of the order is a number its range is cut into buckets, so that a partition's rows are numbered
    bucket by bucket, and those of a hot one not in one task; what comes before a bucket is a sum of counts.
    """
    first = F.col(order[0])
    if not isinstance(df.schema[order[0]].dataType, NumericType):
        number = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
        return df.withColumn(name, F.concat(F.lit(prefix), (number - 1).cast("string")))
    cuts = df.agg(F.percentile_approx(first, [k / buckets for k in range(1, buckets)], 10_000).alias("cuts")).first()["cuts"] or []
    below = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < first)) if cuts else F.lit(0)
    dealt = df.withColumn("_bucket", F.when(first.isNull(), -1).otherwise(below))
    counts = dealt.groupBy(*partition, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*partition).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_p_{c}") for c in partition], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in partition], F.col("_bucket") == F.col("_b"))
    number = F.row_number().over(Window.partitionBy(*partition, "_bucket").orderBy(*order)) - 1
    return dealt.join(starts, same).withColumn(name, F.concat(F.lit(prefix), (number + F.col("_before")).cast("string"))).select(*df.columns, name)
