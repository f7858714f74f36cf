"""Boxes, pages and graphics: unions, containment, nearest matches.

Boxes are ``struct<x, y, w, h, page>``. Everything meets by document (and page), so joins are equi-joins with a residual
condition on the boxes of one page or document; only the rounds of nearest matches are an ordered fold by document.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import match

BOX = ("x", "y", "w", "h")


def box(x: Column, y: Column, w: Column, h: Column, page: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), page.alias("page"))


def from_corners(x1: Column, y1: Column, x2: Column, y2: Column, page: Column) -> Column:
    return box(x1, y1, x2 - x1, y2 - y1, page)


def is_real(b: Column) -> Column:
    return F.coalesce((b["w"] != 0) & (b["h"] != 0), F.lit(False))


def area(b: Column) -> Column:
    return b["w"] * b["h"]


def overlap_area(a: Column, b: Column) -> Column:
    width = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    height = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0.0), width) * F.greatest(F.lit(0.0), height)


def is_within(item: Column, outer: Column, share: float = 0.5) -> Column:
    """Whether at least the share of a (real) box lies in another."""
    return is_real(item) & (overlap_area(item, outer) > 0) & (overlap_area(item, outer) / area(item) >= share)


def overlap_ratio(a: Column, b: Column) -> Column:
    """The common area over the larger area; 0 for empty boxes."""
    larger = F.greatest(area(a), area(b))
    return F.when(larger > 0, overlap_area(a, b) / larger).otherwise(0.0)


def distance(a: Column, b: Column) -> Column:
    """The distance between boxes: gaps on either axis, none where they overlap."""
    gap = lambda p, s: F.greatest(F.lit(0.0), b[p] - (a[p] + a[s]), a[p] - (b[p] + b[s]))
    return F.sqrt(gap("x", "w") * gap("x", "w") + gap("y", "h") * gap("y", "h"))


def list_distance(boxes: Column, others: Column) -> Column:
    """The least distance between two arrays of boxes."""
    return F.array_min(F.flatten(F.transform(boxes, lambda a: F.transform(others, lambda b: distance(a, b)))))


def on_page(b: Column, width: Column, height: Column) -> Column:
    """A box in units of its page, pages one below the other."""
    return box(b["x"] / width, b["y"] / height + b["page"], b["w"] / width, b["h"] / height, b["page"])


def merged_boxes(df: DataFrame, by: list[str], order: list[str], column: str = "coord") -> DataFrame:
    """The unions of boxes in a row on one page, a row each in order (``box_no``).

    A union that is empty so far is replaced by the next box, on whatever page.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    real = df.where(F.col(column).isNotNull())
    # Empty boxes before a run's first real one vanish; one that follows a real box counts by its corner.
    real = real.withColumn("_real", is_real(F.col(column)))
    last_real_page = F.last(F.when(F.col("_real"), F.col(f"{column}.page")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = real.withColumn("_before", last_real_page).where(F.col("_real") | (F.col("_before") == F.col(f"{column}.page")))
    change = ~F.col(f"{column}.page").eqNullSafe(F.lag(f"{column}.page").over(w))
    kept = kept.withColumn("box_no", F.sum(change.cast("int")).over(w) - 1)
    c = lambda name: F.col(f"{column}.{name}")
    out = kept.groupBy(*by, "box_no").agg(F.min(c("x")).alias("x"), F.min(c("y")).alias("y"), F.max(c("x") + c("w")).alias("x2"), F.max(c("y") + c("h")).alias("y2"), F.first(c("page")).alias("page"))
    return out.select(*by, "box_no", "page", "x", "y", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"))


def pages_of_other_size(pages: DataFrame) -> DataFrame:
    """``(doc_id, page_no)`` of pages whose size is not the document's most common (of equals, the first seen)."""
    sized = pages.where((F.col("width") != 0) & (F.col("height") != 0))
    sizes = sized.groupBy("doc_id", "width", "height").agg(F.count(F.lit(1)).alias("n"), F.min("page_no").alias("first"))
    common = sizes.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))).where("r = 1").select("doc_id", F.col("width").alias("w"), F.col("height").alias("h"))
    return sized.join(common, "doc_id").where((F.col("width") != F.col("w")) | (F.col("height") != F.col("h"))).select("doc_id", "page_no").distinct()


def bitmap_pages(pages: DataFrame, graphics: DataFrame, share: float = 0.5) -> DataFrame:
    """``(doc_id, page_no)`` of pages of which one bitmap (any type but svg) covers more than the share."""
    real = graphics.where(~F.coalesce(F.col("graphic_type") == "svg", F.lit(False)) & is_real(F.col("coord")))
    joined = real.join(pages, ["doc_id", "page_no"]).where(F.col("width") * F.col("height") > 0)
    return joined.groupBy("doc_id", "page_no").agg(F.max(area(F.col("coord")) / (F.col("width") * F.col("height"))).alias("share")).where(F.col("share") > share).select("doc_id", "page_no")


def render_pages(pages: DataFrame, graphics: DataFrame) -> DataFrame:
    """Pages to look at as images: of another size, without those that are mostly bitmaps."""
    return pages_of_other_size(pages).exceptAll(bitmap_pages(pages, graphics))


def with_next_pages(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages and those that follow them, if they exist."""
    more = wanted.select("doc_id", (F.col("page_no") + 1).alias("page_no")).join(pages, ["doc_id", "page_no"], "left_semi")
    return wanted.select("doc_id", "page_no").union(more).distinct()


def similar_graphics(boxes: DataFrame, graphics: DataFrame, least: float = 0.8) -> DataFrame:
    """``(doc_id, box_id, graphic_id, ratio)``: the graphic of the page that a detected box is most like, svg left out."""
    g = graphics.where(~F.coalesce(F.col("graphic_type") == "svg", F.lit(False)) & is_real(F.col("coord"))).select("doc_id", "page_no", "graphic_id", F.col("coord").alias("g"))
    scored = boxes.join(g, ["doc_id", "page_no"]).withColumn("ratio", overlap_ratio(F.col("coord"), F.col("g")))
    best = scored.groupBy("doc_id", "box_id").agg(F.max(F.struct("ratio", (-F.col("graphic_id")).alias("o"))).alias("m"))
    return best.where(F.col("m.ratio") >= least).select("doc_id", "box_id", (-F.col("m.o")).alias("graphic_id"), F.col("m.ratio").alias("ratio"))


def outside(items: DataFrame, boxes: DataFrame, share: float = 0.5) -> DataFrame:
    """The items (tokens or graphics, with page_no and coord) that do not lie in a box of their page."""
    b = boxes.select(F.col("doc_id").alias("_d"), F.col("page_no").alias("_p"), F.col("coord").alias("_b"))
    return items.join(b, (F.col("doc_id") == F.col("_d")) & (F.col("page_no") == F.col("_p")) & is_within(F.col("coord"), F.col("_b"), share), "left_anti")


def replaced_by_graphics(tokens: DataFrame, graphics: DataFrame, detected: DataFrame, replace_text: bool) -> tuple[DataFrame, DataFrame]:
    """Tokens and graphics of pages on which detected graphics take the place of what they cover."""
    return (outside(tokens, detected) if replace_text else tokens), outside(graphics, detected).unionByName(detected, allowMissingColumns=True)


def without_overlaps(boxes: Column, most: float = 0.1) -> Column:
    """Of an array of boxes in order, those of which less than the share lies in one kept before."""
    def keep(kept: Column, b: Column) -> Column:
        covered = F.exists(kept, lambda k: (overlap_area(b, k) > 0) & (overlap_area(b, k) / area(b) >= most))
        return F.when(covered, kept).otherwise(F.array_append(kept, b))

    return F.aggregate(boxes, F.slice(boxes, 1, 0), keep)


def detections(found: DataFrame, types: list[str], score: float, avoid_overlaps: bool = True, most: float = 0.1) -> DataFrame:
    """``(doc_id, page_no, boxes)``: real boxes of the types with the score, in order, without overlaps."""
    real = found.where(F.col("type").isin(types) & (F.col("score") >= score) & is_real(F.col("coord")))
    boxes = F.transform(F.array_sort(F.collect_list(F.struct("ord", "coord"))), lambda x: x["coord"])
    out = real.groupBy("doc_id", "page_no").agg(boxes.alias("boxes"))
    return out.withColumn("boxes", without_overlaps(F.col("boxes"), most)) if avoid_overlaps else out


def nearest_round(graphics: DataFrame, candidates: DataFrame, most: float = 0.3) -> DataFrame:
    """``(doc_id, graphic_id, candidate_id, distance)``: each graphic's nearest candidate, then each candidate's nearest graphic.

    Graphics ``(doc_id, graphic_id, boxes)`` (svg left out before), candidates ``(doc_id, candidate_id, boxes)``; distances
    must be below ``most``; ties go to the first. The pairs are those of one document.
    """
    c = candidates.where(F.size("boxes") > 0).select("doc_id", "candidate_id", F.col("boxes").alias("others"))
    pairs = graphics.where(F.size("boxes") > 0).join(c, "doc_id").select("doc_id", "graphic_id", "candidate_id", list_distance(F.col("boxes"), F.col("others")).alias("distance"))
    nearest = pairs.groupBy("doc_id", "graphic_id").agg(F.min(F.struct("distance", "candidate_id")).alias("m")).where(F.col("m.distance") < most)
    return (nearest.select("doc_id", F.col("m.candidate_id").alias("candidate_id"), F.col("m.distance").alias("distance"), "graphic_id")
            .groupBy("doc_id", "candidate_id").agg(F.min(F.struct("distance", "graphic_id")).alias("m")).select("doc_id", F.col("m.graphic_id").alias("graphic_id"), "candidate_id", F.col("m.distance").alias("distance")))


def _gap(a: dict, b: dict, p: str, s: str) -> float:
    return max(0.0, b[p] - (a[p] + a[s]), a[p] - (b[p] + b[s]))


def _matched(graphics: list[tuple], candidates: list[tuple], most: float) -> list[tuple]:
    found = []
    near = lambda bs, cs: min(math.hypot(_gap(a, b, "x", "w"), _gap(a, b, "y", "h")) for a in bs for b in cs)
    while graphics and candidates:
        best: dict = {}
        for g, boxes in graphics:
            d, _, c = min((near(boxes, others), i, i) for i, (_, others) in enumerate(candidates))
            if d < most and (c not in best or d < best[c][0]):
                best[c] = (d, g, boxes)
        if not best:
            break
        taken = {g for _, g, _ in best.values()}
        found += [(g, candidates[c][0], d) for c, (d, g, _) in best.items()]
        candidates = [(candidates[c][0], [*candidates[c][1], *boxes]) for c, (_, _, boxes) in best.items()]
        graphics = [x for x in graphics if x[0] not in taken]
    return found


def nearest_matches(graphics: DataFrame, candidates: DataFrame, most: float = 0.3) -> DataFrame:
    """Rounds of nearest matches until none is added: each round's matched candidates grow by their graphics and are the next round's."""
    both = graphics.select("doc_id", F.lit("g").alias("side"), F.col("graphic_id").alias("id"), "boxes").unionByName(candidates.select("doc_id", F.lit("c").alias("side"), F.col("candidate_id").alias("id"), "boxes"))
    kind = both.schema["doc_id"].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        sides = [[(i, list(b)) for s, i, b in zip(rows["side"], rows["id"], rows["boxes"]) if s == side and len(b)] for side in "gc"]
        return pd.DataFrame([(key[0], *m) for m in _matched(*sides, most)], columns=["doc_id", "graphic_id", "candidate_id", "distance"])

    return both.groupBy("doc_id").applyInPandas(run, f"doc_id {kind}, graphic_id BIGINT, candidate_id BIGINT, distance DOUBLE")


def text_matches(graphics: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(doc_id, graphic_id, candidate_id)``: the label that the first matching line of a graphic's text names.

    Graphics ``(doc_id, graphic_id, text)``, candidates ``(doc_id, candidate_id, label)``. Keys as for citations, words cut to three.
    """
    lines = graphics.select("doc_id", "graphic_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line", "text")).where("text <> ''")
    asked = lines.select("doc_id", F.struct("graphic_id", "line").alias("citation_id"), "text")
    targets = candidates.select("doc_id", F.col("candidate_id").alias("target_id"), F.col("candidate_id").alias("ord"), F.col("label").alias("text"))
    found = match.match_by_key(asked, targets, prefix=3).where(F.col("target_id").isNotNull())
    return found.groupBy("doc_id", F.col("citation_id.graphic_id").alias("graphic_id")).agg(F.min_by("target_id", "citation_id.line").alias("candidate_id"))


def graphic_matches(graphics: DataFrame, candidates: DataFrame, most: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Matches by distance, then by text for what is left; and the graphics left unmatched."""
    boxed = graphics.where(~F.coalesce(F.col("graphic_type") == "svg", F.lit(False)))
    near = nearest_matches(boxed, candidates, most).select("doc_id", "graphic_id", "candidate_id")
    rest = graphics.join(near, ["doc_id", "graphic_id"], "left_anti")
    by_text = text_matches(rest.where(F.col("text").isNotNull()), candidates)
    found = near.unionByName(by_text)
    return found, graphics.join(found, ["doc_id", "graphic_id"], "left_anti")


def graphic_rows(graphics: DataFrame, with_assets: bool) -> DataFrame:
    """Graphics with a real box; their file's name if assets are asked for."""
    name = F.regexp_extract("path", r"([^/]+)$", 1) if with_assets else F.lit(None).cast("string")
    return graphics.where(is_real(F.col("coord"))).withColumn("relative_path", name)
