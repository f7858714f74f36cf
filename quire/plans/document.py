"""The whole plan: from layout tokens to semantic nodes, TEI and JATS.

A plan takes labellers, functions from ``(tokens, model)`` to labelled tokens, so any model can give the labels. Parts that a
request does not name are never built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graphics as G
from ..operators import jats as J
from ..operators import labels as L
from ..operators import match, semantic, tei

FRONT = frozenset({"title", "abstract", "authors", "affiliations"})


@dataclass(frozen=True)
class PlanConfig:
    """Which parts are extracted."""

    front: bool = True
    authors: bool = True
    affiliations: bool = True
    body: bool = True
    acknowledgements: bool = True
    annex: bool = True
    references: bool = True
    citation_fields: bool = True
    graphics: bool = True

    def for_fields(self, names: Iterable[str]) -> PlanConfig:
        """The parts that the named fields need; all of them for none, or for an unknown name."""
        wanted = frozenset(names)
        if not wanted or wanted - FRONT - {"references"}:
            return self
        return replace(self, front=bool(wanted & FRONT), authors="authors" in wanted, affiliations="affiliations" in wanted, references="references" in wanted,
                       body=False, acknowledgements=False, annex=False, graphics=False)

    def for_header(self) -> PlanConfig:
        return self.for_fields(FRONT)


Labeller = Callable[[DataFrame, str], DataFrame]


def rule_labeller(tokens: DataFrame, model: str) -> DataFrame:
    """Labels by simple rules of place and form; it stands in for trained models in examples and tests."""
    line, token = F.col("line_no"), F.col("token_no")
    digit, capital = F.col("text").rlike("^[0-9]+$"), F.col("text").rlike(r"^\p{Lu}")
    rules = {
        "segmentation": [(F.col("block_no") == 0, "<header>"), (F.col("block_no") % 11 == 10, "<references>"), (F.col("block_no") % 13 == 12, "<acknowledgement>"), (line >= 0, "<body>")],
        "header": [(line == 0, "<title>"), (line == 1, "<author>"), (line == 2, "<affiliation>"), (line >= 3, "<abstract>")],
        "name": [(digit, "<marker>"), (token % 2 == 0, "<forename>"), (token % 2 == 1, "<surname>")],
        "affiliation_address": [(digit, "<marker>"), (token < 3, "<institution>"), (token >= 3, "<country>")],
        "fulltext": [(line % 17 == 16, "<figure>"), (line % 19 == 18, "<table>"), ((line % 7 == 0) & (token < 3), "<section>"), (digit, "<citation_marker>"), (line >= 0, "<paragraph>")],
        "figure": [(token < 2, "<label>"), (line >= 0, "<figDesc>")],
        "table": [(token < 2, "<label>"), (line >= 0, "<figDesc>")],
        "reference_segmenter": [(token == 0, "<label>"), (line >= 0, "<reference>")],
        "citation": [(token < 2, "<author>"), (digit, "<date>"), (capital, "<journal>"), (line >= 0, "<title>")],
    }
    return L.with_rule_labels(tokens, rules[model])


def names_in(tokens: DataFrame, label: Labeller) -> DataFrame:
    return semantic.name_nodes(L.spans(label(tokens, "name")))


def affiliations_in(tokens: DataFrame, label: Labeller) -> DataFrame:
    return semantic.affiliation_nodes(L.spans(label(tokens, "affiliation_address")))


def sub_tokens(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The tokens of spans as documents of their own, for the next model: doc_id is the keys as JSON (see with_keys)."""
    each = spans.select(F.to_json(F.struct(*keys)).alias("doc_id"), F.explode("tokens").alias("t"))
    return each.select("doc_id", "t.line_no", "t.token_no", "t.text", "t.whitespace", "t.font", "t.coord")


def with_keys(nodes: DataFrame, of: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes of sub_tokens() with their keys as columns again, of the types they have in ``of``."""
    schema = ", ".join(f"{k} {of.schema[k].dataType.simpleString()}" for k in keys)
    return nodes.withColumn("_key", F.from_json("doc_id", schema)).drop("doc_id").select(*[F.col(f"_key.{k}").alias(k) for k in keys], "*").drop("_key")


def citations_in(references: DataFrame, spans: DataFrame, label: Labeller) -> DataFrame:
    """``(doc_id, content_id, span_no, type, ...)``: the fields of references, by the citation model; authors as elements, by the name model.

    references, spans: the nodes of a reference list and the spans that they come from. A reference without any of the
    fields that make it one has none.
    """
    raw = references.where(F.col("type") == "RawReferenceText").select("doc_id", "span_no", "content_id").join(spans.select("doc_id", "span_no", "tokens"), ["doc_id", "span_no"])
    found = L.spans(label(sub_tokens(raw, ["doc_id", "content_id"]), "citation"))
    fields = with_keys(semantic.citation_nodes(found).where("valid"), raw, ["doc_id", "content_id"])
    authors = fields.where(F.col("type") == "RawAuthors")
    keys = ["doc_id", "content_id", "span_no"]
    names = with_keys(semantic.name_nodes(L.spans(label(sub_tokens(authors, keys), "name"))), authors, keys)
    elements = tei.author_elements(names, [*keys, "name_no"]).groupBy(*keys).agg(tei.in_order("xml", ["name_no"]).alias("xml"))
    parsed = fields.join(elements, keys, "left")
    return parsed.withColumn("type", F.when(F.col("xml").isNotNull(), "Author").otherwise(F.col("type"))).drop("tokens", "first_line", "first_token")


def figures_in(parts: list[tuple[DataFrame, DataFrame]], label: Labeller, table: bool) -> DataFrame:
    """``(doc_id, content_id, ord, span_no, type, note_type, text, boxes)``: the parts of figures (or tables), by their model.

    parts: nodes of running text with the spans that they come from. Figures are fig_0, fig_1, ... in the order of the
    parts, tables tab_0, ...; boxes are those of all tokens of the figure.
    """
    kind, model, prefix = ("RawTable", "table", "tab_") if table else ("RawFigure", "figure", "fig_")
    raw = None
    for i, (nodes, spans) in enumerate(parts):
        one = nodes.where(F.col("type") == kind).select("doc_id", "span_no").join(spans.select("doc_id", "span_no", "tokens"), ["doc_id", "span_no"]).withColumn("part", F.lit(i))
        raw = one if raw is None else raw.unionByName(one)
    raw = raw.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "span_no")) - 1)
    raw = raw.withColumn("content_id", F.concat(F.lit(prefix), F.col("ord").cast("string")))
    keys = ["doc_id", "content_id", "ord"]
    nodes = with_keys(semantic.figure_nodes(L.spans(label(sub_tokens(raw, keys), model))), raw, keys)
    boxes = F.filter(F.transform("tokens", lambda t: t["coord"]), lambda b: b["w"] > 0)
    return nodes.join(raw.select("doc_id", "content_id", boxes.alias("boxes")), ["doc_id", "content_id"])


def with_graphics(figures: DataFrame, graphics: DataFrame) -> DataFrame:
    """Figure parts with a Graphic for each graphic that matches one by place, or else by text; url is its file.

    graphics: ``(doc_id, graphic_id, graphic_type, relative_path, boxes, text)``, boxes in the units of the tokens'.
    """
    label = F.first(F.when(F.col("type") == "Label", F.col("text")), ignorenulls=True)
    candidates = figures.groupBy("doc_id", F.col("ord").cast("long").alias("candidate_id")).agg(F.first("boxes").alias("boxes"), label.alias("label"))
    found, _ = G.graphic_matches(graphics, candidates)
    named = found.join(graphics.select("doc_id", "graphic_id", "relative_path"), ["doc_id", "graphic_id"])
    ends = figures.groupBy("doc_id", "content_id", "ord").agg(F.max("span_no").alias("last")).withColumn("candidate_id", F.col("ord").cast("long"))
    more = named.join(ends, ["doc_id", "candidate_id"]).select(
        "doc_id", "content_id", "ord", (F.col("last") + 1 + F.col("graphic_id")).cast("int").alias("span_no"), F.lit("Graphic").alias("type"), F.lit("").alias("text"), F.col("relative_path").alias("url"))
    return figures.unionByName(more, allowMissingColumns=True)


def release(documents: DataFrame) -> None:
    """Frees what convert() and converted() keep in storage for a result, once it is written."""
    for frame in documents.__dict__.pop("_held", []):
        frame.unpersist()


def convert(tokens: DataFrame, label: Labeller = rule_labeller, includes: Iterable[str] = (), config: PlanConfig = PlanConfig(), graphics: DataFrame | None = None) -> DataFrame:
    """``(doc_id, tei)`` of layout tokens; includes: names of the fields wanted (title, abstract, authors, affiliations, references).

    graphics: as of with_graphics(). Call release() with the result once it is written.
    """
    plan = config.for_fields(includes)
    held: list[DataFrame] = []

    def kept(df: DataFrame) -> DataFrame:
        """A frame that several branches read; if an executor is lost its part is made again from the tokens."""
        held.append(df.persist())
        return held[-1]

    segments = kept(label(tokens, "segmentation"))
    part = lambda *labels: L.filtered(segments, list(labels)).drop("label")
    front = tokens.select("doc_id").distinct()
    if plan.front:
        header = kept(label(part("<header>"), "header"))
        nodes = kept(semantic.header_nodes(L.spans(header)))
        one = lambda kind, name: nodes.where(F.col("type") == kind).groupBy("doc_id").agg(F.first(T.escaped("text")).alias(name))
        notes = nodes.where((F.col("type") == "Note")).groupBy("doc_id").agg(tei.in_order(tei.note(F.col("note_type"), T.escaped("text")), ["ordinal"]).alias("notes"))
        for more in (one("Title", "title"), one("Abstract", "abstract"), notes):
            front = front.join(more, "doc_id", "left")
        if plan.authors:
            affs = None
            if plan.affiliations:
                parts = affiliations_in(L.filtered(header, ["<affiliation>", "<address>"]).drop("label"), label)
                real = parts.where(F.col("note_type").isNull() | (F.col("part_no") > 0)).withColumn("content_id", F.concat(F.lit("aff"), F.col("name_no").cast("string")))
                affs = kept(tei.affiliation_elements(real, ["doc_id", "name_no", "content_id"]).select("doc_id", "marker", F.col("name_no").alias("ord"), "xml"))
            names = kept(names_in(L.filtered(header, ["<author>"]).drop("label"), label))
            authors = tei.author_elements(names, ["doc_id", "name_no"], affs).groupBy("doc_id").agg(tei.in_order("xml", ["name_no"]).alias("authors"))
            if affs is not None:
                # Affiliations that no author names stand under an author of their own.
                used = names.where(F.col("type") == "Marker").select("doc_id", F.col("text").alias("marker"))
                orphans = affs.join(used, ["doc_id", "marker"], "left_anti").groupBy("doc_id").agg(tei.in_order("xml", ["ord"]).alias("_orphans"))
                dummy = tei.note("dummy_author", F.lit("Dummy author for orphan affiliations"))
                joined = authors.join(orphans, "doc_id", "full")
                authors = joined.select("doc_id", F.concat(F.coalesce("authors", F.lit("")), F.coalesce(F.concat(F.lit("<author>"), dummy, F.col("_orphans"), F.lit("</author>")), F.lit(""))).alias("authors"))
            front = front.join(authors, "doc_id", "left")
    references = fields = None
    if plan.references:
        listed = kept(L.spans(label(part("<references>"), "reference_segmenter")))
        references = kept(semantic.reference_nodes(listed).where(F.col("content_id").isNotNull()))
        if plan.citation_fields:
            fields = citations_in(references, listed, label)
    sections = []
    for wanted, label_name, name, kind in ((plan.body, "<body>", "body", "OTHER"), (plan.acknowledgements, "<acknowledgement>", "acknowledgements", "ACKNOWLEDGEMENT"), (plan.annex, "<annex>", "annex", "OTHER")):
        if wanted:
            spans = kept(L.spans(label(part(label_name), "fulltext")))
            sections.append((name, kept(semantic.fulltext_nodes(spans, kind)), spans))
    by_part = {}
    for name, nodes, _ in sections:
        pieces = semantic.flat_paragraphs(nodes)
        if references is not None and plan.citation_fields:
            cited = pieces.where(F.col("type") == "ReferenceCitation").select("doc_id", F.col("span_no").alias("citation_id"), "text")
            of = lambda kind: references.where(F.col("type") == kind).groupBy("doc_id", F.col("content_id").alias("target_id")).agg(F.min("span_no").alias("ord"), tei.in_order("text", ["span_no"], " ").alias("text"))
            found = match.chained(match.match_by_key(cited, of("Label")), match.match_by_tokens(cited, of("RawReferenceText")))
            pieces = pieces.join(found.select("doc_id", F.col("citation_id").alias("span_no"), F.col("target_id").alias("target")), ["doc_id", "span_no"], "left")
        columns = [c for c in pieces.columns]
        others = nodes.where(F.col("paragraph_no").isNull())
        whole = pieces.unionByName(others.select(*[c for c in columns if c in others.columns]), allowMissingColumns=True)
        by_part[name] = tei.section_elements(whole).groupBy("doc_id").agg(tei.in_order("xml", ["section_no"]).alias(name))
    body, back = by_part.get("body"), None
    if body is not None:
        for table in (False, True):  # figures, then tables, behind the text's sections
            parts = figures_in([(n, s) for _, n, s in sections], label, table)
            if plan.graphics and graphics is not None and not table:
                parts = with_graphics(parts, graphics)
            column = "tables" if table else "figures"
            elements = tei.figure_elements(parts, ["doc_id", "content_id", "ord"], table).groupBy("doc_id").agg(tei.in_order("xml", ["ord"]).alias(column))
            joined = body.join(elements, "doc_id", "full")
            body = joined.select("doc_id", F.concat(F.coalesce("body", F.lit("")), F.coalesce(column, F.lit(""))).alias("body"))
    rear = [by_part[n] for n in ("acknowledgements", "annex") if n in by_part]
    if references is not None:
        none = F.lit(None).cast("string")
        nodes = references.select("doc_id", "content_id", F.when(F.col("type") == "Label", 0).otherwise(1).alias("ord"), "span_no", "type", "text", none.alias("value"), "note_type")
        if fields is not None:
            nodes = nodes.unionByName(fields.withColumn("ord", F.lit(2)), allowMissingColumns=True)
        elements = tei.reference_elements(nodes, ["doc_id", "content_id"], ["ord", "span_no"]).withColumn("_n", F.substring("content_id", 2, 20).cast("int"))
        rear.append(elements.groupBy("doc_id").agg(tei.in_order("xml", ["_n"]).alias("references")))
    for more in rear:
        back = more if back is None else back.join(more, "doc_id", "full")
    out = tei.documents(front, body, back)
    out._held = held
    return out


def converted(tokens: DataFrame, output: str = "tei", options: J.JatsOptions = J.JatsOptions(), **how) -> DataFrame:
    """``(doc_id, tei[, jats])`` by output."""
    if output not in ("tei", "jats"):
        raise ValueError(f"unknown output {output}")
    documents = convert(tokens, **how)
    if output == "tei":
        return documents
    out = J.jats(documents, options)
    out._held = documents._held
    return out


def header(tokens: DataFrame, label: Labeller = rule_labeller) -> DataFrame:
    return convert(tokens, label, includes=sorted(FRONT))


def references(tokens: DataFrame, label: Labeller = rule_labeller) -> DataFrame:
    return convert(tokens, label, includes=["references"])


def fulltext(tokens: DataFrame, label: Labeller = rule_labeller) -> DataFrame:
    return convert(tokens, label)
