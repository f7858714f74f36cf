"""From labelled spans to semantic nodes.

spans: ``(doc_id, span_no, tag, text, n_tokens)`` as by ``labels.spans``. Where the grouping depends on neighbours only it is
a window; the two machines whose resets depend on their state (names, affiliations) are ordered folds by document.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def span_order():
    """A document's spans in order."""
    return Window.partitionBy("doc_id").orderBy("span_no")


def before():
    return span_order().rowsBetween(Window.unboundedPreceding, -1)


def up_to():
    return span_order().rowsBetween(Window.unboundedPreceding, 0)


def after():
    return span_order().rowsBetween(1, Window.unboundedFollowing)


# Types of nodes by label.
HEADER_TYPES = {"<author>": "RawAuthors", "<affiliation>": "RawAffiliation", "<address>": "RawAddress"}
CITATION_TYPES = {"<author>": "RawAuthors", "<editor>": "RawEditors", "<title>": "Title", "<journal>": "Journal", "<volume>": "Volume", "<issue>": "Issue", "<publisher>": "Publisher", "<location>": "Location"}
FIGURE_TYPES = {"<label>": "Label", "<figDesc>": "Caption"}
PARAGRAPH_TYPES = {"<figure_marker>": "FigureCitation", "<table_marker>": "TableCitation", "<citation_marker>": "ReferenceCitation"}
SECTION_TYPES = {"<figure>": "RawFigure", "<table>": "RawTable"}
NAME_TYPES = {"<title>": "NameTitle", "<forename>": "GivenName", "<middlename>": "MiddleName", "<surname>": "Surname", "<suffix>": "NameSuffix"}
AFFILIATION_TYPES = {"<institution>": "Institution", "<department>": "Department", "<laboratory>": "Laboratory", "<addrLine>": "AddressLine", "<postCode>": "PostCode", "<postBox>": "PostBox", "<region>": "Region", "<settlement>": "Settlement", "<country>": "Country"}
VALID_REFERENCE = ["Title", "Journal", "RawAuthors", "RawEditors", "ExternalIdentifier", "ExternalUrl"]


def typed(tag: Column, types: dict[str, str]) -> Column:
    """The type of a label, Note for any other."""
    known = F.element_at(T.literal_map(types), tag)
    return F.coalesce(known, F.lit("Note"))


def header_nodes(spans: DataFrame) -> DataFrame:
    """``(doc_id, ordinal, node_no, type, note_type, text)`` of a header.

    The first title and abstract stand for themselves (the abstract without its leading word), later ones are notes.
    Affiliations and addresses in a row form one RawAffiliationAddress, until an affiliation follows either, or another
    part comes between; node_no numbers these groups, and ordinal is the place at which each node is complete.
    """
    tag = F.col("tag")
    nth = F.row_number().over(Window.partitionBy("doc_id", "tag").orderBy("span_no"))
    df = spans.withColumn("first_title", (tag == "<title>") & (nth == 1)).withColumn("first_abstract", (tag == "<abstract>") & (nth == 1))
    single = F.col("first_title") | F.col("first_abstract")
    aff = tag.isin("<affiliation>", "<address>")
    df = df.withColumn("aff", aff).withColumn("reset", ~aff & ~single)
    last_reset = F.coalesce(F.max(F.when(F.col("reset"), F.col("span_no"))).over(before()), F.lit(-1))
    last_aff = F.coalesce(F.max(F.when(F.col("aff"), F.col("span_no"))).over(before()), F.lit(-1))
    after_aff = F.coalesce(F.lag("tag").over(span_order()).isin("<affiliation>", "<address>"), F.lit(False))
    df = df.withColumn("start", F.col("aff") & ((last_aff <= last_reset) | ((tag == "<affiliation>") & after_aff)))
    df = df.withColumn("group", F.when(F.col("aff"), F.sum(F.col("start").cast("int")).over(up_to())))
    closes = F.min(F.when(F.col("reset") | F.col("start"), F.col("span_no"))).over(after())
    df = df.withColumn("closes", F.coalesce(closes, F.lit(2**30)))
    closed = F.max("closes").over(Window.partitionBy("doc_id", "group"))
    first_closes = F.min_by("closes", "span_no").over(Window.partitionBy("doc_id", "group"))
    text = F.when(F.col("first_abstract"), T.without_abstract_word("text")).otherwise(F.col("text"))
    kind = F.when(F.col("first_title"), "Title").when(F.col("first_abstract"), "Abstract").otherwise(typed(tag, HEADER_TYPES))
    place = F.when(F.col("group").isNotNull(), F.least(closed, first_closes) - F.lit(0.5)).otherwise(F.col("span_no").cast("double"))
    out = df.select("doc_id", place.alias("_place"), "span_no", F.col("group").cast("int").alias("node_no"), kind.alias("type"), F.when(kind == "Note", tag).alias("note_type"), text.alias("text"))
    return out.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("_place", "span_no")) - 1).drop("_place", "span_no")


def reference_nodes(spans: DataFrame) -> DataFrame:
    """``(doc_id, span_no, content_id, type, note_type, text)`` of a reference list.

    Labels belong to the reference that follows. The first reference is a heading if it has no label and three tokens
    at most. References are b0, b1, ... in order.
    """
    tag = F.col("tag")
    is_ref, is_label = tag == "<reference>", tag == "<label>"
    refs_before = F.coalesce(F.sum(is_ref.cast("int")).over(before()), F.lit(0))
    labels_before = F.coalesce(F.sum(is_label.cast("int")).over(before()), F.lit(0))
    df = spans.withColumn("heading", is_ref & (refs_before == 0) & (labels_before == 0) & (F.col("n_tokens") <= 3))
    group = F.coalesce(F.sum((is_ref & ~F.col("heading")).cast("int")).over(before()), F.lit(0))
    part = (is_ref & ~F.col("heading")) | is_label
    kind = F.when(F.col("heading"), "Heading").when(is_label, "Label").when(is_ref, "RawReferenceText").otherwise("Note")
    return df.select("doc_id", "span_no", F.when(part, F.concat(F.lit("b"), group.cast("string"))).alias("content_id"), kind.alias("type"), F.when(kind == "Note", tag).alias("note_type"), "text")


def citation_nodes(spans: DataFrame, partition: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(.., span_no, type, note_type, text, value, id_type, from_page, to_page, year, valid)``: the fields of references.

    valid: whether the reference has one field at least that makes it one.
    """
    tag, ident, web, pages = F.col("tag"), T.external_id("text"), T.web_link("text"), T.page_range("text")
    is_web, is_id, is_date, is_pages = tag == "<web>", tag == "<pubnum>", tag == "<date>", tag == "<pages>"
    kind = (F.when(is_pages, "PageRange").when(is_id | (is_web & (web["type"] == "DOI")), "ExternalIdentifier").when(is_web, "ExternalUrl").when(is_date, "Date").otherwise(typed(tag, CITATION_TYPES)))
    out = spans.withColumn("type", kind).withColumns({
        "note_type": F.when(kind == "Note", tag),
        "value": F.when(is_id, ident["value"]).when(is_web, web["value"]), "id_type": F.when(is_id, ident["type"]).when(is_web & (web["type"] == "DOI"), "DOI"),
        "from_page": F.when(is_pages, pages["from_page"]), "to_page": F.when(is_pages, pages["to_page"]), "year": F.when(is_date, T.year("text")),
    })
    return out.withColumn("valid", F.max(F.col("type").isin(VALID_REFERENCE)).over(Window.partitionBy(*partition))).drop("tag", "n_tokens")


def fulltext_nodes(spans: DataFrame, section_type: str = "OTHER") -> DataFrame:
    """``(doc_id, span_no, section_no, paragraph_no, equation_no, type, note_type, text, label)`` of running text.

    A ``<section>`` opens a section; content before the first one is in section 0. A paragraph opens with a section's
    first content, and between two ``<paragraph>`` spans in a row. Equations and their labels in a row form one equation
    with one content at most. Text outside is a note. section_no is null before any section.
    """
    tag = F.col("tag")
    outside, heading = tag == "O", tag == "<section>"
    block = tag.isin(list(SECTION_TYPES))
    content = ~outside & ~heading & ~block
    df = spans.withColumns({
        "heading": heading, "content": content, "before": F.lag("tag").over(span_order()), "equation": tag.isin("<equation>", "<equation_label>"),
        "seen": F.coalesce(F.max((~outside).cast("int")).over(up_to()), F.lit(0)),
        "headings": F.coalesce(F.sum(heading.cast("int")).over(up_to()), F.lit(0)),
    })
    # Section 0 is there only if something stands before the first heading.
    early = F.max((~outside & (F.col("headings") == 0)).cast("int")).over(Window.partitionBy("doc_id"))
    df = df.withColumn("section_no", F.when(F.col("seen") == 1, F.when(early == 1, F.col("headings")).otherwise(F.col("headings") - 1)).cast("int"))
    section = Window.partitionBy("doc_id", "headings").orderBy("span_no")
    earlier = F.coalesce(F.max(F.col("content").cast("int")).over(section.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    opens = F.col("content") & ((earlier == 0) | ((tag == "<paragraph>") & (F.col("before") == "<paragraph>")))
    df = df.withColumn("opens", opens)
    df = df.withColumn("paragraph_no", F.when(F.col("content"), F.sum(F.col("opens").cast("int")).over(section.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    resets = F.sum((F.col("heading") | (F.col("content") & ~F.col("equation"))).cast("int")).over(up_to())
    df = df.withColumn("run", resets)
    run = Window.partitionBy("doc_id", "run").orderBy("span_no").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("equation_no", F.when(F.col("equation"), F.greatest(F.lit(1), F.sum((tag == "<equation>").cast("int")).over(run)) - 1).cast("int"))
    kind = (F.when(outside, "Note").when(heading, "Heading").when(tag == "<equation>", "RawEquationContent").when(tag == "<equation_label>", "Label")
            .otherwise(F.coalesce(F.element_at(T.literal_map({**PARAGRAPH_TYPES, **SECTION_TYPES}), tag), F.lit("Text"))))
    parts = T.heading_parts("text")
    return df.select("doc_id", "span_no", "section_no", "paragraph_no", "run", "equation_no", F.lit(section_type).alias("section_type"), kind.alias("type"), F.when(outside, "fulltext:other").alias("note_type"),
                     F.when(heading, parts["title"]).otherwise(F.col("text")).alias("text"), F.when(heading, parts["label"]).alias("label"))


def figure_nodes(spans: DataFrame) -> DataFrame:
    """``(doc_id, span_no, type, note_type, text)``: all spans are one figure's (or table's)."""
    kind = typed(F.col("tag"), FIGURE_TYPES)
    return spans.select("doc_id", "span_no", kind.alias("type"), F.when(kind == "Note", F.col("tag")).alias("note_type"), "text")


# --- folds --------------------------------------------------------------------------------------------------------

PARTS = "doc_id {kind}, name_no INT, part_no INT, type STRING, note_type STRING, text STRING, value STRING"


class _Names:
    """Splits labelled parts into names. A name ends before a marker that follows a comma, before a title, forename or
    surname it already has, and before any part after its closing markers."""

    def __init__(self):
        self.done, self.parts, self.labels, self.tail = [], None, set(), False

    def close(self) -> None:
        if self.parts is not None:
            self.done.append(self.parts)
        self.parts, self.labels, self.tail = None, set(), False

    def mark(self, text: str, after_comma: bool) -> None:
        markers = [("Note" if p == "," or p.isspace() else "Marker", "marker_delimiter" if p == "," or p.isspace() else None, p) for p in re.findall(r"\d|\D", text)]
        markers = [(k, n, t) for k, n, t in _joined_digits(markers)]
        if self.parts is not None and self.labels and not self.tail and after_comma:
            self.close()
        fresh = self.parts is None
        self.parts = [*(self.parts or []), *markers]
        self.tail = self.tail or not fresh

    def add(self, tag: str, text: str) -> None:
        kind = NAME_TYPES.get(tag, "Note")
        if self.parts is not None and tag in ("<title>", "<forename>", "<surname>") and tag in self.labels:
            self.close()
        if kind != "Note":
            if self.tail:
                self.close()
            self.labels.add(tag)
        self.parts = [*(self.parts or []), (kind, tag if kind == "Note" else None, text)]


def _joined_digits(parts: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for kind, note, text in parts:
        if text.isdecimal() and out and out[-1][2].isdecimal():
            out[-1] = (kind, note, out[-1][2] + text)
        else:
            out.append((kind, note, text))
    return out


def split_names(parts: list[tuple[str, str]]) -> list[list[tuple]]:
    """Names of ``(tag, text)`` parts, each a list of (type, note type, text, value).

    A name without a surname becomes one note. A given name of two upper-case letters, where it is the only one and no
    middle name is there, is split in two. Values are in title case.
    """
    names, before = _Names(), ""
    for tag, text in parts:
        if tag == "<marker>":
            names.mark(text, before.strip().endswith(","))
        else:
            names.add(tag, text)
        before = text
    names.close()
    out = []
    for name in names.done:
        kinds = [k for k, _, _ in name]
        if "Surname" not in kinds:
            out.append([("Note", "invalid_author_name", " ".join(t for _, _, t in name), None)])
            continue
        given = [t for k, _, t in name if k == "GivenName"]
        split = "MiddleName" not in kinds and len(given) == 1 and len(given[0]) == 2 and given[0].isupper()
        made = []
        for k, n, t in name:
            if k == "GivenName" and split:
                made += [("GivenName", None, t[0], t[0].title()), ("MiddleName", None, t[1], t[1].title())]
            else:
                made.append((k, n, t, t.title() if k in NAME_TYPES.values() else None))
        out.append(made)
    return out


def name_starts(parts: list[tuple[str, str]]) -> list[int]:
    """The places of ``(tag, text)`` parts at which a name begins, as split_names() tells names apart."""
    names, before, out = _Names(), "", []
    for i, (tag, text) in enumerate(parts):
        done = len(names.done)
        if tag == "<marker>":
            names.mark(text, before.strip().endswith(","))
        else:
            names.add(tag, text)
        if i == 0 or len(names.done) > done:
            out.append(i)
        before = text
    return out


def split_affiliations(parts: list[tuple[str, str]]) -> list[list[tuple]]:
    """Affiliations of ``(tag, text)`` parts. A marker opens one, and so does an institution where one is there already.

    Notes before any affiliation stand alone. A country loses its closing dots, which become a note.
    """
    done: list[list[tuple]] = []
    now: list[tuple] | None = None
    for tag, text in parts:
        if tag == "<marker>":
            now = [("Marker", None, text, None)]
            done.append(now)
            continue
        kind = AFFILIATION_TYPES.get(tag, "Note")
        if now is not None and kind == "Institution" and any(k == "Institution" for k, *_ in now):
            now = None
        if now is None:
            if kind == "Note":
                done.append([("Note", tag, text, None)])
                continue
            now = []
            done.append(now)
        kept = text.rstrip(".") if tag == "<country>" and text.strip(".") else text
        now.append((kind, tag if kind == "Note" else None, kept, None))
        if kept != text:
            now.append(("Note", f"{tag}-suffix", text[len(kept):], None))
    return done


def _folded(spans: DataFrame, fold) -> DataFrame:
    kind = spans.schema["doc_id"].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("span_no")
        made = [(key[0], i, j, *part) for i, name in enumerate(fold(list(zip(rows["tag"], rows["text"])))) for j, part in enumerate(name)]
        return pd.DataFrame(made, columns=["doc_id", "name_no", "part_no", "type", "note_type", "text", "value"])

    return spans.select("doc_id", "span_no", "tag", "text").groupBy("doc_id").applyInPandas(run, PARTS.format(kind=kind))


def name_nodes(spans: DataFrame) -> DataFrame:
    """``(doc_id, name_no, part_no, type, note_type, text, value)`` of lists of names."""
    return _folded(spans, split_names)


def affiliation_nodes(spans: DataFrame) -> DataFrame:
    """``(doc_id, name_no, part_no, type, note_type, text, value)`` of affiliations; name_no counts notes that stand alone too."""
    return _folded(spans, split_affiliations)


# --- trees --------------------------------------------------------------------------------------------------------


def children_of_type(nodes: DataFrame, parent: Column, types: list[str]) -> DataFrame:
    """The direct children of a node that have one of the types; nodes ``(doc_id, node_id, parent_id, ordinal, type, ...)``."""
    return nodes.where((F.col("parent_id") == parent) & F.col("type").isin(types))


def outermost_of_type(nodes: DataFrame, types: list[str]) -> DataFrame:
    """Nodes of the types that have no ancestor of these types; nodes carry ``path``, their ancestors' ordinals and their own."""
    found = nodes.where(F.col("type").isin(types))
    above = found.select(F.col("doc_id").alias("d"), F.col("path").alias("p"))
    inside = (F.col("doc_id") == F.col("d")) & (F.size("p") < F.size("path")) & (F.slice("path", F.lit(1), F.size("p")) == F.col("p"))
    return found.join(above, inside, "left_anti")


def text_of(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Texts of nodes in order, joined by single spaces."""
    return nodes.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), " ").alias("text"))


def flat_paragraphs(nodes: DataFrame) -> DataFrame:
    """Fulltext nodes with ``piece_no``: a paragraph's runs of text between its equations, each run and equation a piece."""
    w = Window.partitionBy("doc_id", "section_no", "paragraph_no").orderBy("span_no")
    equation = F.col("equation_no").isNotNull()
    key = F.when(equation, F.concat_ws(":", "run", "equation_no")).otherwise("text")
    out = nodes.where(F.col("paragraph_no").isNotNull()).withColumn("_key", key)
    change = ~F.col("_key").eqNullSafe(F.lag("_key").over(w))
    return out.withColumn("piece_no", F.sum(change.cast("int")).over(w) - 1).drop("_key")
