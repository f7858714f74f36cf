"""TEI as text columns: styled runs, coordinates, elements of nodes, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

NAMESPACE = "http://www.tei-c.org/ns/1.0"

# The elements of simple nodes.
ELEMENTS = {
    "NameTitle": "roleName", "GivenName": 'forename[@type="first"]', "MiddleName": 'forename[@type="middle"]', "Surname": "surname", "NameSuffix": "genName", "RawEditors": "editor",
    "Label": "label", "Marker": 'note[@type="marker"]', "Institution": 'orgName[@type="institution"]', "Department": 'orgName[@type="department"]', "Laboratory": 'orgName[@type="laboratory"]',
    "AddressLine": "addrLine", "PostCode": "postCode", "PostBox": "postBox", "Settlement": "settlement", "Region": "region", "Country": "country", "Journal": 'title[@level="j"]',
    "Volume": 'biblScope[@unit="volume"]', "Issue": 'biblScope[@unit="issue"]', "Publisher": "publisher", "Location": "addrLine", "ExternalUrl": 'ref[@type="url"]',
    "Title": 'title[@level="a"][@type="main"]', "RawReferenceText": 'note[@type="raw_reference"]',
}
# Where a reference's fields stand in it.
PARENTS = {"Title": "analytic", "Author": "analytic", "ExternalIdentifier": "analytic", "RawEditors": "monogr", "Journal": "monogr", "Volume": "monogr/imprint", "Issue": "monogr/imprint",
           "PageRange": "monogr/imprint", "Publisher": "monogr/imprint", "Date": "monogr/imprint", "Location": "monogr/meeting/address"}
CITATIONS = {"ReferenceCitation": "bibr", "FigureCitation": "figure", "TableCitation": "table"}
ADDRESS = ["AddressLine", "PostCode", "PostBox", "Region", "Settlement", "Country"]


def element(tag: str, content: Column, **attributes: Column | str | None) -> Column:
    """An element with escaped attributes around content that is XML already; a null attribute is left out."""
    out = [F.lit(f"<{tag}")]
    for name, value in attributes.items():
        if value is None:
            continue
        value = F.lit(value) if isinstance(value, str) else value
        out.append(F.coalesce(F.concat(F.lit(f' {name.replace("xml_", "xml:").rstrip("_")}="'), T.escaped_attribute(value), F.lit('"')), F.lit("")))
    body = F.coalesce(content, F.lit(""))
    return F.concat(*out, F.when(body == "", "/>").otherwise(F.concat(F.lit(">"), body, F.lit(f"</{tag}>"))))


def _opened(expression: str) -> tuple[str, str]:
    """The name and the inside of the start tag of a tag expression such as ``note[@type="x"]``."""
    tag, *conditions = expression.split("[@")
    return tag, " ".join([tag, *(c.rstrip("]") for c in conditions)])


def simple_element(kind: Column, content: Column) -> Column:
    """The element of a simple node's type around content; null for other types."""
    opened = {k: _opened(e) for k, e in ELEMENTS.items()}
    start = F.element_at(T.literal_map({k: inside for k, (_, inside) in opened.items()}), kind)
    name = F.element_at(T.literal_map({k: tag for k, (tag, _) in opened.items()}), kind)
    return F.concat(F.lit("<"), start, F.when(F.coalesce(content, F.lit("")) == "", "/>").otherwise(F.concat(F.lit(">"), content, F.lit("</"), name, F.lit(">"))))


def styles(font: Column) -> Column:
    """The styles of a font, outermost first."""
    named = [F.when(F.coalesce(font[field], F.lit(False)), F.lit(name)) for field, name in (("bold", "bold"), ("italic", "italic"), ("subscript", "subscript"), ("superscript", "superscript"))]
    return F.array_compact(F.array(*named))


def styled(text: Column, names: Column) -> Column:
    """Escaped text inside nested ``hi`` elements."""
    return F.aggregate(F.reverse(names), T.escaped(text), lambda inner, s: F.concat(F.lit('<hi rend="'), s, F.lit('">'), inner, F.lit("</hi>")))


def styled_runs(tokens: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``(by, xml)``: tokens as XML, those in a row with the same styles in one element, white space between runs outside."""
    w = Window.partitionBy(*by).orderBy(*order)
    df = tokens.withColumn("_styles", F.array_join(styles(F.col("font")), " "))
    change = ~F.col("_styles").eqNullSafe(F.lag("_styles").over(w))
    df = df.withColumn("_run", F.sum(change.cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.struct(*order, "text", "whitespace")))
    runs = df.groupBy(*by, "_run").agg(parts.alias("parts"), F.first("_styles").alias("_styles"))
    last = F.element_at("parts", -1)
    head = F.array_join(F.transform(F.slice("parts", F.lit(1), F.size("parts") - 1), lambda p: F.concat(p["text"], p["whitespace"])), "")
    named = F.filter(F.split("_styles", " "), lambda s: s != "")
    runs = runs.select(*by, "_run", styled(F.concat(head, last["text"]), named).alias("xml"), last["whitespace"].alias("ws"))
    all_ = F.array_sort(F.collect_list(F.struct("_run", "xml", "ws")))
    merged = runs.groupBy(*by).agg(all_.alias("runs"))
    end = F.element_at("runs", -1)
    body = F.array_join(F.transform(F.slice("runs", F.lit(1), F.size("runs") - 1), lambda r: F.concat(r["xml"], r["ws"])), "")
    return merged.select(*by, F.concat(body, end["xml"]).alias("xml"))


def coordinates(boxes: Column) -> Column:
    """``page,x,y,w,h`` of each box, joined by semicolons; null without any."""
    each = F.transform(boxes, lambda b: F.format_string("%d,%.2f,%.2f,%.2f,%.2f", b["page"], b["x"], b["y"], b["w"], b["h"]))
    return F.nullif(F.array_join(each, ";"), F.lit(""))


def note(kind: Column | str, content: Column) -> Column:
    return element("note", content, type_=kind)


def node_element(kind: Column, text: Column, value: Column, note_type: Column, extra: dict[str, Column] | None = None) -> Column:
    """The element of a node without children: by its type, a note for any other.

    extra: columns ``id_type``, ``from_page``, ``to_page``, ``year``, ``published``, ``target`` where nodes have them.
    """
    extra = extra or {}
    none = F.lit(None).cast("string")
    shown = T.escaped(F.coalesce(value, text))
    out = note(F.coalesce(note_type, F.concat(F.lit("other:"), kind)), T.escaped(text))
    out = F.coalesce(simple_element(kind, shown), out)
    target = element("ref", T.escaped(text), type_=F.element_at(T.literal_map(CITATIONS), kind), target=F.concat(F.lit("#"), extra.get("target", none)))
    out = F.when(kind.isin(list(CITATIONS)), target).otherwise(out)
    out = F.when(kind == "ExternalIdentifier", element("idno", shown, type_=extra.get("id_type", none))).otherwise(out)
    pages = element("biblScope", T.escaped(text), unit="page", **{"from_": extra.get("from_page", none), "to": extra.get("to_page", none)})
    out = F.when(kind == "PageRange", pages).otherwise(out)
    date = element("date", T.escaped(text), type_=F.when(extra.get("published", F.lit(False)), "published"), when=extra.get("year", none).cast("string"))
    return F.when(kind == "Date", date).when(kind == "Text", T.escaped(text)).otherwise(out)


def in_order(xml: str | Column, order: list[str], separator: str = "") -> Column:
    """An aggregate: fragments in order."""
    x = F.col(xml) if isinstance(xml, str) else xml
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, x.alias("_xml")))), lambda r: r["_xml"]), separator)


def reference_elements(nodes: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``(by, xml)``: a ``biblStruct`` for each reference; nodes have type, text, value, note_type and the fields of citations.

    A node with a column ``xml`` that is not null is that element. Fields stand in analytic, monogr, monogr/imprint or the meeting's address; the first date is the published one.
    """
    w = Window.partitionBy(*by, "type").orderBy(*order)
    dated = nodes.withColumn("published", (F.col("type") == "Date") & (F.row_number().over(w) == 1))
    extra = {c: F.col(c) for c in ("id_type", "from_page", "to_page", "year", "published") if c in dated.columns}
    xml = node_element(F.col("type"), F.col("text"), F.col("value"), F.col("note_type"), extra)
    xml = F.when(F.col("type") == "Label", note("label", T.escaped("text"))).otherwise(xml)
    xml = F.coalesce(F.col("xml"), xml) if "xml" in dated.columns else xml
    parent = F.coalesce(F.element_at(T.literal_map(PARENTS), F.col("type")), F.lit(""))
    placed = dated.select(*by, *order, parent.alias("_parent"), xml.alias("_xml"))
    part = lambda p: F.array_join(F.transform(F.filter(F.col("parts"), lambda x: x["_parent"] == p), lambda x: x["_xml"]), "")
    grouped = placed.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, "_parent", "_xml"))).alias("parts"))
    optional = lambda tag, content: F.when(content != "", F.concat(F.lit(f"<{tag}>"), content, F.lit(f"</{tag}>"))).otherwise("")
    monogr = F.concat(part("monogr"), optional("imprint", part("monogr/imprint")), optional("meeting", optional("address", part("monogr/meeting/address"))))
    body = F.concat(part(""), optional("analytic", part("analytic")), optional("monogr", monogr))
    ident = F.col("content_id") if "content_id" in by else F.lit(None).cast("string")
    return grouped.select(*by, element("biblStruct", body, xml_id=ident).alias("xml"))


def author_elements(parts: DataFrame, by: list[str], affiliations: DataFrame | None = None) -> DataFrame:
    """``(by, xml)``: an ``author`` for each name, with the affiliations ``(doc_id, marker, ord, xml)`` of its markers."""
    xml = node_element(F.col("type"), F.col("text"), F.col("value"), F.col("note_type"))
    markers = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("part_no", "type", "text"))), lambda p: p["type"] == "Marker"), lambda p: p["text"])
    named = parts.withColumn("_x", xml).groupBy(*by).agg(in_order("_x", ["part_no"]).alias("name"), markers.alias("markers"))
    person = element("persName", F.col("name"))
    if affiliations is None:
        return named.select(*by, element("author", person).alias("xml"))
    each = named.select(*by, F.posexplode("markers").alias("m", "marker")).join(affiliations.withColumnRenamed("xml", "aff"), ["doc_id", "marker"])
    held = each.groupBy(*by).agg(in_order("aff", ["m", "ord"]).alias("affs"))
    return named.join(held, by, "left").select(*by, element("author", F.concat(person, F.coalesce("affs", F.lit("")))).alias("xml"))


def affiliation_elements(parts: DataFrame, by: list[str]) -> DataFrame:
    """``(by, marker, xml)``: an ``affiliation`` for each, with its raw note, organisations and address; key is the column content_id."""
    raw = F.when(F.col("type") == "Marker", F.concat(F.lit("<label>"), T.escaped("text"), F.lit("</label>"))).otherwise(T.escaped("text"))
    xml = node_element(F.col("type"), F.col("text"), F.col("value"), F.col("note_type"))
    df = parts.withColumns({"_raw": raw, "_x": xml, "_address": F.col("type").isin(ADDRESS)})
    grouped = df.groupBy(*by).agg(in_order("_raw", ["part_no"], " ").alias("raw"), in_order(F.when(~F.col("_address"), F.col("_x")).otherwise(""), ["part_no"]).alias("fields"),
                                  in_order(F.when(F.col("_address"), F.col("_x")).otherwise(""), ["part_no"]).alias("address"), F.coalesce(F.first(F.when(F.col("type") == "Marker", F.col("text")), ignorenulls=True), F.lit("")).alias("marker"))
    body = F.concat(note("raw_affiliation", F.col("raw")), F.col("fields"), F.when(F.col("address") != "", F.concat(F.lit("<address>"), F.col("address"), F.lit("</address>"))).otherwise(""))
    return grouped.select(*by, "marker", element("affiliation", body, key=F.col("content_id") if "content_id" in by else None).alias("xml"))


def section_elements(nodes: DataFrame) -> DataFrame:
    """``(doc_id, section_type, section_no, xml)``: a ``div`` for each section: its head, paragraphs, and formulas between their parts.

    nodes as by ``semantic.fulltext_nodes`` and ``flat_paragraphs``; figures and tables are rendered at the level above.
    """
    kind, text = F.col("type"), F.col("text")
    target = F.col("target") if "target" in nodes.columns else F.lit(None).cast("string")
    inline = node_element(kind, text, F.lit(None).cast("string"), F.col("note_type"), {"target": target})
    inline = F.when(kind == "Label", F.concat(F.lit("<label>"), T.escaped("text"), F.lit("</label>"))).when(kind == "RawEquationContent", T.escaped("text")).otherwise(inline)
    pieces = nodes.where(F.col("paragraph_no").isNotNull()).withColumn("_x", inline)
    keys = ["doc_id", "section_type", "section_no"]
    each = pieces.groupBy(*keys, "paragraph_no", "piece_no").agg(in_order("_x", ["span_no"], " ").alias("body"), F.min("span_no").alias("at"), F.max(F.col("equation_no").isNotNull()).alias("formula"))
    each = each.select(*keys, "at", F.when(F.col("formula"), element("formula", F.col("body"))).otherwise(element("p", F.col("body"))).alias("xml"))
    heads = nodes.where(kind == "Heading").select(*keys, F.col("span_no").alias("at"), element("head", T.escaped("text"), n=F.col("label")).alias("xml"))
    notes = nodes.where((kind == "Note") & F.col("paragraph_no").isNull() & F.col("section_no").isNotNull()).select(*keys, F.col("span_no").alias("at"), note(F.col("note_type"), T.escaped("text")).alias("xml"))
    grouped = each.unionByName(heads).unionByName(notes).groupBy(*keys).agg(in_order("xml", ["at"]).alias("body"))
    return grouped.select(*keys, element("div", F.col("body"), type_=F.when(F.col("section_type") == "ACKNOWLEDGEMENT", "acknowledgement")).alias("xml"))


def figure_elements(nodes: DataFrame, by: list[str], table: bool = False) -> DataFrame:
    """``(by, xml)``: a ``figure`` with its label as head and label, its caption and the rest; graphics come as type Graphic."""
    kind, text = F.col("type"), T.escaped("text")
    label = F.concat(element("head", text), element("label", text))
    graphic = element("graphic", F.lit(""), url=F.col("url")) if "url" in nodes.columns else F.lit("<graphic/>")
    xml = F.when(kind == "Label", label).when(kind == "Caption", element("figDesc", text)).when(kind == "Graphic", graphic).otherwise(node_element(kind, F.col("text"), F.lit(None).cast("string"), F.col("note_type")))
    grouped = nodes.withColumn("_x", xml).groupBy(*by).agg(in_order("_x", ["span_no"]).alias("body"))
    return grouped.select(*by, element("figure", F.col("body"), type_="table" if table else None, xml_id=F.col("content_id") if "content_id" in by else None).alias("xml"))


def documents(front: DataFrame, body: DataFrame | None = None, back: DataFrame | None = None) -> DataFrame:
    """``(doc_id, tei)`` from front ``(doc_id, title, abstract, authors, notes)``, body ``(doc_id, body)`` and back ``(doc_id, acknowledgements, annex, references)``.

    All parts are XML already; missing ones are left out.
    """
    df = front
    for more in (body, back):
        df = df.join(more, "doc_id", "left") if more is not None else df
    has = lambda c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
    wrapped = lambda open_, content, close: F.when(content != "", F.concat(F.lit(open_), content, F.lit(close))).otherwise("")
    title = wrapped('<titleStmt><title level="a" type="main">', has("title"), "</title></titleStmt>")
    source = wrapped("<sourceDesc><biblStruct><analytic>", has("authors"), "</analytic></biblStruct></sourceDesc>")
    header = F.concat(F.lit("<teiHeader>"), wrapped("<fileDesc>", F.concat(title, source), "</fileDesc>"), wrapped("<profileDesc><abstract><p>", has("abstract"), "</p></abstract></profileDesc>"), has("notes"), F.lit("</teiHeader>"))
    rear = F.concat(has("acknowledgements"), wrapped('<div type="annex">', has("annex"), "</div>"), wrapped('<div type="references"><listBibl>', has("references"), "</listBibl></div>"))
    text = F.concat(F.lit("<text>"), F.lit("<body>"), has("body"), F.lit("</body>"), wrapped("<back>", rear, "</back>"), F.lit("</text>"))
    return df.select("doc_id", F.concat(F.lit(f'<TEI xmlns="{NAMESPACE}">'), header, text, F.lit("</TEI>")).alias("tei"))


def query(xml: Column, path: str) -> Column:
    """Texts at a path of plain element names, whatever their namespace; ``@`` names an attribute."""
    steps = "".join(f"/{s}" if s.startswith("@") else f"/*[local-name()='{s}']" for s in path.strip("/").split("/"))
    return F.xpath(xml, F.lit("/" + steps if steps.split("/")[-1].startswith("@") else "/" + steps + "//text()"))
