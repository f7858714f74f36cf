"""TEI documents as JATS articles."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tei import NAMESPACE

_ID = "{http://www.w3.org/XML/1998/namespace}id"
_LINK = "{http://www.w3.org/1999/xlink}href"
ET.register_namespace("xlink", "http://www.w3.org/1999/xlink")


@dataclass(frozen=True)
class JatsOptions:
    """acknowledgements: ack or body; annex: back, body or app. strict: what does not fit the published stylesheet's paths
    (a flat acknowledgement, identifiers in analytic) is left out, as that does."""

    parameters: bool = False
    bold: bool = False
    italic: bool = False
    empty_graphics: bool = True
    acknowledgements: str = "ack"
    annex: str = "back"
    strict: bool = False


@cache
def _in_namespace(path: str) -> str:
    return "/".join(re.sub(r"^([a-zA-Z]+)", rf"{{{NAMESPACE}}}\1", s) for s in path.split("/"))


class _Article:
    def __init__(self, tei: ET.Element, options: JatsOptions):
        self.tei, self.o = tei, options

    def all(self, at: ET.Element, path: str) -> list[ET.Element]:
        return at.findall(_in_namespace(path))

    def one(self, at: ET.Element, path: str) -> str | None:
        found = self.all(at, path)
        return "".join(found[0].itertext()) if found else None

    @staticmethod
    def add(parent: ET.Element, tag: str, text: str | None = None, **attributes: str) -> ET.Element:
        child = ET.SubElement(parent, tag, {k.replace("_", "-"): v for k, v in attributes.items()})
        child.text = text
        return child

    def optional(self, parent: ET.Element, tag: str, at: ET.Element, path: str, **attributes: str) -> None:
        text = self.one(at, path)
        if text is not None:
            self.add(parent, tag, text, **attributes)

    # Mixed content ------------------------------------------------------------------------------------------------

    def text(self, to: ET.Element, text: str | None) -> None:
        if text:
            if len(to):
                to[-1].tail = (to[-1].tail or "") + text
            else:
                to.text = (to.text or "") + text

    def mixed(self, to: ET.Element, source: ET.Element) -> None:
        self.text(to, source.text)
        for child in source:
            name = child.tag.split("}")[-1]
            if name == "ref":
                self.reference_link(to, child)
            elif name == "hi" and (child.get("rend") == "bold" and self.o.bold or child.get("rend") == "italic" and self.o.italic):
                self.mixed(self.add(to, "b" if child.get("rend") == "bold" else "i"), child)
            else:
                self.mixed(to, child)
            self.text(to, child.tail)

    def reference_link(self, to: ET.Element, ref: ET.Element) -> None:
        kind = {"bibr": "bibr", "figure": "fig", "table": "table"}.get(ref.get("type", ""))
        whole = "".join(ref.itertext())
        if kind and ref.get("target") is not None:
            self.add(to, "xref", whole, ref_type=kind, rid=ref.get("target").partition("#")[2])
        else:
            self.text(to, whole)

    # Blocks -------------------------------------------------------------------------------------------------------

    def section(self, to: ET.Element, div: ET.Element) -> None:
        sec = self.add(to, "sec")
        for head in self.all(div, "head"):
            self.mixed(self.add(sec, "title"), head)
        for p in self.all(div, "p"):
            self.mixed(self.add(sec, "p"), p)

    def figure(self, to: ET.Element, figure: ET.Element) -> None:
        table, ident = figure.get("type") == "table", figure.get(_ID, "")
        made = self.add(to, "table-wrap" if table else "fig", id=ident)
        if not table:
            self.add(made, "object-id", ident)
        self.add(made, "label", self.one(figure, "head") or "")
        caption = self.add(made, "caption")
        for head in self.all(figure, "head"):
            self.mixed(self.add(caption, "title"), head)
        p = self.add(caption, "p")
        for description in self.all(figure, "figDesc"):
            self.mixed(p, description)
        if table:
            cell = self.add(self.add(self.add(self.add(made, "table"), "tbody"), "tr"), "td")
            cell.text = self.one(figure, "table") or ""
            return
        graphics = self.all(figure, "graphic")
        for graphic in graphics:
            self.add(made, "graphic", **({_LINK: graphic.get("url")} if graphic.get("url") else {}))
        if not graphics and self.o.empty_graphics:
            self.add(made, "graphic")

    def figures(self, to: ET.Element, parent: ET.Element, ident: str, title: str) -> None:
        if found := self.all(parent, "figure"):
            sec = self.add(to, "sec", id=ident)
            self.add(sec, "title", title)
            for figure in found:
                self.figure(sec, figure)

    def name(self, to: ET.Element, person: ET.Element) -> None:
        name = self.add(to, "name")
        self.add(name, "surname", self.one(person, "surname") or "")
        self.add(name, "given-names", " ".join("".join(f.itertext()) for f in self.all(person, "forename")))

    def reference(self, to: ET.Element, bibl: ET.Element) -> None:
        ref = self.add(to, "ref", id=bibl.get(_ID, ""))
        cite = self.add(ref, "element-citation", publication_type="journal")
        title = self.one(bibl, "analytic/title[@type='main']")
        title = self.one(bibl, "monogr/title[@type='main']") if title is None else title
        if title is not None:
            self.add(cite, "article-title", title)
        self.optional(cite, "source", bibl, "monogr/title[@level='j']")
        if dates := self.all(bibl, "monogr/imprint/date[@type='published']"):
            for tag, value in zip(("year", "month", "day"), (dates[0].get("when") or "").split("-", 2)):
                self.add(cite, tag, value)
        self.optional(cite, "volume", bibl, "monogr/imprint/biblScope[@unit='volume']")
        self.optional(cite, "issue", bibl, "monogr/imprint/biblScope[@unit='issue']")
        if pages := self.all(bibl, "monogr/imprint/biblScope[@unit='page']"):
            bounds = [(t, pages[0].get(a)) for t, a in (("fpage", "from"), ("lpage", "to"))]
            if not any(p.get("from") or p.get("to") for p in pages):
                whole = "".join(pages[0].itertext())
                bounds = [("fpage", whole), ("lpage", whole)] if whole else []
            for tag, value in bounds:
                if value is not None:
                    self.add(cite, tag, value)
        doi = self.one(bibl, "monogr/idno[@type='doi']")
        if doi is None and not self.o.strict:
            doi = self.one(bibl, "analytic/idno[@type='DOI']")
        if doi is not None:
            self.add(cite, "pub-id", doi, pub_id_type="doi")
        for level in ("analytic", "monogr"):
            if people := self.all(bibl, f"{level}/author/persName"):
                group = self.add(cite, "person-group", person_group_type="author")
                for person in people:
                    self.name(group, person)

    # Document -----------------------------------------------------------------------------------------------------

    def front(self, to: ET.Element) -> None:
        for header in self.all(self.tei, "teiHeader"):
            source = "fileDesc/sourceDesc/biblStruct"
            journal = self.one(header, f"{source}/monogr/title")
            if journal is not None:
                self.add(self.add(self.add(to, "journal-meta"), "journal-title-group"), "journal-title", journal)
            meta = self.add(to, "article-meta")
            title = self.add(self.add(meta, "title-group"), "article-title")
            for found in self.all(header, "fileDesc/titleStmt/title"):
                self.mixed(title, found)
            authors = self.all(header, f"{source}/analytic/author")
            if authors:
                group = self.add(meta, "contrib-group", content_type="author")
                for author in authors:
                    contrib = self.add(group, "contrib", contrib_type="person")
                    for person in self.all(author, "persName"):
                        self.name(contrib, person)
                    self.optional(contrib, "email", author, "email")
                    if affiliations := self.all(author, "affiliation"):
                        self.add(contrib, "xref", ref_type="aff", rid=affiliations[0].get("key", ""))
            for affiliation in (a for author in authors for a in self.all(author, "affiliation")):
                aff = self.add(meta, "aff", id=affiliation.get("key", ""))
                for kind, content in (("institution", "orgname"), ("department", "orgdiv1"), ("laboratory", "orgdiv2")):
                    self.optional(aff, "institution", affiliation, f"orgName[@type='{kind}']", content_type=content)
                self.optional(aff, "city", affiliation, "address/settlement")
                self.optional(aff, "country", affiliation, "address/country")
            abstract = self.add(meta, "abstract")
            for found in self.all(header, "profileDesc/abstract"):
                if paragraphs := self.all(found, "p"):
                    for p in paragraphs:
                        self.mixed(self.add(abstract, "p"), p)
                else:
                    self.mixed(abstract, found)
            if self.o.parameters:
                custom = self.add(meta, "custom-meta-group")
                for name, value in (("acknowledgement_target", self.o.acknowledgements), ("annex_target", self.o.annex)):
                    item = self.add(custom, "custom-meta")
                    self.add(item, "meta-name", f"xslt-param-{name}")
                    self.add(item, "meta-value", value)

    def acknowledgements(self, to: ET.Element, back: ET.Element) -> None:
        for div in self.all(back, "div[@type='acknowledgement']"):
            nested = self.all(div, "div")
            for part in nested or ([] if self.o.strict else [div]):
                self.section(to, part)

    def annexes(self, to: ET.Element, back: ET.Element) -> None:
        for annex in self.all(back, "div[@type='annex']"):
            for div in self.all(annex, "div"):
                self.section(to, div)
            self.figures(to, annex, "annex_figures", "Annex Figures")

    def build(self) -> ET.Element:
        article = ET.Element("article", {"article-type": "research-article"})
        self.front(self.add(article, "front"))
        body, rear = self.add(article, "body"), self.add(article, "back")
        backs = self.all(self.tei, "text/back")
        for text in self.all(self.tei, "text/body"):
            for div in self.all(text, "div"):
                self.section(body, div)
            self.figures(body, text, "figures", "Figures")
        for back in backs:
            if self.o.acknowledgements == "body":
                self.acknowledgements(body, back)
            if self.o.annex == "body":
                self.annexes(body, back)
            if self.o.acknowledgements == "ack" and self.all(back, "div[@type='acknowledgement']"):
                self.acknowledgements(self.add(rear, "ack"), back)
            if self.o.annex == "back":
                self.annexes(rear, back)
            for bibl in self.all(back, "div/listBibl"):
                if references := self.all(bibl, "biblStruct"):
                    listed = self.add(rear, "ref-list", id="ref-list-1")
                    for reference in references:
                        self.reference(listed, reference)
            if self.o.annex == "app" and (annexes := self.all(back, "div[@type='annex']")):
                app = self.add(self.add(rear, "app-group"), "app", id="appendix-1")
                self.add(app, "title", "Appendix 1")
                for annex in annexes:
                    for div in self.all(annex, "div"):
                        self.section(app, div)
                for annex in annexes:
                    for figure in self.all(annex, "figure"):
                        self.figure(app, figure)
        return article


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _write(at: ET.Element, out: list[str]) -> None:
    tag, start = at.tag, at.tag
    if at.attrib:
        for k, v in at.attrib.items():
            start += f' {k}="{_escaped(v).replace(chr(34), "&quot;").replace(chr(13), "&#13;").replace(chr(10), "&#10;").replace(chr(9), "&#09;")}"'
    if at.text or len(at):
        out.append(f"<{start}>")
        if at.text:
            out.append(_escaped(at.text))
        for child in at:
            _write(child, out)
        out.append(f"</{tag}>")
    else:
        out.append(f"<{start} />")
    if at.tail:
        out.append(_escaped(at.tail))


def written(root: ET.Element) -> str:
    """What ``ET.tostring`` gives, faster where no name needs a namespace."""
    if any(_LINK in x.attrib for x in root.iter("graphic")):
        return ET.tostring(root, encoding="unicode")
    out: list[str] = []
    _write(root, out)
    return "".join(out)


def article(tei: str | None, options: JatsOptions = JatsOptions()) -> str | None:
    """The JATS article of a TEI document."""
    return None if tei is None else written(_Article(ET.fromstring(tei), options).build())


def jats(documents: DataFrame, options: JatsOptions = JatsOptions(), tei_col: str = "tei") -> DataFrame:
    """``documents`` with a column jats, made from the TEI of each row."""
    from pyspark.sql.functions import arrow_udf

    make = arrow_udf(lambda x: pa.array([article(t.as_py(), options) for t in x], pa.string()), "string")
    return documents.withColumn("jats", make(F.col(tei_col)))
