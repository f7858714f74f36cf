"""Layout sources: text, HTML and ALTO XML as one table of tokens.

``tokens(doc_id, page_no, block_no, line_no, token_no, token_count, line_chars, line_marks, text, whitespace, line_offset,
font, coord)``: a row for each token. ``(line_no, token_no)`` is the order within a document. line_chars and line_marks are
the length and the punctuation of the token's line without white space, found once for each line. With ``colocate`` the documents are dealt out by id before
they are unnested, so every later window or group by document (or document and anything) needs no shuffle of tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

FONT = "STRUCT<font_id: STRING, family: STRING, size: DOUBLE, bold: BOOLEAN, italic: BOOLEAN, subscript: BOOLEAN, superscript: BOOLEAN>"
COORD = "STRUCT<x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE, page: INT>"


def spread(df: DataFrame) -> DataFrame:
    """The rows of a table that comes in fewer partitions than there are cores, dealt out to all of them; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def line_offset() -> Column:
    """The characters of a line before a token, without white space; a running sum in the order that other windows need too."""
    before = Window.partitionBy("doc_id", "line_no").orderBy("token_no").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(F.char_length("text")).over(before), F.lit(0)).cast("long")


def _unnested(lines: DataFrame, keep: list[str], font: Column, tail: str) -> DataFrame:
    """A row for each token of each line; lines has the columns of keep, and text."""
    found = lines.withColumn("spaced", T.spaced_tokens("text")).drop("text")
    joined = F.array_join(F.transform("spaced", T.without_trailing_space), "")
    # What belongs to a line is found before its tokens are unnested.
    found = found.select(*keep, font.alias("font"), "spaced", F.size("spaced").alias("token_count"), F.char_length(joined).alias("line_chars"), T.punctuation_profile(joined).alias("line_marks"))
    out = found.select(*keep, "token_count", "line_chars", "line_marks", "font", F.posexplode(T.split_spaced(F.col("spaced"))).alias("token_no", "token"))
    last = F.col("token_no") == F.col("token_count") - 1
    out = out.select("*", F.col("token.text").alias("text"), F.when(last, F.concat(F.col("token.whitespace"), F.lit(tail))).otherwise(F.col("token.whitespace")).alias("whitespace")).drop("token")
    return out.withColumn("line_offset", line_offset())


def text_layout(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_per_block: int = 5, lines_per_page: int = 40, colocate: bool = False) -> DataFrame:
    """Lines of plain text; blocks and pages hold a fixed number of lines. x is the character offset in the line, y the line of the page."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = base.repartition("doc_id") if colocate else spread(base)
    lines = base.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    lines = lines.withColumn("page_no", (F.floor(F.col("line_no") / lines_per_page) + 1).cast("int")).withColumn("block_no", F.floor(F.col("line_no") / lines_per_block).cast("int"))
    out = _unnested(lines, ["doc_id", "page_no", "block_no", "line_no"], F.lit(None).cast(FONT), "\n")
    coord = F.struct(F.col("line_offset").cast("double").alias("x"), (F.col("line_no") % lines_per_page).cast("double").alias("y"), F.char_length("text").cast("double").alias("w"), F.lit(1.0).alias("h"), F.col("page_no").alias("page"))
    return out.withColumn("coord", coord)


# Tags whose text runs are blocks of an HTML layout, with font size and weight.
HTML_FONTS = {"h1": (20.0, True), "h2": (16.0, True), "h3": (14.0, True), "b": (10.0, True), "p": (10.0, False), "br": (10.0, False), "li": (10.0, False), "td": (10.0, False)}
HTML_RUN = r"<(h1|h2|h3|b|p|br|li|td)(?: [^<>]*)?>([^<]+)"
HTML_HIDDEN = r"(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
HTML_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def html_text(html: Column) -> Column:
    return F.regexp_replace(html, HTML_HIDDEN, "")


def html_layout(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", colocate: bool = False) -> DataFrame:
    """The text runs that follow headings, paragraphs, bold and list tags; each run is a block of one line with its tag's font."""
    base = pages.select(F.col(id_col).alias("doc_id"), html_text(F.col(html_col)).alias("html"))
    base = base.repartition("doc_id") if colocate else base
    runs = F.arrays_zip(F.regexp_extract_all("html", F.lit(HTML_RUN), F.lit(1)).alias("tag"), F.regexp_extract_all("html", F.lit(HTML_RUN), F.lit(2)).alias("text"))
    text = F.col("run.text")
    for entity, char in HTML_ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    lines = base.select("doc_id", F.posexplode(runs).alias("line_no", "run")).select("doc_id", F.lit(1).alias("page_no"), F.col("line_no").alias("block_no"), "line_no", F.col("run.tag").alias("tag"), text.alias("text"))
    size, bold = F.lit(None).cast("double"), F.lit(False)
    for tag, (s, b) in HTML_FONTS.items():
        size, bold = F.when(F.col("tag") == tag, F.lit(s)).otherwise(size), F.when(F.col("tag") == tag, F.lit(b)).otherwise(bold)
    font = F.struct(F.col("tag").alias("font_id"), F.when(F.col("tag").startswith("h"), "heading").otherwise("text").alias("family"), size.alias("size"), bold.alias("bold"),
                    F.lit(False).alias("italic"), F.lit(False).alias("subscript"), F.lit(False).alias("superscript")).cast(FONT)
    out = _unnested(lines.withColumn("font", font), ["doc_id", "page_no", "block_no", "line_no"], F.col("font"), "\n")
    return out.withColumn("coord", F.lit(None).cast(COORD))


def conversation_layout(turns: DataFrame) -> DataFrame:
    """Conversations as documents: a turn is a block, its lines are lines."""
    lines = turns.select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_no"), F.col("turn").cast("int").alias("block_no"), F.posexplode(F.split("text", "\n")).alias("line_in_block", "text"))
    lines = lines.withColumn("line_no", F.col("block_no") * 100_000 + F.col("line_in_block")).drop("line_in_block")
    return _unnested(lines, ["doc_id", "page_no", "block_no", "line_no"], F.lit(None).cast(FONT), "\n").withColumn("coord", F.lit(None).cast(COORD))


_STRING = "STRUCT<_CONTENT: STRING, _HPOS: DOUBLE, _VPOS: DOUBLE, _WIDTH: DOUBLE, _HEIGHT: DOUBLE, _STYLEREFS: STRING>"
_BOX = "_HPOS: DOUBLE, _VPOS: DOUBLE, _WIDTH: DOUBLE, _HEIGHT: DOUBLE"
ALTO = f"""Styles STRUCT<TextStyle: ARRAY<STRUCT<_ID: STRING, _FONTFAMILY: STRING, _FONTSIZE: DOUBLE, _FONTSTYLE: STRING>>>,
Layout STRUCT<Page: ARRAY<STRUCT<_ID: STRING, _PHYSICAL_IMG_NR: INT, _WIDTH: DOUBLE, _HEIGHT: DOUBLE, PrintSpace: STRUCT<
TextBlock: ARRAY<STRUCT<_ID: STRING, TextLine: ARRAY<STRUCT<_ID: STRING, String: ARRAY<{_STRING}>>>>>,
Illustration: ARRAY<STRUCT<_ID: STRING, _TYPE: STRING, _FILEID: STRING, {_BOX}>>>>>>"""


def parsed_alto(files: DataFrame, id_col: str = "doc_id", xml_col: str = "xml") -> DataFrame:
    return files.select(F.col(id_col).alias("doc_id"), F.from_xml(F.col(xml_col), ALTO, {"rowTag": "alto"}).alias("alto"))


def alto_layout(files: DataFrame, id_col: str = "doc_id", xml_col: str = "xml") -> DataFrame:
    """Tokens of ALTO files, with their text styles as fonts. A String is followed by a space if the next one starts behind its end."""
    page = parsed_alto(files, id_col, xml_col).select("doc_id", F.col("alto.Styles.TextStyle").alias("styles"), F.explode("alto.Layout.Page").alias("page"))
    block = page.select("doc_id", "styles", F.col("page._PHYSICAL_IMG_NR").alias("page_no"), F.posexplode("page.PrintSpace.TextBlock").alias("b", "block"))
    line = block.select("doc_id", "styles", "page_no", "b", F.posexplode("block.TextLine").alias("l", "line"))
    line = line.withColumn("block_no", F.col("page_no") * 10_000 + F.col("b")).withColumn("line_no", (F.col("block_no") * 10_000 + F.col("l")).cast("long"))
    joined = F.array_join("line.String._CONTENT", "")
    line = line.select("*", F.char_length(joined).alias("line_chars"), T.punctuation_profile(joined).alias("line_marks"))
    token = line.select("doc_id", "styles", "page_no", "block_no", "line_no", "line_chars", "line_marks", F.col("line.String").alias("strings"), F.posexplode("line.String").alias("token_no", "s"))
    following = F.get("strings", F.col("token_no") + 1)
    style = F.get(F.filter("styles", lambda x: x["_ID"] == F.col("s._STYLEREFS")), F.lit(0))
    has = lambda word: F.coalesce(F.lower(style["_FONTSTYLE"]).contains(word), F.lit(False))
    font = F.struct(style["_ID"].alias("font_id"), style["_FONTFAMILY"].alias("family"), style["_FONTSIZE"].alias("size"), has("bold").alias("bold"), has("italic").alias("italic"), has("subscript").alias("subscript"), has("superscript").alias("superscript")).cast(FONT)
    coord = F.struct(F.col("s._HPOS").alias("x"), F.col("s._VPOS").alias("y"), F.col("s._WIDTH").alias("w"), F.col("s._HEIGHT").alias("h"), F.col("page_no").alias("page")).cast(COORD)
    space = F.when(following.isNull(), "\n").when(following["_HPOS"] > F.col("s._HPOS") + F.col("s._WIDTH"), " ").otherwise("")
    out = token.select("doc_id", "page_no", "block_no", "line_no", F.size("strings").alias("token_count"), "line_chars", "line_marks", font.alias("font"), "token_no", F.col("s._CONTENT").alias("text"), space.alias("whitespace"), coord.alias("coord"))
    return out.withColumn("line_offset", line_offset())


def alto_graphics(files: DataFrame, id_col: str = "doc_id", xml_col: str = "xml") -> DataFrame:
    """``(doc_id, graphic_no, graphic_type, path, coord, page)``: the illustrations of ALTO files."""
    page = parsed_alto(files, id_col, xml_col).select("doc_id", F.explode("alto.Layout.Page").alias("page"))
    each = page.select("doc_id", F.col("page._PHYSICAL_IMG_NR").alias("page_no"), F.posexplode("page.PrintSpace.Illustration").alias("graphic_no", "g"))
    return each.select("doc_id", "page_no", "graphic_no", F.col("g._TYPE").alias("graphic_type"), F.col("g._FILEID").alias("path"),
                       F.struct(F.col("g._HPOS").alias("x"), F.col("g._VPOS").alias("y"), F.col("g._WIDTH").alias("w"), F.col("g._HEIGHT").alias("h"), F.col("page_no").alias("page")).cast(COORD).alias("coord"))


def alto_pages(files: DataFrame, id_col: str = "doc_id", xml_col: str = "xml") -> DataFrame:
    """``(doc_id, page_no, width, height)``."""
    page = parsed_alto(files, id_col, xml_col).select("doc_id", F.explode("alto.Layout.Page").alias("page"))
    return page.select("doc_id", F.col("page._PHYSICAL_IMG_NR").alias("page_no"), F.col("page._WIDTH").alias("width"), F.col("page._HEIGHT").alias("height"))
