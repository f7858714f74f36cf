"""Token and line features, and the feature lines of each model.

All windows are by document (or document and block or line), ordered by line and token, so documents that were dealt
out by id when they were read need one sort and no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def doc_order():
    """A document's tokens in order."""
    return Window.partitionBy("doc_id").orderBy("line_no", "token_no")


def whole_document():
    return Window.partitionBy("doc_id")


# The order of the features in each model's lines. A number in brackets is a length, quotes are constants.
_LEXICAL = ["token_text", "lower_text", "prefix_1", "prefix_2", "prefix_3", "prefix_4", "suffix_1", "suffix_2", "suffix_3", "suffix_4"]
MODEL_FEATURES = {
    "affiliation_address": [*_LEXICAL, "'LINEEND'", "caps_allcaps", "digit_containdigit", "single_char", "'0'", "'0'", "is_first_name", "'0'", "is_country", "punctuation", "word_shape", "'0'"],
    "citation": [*_LEXICAL, "line_status_end", "caps", "digit", "single_char", "'0'", "'0'", "is_first_name", "is_last_name", "'0'", "'0'", "'0'", "'0'", "'0'", "'0'", "'0'", "'0'", "'0'", "punctuation", "sentence_position", "'0'"],
    "fulltext": [*_LEXICAL, "block_status_start", "line_status_start", "alignment", "font_status", "font_size_status", "bold", "italic", "caps", "digit", "single_char", "punctuation", "'0'", "'0'", "'0'", "'UNKNOWN'", "'0'", "superscript"],
    "header": [*_LEXICAL, "block_status_end", "line_status_end", "alignment", "font_status", "font_size_status", "bold", "italic", "caps", "digit", "single_char", "'0'", "'0'", "'0'", "'0'", "'0'", "'0'", "'0'", "punctuation", "largest_font", "'0'", "'1'", "'0'"],
    "name": [*_LEXICAL, "line_status_end", "caps", "digit", "single_char", "'0'", "is_first_name", "is_last_name", "'0'", "'0'", "punctuation", "'0'"],
    "reference_segmenter": [*_LEXICAL, "line_status_end", "alignment", "caps", "digit", "single_char", "'0'", "'0'", "is_first_name", "'0'", "'0'", "'0'", "'0'", "line_profile", "line_position", "line_length", "block_status_end", "line_profile_length", "'0'"],
}
MODEL_FEATURES |= {"figure": MODEL_FEATURES["fulltext"], "table": MODEL_FEATURES["fulltext"]}
SEGMENTATION_FEATURES = ["token_text", "second_text", "lower_text", "prefix_1", "prefix_2", "prefix_3", "prefix_4", "block_status", "page_status", "font_status", "font_size_status", "bold", "italic", "caps", "digit", "single_char",
                         "'0'", "'0'", "'0'", "'0'", "'0'", "'0'", "'0'", "document_position", "'0'", "line_profile", "line_profile_length", "block_line_length", "'0'", "'0'", "repetitive", "first_repetitive", "'1'", "whole_line"]


def lexical(df: DataFrame, token: str = "text") -> DataFrame:
    """Features of a token's text alone."""
    t = F.col(token)
    return df.withColumns({
        "token_text": t, "lower_text": F.lower(t),
        **{f"prefix_{n}": F.left(t, F.lit(n)) for n in range(1, 5)}, **{f"suffix_{n}": F.right(t, F.lit(n)) for n in range(1, 5)},
        "single_char": T.flag(F.char_length(t) == 1), "digit": T.digit_status(t), "digit_containdigit": T.digit_status(t, "CONTAINDIGIT"),
        "caps": T.caps_status(t), "caps_allcaps": T.caps_status(t, "ALLCAPS"), "punctuation": T.punctuation_type(t), "word_shape": T.word_shape(t),
    })


def line_status(index: Column, count: Column, single: str) -> Column:
    """LINESTART, LINEIN or LINEEND; ``single`` is what a line of one token is."""
    first, last = (index == 0, "LINESTART"), (index == count - 1, "LINEEND")
    order = (first, last) if single == "LINESTART" else (last, first)
    return F.when(*order[0]).when(*order[1]).otherwise("LINEIN")


def block_status(line_index: Column, line_count: Column, status: Column, single: str) -> Column:
    first = ((line_index == 0) & (status == "LINESTART"), "BLOCKSTART")
    last = ((line_index == line_count - 1) & (status == "LINEEND"), "BLOCKEND")
    order = (first, last) if single == "BLOCKSTART" else (last, first)
    return F.when(*order[0]).when(*order[1]).otherwise("BLOCKIN")


def with_line_index(df: DataFrame) -> DataFrame:
    """``line_index`` and ``line_count`` of each line in its block."""
    block = Window.partitionBy("doc_id", "block_no")
    ranked = df.withColumn("line_index", F.dense_rank().over(block.orderBy("line_no")) - 1)
    return ranked.withColumn("line_count", F.max("line_index").over(block) + 1)


def status(df: DataFrame) -> DataFrame:
    """Line and block status, for either treatment of single tokens."""
    i, n = F.col("token_no"), F.col("token_count")
    out = with_line_index(df).withColumns({"line_status_end": line_status(i, n, "LINEEND"), "line_status_start": line_status(i, n, "LINESTART")})
    at = F.col("line_index"), F.col("line_count")
    return out.withColumns({"block_status_end": block_status(*at, F.col("line_status_end"), "BLOCKEND"), "block_status_start": block_status(*at, F.col("line_status_start"), "BLOCKSTART")})


def fonts(df: DataFrame) -> DataFrame:
    """Changes of font against the token before, and relative sizes in the document."""
    family, size = F.col("font.family"), F.col("font.size")
    first = F.row_number().over(doc_order()) == 1
    old = F.lag(size).over(doc_order())
    real = F.when(size != 0, size)
    unknown = first | old.isNull() | size.isNull() | (old == 0) | (size == 0)
    return df.withColumns({
        "font_status": F.when(~first & F.lag(family).over(doc_order()).eqNullSafe(family), "SAMEFONT").otherwise("NEWFONT"),
        "font_size_status": F.when(unknown | (old < size), "HIGHERFONT").when(old > size, "LOWERFONT").otherwise("SAMEFONTSIZE"),
        "largest_font": T.flag(size == F.coalesce(F.max(real).over(whole_document()), F.lit(0.0))),
        "smallest_font": T.flag(size == F.coalesce(F.min(real).over(whole_document()), F.lit(0.0))),
        "above_average_font": T.flag((size != 0) & (size > F.avg(real).over(whole_document()))),
        "bold": T.flag(F.col("font.bold")), "italic": T.flag(F.col("font.italic")), "superscript": T.flag(F.col("font.superscript")),
    })


def alignment(df: DataFrame) -> DataFrame:
    """LINEINDENT or ALIGNEDLEFT: the state flips where a line starts by more than a character's width off the line before."""
    start = (F.col("token_no") == 0) & (F.col("coord.w") != 0) & (F.col("coord.h") != 0) & (F.col("text") != "")
    x = F.when(start, F.col("coord.x"))
    before = F.last(x, ignorenulls=True).over(doc_order().rowsBetween(Window.unboundedPreceding, -1))
    width = F.col("coord.w") / F.char_length("text")
    change = F.when(x - before > width, True).when(before - x > width, False)
    out = df.withColumn("_change", change)
    state = F.coalesce(F.last("_change", ignorenulls=True).over(doc_order().rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    return out.withColumn("alignment", F.when(state, "LINEINDENT").otherwise("ALIGNEDLEFT")).drop("_change")


def positions(df: DataFrame) -> DataFrame:
    """Binned positions in line and document, and the line's punctuation."""
    profile = F.col("line_marks")
    return df.withColumns({
        "document_index": (F.row_number().over(doc_order()) - 1).cast("long"), "document_count": F.count(F.lit(1)).over(whole_document()),
        "line_position": T.scaled(F.col("line_offset"), F.col("line_chars"), 10), "line_length": T.scaled(F.col("line_chars"), F.max("line_chars").over(whole_document()), 10),
        "line_profile": F.when(profile == "", "no").otherwise(profile), "line_profile_length": F.least(F.char_length(profile), F.lit(10)),
    }).withColumn("sentence_position", T.scaled(F.col("document_index"), F.col("document_count"), 12))


def lookups(df: DataFrame, lexicon: DataFrame | None, token: str = "text") -> DataFrame:
    """Flags of the lexicon's kinds (first_name, last_name, country); without a lexicon none is set.

    lexicon: distinct ``(kind, term)``. Spark broadcasts it if its size allows, else joins by term.
    """
    kinds = ("first_name", "last_name", "country")
    if lexicon is None:
        return df.withColumns({f"is_{k}": F.lit("0") for k in kinds})
    terms = lexicon.groupBy("term").agg(*[F.max(F.col("kind") == k).alias(f"_{k}") for k in kinds])
    joined = df.join(terms, F.lower(F.col(token)) == F.col("term"), "left")
    return joined.withColumns({f"is_{k}": T.flag(F.col(f"_{k}")) for k in kinds}).drop("term", *[f"_{k}" for k in kinds])


def token_features(tokens: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """All token features, a column each."""
    return lookups(positions(alignment(fonts(status(lexical(tokens))))), lexicon)


def _line(names: list[str]) -> Column:
    return F.concat_ws(" ", *[F.lit(n[1:-1]) if n[0] == "'" else F.col(n).cast("string") for n in names])


def feature_lines(tokens: DataFrame, model: str, lexicon: DataFrame | None = None) -> DataFrame:
    """``(doc_id, line_no, token_no, data)``: a model's feature line for each token (segmentation: for each line)."""
    if model == "segmentation":
        return segmentation_features(tokens).select("doc_id", "line_no", F.lit(0).alias("token_no"), _line(SEGMENTATION_FEATURES).alias("data"))
    return token_features(tokens, lexicon).select("doc_id", "line_no", "token_no", _line(MODEL_FEATURES[model]).alias("data"))


# --- lines --------------------------------------------------------------------------------------------------------


def lines(tokens: DataFrame) -> DataFrame:
    """``(doc_id, page_no, block_no, line_no, text, n_tokens, length, font, text_whitespace)``: tokens put together."""
    parts = F.array_sort(F.collect_list(F.struct("token_no", "text", "whitespace", "font")))
    grouped = tokens.groupBy("doc_id", "page_no", "block_no", "line_no").agg(parts.alias("parts"))
    last = F.element_at("parts", -1)
    text = F.concat(F.array_join(F.transform(F.slice("parts", F.lit(1), F.size("parts") - 1), lambda p: F.concat(p["text"], p["whitespace"])), ""), last["text"])
    length = F.aggregate("parts", F.lit(0), lambda n, p: n + F.char_length(p["text"]))
    return grouped.select("doc_id", "page_no", "block_no", "line_no", text.alias("text"), F.size("parts").alias("n_tokens"), length.alias("length"), F.get("parts", F.lit(0))["font"].alias("font"), last["whitespace"].alias("text_whitespace"))


def line_order() -> Window:
    return Window.partitionBy("doc_id").orderBy("line_no")


def repetitions(df: DataFrame) -> DataFrame:
    """Lines whose letters recur at the edges of pages: flags ``repetitive`` and ``first_repetitive``.

    Candidates are the first lines of a page's first two and last blocks, with at least eight letters and spaces.
    """
    page = Window.partitionBy("doc_id", "page_no")
    out = df.withColumn("block_index", F.dense_rank().over(page.orderBy("block_no")) - 1).withColumn("block_count", F.max("block_index").over(page) + 1)
    first_line = F.row_number().over(Window.partitionBy("doc_id", "block_no").orderBy("line_no")) == 1
    edge = (F.col("block_index") < 2) | (F.col("block_index") > F.col("block_count") - 2)
    pattern = T.letters_pattern("text")
    out = out.withColumn("pattern", F.when(first_line & edge & (F.char_length(pattern) >= 8), pattern))
    same = Window.partitionBy("doc_id", "pattern")
    again = F.col("pattern").isNotNull() & (F.count(F.lit(1)).over(same) > 1)
    first = F.row_number().over(same.orderBy("line_no")) == 1
    return out.withColumns({"repetitive": T.flag(again), "first_repetitive": T.flag(again & first)})


def segmentation_features(tokens: DataFrame, first_token_of_block: bool = True) -> DataFrame:
    """The segmentation model's features, a row for each line."""
    df = with_line_index(repetitions(lines(tokens)))
    by_block, order = Window.partitionBy("doc_id", "block_no"), line_order()
    words = F.split("text", r"[ \t\f\x{A0}]")
    first, second = T.stripped(F.get(words, F.lit(0))), F.coalesce(F.get(words, F.lit(1)), F.lit(""))
    df = lexical(df.withColumn("first_text", first), "first_text").withColumn("second_text", F.when(second == "", first).otherwise(second))
    token_font = F.first("font").over(by_block.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)) if first_token_of_block else F.col("font")
    df = df.withColumn("token_font", token_font)
    start = F.row_number().over(order) == 1
    size, old = F.col("token_font.size"), F.lag("token_font.size").over(order)
    unknown = start | old.isNull() | size.isNull() | (old == 0) | (size == 0)
    i, n = F.col("line_index"), F.col("line_count")
    profile = T.punctuation_profile("text")
    before = F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumns({
        "block_status": F.when(i == 0, "BLOCKSTART").when(i == n - 1, "BLOCKEND").otherwise("BLOCKIN"),
        "page_status": F.when((F.col("block_index") == 0) & (i == 0), "PAGESTART").when((F.col("block_index") == F.col("block_count") - 1) & (i == n - 1), "PAGEEND").otherwise("PAGEIN"),
        "font_status": F.when(~start & F.lag("token_font.family").over(order).eqNullSafe(F.col("token_font.family")), "SAMEFONT").otherwise("NEWFONT"),
        "font_size_status": F.when(unknown | (old < size), "HIGHERFONT").when(old > size, "LOWERFONT").otherwise("SAMEFONTSIZE"),
        "bold": T.flag(F.col("token_font.bold")), "italic": T.flag(F.col("token_font.italic")),
        "document_position": T.scaled(before, F.sum("n_tokens").over(whole_document()), 12),
        "line_profile": F.when(profile == "", "no").otherwise(profile), "line_profile_length": F.char_length(profile),
        "block_line_length": T.scaled(F.char_length("text"), F.max(F.char_length("text")).over(by_block), 10),
        "whole_line": T.as_one_word("text"),
    })


def summaries(tokens: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, n_lines, n_repetitive_lines, max_line_length)``."""
    return repetitions(lines(tokens)).groupBy("doc_id").agg(
        F.sum("n_tokens").cast("long").alias("n_tokens"), F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.col("repetitive").cast("int")).cast("long").alias("n_repetitive_lines"), F.max("length").cast("long").alias("max_line_length"))
