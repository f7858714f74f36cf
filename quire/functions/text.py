"""Text rules as Columns: tokens, normalisation, keys, scalar features and small parsers.

Everything here stays in the JVM. White space means Unicode white space, written out as an explicit class, because
Java's ``\\s`` is ASCII only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def hexed(chars: str) -> str:
    """Characters as escapes that both Java and RE2 read inside a class."""
    return "".join(rf"\x{{{ord(c):X}}}" for c in chars)


# Unicode white space.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# Characters that are tokens of their own.
DELIMITERS = "([•*,:;?.!/#)-−–‐\"“”‘’'`$]♦♥♣♠@†‡§¶⁋ǂ"
# Characters that a line's punctuation profile keeps.
PROFILE = "(（[•*,:;?.!/)）-−–‐«»„\"“”‘’'`$#@]♦♥♣♠"
# Single characters and their plain forms.
PLAIN_FORMS = {
    "`": "'", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st",
    "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-",
    "“": '"', "”": '"', "„": '"', "‟": '"', "’": "'", "‘": "'",
    "•": "•", "‣": "•", "⁃": "•", "⁌": "•", "⁍": "•", "∙": "•", "◉": "•", "◘": "•", "◦": "•",
    "☙": "•", "❥": "•", "❧": "•", "⦾": "•", "⦿": "•", "∗": "*",
}
# Punctuation classes of single-character tokens.
PUNCTUATION = {
    "(": "OPENBRACKET", "[": "OPENBRACKET", ")": "ENDBRACKET", "]": "ENDBRACKET", ".": "DOT", ",": "COMMA",
    "-": "HYPHEN", "–": "HYPHEN", '"': "QUOTE", "'": "QUOTE", "`": "QUOTE", "’": "QUOTE",
}

TOKEN = rf"([^{hexed(DELIMITERS)}{SPACE}]+|[{hexed(DELIMITERS)}])([{SPACE}]*)"
DIGIT = r"\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal_map(values: dict[str, str]) -> Column:
    """A map of literals, as one expression."""
    quoted = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(f"map({', '.join(quoted(x) for kv in values.items() for x in kv)})")


def tokens(text: Column | str) -> Column:
    """The tokens of a text, without white space."""
    return F.regexp_extract_all(_c(text), F.lit(TOKEN), F.lit(1))


def spaced_tokens(text: Column | str) -> Column:
    """The tokens of a text, each with the white space after it; one pass over the text."""
    return F.regexp_extract_all(_c(text), F.lit(TOKEN), F.lit(0))


def without_trailing_space(spaced: Column) -> Column:
    return F.rtrim(spaced, F.lit(SPACES))


def tokenized(text: Column | str) -> Column:
    """An array of ``struct<text, whitespace>``."""
    return split_spaced(spaced_tokens(text))


def split_spaced(spaced: Column) -> Column:
    """The same from spaced_tokens()."""
    return F.transform(spaced, lambda s: F.struct(without_trailing_space(s).alias("text"), F.substring(s, F.char_length(without_trailing_space(s)) + 1, F.char_length(s)).alias("whitespace")))


def plain_characters(text: Column | str) -> Column:
    """Ligatures, dashes, quotes and bullets in their plain forms."""
    single = {k: v for k, v in PLAIN_FORMS.items() if len(v) == 1}
    out = F.translate(_c(text), "".join(single), "".join(single.values()))
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), [kv for kv in PLAIN_FORMS.items() if len(kv[1]) > 1], out)


def normalized(text: Column | str) -> Column:
    """Plain characters, no white space around newlines, other runs of it as one space."""
    joined = F.regexp_replace(plain_characters(text), rf"[{SPACE}]*\n[{SPACE}]*", "\n")
    return F.regexp_replace(joined, rf"[{SPACE}]{{2,}}", " ")


def without_space(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), rf"[{SPACE}]", "")


def stripped(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), rf"^[{SPACE}]+|[{SPACE}]+$", "")


def comma_separated(text: Column | str, separator: str = ",") -> Column:
    """The parts of a list in text, stripped; an empty text has none."""
    parts = F.transform(F.split(_c(text), separator), stripped)
    return F.when(stripped(text) == "", F.array().cast("array<string>")).otherwise(parts)


# --- keys ---------------------------------------------------------------------------------------------------------


def key_text(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]", "")


def prefix_key(text: Column | str, length: int = 1) -> Column:
    """The key of a text whose words are cut to ``length`` characters unless they have a digit."""
    part = lambda w: key_text(F.when(w.rlike("[0-9]"), w).otherwise(F.left(w, F.lit(length))))
    return F.array_join(F.transform(F.split(_c(text), rf"[{SPACE}]"), part), "")


def key_tokens(text: Column | str) -> Column:
    """Each token's key; that of punctuation is empty."""
    return F.transform(tokens(text), key_text)


# --- scalar features ----------------------------------------------------------------------------------------------


def flag(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit(False)), "1").otherwise("0")


def digit_status(token: Column | str, contains: str = "CONTAINSDIGITS") -> Column:
    t = _c(token)
    return F.when(t.rlike(rf"^[{DIGIT}]+$"), "ALLDIGIT").when(t.rlike(rf"[{DIGIT}]"), contains).otherwise("NODIGIT")


def caps_status(token: Column | str, all_caps: str = "ALLCAP") -> Column:
    t = _c(token)
    return (F.when((t == "") | t.rlike(rf"^[{DIGIT}]+$"), "NOCAPS").when(~t.rlike(r"[\p{Ll}\x{AA}\x{BA}]"), all_caps)
            .when(t.rlike(r"^\p{Lu}"), "INITCAP").otherwise("NOCAPS"))


def punctuation_type(token: Column | str) -> Column:
    t = _c(token)
    known = F.element_at(literal_map(PUNCTUATION), t)
    return F.coalesce(known, F.when(t.rlike("^[,:;?.]+$"), "PUNCT").otherwise("NOPUNCT"))


def punctuation_profile(text: Column | str) -> Column:
    """The punctuation of a text, in order."""
    return F.regexp_replace(_c(text), f"[^{hexed(PROFILE)}]", "")


def word_shape(token: Column | str) -> Column:
    """Letters and digits by class: the first, the middle with runs shortened, the last two."""
    t = F.regexp_replace(_c(token), r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]", "x")
    t = F.regexp_replace(F.regexp_replace(t, r"\p{Lu}", "X"), rf"[{DIGIT}]", "d")
    n = F.char_length(t)
    middle = F.when(n > 3, F.substring(t, F.lit(2), n - 3)).otherwise("")
    last = F.when(n > 2, F.right(t, F.lit(2))).when(n == 2, F.right(t, F.lit(1))).otherwise("")
    return F.concat(F.left(t, F.lit(1)), F.regexp_replace(middle, r"(.)\1+", "$1"), last)


def scaled(position: Column, total: Column, bins: int) -> Column:
    """A position within a total as a bin number from 0 to ``bins``."""
    return (F.when(position >= total, F.lit(bins)).when(position <= 0, F.lit(0))
            .otherwise(F.floor(position / total * bins))).cast("int")


def letters_pattern(text: Column | str) -> Column:
    return F.lower(F.regexp_replace(_c(text), "[^a-zA-Z ]", ""))


def as_one_word(text: Column | str) -> Column:
    """A line as one feature value: stripped, spaces and tabs made non-breaking."""
    return F.translate(stripped(text), " \t", "  ")


# --- parsers ------------------------------------------------------------------------------------------------------

# Forms of identifiers, headings and the word before an abstract.
DOI = r"\b(10\.[0-9]{4,}(?:\.[0-9]+)*/.+)"
PMCID = r"PMC([0-9]+)"
ARXIV_NEW = r"arXiv(?:\.org)?:([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)"
ARXIV_OLD = r"arXiv(?:\.org)?:([a-zA-Z.\-]*/[0-9]{7}(?:v[0-9]+)?)"
PMID = r"^(?:PMID|PubMed(?:ID)?):?([0-9]{1,8})"
PII = r"\b([S,B]\W*(?:[0-9xX]\W*){15,}[0-9xX])"
HEADING = r"^([0-9]+\.?(?:[0-9]+\.?)*)[ \t\n\r\f]*([^0-9].*)"
ABSTRACT = r"^(?:(?:abstract|summary|résumé|abrégé|a b s t r a c t)[.:]?)?[ \t\n\r\f]*(.*)"


# A word boundary as RE2 sees it; Java's own takes letters of all scripts for parts of words.
BOUNDARY = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    pattern = pattern.replace(r"\b", BOUNDARY)
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def page_range(text: Column | str) -> Column:
    """``struct<from_page, to_page>`` of ``a-b``; a shorter b is completed with a's first digits."""
    parts = F.transform(F.split(_c(text), "-"), stripped)
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    shorter = (F.char_length(b) > 0) & (F.char_length(b) < F.char_length(a))
    whole = F.when(shorter, F.concat(F.left(a, F.char_length(a) - F.char_length(b)), b)).otherwise(b)
    two = F.size(parts) == 2
    return F.struct(F.when(two, a).alias("from_page"), F.when(two, whole).alias("to_page"))


def external_id(text: Column | str) -> Column:
    """``struct<type, value>``: the first of DOI, PMCID, arXiv, PMID (at the start only) and PII; else the bare text."""
    v = without_space(text)
    named = lambda kind, value: F.when(value.isNotNull(), F.struct(F.lit(kind).alias("type"), value.alias("value")))
    return F.coalesce(
        named("DOI", _found(v, DOI)), named("PMCID", F.concat(F.lit("PMC"), _found(v, PMCID))),
        named("ARXIV", F.coalesce(_found(v, ARXIV_NEW), _found(v, ARXIV_OLD))), named("PMID", _found(v, PMID)), named("PII", _found(v, PII)),
        F.struct(F.lit(None).cast("string").alias("type"), v.alias("value")))


def web_link(text: Column | str) -> Column:
    """``struct<type, value>``: a DOI if there is one, else the URL."""
    v = without_space(text)
    doi = _found(v, DOI)
    return F.struct(F.when(doi.isNotNull(), "DOI").otherwise("URL").alias("type"), F.coalesce(doi, v).alias("value"))


def year(text: Column | str) -> Column:
    return F.expr("int(null)") if text is None else F.regexp_extract(without_space(text), "([0-9]{4})", 1).try_cast("int")


def heading_parts(text: Column | str) -> Column:
    """``struct<label, title>`` of a heading; the label is null without a leading number."""
    t = _c(text)
    return F.struct(_found(t, HEADING).alias("label"), F.coalesce(_found(t, HEADING, 2), t).alias("title"))


def without_abstract_word(text: Column | str) -> Column:
    return F.regexp_extract(_c(text), "(?iu)" + ABSTRACT, 1)


def title_case(text: Column | str) -> Column:
    """Each run of letters with its first letter upper and the rest lower."""
    runs = F.regexp_extract_all(_c(text), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, 2, 2**30)))), "")


def marker_parts(text: Column | str) -> Column:
    """Numbers and single other characters of a marker: ``array<struct<text, kind>>``; commas and spaces delimit."""
    parts = F.regexp_extract_all(_c(text), F.lit("[0-9]+|[^0-9]"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(p.alias("text"), F.when((p == ",") | p.rlike(rf"^[{SPACE}]$"), "marker_delimiter").otherwise("marker").alias("kind")))


def initials(text: Column | str) -> Column:
    """``struct<given, middle>``: two upper-case letters are split, anything else is a given name."""
    t = _c(text)
    two = (F.char_length(t) == 2) & t.rlike(r"\p{Lu}") & ~t.rlike(r"\p{Ll}")
    return F.struct(F.when(two, F.left(t, F.lit(1))).otherwise(t).alias("given"), F.when(two, F.right(t, F.lit(1))).alias("middle"))


def date_parts(date: Column | str) -> Column:
    """``struct<year, month, day>`` of an ISO date or the part of one that is there."""
    parts = F.split(_c(date), "-", 3)
    return F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("year", "month", "day"))])


def tag_expression(text: Column | str) -> Column:
    """``struct<tag, attribute, value>`` of ``tag[@attribute="value"]``."""
    pattern = r'^([^\[]+)(?:\[@?([^=]+)="(.+)"\])?$'
    part = lambda g: F.nullif(F.regexp_extract(_c(text), pattern, g), F.lit(""))
    return F.struct(part(1).alias("tag"), part(2).alias("attribute"), part(3).alias("value"))


# --- labels -------------------------------------------------------------------------------------------------------


def without_prefix(label: Column | str) -> Column:
    return F.regexp_replace(_c(label), "^[BI]-", "")


def split_label(label: Column | str) -> Column:
    """``struct<prefix, tag>``, split at the first hyphen."""
    x = _c(label)
    at = F.instr(x, "-")
    return F.struct(F.when(at > 0, F.left(x, at - 1)).otherwise("").alias("prefix"), F.when(at > 0, F.substring(x, at + 1, F.lit(2**30))).otherwise(x).alias("tag"))


def crf_label(label: Column | str) -> Column:
    """An IOB label in the form of CRF training files: begin as ``I-``, inside bare, outside ``<other>``."""
    x = _c(label)
    return F.when(x == "O", "<other>").when(x.startswith("B-"), F.concat(F.lit("I-"), F.substring(x, 3, 2**30))).when(x.startswith("I-"), F.substring(x, 3, 2**30)).otherwise(x)


def note_type(label: Column | str) -> Column:
    return F.btrim(_c(label), F.lit("<>"))


# --- XML ----------------------------------------------------------------------------------------------------------


def escaped(text: Column | str) -> Column:
    out = _c(text)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def escaped_attribute(text: Column | str) -> Column:
    return F.replace(escaped(text), F.lit('"'), F.lit("&quot;"))


def xml_text(xml: Column | str) -> Column:
    """The text content of an XML fragment."""
    return F.array_join(F.xpath(_c(xml), F.lit("//text()")), "")


def changed_extension(path: Column | str, old: str, new: str) -> Column:
    """A path with another extension, a trailing .gz left out of account."""
    return F.concat(F.regexp_replace(F.regexp_replace(_c(path), r"\.gz$", ""), rf"{old.replace('.', chr(92) + '.')}$", ""), F.lit(new))
