"""Personal data: patterns, and information-theoretic sanitisation of the terms that reveal it.

Patterns find the protected entities (e-mail and IP addresses, card and phone numbers). A term that stands near an
entity can disclose it: how strongly is measured by pointwise mutual information over the corpus,
``PMI(t; e) = ln(p(t, e) / (p(t) p(e)))`` with the shares of documents that hold both, the term and the entity.
The entity's information is ``IC(e) = -ln p(e)``, which PMI cannot exceed; a term whose PMI exceeds the share
``disclosure`` of it exceeds the threshold, and its occurrences near the entity are generalised to a class name.
Terms must be seen near the entity in ``min_contexts`` different contexts, so copies of one passage prove nothing.
Co-occurrence is counted near entities only (``reach`` words on either side), so pairs grow with the entities
found; document frequencies of the terms in question are counted over all documents. Both take a word to be a run of what
Spark holds to be letters, in Spark's lower case, so no term gets lost between them.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, text_key

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
#: Letters of a term at least.
LETTERS = 3
#: What a broadcast of terms takes at most, and how many hash values stand for more of them.
BROADCAST_BYTES, BUCKETS = 64 << 20, 1 << 22


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ is looked at once: the characters before it, then the domain after it; long runs stay linear."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def is_ip(value: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in value.split(".")))


def luhn(digits: str) -> bool:
    return sum(n if i % 2 == 0 else n * 2 - 9 * (n > 4) for i, n in enumerate(map(int, reversed(digits)))) % 10 == 0


def is_card(value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    return 12 <= len(digits) <= 19 and luhn(digits)


def is_phone(value: str) -> bool:
    return 9 <= sum("0" <= c <= "9" for c in value) <= 15


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, by start and kind; matches that fail their check are dropped."""
    if not _ANY.search(text):
        return []
    found = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    found += [(*m.span(), "ip") for m in _IP.finditer(text) if is_ip(m[0])]
    found += [(*m.span(), "card") for m in _CARD.finditer(text) if is_card(m[0])]
    found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if is_phone(m[0])] if "+" in text else []
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else re.sub('[^0-9]', '', value)}"


def word_pattern(spark: SparkSession) -> str:
    """A pattern of the words of ``LETTERS`` letters and more, with the letters of Spark's ``\\p{L}`` listed by ranges."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    runs = spark.createDataFrame([(every,)], "s STRING").select(F.regexp_extract_all("s", F.lit(r"(\p{L}+)"), F.lit(1))).first()[0]
    return "(?:[" + "".join(f"{r[0]}-{r[-1]}" for r in runs) + f"]){{{LETTERS},}}"


def contexts(text: str, spans: list[tuple[int, int, str]], reach: int, word: re.Pattern) -> list[dict]:
    """The words near each span: entity, a hash of the context, and each word with its place (words that touch spans left out)."""
    words: list[tuple[int, int]] = []
    k, covered = 0, 0
    for m in word.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():  # spans that begin before the word ends
            covered = max(covered, spans[k][1])
            k += 1
        if m.start() >= covered:
            words.append(m.span())
    starts, out = [a for a, _ in words], []
    for a, b, kind in spans:
        near = words[max(0, (i := bisect_left(starts, a)) - reach) : i] + words[(j := bisect_left(starts, b)) : j + reach]
        mark = zlib.crc32(" ".join(text[x:y].lower() for x, y in near).encode("utf-8", "surrogatepass"))
        out += [{"entity": _entity(kind, text[a:b]), "context": mark, "start": x, "end": y, "term": text[x:y]} for x, y in near]
    return out


_BASE = "array<struct<start:int,end:int,kind:string>>"
_NEAR = "array<struct<entity:string,context:bigint,start:int,end:int,term:string>>"


def _scan(docs: DataFrame, id_col: str, text_col: str, reach: int) -> DataFrame:
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("t"))
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    pattern = word_pattern(docs.sparkSession)
    nears = pa.list_(pa.struct([("entity", pa.string()), ("context", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("term", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(pattern)
        for b in batches:
            spans, near = [], []
            for value in b.column(1):
                text = value.as_py() or ""
                found = base_spans(text)
                spans.append([{"start": x, "end": y, "kind": k} for x, y, k in found])
                near.append(contexts(text, found, reach, word) if found else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(spans, kinds), pa.array(near, nears)], names=["id", "t", "base", "near"])

    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, t bigint, base {_BASE}, near {_NEAR}")


def _counted(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """``(term, name)``: the number of documents that hold each term of the pairs.

    The terms are broadcast if they take ``BROADCAST_BYTES`` at most; else a set of ``BUCKETS`` hash values at most is, so
    that words of no term are not shuffled.
    """
    words = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("t"), F.explode(F.array_distinct(F.split(F.col(text_col), r"[^\p{L}]+"))).alias("w"))
    found = words.where(F.char_length("w") >= LETTERS).select("id", "t", F.lower("w").alias("term"))
    terms = checkpointed(pairs.select("term").distinct())
    if (terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        terms = F.broadcast(terms)
    else:
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
        found = found.withColumn("b", bucket).join(F.broadcast(terms.select(bucket.alias("b")).distinct()), "b", "left_semi").drop("b")
    found = found.join(terms, "term", "left_semi")
    return found.distinct().groupBy("term").agg(F.count(F.lit(1)).alias(name))


def disclosing_terms(docs: DataFrame, near: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_contexts: int = 2, disclosure: float = 0.8) -> DataFrame:
    """``(entity, term, pmi, ic)`` of the terms above the threshold; near: ``(id, t, entity, context, start, end, term)``."""
    total = float(docs.count())
    often = (near.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"))
             .where(F.col("contexts") >= min_contexts).select("entity", "term"))
    held = near.select("entity", "term", "id", "t").distinct()
    n_pair = held.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_pair"))
    n_entity = near.select("entity", "id", "t").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    n_near = near.select("term", "id", "t").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_near"))

    def pmi(n_term: str) -> F.Column:
        return F.log(F.col("n_pair") * total / (F.col("n_entity") * F.greatest(F.col(n_term), F.col("n_pair"))))

    ic = F.log(total / F.col("n_entity"))
    above = lambda n_term: (ic > 0) & (pmi(n_term) >= F.lit(disclosure) * ic)
    # A term is in at least the documents in which it stands near an entity, so common words fall out before they are counted.
    pairs = checkpointed(often.join(n_pair, ["entity", "term"]).join(n_entity, "entity").join(n_near, "term").where(above("n_near")))
    if not pairs.limit(1).count():
        return pairs.select("entity", "term", F.lit(0.0).alias("pmi"), F.lit(0.0).alias("ic"))
    # So they are in at least those of a sixteenth of all documents that hold them: what is too common there goes unread.
    some = checkpointed(pairs.join(_counted(docs.where(F.pmod(text_key(F.col(text_col)), F.lit(16)) == 0), pairs, id_col, text_col, "n_some"), "term", "left")
                        .withColumn("n_some", F.coalesce("n_some", F.lit(0))).where(above("n_some")))
    n_term = _counted(docs, some, id_col, text_col, "n_term")
    return some.join(n_term, "term").where(above("n_term")).select("entity", "term", pmi("n_term").alias("pmi"), ic.alias("ic"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 16, min_contexts: int = 2, disclosure: float = 0.8) -> DataFrame:
    """``(id, t, base, terms)`` for each row: the pattern spans, and the spans of disclosing terms (kind term).

    Offsets are code points, ends exclusive. A null text is empty and has no spans. Rows that share id and text
    share their result; ids may be null; extra columns are ignored; an empty table gives no rows. Words may be of any
    length and are taken whole; all terms above the threshold count, whatever their order.
    """
    scanned = checkpointed(_scan(docs, id_col, text_col, reach))
    near = scanned.select("id", "t", F.explode("near").alias("n")).select("id", "t", "n.entity", "n.context", "n.start", "n.end", F.lower("n.term").alias("term"))
    flagged = disclosing_terms(docs, near, id_col, text_col, min_contexts, disclosure)
    hits = (near.join(flagged.select("entity", "term"), ["entity", "term"], "left_semi")
            .groupBy("id", "t").agg(F.array_sort(F.collect_set(F.struct("start", "end", F.lit("term").alias("kind")))).alias("terms")))
    rows = scanned.alias("s").join(hits.alias("h"), F.col("s.id").eqNullSafe(F.col("h.id")) & (F.col("s.t") == F.col("h.t")), "left")
    return rows.select(F.col("s.id").alias(id_col), F.col("s.t").alias("t"), "base", F.coalesce("terms", F.array().cast(_BASE)).alias("terms"))


def spans_text(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def all_spans(base, terms) -> F.Column:
    """Base and term spans by start, then kind in the listed order, terms last."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, (*KINDS, "term"))), s["kind"])
    keyed = F.transform(F.concat(base, terms), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def redacted(text: str | None, spans: list) -> str | None:
    """A text whose spans are generalised to their class name; of overlapping spans the earlier covers both."""
    if text is None:
        return None
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the texts generalised; all columns stay, a null text stays null."""
    found = find(docs, id_col, text_col, **how).select(F.col(id_col).alias("_id"), F.col("t").alias("_t"), F.concat("base", "terms").alias("_spans")).where(F.size("_spans") > 0).dropDuplicates(["_id", "_t"])
    rows = docs.join(found, docs[id_col].eqNullSafe(found["_id"]) & (text_key(docs[text_col]) == found["_t"]), "left").drop("_id", "_t")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [redacted(t, s) if s else t for t, s in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
            columns = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    return rows.mapInArrow(run, docs.schema)
