"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter stands for all languages at once: each of its slots holds a bitmask of languages, and an
n-gram's languages are the AND of the masks at its slots. A text's n-grams give a population count for each
language; the count is corrected for false positives (a language whose slices are filled to the share ``r`` answers
``r ** k`` of foreign n-grams) and the highest corrected share decides.

The filter is fitted on a bounded sample of labelled rows: ``sample_per_language`` rows for each language, chosen by
a hash of the id. All languages are learned, and of each all n-grams found in two of its sampled rows, or in one where
a language has fewer than ``FEW`` of them. The masks have as many bits as there are languages, the filter slots in
proportion to the n-grams of the language with most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 20
#: Sampled rows of a language below which an n-gram of one row counts; slots for each n-gram at least.
FEW, SLOTS = 20, 6
UNKNOWN = "und"

_letters = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def ngram_hashes(text: str | None, sizes: tuple[int, ...]) -> Iterator[np.ndarray]:
    """64-bit hashes of the n-grams of a text's letters, piece by piece; every run of other characters is one space.

    n-grams have no space but at their ends, and one letter at least.
    """
    if not text:
        return
    table, text, longest = _letter_table(), text.lower(), max(sizes)
    held = np.array([32], np.uint64)  # what n-grams of the next piece can begin with
    last = False
    for lo in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[lo : lo + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        word = table[np.minimum(codes, 0x10FFFF)]
        keep = word.copy()
        keep[1:] |= word[:-1]  # of a run of others, the first
        keep[0] |= last
        last = bool(word[-1])
        new = np.where(word, codes, np.uint32(32))[keep].astype(np.uint64)
        if lo + CHUNK >= len(text):
            new = np.append(new, np.uint64(32))
        codes = np.concatenate([held, new])
        space = codes == 32
        for n in sizes:
            from_ = max(0, len(held) - n + 1)  # those before were complete in the last piece
            m = len(codes) - n + 1 - from_
            if m <= 0 or not len(new):
                continue
            h = np.full(m, n, np.uint64)
            inner = np.zeros(m, bool)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + codes[from_ + k : from_ + k + m]
                if 0 < k < n - 1:
                    inner |= space[from_ + k : from_ + k + m]
            ends = space[from_ : from_ + m], space[from_ + n - 1 : from_ + n - 1 + m]
            good = ~inner & ~(ends[0] & ends[1]) if n > 1 else ~ends[0]
            yield _mixed(h[good])
        held = codes[-(longest - 1) :] if longest > 1 else codes[:0]


@dataclass
class BitmaskFilter:
    """A Bloom filter whose slots are bitmasks of languages."""

    languages: list[str]
    sizes: tuple[int, ...] = (2, 3, 4)
    slots: int = 1 << 20
    probes: int = 3
    masks: np.ndarray = field(default=None, repr=False)
    false_rate: np.ndarray = field(default=None, repr=False)

    def __post_init__(self):
        n = len(self.languages)
        kind = np.uint8 if n <= 8 else np.uint16 if n <= 16 else np.uint32 if n <= 32 else np.uint64
        if self.masks is None:  # a word for every 64 languages
            self.masks = np.zeros((max(1, -(-n // 64)), self.slots), kind)

    def _at(self, hashes: np.ndarray, k: int) -> np.ndarray:
        return ((hashes + np.uint64(k) * ((hashes >> np.uint64(40)) | np.uint64(1))) & np.uint64(self.slots - 1)).astype(np.int64)

    def add(self, hashes: np.ndarray, language: int) -> None:
        for k in range(self.probes):
            self.masks[language // 64][self._at(hashes, k)] |= self.masks.dtype.type(1 << language % 64)

    def has(self, masks: np.ndarray, language: int) -> np.ndarray:
        """Whether masks, as of languages_of(), have a language's bit."""
        return (masks[language // 64] >> masks.dtype.type(language % 64)) & masks.dtype.type(1)

    def settle(self) -> BitmaskFilter:
        self.false_rate = np.array([float(self.has(self.masks, i).mean()) for i in range(len(self.languages))]) ** self.probes
        return self

    def languages_of(self, hashes: np.ndarray) -> np.ndarray:
        """(words, n) masks of the languages of each n-gram."""
        found = self.masks[:, self._at(hashes, 0)]
        for k in range(1, self.probes):
            found &= self.masks[:, self._at(hashes, k)]
        return found

    def decide(self, text: str | None) -> tuple[str, float]:
        """The language and its corrected share of n-grams; und for a text that is null or has no letter."""
        counts, total = np.zeros(len(self.languages), np.int64), 0
        for hashes in ngram_hashes(text, self.sizes):
            found = self.languages_of(hashes)
            total += len(hashes)
            if len(self.languages) <= 8:
                by_mask = np.bincount(found[0], minlength=256)
                counts += by_mask @ _BITS[:, : len(self.languages)]
            else:
                counts += np.array([int(self.has(found, i).sum()) for i in range(len(self.languages))])
        if not total or not self.languages:
            return UNKNOWN, 0.0
        shares = np.clip((counts / total - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1)
        best = int(shares.argmax())  # of equal shares, the language with more rows
        return self.languages[best], float(shares[best])


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_language: int = 400,
        sizes: tuple[int, ...] = (2, 3, 4), slots: int = 1 << 20, probes: int = 3) -> BitmaskFilter:
    """A filter learned from the labelled rows of ``docs`` (text and language not null).

    Languages are numbered by rows, most first (ties by name), which decides between equal shares. slots is the least
    number of slots; it is doubled until there are ``SLOTS`` for each n-gram of a language.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # one for each language
    languages = [r["lang"] for r in rows]
    if not languages:
        return BitmaskFilter([], sizes, slots, probes).settle()
    # About a quarter more than wanted is drawn, and cut to the bound.
    shares = F.broadcast(spark.createDataFrame([(r["lang"], min(1.0, 1.25 * sample_per_language / r["count"])) for r in rows], "lang string, share double"))
    place = F.xxhash64(F.lit(11), "id")
    drawn = known.withColumn("place", place).join(shares, "lang").where(F.pmod("place", F.lit(1 << 30)) < F.col("share") * float(1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "id", F.xxhash64("text")))
    drawn = drawn.withColumn("rank", rank).where(F.col("rank") <= sample_per_language).select("lang", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = list(ngram_hashes(text, sizes))
                if parts:
                    found = np.unique(np.concatenate(parts)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found)], names=["lang", "gram"])

    counted = drawn.repartition(F.xxhash64("text")).mapInArrow(grams, "lang string, gram bigint").groupBy("lang", "gram").count()
    few = [r["lang"] for r in rows if r["count"] < FEW]
    chosen = counted.where((F.col("count") > 1) | F.col("lang").isin(few) if few else F.col("count") > 1).select("lang", "gram").toArrow()  # of the sampled rows
    number = {name: i for i, name in enumerate(languages)}
    lang = np.fromiter((number[x] for x in chosen.column("lang").to_pylist()), np.int64, chosen.num_rows)
    gram = chosen.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    most = int(np.bincount(lang, minlength=1).max())
    while slots < SLOTS * most:
        slots *= 2
    made = BitmaskFilter(languages, sizes, slots, probes)
    for i in range(len(languages)):
        made.add(gram[lang == i], i)
    return made.settle()


def predict(docs: DataFrame, model: BitmaskFilter, text_col: str = "text") -> DataFrame:
    """``docs`` with columns ``lang_pred`` and ``score`` (the corrected share of n-grams, 0 to 1).

    A text that is null or has no letter is ``und`` with score 0. Columns of these names are replaced. Every row is
    judged alone, whole; repeated rows get equal results, an empty table gives no rows.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # slots and languages bound its size
    from pyspark.sql.functions import arrow_udf

    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def decide(texts: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("lang_pred", "score"), held.value.decide(t.as_py()))) for t in texts], kind)

    judged = arrow_udf(decide, "struct<lang_pred:string,score:double>")
    rows = docs.drop("lang_pred", "score").withColumn("_judged", judged(F.col(text_col)))
    return rows.select("*", "_judged.lang_pred", "_judged.score").drop("_judged")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves 2 when divided by 4 (a null id does not)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
