"""Five stages from raw documents to token files; each is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, langid, mixing, simhash, tokens
from quire.llm.common import fresh_path, table

#: Texts of which a smaller share of n-grams is known in any language are rejected.
LEAST_LANGUAGE_SCORE = 0.3


def _aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list]:
    """``docs`` with columns of the names an operator adds set aside, and the columns that bring them back."""
    own = {c: f"_own_{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(own), [F.col(own.get(c, c)).alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null texts, texts without letters and texts in no known language. Repeated rows share their fate; an empty table stays empty."""
    rows, columns = _aside(docs, ("lang_pred", "score"))
    judged = langid.predict(rows, langid.fit(rows))
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least id of each group of copies and near copies (different shingles of five words, Jaccard similarity 0.8).

    Sets that similar differ in about 39 of 256 bits (standard deviation 6), unrelated ones in 128 (8).
    """
    return simhash.one_of_each(docs, width=5, words64=4, radius=76, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain an item of the benchmark; null and empty texts contain none, rows that share an id go together."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws half of the tokens, with sources, languages and topics evened out. Null sources and languages are classes of their own, repeated rows share their fate."""
    rows, columns = _aside(docs, ("topic", "n_tokens", "weight", "prob", "kept"))
    return mixing.mixed(rows, keep=0.5, power=0.5).where("kept").select(*columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards and gives each document's place, size and checksum read from them; a null text is empty, every row is a document."""
    return tokens.token_rows(docs, tokens.default_tokenizer(), end_id=2, pieces=200_000)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("token_files", token_files)]

#: SQL cannot express these stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
