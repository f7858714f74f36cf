"""File sources: lexicons, CRF training files, configuration, uploads."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Media types by extension, for uploads without one.
MEDIA_TYPES = {
    "pdf": "application/pdf", "xml": "application/xml", "zip": "application/zip", "json": "application/json", "txt": "text/plain", "html": "text/html", "rtf": "application/rtf",
    "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "dotx": "application/vnd.openxmlformats-officedocument.wordprocessingml.template",
}
OFFICE_TYPES = [MEDIA_TYPES[x] for x in ("doc", "docx", "dotx", "rtf")]
TEI_TYPE, JATS_TYPE = "application/tei+xml", "application/vnd.jats+xml"


def media_type(filename: Column, declared: Column) -> Column:
    """The declared media type, or that of the file's extension where none or a general one is declared."""
    known = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    guessed = F.element_at(known, F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1)))
    general = declared.isNull() | (declared == "") | (declared == "application/octet-stream")
    return F.when(general, F.coalesce(guessed, F.lit("application/octet-stream"))).otherwise(declared)


def accepted_media_type(accepted: list[str], available: list[str]) -> str | None:
    """The first available type that the caller accepts; wildcards and an empty list take the first there is."""
    for wanted in accepted or ["*/*"]:
        if wanted == "*/*":
            return available[0] if available else None
        if wanted in available:
            return wanted
    return None


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content, media_type)`` of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content", media_type(F.col("path"), F.lit(None).cast("string")).alias("media_type"))


def needs_conversion(kind: Column) -> Column:
    """Whether a file must pass the (pluggable) office converter first."""
    return kind.isin(OFFICE_TYPES)


def is_xml_lookup(path: str) -> bool:
    return path.lower().removesuffix(".gz").endswith(".xml")


def lexicon(spark: SparkSession, kinds: Mapping[str, list[str]]) -> DataFrame:
    """``(kind, term)``: lower-case terms of text files (one a line) and XML files (the text of each cell)."""
    found = spark.createDataFrame([], "kind STRING, term STRING")
    for kind, paths in kinds.items():
        for path in paths:
            if is_xml_lookup(path):
                terms = spark.read.text(path, wholetext=True).select(F.explode(F.xpath("value", F.lit("//*[local-name()='cell']/text()"))).alias("term"))
            else:
                terms = spark.read.text(path).select(F.col("value").alias("term"))
            found = found.unionByName(terms.select(F.lit(kind).alias("kind"), F.lower("term").alias("term")).where("term <> ''"))
    return found.distinct()


def crf_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(path, doc_no, token_no, token, features, label)`` of CRF data files: space-separated lines, blank between documents."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\n[ \t]*\n+")).alias("doc_no", "doc"))
    lines = whole.select("path", "doc_no", F.posexplode(F.filter(F.split("doc", "\n"), lambda x: F.trim(x) != "")).alias("token_no", "line"))
    parts = F.split("line", "[ \t]")
    return lines.select("path", "doc_no", "token_no", F.get(parts, F.lit(0)).alias("token"), F.slice(parts, F.lit(2), F.size(parts) - 2).alias("features"), F.element_at(parts, -1).alias("label"))


def paired(tei: DataFrame, raw: DataFrame, suffix: str = ".tei.xml") -> DataFrame:
    """Training TEI files with their feature files, by base name; both have a column path."""
    base = lambda c: F.regexp_extract(F.regexp_replace(c, r"\.gz$", ""), r"([^/]+)$", 1)
    left = tei.withColumn("base", F.regexp_replace(base(F.col("path")), suffix.replace(".", r"\.") + "$", ""))
    return left.join(raw.withColumn("base", base(F.col("path"))).withColumnRenamed("path", "raw_path"), "base")


def first_existing(spark: SparkSession, alternatives: list[str]) -> str | None:
    """The first path that exists in its store."""
    jvm = spark._jvm
    for path in alternatives:
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return path
    return None


def files_or_fail(spark: SparkSession, pattern: str) -> list[str]:
    """The qualified paths that a glob pattern finds; an error without any."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    paths = [f.getPath().toString() for f in found or []]
    if not paths:
        raise FileNotFoundError(f"no files found: {pattern}")
    return paths


def with_environment(props: dict, environment: Mapping[str, str] | None = None, prefix: str = "QUIRE__") -> dict:
    """Settings with overrides from variables such as ``QUIRE__A__B=value``; values are JSON scalars, else text."""
    out = json.loads(json.dumps(props))
    for name, value in (os.environ if environment is None else environment).items():
        if not name.startswith(prefix):
            continue
        *parents, last = name[len(prefix):].lower().split("__")
        at = out
        for p in parents:
            at = at.setdefault(p, {})
        try:
            at[last] = json.loads(value)
        except ValueError:
            at[last] = value
    return out
