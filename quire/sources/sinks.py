"""Sinks: XML and training files, archives with assets, CRF data."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_xml(documents: DataFrame, path: str, column: str = "tei", compressed: bool = False) -> None:
    """A file for each document, in a folder of its id, with the text as it is and a newline at its end."""
    one_each = documents.select("doc_id", F.col(column).alias("value")).repartition("doc_id")
    one_each.write.partitionBy("doc_id").option("compression", "gzip" if compressed else "none").text(path)


def write_training(files: DataFrame, path: str, compressed: bool = True) -> None:
    """Training rows ``(model, kind, text)`` in a folder for each model and kind; empty texts are left out."""
    rows = files.where(F.coalesce(F.col("text"), F.lit("")) != "").select("model", "kind", F.col("text").alias("value"))
    rows.write.partitionBy("model", "kind").option("compression", "gzip" if compressed else "none").text(path)


def write_crf(texts: DataFrame, path: str) -> None:
    """CRF documents with a blank line after each, in files by partition."""
    texts.select(F.concat("text", F.lit("\n")).alias("value")).write.text(path)


def training_path(name: str, suffix: str, folder: str | None = None, compressed: bool = False) -> str:
    return "/".join(p for p in (folder, f"{name}{suffix}{'.gz' if compressed else ''}") if p)


def zipped_assets(documents: DataFrame, assets: DataFrame, column: str = "tei", name: str = "document.xml") -> DataFrame:
    """``(doc_id, archive)``: a ZIP file for each document with its XML and assets ``(doc_id, relative_path, content)``."""
    both = documents.select("doc_id", F.lit(name).alias("relative_path"), F.encode(F.col(column), "UTF-8").alias("content")).unionByName(assets.select("doc_id", "relative_path", "content"))
    kind = both.schema["doc_id"].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path, content in sorted(zip(rows["relative_path"], rows["content"]), key=lambda x: (x[0] != name, x[0])):
                if path is None:
                    raise ValueError("an asset has no relative path")
                z.writestr(zipfile.ZipInfo(path), bytes(content))
        return pd.DataFrame({"doc_id": [key[0]], "archive": [out.getvalue()]})

    return both.groupBy("doc_id").applyInPandas(run, f"doc_id {kind}, archive BINARY")


def converted(files: DataFrame, convert) -> DataFrame:
    """Files ``(path, content)`` through an external converter, a function from bytes to bytes that a task loads once."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(content=[convert(bytes(c)) for c in rows["content"]])[["path", "content"]]

    return files.select("path", "content").mapInPandas(run, "path STRING, content BINARY")
