"""Labels and spans: labellers, filters by label, islands of equal labels.

A label table ``(doc_id, line_no, token_no, label)`` is what any sequence model gives; models plug in as functions from
feature lines to labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

KEY = ["doc_id", "line_no", "token_no"]
ORDER = ["line_no", "token_no"]


def with_rule_labels(tokens: DataFrame, rules: list[tuple[Column, str]], default: str = "O") -> DataFrame:
    """Tokens with a label by the first rule that holds; runs of one label begin with ``B-``."""
    tag = F.lit(default)
    for condition, name in reversed(rules):
        tag = F.when(condition, F.lit(name)).otherwise(tag)
    out = tokens.withColumn("_tag", tag)
    before = F.lag("_tag").over(Window.partitionBy("doc_id").orderBy(*ORDER))
    prefix = F.when(before.eqNullSafe(F.col("_tag")), "I-").otherwise("B-")
    return out.withColumn("label", F.when(F.col("_tag") == "O", "O").otherwise(F.concat(prefix, "_tag"))).drop("_tag")


def with_model_labels(features: DataFrame, predict: Callable[[list[str]], list[str]]) -> DataFrame:
    """Labels of a sequence model, a call for each document with its feature lines in order.

    The model gives one label for each line it gets; features as by ``feature_lines``.
    """
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(ORDER)
        found = predict(rows["data"].tolist())
        if len(found) != len(rows):
            raise ValueError(f"{len(found)} labels for {len(rows)} lines of document {key[0]}")
        return rows[KEY].assign(label=found)

    kinds = {f.name: f.dataType.simpleString() for f in features.schema.fields}
    return features.groupBy("doc_id").applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in KEY) + ", label string")


def with_process_labels(features: DataFrame, command: list[str], timeout: float = 20.0, attempts: int = 10, lines_at_once: int = 100_000) -> DataFrame:
    """Labels of an external tagger that reads feature lines and a blank line per document, and writes lines that end in the label.

    A call gets whole documents, however the rows come in batches: as many as have ``lines_at_once`` lines together, or one
    longer one. A call that fails, or takes more than ``timeout`` seconds for each 10,000 lines begun, is tried again.
    """
    import subprocess

    schema = features.select(*KEY).schema.add("label", "string")

    def tagged(rows: pd.DataFrame) -> pd.DataFrame:
        starts = rows["doc_id"].ne(rows["doc_id"].shift()).to_numpy(copy=True)
        starts[0] = False
        text = "".join(("\n" if s else "") + line + "\n" for s, line in zip(starts, rows["data"])) + "\n"
        for attempt in range(attempts):
            try:
                done = subprocess.run(command, input=text, capture_output=True, text=True, check=True, timeout=timeout * (1 + len(rows) // 10_000))
                break
            except (subprocess.TimeoutExpired, subprocess.CalledProcessError):
                if attempt + 1 == attempts:
                    raise
        labels = [line.split()[-1] for line in done.stdout.splitlines() if line.strip()]
        if len(labels) != len(rows):
            raise ValueError(f"{len(labels)} labels for {len(rows)} lines")
        return rows[KEY].assign(label=labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in batches:
            if not len(rows):
                continue
            held.append(rows)
            if sum(map(len, held)) >= lines_at_once:
                whole = pd.concat(held, ignore_index=True)
                last = whole["doc_id"].ne(whole["doc_id"].shift()).to_numpy().nonzero()[0][-1]  # the last document may go on
                if last:
                    yield tagged(whole[:last])
                held = [whole[last:].reset_index(drop=True)]
        if held:
            yield tagged(pd.concat(held, ignore_index=True))

    return features.repartition("doc_id").sortWithinPartitions(*KEY).mapInPandas(run, schema)


def zipped(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """Tokens with their labels by position; a token without a label is an error."""
    joined = tokens.join(labels.select(*KEY, "label"), KEY, "left")
    return joined.withColumn("label", F.coalesce("label", F.raise_error(F.lit("a token has no label")).cast("string")))


def available_labels(labelled: DataFrame) -> DataFrame:
    return labelled.select(T.without_prefix("label").alias("label")).distinct()


def filtered(labelled: DataFrame, labels: list[str]) -> DataFrame:
    """The tokens with one of the labels; containers that lose all tokens are gone."""
    return labelled.where(T.without_prefix("label").isin(labels))


def filtered_lines(tokens: DataFrame, line_labels: DataFrame, labels: list[str]) -> DataFrame:
    """The tokens of lines with one of the labels; line_labels: ``(doc_id, line_no, label)``."""
    wanted = line_labels.where(T.without_prefix("label").isin(labels)).select("doc_id", "line_no")
    return tokens.join(wanted, ["doc_id", "line_no"], "left_semi")


def with_islands(labelled: DataFrame, partition: tuple[str, ...] = ("doc_id",), order: tuple[str, ...] = tuple(ORDER)) -> DataFrame:
    """``tag`` and ``span_no``: a span ends where the tag changes or a ``B-`` begins another."""
    w = Window.partitionBy(*partition).orderBy(*order)
    parts = labelled.withColumn("_l", T.split_label("label")).withColumns({"tag": F.col("_l.tag"), "_prefix": F.col("_l.prefix")}).drop("_l")
    start = (F.col("_prefix") == "B") | ~F.col("tag").eqNullSafe(F.lag("tag", 1, "O").over(w))
    # A first token outside any entity starts no new span; numbers begin at zero.
    numbered = parts.withColumn("_start", F.when(start, 1).otherwise(0))
    first = F.first("_start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return numbered.withColumn("span_no", (F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - first).cast("int")).drop("_start", "_prefix")


def joined_text(parts: Column) -> Column:
    """The text of an ordered array of ``struct<..., text, whitespace>``, without the last white space."""
    last = F.element_at(parts, -1)
    head = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.concat(p["text"], p["whitespace"]))
    return F.concat(F.array_join(head, ""), last["text"])


def spans(labelled: DataFrame) -> DataFrame:
    """``(doc_id, span_no, tag, text, n_tokens, first_line, first_token, tokens)``: the spans of equal labels in order.

    A span's text keeps the white space between its tokens.
    """
    grouped = with_islands(labelled).groupBy("doc_id", "span_no", "tag").agg(F.array_sort(F.collect_list(F.struct("line_no", "token_no", "text", "whitespace", "font", "coord"))).alias("tokens"))
    return grouped.select("doc_id", "span_no", "tag", joined_text(F.col("tokens")).alias("text"), F.size("tokens").alias("n_tokens"),
                          F.get("tokens", F.lit(0))["line_no"].alias("first_line"), F.get("tokens", F.lit(0))["token_no"].alias("first_token"), "tokens")


def model_output(labelled: DataFrame, fmt: str = "json") -> DataFrame:
    """A model's output by document: raw_data (feature lines), data (token and label lines), xml or json."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "token_no", "text", "label", *(["data"] if "data" in labelled.columns else []))))
    docs = labelled.groupBy("doc_id").agg(rows.alias("rows"))
    if fmt == "json":
        out = F.to_json(F.transform("rows", lambda r: F.struct(r["text"].alias("token"), r["label"].alias("label"))))
    elif fmt == "data":
        out = F.array_join(F.transform("rows", lambda r: F.concat_ws(" ", r["text"], r["label"])), "\n")
    elif fmt == "raw_data":
        out = F.array_join(F.transform("rows", lambda r: r["data"]), "\n")
    elif fmt == "xml":
        tag = lambda r: F.regexp_replace(T.without_prefix(r["label"]), "[<>]", "")
        out = F.concat(F.lit("<xml>"), F.array_join(F.transform("rows", lambda r: F.concat(F.lit("<"), tag(r), F.lit(">"), T.escaped(r["text"]), F.lit("</"), tag(r), F.lit(">"))), ""), F.lit("</xml>"))
    else:
        raise ValueError(f"unknown format {fmt}")
    return docs.select("doc_id", out.alias("output"))


def tokens_between(tokens: DataFrame, start: Column, end: Column) -> DataFrame:
    """The tokens that overlap a range of character offsets in their document's text (white space counts)."""
    w = Window.partitionBy("doc_id").orderBy(*ORDER)
    before = F.coalesce(F.sum(F.char_length(F.concat("text", "whitespace"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = tokens.withColumn("char_start", before).withColumn("char_end", F.col("char_start") + F.char_length("text"))
    return at.where((F.col("char_start") < end) & (F.col("char_end") > start))
