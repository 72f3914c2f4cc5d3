"""Tables and texts out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.refs import first_of
from quillspark.operators.graph import feature_lines


def output_path(levels: list[list[Column]], names: list[list[str]], version: str = "1.0") -> Column:
    """One folder for each level, from the first field that has a value, else ``unknown a-b``; then the version."""
    parts = [F.regexp_replace(F.trim(first_of(*cols, default="unknown " + "-".join(own))), r"[/\\]", "-") for cols, own in zip(levels, names, strict=True)]
    return F.concat_ws("/", *parts, F.lit(version))


def numbered_paths(paths: DataFrame, path_col: str, order_col: str) -> DataFrame:
    """``paths`` with ``edition`` and ``folder``: documents of one path are told apart by a counter, which comes before the version."""
    counter = F.row_number().over(Window.partitionBy(path_col).orderBy(order_col))
    at = F.col(path_col)
    return paths.withColumn("edition", counter).withColumn("folder", F.concat(F.regexp_replace(at, "/[^/]*\\z", ""), F.lit("/"), F.col("edition").cast("string"), F.lit("/"), F.regexp_extract(at, "([^/]*)\\z", 1)))


def write_lexicon(lexicon: DataFrame, folder: str) -> None:
    """A lexicon of forms and lemmata as Parquet, sorted by form within files, so that look-ups skip most of them."""
    lexicon.sortWithinPartitions("form").write.mode("overwrite").parquet(folder)


def write_feature_files(features: DataFrame, headers: DataFrame, id_col: str, folder: str) -> None:
    """The text form with headers: for each feature and document its header (feature, header), a blank line and its lines in order."""
    lines = feature_lines(features, id_col)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "line"))), lambda x: x["line"]), "\n")
    whole = lines.groupBy("feature", id_col).agg(text.alias("body")).join(headers.select("feature", "header"), "feature")
    whole.select("feature", F.concat("header", F.lit("\n\n"), "body").alias("value")).write.mode("overwrite").partitionBy("feature").option("lineSep", "\n\n").text(folder)


def write_graph(slots: DataFrame, nodes: DataFrame, features: DataFrame, ranges: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """The canonical sink: Parquet tables; with ``mode='ignore'`` what is there stays."""
    for name, df in (("slots", slots), ("nodes", nodes), ("node_features", features), ("oslots", ranges)):
        df.write.mode(mode).parquet(f"{folder}/{name}")


def write_feature_text(features: DataFrame, id_col: str, folder: str) -> None:
    """One folder of text files for each feature, lines ordered by document and node."""
    lines = feature_lines(features, id_col)
    lines.repartition("feature", id_col).sortWithinPartitions("feature", id_col, "node").select("feature", F.col("line").alias("value")).write.mode("overwrite").partitionBy("feature").text(folder)


def write_tsv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").csv(folder, sep="\t", header=True, quote='"', escape='"')


def write_witnesses(df: DataFrame, doc_col: str, hand_col: str, text_col: str, folder: str) -> None:
    """One folder of XML for each manuscript's hand, its transcription as the body of a document."""
    body = F.concat(F.lit("<TEI><text><body>"), F.col(text_col), F.lit("</body></text></TEI>"))
    df.select(F.concat_ws("_", doc_col, hand_col).alias("witness"), body.alias("value")).write.mode("overwrite").partitionBy("witness").text(folder)
