"""Files in: discovery, dialects, headers, delimited text, XML, lemma sources."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.refs import scheme_parts
from quillspark.operators.citations import parse_citations

DELIMITERS = ("\t", ",", ";", "|")


def list_files(spark: SparkSession, folder: str, name_part: str = "", extensions: tuple[str, ...] = ("csv", "tsv", "txt", "xml")) -> DataFrame:
    """(path, name, extension, bytes) of the files under a folder whose name holds ``name_part``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{name_part}*.*").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.lower(F.element_at(F.split(name, r"\."), -1)).alias("extension"), F.col("length").alias("bytes")).where(F.col("extension").isin(*extensions))


def sniff_delimiter(line: Column) -> Column:
    """The delimiter that occurs most often in a first line outside quotation marks, the first of equals; null without any."""
    bare = F.regexp_replace(line, '"[^"]*"', "")
    counts = F.array(*[F.struct((F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))).alias("n"), F.lit(-k).alias("rank"), F.lit(d).alias("sep")) for k, d in enumerate(DELIMITERS)])
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["sep"])


def header_names(line: Column, sep: Column) -> Column:
    """Names of a header line in small letters, without a byte-order mark and quotation marks."""
    bare = F.regexp_replace(line, "^﻿|\r\\z", "")
    return F.transform(F.split(F.replace(bare, sep, F.lit("\x01")), "\x01"), lambda c: F.lower(F.trim(F.regexp_replace(c, '^"|"\\z', ""))))


def read_delimited(spark: SparkSession, path: str | list[str], sep: str | None = None, header: bool | list[str] = True, with_source: bool = False) -> DataFrame:
    """All columns as strings; names are in small letters; a list of names must fit the columns.

    Where no delimiter is given, each file is read with its own, sniffed from its
    first line; their columns must have the same names. With ``with_source`` also
    ``doc_id``, the file's path, and ``row_no``, which orders the rows of a file.
    The paths of files of different dialects are listed by the driver, as those
    of any folder are.
    """
    if sep is None:
        dialects = by_dialect(spark, path).groupBy("sep").agg(F.collect_list("path").alias("paths")).collect()
        if len(dialects) > 1:
            return functools.reduce(DataFrame.unionByName, [read_delimited(spark, sorted(r["paths"]), r["sep"] or ",", header, with_source) for r in sorted(dialects, key=lambda r: r["sep"] or "")])
        sep = (dialects[0]["sep"] if dialects else None) or ","
    df = spark.read.csv(path, sep=sep, header=header is True, quote='"', escape='"', multiLine=True, inferSchema=False)
    names = list(header) if isinstance(header, (list, tuple)) else df.columns
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    columns = [F.col(f"`{c}`").alias(n.lower()) for c, n in zip(df.columns, names, strict=True)]
    # A file of quoted line breaks is read by one task, from its start, so numbers rise within it.
    own = [F.col("_metadata.file_path").alias("doc_id"), F.monotonically_increasing_id().alias("row_no")] if with_source else []
    return df.select(*own, *columns)


def by_dialect(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, sep): the delimiter of each file by its first line."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.col("value"), F.monotonically_increasing_id().alias("row"))
    first = lines.where("at = 0").groupBy("path").agg(F.min_by("value", "row").alias("line"))
    return first.select("path", sniff_delimiter(F.col("line")).alias("sep"))


def read_xml_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, xml): whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


def read_lemma_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(form, lemma) from lines of form, alternative, morphology, lemma; both forms count."""
    df = spark.read.csv(path, sep="\t", schema="form string, alternative string, morphology string, lemma string", quote="")
    return df.select(F.explode(F.array_distinct(F.array("form", "alternative"))).alias("form"), "lemma").where("form <> ''")


def read_lemma_xml(spark: SparkSession, path: str) -> DataFrame:
    """(form, lemma) from records <t><f>form</f><b>form</b><l>lemma</l></t>."""
    df = spark.read.format("xml").option("rowTag", "t").schema("f string, b string, l string").load(path)
    return df.select(F.explode(F.array_distinct(F.array("f", "b"))).alias("form"), F.col("l").alias("lemma")).where("form <> ''")


def read_citation_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of plain citation text; numbers are the lines' places in their files, which may be cut over several tasks."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    return lines.select("path", F.row_number().over(Window.partitionBy("path").orderBy("block", "at")).alias("line_no"), "line")


def read_citations(spark: SparkSession, path: str, schemes: DataFrame) -> DataFrame:
    """(path, line_no, levels, refs, text) of citation files whose names have a scheme (file, citation_scheme with / between its levels); other files are left out."""
    lines = read_citation_text(spark, path).withColumn("file", F.element_at(F.split("path", "/"), -1))
    known = schemes.select("file", scheme_parts(F.col("citation_scheme")).alias("levels"))
    told = lines.join(known, "file").withColumn("n__", F.size("levels"))
    parsed = parse_citations(told, "path", "line_no", "line", "n__")
    return parsed.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(known, "file").select("path", "line_no", "levels", "refs", "text")
