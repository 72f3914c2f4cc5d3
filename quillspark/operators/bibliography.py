"""Line-oriented bibliographies: keyed blocks of coded lines to records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Line codes and the names of their fields.
FIELDS = {"nam": "author", "edr": "editor", "geo": "geography", "dat": "date", "cit": "citation_scheme", "wct": "tlg_wordcount", "wrk": "work", "pub": "publisher", "pag": "pages", "epi": "epithet", "typ": "type", "pyr": "publication_year", "ryr": "republication_year", "pla": "place", "tit": "title"}


def split_lines(df: DataFrame, line_col: str) -> DataFrame:
    """``df`` with ``code`` and ``value``: four leading spaces continue the line before (code null), else the code ends at the first space."""
    goes_on = F.col(line_col).startswith("    ")
    return df.select(
        "*",
        F.when(~goes_on, F.regexp_extract(line_col, r"^(\S*)", 1)).alias("code"),
        F.when(goes_on, F.trim(line_col)).otherwise(F.trim(F.regexp_replace(line_col, r"^\S*", ""))).alias("value"),
    )


def parse_bibliography(df: DataFrame, part_col: str, order_col: str, line_col: str) -> DataFrame:
    """(work_id, field, value): keys are carried down to their lines, continued values joined, the last of equal fields wins.

    ``part_col`` tells apart what is read on its own (a file), so that no order
    spans all input. A line of an unknown code keeps the code as its field.
    """
    split = split_lines(df, line_col)
    run = Window.partitionBy(part_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    keyed = split.select(part_col, order_col, "code", "value", F.last(F.when(F.col("code") == "key", F.col("value")), ignorenulls=True).over(run).alias("work_id"), F.sum(F.col("code").isNotNull().cast("int")).over(run).alias("entry"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col("value").alias("v")))), lambda s: s["v"]), " ")
    entries = keyed.groupBy(part_col, "work_id", "entry").agg(F.max("code").alias("code"), joined.alias("value")).where((F.col("code") != "key") & F.col("work_id").isNotNull())
    names = F.create_map(*[F.lit(x) for kv in FIELDS.items() for x in kv])
    return entries.groupBy("work_id", F.coalesce(F.element_at(names, F.col("code")), F.col("code")).alias("field")).agg(F.max_by("value", F.struct(part_col, "entry")).alias("value"))


def tidy_fields(fields: DataFrame) -> DataFrame:
    """(work_id, field, value) with values as a catalogue has them: angle and square brackets go from names, names, titles, publishers and places have capitals, citation schemes are in small letters."""
    f, v = F.col("field"), F.col("value")
    bare = F.regexp_replace(v, r"^[<>\[\]]+|[<>\[\]]+\z", "")
    tidy = F.when(f.isin("author", "editor"), F.initcap(bare)).when(f.isin("work", "publisher", "place", "title"), F.initcap(v)).when(f == "citation_scheme", F.lower(v)).otherwise(v)
    return fields.withColumn("value", tidy)


def parse_titles(df: DataFrame, part_col: str, order_col: str, line_col: str, prefix: str = "") -> DataFrame:
    """(work_id, title, title_full) of a list of works: ``NNNN WWW`` opens a work, the lines to the next one are its title, up to a comma the short one; ``NNNN`` alone opens an author."""
    line = F.trim(line_col)
    work = F.when(line.rlike(r"^[0-9]{4} \w{3}\z"), F.concat(F.lit(prefix), F.replace(line, F.lit(" "), F.lit("-")))).when(line.rlike(r"^[0-9]{4}\z"), F.lit(""))
    run = Window.partitionBy(part_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    told = df.select(part_col, order_col, line.alias("line"), F.last(work, ignorenulls=True).over(run).alias("work_id"), work.isNotNull().alias("opens")).where("work_id <> '' AND NOT opens")
    rows = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col("line").alias("l"))))
    full = told.groupBy(part_col, "work_id").agg(rows.alias("rows")).select("work_id", F.regexp_extract(F.get("rows", F.lit(0))["l"], "^([^,]*)", 1).alias("title"), F.array_join(F.transform("rows", lambda r: r["l"]), " ").alias("title_full"))
    return full


def with_titles(df: DataFrame, key_col: str, titles: DataFrame, default: str = "not provided") -> DataFrame:
    """``df`` with ``title`` by ``titles`` (work_id, title), else the default."""
    lex = titles.groupBy(F.col("work_id").alias("key__")).agg(F.max("title").alias("title__"))
    return df.join(lex, F.col(key_col) == F.col("key__"), "left").select(*[df[c] for c in df.columns], F.coalesce("title__", F.lit(default)).alias("title"))


def as_records(fields: DataFrame) -> DataFrame:
    """(work_id, fields): one map for each work."""
    return fields.groupBy("work_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))
