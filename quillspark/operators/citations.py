"""Plain citation text, line by line, to rows of references and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.refs import align_right, clean_ref


def _levels(ref: Column) -> Column:
    return F.filter(F.split(ref, r"\."), lambda x: x != "")


def parse_citations(lines: DataFrame, part_col: str, order_col: str, line_col: str, n_col: str) -> DataFrame:
    """(part, order, refs, text) of lines ``reference<TAB>text``; ``n_col`` is how many levels the file's scheme has.

    Blank lines go. A line without a tab goes, with a space, before the next
    one, unless what is held then has as many levels as the scheme: that is a
    reference without text and is dropped. What is left at a file's end comes out
    with null references. References are cleaned and aligned to the right.
    """
    told = lines.select(part_col, order_col, F.trim(F.regexp_replace(line_col, r"^[\s]+|[\s]+\z", "")).alias("line__"), F.col(n_col).alias("n__")).where("line__ <> ''")
    complete = F.col("line__").contains("\t")
    by_part = Window.partitionBy(part_col).orderBy(order_col)
    run = F.coalesce(F.sum(complete.cast("int")).over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = told.withColumn("run__", run)
    grouped = runs.groupBy(part_col, "run__").agg(F.max(order_col).alias(order_col), F.first("n__").alias("n__"), F.array_sort(F.collect_list(F.when(~complete, F.struct(order_col, "line__")))).alias("open__"), F.max(F.when(complete, F.col("line__"))).alias("full__"))
    step = lambda acc, x: F.ltrim(F.concat(acc, F.lit(" "), x["line__"]))
    held = F.aggregate("open__", F.lit(""), lambda acc, x: F.when(F.size(_levels(step(acc, x))) == F.col("n__"), F.lit("")).otherwise(step(acc, x)))
    joined = grouped.withColumn("held__", held).withColumn("whole__", F.when(F.col("full__").isNotNull(), F.ltrim(F.concat("held__", F.lit(" "), "full__"))))
    cut = F.instr("whole__", "\t")
    ref = F.expr("substring(whole__, 1, instr(whole__, '\t') - 1)")
    text = F.when(cut > 0, F.translate(F.regexp_replace(F.expr("substring(whole__, instr(whole__, '\t') + 1)"), r"^\s+|\s+\z", ""), "\t", " ")).otherwise(F.col("held__"))
    refs = F.when(cut > 0, align_right(F.transform(_levels(ref), clean_ref), F.col("n__")))
    return joined.select(part_col, order_col, refs.alias("refs"), text.alias("text")).where("refs IS NOT NULL OR text <> ''")
