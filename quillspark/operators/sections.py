"""Sections, headings and carried text of row-oriented sources."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import checkpoint_dir


def number_sections(rows: DataFrame, id_col: str, order_col: str, levels: list[str], text_col: str | None = None, block: Column | None = None) -> DataFrame:
    """``rows`` with ``<level>_node`` for each level: it restarts when its value or that of a level above differs from the row before.

    Rows whose text is null or empty break nothing and have null numbers. A
    document's rows are one window, unless ``block`` (which must not fall along
    the order, as a line number by thousands) cuts it: then windows span one
    block of one document, and what goes on from block to block, its last values
    and its counts, is carried over a table of one row for each block.
    """
    full = rows.where(F.col(text_col) != "") if text_col else rows
    keys = [id_col] if block is None else [id_col, "block__"]
    if block is not None:
        full = full.withColumn("block__", block)
    own = Window.partitionBy(*keys).orderBy(order_col)
    run = own.rowsBetween(Window.unboundedPreceding, 0)
    values = F.struct(*[F.col(c) for c in levels])

    def changes(now: Column, before: Column) -> list[Column]:
        """Of each level, 1 where it or one above differs; all of them where there is nothing before."""
        same = [now[c].eqNullSafe(before[c]) for c in levels]
        return [(before.isNull() | ~functools.reduce(Column.__and__, same[: k + 1])).cast("int") for k in range(len(levels))]

    out = full.withColumn("now__", values).withColumn("before__", F.lag("now__").over(own)).withColumn("nth__", F.row_number().over(own))
    inner = F.lit(True) if block is None else F.col("nth__") > 1
    out = out.select("*", *[F.when(inner, c).otherwise(0).alias(f"__{level}") for level, c in zip(levels, changes(F.col("now__"), F.col("before__")), strict=True)])
    out = out.select("*", *[F.sum(f"__{level}").over(run).alias(f"{level}_node") for level in levels])
    if block is not None:
        checkpoint_dir(rows.sparkSession)
        out = out.checkpoint()  # read for the blocks' ends and for the rows
        ends = out.groupBy(*keys).agg(F.min_by("now__", order_col).alias("first__"), F.max_by("now__", order_col).alias("last__"), *[F.sum(f"__{level}").alias(f"n_{level}") for level in levels])
        by_block = Window.partitionBy(id_col).orderBy("block__")
        ends = ends.withColumn("carried__", F.lag("last__").over(by_block))
        ends = ends.select("*", *[c.alias(f"f_{level}") for level, c in zip(levels, changes(F.col("first__"), F.col("carried__")), strict=True)])
        so_far = by_block.rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*keys, *[(F.coalesce(F.sum(F.col(f"n_{level}") + F.col(f"f_{level}")).over(so_far), F.lit(0)) + F.col(f"f_{level}")).alias(f"o_{level}") for level in levels])
        out = out.join(ends.withColumnsRenamed({k: f"{k}_e" for k in keys}), functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_e")) for k in keys]))
        out = out.withColumns({f"{level}_node": F.col(f"{level}_node") + F.col(f"o_{level}") for level in levels})
    out = out.select(*rows.columns, *[f"{level}_node" for level in levels])
    if not text_col:
        return out
    rest = rows.where(F.coalesce(F.col(text_col) == "", F.lit(True)))
    return out.unionByName(rest, allowMissingColumns=True)


def backfill_levels(rows: DataFrame, id_col: str, order_col: str, value_col: str) -> DataFrame:
    """``rows`` with ``filled``: a value 0 before a number v becomes v - 1."""
    after = F.lead(value_col).over(Window.partitionBy(id_col).orderBy(order_col))
    return rows.withColumn("filled", F.when((F.col(value_col) == 0) & after.isNotNull(), after - 1).otherwise(F.col(value_col)))


def carry_lines(rows: DataFrame, id_col: str, order_col: str, text_col: str) -> DataFrame:
    """(id, order of the first line, text): lines that end with a hyphen or ``<`` are glued to the next, the sign dropped; the last carry stays."""
    by_doc = Window.partitionBy(id_col).orderBy(order_col)
    opened = F.coalesce(F.lag(text_col).over(by_doc).rlike(r"[-<]\z"), F.lit(False))
    island = F.sum((~opened).cast("int")).over(by_doc.rowsBetween(Window.unboundedPreceding, 0))
    bare = F.regexp_replace(text_col, r"[-<]\z", "")
    last = F.lead(text_col).over(by_doc).isNull()
    part = F.when(last, F.col(text_col)).otherwise(bare)
    marked = rows.select(id_col, order_col, island.alias("island"), part.alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order_col, "part"))), lambda s: s["part"]), "")
    return marked.groupBy(id_col, "island").agg(F.min(order_col).alias(order_col), joined.alias("text")).drop("island")


def fill_continuations(rows: DataFrame, id_col: str, order_col: str, text_col: str, complete: Column) -> DataFrame:
    """(id, order, text): rows that are not complete go before the next complete row; what is left at the end stays apart."""
    by_doc = Window.partitionBy(id_col).orderBy(order_col)
    island = F.coalesce(F.sum(complete.cast("int")).over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order_col, text_col))), lambda s: s[text_col]), "")
    return rows.withColumn("island", island).groupBy(id_col, "island").agg(F.max(order_col).alias(order_col), joined.alias("text")).drop("island")


def verse_changes(rows: DataFrame, id_col: str, order_col: str, levels: list[str]) -> DataFrame:
    """(id, order, level, value): one row for each level that changes; a change restarts the levels below it."""
    by_doc = Window.partitionBy(id_col).orderBy(order_col)
    told = rows
    for k, level in enumerate(levels):
        prefix = F.struct(*[F.col(c) for c in levels[: k + 1]])
        told = told.withColumn(f"__{level}", (F.row_number().over(by_doc) == 1) | ~prefix.eqNullSafe(F.lag(prefix).over(by_doc)))
    changed = [F.struct(F.lit(level).alias("level"), F.col(level).cast("string").alias("value"), F.col(f"__{level}").alias("changed")) for level in levels]
    return told.select(id_col, order_col, F.inline(F.array(*changed))).where("changed").drop("changed")
