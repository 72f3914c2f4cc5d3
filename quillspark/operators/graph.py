"""The annotated-text graph: nodes, containment, features, their types and the text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def units_as_nodes(numbered: DataFrame, id_col: str) -> DataFrame:
    """(id, otype, seq, from_slot, to_slot) of the book, sentences and phrases of numbered slots."""
    kinds = F.array(
        F.struct(F.lit("_book").alias("otype"), F.lit(1).cast("long").alias("seq")),
        F.struct(F.lit("_phrase").alias("otype"), F.col("phrase").cast("long").alias("seq")),
        F.struct(F.lit("_sentence").alias("otype"), F.col("sentence").cast("long").alias("seq")),
    )
    return numbered.select(id_col, "slot", F.inline(kinds)).groupBy(id_col, "otype", "seq").agg(F.min("slot").alias("from_slot"), F.max("slot").alias("to_slot"))


def number_nodes(units: DataFrame, id_col: str) -> DataFrame:
    """``units`` with ``node``: after the last slot, by type in alphabetical order, then by number."""
    doc = Window.partitionBy(id_col)
    at = F.row_number().over(doc.orderBy("otype", "seq", "from_slot"))
    return units.select("*", (F.max("to_slot").over(doc) + at).alias("node"))


def containment(nodes: DataFrame, id_col: str) -> DataFrame:
    """(id, node, ranges): the slots of each node as ranges."""
    return nodes.groupBy(id_col, "node").agg(F.array_sort(F.collect_list(F.struct("from_slot", "to_slot"))).alias("ranges"))


def slot_ranges(slots: DataFrame, id_col: str, node_col: str) -> DataFrame:
    """(id, node, ranges) from rows (id, node, slot): runs without a gap become one range each."""
    run = F.col("slot") - F.row_number().over(Window.partitionBy(id_col, node_col).orderBy("slot"))
    runs = slots.select(id_col, node_col, "slot", run.alias("run")).groupBy(id_col, node_col, "run").agg(F.min("slot").alias("from_slot"), F.max("slot").alias("to_slot"))
    return runs.groupBy(id_col, node_col).agg(F.array_sort(F.collect_list(F.struct("from_slot", "to_slot"))).alias("ranges"))


def locate_slots(slots: DataFrame, ranges: DataFrame, id_col: str) -> DataFrame:
    """(id, slot, node): the node whose range holds each slot, for ranges (id, node, from_slot, to_slot) that don't overlap.

    No range join: slots and range starts are put in one order, and the last
    start before a slot is carried down to it.
    """
    null = F.lit(None).cast("long")
    points = slots.select(id_col, F.col("slot").alias("at"), F.lit(1).alias("kind"), null.alias("node"), null.alias("until"))
    starts = ranges.select(id_col, F.col("from_slot").alias("at"), F.lit(0).alias("kind"), F.col("node"), F.col("to_slot").alias("until"))
    last = Window.partitionBy(id_col).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("kind") == 0, F.struct("node", "until")), ignorenulls=True).over(last)
    return points.unionByName(starts).select(id_col, "at", "kind", carried.alias("c")).where((F.col("kind") == 1) & (F.col("c.until") >= F.col("at"))).select(id_col, F.col("at").alias("slot"), F.col("c.node").alias("node"))


def value_type(value_col: str) -> Column:
    """The aggregate ``int`` where every value is ASCII digits, else ``str``."""
    return F.when(F.bool_and(F.col(value_col).rlike(r"^[0-9]+\z")), "int").otherwise("str")


def value_types(features: DataFrame, feature_col: str, value_col: str) -> DataFrame:
    """(feature, value_type, values): int when every value is ASCII digits, else str; nulls don't count."""
    return features.groupBy(F.col(feature_col).alias("feature")).agg(value_type(value_col).alias("value_type"), F.count_distinct(value_col).alias("n_values"))


def as_int(value: Column) -> Column:
    return F.when(value.rlike(r"^[0-9]{1,18}\z"), value.cast("long"))


def feature_lines(features: DataFrame, id_col: str) -> DataFrame:
    """(id, feature, node, line): the text form of node features, with the node only where it doesn't follow the one before."""
    by_feature = Window.partitionBy(id_col, "feature").orderBy("node")
    value = F.replace(F.replace(F.coalesce("feature_value", F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t"))
    value = F.replace(value, F.lit("\n"), F.lit("\\n"))
    implicit = F.lag("node").over(by_feature) == F.col("node") - 1
    return features.select(id_col, "feature", "node", F.when(implicit, value).otherwise(F.concat(F.col("node").cast("string"), F.lit("\t"), value)).alias("line"))


def feature_header(types: DataFrame, meta: dict[str, str]) -> DataFrame:
    """(feature, header): the head of each feature's file: kind, metadata in order, value type."""
    lines = [F.lit("@node"), *[F.lit(f"@{k}={v}") for k, v in sorted(meta.items())], F.concat(F.lit("@valueType="), F.col("value_type"))]
    return types.select("feature", F.concat_ws("\n", *lines).alias("header"))


def overlap_everywhere(a: Column, b: Column) -> Column:
    """Whether two sequences of sets meet at every position (nulls and unequal lengths don't)."""
    return F.coalesce((F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(F.arrays_overlap(x, y), F.lit(False))), lambda x: x), F.lit(False))
