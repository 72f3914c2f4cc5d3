"""Reports on the quality of texts and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alphabet_faults(lines: DataFrame, line_col: str, allowed: str) -> DataFrame:
    """(line, faults): distinct lines with a character outside the class ``allowed``, and those characters, sorted; lines that open with ``@`` are metadata."""
    odd = f"([^{allowed}])"
    told = lines.where(~F.col(line_col).startswith("@") & F.col(line_col).rlike(odd)).select(F.col(line_col).alias("line")).distinct()
    return told.select("line", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("line", F.lit(odd), F.lit(1)))), "").alias("faults"))


def missing_fields(records: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field): each field of a record that is null or blank."""
    told = F.filter(F.array(*[F.when(F.coalesce(F.trim(c) == "", F.lit(True)), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    return records.select(id_col, F.explode(told).alias("field"))


def without_partner(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key is null or not in ``right``."""
    return left.join(right.select(key).distinct(), key, "left_anti")
