"""Several values packed in one field: one row for each value, with its position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Quotation marks that can enclose a value, as one pattern for each pair.
QUOTED = "|".join(
    [
        r'"(?:[^"]|"")*"',
        "«[^»]*»",
        "“[^”]*”",
        "„[^“”]*[“”]",
        "‹[^›]*›",
        "「[^」]*」",
        r"(?<![\p{L}\p{M}\p{N}.)])['‘](?:[^'’]|['’](?=[\p{L}\p{N}]))*['’](?![\p{L}\p{N}])",
    ]
)
# What separates values; hyphens, apostrophes, full stops and round brackets don't.
DELIMITERS = r"[\p{P}\p{S}\p{Cc}  &&[^\-‐‑'’.()]]+"

_OPEN, _CLOSE, _ESCAPED = "", "", "z"


def _placeholder(k: Column) -> Column:
    return F.concat(F.lit(_OPEN), k.cast("string"), F.lit(_CLOSE))


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s  -  　]+|[\s  -  　]+$", "")


def _unquote(span: Column) -> Column:
    inner = F.substring(span, F.lit(2), F.length(span) - 2)
    return F.when(span.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(inner)


def split_packed(packed: Column) -> Column:
    """array<string> of the values in the order written; null stays null, a blank field gives an empty array.

    Quoted spans are replaced by numbered placeholders (a placeholder's opening
    character that the field itself holds is escaped first, so none can
    collide), the rest is split at delimiters, and the spans come back by look-up
    in their array. A mark that is never closed separates like other punctuation.
    """
    safe = F.replace(packed, F.lit(_OPEN), F.lit(_ESCAPED))
    spans = F.regexp_extract_all(safe, F.lit(f"({QUOTED})"), F.lit(1))
    between = F.split(safe, QUOTED, -1)
    masked = F.array_join(F.transform(between, lambda p, k: F.when(k < F.size(spans), F.concat(p, _placeholder(k))).otherwise(p)), "")
    levels = F.split(masked, DELIMITERS, -1)

    def restore(level: Column) -> Column:
        trimmed = _trim(level)
        alone = F.regexp_extract(trimmed, f"^{_OPEN}([0-9]+){_CLOSE}$", 1)
        inside = F.transform(F.regexp_extract_all(trimmed, F.lit(f"{_OPEN}([0-9]+){_CLOSE}"), F.lit(1)), lambda k: k.cast("int"))
        back = F.aggregate(inside, trimmed, lambda acc, k: F.replace(acc, _placeholder(k), F.get(spans, k)))
        whole = F.when(alone != "", _unquote(F.get(spans, alone.cast("int")))).otherwise(back)
        return F.lower(_trim(F.replace(whole, F.lit(_ESCAPED), F.lit(_OPEN))))

    return F.filter(F.transform(levels, restore), lambda v: v != "")


def explode_packed(df: DataFrame, id_col: str, packed_col: str, order_col: str | None = None, pos_name: str = "pos", value_name: str = "level_name") -> DataFrame:
    """Rows (id, pos, value), pos from 1, once for each id.

    Of rows with the same id the one with the greatest ``order_col`` counts;
    rows with a null id are told apart by the packed field itself. Null and
    blank fields give no rows; other columns are not looked at.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(packed_col).cast("string").alias("packed"), (F.col(order_col) if order_col else F.lit(None).cast("timestamp")).alias("ord"))
    once = (
        src.groupBy("id", F.when(F.col("id").isNull(), F.col("packed")).alias("own"))
        .agg(F.max(F.struct("ord", "packed")).alias("last"))
        .select("id", F.posexplode(split_packed(F.col("last.packed"))).alias("at", "value"))
    )
    return once.select(F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias(pos_name), F.col("value").alias(value_name))
