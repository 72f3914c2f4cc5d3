"""From texts to slots, and the sentences and phrases that bare marks make of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import core_word, plain_low, slot_pieces, token_parts, tokens
from quillspark.session import spread

SENTENCE_MARKS = ".?!"
PHRASE_MARKS = ",;:"


def explode_tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token_no, pre, word, post) of every token, also of those without letters."""
    src = spread(df.select(id_col, text_col), id_col).select(F.col(id_col).alias("id"), F.posexplode(tokens(F.col(text_col))).alias("at", "token"))
    return src.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("token_no"), token_parts(F.col("token")).alias("t")).select(id_col, "token_no", "t.*")


def explode_slots(df: DataFrame, id_col: str, text_col: str, cased: bool = True) -> DataFrame:
    """(id, slot, pre, orig, post, plain): slots from 1, numbered within the row, so without a shuffle.

    Punctuation, digits and letters without case belong to the word before them,
    at the start of a text to its first word; a text without a word has no slot.
    """
    src = spread(df.select(id_col, text_col), id_col).select(F.col(id_col).alias("id"), F.posexplode(slot_pieces(F.col(text_col), cased)).alias("at", "t"))
    cut = src.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("slot"), F.btrim("t.pre", F.lit("\n")).alias("pre"), core_word(F.col("t.core"), cased).alias("orig"), F.btrim("t.post", F.lit("\n")).alias("post"))
    return cut.select("*", plain_low(F.col("orig")).alias("plain"))


def has_mark(post: Column, marks: str) -> Column:
    return post.rlike("[" + "".join("\\" + m for m in marks) + "]")


def number_units(slots: DataFrame, id_col: str, sentence_marks: str = SENTENCE_MARKS, phrase_marks: str = PHRASE_MARKS) -> DataFrame:
    """``slots`` with the running numbers of their sentence and phrase, both from 1; a unit ends after the slot whose post has a mark."""
    before = Window.partitionBy(id_col).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    ends = has_mark(F.col("post"), sentence_marks).cast("int")
    breaks = has_mark(F.col("post"), sentence_marks + phrase_marks).cast("int")
    return slots.select("*", (F.coalesce(F.sum(ends).over(before), F.lit(0)) + 1).alias("sentence"), (F.coalesce(F.sum(breaks).over(before), F.lit(0)) + 1).alias("phrase"))


def once(slots: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """The last delivery of each key; reduced on both sides of the shuffle."""
    rest = [c for c in slots.columns if c not in keys]
    return slots.groupBy(*keys).agg(F.max(F.struct(order_col, *[c for c in rest if c != order_col])).alias("last__")).select(*keys, *[F.col("last__")[c].alias(c) for c in rest])


def render(slots: DataFrame, id_col: str, columns: list[str], name: str = "text") -> DataFrame:
    """(id, text): the columns of every slot, in slot order, joined."""
    part = F.concat(*[F.coalesce(F.col(c), F.lit("")) for c in columns])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", part.alias("part")))), lambda s: s["part"]), "")
    return slots.groupBy(id_col).agg(joined.alias(name))
