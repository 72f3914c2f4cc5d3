"""Readings of manuscripts' hands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.refs import verse_levels
from quillspark.operators.xml_events import clean_transcription

FIRST_HAND = "firsthand"


def last_readings(readings: DataFrame, key_cols: list[str], hand_col: str, order_col: str, text_col: str) -> DataFrame:
    """(keys, hand, text): the last reading of each hand in each variant unit; a missing hand is the first hand, an empty one unknown."""
    hand = F.when(F.col(hand_col).isNull(), FIRST_HAND).when(F.col(hand_col) == "", "unknown").otherwise(F.col(hand_col))
    return readings.groupBy(*key_cols, hand.alias("hand")).agg(F.max_by(text_col, F.struct(order_col, text_col)).alias("text"))


def select_readings(readings: DataFrame, witnesses: DataFrame, doc_col: str, unit_col: str, hand_col: str, order_col: str, text_col: str) -> DataFrame:
    """(doc, hand, unit, text): for each hand of a manuscript and each of its units the hand's own last reading, else the first hand's.

    Hands and units meet within their manuscript only, by an equi-join.
    """
    last = last_readings(readings, [doc_col, unit_col], hand_col, order_col, text_col)
    units = last.select(doc_col, unit_col).distinct()
    wanted = witnesses.select(doc_col, F.col(hand_col).alias("hand")).distinct().join(units, doc_col)
    own = last.select(doc_col, unit_col, "hand", F.col("text").alias("own"))
    first = last.where(F.col("hand") == FIRST_HAND).select(doc_col, unit_col, F.col("text").alias("first"))
    return wanted.join(own, [doc_col, unit_col, "hand"], "left").join(first, [doc_col, unit_col], "left").select(doc_col, "hand", unit_col, F.coalesce("own", "first").alias("text"))


_APP = r"(?s)(<app\b[^>]*>.*?</app>|(?:(?!<app\b).)+)"
_RDG = r"(?s)(<rdg\b[^>]*/>|<rdg\b[^>]*>.*?</rdg>)"
_AB = r"<ab\b[^>]*\bn=\"([^\"]*)\"[^>]*>"


def _hand(reading: Column) -> Column:
    """The hand of a reading's tag, without the V of a supplement; none is the first hand, an empty one unknown."""
    tag = F.regexp_extract(reading, "^(<[^>]*>)", 1)
    own = F.regexp_replace(F.regexp_extract(tag, r"\bhand=\"([^\"]*)\"", 1), r"V+\z", "")
    return F.when(~tag.rlike(r"\bhand="), FIRST_HAND).when(own == "", "unknown").otherwise(own)


def witness_list(xml: Column) -> Column:
    """array<string> of the hands that a transcription lists, and ``unknown`` where a reading's hand is empty; none where there are no hands."""
    listed = F.transform(F.regexp_extract_all(xml, F.lit(r"<witness\b[^>]*\bid=\"([^\"]*)\""), F.lit(1)), lambda w: F.regexp_replace(w, r"V+\z", ""))
    return F.array_distinct(F.concat(listed, F.when(xml.rlike(r"<rdg\b[^>]*\bhand=\"\""), F.array(F.lit("unknown"))).otherwise(F.array().cast("array<string>"))))


def chosen_text(xml: Column, witness: Column) -> Column:
    """A transcription with one reading in each variant unit: the last one of the witness, else the last one of the first hand, else none."""

    def choose(unit: Column) -> Column:
        readings = F.regexp_extract_all(unit, F.lit(_RDG), F.lit(1))
        own = F.filter(readings, lambda r: _hand(r) == witness)
        first = F.filter(readings, lambda r: _hand(r) == FIRST_HAND)
        pick = F.coalesce(F.try_element_at(own, F.lit(-1)), F.try_element_at(first, F.lit(-1)), F.lit(""))
        return F.regexp_replace(pick, r"(?s)^<rdg\b[^>]*>|</rdg>\z", "")

    pieces = F.regexp_extract_all(xml, F.lit(_APP), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("<app"), choose(p)).otherwise(p)), "")


def verse_divisions(xml: Column) -> Column:
    """Verse codes of ``ab`` tags as divisions: one for each level that changes, and for those below it."""
    codes = F.transform(F.regexp_extract_all(xml, F.lit(_AB), F.lit(1)), verse_levels)
    between = F.split(xml, r"<ab\b[^>]*>", -1)

    def opened(k: Column) -> Column:
        now, before = F.get(codes, k), F.get(codes, k - 1)
        book = (k == 0) | ~now["book"].eqNullSafe(before["book"])
        chapter = book | ~now["chapter"].eqNullSafe(before["chapter"])
        verse = chapter | ~now["verse"].eqNullSafe(before["verse"])
        return F.concat(*[F.when(c & now[n].isNotNull(), F.concat(F.lit(f'<div type="{n}" n="'), now[n], F.lit('">'))).otherwise("") for n, c in (("book", book), ("chapter", chapter), ("verse", verse))])

    parts = F.transform(between, lambda t, k: F.when(k == 0, t).otherwise(F.concat(opened(k - 1), t)))
    return F.regexp_replace(F.array_join(parts, ""), r"</ab>", "")


def witness_texts(docs: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """(id, witness, text): the cleaned transcription of each hand of a manuscript, or of its first hand where it lists none, all tags but divisions gone.

    Everything is done on a document's own row: no tree is built, so that broken
    XML is read as far as it goes.
    """
    body = F.regexp_extract(F.col(xml_col), r"(?s)<body\b[^>]*>(.*?)(?:</body\s*>|\z)", 1)
    hands = F.when(F.size(witness_list(F.col(xml_col))) > 0, witness_list(F.col(xml_col))).otherwise(F.array(F.lit(FIRST_HAND)))
    rows = docs.where(F.col(xml_col).isNotNull()).select(F.col(id_col).alias("id__"), body.alias("body__"), F.explode(hands).alias("witness"))
    chosen = rows.withColumn("text", chosen_text(F.col("body__"), F.col("witness")))
    divided = verse_divisions(F.col("text"))
    return chosen.select(F.col("id__").alias(id_col), F.when(F.col("witness") == "*", "star").otherwise(F.col("witness")).alias("witness"), clean_transcription(F.regexp_replace(divided, r"\r?\n", ""), keep=("div",)).alias("text"))
