"""Segments: the stretches of rows or events from which slots are numbered, without a window over the slots themselves.

Every function takes rows (id, order, …) and orders them within their document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import core_word, orphans, slot_pieces

_ALL_BEFORE = (Window.unboundedPreceding, -1)


def carry_words(rows: DataFrame, id_col: str, order_col: str, text_col: str, on: Column | None = None) -> DataFrame:
    """``rows`` with ``body``: its text, a word broken at its end (by a hyphen or ``<``) moved to the next text; a space is put behind what isn't broken.

    A text of one broken word goes on as a whole; the last text of a document
    keeps its end. Rows for which ``on`` is false take no part and have null.
    """
    by_doc = Window.partitionBy(id_col).orderBy(order_col)
    takes = F.coalesce(on, F.lit(False)) if on is not None else F.lit(True)
    text = F.trim(F.coalesce(F.col(text_col), F.lit("")))
    last = F.max(F.when(F.col("takes__"), F.col(order_col))).over(Window.partitionBy(id_col)) == F.col(order_col)
    out = rows.withColumn("takes__", takes).withColumn("open__", F.col("takes__") & text.rlike(r"[-<]\z") & ~last)
    single = F.col("open__") & ~text.contains(" ")
    bare = F.regexp_replace(text, r"[-<]+\z", "")
    out = out.withColumn("single__", single).withColumn("island__", F.coalesce(F.sum((F.col("takes__") & ~single).cast("int")).over(by_doc.rowsBetween(*_ALL_BEFORE)), F.lit(0)))
    tail = F.struct(F.when(F.col("open__"), F.regexp_extract(bare, r"([^ ]*)\z", 1)).otherwise("").alias("t"))
    handed = F.last(F.when(F.col("takes__") & ~F.col("single__"), tail), ignorenulls=True).over(by_doc.rowsBetween(*_ALL_BEFORE))["t"]
    chain = F.collect_list(F.when(F.col("single__"), bare)).over(Window.partitionBy(id_col, "island__").orderBy(order_col).rowsBetween(*_ALL_BEFORE))
    own = F.when(F.col("open__"), F.regexp_replace(bare, r"[^ ]*\z", "")).otherwise(text)
    body = F.concat(F.coalesce(handed, F.lit("")), F.array_join(chain, ""), own)
    spaced = F.when((body == "") | body.rlike(r"[-<\s]\z"), body).otherwise(F.concat(body, F.lit(" ")))
    return out.withColumn("body", F.when(F.col("takes__"), F.when(F.col("single__"), "").otherwise(spaced))).drop("takes__", "open__", "single__", "island__")


def cut_heads(rows: DataFrame, id_col: str, order_col: str, body_col: str) -> DataFrame:
    """``rows`` cut at heads in braces, with ``seg`` (from 0), ``body`` (null in a head), ``head`` (null outside) and ``head_no``, which a head keeps over rows.

    A brace that opens within a head opens none, one that closes outside is text.
    """
    by_doc = Window.partitionBy(id_col).orderBy(order_col)
    brace = F.nullif(F.regexp_extract(F.col(body_col), r"(?s)^.*([{}])", 1), F.lit(""))
    inside = F.coalesce(F.last(brace, ignorenulls=True).over(by_doc.rowsBetween(*_ALL_BEFORE)) == "{", F.lit(False))
    marked = rows.withColumn("marked__", F.when(inside, F.concat(F.lit("\x02"), F.col(body_col))).otherwise(F.col(body_col))).drop(*({"body"} & set(rows.columns)))
    pieces = F.regexp_extract_all("marked__", F.lit("((?s)\x02[^}]*\\}? ?|\\{[^}]*\\}? ?|[^{\x02]+)"), F.lit(1))
    cut = marked.select(*[c for c in marked.columns if c != "marked__"], F.posexplode_outer(pieces).alias("seg", "piece__"))
    is_head = F.coalesce(F.col("piece__").rlike("^[{\x02]"), F.lit(False))
    starts = F.coalesce(F.col("piece__").startswith("{"), F.lit(False)).cast("int")
    number = F.sum(starts).over(Window.partitionBy(id_col).orderBy(order_col, "seg").rowsBetween(Window.unboundedPreceding, 0))
    return cut.select("*", F.when(~is_head, F.col("piece__")).alias("body"), F.when(is_head, F.translate("piece__", "\x02", "")).alias("head"), F.when(is_head, number).alias("head_no")).drop("piece__").withColumn("seg", F.coalesce("seg", F.lit(0)))


def resolved(pieces: Column, contractions: tuple[tuple[str, str], ...], cased: bool) -> Column:
    """array<struct<pre, word, post, whole, part>>: contractions as several words; the first keeps ``pre``, the last ``post``, ``whole`` is the word before, on the first only."""
    known = F.create_map(*[F.lit(x) for pair in contractions for x in pair]) if contractions else None

    def parts(piece: Column) -> Column:
        word = core_word(piece["core"], cased)
        one = F.array(F.struct(piece["pre"].alias("pre"), word.alias("word"), piece["post"].alias("post"), word.alias("whole"), F.lit(0).alias("part")))
        if known is None:
            return one
        found = F.element_at(known, F.lower(word))
        words = F.split(found, " ")
        several = F.transform(
            words,
            lambda w, k: F.struct(F.when(k == 0, piece["pre"]).otherwise("").alias("pre"), w.alias("word"), F.when(k == F.size(words) - 1, piece["post"]).otherwise(" ").alias("post"), F.when(k == 0, word).otherwise("").alias("whole"), k.alias("part")),
        )
        return F.when(found.isNull(), one).otherwise(several)

    return F.flatten(F.transform(pieces, parts))


def counted(segments: DataFrame, id_col: str, order: list[str], body_col: str, contractions: tuple[tuple[str, str], ...] = (), cased: bool = True, tokenizer: Callable[[Column, bool], Column] = slot_pieces) -> DataFrame:
    """``segments`` with ``words`` (see ``resolved``), their number ``n`` and ``before``, the slots of the document before them.

    Punctuation at the start of a body that stands apart from its first word, as
    well as a body without a word, goes behind the last word before it, or at
    the start of a document before its first word.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    by_doc = Window.partitionBy(id_col).orderBy(*order)
    # bodies with a word before each; what stands apart is joined once for each such number, and put behind that word's body
    has = body.rlike(r"[\p{Lu}\p{Ll}\p{Lt}]" if cased else r"\p{L}")
    out = segments.withColumn("apart__", orphans(body, cased)).withColumn("island__", F.coalesce(F.sum(has.cast("int")).over(by_doc.rowsBetween(*_ALL_BEFORE)), F.lit(0)))
    part = F.array_sort(F.collect_list(F.struct(*order, F.col("apart__").alias("t__"))))
    loose = out.where("apart__ <> ''").groupBy(F.col(id_col).alias("id__"), F.col("island__").alias("no__")).agg(F.array_join(F.transform(part, lambda x: x["t__"]), "").alias("loose__"))
    out = out.withColumn("words", resolved(tokenizer(F.substring(body, F.length("apart__") + 1, F.length(body)), cased), contractions, cased)).withColumn("n", F.size("words"))
    out = out.withColumn("before", F.coalesce(F.sum("n").over(by_doc.rowsBetween(*_ALL_BEFORE)), F.lit(0)))
    behind, first = loose.withColumnRenamed("loose__", "behind__"), loose.where("no__ = 0").select(F.col("id__").alias("id2__"), F.col("loose__").alias("first__"))
    out = out.join(behind, F.col(id_col).eqNullSafe(F.col("id__")) & (F.col("n") > 0) & (F.col("island__") + 1 == F.col("no__")), "left")
    out = out.join(first, F.col(id_col).eqNullSafe(F.col("id2__")) & (F.col("n") > 0) & (F.col("island__") == 0), "left")
    moved = F.transform(
        "words",
        lambda w, k: w.withField("pre", F.when(k == 0, F.concat(F.coalesce("first__", F.lit("")), w["pre"])).otherwise(w["pre"])).withField("post", F.when(k == F.col("n") - 1, F.concat(w["post"], F.coalesce("behind__", F.lit("")))).otherwise(w["post"])),
    )
    touched = F.col("behind__").isNotNull() | F.col("first__").isNotNull()
    return out.withColumn("words", F.when(touched, moved).otherwise(F.col("words"))).drop("apart__", "island__", "id__", "no__", "behind__", "id2__", "first__")
