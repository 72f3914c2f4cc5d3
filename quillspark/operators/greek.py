"""The replacements of Greek words in their order: elision, crasis, movable letter, letter repairs, negation and preposition, sacred names.

Words are resolved once each and joined back to their tokens. Lexicons are
inputs of unknown size, so nothing is forced to be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import APOSTROPHE, APOSTROPHES, greek_text, one_apostrophe, plain_low
from quillspark.operators.lexicon import resolve_elision


@dataclass(frozen=True)
class Lexicons:
    """``elisions`` (key, value array), ``crases`` (key, value of two words), ``movable`` (form: plain forms that lose their last letter), ``sacra`` (key, value)."""

    elisions: DataFrame
    crases: DataFrame
    movable: DataFrame
    sacra: DataFrame
    require_mark: bool = False


def resolve_words(words: DataFrame, word_col: str, elisions: DataFrame, crases: DataFrame, movable: DataFrame, sacra: DataFrame, require_mark: bool = False) -> DataFrame:
    """(word, parts): each distinct word with the words it stands for; null words are left out.

    For the lexicons see ``Lexicons``. Words in ASCII letters are Greek in Latin
    letters.
    """
    w = F.lower(F.col("word"))
    base = words.select(F.col(word_col).alias("word")).where("word IS NOT NULL").distinct().withColumn("base", one_apostrophe(greek_text(w)))
    full = resolve_elision(base.select("base").distinct(), "base", elisions, require_mark=require_mark)
    told = base.join(full, "base", "left").select("word", F.coalesce(F.array_join("full", ","), F.col("base")).alias("elided"))
    pairs = crases.select(one_apostrophe(F.col("key")).alias("elided"), F.col("value").alias("pair")).dropDuplicates(["elided"])
    parts = told.join(pairs, "elided", "left").select("word", F.posexplode(F.split(F.coalesce("pair", "elided"), " ")).alias("part", "w")).withColumn("plain", plain_low(F.col("w")))
    nu = movable.select(F.col("form").alias("plain")).distinct().withColumn("moves", F.lit(True))
    cut = F.when(F.col("moves"), F.expr("substring(w, 1, length(w) - 1)")).otherwise(F.col("w"))
    letters = F.translate(F.regexp_replace(F.translate(cut, "ϲ", "σ"), r"σ\z", "ς"), "¯", "ν")
    repaired = parts.join(nu, "plain", "left").select("word", "part", "plain", letters.alias("w"))
    names = sacra.select(F.col("key").alias("w"), F.col("value").alias("name")).dropDuplicates(["w"])
    short = F.expr("substring(w, 1, length(w) - 1)")
    done = F.when(F.col("plain").isin("ουχ", "ουκ"), short).when(F.col("plain") == "εξ", F.concat(short, F.lit("κ"))).otherwise(F.coalesce("name", "w"))
    out = repaired.join(names, "w", "left").select("word", F.struct("part", done.alias("w")).alias("p"))
    return out.groupBy("word").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["w"]).alias("parts"))


def replace_tokens(tokens: DataFrame, keys: list[str], word_col: str, elisions: DataFrame, crases: DataFrame, movable: DataFrame, sacra: DataFrame, require_mark: bool = False) -> DataFrame:
    """Tokens (keys, pre, word, post) → (keys, part, pre, word, post, orig): the first part keeps ``pre`` and ``orig``, the last ``post``, whose apostrophe is the one of the lexicons."""
    parts = resolve_words(tokens, word_col, elisions, crases, movable, sacra, require_mark).withColumnRenamed("word", "word__")
    joined = tokens.join(parts, F.col(word_col) == F.col("word__"), "left")
    flat = joined.select(*keys, "pre", F.col(word_col).alias("orig"), "post", F.size("parts").alias("n__"), F.posexplode(F.coalesce("parts", F.array(F.col(word_col)))).alias("part", "word"))
    post = F.when(F.substring("post", 1, 1).isin(*APOSTROPHES, APOSTROPHE), F.concat(F.lit(APOSTROPHE), F.expr("substring(post, 2)"))).otherwise(F.col("post"))
    last = F.col("part") >= F.col("n__") - 1
    return flat.select(*keys, "part", F.when(F.col("part") == 0, F.col("pre")).otherwise("").alias("pre"), "word", F.when(last, post).otherwise(" ").alias("post"), F.when(F.col("part") == 0, F.col("orig")).otherwise("").alias("orig"))
