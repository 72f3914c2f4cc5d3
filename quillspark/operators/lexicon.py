"""Look-ups in lexicons: elision, contraction, movable letters, lemmata; and lexicons made from others.

Lexicons are inputs of unknown size, so nothing is forced to be broadcast;
Spark does so below its size threshold and else joins by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import APOSTROPHE, plain_low


def candidate_keys(word: Column, mark: str = APOSTROPHE) -> Column:
    """The keys of an elided word by rank: mark behind, none, before, on both sides."""
    return F.array(F.concat(word, F.lit(mark)), word, F.concat(F.lit(mark), word), F.concat(F.lit(mark), word, F.lit(mark)))


def with_plain_keys(lexicon: DataFrame, mark: str = APOSTROPHE) -> DataFrame:
    """(key, exact, value) of a lexicon (key, value array): its keys, and their plain forms with the values of all keys that share them."""
    end = lambda side: F.when(side, F.lit(mark)).otherwise("")
    k = F.col("key")
    plain = F.concat(end(k.startswith(mark)), plain_low(k), end((F.length(k) > 1) & k.endswith(mark)))
    grouped = lexicon.select(plain.alias("key"), F.explode("value").alias("v")).groupBy("key").agg(F.array_sort(F.collect_set("v")).alias("value"))
    return lexicon.select("key", F.lit(True).alias("exact"), F.array_sort("value").alias("value")).unionByName(grouped.select("key", F.lit(False).alias("exact"), "value"))


def resolve_elision(words: DataFrame, word_col: str, lexicon: DataFrame, mark: str = APOSTROPHE, require_mark: bool = True) -> DataFrame:
    """``words`` (distinct) with ``full``, the sorted values of the first key that the lexicon (key, value array) has.

    Keys are tried by rank (see ``candidate_keys``), each first as it is, then in
    its plain form. With ``require_mark`` the bare word is no key, as it would
    fire on any equal stem. Words go by once: their keys are joined to the
    lexicon, and the best one is kept.
    """
    tries = F.array(F.struct(F.lit(True).alias("exact"), F.col(word_col).alias("w")), F.struct(F.lit(False).alias("exact"), plain_low(F.col(word_col)).alias("w")))
    keys = words.select(word_col, F.inline(tries)).select(word_col, "exact", F.posexplode(candidate_keys(F.col("w"), mark)).alias("rank", "key"))
    if require_mark:
        keys = keys.where("rank <> 1")
    hits = keys.join(with_plain_keys(lexicon.select("key", "value"), mark), ["key", "exact"], "left")
    best = F.min(F.when(F.col("value").isNotNull(), F.struct("rank", (~F.col("exact")).alias("plain"), "value")))
    return hits.groupBy(word_col).agg(best["value"].alias("full"))


def resolve_names(words: DataFrame, word_col: str, lexicon: DataFrame) -> DataFrame:
    """``words`` with ``full``: abbreviated names by a lexicon (key, value), other words as they are."""
    lex = lexicon.select(F.col("key").alias("key__"), F.col("value").alias("value__")).dropDuplicates(["key__"])
    return words.join(lex, F.col(word_col) == F.col("key__"), "left").select(*[words[c] for c in words.columns], F.coalesce("value__", word_col).alias("full"))


def resolve_contraction(tokens: DataFrame, keys: list[str], word_col: str, lexicon: DataFrame) -> DataFrame:
    """Tokens (keys, pre, word, post) with contractions (key, value of two words) as two rows: the first keeps ``pre``, the last ``post``; ``orig`` stays on the first."""
    joined = tokens.join(lexicon.select(F.col("key").alias("key__"), F.col("value").alias("value__")), F.lower(F.col(word_col)) == F.col("key__"), "left")
    parts = joined.select(*keys, "pre", F.col(word_col).alias("whole"), "post", F.posexplode(F.coalesce(F.split("value__", " "), F.array(F.col(word_col)))).alias("part", "word"), (F.coalesce(F.size(F.split("value__", " ")), F.lit(1)) - 1).alias("last"))
    return parts.select(
        *keys,
        "part",
        F.when(F.col("part") == 0, F.col("pre")).otherwise("").alias("pre"),
        "word",
        F.when(F.col("part") == F.col("last"), F.col("post")).otherwise(" ").alias("post"),
        F.when(F.col("part") == 0, F.col("whole")).otherwise("").alias("orig"),
    )


def with_movable(words: DataFrame, word_col: str, letter: str) -> DataFrame:
    """Words that end in a movable letter and stand without it in the same column; a semi-join."""
    stems = words.select(F.col(word_col).alias("stem__")).distinct()
    ends = words.where(F.col(word_col).endswith(letter))
    return ends.join(stems, F.expr(f"substring({word_col}, 1, length({word_col}) - {len(letter)})") == F.col("stem__"), "left_semi")


def lemma_cascade(words: DataFrame, lang_col: str, form_col: str, plain_col: str, lemmata: DataFrame, norm_col: str | None = None) -> DataFrame:
    """``words`` with ``lemma``: by exact form, else by the normalised form where one is given, else by plain form, else ``*`` and the plain form; several joined by commas, sorted."""
    lex = lemmata.groupBy("lang", "form").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lemma")))).alias("found"))
    joined, found = words, []
    for k, form in enumerate([F.lower(form_col), *([F.col(norm_col)] if norm_col else []), F.col(plain_col)]):
        own = lex.select(F.col("lang").alias(f"l{k}__"), F.col("form").alias(f"f{k}__"), F.col("found").alias(f"by{k}__"))
        joined = joined.join(own, (F.col(lang_col) == F.col(f"l{k}__")) & (form == F.col(f"f{k}__")), "left")
        found.append(F.array_join(f"by{k}__", ","))
    return joined.select(*[words[c] for c in words.columns], F.coalesce(*found, F.concat(F.lit("*"), F.col(plain_col))).alias("lemma"))


def lemma_of(words: DataFrame, form_col: str, plain_col: str, lemmata: DataFrame) -> DataFrame:
    """``words`` with ``lemma`` by lexicon entries (form, lemma array) of one language: by form, else by plain form, else ``*`` and the plain form."""
    lex = lemmata.select(F.lit("").alias("lang"), "form", "lemma")
    return lemma_cascade(words.withColumn("lang__", F.lit("")), "lang__", form_col, plain_col, lex).drop("lang__")


def build_lexicon(entries: DataFrame, form_col: str, lemma_col: str, *more: DataFrame) -> DataFrame:
    """(form, lemmata): every form and its plain form with the sorted set of their lemmata (an array column), from any number of sources with the same two columns."""
    for source in more:
        entries = entries.select(form_col, lemma_col).unionByName(source.select(form_col, lemma_col))
    keys = entries.select(F.explode(F.array_distinct(F.array(F.col(form_col), plain_low(F.col(form_col))))).alias("form"), F.explode(lemma_col).alias("lemma"))
    return keys.where("form <> ''").groupBy("form").agg(F.array_sort(F.collect_set("lemma")).alias("lemmata"))


def only_absent(base: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """``base`` and those rows of ``derived`` whose key it lacks."""
    return base.unionByName(derived.join(base.select(key).distinct(), key, "left_anti"))


def coverage(slots: DataFrame, by: list[str], lemma_col: str) -> DataFrame:
    """Share of slots with a known lemma, per cent, as ``75.0%``; a lemma with ``*`` is unknown, null and empty ones don't count."""
    told = slots.where(F.col(lemma_col) != "")
    hit = F.count_if(~F.col(lemma_col).startswith("*"))
    return told.groupBy(*by).agg(hit.alias("known"), F.count("*").alias("told"), F.concat(F.round(F.lit(100.0) * hit / F.count("*"), 2).cast("double").cast("string"), F.lit("%")).alias("coverage"))
