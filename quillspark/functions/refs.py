"""References, citation schemes and sigla as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_ref(ref: Column) -> Column:
    """Digits or letters alone stay; else cut at ``_``, keep the leading run of letters or of non-letters, then letters, digits and hyphens; letters at the end go unless there is nothing else."""
    cut = F.regexp_extract(ref, r"^([^_]*)", 1)
    run = F.when(cut.rlike(r"^\p{L}"), F.regexp_extract(cut, r"^(\p{L}+)", 1)).otherwise(F.regexp_extract(cut, r"^(\P{L}*)", 1))
    kept = F.regexp_replace(run, r"[^\p{L}\p{N}-]", "")
    bare = F.when(kept.rlike(r"^\p{L}+\z"), kept).otherwise(F.regexp_replace(kept, r"[A-Za-z]+\z", ""))
    return F.when(ref.rlike(r"^[0-9]+\z") | ref.rlike(r"^\p{L}+\z"), ref).otherwise(bare)


def scheme_parts(scheme: Column, sep: str = "/") -> Column:
    """Names of the levels, in small letters, empty ones dropped."""
    return F.filter(F.split(F.lower(scheme), sep), lambda x: x != "")


def align_right(parts: Column, n: Column) -> Column:
    """The last ``n`` parts; a shorter reference has nulls before it."""
    own = F.filter(parts, lambda x: x != "")
    short = F.concat(F.array_repeat(F.lit(None).cast("string"), F.greatest(n - F.size(own), F.lit(0))), own)
    return F.slice(short, F.size(short) - n + 1, n)


def verse_levels(ref: Column) -> Column:
    """struct<book, chapter, verse> of a code like B04K4V6."""
    return F.struct(*[F.nullif(F.regexp_extract(ref, r"^B([0-9]+)K([0-9]+)V([0-9]+)", k), F.lit("")).alias(n) for k, n in ((1, "book"), (2, "chapter"), (3, "verse"))])


def manuscript_siglum(number: Column, institution: Column | None = None) -> Column:
    """Five characters, the last no ``S``: 1 is a papyrus, 2 a majuscule, 3 a minuscule, 4 a lectionary, and zeros before the number go; other names stay. Two institutions have their letter before it."""
    kind = F.substring(number, 1, 1)
    mark = F.when(kind == "1", "P").when(kind == "2", "0").when(kind == "3", "").when(kind == "4", "L")
    named = F.when((F.length(number) == 5) & ~number.endswith("S"), F.coalesce(F.concat(mark, F.regexp_replace(F.substring(number, 2, 4), "^0+", "")), number)).otherwise(number)
    if institution is None:
        return named
    return F.concat(F.when(institution == "Birmingham", "B_").when(institution == "Muenster", "M_").otherwise(""), named)


def code_path(key: Column, from_file: bool = False) -> Column:
    """A work's folders by its code: its parts between spaces, or the first three between full stops of a file's name."""
    return F.array_join(F.slice(F.split(key, r"\."), 1, 3) if from_file else F.split(key, " +"), "/")


def first_of(*cols: Column, default: str) -> Column:
    """The first value that is there and not empty."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cols], F.lit(default))


def ordinal_label(n: Column) -> Column:
    th = F.when(n == 1, "1st").when(n == 2, "2nd").when(n == 3, "3rd").otherwise(F.concat(n.cast("string"), F.lit("th")))
    return F.concat(F.lit("structure feature of the "), th, F.lit(" level"))
