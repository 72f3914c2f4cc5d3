"""Tokens and word forms as Column expressions."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters are cased letters and marks; separators are spaces; all else is other.
LETTER = r"\p{Lu}\p{Ll}\p{Lt}\p{M}"
_L, _NL, _S, _O = f"[{LETTER}]", f"[^{LETTER}]", r"\p{Z}", rf"[^{LETTER}\p{{Z}}]"
#: One token: punctuation up to a space; or a word with what stands around it; or a text's last punctuation.
TOKEN = (
    rf"(?:{_NL}{_O}*{_S})"
    rf"|(?:{_NL}?{_O}*)(?:{_L}+(?:{_O}*[-<]{_L}+)*)(?:{_O}*{_S}(?:{_NL}*{_S})?|{_O}*)"
    rf"|(?:{_NL}{_O}*)\z"
)
#: Letters only, glued over inner punctuation up to a space.
CLEAN_WORD = rf"{_L}(?:{_O}*{_L}+)*"

APOSTROPHES = "᾿'ʼʹ’"
APOSTROPHE = "᾽"


def tokens(text: Column) -> Column:
    """array<string> of whole tokens; joined they give the text again."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def token_parts(token: Column) -> Column:
    """struct<pre, word, post>; a token without a letter is all ``pre``."""
    return F.struct(
        F.btrim(F.regexp_extract(token, rf"^({_NL}*)", 1), F.lit("\n")).alias("pre"),
        F.regexp_replace(token, _NL, "").alias("word"),
        F.btrim(F.when(token.rlike(_L), F.regexp_replace(token, rf"^{_NL}*{_L}+(?:{_O}*[-<]{_L}+)*", "")).otherwise(""), F.lit("\n")).alias("post"),
    )


def _slot_patterns(cased: bool) -> tuple[str, str]:
    """A slot as (before, word, after), and what a line begins with that belongs to the word before it, as a line without a word does as a whole."""
    kinds = r"\p{Lu}\p{Ll}\p{Lt}" if cased else r"\p{L}"
    c, nc, oc = f"[{kinds}]", f"[^{kinds}]", rf"[^{kinds}\p{{Z}}]"
    run = rf"{c}[{kinds}\p{{M}}]*"
    slot = rf"(\A{nc}*|{oc}*)({run}(?:{oc}*[-<]{run})*)({nc}*\z|{oc}*{_S}(?:{nc}*{_S})?|{oc}*)"
    return slot, rf"^((?:{nc}{oc}*{_S})+|{nc}*\z)"


def slot_pieces(text: Column, cased: bool = True) -> Column:
    """array<struct<pre, core, post>> of the words; joined they give the text again. Cores keep inner punctuation, see ``core_word``.

    A word begins with a letter with case or, with ``cased=False``, with any
    letter. What has none belongs to the word before it, at a text's start to
    the first one.
    """
    pattern = F.lit(_slot_patterns(cased)[0])
    pre, core, post = (F.regexp_extract_all(text, pattern, F.lit(k)) for k in (1, 2, 3))
    return F.arrays_zip(pre.alias("pre"), core.alias("core"), post.alias("post"))


def core_word(core: Column, cased: bool = True) -> Column:
    return F.regexp_replace(core, _NL if cased else r"[^\p{L}\p{M}]", "")


def orphans(text: Column, cased: bool = True) -> Column:
    """Punctuation at a text's start that stands apart from its first word; a text without a word as a whole."""
    return F.regexp_extract(text, _slot_patterns(cased)[1], 1)


def clean_words(text: Column) -> Column:
    """array<string> of words, inner punctuation dropped."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({CLEAN_WORD})"), F.lit(1)), lambda w: F.regexp_replace(w, _NL, ""))


@functools.cache
def _bare_letters() -> tuple[str, str]:
    """Precomposed cased letters and their letters without marks; capital sigma goes to its plain small form."""
    src, dst = ["Σ"], ["σ"]
    for cp in [*range(0xC0, 0x590), *range(0x1E00, 0x2000), *range(0x2C00, 0x2E00), *range(0xA640, 0xA800)]:
        ch = chr(cp)
        if unicodedata.category(ch) in ("Lu", "Ll", "Lt"):
            bare = "".join(c for c in unicodedata.normalize("NFD", ch) if not unicodedata.combining(c))
            if bare != ch and len(bare) == 1:
                src.append(ch)
                dst.append("σ" if bare == "Σ" else bare)
    return "".join(src), "".join(dst)


def strip_marks(c: Column) -> Column:
    """Cased letters without their marks; all else goes."""
    src, dst = _bare_letters()
    return F.regexp_replace(F.translate(c, src, dst), r"[^\p{Lu}\p{Ll}\p{Lt}]", "")


def plain_low(c: Column) -> Column:
    return F.lower(strip_marks(c))


def plain_caps(c: Column) -> Column:
    return F.upper(plain_low(c))


def strip_all_letters(c: Column) -> Column:
    """Like ``plain_low``, but letters of every category stay."""
    src, dst = _bare_letters()
    return F.lower(F.regexp_replace(F.translate(c, src, dst), r"[^\p{L}]", ""))


def alternatives(c: Column, form=lambda x: x) -> Column:
    """Comma-separated alternatives, each in its form, once, in order."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(F.split(c, ","), form))), ",")


def main_word(c: Column) -> Column:
    return alternatives(F.lower(c))


def plain_word(c: Column) -> Column:
    return alternatives(c, plain_low)


def clean_plain(c: Column) -> Column:
    return F.regexp_replace(c, "[ινσς]", "")


def split_left(c: Column) -> Column:
    """struct<punc, word>: what stands before the first letter, and the rest."""
    return F.struct(F.regexp_extract(c, rf"^({_NL}*)", 1).alias("punc"), F.regexp_replace(c, rf"^{_NL}*", "").alias("word"))


def split_right(c: Column) -> Column:
    return F.struct(F.regexp_replace(c, rf"{_NL}*\z", "").alias("word"), F.regexp_extract(c, rf"({_NL}*)\z", 1).alias("punc"))


def minuscule(words: Column) -> Column:
    """Words joined by spaces, marks dropped, punctuation kept, in small letters."""
    src, dst = _bare_letters()
    return F.lower(F.regexp_replace(F.translate(F.array_join(words, " "), src, dst), r"\p{M}", ""))


def majuscule(words: Column) -> Column:
    return F.upper(minuscule(words))


def one_apostrophe(c: Column) -> Column:
    return F.translate(c, APOSTROPHES, APOSTROPHE * len(APOSTROPHES))


def greek_letters(c: Column) -> Column:
    """Letter repairs in order: lunate sigma, sigma at the end, macron for final nu, then the negation's and preposition's short forms."""
    c = F.translate(F.lower(c), "ϲ", "σ")
    c = F.regexp_replace(c, r"σ\z", "ς")
    c = F.regexp_replace(c, r"̄\z|¯\z", "ν")
    return F.when(c.isin("ουχ", "ουκ"), "ου").when(c == "εξ", "εκ").otherwise(c)


def greek_word(c: Column) -> Column:
    """A word in small letters with its marks, lunate and last sigma and the sign for nu repaired."""
    return F.translate(F.regexp_replace(F.translate(F.lower(c), "ϲ", "σ"), r"σ\z", "ς"), "¯", "ν")


#: The usual Latin letters for Greek ones.
GREEK_TO_LATIN = ("αβγδεζηθικλμνξοπρσςτυφχψω", "abgdezhqiklmncoprsstufxyw")


def to_latin(c: Column) -> Column:
    return F.translate(c, *GREEK_TO_LATIN)


def to_greek(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(c), "abgdezhqiklmncoprstufxyw", "αβγδεζηθικλμνξοπρστυφχψω"), r"σ(?!\p{L})", "ς")


# The signs of marks in Greek written with Latin letters, and the combining marks.
BETA_MARKS = (")(/\\=|+", "\u0313\u0314\u0301\u0300\u0342\u0345\u0308")


def beta_to_greek(c: Column) -> Column:
    """Greek written in Latin letters with signs for its marks (``lo/gos``, ``*)aqh=nai``) in Greek letters with combining marks: a star makes the next letter a capital, whose marks stand before it."""
    c = F.lower(c)
    for letter, capital in zip("abgdezhqiklmncoprstufxyw", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", strict=True):
        c = F.regexp_replace(c, rf"\*([)(/\\=|+]*){letter}", f"{capital}$1")
    marks = F.translate(c, *BETA_MARKS)
    return F.regexp_replace(F.translate(marks, "abgdezhqiklmncoprstufxywj", "αβγδεζηθικλμνξοπρστυφχψως"), r"σ(?![\p{L}\p{M}])", "ς")


def is_ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7F]*\z")


def greek_text(c: Column) -> Column:
    """Text that is all ASCII as Greek written in Latin letters, other text as it is."""
    return F.when(is_ascii(c), beta_to_greek(c)).otherwise(c)


def ends_open(c: Column) -> Column:
    """Text that goes on in the next row: a hyphen or ``<`` at its end."""
    return c.rlike(r"[-<]\z")


def join_lines(c: Column) -> Column:
    """Lines joined by a space, or by nothing after a hyphen, which stays."""
    return F.regexp_replace(F.regexp_replace(c, r"-[ \t]*\r?\n\s*", "-"), r"\r?\n", " ")


def author_case(c: Column) -> Column:
    """Words with a capital, ``of`` and ``the`` small."""
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.when(F.lower(w).isin("of", "the"), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000))))), " ")
