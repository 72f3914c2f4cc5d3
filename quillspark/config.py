"""Language profiles: what differs between languages and editions, as frozen settings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as T


@dataclass(frozen=True)
class Format:
    """A text form of a slot: from its word, or from the word before contractions are resolved."""

    function: Callable[[Column], Column]
    template: str = "{pre}{}{post}"
    before_replace: bool = False
    description: str = ""
    title: str = ""


@dataclass(frozen=True)
class HeaderBlock:
    """A block of a header: one field for each tag below it, or all its text in one field."""

    joined: bool = True
    delimiter: str = ", "
    end: str = "."


ORIG = Format(lambda w: w, before_replace=True, description="original format of the word", title="fmt:text-orig-orig")
MAIN = Format(T.main_word, "{} ", before_replace=True, description="word in small letters, without punctuation", title="fmt:text-orig-main")
PLAIN = Format(T.plain_low, "{} ", description="plain format in lowercase", title="fmt:text-orig-plain")


@dataclass(frozen=True)
class Profile:
    name: str = "generic"
    sentence_marks: str = ".?!"
    phrase_marks: str = ",;:"
    formats: dict[str, Format] = field(default_factory=lambda: {"orig": ORIG, "main": MAIN, "plain": PLAIN})
    #: Only letters with case make words; else letters of all scripts.
    cased: bool = True
    #: From a text and ``cased`` to array<struct<pre, core, post>>.
    tokenizer: Callable[[Column, bool], Column] = T.slot_pieces
    #: Text in braces is a head, not part of the text.
    bracket_heads: bool = False
    contractions: tuple[tuple[str, str], ...] = ()
    section_tags: tuple[str, ...] = ("div",)
    section_keys: tuple[str, ...] = ("subtype",)
    non_section_keys: tuple[str, ...] = ()
    non_section_values: tuple[str, ...] = ()
    ignored_attributes: tuple[str, ...] = ()
    feature_attributes: tuple[str, ...] = ("corresp", "source")
    non_text_tags: tuple[str, ...] = ()
    corrections: tuple[tuple[str, str], ...] = ()
    header_blocks: dict[str, HeaderBlock] = field(default_factory=lambda: {"titleStmt": HeaderBlock(False, ", ", ""), **{n: HeaderBlock() for n in ("publicationStmt", "sourceDesc", "license", "availability")}})
    metadata: tuple[tuple[str, str], ...] = ()


GENERIC = Profile()
LATIN = replace(GENERIC, name="latin")
GREEK = replace(
    GENERIC,
    name="greek",
    sentence_marks=".;",
    phrase_marks=",··:",
    formats={
        "orig": ORIG,
        "plain": replace(PLAIN, function=lambda w: T.alternatives(w, lambda x: T.greek_letters(T.plain_low(x)))),
        "norm": Format(lambda w: T.alternatives(w, T.greek_word), "{} ", description="word with its letters repaired", title="fmt:text-orig-norm"),
        "plain_reduced": Format(lambda w: T.clean_plain(T.plain_word(w)), "{} ", description="plain format without ι, ν, σ, ς", title="fmt:text-orig-plain-reduced"),
        "beta_plain": Format(lambda w: T.to_latin(T.plain_low(w)), "{} ", description="plain format in Latin letters", title="fmt:text-trans-plain-betacode"),
    },
    section_tags=("div", "milestone", "state"),
    ignored_attributes=("corresp", "merge", "resp", "id", "xml:id", "source"),
    # Keys and values of attributes that name pages, lines and other editions' numbers, not sections.
    non_section_keys=("altpage", "altpage1", "altnumbering", "altref", "mspage", "xml:lang", "corresp", "xml:id", "ed", "id", "source"),
    non_section_values=(
        "altpage", "altpage1", "altnumbering", "altref", "mspage", "xml:lang", "edition", "mignepage", "stephnumbering", "vignumbering", "ms", "textpart", "altedition", "page", "line", "Line", "bekker page", "tlnum", "stephpage", "olpage", "altchapter",
        "pat2", "oleariuspage", "pagew", "pagep", "MSS", "NarrProof", "blancard", "hudson", "borheck", "lnum", "reiskpage", "bekker line", "altsection", "section2", "casaubonpage", "Whiston chapter", "Whiston section", "cam2page", "orgpage", "Para",
        "Jebb page", "ed1page", "ed2page", "ms1folio", "lineno", "altline", "altpagecont", "alt",
    ),
    non_text_tags=("head", "note", "title", "bibl", "del", "foreign"),
)
PROFILES = {p.name: p for p in (GENERIC, LATIN, GREEK)}


def slot_forms(profile: Profile, word: Column, whole: Column | None = None) -> list[Column]:
    """The columns of a profile's formats; ``whole`` is the word before contractions, on the first part only."""
    return [f.function(whole if f.before_replace and whole is not None else word).alias(n) for n, f in profile.formats.items()]


def rendered(profile: Profile, form: str) -> Column:
    """A slot in a format's template, from the columns pre, post and the form."""
    parts = profile.formats[form].template.replace("{pre}", "\x01").replace("{post}", "\x02").replace("{}", "\x03")
    at = {"\x01": F.col("pre"), "\x02": F.col("post"), "\x03": F.col(form)}
    return F.concat(*[F.coalesce(at[c], F.lit("")) if c in at else F.lit(c) for c in parts])
