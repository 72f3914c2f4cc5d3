"""Sentence units of texts in many scripts, by cascading tables of break and no-break rules.

A candidate place is a run of sentence marks with the closing marks behind it.
There the tables of its language and script are asked in order (the language's,
then the script's, then the common one); a rule is a pair of regular
expressions for what stands before and behind the place, and the first rule
that matches decides. The script is told by the letters before the mark; the
language of Latin letters by the words of the text, else by its label, which is
often missing or wrong. A blank line always ends a unit.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.residue import _SLOTS as SLOT_PATTERNS
from quillspark.session import spread


@dataclass(frozen=True)
class Rule:
    breaks: bool
    before: str
    after: str = ""


# Sentence marks, closing marks and what carries a sentence on.
STOPS = ".!?;…．。｡！？।॥։።፧፨؟۔។៕။‼⁇⁈⁉"
CLOSERS = "”’\"')\\]}」』）】〉》›＂"
CARRY_ON = ",،、，؛፣՝·"

# Abbreviations by language, for any following word.
ABBREVIATIONS = {
    "en": "etc|cf|ed|eds|vol|vols|fol|fols|pp|ms|mss|Mr|Mrs|Ms|Dr|Prof|St|vs|ca|chap|esp|viz|fig|figs|sect|Rev|Jr|Sr|Gov|Gen|Capt|Lt|Sgt|Hon|Sen|Messrs|Esq|Bros|Ltd|Inc|approx|dept|trans|suppl|ibid|op|cit|et al|Jan|Feb|Apr|Aug|Sept|Oct|Nov|Dec|i\\.\\s?e|e\\.\\s?g",
    "fr": "éd|chap|av|apr|env|art|Mme|Mlle|MM|litt|trad|tome|vol|fol|ms|mss|cf|etc|St|Ste|Dr|Prof|Mgr|fig|figs|coll|suppl|ibid|op|cit|réimpr|publ|janv|févr|juil|sept|oct|nov|déc",
    "de": "usw|bzw|vgl|Bd|Bde|Kap|Nr|Hl|hl|Abb|Anm|Hrsg|Aufl|Jh|Taf|Zl|ebd|evtl|ggf|sog|geb|gest|Bsp|Str|Dr|Prof|Hr|St|ca|etc|lat|griech|hebr|Hs|Hss|Verf|Übers|Lit|Mio|Mrd|inkl|exkl|zit|Tab|Jhd|Jhdt|Gebr|fol|Jan|Feb|Aug|Sept|Okt|Nov|Dez|z\\.\\s?B|d\\.\\s?h|u\\.\\s?a",
    "es": "núm|núms|Sr|Sra|Srta|Sta|Sto|Dr|Dra|Prof|pág|págs|cap|caps|ej|aprox|Ud|Uds|vol|vols|fol|fols|ed|eds|fig|figs|art|etc|cf|ms|mss|trad|Lic|Dña|p\\.\\s?ej",
    "it": "cap|capp|vol|voll|fig|figg|ecc|sig|dott|prof|pag|pagg|ed|edd|trad|es|art|cfr|cod|ms|mss|ibid|op|cit",
    "la": "lib|cap|Lib|Ep|Hom|Cap|scil|sc|ibid|ib|loc|cit|op|cf|etc|fol|ed|edd|cod|codd|ms|mss|vid|sq|sqq",
    "grc": "κεφ|κτλ|σελ|πρβ|βλ|στ|τόμ|κ\\.τ\\.λ|δηλ|ἤτ",
    "ru": "табл|рис|гл|стр|см|ср|др|пр|гг|вв|тыс|млн|ул|им|изд|ред|пер|ок|напр|т\\.\\s?е|т\\.\\s?д|т\\.\\s?п",
}
#: How languages may be labelled, and words by which a text in Latin letters is told to be in one.
LABELS = {"en": "en|eng|english", "fr": "fr|fra|fre|french|français|francais", "de": "de|deu|ger|german|deutsch", "es": "es|spa|spanish|español|espanol", "it": "it|ita|italian|italiano", "la": "la|lat|latin|latina"}
TELLING = {
    "en": "the|of|and|to|was|that|with|for|is|by",
    "fr": "le|les|des|du|dans|une|est|pour|avec|qui",
    "de": "der|die|das|und|den|von|mit|auf|ist|nicht",
    "es": "el|los|las|del|por|con|una|para|como|su",
    "it": "il|gli|della|di|che|per|con|una|nel|sono",
    "la": "et|in|ad|cum|sed|non|quod|est|ut|atque",
}
#: Of one small letter, or like a common word: only before a number.
REFERENCES = "p|v|n|t|c|f|s|l|d|b|q|no|nos|nr|art|par|col|op"
#: Works and parts of works, cited alike in all languages: only before a number.
WORKS = "Lib|lib|Ep|ep|Hom|hom|Cap|cap|Serm|serm|Or|Tract|Conf|Ps|fol|vol|ed"
SPEECH = "εἶπ|εἰπ|ἔφη|ἔφα|ἔλεγ|λέγ|φησ|φασ|ἀπεκρίν|ἀποκρι|ἠρώτ|ἠρώτησ"

_WORD = r"(?<![\p{L}\p{M}\p{N}_])"


def _accents(words: str) -> str:
    """Accented letters, also as letter and mark."""
    return words.replace("é", "(?:é|é)").replace("ú", "(?:ú|ú)").replace("á", "(?:á|á)").replace("ό", "(?:ό|ό)")


def _language(code: str) -> list[Rule]:
    return [Rule(False, rf"{_WORD}(?:{_accents(ABBREVIATIONS[code])})\.")]


_SHORT = [
    Rule(False, rf"{_WORD}\p{{Lu}}\p{{M}}*\."),  # initials
    Rule(False, rf"{_WORD}(?:\p{{L}}\p{{M}}*\.){{2,}}"),  # i.e., J.-C.
]
_ELLIPSIS = [Rule(False, r"(?<![!?;。！？।։።؟])(?:[.．]{2,}|…[.…]*)")]
_GOES_ON = [
    Rule(False, r"[.．]", r"[\p{N}_@/&=\\]"),
    Rule(False, "", rf"\s?[{CARRY_ON}]|\s?[;:](?!\w)|[-–—/]"),
]

COMMON = [*_ELLIPSIS, *_GOES_ON, Rule(True, "")]
LATIN = [
    Rule(False, ";"),
    *_SHORT,
    Rule(False, rf"(?i:{_WORD}(?:{REFERENCES}))\.", r"\s+(?=[\p{L}]*\p{N})"),
    Rule(False, rf"{_WORD}(?:{WORKS})\.", r"\s+(?=\p{N})"),
    Rule(False, r"[(\[]\p{L}{1,6}\.", r"\s+(?=\p{N})"),
    Rule(False, rf"{_WORD}[ad]\.", r"\s?C\."),
    Rule(False, rf"{_WORD}z\.", r"\s?[BTZ]\."),
    Rule(False, rf"{_WORD}[vn]\.", r"\s?Chr\."),
    Rule(False, rf"[.．]|[{STOPS}]\s?[{CLOSERS}«»“‘]+", r"\s*\p{Ll}"),
    Rule(False, r"[!?]", r"[\p{Ll}=&]"),
]
GREEK = [
    *_language("grc"),
    *_SHORT,
    Rule(False, rf"[{STOPS}]\s?[{CLOSERS}«»“]+", rf"\s*(?:{SPEECH})[^.;:·!?«“\"]*[.,·]"),
]
ARMENIAN = [Rule(False, r"[;.]"), *_SHORT, Rule(False, rf"[{STOPS}]\s?[{CLOSERS}«»“]+", r"\s*\p{Ll}")]
SEMITIC = [Rule(False, ";"), Rule(False, rf"{_WORD}\p{{Lo}}\p{{M}}*\.")]
OWN_STOPS = [Rule(False, r"[;.]")]  # scripts whose stop is not the full stop

_LATIN_LANGUAGES = ("en", "fr", "de", "es", "it", "la")
CYRILLIC = [*_language("ru"), *LATIN]
#: A text in Latin letters whose language neither its words nor its label tell is read by the rules of all of them.
TABLES = {code: [*_language(code), *LATIN] for code in _LATIN_LANGUAGES} | {
    "latin": [*(r for code in _LATIN_LANGUAGES for r in _language(code)), *LATIN], "cyrillic": CYRILLIC, "greek": GREEK, "armenian": ARMENIAN, "semitic": SEMITIC, "own": OWN_STOPS, "none": [Rule(False, ";")],
}


@functools.cache
def _cascade(table: str) -> list[tuple[bool, regex.Pattern]]:
    """The rules of a table and of the common one, neighbours of one verdict joined."""
    out: list[tuple[bool, list[str]]] = []
    for rule in [*TABLES[table], *COMMON]:
        pair = f"(?<={rule.before})(?={rule.after})" if rule.before else f"(?={rule.after})"
        if out and out[-1][0] == rule.breaks:
            out[-1][1].append(pair)
        else:
            out.append((rule.breaks, [pair]))
    return [(breaks, regex.compile("|".join(pairs))) for breaks, pairs in out]


_MARKS = f"[{STOPS}]+"
_CANDIDATE = {
    "«": regex.compile(rf"{_MARKS}(?:[{CLOSERS}]|»|[ \xa0  ]»)*"),
    "»": regex.compile(rf"{_MARKS}(?:[{CLOSERS}]|«)*"),
}
_LOW_QUOTE = {k: regex.compile(p.pattern.replace("|»", "|»|“").replace("|«)", "|«|“)")) for k, p in _CANDIDATE.items()}
_PARAGRAPH = regex.compile(r"(?:\r\n|\n|\r)[^\S\r\n]*(?:\r\n|\n|\r)\s*")
_RARE = re.compile("[\u00ad\u0400-\u04ff\u200b-\u200f\u202a-\u202e\u2060-\u2069\ufeff\uff21-\uff5a]")
_SHAPES_OF_LATIN = re.compile("[\u0400-\u04ff\uff21-\uff5a]")
_CYRILLIC_ANY, _CYRILLIC_ONLY = re.compile("[\u0400-\u04ff]"), re.compile("[БГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯбвгджзийклмнптфцчшщъыьэюя]")
_GREEK_IN_LATIN = re.compile("[A-Za-z][Α-ΡΤ-Χο]|[Α-ΡΤ-Χο][A-Za-z]")
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff\u202a-\u202e\u2066-\u2069]")
# Letters of the same shape, one for one, and full-width forms.
_SHADOW = str.maketrans(dict(zip("АВЕЅІЈКМНОРСТХУаеѕіјорсхуΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABESIJKMHOPCTXYaesijopcxyABEZHIKMNOPTYXo", strict=True)) | {chr(c): chr(c - 0xFEE0) for c in range(0xFF21, 0xFF5B) if c < 0xFF3B or c > 0xFF40})


def _script(text: str, at: int) -> str:
    """The table for a mark at ``at``, by the word before it."""
    k = at - 1
    floor = max(0, at - 40)
    while k >= floor and not text[k].isalpha():
        k -= 1
    if k < floor:
        return "none"
    cp = ord(text[k])
    if cp < 0x250 or 0x1E00 <= cp < 0x1F00 or 0x370 <= cp < 0x400 or 0x1F00 <= cp < 0x2000:
        while k >= 0 and (text[k].isalpha() or "̀" <= text[k] <= "ͯ"):
            if "Ͱ" <= text[k] < "Ѐ" or "ἀ" <= text[k] < " ":
                return "greek"
            k -= 1
        return "latin"
    if 0x400 <= cp < 0x530:
        return "cyrillic"
    if 0x530 <= cp < 0x590:
        return "armenian"
    if 0x590 <= cp < 0x780:
        return "semitic"
    return "own"


@functools.cache
def _words() -> tuple[re.Pattern, dict[str, tuple[str, ...]]]:
    """A pattern of all telling words, and their languages."""
    own: dict[str, tuple[str, ...]] = {}
    for code, words in TELLING.items():
        for w in words.split("|"):
            own[w] = (*own.get(w, ()), code)
    return re.compile(rf"(?<![^\s(«“„\"'’])(?:{'|'.join(sorted(own, key=len, reverse=True))})(?![^\s,;:.!?)»”\"])"), own


def language(text: str, label: str | None) -> str:
    """The table of a text's words in Latin letters: by its telling words, all through the text, where one language has twice as many as any other; else by its label; else that of all languages."""
    pattern, own = _words()
    counts = dict.fromkeys(TELLING, 0)
    for word, n in Counter(pattern.findall(text)).items():
        for code in own[word]:
            counts[code] += n
    (most, n), (_, second) = sorted(counts.items(), key=lambda x: -x[1])[:2]
    if n >= 3 and n >= 2 * second:
        return most
    known = re.split(r"[-_ ]", (label or "").strip().lower())[0]
    return next((code for code, names in LABELS.items() if known in names.split("|") and counts[code] * 2 >= n), "latin")


def _is_cyrillic(text: str) -> bool:
    """Whether Cyrillic letters are more than look-alikes of Latin ones: at least a third of them have no such shape."""
    own = len(_CYRILLIC_ONLY.findall(text))
    return own > 0 and 3 * own >= len(_CYRILLIC_ANY.findall(text))


def _units(text: str, slots: list[tuple[int, int]], latin: str) -> Iterator[tuple[int, int]]:
    guillemet = next((c for c in text if c in "«»"), "«") if "«" in text or "»" in text else "«"
    candidate = (_LOW_QUOTE if "„" in text else _CANDIDATE)[guillemet]
    starts = [a for a, _ in slots]
    lo = 0
    bounds = [(m.start(), m.end()) for m in _PARAGRAPH.finditer(text)]
    for hi, after in [*bounds, (len(text), len(text))]:
        at = counted = lo
        odd = False
        for m in candidate.finditer(text, lo, hi):
            mark, end = m.span()
            if slots:
                k = bisect_right(starts, mark) - 1
                if k >= 0 and mark < slots[k][1]:
                    continue
            straight = text.find('"', mark, end)
            if straight >= 0:
                # a straight mark closes where an odd number of them is before it in its paragraph
                odd ^= text.count('"', counted, straight) % 2 == 1
                counted = straight
                if not odd:
                    end = straight
            if end > mark and text[end - 1] in "'’" and end < hi and text[end].isalpha() and text[end - 1] == "'":
                end -= 1
            if end < hi:
                table = _script(text, mark)
                for breaks, pattern in _cascade(latin if table == "latin" else table):
                    if pattern.match(text, end):
                        break
                if not breaks:
                    continue
            yield at, end
            at = end
        if at < hi:
            yield at, hi
        lo = after


def sentence_spans(text: str, label: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of each unit in code points, without white space at its ends; ``label`` is the text's language as told."""
    if not text or text.isspace():
        return []
    places, shadow = None, text
    if not text.isascii():
        rare = _RARE.search(text)
        if rare and _UNSEEN.search(text, rare.start()):
            gone = {m.start() for m in _UNSEEN.finditer(text)}
            places = [k for k in range(len(text)) if k not in gone]
            shadow = _UNSEEN.sub("", text)
        if (rare and _SHAPES_OF_LATIN.search(shadow) and not _is_cyrillic(shadow)) or ("ο" in shadow and _GREEK_IN_LATIN.search(shadow)):
            shadow = shadow.translate(_SHADOW)
    slots = sorted(m.span() for held, pattern in SLOT_PATTERNS if held != ":" and held in shadow for m in pattern.finditer(shadow))
    out = []
    for a, b in _units(shadow, slots, language(shadow, label)):
        while a < b and shadow[a].isspace():
            a += 1
        while a < b and shadow[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b) if places is None else (places[a], places[b - 1] + 1))
    return out


def _span_batches(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, nos, starts, ends, texts = [], [], [], [], []
                for i, text, label in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                    spans = sentence_spans(text, label)
                    ids += [i] * len(spans)
                    nos += range(1, len(spans) + 1)
                    starts += [a for a, _ in spans]
                    ends += [b for _, b in spans]
                    if with_text:
                        texts += [text[a:b] for a, b in spans]
                cols = [pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
                names = ["id", "sentence_no", "start_at", "end_at"]
                if with_text:
                    cols.append(pa.array(texts, pa.string()))
                    names.append("sentence")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def split_sentences(df: DataFrame, id_col: str, text_col: str, with_text: bool = False, lang_col: str | None = None) -> DataFrame:
    """Rows (id, sentence_no, start_at, end_at[, sentence]) of every text; null, empty and blank texts have none.

    Places count code points from 0, ``end_at`` is the place after the last one.
    ``lang_col`` helps where a text's own words don't tell its language; wrong
    and missing labels do no harm. Repeated rows come out as often as they come
    in; other columns are not looked at.
    """
    label = (F.col(lang_col) if lang_col else F.lit(None)).cast("string").alias("lang")
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), label).where(F.length("text") > 0)
    src = spread(src, "id")
    ddl = "id long, sentence_no int, start_at int, end_at int" + (", sentence string" if with_text else "")
    return src.mapInArrow(_span_batches(with_text), ddl).withColumnRenamed("id", id_col)
