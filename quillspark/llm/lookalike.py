"""One consistent form for text that looks the same though its characters differ.

A batch of texts is exploded to one array of code points with their rows and
places. Mapping tables, the same for every batch and held once by each worker,
are joined to it by code point: decompositions, look-alike letters, widths,
invisible characters and gaps. Combining marks are then ordered by class,
letters and marks are recomposed, and the strings are rebuilt.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import checkpoint_dir, spread

# Letters of other scripts and the Latin letters of the same shape.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХУаеѕіјорсхуһԛԝԁкѵ", "ABESIJKMHOPCTXYaesijopcxyhqwdĸv", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοκρνϳϲ", "ABEZHIKMNOPTYXoĸpvjc", strict=True))
ARMENIAN = dict(zip("օՕհոսցՍՏԼ", "oOhnugUSL", strict=True))
OTHER = dict(zip("ı‐‑へ", "ı--ヘ", strict=True))
SHAPES = CYRILLIC | GREEK | ARMENIAN | OTHER
#: Compatibility decompositions that change no shape but the width or position of a character.
_SAME_SHAPE = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>")
#: Of the mixed kind <compat>, the blocks whose characters look like their decomposition.
_COMPAT_BLOCKS = ((0x132, 0x140), (0x149, 0x149), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0xB5, 0xB5), (0x2160, 0x217F), (0x2E80, 0x2FDF), (0xFB00, 0xFB17), (0x2024, 0x2026), (0x3131, 0x318E), (0x587, 0x587), (0x675, 0x678), (0xE33, 0xEDD), (0x2126, 0x212B))
_VISIBLE_FORMATS = frozenset([*range(0x600, 0x606), 0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD])
_SPACE = 0x20
#: Rows of a class that are paired in one task.
BLOCK_ROWS = 1024


@dataclass(frozen=True)
class Tables:
    count: np.ndarray  # code points that a code point becomes
    start: np.ndarray  # where they begin in pool
    pool: np.ndarray
    ccc: np.ndarray
    gap: np.ndarray
    second: np.ndarray  # may be joined to the code point before it
    pairs: np.ndarray  # first << 21 | second, sorted
    joined: np.ndarray


def _expand(ch: str) -> str:
    """The full decomposition of a character, as far as it keeps its shape."""
    d = unicodedata.decomposition(ch)
    if not d:
        return ch
    kind, _, rest = d.rpartition("> ") if d.startswith("<") else ("", "", d)
    if kind:
        kind += ">"
        if kind not in _SAME_SHAPE and not (kind == "<compat>" and any(a <= ord(ch) <= b for a, b in _COMPAT_BLOCKS)):
            return ch
    return "".join(_expand(chr(int(x, 16))) for x in rest.split())


def _invisible(ch: str) -> bool:
    cp, cat = ord(ch), unicodedata.category(ch)
    if cat == "Cf":
        return cp not in _VISIBLE_FORMATS
    return cat == "Cc" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D)


# Where conjoining Hangul begins, and how many vowels and finals a syllable can have.
_L, _V, _T, _SYLLABLES, _VOWELS, _FINALS = 0x1100, 0x1161, 0x11A7, 0xAC00, 21, 28


@functools.cache
def tables() -> Tables:
    n = 0x110000
    count, start = np.ones(n, np.uint8), np.arange(n, dtype=np.int32)
    pool = list(range(n))
    ccc, gap, second = np.zeros(n, np.uint8), np.zeros(n, bool), np.zeros(n, bool)
    pairs: dict[int, int] = {}
    assigned = [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE01F0)]
    for cp in assigned:
        ch = chr(cp)
        ccc[cp] = unicodedata.combining(ch)
        if ch.isspace() and cp not in (0x1C, 0x1D, 0x1E, 0x1F):
            gap[cp], start[cp] = True, _SPACE
            continue
        if _invisible(ch):
            count[cp] = 0
            continue
        d = unicodedata.decomposition(ch)
        if d and not d.startswith("<") and " " in d and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in d.split())
            pairs[a << 21 | b] = cp
            second[b] = True
        to = "".join(SHAPES.get(c, c) for c in _expand(ch))
        if to != ch:
            count[cp], start[cp] = len(to), len(pool)
            pool += map(ord, to)
    second[_V : _V + _VOWELS] = second[_T + 1 : _T + _FINALS] = True
    keys = np.array(sorted(pairs), np.int64)
    return Tables(count, start, np.array(pool, np.int32), ccc, gap, second, keys, np.array([pairs[k] for k in keys.tolist()], np.int32))


def _order_marks(cp: np.ndarray, row: np.ndarray, t: Tables) -> None:
    """Runs of combining marks, by class; marks of one class keep their order."""
    ccc = t.ccc[cp]
    at = np.flatnonzero(ccc)
    if not len(at):
        return
    c = ccc[at]
    run = np.cumsum(np.r_[True, (np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]])])
    if len(at) > 1 and ((run[1:] == run[:-1]) & (c[1:] < c[:-1])).any():
        cp[at] = cp[at[np.lexsort((c, run))]]


def _joined(first: np.ndarray, second: np.ndarray, t: Tables) -> np.ndarray:
    """What each pair of code points is joined to, 0 for nothing."""
    key = first.astype(np.int64) << 21 | second
    k = np.minimum(np.searchsorted(t.pairs, key), len(t.pairs) - 1)
    out = np.where(t.pairs[k] == key, t.joined[k], 0)
    lead, vowel, final = first - _L, second - _V, second - _T
    out = np.where((lead >= 0) & (lead < 19) & (vowel >= 0) & (vowel < _VOWELS), _SYLLABLES + (lead * _VOWELS + vowel) * _FINALS, out)
    syllable = first - _SYLLABLES
    open_syllable = (syllable >= 0) & (syllable < 19 * _VOWELS * _FINALS) & (syllable % _FINALS == 0)
    return np.where(open_syllable & (final > 0) & (final < _FINALS), first + final, out)


def _compose(cp: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Letters and what follows them joined until nothing more can be: a mark reaches back over marks of lower classes, one of its own class blocks it."""
    while len(cp) > 1:
        at = np.flatnonzero(t.second[cp[1:]]) + 1
        if not len(at):
            break
        ccc = t.ccc[cp]
        starter = np.maximum.accumulate(np.where(ccc == 0, np.arange(len(cp)), -1))[at - 1]
        at, starter = at[starter >= 0], starter[starter >= 0]
        reach = (row[starter] == row[at]) & ((starter == at - 1) | ((ccc[at] > ccc[at - 1]) & (ccc[at - 1] > 0)))
        at, starter = at[reach], starter[reach]
        to = _joined(cp[starter], cp[at], t)
        at, starter, to = at[to > 0], starter[to > 0], to[to > 0]
        if not len(at):
            break
        # of a letter's marks the first is joined in one pass, and a letter that is itself joined waits
        starter, first = np.unique(starter, return_index=True)
        at, to = at[first], to[first]
        free = ~np.isin(starter, at)
        starter, at, to = starter[free], at[free], to[free]
        cp[starter] = to
        keep = np.ones(len(cp), bool)
        keep[at] = False
        cp, row = cp[keep], row[keep]
    return cp, row


def canonical_forms(texts: list[str]) -> list[str]:
    """The consistent form of each text."""
    t = tables()
    src = np.frombuffer("".join(texts).encode("utf-32-le"), np.int32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    count, start = t.count[src], t.start[src]
    if (count == 1).all():
        cp = t.pool[start]
    else:
        gone = count == 0
        if gone.any():
            keep = ~gone
            count, start, row = count[keep], start[keep], row[keep]
        if (count > 1).any():
            n = count.astype(np.int64)
            ends = np.cumsum(n)
            inner = np.arange(ends[-1]) - np.repeat(ends - n, n)
            cp, row = t.pool[np.repeat(start, n) + inner], np.repeat(row, n)
        else:
            cp = t.pool[start]
    _order_marks(cp, row, t)
    cp, row = _compose(cp, row, t)
    space = cp == _SPACE
    if len(cp) and space.any():
        fresh = np.r_[True, row[1:] != row[:-1]]
        last = np.r_[fresh[1:], True]
        again = np.r_[False, space[:-1]] & ~fresh
        keep = ~(space & (again | fresh))
        cp, row = cp[keep], row[keep]
        if len(cp):
            last = np.r_[row[1:] != row[:-1], True]
            keep = ~((cp == _SPACE) & last)
            cp, row = cp[keep], row[keep]
    whole = cp.astype("<u4").tobytes().decode("utf-32-le")
    ends = np.searchsorted(row, np.arange(len(texts)), side="right").tolist()
    out, at = [], 0
    for end in ends:
        out.append(whole[at:end])
        at = end
    return out


def canonical_form(text: str) -> str:
    return canonical_forms([text])[0]


def _digest(data: bytes) -> tuple[int, int]:
    """128 bits as two numbers, which are grouped and joined without a copy."""
    return struct.unpack("<qq", hashlib.blake2b(data, digest_size=16).digest())


def _slices(texts: list[str | None], limit: int = 1 << 21) -> Iterator[list[int]]:
    """Places of the non-null texts, in groups of about ``limit`` characters."""
    group, size = [], 0
    for k, t in enumerate(texts):
        if t is None:
            continue
        group.append(k)
        size += len(t)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def _forms_of(texts: list[str | None]) -> list[str | None]:
    out: list[str | None] = [None] * len(texts)
    for group in _slices(texts):
        for k, form in zip(group, canonical_forms([texts[k] for k in group]), strict=True):
            out[k] = form
    return out


def _form_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_forms_of(batch.column(1).to_pylist()), pa.string())], names=["id", "form"])


_DIGESTS = pa.schema([("id", pa.int64()), *((n, pa.int64()) for n in ("raw_hi", "raw_lo", "form_hi", "form_lo"))])


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        told = [(i, *_digest(t.encode()), *_digest(f.encode())) for i, t, f in zip(batch.column(0).to_pylist(), texts, _forms_of(texts), strict=True) if f]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*told, strict=True)] if told else [pa.array([], pa.int64())] * 5, schema=_DIGESTS)


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "id")


def consistent_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, form), one for each row; a null text has a null form, one without a visible character an empty form."""
    return _source(df, id_col, text_col).mapInArrow(_form_batches, "id long, form string").withColumnRenamed("id", id_col)


def _digested(columns: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Rows (field_name, id, digests of string and form) of all strings with a visible character, in a checkpoint: they are few bytes and read twice, while forms are costly."""
    parts = [_source(df, i, t).where(F.length("text") > 0).mapInArrow(_digest_batches, "id long, raw_hi long, raw_lo long, form_hi long, form_lo long").select(F.lit(name).alias("field_name"), "*") for name, df, i, t in columns]
    rows = functools.reduce(DataFrame.unionByName, parts)
    checkpoint_dir(rows.sparkSession)
    return rows.checkpoint()


_FORM = ["field_name", "form_hi", "form_lo"]


def _in_classes(rows: DataFrame) -> DataFrame:
    """Those rows whose form has different strings, with ``n``, the rows of their form."""
    ends = [f(c).alias(f"{n}_{c}") for n, f in (("least", F.min), ("most", F.max)) for c in ("raw_hi", "raw_lo")]
    mixed = rows.groupBy(*_FORM).agg(F.count("*").alias("n"), *ends).where("least_raw_hi <> most_raw_hi OR least_raw_lo <> most_raw_lo").select(*_FORM, "n")
    return rows.join(mixed, _FORM)


def look_alike_classes(columns: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Rows (field_name, id, class_id, class_rows) of (field_name, df, id, text) whose strings look like another string: one for each row, the class being that of their form.

    Null strings and strings without a visible character are in no class, nor is
    a form that has one string only, however often.
    """
    return _in_classes(_digested(columns)).select("field_name", "id", F.concat(F.hex("form_hi"), F.lit("-"), F.hex("form_lo")).alias("class_id"), F.col("n").alias("class_rows"))


def look_alike_pairs(columns: list[tuple[str, DataFrame, str, str]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (field_name, id_a, id_b), id_a < id_b: the members of ``look_alike_classes`` paired where their strings differ.

    A class of more than ``block_rows`` rows is cut into blocks by id, and each
    two blocks meet in a group of their own, so that no task has more than two
    blocks of a class at once, whatever its size; all pairs come out. A row with a
    null id is in no pair; a row that comes twice is in each of its pairs twice.
    """
    told = _in_classes(_digested(columns)).withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread_out = told.select(*_FORM, "id", "raw_hi", "raw_lo", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    meets = spread_out.select(*_FORM, "id", "raw_hi", "raw_lo", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))
    keys = [*_FORM, "i", "j"]
    a = meets.where("own = i").select(*keys, F.col("id").alias("x"), F.col("raw_hi").alias("hi"), F.col("raw_lo").alias("lo"))
    b = meets.where("own = j").select(*keys, F.col("id").alias("y"), "raw_hi", "raw_lo")
    differ = (F.col("hi") != F.col("raw_hi")) | (F.col("lo") != F.col("raw_lo"))
    once = F.when(F.col("i") == F.col("j"), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y"))
    return a.join(b, keys).where(differ & once).select("field_name", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
