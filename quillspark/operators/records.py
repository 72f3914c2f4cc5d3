"""Delimited records that may fail to parse: sound rows and failures with their reason.

Records are read in blocks. One linear check tells whether a whole block is well
formed; a block that holds a record with broken quoting, a wrong number of
fields or a bare line break fails, and is bisected until the bad records are
alone in pieces of at most ``STRICT_ROWS``, which are diagnosed record by
record. The stretches left between them go through Arrow's columnar CSV reader
in one read, each record between two copies of its number. Values are checked on
the parsed columns, and the records that these checks single out are diagnosed
in the same way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import spread

BLOCK_ROWS = 4096
STRICT_ROWS = 8

QUOTING, COLUMNS, VALUE = "quoting", "columns", "value"

_REF = re.compile(r"[1-9][0-9]{0,3}[a-z]?")
_BAD_TEXT = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f�]")
_REF_RE2 = r"^ *[1-9][0-9]{0,3}[a-z]? *$"
_BAD_TEXT_RE2 = r"[\x00-\x08\x0b-\x1f\x7f\x{80}-\x{9f}\x{fffd}]"


@dataclass(frozen=True)
class Parsed:
    reason: str | None
    fields: tuple[str, str, str, str] | None


def split_record(record: str, sep: str | None) -> list[str] | None:
    """Unquoted fields of one record, or None where its quoting is broken."""
    fields, at, n = [], 0, len(record)
    while True:
        if at < n and record[at] == '"':
            end = at + 1
            while True:
                end = record.find('"', end)
                if end < 0:
                    return None
                if record.startswith('"', end + 1):
                    end += 2
                    continue
                break
            fields.append(record[at + 1 : end].replace('""', '"'))
            end += 1
            if end < n and not (sep and record.startswith(sep, end)):
                return None
        else:
            end = record.find(sep, at) if sep else -1
            end = n if end < 0 else end
            if '"' in record[at:end]:
                return None
            fields.append(record[at:end])
        if end >= n:
            return fields
        at = end + len(sep)


def diagnose(record: str | None, sep: str | None) -> Parsed:
    """The strict reading of one record; its reason is the first that holds."""
    if record is None:
        return Parsed(COLUMNS, None)
    record = record[:-1] if record.endswith("\r") else record
    sep = None if sep == '"' else sep
    fields = split_record(record, sep)
    if fields is None:
        return Parsed(QUOTING, None)
    if len(fields) != 4 or not record.strip():
        return Parsed(COLUMNS, None)
    chapter, section, line, text = fields
    chapter, section = chapter.strip(" "), section.strip(" ")
    if not _REF.fullmatch(chapter) or not _REF.fullmatch(section) or _BAD_TEXT.search(text):
        return Parsed(VALUE, None)
    return Parsed(None, (chapter, section, line, text))


def _format_re2(sep: str) -> str:
    """Records of four fields between two numbers, each on a line of its own."""
    s = r"\x{%x}" % ord(sep)
    field = rf'(?:"(?:[^"]|"")*"|[^"{s}\r\n][^"{s}\r\n]*|)'
    return rf"(?s)\A(?:[0-9]+{s}{field}{s}{field}{s}{field}{s}{field}{s}[0-9]+\n)*\z"


_NUMBERS = pa.array(range(BLOCK_ROWS), pa.int32()).cast(pa.string())
_NAMES = ["n", "chapter", "section", "line", "text", "m"]
_TYPES = dict.fromkeys(_NAMES, pa.string())
#: Stands for a separator beyond ASCII, in records that don't hold it themselves.
_STAND_IN = "\x1f"


class _Block:
    """Up to ``BLOCK_ROWS`` records as one buffer, any stretch of which can be read without a copy."""

    def __init__(self, records: pa.Array, sep: str):
        numbers = _NUMBERS.slice(0, len(records))
        lines = pc.binary_join_element_wise(numbers, records, numbers, sep)
        lines = pc.binary_join_element_wise(lines, "", "\n")
        _, offsets, self.data = lines.buffers()
        self.at = np.frombuffer(offsets, np.int32)[lines.offset : lines.offset + len(lines) + 1]
        self.sep, self.format = sep, _format_re2(sep)

    def well_formed(self, lo: int, hi: int) -> bool:
        """Whether records lo to hi are all of four well-quoted fields without a bare line break."""
        a, b = int(self.at[lo]), int(self.at[hi])
        whole = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, b - a], np.int32)), self.data.slice(a, b - a)])
        return pc.match_substring_regex(whole, self.format)[0].as_py()

    def read(self, stretches: list[tuple[int, int]]) -> list[pa.Array] | None:
        """The columns of the records of these stretches, or None where they don't come out as they went in."""
        data = pa.py_buffer(b"".join(self.data.slice(int(self.at[lo]), int(self.at[hi] - self.at[lo])) for lo, hi in stretches))
        try:
            table = pacsv.read_csv(
                pa.BufferReader(data),
                read_options=pacsv.ReadOptions(use_threads=False, block_size=max(len(data) + 1, 1024), column_names=_NAMES),
                parse_options=pacsv.ParseOptions(delimiter=self.sep, newlines_in_values=True, ignore_empty_lines=False),
                convert_options=pacsv.ConvertOptions(column_types=_TYPES, strings_can_be_null=False),
            )
        except pa.ArrowInvalid:
            return None
        cols = [c.combine_chunks() for c in table.columns]
        numbers = pa.concat_arrays([_NUMBERS.slice(lo, hi - lo) for lo, hi in stretches])
        return cols[1:5] if cols[0].equals(numbers) and cols[5].equals(numbers) else None


def _sound_values(cols: list[pa.Array]) -> np.ndarray:
    sound = pc.and_(pc.match_substring_regex(cols[0], _REF_RE2), pc.match_substring_regex(cols[1], _REF_RE2))
    return pc.and_(sound, pc.invert(pc.match_substring_regex(cols[3], _BAD_TEXT_RE2))).to_numpy(zero_copy_only=False)


def _solve(records: pa.Array, sep: str | None, failed: list[int] | None = None) -> Iterator[tuple[np.ndarray, list[pa.Array] | None, list[Parsed] | None]]:
    """(places, columns, None) of sound records and (places, None, diagnoses) of the others; ``failed`` is given the size of each block that was bisected."""
    everything = np.arange(len(records))

    def strictly(places: np.ndarray) -> tuple[np.ndarray, None, list[Parsed]]:
        return places, None, [diagnose(r, sep) for r in records.take(pa.array(places)).to_pylist()]

    if not sep or len(sep) > 1 or sep in '"\r\n':
        if len(everything):
            yield strictly(everything)
        return
    plain = pc.replace_substring_regex(pc.fill_null(records, ""), r"\r\z", "")
    mark = sep
    if ord(sep) > 127:
        mark = _STAND_IN
        own = pc.match_substring(plain, mark).to_numpy(zero_copy_only=False)
        if own.any():
            yield strictly(everything[own])
            everything = everything[~own]
            plain = plain.filter(pa.array(~own))
        plain = pc.replace_substring(plain, sep, mark)
    for first in range(0, len(everything), BLOCK_ROWS):
        places = everything[first : first + BLOCK_ROWS]
        block = _Block(plain.slice(first, BLOCK_ROWS), mark)
        todo, good = [(0, len(places))], []
        while todo:
            lo, hi = todo.pop()
            if block.well_formed(lo, hi):
                good.append((lo, hi))
                continue
            if failed is not None:
                failed.append(hi - lo)
            if hi - lo > STRICT_ROWS:
                half = (lo + hi) // 2
                todo += [(half, hi), (lo, half)]
            else:
                yield strictly(places[lo:hi])
        reads = [good] if good else []
        while reads:
            stretches = reads.pop()
            own = np.concatenate([places[lo:hi] for lo, hi in stretches])
            cols = block.read(stretches)
            if cols is None:
                if len(own) <= STRICT_ROWS:
                    yield strictly(own)
                elif len(stretches) > 1:
                    reads += [stretches[len(stretches) // 2 :], stretches[: len(stretches) // 2]]
                else:
                    (lo, hi) = stretches[0]
                    reads += [[((lo + hi) // 2, hi)], [(lo, (lo + hi) // 2)]]
                continue
            sound = _sound_values(cols)
            if not sound.all():
                yield strictly(own[~sound])
                cols, own = [c.filter(pa.array(sound)) for c in cols], own[sound]
            if mark != sep:
                cols = [pc.replace_substring(c, mark, sep) for c in cols]
            if len(own):
                yield own, [pc.utf8_trim(cols[0], " "), pc.utf8_trim(cols[1], " "), cols[2], cols[3]], None


def _parse_batches(only_failures: bool, kept: int):
    carried = ["id", *(f"k{n}" for n in range(kept))]
    names = carried + (["reason"] if only_failures else ["chapter", "section", "line", "text", "reason"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seps = batch.column("sep")
            for sep in pc.unique(seps).to_pylist():
                mask = pc.is_null(seps) if sep is None else pc.fill_null(pc.equal(seps, sep), False)
                part = batch.filter(mask)
                for places, cols, found in _solve(part.column("raw"), sep or None):
                    if cols is not None and only_failures:
                        continue
                    own = part.select(carried).take(pa.array(places)).columns
                    if cols is not None:
                        yield pa.RecordBatch.from_arrays([*own, *cols, pa.nulls(len(places), pa.string())], names=names)
                        continue
                    reasons = pa.array([p.reason for p in found], pa.string())
                    if only_failures:
                        out = pa.RecordBatch.from_arrays([*own, reasons], names=names)
                        yield out.filter(pc.is_valid(reasons))
                    else:
                        parts = [pa.array([p.fields[k] if p.fields else None for p in found], pa.string()) for k in range(4)]
                        yield pa.RecordBatch.from_arrays([*own, *parts, reasons], names=names)

    return run


def parse_records(df: DataFrame, id_col: str, sep_col: str, raw_col: str, only_failures: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, chapter, section, line, text, reason), or (id, reason) of the failures alone.

    ``reason`` is null for a sound record and else ``quoting``, ``columns`` or
    ``value``; a failed record has null fields. Chapter and Section lose the
    spaces around them. A null record, like a blank one, fails by ``columns``;
    a record with a null, empty or `"` separator is one field. Rows that come
    twice come out twice, an empty table gives an empty result. Of the other
    columns of ``df`` those in ``keep`` are passed through, before the fields;
    the rest are not looked at, so their names can't clash.
    """
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(sep_col).cast("string").alias("sep"), F.col(raw_col).cast("string").alias("raw"), *[F.col(c).alias(f"k{n}") for n, c in enumerate(keep)])
    fields = ["reason"] if only_failures else ["chapter", "section", "line", "text", "reason"]
    kept = [f"k{n} {df.schema[c].dataType.simpleString()}" for n, c in enumerate(keep)]
    ddl = ", ".join(["id long", *kept, *(f"{f} string" for f in fields)])
    out = spread(src, "id").mapInArrow(_parse_batches(only_failures, len(keep)), ddl)
    return out.select(F.col("id").alias(id_col), *[F.col(f"k{n}").alias(c) for n, c in enumerate(keep)], *fields)
