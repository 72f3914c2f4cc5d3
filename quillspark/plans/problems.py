"""Queries of the general corpus problems (p1, p5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.packed import explode_packed
from quillspark.operators.records import parse_records
from quillspark.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "citation_rows").where(F.col("line_no") > 1)
    return parse_records(rows, "row_id", "sep_char", "raw_line", only_failures=True)


def p1_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "citation_rows").where(F.col("line_no") > 1)
    out = parse_records(rows, "row_id", "sep_char", "raw_line")
    return out.where(F.col("reason").isNull()).drop("reason")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return explode_packed(table(spark, d, "works"), "work_id", "citation_scheme", "loaded_at")


_FIELD = '(?:"(?:[^"]|"")*"|[^"{s}][^"{s}]*|)'


def _whole(sep: str) -> str:
    field = _FIELD.format(s=sep)
    return f"(?s)^{field}(?:{sep}{field})*$"


def _four(sep: str) -> str:
    return "(?s)^" + sep.join(["(" + _FIELD.format(s=sep) + ")"] * 4) + "$"


_CASES = " ".join(
    f"WHEN sep_char = {lit} THEN struct_pack(sound := regexp_matches(r, '{_whole(s)}'), four := regexp_matches(r, '{_four(s)}'), "
    + ", ".join(f"f{k} := regexp_extract(r, '{_four(s)}', {k})" for k in range(1, 5))
    + ")"
    for lit, s in (("chr(9)", r"\t"), ("','", ","), ("';'", ";"))
)

_PARSED = f"""
WITH raw AS (SELECT row_id, sep_char, regexp_replace(coalesce(raw_line, ''), '\\r\\z', '') AS r FROM citation_rows WHERE line_no > 1),
split AS (SELECT row_id, r, CASE {_CASES} END AS c FROM raw),
bare AS (SELECT row_id, r, c.sound AS sound, c.four AS four,
  """ + ", ".join(
    f"CASE WHEN starts_with(c.f{k}, '\"') THEN replace(substr(c.f{k}, 2, length(c.f{k}) - 2), '\"\"', '\"') ELSE c.f{k} END AS f{k}" for k in range(1, 5)
) + """ FROM split),
told AS (SELECT row_id, trim(f1, ' ') AS chapter, trim(f2, ' ') AS section, f3 AS line, f4 AS text,
  CASE WHEN NOT sound THEN 'quoting' WHEN NOT four OR regexp_matches(r, '^\\s*$') THEN 'columns'
  WHEN NOT regexp_full_match(trim(f1, ' '), '[1-9][0-9]{0,3}[a-z]?') OR NOT regexp_full_match(trim(f2, ' '), '[1-9][0-9]{0,3}[a-z]?')
    OR regexp_matches(f4, '[\\x00-\\x08\\x0b-\\x1f\\x7f\\x{80}-\\x{9f}\\x{fffd}]') THEN 'value' END AS reason FROM bare)
"""

# What separates levels and what encloses them, in another wording than the operator's: marks and the stretches between them; single marks are made angled, twice as one pass takes the sign between two of them.
_QUOTES = '"(?:[^"]|"")*"|«[^»]*»|“[^”]*”|„[^“”]*[“”]|‹[^›]*›|「[^」]*」'
_LEVELS = f"""
WITH once AS (SELECT work_id, arg_max(citation_scheme, loaded_at) AS s FROM works WHERE work_id IS NOT NULL GROUP BY 1),
single AS (SELECT work_id, regexp_replace(regexp_replace(s, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}.)])[''‘]((?:[^''’]|[''’][\\p{{L}}\\p{{N}}])*)[''’]($|[^\\p{{L}}\\p{{N}}])', '\\1‹\\2›\\3', 'g'), '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}.)])[''‘]((?:[^''’]|[''’][\\p{{L}}\\p{{N}}])*)[''’]($|[^\\p{{L}}\\p{{N}}])', '\\1‹\\2›\\3', 'g') AS s FROM once),
pieces AS (SELECT work_id, regexp_extract_all(s, '(?s){_QUOTES}|(?:[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Zs}}\\-‐‑''’.()])+|.') AS l FROM single),
rows AS (SELECT work_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS k FROM pieces),
kinds AS (SELECT *, regexp_full_match(x, '(?s){_QUOTES}') AS quoted, regexp_full_match(x, '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Zs}}\\-‐‑''’.()]+') AS word FROM rows),
runs AS (SELECT *, sum((NOT quoted AND NOT word)::INT) OVER (PARTITION BY work_id ORDER BY k) AS level FROM kinds),
bare AS (SELECT work_id, level, CASE WHEN count(*) FILTER (quoted) = 1 AND count(*) FILTER (word AND trim(x) <> '') = 0 THEN replace(substr(max(CASE WHEN quoted THEN x END), 2, length(max(CASE WHEN quoted THEN x END)) - 2), '""', '"') ELSE string_agg(x, '' ORDER BY k) END AS v FROM runs WHERE quoted OR word GROUP BY 1, 2),
told AS (SELECT work_id, level, lower(regexp_replace(v, '^\\s+|\\s+$', '', 'g')) AS level_name FROM bare)
SELECT work_id, row_number() OVER (PARTITION BY work_id ORDER BY level)::INT AS pos, level_name FROM told WHERE level_name <> ''
"""

QUERIES = {"p1_found": p1_found, "p1_rows": p1_rows, "p5_found": p5_found}

ORACLES = {
    "p1_found": _PARSED + "SELECT row_id, reason FROM told WHERE reason IS NOT NULL",
    "p5_found": _LEVELS,
    "p1_rows": _PARSED + "SELECT row_id, chapter, section, line, text FROM told WHERE reason IS NULL",
}
