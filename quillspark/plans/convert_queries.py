"""Queries of whole conversions, from rows and from nested XML, and their SQL, which knows texts by runs of letters and gaps."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import GENERIC
from quillspark.operators import xml_events as E
from quillspark.operators.records import parse_records
from quillspark.operators.xml_recovery import recover_xml
from quillspark.plans.convert import Graph, rows_to_graph, xml_to_graph
from quillspark.plans.problems import _PARSED
from quillspark.plans.text_queries import _C, _L, _Z, sql_plain, sql_runs
from quillspark.session import table

LEVELS = ["chapter", "section", "line"]
XML_PROFILE = replace(GENERIC, name="tei", non_text_tags=("note",))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Sound citation rows: (file_name, line_at, row_id, chapter, section, line, text)."""
    raw = table(spark, d, "citation_rows").where("line_no > 1").withColumn("line_at", F.col("line_no").cast("long") * 1_000_000_000 + F.col("row_id"))
    return parse_records(raw, "row_id", "sep_char", "raw_line", keep=("file_name", "line_at")).where("reason IS NULL").drop("reason")


def _titles(spark: SparkSession, d: str, rows: DataFrame, id_col: str) -> DataFrame:
    """(id, title) of files by the work that their name begins with."""
    works = table(spark, d, "works").groupBy("work_id").agg(F.max(F.struct("loaded_at", "title"))["title"].alias("title"))
    names = rows.select(id_col).distinct().withColumn("work_id", F.regexp_extract(id_col, r"^([a-z]+[0-9]+-[0-9]+)", 1))
    return names.join(works, "work_id").select(id_col, "title")


def _from_rows(spark: SparkSession, d: str) -> Graph:
    rows = lines(spark, d)
    return rows_to_graph(rows, "file_name", "line_at", LEVELS, "text", titles=_titles(spark, d, table(spark, d, "citation_rows"), "file_name"))


def q_convert_slots(spark: SparkSession, d: str) -> DataFrame:
    return _from_rows(spark, d).slots


def q_convert_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _from_rows(spark, d).units.select("file_name", "node", "otype", "value", "from_slot", "to_slot")


def q_convert_meta(spark: SparkSession, d: str) -> DataFrame:
    return _from_rows(spark, d).feature_meta.where("key = 'valueType' OR feature IN ('_book', 'section')")


def q_convert_otext(spark: SparkSession, d: str) -> DataFrame:
    return _from_rows(spark, d).otext


# --- nested XML of the same rows


def _escaped(c: str) -> F.Column:
    return F.translate(F.coalesce(F.col(c), F.lit("")), "<>&", "()+")


def nested_xml(spark: SparkSession, d: str) -> DataFrame:
    """(file_name, xml): rows with a word as paragraphs in sections in chapters, single and double quotes, notes and page breaks."""
    rows = lines(spark, d).where(F.col("text").rlike(_C))
    part = F.struct("line_at", "chapter", "section", _escaped("text").alias("t"), (F.col("row_id") % 10 == 0).alias("page"), (F.col("row_id") % 7 == 0).alias("note"), F.col("row_id").cast("string").alias("r"))
    docs = rows.groupBy("file_name").agg(F.array_sort(F.collect_list(part)).alias("rows"))

    def piece(x, k):
        before, after = F.get("rows", k - 1), F.get("rows", k + 1)
        new_chapter, new_section = (k == 0) | (before["chapter"] != x["chapter"]), (k == 0) | (before["chapter"] != x["chapter"]) | (before["section"] != x["section"])
        end_section = after.isNull() | (after["chapter"] != x["chapter"]) | (after["section"] != x["section"])
        end_chapter = after.isNull() | (after["chapter"] != x["chapter"])
        return F.concat(
            F.when(new_chapter, F.concat(F.lit("<div subtype='chapter' n = \""), x["chapter"], F.lit('">\n'))).otherwise(""),
            F.when(new_section, F.concat(F.lit('<div subtype="section" n="'), x["section"], F.lit('">'))).otherwise(""),
            F.when(x["page"], F.concat(F.lit('<pb n="'), x["r"], F.lit('"/>'))).otherwise(""),
            F.lit("<p>"), x["t"], F.lit("</p>"),
            F.when(x["note"], F.lit("<note>a remark</note>")).otherwise(""),
            F.when(end_section, F.lit("</div>")).otherwise(""),
            F.when(end_chapter, F.lit("</div>\n")).otherwise(""),
        )

    body = F.array_join(F.transform("rows", piece), "")
    head = F.concat(F.lit("<TEI><teiHeader><fileDesc><titleStmt><title>"), F.col("file_name"), F.lit(".</title><author>ANN OF THE ROUEN</author></titleStmt><publicationStmt><p>one</p><p>two</p></publicationStmt></fileDesc></teiHeader>\n<body><!-- a <b> c -->"))
    return docs.select("file_name", F.concat(head, body, F.lit("</body></TEI>")).alias("xml"))


def q_xml_roles(spark: SparkSession, d: str) -> DataFrame:
    body = E.body_events(E.xml_events(nested_xml(spark, d), "file_name", "xml"), "file_name")
    roles = E.attribute_roles(body, "file_name")
    return roles.select("file_name", "tag", F.replace("keys", F.lit("\x1f"), F.lit(",")).alias("keys"), "value_key", F.array_join("name_keys", ",").alias("name_keys"), "is_section")


def q_attribute_values(spark: SparkSession, d: str) -> DataFrame:
    body = E.body_events(E.xml_events(nested_xml(spark, d), "file_name", "xml"), "file_name")
    return E.attribute_values(body, "file_name").select("file_name", "tag", F.replace("keys", F.lit("\x1f"), F.lit(",")).alias("keys"), "attr", "n_values")


def _from_xml(spark: SparkSession, d: str) -> Graph:
    return xml_to_graph(nested_xml(spark, d), "file_name", "xml", XML_PROFILE)


def q_xml_convert_slots(spark: SparkSession, d: str) -> DataFrame:
    return _from_xml(spark, d).slots


def q_xml_convert_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _from_xml(spark, d).units.select("file_name", "otype", "value", "from_slot", "to_slot")


def q_xml_convert_header(spark: SparkSession, d: str) -> DataFrame:
    return _from_xml(spark, d).metadata


def q_recovered_xml(spark: SparkSession, d: str) -> DataFrame:
    """The same documents with closing tags lost, strayed and crossed, after recovery: what is opened and closed, and their texts."""
    docs = nested_xml(spark, d)
    broken = F.regexp_replace(F.regexp_replace(F.regexp_replace("xml", "</p><note>", "<note>"), "</div>\n", "</x></y>"), "</body></TEI>", "")
    whole = recover_xml(docs.select("file_name", broken.alias("xml")), "file_name", "xml")
    events = E.xml_events(whole, "file_name", "xml")
    kinds = lambda *codes: F.count_if(F.col("code").isin(*codes) & F.col("tag").isin("p", "div", "note", "body", "TEI"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("code") == "text", F.struct("pos", "text")))), lambda x: x["text"]), "|")
    return events.groupBy("file_name").agg(kinds("openTag", "openAttrTag", "bodyStart").alias("opened"), kinds("closeTag", "bodyStop").alias("closed"), F.md5(texts).alias("texts"))


def q_corrections(spark: SparkSession, d: str) -> DataFrame:
    events = E.xml_events(nested_xml(spark, d), "file_name", "xml", {"chapter": "capitulum", "1": "I"})
    return events.where("tag = 'div' AND attrs IS NOT NULL").groupBy("file_name", F.col("attrs")["subtype"].alias("kind"), F.col("attrs")["n"].alias("n")).agg(F.count("*").alias("divisions"))


def q_xml_fillers(spark: SparkSession, d: str) -> DataFrame:
    """A work's author as the text of a second part; the first part is empty, the last volume has none."""
    w = table(spark, d, "works").groupBy("work_id").agg(F.max("author").alias("a")).where(F.col("a").rlike(_C))
    xml = F.concat(F.lit('<TEI><body><div subtype="volume" n="2"><div subtype="part" n="'), F.col("work_id"), F.lit('" corresp="c"></div><div subtype="part" n="7"><p>'), _escaped("a"), F.lit('</p></div></div><div subtype="volume" n="3"><p>Last</p></div></body></TEI>'))
    graph = xml_to_graph(w.select("work_id", xml.alias("xml")), "work_id", "xml", replace(XML_PROFILE, ignored_attributes=("corresp",)))
    return graph.units.where(~F.col("otype").startswith("_")).select("work_id", "otype", "value", "from_slot", "to_slot")


def _bodies(text: str, where: str = "") -> str:
    """CTEs from lines to sl, the slots of files with their row's values."""
    own = "row_id, file_name, line_at, chapter, section, line"
    return (
        _PARSED
        + f", lines AS (SELECT t.row_id, t.chapter, t.section, t.line, t.text, file_name, c.line_no::BIGINT * 1000000000 + c.row_id AS line_at FROM told t JOIN citation_rows c USING (row_id) WHERE reason IS NULL {where}), "
        f"ta AS (SELECT *, trim({text}, ' ') AS t, lead(line_at) OVER w IS NULL AS is_last FROM lines WINDOW w AS (PARTITION BY file_name ORDER BY line_at)), "
        "tb AS (SELECT *, regexp_matches(t, '[-<]\\z') AND NOT is_last AS opened FROM ta), "
        "tc AS (SELECT *, opened AND NOT contains(t, ' ') AS single, regexp_replace(t, '[-<]+\\z', '') AS bare FROM tb), "
        "td AS (SELECT *, coalesce(sum((NOT single)::INT) OVER (PARTITION BY file_name ORDER BY line_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM tc), "
        "te AS (SELECT file_name, row_number() OVER (PARTITION BY file_name ORDER BY line_at) AS island, CASE WHEN opened THEN regexp_extract(bare, '([^ ]*)\\z', 1) ELSE '' END AS tail FROM td WHERE NOT single), "
        "tf AS (SELECT td.*, coalesce(tail, '') || coalesce(string_agg(CASE WHEN single THEN bare END, '') OVER (PARTITION BY td.file_name, island ORDER BY line_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || CASE WHEN opened THEN regexp_replace(bare, '[^ ]*\\z', '') ELSE t END AS b FROM td LEFT JOIN te USING (file_name, island)), "
        f"bodies AS (SELECT {own}, CASE WHEN single THEN '' WHEN b = '' OR regexp_matches(b, '[-<\\s]\\z') THEN b ELSE b || ' ' END AS body FROM tf), "
        + sql_runs(f"{_C}[{_L}]*", "bodies", own, "body")
        + f", worded AS (SELECT row_id FROM cut WHERE word IS NOT NULL GROUP BY 1), "
        f"apart AS (SELECT b.row_id, b.file_name, b.line_at, w.row_id IS NOT NULL AS has, CASE WHEN w.row_id IS NULL THEN body ELSE regexp_extract(first, '(?s)^((?:.[^{_Z}]*{_Z})+)', 1) END AS lead FROM bodies b LEFT JOIN worded w USING (row_id) LEFT JOIN (SELECT row_id, first FROM cut WHERE no = 1) USING (row_id)), "
        "tg AS (SELECT *, coalesce(sum(has::INT) OVER (PARTITION BY file_name ORDER BY line_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS target FROM apart), "
        "loose AS (SELECT file_name, target, string_agg(lead, '' ORDER BY line_at) AS loose FROM tg GROUP BY 1, 2), "
        f"sl0 AS (SELECT {', '.join('cut.' + c for c in own.split(', '))}, no, word, tg.target, CASE WHEN no = 1 THEN substr(first, length(tg.lead) + 1) ELSE cut_pre END AS pre, CASE WHEN last <> '' THEN last ELSE cut_post END AS post, row_number() OVER (PARTITION BY cut.row_id ORDER BY no DESC) = 1 AS at_end, "
        "row_number() OVER (PARTITION BY cut.file_name ORDER BY cut.line_at, no) AS slot FROM cut JOIN tg USING (row_id) WHERE word IS NOT NULL), "
        f"sl AS (SELECT s.file_name, s.line_at, s.chapter, s.section, s.line, s.slot, trim(CASE WHEN s.target = 0 AND s.no = 1 THEN coalesce(a.loose, '') ELSE '' END || pre, chr(10)) AS pre, trim(post || CASE WHEN at_end THEN coalesce(b.loose, '') ELSE '' END, chr(10)) AS post, word AS orig, lower(word) AS main, {sql_plain('word')} AS plain "
        "FROM sl0 s LEFT JOIN loose a ON a.file_name = s.file_name AND a.target = 0 LEFT JOIN loose b ON b.file_name = s.file_name AND b.target = s.target + 1)"
    )


def _units(levels: list[str], more: str = "", title: str = "coalesce(title, 'no title found in metadata')") -> str:
    """CTEs from sl to u (file_name, otype, seq, value, from_slot, to_slot)."""
    new = " OR ".join
    flags = ", ".join(f"(lag(slot) OVER w IS NULL OR {new(f'{c} IS DISTINCT FROM lag({c}) OVER w' for c in levels[: k + 1])})::INT AS n_{x}" for k, x in enumerate(levels))
    kinds = " UNION ALL ".join(
        [f"SELECT file_name, '{x}' AS otype, sum(n_{x}) OVER (PARTITION BY file_name ORDER BY slot) AS seq, {x} AS value, slot FROM f" for x in levels]
        + [f"SELECT file_name, '_{x}', {x}, {x}::VARCHAR, slot FROM n" for x in ("sentence", "phrase")]
    )
    marks = lambda m, a: f"1 + coalesce(sum(regexp_matches(post, '[{m}]')::INT) OVER (PARTITION BY file_name ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS {a}"
    return (
        f", f AS (SELECT *, {flags} FROM sl WINDOW w AS (PARTITION BY file_name ORDER BY slot)), n AS (SELECT *, {marks('.?!', 'sentence')}, {marks('.?!,;:', 'phrase')} FROM sl), k AS ({kinds}), "
        "ti AS (SELECT work_id, arg_max(title, loaded_at) AS title FROM works GROUP BY 1), "
        "u AS (SELECT file_name, otype, seq, value, min(slot) AS from_slot, max(slot) AS to_slot FROM k GROUP BY ALL "
        f"UNION ALL SELECT file_name, '_book', 1, any_value({title}), 1, max(slot) FROM sl LEFT JOIN ti ON work_id = regexp_extract(file_name, '^([a-z]+[0-9]+-[0-9]+)', 1) GROUP BY file_name {more})"
    )


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}

_ROWS = _bodies("coalesce(text, '')")
_XML_TEXT = "trim(regexp_replace(regexp_replace(translate(text, '<>&', '()+'), '-[ \\t]*\\r?\\n\\s*', '-', 'g'), '\\r?\\n', ' ', 'g'), ' ')"
_XML = _bodies(_XML_TEXT, f"AND regexp_matches(text, '{_C}')")
_P = "SELECT file_name, line_at, min(slot) AS a, max(slot) AS z FROM sl GROUP BY 1, 2"

ORACLES = {
    "q_convert_slots": _ROWS + " SELECT file_name, slot, pre, post, orig, main, plain FROM sl",
    "q_convert_nodes": _ROWS + _units(LEVELS) + " SELECT file_name, max(CASE otype WHEN '_book' THEN to_slot END) OVER (PARTITION BY file_name) + row_number() OVER (PARTITION BY file_name ORDER BY otype, seq) AS node, otype, value, from_slot, to_slot FROM u",
    "q_convert_meta": _ROWS + _units(LEVELS) + " SELECT file_name, otype AS feature, 'valueType' AS key, CASE WHEN otype <> '_book' AND bool_and(regexp_full_match(value, '[0-9]+')) THEN 'int' ELSE 'str' END AS value FROM u GROUP BY 1, 2 "
    "UNION ALL SELECT file_name, unnest(['pre', 'post', 'orig', 'main', 'plain']), 'valueType', 'str' FROM (SELECT DISTINCT file_name FROM sl) UNION ALL SELECT file_name, '_book', 'description', value FROM u WHERE otype = '_book' "
    "UNION ALL SELECT DISTINCT file_name, 'section', 'description', 'structure feature of the 2nd level' FROM sl",
    "q_convert_otext": _ROWS + " SELECT DISTINCT file_name, t.key, t.value FROM sl, (VALUES ('fmt:text-orig-orig', '{pre}{orig}{post}'), ('fmt:text-orig-main', '{main} '), ('fmt:text-orig-plain', '{plain} '), ('sectionTypes', 'chapter,section,line'), ('sectionFeatures', 'chapter,section,line'), ('structureTypes', '_book,chapter,section,line,_sentence,_phrase'), ('structureFeatures', '_book,chapter,section,line,_sentence,_phrase')) t(key, value)",
    "q_recovered_xml": _XML + f", ch AS (SELECT *, (lag(chapter) OVER w IS DISTINCT FROM chapter)::INT AS a, (lag(chapter) OVER w IS DISTINCT FROM chapter OR lag(section) OVER w IS DISTINCT FROM section)::INT AS b FROM lines WINDOW w AS (PARTITION BY file_name ORDER BY line_at)), "
    f"n AS (SELECT file_name, (count(*) + 2 + sum(a) + sum(b) + 2 + count(*) FILTER (row_id % 7 = 0))::BIGINT AS opened, md5(file_name || '.|ANN OF THE ROUEN|one|two|' || string_agg({_XML_TEXT} || CASE WHEN row_id % 7 = 0 THEN '|a remark' ELSE '' END, '|' ORDER BY line_at)) AS texts FROM ch GROUP BY 1) SELECT file_name, opened, opened AS closed, texts FROM n",
    "q_corrections": _XML + ", ch AS (SELECT *, lag(chapter) OVER w IS DISTINCT FROM chapter AS a, lag(chapter) OVER w IS DISTINCT FROM chapter OR lag(section) OVER w IS DISTINCT FROM section AS b FROM lines WINDOW w AS (PARTITION BY file_name ORDER BY line_at)), k AS (SELECT file_name, 'capitulum' AS kind, chapter AS n FROM ch WHERE a UNION ALL SELECT file_name, 'section', section FROM ch WHERE b) SELECT file_name, kind, CASE n WHEN '1' THEN 'I' ELSE n END AS n, count(*) AS divisions FROM k GROUP BY 1, 2, 3",
    "q_xml_fillers": f"WITH aw AS (SELECT work_id, translate(max(author), '<>&', '()+') AS a FROM works GROUP BY 1), " + sql_runs(f"{_C}[{_L}]*", "aw", "work_id", "a") + ", c AS (SELECT work_id, count(word) AS n FROM cut GROUP BY 1 HAVING count(word) > 0) "
    "SELECT work_id, t.otype, coalesce(t.value, work_id) AS value, t.a + CASE WHEN t.x = 1 THEN n ELSE 0 END AS from_slot, t.z + CASE WHEN t.y = 1 THEN n ELSE 0 END AS to_slot FROM c, (VALUES ('volume', '2', 1, 0, 1, 1), ('part', NULL, 1, 0, 1, 0), ('corresp', 'c', 1, 0, 1, 0), ('part', '7', 2, 0, 1, 1), ('p', '1', 2, 0, 1, 1), ('volume', '3', 2, 1, 2, 1), ('part', '0', 2, 1, 2, 1), ('p', '2', 2, 1, 2, 1)) t(otype, value, a, x, z, y)",
    "q_xml_roles": _XML + ", fl AS (SELECT DISTINCT file_name FROM lines) SELECT file_name, 'div' AS tag, 'subtype,n' AS keys, 'n' AS value_key, 'subtype' AS name_keys, true AS is_section FROM fl UNION ALL SELECT DISTINCT file_name, 'pb', 'n', 'n', '', false FROM lines WHERE row_id % 10 = 0",
    "q_attribute_values": _XML + " SELECT file_name, 'div' AS tag, 'subtype,n' AS keys, 'subtype' AS attr, 2 AS n_values FROM lines GROUP BY 1 UNION ALL SELECT file_name, 'div', 'subtype,n', 'n', count(DISTINCT v) FROM (SELECT file_name, unnest([chapter, section]) AS v FROM lines) GROUP BY 1 UNION ALL SELECT file_name, 'pb', 'n', 'n', count(*) FROM lines WHERE row_id % 10 = 0 GROUP BY 1",
    "q_xml_convert_slots": _XML + " SELECT file_name, slot, pre, post, orig, main, plain FROM sl",
    "q_xml_convert_nodes": _XML + f", pr AS (SELECT l.file_name, l.line_at, l.row_id, a, z FROM lines l LEFT JOIN ({_P}) p USING (file_name, line_at)), pq AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY line_at) AS no, coalesce(max(z) OVER (PARTITION BY file_name ORDER BY line_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, coalesce(max(z) OVER (PARTITION BY file_name ORDER BY line_at), 0) AS after, max(z) OVER (PARTITION BY file_name) AS total FROM pr), "
    "pb AS (SELECT file_name, row_id, before, lead(before, 1, total) OVER (PARTITION BY file_name ORDER BY line_at) AS until FROM pq WHERE row_id % 10 = 0), pn AS (SELECT file_name, after, string_agg('a remark', ' ' ORDER BY line_at) AS value, any_value(total) AS total FROM pq WHERE row_id % 7 = 0 GROUP BY file_name, after), "
    "pm AS (SELECT *, lead(after, 1, total) OVER (PARTITION BY file_name ORDER BY after) AS until FROM pn)"
    + _units(LEVELS[:2], "UNION ALL SELECT file_name, 'p', no, no::VARCHAR, a, z FROM pq WHERE a IS NOT NULL UNION ALL SELECT file_name, 'pb', 0, row_id::VARCHAR, before + 1, until FROM pb WHERE until > before UNION ALL SELECT file_name, 'note', 0, value, after + 1, until FROM pm WHERE until > after", "file_name")
    + " SELECT file_name, otype, value, from_slot, to_slot FROM u",
    "q_xml_convert_header": _XML + " SELECT DISTINCT file_name, t.key, CASE t.key WHEN 'title' THEN file_name ELSE t.value END AS value FROM lines, (VALUES ('title', ''), ('author', 'Ann of the Rouen'), ('publicationStmt', 'one, two.')) t(key, value)",
}
