"""Queries of sections, graph, XML, bibliography, witnesses and quality, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import refs as R
from quillspark.functions import text as T
from quillspark.operators import bibliography as B
from quillspark.operators import graph as G
from quillspark.operators import quality as Q
from quillspark.operators import sections as S
from quillspark.operators import slots as O
from quillspark.operators import witness as V
from quillspark.operators import xml_events as E
from quillspark.operators.citations import parse_citations
from quillspark.operators.segments import cut_heads
from quillspark.plans.convert_queries import _XML as _NESTED, _XML_TEXT
from quillspark.plans.convert_queries import lines as _lines
from quillspark.plans.convert_queries import nested_xml
from quillspark.plans.problems import _PARSED
from quillspark.plans.text_queries import TOKENS, UNITS
from quillspark.session import spread, table
from quillspark.sources.files import header_names, list_files, sniff_delimiter
from quillspark.sources.sinks import numbered_paths, output_path

LEVELS = ["chapter", "section", "line"]


# --- sections and references


def q_sections(spark: SparkSession, d: str) -> DataFrame:
    thousands = F.floor(F.col("line_at") / 1_000_000_000_000)  # of lines, so that no long file is one task's work
    rows = S.number_sections(_lines(spark, d), "file_name", "line_at", LEVELS, "text", thousands)
    return rows.select("row_id", *[f"{x}_node" for x in LEVELS])


def q_verse_changes(spark: SparkSession, d: str) -> DataFrame:
    return S.verse_changes(_lines(spark, d), "file_name", "line_at", LEVELS)


def q_backfill(spark: SparkSession, d: str) -> DataFrame:
    nums = _lines(spark, d).select("file_name", "line_at", F.when(F.col("line") == "1", 0).otherwise(G.as_int(F.col("line"))).alias("value"))
    return S.backfill_levels(nums, "file_name", "line_at", "value")


def q_refs(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "citation_rows").where("line_no > 1").select(F.split("raw_line", "[\t,;]").alias("parts"))
    ref = raw.select(F.explode(F.slice("parts", 1, 3)).alias("ref")).distinct()
    return ref.select("ref", R.clean_ref(F.col("ref")).alias("cleaned"))


def q_ref_align(spark: SparkSession, d: str) -> DataFrame:
    refs = _lines(spark, d).select(F.concat_ws(".", "chapter", "section", "line").alias("ref")).distinct()
    two, five = (R.align_right(F.split("ref", r"\."), F.lit(n)) for n in (2, 5))
    return refs.select("ref", F.array_join(two, "|", "~").alias("two"), F.array_join(five, "|", "~").alias("five"))


def q_schemes(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "works").select("work_id", "citation_scheme").distinct()
    return w.select("work_id", F.array_join(R.scheme_parts(F.col("citation_scheme")), "|").alias("levels"), F.size(R.scheme_parts(F.col("citation_scheme"))).alias("n"))


def q_scheme_labels(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "works").select("work_id", F.explode(F.sequence(F.lit(1), F.greatest(F.size(R.scheme_parts(F.coalesce("citation_scheme", F.lit("")))), F.lit(1)))).alias("n")).distinct()
    return parts.select("work_id", "n", R.ordinal_label(F.col("n")).alias("label"))


def q_verse_codes(spark: SparkSession, d: str) -> DataFrame:
    refs = _lines(spark, d).select(F.concat(F.lit("B0"), F.length("file_name").cast("string"), F.lit("K"), F.regexp_extract("chapter", "^([0-9]+)", 1), F.lit("V"), F.regexp_extract("section", "^([0-9]+)", 1)).alias("ref")).distinct()
    return refs.select("ref", R.verse_levels(F.col("ref")).alias("v")).select("ref", "v.*")


def q_sigla(spark: SparkSession, d: str) -> DataFrame:
    nums = table(spark, d, "works").select(F.regexp_replace("work_id", "[^0-9]", "").alias("n")).distinct()
    five = F.concat(((F.substring("n", 4, 1).cast("int") % 4) + 1).cast("string"), F.substring("n", 1, 4))
    number = F.when(F.col("n").endswith("7"), F.concat(F.substring(five, 1, 4), F.lit("S"))).when(F.col("n").endswith("8"), F.substring(five, 1, 4)).otherwise(five)
    place = F.when(F.substring("n", 5, 1) == "1", "Birmingham").when(F.substring("n", 5, 1) == "2", "Muenster").otherwise("Lyon")
    return nums.select("n", R.manuscript_siglum(number, place).alias("siglum"))


def q_headers(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "citation_rows").where("line_no = 1")
    return first.select("row_id", sniff_delimiter(F.col("raw_line")).alias("sniffed"), F.array_join(header_names(F.col("raw_line"), F.col("sep_char")), "|").alias("names"))


def q_files(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "citation_rows")
    return rows.groupBy(F.regexp_extract("file_name", r"\.([a-z]+)\z", 1).alias("extension")).agg(F.count_distinct("file_name").alias("files"), F.count("*").alias("records"), F.count_if(F.col("line_no") > 1).alias("body_records"))


OWN_TABLES = ["documents", "slots", "node_features", "oslots", "works", "citation_rows", "wordforms", "lemmata", "sources"]


def q_listing(spark: SparkSession, d: str) -> DataFrame:
    found = list_files(spark, d, extensions=("parquet",))
    return found.where(F.col("name").isin(*[f"{t}.parquet" for t in OWN_TABLES])).select("name", "extension", (F.col("bytes") > 0).alias("filled"))


def q_carry(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    cut = lines.withColumn("line", F.when(F.col("line_no") % 5 == 2, F.concat("line", F.lit("-"))).otherwise(F.col("line")))
    return S.carry_lines(cut, "doc_id", "line_no", "line").select("doc_id", "line_no", F.md5("text").alias("text"))


def q_continuations(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    done = S.fill_continuations(lines, "doc_id", "line_no", "line", F.col("line").rlike(r"[.?!]\s*\z"))
    return done.select("doc_id", "line_no", F.md5("text").alias("text"))


def q_heads(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").where(F.col("text").contains("{")).select("doc_id", "text", F.lit(0).alias("line_no")), "doc_id")
    heads = cut_heads(docs, "doc_id", "line_no", "text").where("head IS NOT NULL")
    return heads.select("doc_id", "head_no", F.trim(F.translate("head", "{}", "")).alias("head"))


def q_citations(spark: SparkSession, d: str) -> DataFrame:
    """Rows as plain citation text: some references broken over two lines, some without text, blank lines between."""
    rows = _lines(spark, d)
    ref, text = F.concat_ws(".", "section", "line"), F.concat(F.lit("§ "), F.regexp_replace("text", r"[\r\n]", " "))
    whole = F.concat(F.col("chapter"), F.lit("."), ref, F.lit("\t"), text)
    parts = F.when(F.col("row_id") % 5 == 0, F.array(F.concat("chapter", F.lit(".")), F.lit(" "), F.concat(ref, F.lit("\t"), text))).when(F.col("row_id") % 7 == 0, F.array(F.lit("x.y.z"), whole)).otherwise(F.array(whole))
    lines = rows.select("file_name", "line_at", F.posexplode(parts).alias("k", "line")).select("file_name", (F.col("line_at") * 4 + F.col("k")).alias("place"), "line", F.lit(3).alias("n"))
    return parse_citations(lines, "file_name", "place", "line", "n").select("file_name", "place", F.array_join("refs", "|", "~").alias("refs"), "text")


# --- graph


def _units(spark: SparkSession, d: str) -> DataFrame:
    slots = O.number_units(O.explode_slots(table(spark, d, "documents"), "doc_id", "text"), "doc_id")
    return G.number_nodes(G.units_as_nodes(slots, "doc_id"), "doc_id")


def q_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).select("doc_id", "node", "otype", "seq")


def q_oslots(spark: SparkSession, d: str) -> DataFrame:
    r = G.containment(_units(spark, d), "doc_id")
    return r.select("doc_id", "node", F.explode("ranges").alias("r")).select("doc_id", "node", "r.*")


def q_slot_ranges(spark: SparkSession, d: str) -> DataFrame:
    known = O.once(table(spark, d, "slots"), ["doc_id", "slot"], "loaded_at").where("lemma IS NOT NULL AND lemma <> ''").withColumn("node", F.lit(0).cast("long"))
    r = G.slot_ranges(known, "doc_id", "node")
    return r.select("doc_id", F.size("ranges").alias("runs"), F.element_at("ranges", 1)["from_slot"].alias("first"), F.element_at("ranges", -1)["to_slot"].alias("last"))


def q_locate(spark: SparkSession, d: str) -> DataFrame:
    sentences = table(spark, d, "node_features").where("feature = '_sentence'").select("doc_id", "node").distinct()
    ranges = table(spark, d, "oslots").join(sentences, ["doc_id", "node"], "left_semi").select("doc_id", "node", F.inline("ranges")).distinct()
    slots = table(spark, d, "slots").select("doc_id", "slot").distinct()
    return G.locate_slots(slots, ranges, "doc_id")


def q_value_types(spark: SparkSession, d: str) -> DataFrame:
    return G.value_types(table(spark, d, "node_features"), "feature", "feature_value")


def q_feature_lines(spark: SparkSession, d: str) -> DataFrame:
    return G.feature_lines(table(spark, d, "node_features").distinct(), "doc_id").select("doc_id", "feature", "node", "line")


def q_feature_header(spark: SparkSession, d: str) -> DataFrame:
    return G.feature_header(G.value_types(table(spark, d, "node_features"), "feature", "feature_value"), {"version": "1.0", "language": "mixed"})


def q_metadata_path(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "works").drop("loaded_at").distinct()
    c = F.col
    paths = w.select("work_id", output_path([[c("author"), c("geography")], [c("title")], [c("place"), c("publication_year")]], [["author", "geography"], ["title"], ["place", "publication_year"]]).alias("path"), R.code_path(F.regexp_replace("work_id", "^([a-z]+)([0-9]+)-", "$1 $2 ")).alias("by_code"))
    return numbered_paths(paths, "path", "work_id").drop("edition")


def q_set_overlap(spark: SparkSession, d: str) -> DataFrame:
    lex = table(spark, d, "lemmata").select("form", F.col("lemma").alias("known"))
    told = table(spark, d, "slots").select("plain", "lemma").where("plain <> '' AND lemma <> ''").distinct().join(lex, F.col("plain") == F.col("form"))
    return told.select("plain", "lemma", F.array_join("known", ",").alias("known"), G.overlap_everywhere(F.array(F.split("lemma", ",")), F.array("known")).alias("meets"))


# --- XML


def _xml(spark: SparkSession, d: str) -> DataFrame:
    """Each work as a small XML document."""
    esc = lambda c: F.translate(F.coalesce(c, F.lit("")), '<>&"\n', "()+' ")
    w = table(spark, d, "works").drop("loaded_at").distinct()
    return w.select(
        "work_id",
        F.concat(
            F.lit("<TEI><teiHeader><title>"), esc(F.col("title")), F.lit("</title><author>"), esc(F.col("author")), F.lit('</author></teiHeader>\n<body><!-- list --><div type="work" n = "'), F.col("work_id"), F.lit('"><head>'), esc(F.col("lang")),
            F.lit('</head><p>'), esc(F.col("citation_scheme")), F.lit('</p><pb n="'), esc(F.col("publication_year")), F.lit('"/><lb/></div></body></TEI>'),
        ).alias("xml"),
    )


def q_xml_events(spark: SparkSession, d: str) -> DataFrame:
    return E.xml_events(_xml(spark, d), "work_id", "xml").select("work_id", "pos", "code", "tag", "text", F.col("attrs")["n"].alias("n"))


def q_body_tags(spark: SparkSession, d: str) -> DataFrame:
    return E.number_tags(E.body_events(E.xml_events(_xml(spark, d), "work_id", "xml"), "work_id"), "work_id")


def q_depth(spark: SparkSession, d: str) -> DataFrame:
    e = E.with_depth(E.xml_events(_xml(spark, d), "work_id", "xml"), "work_id")
    return e.groupBy("code", "depth").agg(F.count("*").alias("n"))


def q_attr_profile(spark: SparkSession, d: str) -> DataFrame:
    return E.attribute_profile(E.xml_events(_xml(spark, d), "work_id", "xml"))


def q_value_keys(spark: SparkSession, d: str) -> DataFrame:
    return E.value_keys(q_attr_profile(spark, d))


def q_element_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = E.element_spans(E.body_events(E.xml_events(nested_xml(spark, d), "file_name", "xml"), "file_name"), "file_name")
    return spans.groupBy("file_name", "tag").agg(F.count("*").alias("opened"), F.count("close_pos").alias("closed"), F.sum(F.when(F.col("tag") != "div", F.col("close_pos") - F.col("pos"))).alias("inside"))


def q_xml_sections(spark: SparkSession, d: str) -> DataFrame:
    body = E.body_events(E.xml_events(nested_xml(spark, d), "file_name", "xml"), "file_name")
    return E.xml_sections(body, "file_name", "div", "subtype", "n", ["chapter", "section"]).select("file_name", "chapter", "section", "text")


def q_header_fields(spark: SparkSession, d: str) -> DataFrame:
    return E.header_fields(E.xml_events(_xml(spark, d), "work_id", "xml"), "work_id")


def q_transcription(spark: SparkSession, d: str) -> DataFrame:
    safe = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[<>&]", "&amp;")
    t = F.concat(F.lit("<w>"), safe("orig"), F.lit('</w><lb break="no"/><note>x</note>'), safe("post"), F.lit("<lb/>y<gap/>&amp;"))
    s = table(spark, d, "slots").select("orig", "post").distinct()
    return s.select("orig", "post", E.clean_transcription(t).alias("cleaned"))


# --- bibliography and metadata


def q_bibliography(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "works").drop("loaded_at").distinct()
    one = lambda c: F.regexp_replace(F.trim(F.coalesce(F.col(c), F.lit(""))), r"\s+", " ")
    lines = F.array(F.concat(F.lit("key "), "work_id"), F.concat(F.lit("nam "), one("author")), F.concat(F.lit("tit "), one("title")), F.concat(F.lit("pla "), one("place")), F.concat(F.lit("    "), one("geography")), F.concat(F.lit("wct "), one("tlg_wordcount")))
    return B.parse_bibliography(w.select("work_id", F.posexplode(lines).alias("line_no", "line")).withColumnRenamed("work_id", "file"), "file", "line_no", "line")


def q_records(spark: SparkSession, d: str) -> DataFrame:
    records = B.as_records(q_bibliography(spark, d))
    return records.select("work_id", F.col("fields")["author"].alias("author"), F.size("fields").alias("n_fields"))


def q_titles(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "works").groupBy("work_id").agg(F.max(F.struct("loaded_at", "title"))["title"].alias("title"))
    return B.with_titles(table(spark, d, "documents").select("doc_id", "work_id"), "work_id", titles).select("doc_id", "title")


def q_title_list(spark: SparkSession, d: str) -> DataFrame:
    """Works as a list of authors, works and their titles on two lines."""
    w = table(spark, d, "works").groupBy("work_id").agg(F.max("title").alias("title"), F.max("place").alias("place"))
    code = lambda k: F.regexp_extract("work_id", "([0-9]+)-([0-9]+)", k)
    one = lambda c: F.regexp_replace(F.trim(F.coalesce(F.col(c), F.lit("-"))), r"\s+", " ")
    lines = F.array(code(1), F.concat(code(1), F.lit(" "), code(2)), one("title"), one("place"))
    return B.parse_titles(w.select("work_id", F.posexplode(lines).alias("n", "line")).withColumnRenamed("work_id", "file"), "file", "n", "line", "cpx")


def q_tidy_fields(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "works").groupBy("work_id").agg(F.max("author").alias("author"), F.max("place").alias("place"), F.max("citation_scheme").alias("scheme"))
    fields = F.array(F.struct(F.lit("author").alias("field"), F.concat(F.lit("<"), "author", F.lit("]")).alias("value")), F.struct(F.lit("place").alias("field"), F.upper("place").alias("value")), F.struct(F.lit("citation_scheme").alias("field"), F.upper("scheme").alias("value")), F.struct(F.lit("pages").alias("field"), F.upper("place").alias("value")))
    return B.tidy_fields(w.select("work_id", F.inline(fields)))


def q_authors(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "works").select("author").where("author IS NOT NULL").distinct()
    return w.select("author", T.author_case(F.concat(F.upper("author"), F.lit(" OF THE WEST"))).alias("cased"))


def q_word_counts(spark: SparkSession, d: str) -> DataFrame:
    n = G.as_int(F.replace(F.col("tlg_wordcount"), F.lit(","), F.lit("")))
    return table(spark, d, "works").select("work_id", "lang", n.alias("n")).distinct().groupBy("lang").agg(F.count("n").alias("works"), F.sum("n").alias("words"), F.max("n").alias("largest"))


def q_missing_meta(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "works").drop("loaded_at").distinct()
    return Q.missing_fields(w, "work_id", ["author", "title", "citation_scheme", "place", "geography", "publication_year"])


def q_without_work(spark: SparkSession, d: str) -> DataFrame:
    return Q.without_partner(table(spark, d, "documents").select("work_id", "doc_id"), table(spark, d, "works"), "work_id").select("doc_id")


def q_alphabet(spark: SparkSession, d: str) -> DataFrame:
    return Q.alphabet_faults(table(spark, d, "wordforms").where("orig IS NOT NULL"), "orig", r"\x{20}-\x{7E}\x{C0}-\x{17F}")


def q_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    return docs.join(table(spark, d, "sources"), "source", "left").select("source", "docs", "chars", F.coalesce("licence", F.lit("unknown")).alias("licence"))


# --- witnesses


def _readings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    hand = F.when(F.col("event_type") == "view", None).when(F.col("event_type") == "click", "").otherwise(F.col("event_type"))
    return e.select(F.col("user_id").alias("manuscript"), (F.col("event_id") % 7).alias("unit"), hand.alias("hand"), F.col("event_id").alias("pos"), F.col("props").alias("text"))


def q_witness_last(spark: SparkSession, d: str) -> DataFrame:
    return V.last_readings(_readings(spark, d), ["manuscript", "unit"], "hand", "pos", "text")


def q_witness_select(spark: SparkSession, d: str) -> DataFrame:
    r = _readings(spark, d)
    return V.select_readings(r, r.where("hand <> ''").select("manuscript", "hand"), "manuscript", "unit", "hand", "pos", "text")


def _transcriptions(spark: SparkSession, d: str) -> DataFrame:
    """Each manuscript's readings as XML: listed hands, verses, variant units."""
    r = _readings(spark, d).withColumn("t", F.translate(F.coalesce("text", F.lit("")), "<>&\"\n", "()+' "))
    rdg = F.concat(F.lit("<rdg type='x'"), F.when(F.col("hand").isNull(), "").otherwise(F.concat(F.lit(' hand="'), "hand", F.lit('V"'))), F.lit("><w>"), "t", F.lit("</w></rdg>"))
    units = r.withColumn("rdg", F.regexp_replace(rdg, 'hand="V"', 'hand=""')).groupBy("manuscript", "unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "rdg"))), lambda x: x["rdg"]), "\n").alias("app"), F.collect_set(F.when(F.col("hand") != "", F.col("hand"))).alias("hands"))
    units = units.withColumn("ab", F.concat(F.lit('<ab n="B0'), F.pmod(F.floor(F.col("unit") / 4), F.lit(4)), F.lit("K"), F.floor(F.col("unit") / 2), F.lit("V"), F.col("unit"), F.lit('">q <app>'), "app", F.lit("</app>\n</ab>")))
    docs = units.groupBy("manuscript").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit", "ab"))), lambda x: x["ab"]), "").alias("body"), F.array_distinct(F.flatten(F.collect_list("hands"))).alias("hands"))
    return docs.select("manuscript", F.concat(F.lit("<TEI><listWit>"), F.array_join(F.transform("hands", lambda h: F.concat(F.lit('<witness id="'), h, F.lit('"/>'))), ""), F.lit("</listWit><body>"), "body", F.lit("</body></TEI>")).alias("xml"))


def q_manuscripts(spark: SparkSession, d: str) -> DataFrame:
    return V.witness_texts(_transcriptions(spark, d), "manuscript", "xml")


# --- SQL

_LINES = _PARSED + ", lines AS (SELECT t.*, file_name, c.line_no::BIGINT * 1000000000 + row_id AS line_at FROM told t JOIN citation_rows c USING (row_id) WHERE reason IS NULL)"
_NEW = {
    "chapter": "row_number() OVER w = 1 OR chapter IS DISTINCT FROM lag(chapter) OVER w",
    "section": "row_number() OVER w = 1 OR chapter IS DISTINCT FROM lag(chapter) OVER w OR section IS DISTINCT FROM lag(section) OVER w",
    "line": "row_number() OVER w = 1 OR chapter IS DISTINCT FROM lag(chapter) OVER w OR section IS DISTINCT FROM lag(section) OVER w OR line IS DISTINCT FROM lag(line) OVER w",
}
_FLAGS = lambda where: ", f AS (SELECT *, " + ", ".join(f"({v})::INT AS f_{k}" for k, v in _NEW.items()) + f" FROM lines {where} WINDOW w AS (PARTITION BY file_name ORDER BY line_at))"
_ALIGN = "array_to_string(list_transform(range(1, {n} + 1), lambda i: coalesce(CASE WHEN len(p) - {n} + i >= 1 THEN p[(len(p) - {n} + i)::INT] END, '~')), '|')"
_KEPT = "regexp_replace(CASE WHEN regexp_matches(x, '^\\p{L}') THEN regexp_extract(x, '^(\\p{L}+)', 1) ELSE regexp_extract(regexp_extract(x, '^([^_]*)', 1), '^(\\P{L}*)', 1) END, '[^\\p{L}\\p{N}-]', '', 'g')"
_CLEAN = f"CASE WHEN regexp_full_match(x, '[0-9]+|\\p{{L}}+') THEN x WHEN regexp_full_match({_KEPT}, '\\p{{L}}+') THEN {_KEPT} ELSE regexp_replace({_KEPT}, '[A-Za-z]+\\z', '') END"
_DOC_LINES = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents)"
_NODES = UNITS + (
    ", k AS (SELECT doc_id, slot, '_book' AS otype, 1::BIGINT AS seq FROM u UNION ALL SELECT doc_id, slot, '_phrase', phrase FROM u UNION ALL SELECT doc_id, slot, '_sentence', sentence FROM u)"
    ", g AS (SELECT doc_id, otype, seq, min(slot) AS from_slot, max(slot) AS to_slot FROM k GROUP BY ALL)"
    ", n AS (SELECT *, max(to_slot) OVER (PARTITION BY doc_id) + row_number() OVER (PARTITION BY doc_id ORDER BY otype, seq) AS node FROM g)"
)
_ESC = lambda c: f"translate(coalesce({c}, ''), '<>&\"' || chr(10), '()+'' ')"
_XML = (
    "WITH w AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM works), x AS (SELECT work_id, '<TEI><teiHeader><title>' || " + _ESC("title") + " || '</title><author>' || " + _ESC("author")
    + " || '</author></teiHeader>' || chr(10) || '<body><!-- list --><div type=\"work\" n = \"' || work_id || '\"><head>' || " + _ESC("lang") + " || '</head><p>' || " + _ESC("citation_scheme")
    + " || '</p><pb n=\"' || " + _ESC("publication_year") + " || '\"/><lb/></div></body></TEI>' AS xml FROM w), "
    "p AS (SELECT work_id, regexp_extract_all(replace(xml, chr(10), ' '), '<!--[\\s\\S]*?-->|<[^>]*>|[^<]+') AS l FROM x), "
    "q AS (SELECT work_id, unnest(l) AS piece, unnest(range(0, len(l))) AS pos FROM p), "
    "e AS (SELECT work_id, pos, piece, CASE WHEN piece LIKE '<!--%' THEN 'comment' WHEN piece = '<body>' THEN 'bodyStart' WHEN piece = '</body>' THEN 'bodyStop' WHEN piece LIKE '</%' THEN 'closeTag' "
    "WHEN piece LIKE '<%=%/>' THEN 'closedAttrTag' WHEN piece LIKE '<%/>' THEN 'openCloseTag' WHEN piece LIKE '<%=%' THEN 'openAttrTag' WHEN piece LIKE '<%' THEN 'openTag' WHEN trim(piece, ' ') <> '' THEN 'text' END AS code, "
    "regexp_extract(piece, '^</?([A-Za-z]+)', 1) AS tag FROM q), "
    "ev AS (SELECT work_id, pos, piece, code, CASE WHEN code IN ('comment', 'text') THEN NULL ELSE tag END AS tag, CASE WHEN code = 'text' THEN trim(piece, ' ') END AS text FROM e WHERE code IS NOT NULL)"
)
_READINGS = "WITH r AS (SELECT user_id AS manuscript, event_id % 7 AS unit, CASE event_type WHEN 'view' THEN 'firsthand' WHEN 'click' THEN 'unknown' ELSE event_type END AS hand, event_id AS pos, props AS text FROM events), last AS (SELECT manuscript, unit, hand, arg_max(text, pos) AS text FROM r GROUP BY ALL)"
_WORKS = "WITH w AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM works)"
_ONE = lambda c: f"regexp_replace(trim(coalesce({c}, ''), ' '), '\\s+', ' ', 'g')"

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}

ORACLES = {
    "q_sections": _LINES + _FLAGS("WHERE text <> ''") + " SELECT row_id, " + ", ".join(f"sum(f_{k}) OVER w AS {k}_node" for k in LEVELS) + " FROM f WINDOW w AS (PARTITION BY file_name ORDER BY line_at) UNION ALL SELECT row_id, NULL, NULL, NULL FROM lines WHERE text = ''",
    "q_verse_changes": _LINES + _FLAGS("") + " " + " UNION ALL ".join(f"SELECT file_name, line_at, '{k}' AS level, {k} AS value FROM f WHERE f_{k} = 1" for k in LEVELS),
    "q_backfill": _LINES + ", n AS (SELECT file_name, line_at, CASE WHEN line = '1' THEN 0 WHEN regexp_full_match(line, '[0-9]{1,18}') THEN line::BIGINT END AS value FROM lines) SELECT *, CASE WHEN value = 0 AND lead(value) OVER w IS NOT NULL THEN lead(value) OVER w - 1 ELSE value END AS filled FROM n WINDOW w AS (PARTITION BY file_name ORDER BY line_at)",
    "q_citations": _LINES + ", r AS (SELECT file_name, line_at * 4 + CASE WHEN row_id % 5 = 0 THEN 2 WHEN row_id % 7 = 0 THEN 1 ELSE 0 END AS place, string_split(concat_ws('.', chapter || CASE WHEN row_id % 5 = 0 THEN '. ' ELSE '.' END || section, line), '.') AS p, trim(regexp_replace(regexp_replace(regexp_replace('§ ' || text, '[\\r\\n\\t]', ' ', 'g'), '^\\s+', ''), '\\s+\\z', ''), ' ') AS text FROM lines), "
    "c AS (SELECT file_name, place, text, list_transform(list_filter(p, lambda x: x <> ''), lambda x: " + _CLEAN + ") AS c FROM r), f AS (SELECT file_name, place, text, list_filter(c, lambda x: x <> '') AS p FROM c) SELECT file_name, place, " + _ALIGN.format(n=3) + " AS refs, text FROM f",
    "q_refs": "WITH r AS (SELECT DISTINCT unnest(regexp_split_to_array(raw_line, '[\\t,;]')[1:3]) AS ref FROM citation_rows WHERE line_no > 1), c AS (SELECT ref, regexp_extract(ref, '^([^_]*)', 1) AS cut FROM r), k AS (SELECT ref, regexp_replace(CASE WHEN regexp_matches(cut, '^\\p{L}') THEN regexp_extract(cut, '^(\\p{L}+)', 1) ELSE regexp_extract(cut, '^(\\P{L}*)', 1) END, '[^\\p{L}\\p{N}-]', '', 'g') AS kept FROM c) SELECT ref, CASE WHEN regexp_full_match(ref, '[0-9]+|\\p{L}+') THEN ref WHEN regexp_full_match(kept, '\\p{L}+') THEN kept ELSE regexp_replace(kept, '[A-Za-z]+\\z', '') END AS cleaned FROM k",
    "q_ref_align": _LINES + ", r AS (SELECT DISTINCT concat_ws('.', chapter, section, line) AS ref FROM lines), k AS (SELECT ref, list_filter(string_split(ref, '.'), lambda x: x <> '') AS p FROM r) SELECT ref, " + _ALIGN.format(n=2) + " AS two, " + _ALIGN.format(n=5) + " AS five FROM k",
    "q_schemes": "WITH w AS (SELECT DISTINCT work_id, list_filter(string_split(lower(citation_scheme), '/'), lambda x: x <> '') AS l FROM works) SELECT work_id, array_to_string(l, '|') AS levels, len(l) AS n FROM w",
    "q_scheme_labels": "WITH w AS (SELECT DISTINCT work_id, greatest(len(list_filter(string_split(lower(coalesce(citation_scheme, '')), '/'), lambda x: x <> '')), 1) AS k FROM works), n AS (SELECT DISTINCT work_id, unnest(range(1, k + 1)) AS n FROM w) SELECT work_id, n, 'structure feature of the ' || CASE n WHEN 1 THEN '1st' WHEN 2 THEN '2nd' WHEN 3 THEN '3rd' ELSE n || 'th' END || ' level' AS label FROM n",
    "q_verse_codes": _LINES + ", r AS (SELECT DISTINCT 'B0' || length(file_name) || 'K' || regexp_extract(chapter, '^([0-9]+)', 1) || 'V' || regexp_extract(section, '^([0-9]+)', 1) AS ref FROM lines) SELECT ref, regexp_extract(ref, 'B([0-9]+)', 1) AS book, regexp_extract(ref, 'K([0-9]+)', 1) AS chapter, regexp_extract(ref, 'V([0-9]+)', 1) AS verse FROM r",
    "q_sigla": "WITH n AS (SELECT DISTINCT regexp_replace(work_id, '[^0-9]', '', 'g') AS n FROM works) SELECT n, CASE substr(n, 5, 1) WHEN '1' THEN 'B_' WHEN '2' THEN 'M_' ELSE '' END || CASE WHEN n LIKE '%7' THEN (substr(n, 4, 1)::INT % 4 + 1) || substr(n, 1, 3) || 'S' WHEN n LIKE '%8' THEN (substr(n, 4, 1)::INT % 4 + 1) || substr(n, 1, 3) ELSE CASE substr(n, 4, 1)::INT % 4 WHEN 0 THEN 'P' WHEN 1 THEN '0' WHEN 2 THEN '' ELSE 'L' END || ltrim(substr(n, 1, 4), '0') END AS siglum FROM n",
    "q_headers": "SELECT row_id, sep_char AS sniffed, lower(array_to_string(string_split(regexp_replace(regexp_replace(raw_line, '^\\x{feff}', ''), '\\r\\z', ''), sep_char), '|')) AS names FROM citation_rows WHERE line_no = 1",
    "q_files": "SELECT regexp_extract(file_name, '\\.([a-z]+)\\z', 1) AS extension, count(DISTINCT file_name) AS files, count(*) AS records, count(*) FILTER (WHERE line_no > 1) AS body_records FROM citation_rows GROUP BY 1",
    "q_listing": f"SELECT table_name || '.parquet' AS name, 'parquet' AS extension, true AS filled FROM information_schema.tables WHERE table_name IN ({', '.join(repr(t) for t in OWN_TABLES)})",
    "q_carry": _DOC_LINES + ", c AS (SELECT doc_id, line_no, CASE WHEN line_no % 5 = 2 THEN line || '-' ELSE line END AS line FROM l), o AS (SELECT *, coalesce(regexp_matches(lag(line) OVER w, '[-<]\\z'), false) AS opened, lead(line) OVER w IS NULL AS last FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), i AS (SELECT *, sum((NOT opened)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM o) SELECT doc_id, min(line_no) AS line_no, md5(string_agg(CASE WHEN last THEN line ELSE regexp_replace(line, '[-<]\\z', '') END, '' ORDER BY line_no)) AS text FROM i GROUP BY doc_id, island",
    "q_continuations": _DOC_LINES + ", i AS (SELECT *, coalesce(sum(regexp_matches(line, '[.?!]\\s*\\z')::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM l) SELECT doc_id, max(line_no) AS line_no, md5(string_agg(line, '' ORDER BY line_no)) AS text FROM i GROUP BY doc_id, island",
    "q_heads": "WITH h AS (SELECT doc_id, regexp_extract_all(text, '\\{[^}]*\\}? ?') AS l FROM documents) SELECT doc_id, unnest(range(1, len(l) + 1)) AS head_no, trim(translate(unnest(l), '{}', ''), ' ') AS head FROM h",
    "q_nodes": _NODES + " SELECT doc_id, node, otype, seq FROM n",
    "q_oslots": _NODES + " SELECT doc_id, node, from_slot, to_slot FROM n",
    "q_slot_ranges": "WITH k AS (SELECT doc_id, slot, arg_max(lemma, loaded_at) AS lemma FROM slots GROUP BY 1, 2), r AS (SELECT doc_id, slot, slot - row_number() OVER (PARTITION BY doc_id ORDER BY slot) AS run FROM k WHERE lemma <> ''), g AS (SELECT doc_id, run, min(slot) AS a, max(slot) AS b FROM r GROUP BY 1, 2) SELECT doc_id, count(*) AS runs, min(a) AS first, max(b) AS last FROM g GROUP BY doc_id",
    "q_locate": "WITH f AS (SELECT DISTINCT doc_id, node FROM node_features WHERE feature = '_sentence'), r AS (SELECT doc_id, node, unnest(ranges) AS r FROM oslots SEMI JOIN f USING (doc_id, node)), s AS (SELECT DISTINCT doc_id, slot FROM slots) SELECT DISTINCT s.doc_id, slot, node FROM s JOIN r ON s.doc_id = r.doc_id AND slot BETWEEN r.r.from_slot AND r.r.to_slot",
    "q_value_types": "SELECT feature, CASE WHEN bool_and(regexp_full_match(feature_value, '[0-9]+')) THEN 'int' ELSE 'str' END AS value_type, count(DISTINCT feature_value) AS n_values FROM node_features GROUP BY feature",
    "q_feature_lines": "WITH f AS (SELECT DISTINCT * FROM node_features), v AS (SELECT *, replace(replace(replace(coalesce(feature_value, ''), '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n') AS v, lag(node) OVER (PARTITION BY doc_id, feature ORDER BY node) AS before FROM f) SELECT doc_id, feature, node, CASE WHEN before = node - 1 THEN v ELSE node || chr(9) || v END AS line FROM v",
    "q_feature_header": "SELECT feature, '@node' || chr(10) || '@language=mixed' || chr(10) || '@version=1.0' || chr(10) || '@valueType=' || CASE WHEN bool_and(regexp_full_match(feature_value, '[0-9]+')) THEN 'int' ELSE 'str' END AS header FROM node_features GROUP BY feature",
    "q_metadata_path": _WORKS + ", p AS (SELECT work_id, concat_ws('/', " + ", ".join("regexp_replace(trim(coalesce(" + ", ".join(f"CASE WHEN trim({c}, ' ') <> '' THEN {c} END" for c in cols) + f", 'unknown {'-'.join(cols)}'), ' '), '[/\\\\]', '-', 'g')" for cols in (["author", "geography"], ["title"], ["place", "publication_year"])) + ", '1.0') AS path FROM w) SELECT work_id, path, regexp_replace(work_id, '^([a-z]+)([0-9]+)-', '\\1/\\2/') AS by_code, path[:-5] || '/' || row_number() OVER (PARTITION BY path ORDER BY work_id) || '/1.0' AS folder FROM p",
    "q_set_overlap": "WITH s AS (SELECT DISTINCT plain, lemma FROM slots WHERE plain <> '' AND lemma <> '') SELECT plain, s.lemma, array_to_string(l.lemma, ',') AS known, list_has_any(string_split(s.lemma, ','), l.lemma) AS meets FROM s JOIN lemmata l ON plain = form",
    "q_xml_events": _XML + " SELECT work_id, pos, code, tag, text, CASE WHEN regexp_matches(piece, 'n ?= ?\"') THEN trim(regexp_extract(piece, ' n ?= ?\"([^\"]*)\"', 1), ' ') END AS n FROM ev",
    "q_body_tags": _XML + ", b AS (SELECT *, min(CASE WHEN code = 'bodyStart' THEN pos END) OVER (PARTITION BY work_id) AS a, min(CASE WHEN code = 'bodyStop' THEN pos END) OVER (PARTITION BY work_id) AS z FROM ev) SELECT work_id, pos, tag, row_number() OVER (PARTITION BY work_id, tag ORDER BY pos) AS tag_no FROM b WHERE pos > a AND pos < z AND code IN ('openTag', 'openAttrTag', 'openCloseTag', 'closedAttrTag')",
    "q_depth": _XML + ", d AS (SELECT code, sum((code IN ('openTag', 'openAttrTag', 'bodyStart'))::INT) OVER (PARTITION BY work_id ORDER BY pos) - coalesce(sum((code IN ('closeTag', 'bodyStop'))::INT) OVER (PARTITION BY work_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM ev) SELECT code, depth::BIGINT AS depth, count(*) AS n FROM d GROUP BY 1, 2",
    "q_attr_profile": _XML + ", a AS (SELECT tag, 'n' AS attr, trim(regexp_extract(piece, ' n ?= ?\"([^\"]*)\"', 1), ' ') AS value FROM ev WHERE code IN ('openAttrTag', 'closedAttrTag') UNION ALL SELECT tag, 'type', regexp_extract(piece, ' type=\"([^\"]*)\"', 1) FROM ev WHERE code = 'openAttrTag') SELECT tag, attr, count(*) AS n, count(DISTINCT value) AS n_values FROM a GROUP BY 1, 2",
    "q_value_keys": _XML + " SELECT DISTINCT tag, 'n' AS value_key FROM ev WHERE code IN ('openAttrTag', 'closedAttrTag')",
    "q_header_fields": _XML + ", b AS (SELECT work_id, pos, text, code, lag(tag) OVER (PARTITION BY work_id ORDER BY pos) AS field, min(CASE WHEN code = 'bodyStart' THEN pos END) OVER (PARTITION BY work_id) AS a FROM ev) SELECT work_id, field, text AS value FROM b WHERE code = 'text' AND pos < a",
    "q_element_spans": _NESTED + ", ch AS (SELECT *, (lag(chapter) OVER w IS DISTINCT FROM chapter)::INT AS a, (lag(chapter) OVER w IS DISTINCT FROM chapter OR lag(section) OVER w IS DISTINCT FROM section)::INT AS b FROM lines WINDOW w AS (PARTITION BY file_name ORDER BY line_at)), "
    "t AS (SELECT file_name, 'p' AS tag, count(*) AS opened, 2 * count(*) AS inside FROM lines GROUP BY 1 UNION ALL SELECT file_name, 'note', count(*), 2 * count(*) FROM lines WHERE row_id % 7 = 0 GROUP BY 1 UNION ALL SELECT file_name, 'div', sum(a) + sum(b), NULL FROM ch GROUP BY 1) SELECT file_name, tag, opened::BIGINT AS opened, opened::BIGINT AS closed, inside::BIGINT AS inside FROM t",
    "q_xml_sections": _NESTED + f" SELECT file_name, chapter, section, {_XML_TEXT} AS text FROM lines UNION ALL SELECT file_name, chapter, section, 'a remark' FROM lines WHERE row_id % 7 = 0",
    "q_transcription": "WITH s AS (SELECT DISTINCT orig, post FROM slots) SELECT orig, post, trim(regexp_replace(regexp_replace(coalesce(orig, '') || coalesce(post, ''), '[<>&]', '', 'g') || ' y {gap} ', ' {2,}', ' ', 'g'), ' ') AS cleaned FROM s",
    "q_bibliography": _WORKS + " SELECT work_id, 'author' AS field, " + _ONE("author") + " AS value FROM w UNION ALL SELECT work_id, 'title', " + _ONE("title") + " FROM w UNION ALL SELECT work_id, 'place', " + _ONE("place") + " || ' ' || " + _ONE("geography") + " FROM w UNION ALL SELECT work_id, 'tlg_wordcount', " + _ONE("tlg_wordcount") + " FROM w",
    "q_title_list": f"WITH w AS (SELECT work_id, max(title) AS a, max(place) AS b FROM works GROUP BY 1), o AS (SELECT work_id, coalesce(regexp_replace(trim(a, ' '), '\\s+', ' ', 'g'), '-') AS a, coalesce(regexp_replace(trim(b, ' '), '\\s+', ' ', 'g'), '-') AS b FROM w) SELECT work_id, regexp_extract(trim(a, ' '), '^([^,]*)', 1) AS title, trim(a, ' ') || ' ' || trim(b, ' ') AS title_full FROM o",
    "q_tidy_fields": "WITH w AS (SELECT work_id, max(author) AS a, max(place) AS p, max(citation_scheme) AS s FROM works GROUP BY 1), cap AS (SELECT *, array_to_string(list_transform(string_split(lower(a), ' '), lambda x: upper(left(x, 1)) || substr(x, 2)), ' ') AS ca, array_to_string(list_transform(string_split(lower(p), ' '), lambda x: upper(left(x, 1)) || substr(x, 2)), ' ') AS cp FROM w) SELECT work_id, 'author' AS field, ca AS value FROM cap UNION ALL SELECT work_id, 'place', cp FROM cap UNION ALL SELECT work_id, 'citation_scheme', lower(upper(s)) FROM cap UNION ALL SELECT work_id, 'pages', upper(p) FROM cap",
    "q_authors": "WITH w AS (SELECT DISTINCT author FROM works WHERE author IS NOT NULL) SELECT author, array_to_string(list_transform(string_split(upper(author) || ' OF THE WEST', ' '), lambda x: CASE WHEN lower(x) IN ('of', 'the') THEN lower(x) ELSE upper(left(x, 1)) || lower(substr(x, 2)) END), ' ') AS cased FROM w",
    "q_records": _WORKS + " SELECT work_id, " + _ONE("author") + " AS author, 4 AS n_fields FROM w",
    "q_titles": "WITH t AS (SELECT work_id, arg_max(title, loaded_at) AS title FROM works GROUP BY 1) SELECT doc_id, coalesce(title, 'not provided') AS title FROM documents LEFT JOIN t USING (work_id)",
    "q_word_counts": "WITH w AS (SELECT DISTINCT work_id, lang, replace(tlg_wordcount, ',', '') AS c FROM works), n AS (SELECT lang, CASE WHEN regexp_full_match(c, '[0-9]{1,18}') THEN c::BIGINT END AS n FROM w) SELECT lang, count(n) AS works, sum(n)::BIGINT AS words, max(n) AS largest FROM n GROUP BY lang",
    "q_missing_meta": _WORKS + ", m AS (" + " UNION ALL ".join(f"SELECT work_id, '{c}' AS field, {c} AS v FROM w" for c in ("author", "title", "citation_scheme", "place", "geography", "publication_year")) + ") SELECT work_id, field FROM m WHERE v IS NULL OR trim(v, ' ') = ''",
    "q_without_work": "SELECT doc_id FROM documents WHERE work_id IS NULL OR work_id NOT IN (SELECT work_id FROM works WHERE work_id IS NOT NULL)",
    "q_alphabet": "WITH l AS (SELECT DISTINCT orig AS line FROM wordforms WHERE orig NOT LIKE '@%' AND regexp_matches(orig, '[^\\x{20}-\\x{7E}\\x{C0}-\\x{17F}]')) SELECT line, array_to_string(list_sort(list_distinct(regexp_extract_all(line, '[^\\x{20}-\\x{7E}\\x{C0}-\\x{17F}]'))), '') AS faults FROM l",
    "q_sources": "SELECT source, count(*) AS docs, sum(n_chars)::BIGINT AS chars, coalesce(any_value(licence), 'unknown') AS licence FROM documents LEFT JOIN sources USING (source) GROUP BY source",
    "q_manuscripts": _READINGS + ", h AS (SELECT DISTINCT manuscript, hand FROM r WHERE hand NOT IN ('firsthand') UNION SELECT manuscript, 'firsthand' FROM r GROUP BY 1 HAVING bool_and(hand = 'firsthand')), u AS (SELECT DISTINCT manuscript, unit, unit // 4 % 4 AS b, unit // 2 AS c FROM r), "
    "v AS (SELECT *, lag(b) OVER w AS lb, lag(c) OVER w AS lc FROM u WINDOW w AS (PARTITION BY manuscript ORDER BY unit)), x AS (SELECT u.manuscript, h.hand AS witness, u.unit, CASE WHEN lb IS DISTINCT FROM b THEN '<div type=\"book\" n=\"0' || b || '\">' ELSE '' END || CASE WHEN lb IS DISTINCT FROM b OR lc IS DISTINCT FROM c THEN '<div type=\"chapter\" n=\"' || c || '\">' ELSE '' END || '<div type=\"verse\" n=\"' || u.unit || '\">q ' || translate(coalesce(a.text, f.text, ''), '<>&\"' || chr(10), '()+'' ') AS t "
    "FROM h JOIN v u USING (manuscript) LEFT JOIN last a ON a.manuscript = u.manuscript AND a.unit = u.unit AND a.hand = h.hand LEFT JOIN last f ON f.manuscript = u.manuscript AND f.unit = u.unit AND f.hand = 'firsthand') SELECT manuscript, witness, trim(regexp_replace(string_agg(t, '' ORDER BY unit), ' {2,}', ' ', 'g'), ' ') AS text FROM x GROUP BY 1, 2",
    "q_witness_last": _READINGS + " SELECT * FROM last",
    "q_witness_select": _READINGS + ", h AS (SELECT DISTINCT manuscript, hand FROM r WHERE hand NOT IN ('firsthand', 'unknown')), u AS (SELECT DISTINCT manuscript, unit FROM r) SELECT u.manuscript, h.hand, u.unit, coalesce(a.text, b.text) AS text FROM h JOIN u USING (manuscript) LEFT JOIN last a ON a.manuscript = u.manuscript AND a.unit = u.unit AND a.hand = h.hand LEFT JOIN last b ON b.manuscript = u.manuscript AND b.unit = u.unit AND b.hand = 'firsthand'",
}
