"""Whole conversions, profiles, normalisation."""

from dataclasses import replace

from pyspark.sql import functions as F

from quillspark.config import GENERIC, GREEK, PROFILES, rendered, slot_forms
from quillspark.functions.unicode import normalize
from quillspark.operators import xml_events as E
from quillspark.operators.greek import Lexicons
from quillspark.plans.convert import convert, convert_delimited, convert_xml, rows_to_graph, xml_to_graph
from quillspark.sources.files import by_dialect

PROFILE = replace(GENERIC, bracket_heads=True, contractions=(("du", "de le"),))
XML = """<TEI><teiHeader><fileDesc><titleStmt><title>T.</title><author>ANN OF ROUEN</author></titleStmt><publicationStmt><p>one</p><p>two</p></publicationStmt></fileDesc></teiHeader>
<body><!-- x --><p>zero</p><div type='chapter' n="3"><head>H</head><p>Un du. Trois</p><pb n="2"/><div type="verse" n="9" >x y</div><div type="verse" n="10"></div><note>a <hi>remark</hi></note></div><div type="chapter" n="4">z <hi corresp="c1">w</hi></div></body></TEI>"""


def units(graph, doc, *types):
    cols = ["otype", "value", "from_slot", "to_slot"]
    return [tuple(r) for r in graph.units.where(F.col(graph.id_col) == doc).orderBy("node").select(*cols).collect() if not types or r["otype"] in types]


def test_rows(spark):
    rows = [("a", 1, "1", "1", "{test title}"), ("b", 1, "5", "10a", "12. 13! Alpha beta."), ("b", 2, "5", "2", "gam-"), ("b", 3, "7", "2", "ma, {Head"), ("b", 4, "7", "3", "words} du delta; 14! —"), ("b", 5, "7", "3", "— eps! 5."), ("c", 1, "1", "1", None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc string, n int, words string, section string, text string, before string")
    g = rows_to_graph(df, "doc", "n", ["words", "section"], "text", PROFILE, ignore_empty=False, lemmata=spark.createDataFrame([("beta", ["beta"])], "form string, lemma array<string>"))
    got = [tuple(r) for r in g.slots.where("doc = 'b'").orderBy("slot").select("slot", "pre", "post", "orig", "plain").collect()]
    assert got == [
        (1, "12. 13! ", " ", "Alpha", "alpha"), (2, "", ". ", "beta", "beta"), (3, "", ", ", "gamma", "gamma"), (4, "", " ", "du", "de"), (5, "", " ", "", "le"), (6, "", "; 14! — — ", "delta", "delta"), (7, "", "! 5. ", "eps", "eps"),
    ]
    assert units(g, "b", "words", "section", "head", "_sentence") == [
        ("_sentence", "1", 1, 2), ("_sentence", "2", 3, 6), ("_sentence", "3", 7, 7), ("head", "{Head words} ", 4, 7), ("section", "10a", 1, 2), ("section", "2", 3, 3), ("section", "3", 4, 7), ("words", "5", 1, 2), ("words", "7", 3, 7),
    ]
    assert [r["otype"] for r in g.nodes.where("doc = 'a'").orderBy("node").collect()] == ["_book", "_phrase", "_sentence", "head", "section", "words"]
    assert units(g, "a", "head", "section") == [("head", "{test title} ", 1, 1), ("section", "0", 1, 1)] and units(g, "c", "head") == []
    assert {r["lemma"] for r in g.slots.where("doc = 'b' AND slot IN (1, 2)").collect()} == {"*alpha", "beta"}
    meta = {(r["feature"], r["key"]): r["value"] for r in g.feature_meta.where("doc = 'b'").collect()}
    assert meta["section", "valueType"] == "str" and meta["words", "valueType"] == "int" and meta["lemma", "coverage_ratio"] == "14.29%"
    assert {r["key"]: r["value"] for r in g.otext.where("doc = 'b'").collect()}["structureTypes"] == "_book,words,section,_sentence,_phrase"
    assert {r["doc"] for r in rows_to_graph(df, "doc", "n", ["words"], "text", PROFILE).slots.collect()} == {"b"}
    assert rows_to_graph(df.limit(0), "doc", "n", ["words"], "text").units.count() == 0


def test_long_stretches_without_a_word(spark):
    """Two documents of 20,000 lines without a cased letter but for the third one's: all of them go behind its word, or nowhere."""
    df = spark.range(40_000).selectExpr("id % 2 AS doc", "id AS n", "CASE WHEN id = 4 THEN 'word' ELSE '字字。' END AS text")
    slots = rows_to_graph(df, "doc", "n", [], "text").slots.collect()
    assert [(r["doc"], r["slot"], r["orig"], len(r["pre"]), len(r["post"])) for r in slots] == [(0, 1, "word", 8, 1 + 4 * 19_997)]
    every = rows_to_graph(df, "doc", "n", [], "text", replace(GENERIC, cased=False)).slots
    assert every.count() == 40_000


def test_xml(spark):
    docs = spark.createDataFrame([("x", XML), ("y", "<TEI>none</TEI>"), ("z", None)], "doc string, xml string")
    g = xml_to_graph(docs, "doc", "xml", replace(PROFILE, non_text_tags=("note", "head")))
    assert [r["plain"] for r in g.slots.orderBy("slot").collect()] == ["zero", "un", "de", "le", "trois", "x", "y", "", "z", "w"]
    assert units(g, "x") == [
        ("_book", "T", 1, 10), ("_phrase", "1", 1, 4), ("_phrase", "2", 5, 10), ("_sentence", "1", 1, 4), ("_sentence", "2", 5, 10), ("chapter", "2", 1, 1), ("chapter", "3", 2, 8), ("chapter", "4", 9, 10), ("corresp", "c1", 10, 10),
        ("head", "H", 2, 10), ("hi", "c1", 10, 10), ("note", "a remark", 9, 10), ("p", "1", 1, 1), ("p", "2", 2, 5), ("pb", "2", 6, 10), ("verse", "0", 1, 1), ("verse", "8", 2, 5), ("verse", "9", 6, 7), ("verse", "10", 8, 8), ("verse", "0", 9, 10),
    ]
    assert {r["key"]: r["value"] for r in g.metadata.collect()} == {"title": "T", "author": "Ann of Rouen", "publicationStmt": "one, two."}


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.tsv").write_text("Chapter\tSection\ttext\n1\t1\tAlpha beta.\n1\t2\tgamma, delta;\n2\t2\teps!\n")
    (tmp_path / "in" / "y.tsv").write_text("Chapter;Section;text\n9;1;zeta.\n")
    (tmp_path / "in" / "a.xml").write_text(XML)
    (tmp_path / "in" / "b.xml").write_text("<TEI>none</TEI>")
    meta = spark.createDataFrame([("x.tsv", "title", "First"), ("y.tsv", "title", "Second")], "file string, key string, value string")
    g = convert_delimited(spark, str(tmp_path / "in" / "*.tsv"), header=True, metadata=meta)
    got = {(r["doc_id"][-5:], r["otype"], r["value"]) for r in g.units.where("otype IN ('_book', 'chapter')").collect()}
    assert got == {("x.tsv", "_book", "First"), ("x.tsv", "chapter", "1"), ("x.tsv", "chapter", "2"), ("y.tsv", "_book", "Second"), ("y.tsv", "chapter", "9")}
    assert {r["doc_id"][-5:] for r in convert_xml(spark, str(tmp_path / "in" / "*.xml")).slots.collect()} == {"a.xml"}
    assert convert(spark, str(tmp_path / "in"), str(tmp_path / "out")) == {"tsv": (2, 2), "xml": (2, 1)}
    assert spark.read.parquet(str(tmp_path / "out" / "tsv" / "otext")).count() == 14 and spark.read.parquet(str(tmp_path / "out" / "xml" / "node_features")).count() > 10
    assert {r["sep"] for r in by_dialect(spark, str(tmp_path / "in" / "*.tsv")).collect()} == {"\t", ";"}


def test_greek_conversion(spark):
    df = spark.createDataFrame([("d", 1, "ἀλλ’ κἀγώ, θϲ ἐστίν.")], "doc string, n int, text string")
    make = lambda rows, d: spark.createDataFrame(rows, d)
    lexicons = Lexicons(make([("ἀλλ᾽", ["ἀλλά", "ἄλλο"])], "key string, value array<string>"), make([], "key string, value string"), make([("εστιν",)], "form string"), make([("θς", "θεός")], "key string, value string"))
    greek = replace(GREEK, contractions=(("κἀγώ", "καὶ ἐγώ"),))
    g = rows_to_graph(df, "doc", "n", [], "text", greek, lexicons=lexicons)
    got = [(r["orig"], r["norm"], r["plain"]) for r in g.slots.orderBy("slot").collect()]
    assert got == [("ἀλλ", "ἀλλά,ἄλλο", "αλλα,αλλο"), ("κἀγώ", "καὶ", "και"), ("", "ἐγώ", "εγω"), ("θϲ", "θεός", "θεος"), ("ἐστίν", "ἐστί", "εστι")]


def test_own_tokenizer(spark):
    blanks = lambda text, cased: F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: F.struct(F.lit("").alias("pre"), w.alias("core"), F.lit(" ").alias("post")))
    df = spark.createDataFrame([("d", 1, "al-Kitab 12a x")], "doc string, n int, text string")
    got = rows_to_graph(df, "doc", "n", [], "text", replace(GENERIC, tokenizer=blanks)).slots.orderBy("slot").collect()
    assert [(r["orig"], r["post"]) for r in got] == [("alKitab", " "), ("a", " "), ("x", " ")]


def test_sections_and_spans(spark):
    xml = '<body><div type="a" n="1">t<div type="b" n="2">u</div></div><div type="b" n="3">v</div><div type="a" n="4">w</div></body>'
    e = E.xml_events(spark.createDataFrame([(1, xml)], "doc int, xml string"), "doc", "xml")
    got = [(r["text"], r["a"], r["b"]) for r in E.xml_sections(e, "doc", "div", "type", "n", ["a", "b"]).orderBy("pos").collect()]
    assert got == [("t", "1", "0"), ("u", "1", "2"), ("v", "1", "3"), ("w", "4", "0")]
    spans = [(r["pos"], r["close_pos"]) for r in E.element_spans(e, "doc").orderBy("pos").collect()]
    assert spans == [(1, 6), (3, 5), (7, 9), (10, 12)]


def test_profiles_and_forms(spark):
    assert set(PROFILES) == {"generic", "latin", "greek"}
    df = spark.createDataFrame([("(", "Λόγος", ") ")], "pre string, word string, post string").select("pre", "post", *slot_forms(GREEK, F.col("word")))
    assert df.select("plain", "plain_reduced", "beta_plain", rendered(GREEK, "orig"), rendered(GREEK, "plain")).collect()[0] == ("λογος", "λογο", "logos", "(Λόγος) ", "λογος ")
    got = spark.createDataFrame([("é",), (None,)], "t string").select(normalize(F.col("t"))).collect()
    assert [r[0] for r in got] == ["e\u0301", None]
