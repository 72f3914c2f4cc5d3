"""Sections, graph, XML, bibliography, witnesses: worked cases."""

import random

from pyspark.sql import functions as F

from quillspark.operators import bibliography as B
from quillspark.operators import citations as C
from quillspark.operators import graph as G
from quillspark.operators import greek as K
from quillspark.operators import sections as S
from quillspark.operators import segments as G2
from quillspark.operators import slots as O
from quillspark.operators import witness as V
from quillspark.operators import xml_events as E

XML = '<TEI><teiHeader><titleStmt><title>T</title><author>ANN OF ROUEN</author></titleStmt></teiHeader>\n<body><div type="chapter" n = "1"><head>H</head><p>Un deux. Trois</p><pb n="2"/></div></body></TEI>'


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_sections_and_units(spark):
    df = spark.createDataFrame([(1, 1, "1", "1", "Alpha beta."), (1, 2, "1", "2", "gamma, delta;"), (1, 3, "1", "2", ""), (1, 4, "2", "2", "eps!")], "doc int, n int, chapter string, section string, text string")
    got = rows(S.number_sections(df, "doc", "n", ["chapter", "section"], "text").select("n", "chapter_node", "section_node"), "n")
    assert got == [(1, 1, 1), (2, 1, 2), (3, None, None), (4, 2, 3)]
    text = spark.createDataFrame([(1, "Alpha beta. gamma, delta; eps!")], "doc int, text string")
    units = O.number_units(O.explode_slots(text, "doc", "text"), "doc")
    assert rows(units.select("slot", "orig", "sentence", "phrase"), "slot") == [(1, "Alpha", 1, 1), (2, "beta", 1, 1), (3, "gamma", 2, 2), (4, "delta", 2, 3), (5, "eps", 2, 4)]
    nodes = G.number_nodes(G.units_as_nodes(units, "doc"), "doc")
    assert rows(nodes.select("node", "otype", "seq", "from_slot", "to_slot"), "node")[:3] == [(6, "_book", 1, 1, 5), (7, "_phrase", 1, 1, 2), (8, "_phrase", 2, 3, 3)]


def test_sections_in_blocks(spark):
    """Documents cut in blocks, one with two thirds of all rows: the same numbers as over whole documents."""
    rnd = random.Random(4)
    data = [(0 if k % 3 else k % 7, k, rnd.choice(["1", "2", None]), rnd.choice(["a", "b"]), rnd.choice(["x", "", None, "y"])) for k in range(600)]
    df = spark.createDataFrame(data, "doc int, n int, chapter string, section string, text string")
    whole = S.number_sections(df, "doc", "n", ["chapter", "section"], "text")
    cut = S.number_sections(df, "doc", "n", ["chapter", "section"], "text", F.floor(F.col("n") / 37))
    assert cut.columns == whole.columns and rows(cut, "n") == rows(whole, "n")


def test_carry_heads_backfill_verses(spark):
    lines = spark.createDataFrame([(1, 1, "ab-"), (1, 2, "cd-"), (1, 3, "ef"), (1, 4, "gh-")], "doc int, n int, t string")
    assert rows(S.carry_lines(lines, "doc", "n", "t").select("n", "text"), "n") == [(1, "abcdef"), (4, "gh-")]
    text = spark.createDataFrame([(1, "{test title} body {b}"), (2, "none"), (3, None)], "doc int, text string")
    cut = G2.cut_heads(text.withColumn("at", F.lit(0)), "doc", "at", "text")
    assert rows(cut.where("head IS NOT NULL").select("doc", "head_no", "head"), "doc", "head_no") == [(1, 1, "{test title} "), (1, 2, "{b}")]
    assert [r[0] for r in rows(cut.where("doc = 1 AND body IS NOT NULL").select("body"))] == ["body "]
    levels = spark.createDataFrame([(1, 1, 0), (1, 2, 5), (1, 3, 0)], "doc int, n int, v int")
    assert [r[3] for r in rows(S.backfill_levels(levels, "doc", "n", "v"), "n")] == [4, 5, 0]
    verses = spark.createDataFrame([(1, 1, "04", "4", "6"), (1, 2, "04", "4", "7"), (1, 3, "04", "5", "7")], "doc int, n int, book string, chapter string, verse string")
    got = rows(S.verse_changes(verses, "doc", "n", ["book", "chapter", "verse"]).select("n", "level", "value"), "n", "level")
    assert got == [(1, "book", "04"), (1, "chapter", "4"), (1, "verse", "6"), (2, "verse", "7"), (3, "chapter", "5"), (3, "verse", "7")]


def test_graph(spark):
    slots = spark.createDataFrame([(1, 7, s) for s in (1, 2, 4, 5, 9)], "doc int, node long, slot long")
    assert [tuple(x) for x in G.slot_ranges(slots, "doc", "node").collect()[0]["ranges"]] == [(1, 2), (4, 5), (9, 9)]
    ranges = spark.createDataFrame([(1, 70, 1, 2), (1, 71, 4, 6)], "doc int, node long, from_slot long, to_slot long")
    assert rows(G.locate_slots(slots, ranges, "doc").select("slot", "node"), "slot") == [(1, 70), (2, 70), (4, 71), (5, 71)]
    f = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "x"), ("b", None), ("c", None)], "feature string, value string")
    assert rows(G.value_types(f, "feature", "value"), "feature") == [("a", "int", 2), ("b", "str", 1), ("c", "str", 0)]
    sets = spark.sql("SELECT array(array('a','b'),array('c','d'),array('e','f')) AS a, array(array('a','l','p'),array('c','k'),array('e','n')) AS b")
    assert sets.select(G.overlap_everywhere(F.col("a"), F.col("b"))).collect()[0][0]


def test_xml(spark):
    events = E.xml_events(spark.createDataFrame([(1, XML), (2, "<a>no body</a>"), (3, None)], "doc int, xml string"), "doc", "xml")
    body = E.body_events(events, "doc")
    assert [r[0] for r in rows(body.select("code"), "pos")] == ["openAttrTag", "openTag", "text", "closeTag", "openTag", "text", "closeTag", "closedAttrTag", "closeTag"]
    assert rows(E.header_fields(events.where("doc = 1"), "doc").select("field", "value"), "field") == [("author", "ANN OF ROUEN"), ("title", "T")]
    assert rows(E.value_keys(E.attribute_profile(body)), "tag") == [("div", "n"), ("pb", "n")]
    assert max(r[0] for r in rows(E.with_depth(body, "doc").select("depth"))) == 2
    t = spark.createDataFrame([('<w>a</w><lb break="no"/><w>b</w><note>x</note><lb/>c<gap/>&amp;',)], "t string")
    assert t.select(E.clean_transcription(F.col("t"))).collect()[0][0] == "ab c {gap}"


def test_roles(spark):
    xml = '<body><div subtype="book" n="1" id="a"/><div subtype="part" n="1" id="b"/><seg type="x" kind="k" n="3"/><seg type="y" kind="k" n="4"/><pb n="2"/><w a="1" b="2"/><w a="1" b="3"/></body>'
    e = E.xml_events(spark.createDataFrame([(1, xml)], "doc int, xml string"), "doc", "xml")
    roles = E.attribute_roles(e, "doc", ignored=("id",))
    got = {r["tag"]: (r["keys"].split("\x1f"), r["value_key"], r["name_keys"], r["is_section"]) for r in roles.collect()}
    assert got == {"div": (["subtype", "n"], "n", ["subtype"], True), "seg": (["type", "kind", "n"], "n", ["type"], False), "pb": (["n"], "n", [], False), "w": (["a", "b"], "b", ["a"], False)}
    named = E.named_events(e, "doc", roles, ("id",))
    assert rows(E.section_names(named, "doc")) == [(1, ["book", "part"])]
    odd = E.attribute_roles(e, "doc", ignored=("id",), non_section_values=("part",))
    assert not odd.where("is_section").count()


def test_citations_titles_and_manuscripts(spark):
    text = [("f", 1, "1.1\tabc"), ("f", 2, ""), ("f", 3, "2."), ("f", 4, "x"), ("f", 5, "2.2*\tde\tf "), ("f", 6, "3.4"), ("f", 7, "1.B.5_2\tgh"), ("f", 8, "rest"), ("g", 1, None)]
    df = spark.createDataFrame(text, "f string, n int, l string").withColumn("k", F.lit(2))
    assert rows(C.parse_citations(df, "f", "n", "l", "k").select("n", "refs", "text"), "n") == [(1, ["1", "1"], "abc"), (5, ["2", "2"], "de f"), (7, ["B", "5"], "gh"), (8, None, "rest")]
    lines = ["0001", "0001 001", "Long, the", "title", "0001 002", "Last"]
    titles = B.parse_titles(spark.createDataFrame([("f", k, x) for k, x in enumerate(lines)], "f string, n int, l string"), "f", "n", "l")
    assert rows(titles, "work_id") == [("0001-001", "Long", "Long, the title"), ("0001-002", "Last", "Last")]
    assert rows(B.with_titles(spark.createDataFrame([(1, "0001-001"), (2, None)], "id int, w string"), "w", titles).select("title"), "id") == [("Long",), ("not provided",)]
    xml = '<TEI><listWit><witness id="C1V"/></listWit><body><ab n="B04K4V6"><w>a</w> <app><rdg hand="firsthand"><w>b1</w></rdg><rdg hand="C1">b2</rdg><rdg hand="C1V">b3</rdg></app></ab><ab n="B04K5V6">d<lb break="no"/>e<app><rdg hand="">z</rdg><rdg>f</rdg></app></ab></body></TEI>'
    got = {(r["id"], r["witness"]): r["text"] for r in V.witness_texts(spark.createDataFrame([("m", xml), ("n", "<body>q <unclosed"), ("o", None)], "id string, xml string"), "id", "xml").collect()}
    div = '<div type="book" n="04"><div type="chapter" n="4"><div type="verse" n="6">a {}<div type="chapter" n="5"><div type="verse" n="6">de{}'
    assert got == {("m", "C1"): div.format("b3", "f"), ("m", "unknown"): div.format("b1", "z"), ("n", "firsthand"): "q <unclosed"}


def test_greek_words(spark):
    def df(r, d):
        return spark.createDataFrame(r, d)

    lexicons = (df([("ἀλλ᾽", ["ἀλλά"])], "key string, value array<string>"), df([("κἀγώ", "καὶ ἐγώ")], "key string, value string"), df([("εστιν",)], "form string"), df([("θς", "θεός")], "key string, value string"))
    words = ["ἀλλ", "αλλ", "κἀγώ", "ἐστίν", "οὐκ", "ἐξ", "θϲ", "λογο¯", "logos", None]
    tokens = df([(k, "(", w, "’ ") for k, w in enumerate(words)], "n int, pre string, word string, post string")
    got = rows(K.replace_tokens(tokens, ["n"], "word", *lexicons).select("n", "part", "pre", "word", "post"), "n", "part")
    assert [r[3] for r in got] == ["ἀλλά", "ἀλλά", "καὶ", "ἐγώ", "ἐστί", "οὐ", "ἐκ", "θεός", "λογον", "λογος", None]
    assert got[2:4] == [(2, 0, "(", "καὶ", " "), (2, 1, "", "ἐγώ", "᾽ ")]


def test_bibliography_and_witnesses(spark):
    lines = ["key 1 001", "nam ANN", "    OF ROUEN", "tit First", "tit Second", "key 1 002", "zzz odd"]
    df = spark.createDataFrame([("f", k, x) for k, x in enumerate(lines)], "file string, n int, line string")
    assert rows(B.parse_bibliography(df, "file", "n", "line"), "work_id", "field") == [("1 001", "author", "ANN OF ROUEN"), ("1 001", "title", "Second"), ("1 002", "zzz", "odd")]
    r = spark.createDataFrame([("m", 1, None, 1, "a"), ("m", 1, None, 2, "b"), ("m", 1, "c1", 3, "c"), ("m", 2, None, 1, "d")], "m string, u int, hand string, pos int, text string")
    w = spark.createDataFrame([("m", "c1"), ("m", "firsthand")], "m string, hand string")
    assert rows(V.select_readings(r, w, "m", "u", "hand", "pos", "text"), "hand", "u") == [("m", "c1", 1, "c"), ("m", "c1", 2, "d"), ("m", "firsthand", 1, "b"), ("m", "firsthand", 2, "d")]
