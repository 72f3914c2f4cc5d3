"""Tokens, forms, references: worked cases."""

import unicodedata

from pyspark.sql import functions as F

from quillspark.functions import refs as R
from quillspark.functions import text as T
from quillspark.operators import lexicon as X
from quillspark.operators import slots as O

TOKENS = {
    "{test title} ": [("{", "test", " "), ("", "title", "} ")],
    "abc 123 def": [("", "abc", " 123 "), ("", "def", "")],
    "abc, (def": [("", "abc", ", "), ("(", "def", "")],
    "abc.def": [("", "abc", "."), ("", "def", "")],
    "ab-cd": [("", "abcd", "")],
    "a - b": [("", "a", " - "), ("", "b", "")],
    "... abc": [("... ", "", ""), ("", "abc", "")],
    "12 13": [("12 ", "", ""), ("13", "", "")],
    "ab- cd": [("", "ab", "- "), ("", "cd", "")],
    "": [],
}


def one(spark, schema, rows, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_tokens(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*TOKENS, None])], "id int, text string")
    got: dict = {}
    for r in O.explode_tokens(df, "id", "text").orderBy("id", "token_no").collect():
        got.setdefault(r["id"], []).append((r["pre"], r["word"], r["post"]))
    for k, want in enumerate(TOKENS.values()):
        assert got.get(k, []) == want
    joined = one(spark, "t string", [(t,) for t in TOKENS], F.array_join(T.tokens(F.col("t")), ""), "t")
    assert all(a == b for a, b in joined)


def test_forms(spark):
    rows = [("Écoute",), ("λόγος",), ("Straße",), ("ΑΣ",), ("Ὤρα",), (None,), ("",)]
    got = one(spark, "w string", rows, T.plain_low(F.col("w")), T.plain_caps(F.col("w")), T.clean_plain(T.plain_low(F.col("w"))))
    assert got == [("ecoute", "ECOUTE", "ecoute"), ("λογος", "ΛΟΓΟΣ", "λογο"), ("straße", "STRASSE", "straße"), ("ασ", "ΑΣ", "α"), ("ωρα", "ΩΡΑ", "ωρα"), (None, None, None), ("", "", "")]
    assert one(spark, "w string", [("a,A",), ("b,a,b",)], T.main_word(F.col("w")), T.plain_word(F.col("w"))) == [("a", "a"), ("a,b", "a,b")]
    side = one(spark, "w string", [("-:Κεκρ",), ("᾽κείν᾽",)], T.split_left(F.col("w")), T.split_right(F.col("w")))
    assert [tuple(map(tuple, r)) for r in side] == [(("-:", "Κεκρ"), ("-:Κεκρ", "")), (("᾽", "κείν᾽"), ("᾽κείν", "᾽"))]
    assert one(spark, "w string", [("ANN OF THE ROUEN",), ("ab-\n cd\nef",)], T.author_case(F.col("w")), T.join_lines(F.col("w"))) == [("Ann of the Rouen", "ANN OF THE ROUEN"), ("Ab-\n Cd\nef", "ab-cd ef")]


def test_beta_code(spark):
    rows = [("lo/gos",), ("*)aqh=nai",), ("tw=|",), ("*(/omhros",), (None,)]
    got = [r[0] and unicodedata.normalize("NFC", r[0]) for r in spark.createDataFrame(rows, "t string").select(T.beta_to_greek(F.col("t"))).collect()]
    assert got == ["λόγος", "Ἀθῆναι", "τῷ", "Ὅμηρος", None]


def test_minuscule_against_brute_force(spark):
    def brute(s):
        out = []
        for ch in unicodedata.normalize("NFC", s):
            bare = "".join(c for c in unicodedata.normalize("NFD", ch) if not unicodedata.combining(c))
            out.append(bare if unicodedata.category(ch) in ("Lu", "Ll", "Lt") else ch)
        return "".join(c for c in "".join(out).replace("Σ", "σ") if not unicodedata.category(c).startswith("M")).lower()

    words = ["Écoute, Ñandú!", "Ἐν ἀρχῇ", "ΛΌΓΟΣ", "12 – x"]
    assert one(spark, "w string", [(w,) for w in words], T.minuscule(F.array("w"))) == [(brute(w),) for w in words]


def test_refs(spark):
    cases = {"12": "12", "120_3": "120", "1*": "1", "p1": "p", "1a": "1", "asdfp**10**(?)**": "asdfp", "": ""}
    assert one(spark, "r string", [(r,) for r in cases], R.clean_ref(F.col("r"))) == [(v,) for v in cases.values()]
    aligned = one(spark, "r string", [("1.B.2.18.2",), ("7",)], R.align_right(F.split("r", r"\."), F.lit(3)))
    assert aligned == [(["2", "18", "2"],), ([None, None, "7"],)]
    assert one(spark, "r string", [("book//chapter/subchapter/section/line",), (None,)], R.scheme_parts(F.col("r"))) == [(["book", "chapter", "subchapter", "section", "line"],), (None,)]
    assert one(spark, "r string", [("20011",), ("10045",), ("30005",), ("42001",)], R.manuscript_siglum(F.col("r"))) == [("011",), ("P45",), ("5",), ("L2001",)]
    assert [tuple(r[0]) for r in one(spark, "r string", [("B04K4V6",), ("x",)], R.verse_levels(F.col("r")))] == [("04", "4", "6"), (None, None, None)]


def test_lexicon(spark):
    tokens = spark.createDataFrame([(1, "(", "Zum", ", "), (2, "", "x", " ")], "n int, pre string, word string, post string")
    lex = spark.createDataFrame([("zum", "zu dem")], "key string, value string")
    got = [tuple(r) for r in X.resolve_contraction(tokens, ["n"], "word", lex).orderBy("n", "part").collect()]
    assert got == [(1, 0, "(", "zu", " ", "Zum"), (1, 1, "", "dem", ", ", ""), (2, 0, "", "x", " ", "x")]
    words = spark.createDataFrame([("l",), ("x",)], "word string")
    elided = spark.createDataFrame([("l᾽", ["le", "la"]), ("l", ["wrong"])], "key string, value array<string>")
    assert {tuple(map(str, r)) for r in X.resolve_elision(words, "word", elided).collect()} == {("l", "['la', 'le']"), ("x", "None")}
    slots = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "*d"), (1, None), (1, "")], "doc int, lemma string")
    assert [tuple(r) for r in X.coverage(slots, ["doc"], "lemma").collect()] == [(1, 3, 4, "75.0%")]


SLOTS = {
    "{test title} ": [("{", "test", " "), ("", "title", "} ")],
    "12. 13! abc 7": [("12. 13! ", "abc", " 7")],
    "abc (def": [("", "abc", " "), ("(", "def", "")],
    "ab- cd, ef-gh": [("", "ab", "- "), ("", "cd", ", "), ("", "efgh", "")],
    "عربي abc字": [("عربي ", "abc", "字")],
    "12 !": [],
    "": [],
}


def test_slots_keep_all_punctuation(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*SLOTS, None])], "id int, text string, pre string")
    got: dict = {}
    for r in O.explode_slots(df, "id", "text").orderBy("id", "slot").collect():
        got.setdefault(r["id"], []).append((r["pre"], r["orig"], r["post"]))
    assert [got.get(k, []) for k in range(len(SLOTS))] == list(SLOTS.values()) and len(SLOTS) not in got
    every = O.explode_slots(df.where("id = 4"), "id", "text", cased=False).orderBy("slot").select("orig").collect()
    assert [r[0] for r in every] == ["عربي", "abc字"]
