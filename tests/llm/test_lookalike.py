"""Consistent forms against a slow reading, and all pairs against brute force."""

import itertools
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import lookalike as L

SAME = [("Ｒｅａｄ ｉｔ", "Read it"), ("été", "été"), ("so​me﻿", "some"), ("a  b", "a b"), ("\n a\r\nb ", "a b"), ("саѕе", "case"), ("ﬁn", "fin"), ("⼈", "人"), ("が", "が"), ("q̣̇", "q̣̇"), ("Ⅳ", "IV"), ("ά", "ά"), ("한", "한"), ("λoγoς", "λογος"), ("co­op", "coop")]
DIFFERENT = [("a", "A"), ("a", "á"), ("a b", "ab"), ("a.", "a"), ("x²", "x2"), ("ς", "σ"), ("“a”", '"a"'), ("…", "‥"), ("①", "1"), ("ſ", "s"), ("a-b", "a–b"), ("n", "ñ")]


def test_pairs_of_strings():
    for a, b in SAME:
        assert L.canonical_form(a) == L.canonical_form(b), (a, b)
    for a, b in DIFFERENT:
        assert L.canonical_form(a) != L.canonical_form(b), (a, b)
    assert L.canonical_forms(["", " ​\n", "a"]) == ["", "", "a"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("eαо̣́͂̓ \n ​가ᅡᆨがﬂＡ")), max_size=12), max_size=6))
def test_forms_against_slow_reading(texts):
    def slow(s):
        out = "".join(" " if c.isspace() and c not in "\x1c\x1d\x1e\x1f" else "" if L._invisible(c) else "".join(L.SHAPES.get(x, x) for x in L._expand(c)) for c in s)
        return re.sub(" +", " ", unicodedata.normalize("NFC", out)).strip(" ")

    ok = [t for t in texts if all(ord(c) < 0x3400 or 0x4E00 <= ord(c) < 0xAC00 or ord(c) >= 0xF900 and ord(c) < 0x10000 for c in t)]
    assert L.canonical_forms(ok) == [slow(t) for t in ok]


def test_all_pairs_with_copies(spark):
    strings = [a for p in SAME for a in p] + ["case"] * 5 + ["саsе", None, "", " ", "​", "z" * 200_000, "z" * 200_000 + "​"]
    rows = list(enumerate(strings))
    df = spark.createDataFrame(rows, "id long, form string")
    got = sorted(map(tuple, L.look_alike_pairs([("f", df, "id", "form"), ("g", df.where("id < 4"), "id", "form")]).collect()))
    key = {k: L.canonical_form(s) for k, s in rows if s and L.canonical_form(s)}
    want = [("f", a, b) for a, b in itertools.combinations(key, 2) if key[a] == key[b] and strings[a] != strings[b]]
    assert got == sorted(want + [("g", 0, 1), ("g", 2, 3)])
    assert L.look_alike_pairs([("f", df.limit(0), "id", "form")]).count() == 0
    forms = {r["id"]: r["form"] for r in L.consistent_text(df, "id", "form").collect()}
    assert forms == {k: None if s is None else L.canonical_form(s) for k, s in rows}


def test_composition_is_canonical():
    """On letters, marks of several classes and conjoining Hangul the form is NFC of what the tables make of them."""
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.text(alphabet="aαeuᾳ\u0301\u0300\u0308\u0323\u0345\u0327\u0313각가\u1100\u1161\u11a8\u11b8b ", max_size=12), min_size=1, max_size=6))
    def check(texts):
        want = [" ".join(unicodedata.normalize("NFC", t).split()) for t in texts]
        assert L.canonical_forms(texts) == want

    check()


def test_big_classes_in_blocks(spark):
    """A class of many rows, a third of them copies, cut into blocks: the same pairs as brute force."""
    texts = ["look alike" if k % 3 == 0 else f"look{chr(0x2000 + k % 5)}alike" if k % 2 else "other" for k in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    form = [" ".join(t.split()) for t in texts]
    want = {(a, b) for a in range(120) for b in range(a + 1, 120) if form[a] == form[b] and texts[a] != texts[b]}
    for rows in (7, 1000):
        got = [(r["id_a"], r["id_b"]) for r in L.look_alike_pairs([("text", df, "id", "text")], rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    classes = L.look_alike_classes([("text", df, "id", "text")]).collect()
    assert {r["id"] for r in classes} == {x for p in want for x in p} and len({r["class_id"] for r in classes}) == 1 and {r["class_rows"] for r in classes} == {len(classes)}
    odd = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, "a  b", "x"), (None, "a\u00a0b", "x"), (3, None, "x")], "id long, text string, form_hi string")
    assert sorted((r["id_a"], r["id_b"]) for r in L.look_alike_pairs([("text", odd, "id", "text")]).collect()) == [(1, 2), (1, 2)]
    assert sorted((r["id"] or 0) for r in L.look_alike_classes([("text", odd, "id", "text")]).collect()) == [0, 1, 1, 2]
