"""Sentence units: worked cases by script, and that nothing is lost."""

from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.sentences import sentence_spans, split_sentences

CASES = [
    ["Said Mr. Brown on p. 12, vol. 3: yes.", "Then A.D. 445 came."],
    ["He (J. R. Smith, cf. Jones) paid 1.50 etc. for it!", "Why?"],
    ["It went on... and on … here.", "Next"],
    ["“First one.", "Second one?” asked the scribe.", "End."],
    ["«Vis?» inquit ille.", "Sic."],
    ["(All of it stands inside.)", "More."],
    ["« Que la vie. »", "Et puis ?", "« Oui ! » dit la voix."],
    ["Fragte der Abt: „Das ist z. B. gut.“", "»Nun?« rief er.", "»Ja.«", "Gut."],
    ["¿Qué es esto?", "El año 44 a. C. fue.", "No."],
    ["Τί ἐστιν;", "καὶ τὸ κεφ. 3 κτλ. τῆς.", "δὲ ἄλλο."],
    ["«Πυθὸς;» εἶπεν ὁ διδάσκαλος.", "Τὸ δέ."],
    ["色王27.8仁句。", "曰：「言衣水。」", "日（p. 93）文……年！"],
    ["هل؟", "قال د. كريم ص. 4 كذا.", "ثم"],
    ["एवम् पृ. 203 च।", "न डॉ. तोजः॥", "हि?"],
    ["Գալ (գլ. 3) է։", "«Որ։» ասաց նա։", "Իր"],
    ["ወ ሰመ።", "በ፧", "እም"],
    ["See {{work.title}} and <?= $x ?>.", "Then 100%.", "Done"],
    ["Ends here.”", "Next one."],
]


def test_cases():
    for units in CASES:
        text = " ".join(units)
        got = [text[a:b] for a, b in sentence_spans(text)]
        assert got == units


def test_gaps_and_lines():
    text = "No gap.Next one。\nnot a break\r\n \r\nnew\n\nlast e​tc. and so​. X"
    assert [text[a:b] for a, b in sentence_spans(text)] == ["No gap.", "Next one。", "not a break", "new", "last e​tc. and so​.", "X"]
    assert sentence_spans("") == sentence_spans(" \n\n") == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='aB. ?!"”»«(){}\n\r;。字λ…1​', max_size=60))
def test_nothing_is_lost(text):
    spans = sentence_spans(text)
    inside = "".join(text[a:b] for a, b in spans)
    seen = lambda s: [c for c in s if not c.isspace() and c != "​"]
    assert seen(inside) == seen(text)
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    assert all(p[1] <= q[0] for p, q in zip(spans, spans[1:], strict=False))


def test_table(spark):
    rows = [(1, "A b. C d.", "x"), (2, None, "x"), (3, " ", "x"), (4, "Word. Next one here. " * 30_000, "x"), (1, "A b. C d.", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start_at string")
    got = split_sentences(df, "doc_id", "text", with_text=True).collect()
    assert sorted((r["sentence_no"], r["start_at"], r["end_at"], r["sentence"]) for r in got if r["doc_id"] == 1) == [(1, 0, 4, "A b."), (1, 0, 4, "A b."), (2, 5, 9, "C d."), (2, 5, 9, "C d.")]
    assert sum(r["doc_id"] == 4 for r in got) == 60_000 and len(got) == 60_004
    assert split_sentences(df.limit(0), "doc_id", "text").count() == 0


def test_long_armenian_words_before_a_full_stop():
    text = "Մատենադարան. Երևան քաղաք։ Գրքերը այնտեղ են։"
    assert [text[a:b] for a, b in sentence_spans(text)] == ["Մատենադարան. Երևան քաղաք։", "Գրքերը այնտեղ են։"]


def cut(text, label=None):
    return [text[a:b] for a, b in sentence_spans(text, label)]


def test_tables_by_language():
    english = "The gift of the king was for the abbey and that of Gov. Smith is by the door. "
    assert cut(english) == [english.strip()]
    assert cut(english + "He was of the Bd. Then the rest came.")[1:] == ["He was of the Bd.", "Then the rest came."]
    german = "Der Text und die Noten sind nicht von dem Schreiber, Bd. Zwei ist mit der Hs. Anders gilt das Bsp. Hier."
    assert cut(german) == [german]
    assert cut("Bd. Zwei", "de") == ["Bd. Zwei"] and cut("Bd. Zwei", "en") == ["Bd.", "Zwei"] and cut("Bd. Zwei", None) == cut("Bd. Zwei", "xx") == ["Bd. Zwei"]
    assert cut("Смотри табл. Первая часть. Вторая часть.") == ["Смотри табл. Первая часть.", "Вторая часть."]
    assert cut("See (Hom. 4.2) there. Next.", "en") == ["See (Hom. 4.2) there.", "Next."]


def test_armenian_stop_is_not_the_full_stop():
    assert cut("Բարձրագույն. Այսպես է։ Բառ.") == ["Բարձրագույն. Այսպես է։", "Բառ."]


def test_many_straight_quotations_take_linear_time():
    import time

    took = []
    for n in (4_000, 16_000):
        text = '"So it is," he said. "No." ' * n
        began = time.perf_counter()
        sentence_spans(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]
