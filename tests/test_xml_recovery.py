"""Recovery of broken XML: worked cases, and any tag soup parses afterwards."""

from xml.etree import ElementTree

from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators.xml_recovery import recover_xml, recovered

CASES = {
    "<a><b>x</a>": "<a><b>x</b></a>",
    "<a>x</b></a>": "<a>x</a>",
    "<a><b>x</a></b>y": "<a><b>x</b></a>y",
    "<a n='1' m=2 n=\"3\">1 < 2 & 3 &amp; 4": '<a n="3" m="2">1 &lt; 2 &amp; 3 &amp; 4</a>',
    "<a><!-- <b> --><pb/></a>": "<a><!-- <b> --><pb/></a>",
    "": "",
}


def test_cases():
    for broken, whole in CASES.items():
        assert recovered(broken) == whole and recovered(whole) == whole


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<a>", "</a>", "<b n='x'>", "</b>", "<c m=1 m=2>", "</c>", "<d/>", "text & more", "<", ">", '"', "&amp;"]), max_size=25))
def test_any_soup(pieces):
    ElementTree.fromstring("<root>" + recovered("".join(pieces)) + "</root>")


def test_table(spark):
    df = spark.createDataFrame([(1, "<a><b>x</a>", "clash"), (1, "<a><b>x</a>", "clash"), (None, None, ""), (2, "<a>" * 20_000, "")], "doc long, x string, id string")
    got = recover_xml(df, "doc", "x").collect()
    assert sorted((r["doc"] or 0, len(r["x"] or "")) for r in got) == [(0, 0), (1, 15), (1, 15), (2, 140_000)]
    assert recover_xml(df.limit(0), "doc", "x").count() == 0
