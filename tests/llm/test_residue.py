"""Residue against content that speaks of it, and the template tree."""

import random
from re import _parser as re_parser

import pyarrow as pa

from quillspark.llm import residue as R
from quillspark.llm.residue import PrefixTree, has_slot, is_residue, mask, message_templates, residue_ids, scan, without_residue

RESIDUE = [
    "Please enable JavaScript to view this page.", "YOU NEED TO ENABLE JAVASCRIPT TO RUN THIS APP.", "404 Not Found", "502 Bad gateway.", "Error 500: página no encontrada.", "Your session has expired. Please sign in again.",
    "Lorem ipsum dolor sit amet.", "Text goes here.", "Seite nicht gefunden.", "Bitte aktivieren Sie JavaScript, um die Edition zu lesen.", "お探しのページは見つかりませんでした。", "請啟用 JavaScript 以閱讀本文。",
    "By {{ author }} in {{year}}.", "Dear <first name>, hello", "Codex ${folio}, leaf %PLACE%", "Title: TBD_TITLE", "See [your translator] now", "Voir :shelfmark: et", "Section «%s» of work", "Revised on YYYY-MM-DD.",
    "Access de​nied.", "Traceback (most recent call last): KeyError: x", "xxxxx xxxx xxx xxxxxx", "real text here.\n\nAccess denied.\n\nmore real text",
]
CONTENT = [
    "The page was not found in the second codex, so Brown follows the first.", "The error in line 12 is due to the copyist.", "Access to the library was denied to Brown by the abbot.", "The set {a, b, c} of witnesses agrees with Brown.",
    "{Liber I}\n\nSed non.", "The mark <|endoftext|> stands after the colophon of Brown.", "In the year 404 the bishop wrote.", "Brown gives the price as $40 and the loss as 100%.", "Dolorem ipsum sensit Brown in corpore.",
    "The hand writes xxx for thirty, as Brown saw.", "The notes of Brown explain how the JavaScript viewer of the edition shows both columns.", "La page de Brown est déplacée dans ce manuscrit.", "Signs such as [... and ] show where Brown supplies letters.",
    "Here Brown reads ipsum and not ipsam.", "The request of Brown came too late, and the gateway was bad.", "", "word: another; 3:4",
]


def told(text):
    slot, messages = scan(text)
    return slot or any(is_residue(m) for m in messages)


def test_cases():
    assert [t for t in RESIDUE if not told(t)] == []
    assert [t for t in CONTENT if told(t)] == []


def test_tree():
    tree = PrefixTree()
    a = tree.add("the error in line <0> is due to brown")
    b = tree.add("the error in line <0> is due to smith")
    c = tree.add("the error was elsewhere in this line and page")
    assert a is b and a[-1] == "<*>" and c is not a
    assert mask("Error 12 for request a9aab6618f of Brown") == "error <0> for request <id> of <name>"
    assert not has_slot("a: b, c (d) 5% <3")


def test_tables(spark):
    rows = [(k, t, "x") for k, t in enumerate([*RESIDUE, *CONTENT, None, "plain " * 100_000 + "end. Access denied."])] + [(0, RESIDUE[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, message string")
    want = {*range(len(RESIDUE)), len(RESIDUE) + len(CONTENT) + 1}
    got = [r["doc_id"] for r in residue_ids(df, "doc_id", "text").collect()]
    assert sorted(got) == sorted(want)
    kept = without_residue(df, "doc_id", "text")
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {k for k, *_ in rows} - want
    assert message_templates(df, "doc_id", "text").where("residue").count() > 5
    assert residue_ids(df.limit(0), "doc_id", "text").count() == 0


def wordings(pattern):
    """Every wording of a parsed pattern, its repeats at their fewest and most, of two at the most; anchors and boundaries are no part of it."""
    out = [""]
    for op, arg in pattern:
        name = str(op)
        if name == "LITERAL":
            own = [chr(arg)]
        elif name == "ANY":
            own = ["'"]
        elif name == "IN":
            own = [chr(v) for o, v in arg if str(o) == "LITERAL"] or ["."]
        elif name == "BRANCH":
            own = [w for branch in arg[1] for w in wordings(branch)]
        elif name == "SUBPATTERN":
            own = wordings(arg[-1])
        elif name == "MAX_REPEAT":
            least, most, inner = arg
            own = [w * n for w in wordings(inner) for n in {least, max(least, min(most, 1))}]
        else:
            assert name == "AT", name
            own = [""]
        out = [a + b for a in out for b in own]
    return out


def test_every_wording_of_a_residue_pattern_has_a_cue():
    ((kind, (_, branches)),) = re_parser.parse(R.RESIDUE.pattern)
    assert str(kind) == "BRANCH"
    missed = []
    for branch in branches:
        free = str(branch[0][0]) != "AT"
        for w in wordings(branch):
            w = w.replace("<0>", "404").replace("<id>", "a9aab6618f").replace("<name>", "brown").replace("<*>", "word")
            missed += [t for t in (w, *(["so " + w, "請" + w] if free else [])) if not R._has_cue(t)]
    assert missed == []


def test_messages_that_had_no_cue():
    for t in (
        "401 Unauthorized", "HTTP 503", "Code 404", "You are not authorized to view this edition.", "The page you are looking for does not exist.", "Back to the home page", "Stack trace:", "Call to undefined function f()",
        "TypeError: x is None", "ValueError: bad", "KeyError: 'x'", "The page\nyou are looking\nfor does not exist.", "Please try\nagain later.", "請JavaScriptを有効化",
    ):
        assert told(t), t
    for t in ("The manuscripts must be read with the internal notes.", "The gift is to enable scriptural study of the service books."):
        assert not told(t), t


def test_verdict_outlives_merges():
    residue = ["please enable javascript to view this page.", "please enable cookies to view this page.", "please enable javascrpt to view this page."]
    speaks = ["please enable javascript to view this codex.", "please enable javascript to view this charter."]
    table = R._mine(pa.table({"message": [*residue, *speaks], "seen": [1] * 5, "alone": [0] * 5}))
    told = {m: (t, v) for m, t, v in zip(*(table.column(c).to_pylist() for c in ("message", "template", "residue")), strict=True)}
    assert {told[m] for m in residue} == {("please enable <*> to view this page.", True)}
    assert {told[m] for m in speaks} == {("please enable javascript to view this <*>", False)}


def test_documents_of_merged_messages(spark):
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("ab", "eb", "ib", "ob")]
    texts = [f"Please enable {w} in the {v} to view this page." for w in ("JavaScript", "cookies") for v in words]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in residue_ids(df, "doc_id", "text").collect()} == set(range(len(texts)))


def test_templates_decide(spark):
    """Messages whose marks are weak are residue only by the documents of their template; none of them stands in more than one document."""
    weak = [f"This view of the {a}{b} chant is not available at the moment" for a in "bcd" for b in "xyz"]
    rare = ["The view from this tower is not available to strangers in winter"]
    assert not any(R.is_residue(m) for t in [*weak, *rare] for m in R.cued_messages(t)), [R.marks(m) for t in weak for m in R.cued_messages(t)]
    content = " The monk wrote of it to his brother in the valley, who came to see the walls and the well."
    df = spark.createDataFrame([(k, t + "." + content) for k, t in enumerate([*weak, *rare])], "doc_id long, text string")
    assert {r["doc_id"] for r in residue_ids(df, "doc_id", "text").collect()} == set(range(len(weak)))
    assert R.is_residue(R.cued_messages("Session closed by remote host.")[0], 1, 1)  # nothing else in the text


def test_full_leaves_are_split_by_more_tokens(spark, monkeypatch):
    monkeypatch.setattr(R, "LEAF_ROWS", 3)
    messages = spark.createDataFrame([(f"a b {c} d {e}", 1) for c in "xyz" for e in "uvw"] + [("a b", 1)], "message string, seen long")
    got = {r["message"]: r["leaf"] for r in R._leaves(messages).collect()}
    assert got["a b"] == "2 a b" and got["a b x d u"] == "5 a b x d" and len(set(got.values())) == 4


def test_wrapped_slots():
    assert has_slot("By {{ author of\nthe work }} in") and has_slot("See [your " + "long " * 30 + "name]") and not has_slot("a {{ b\n\nc }} d")


def test_no_result_depends_on_how_many_messages_a_leaf_has(spark, monkeypatch):
    """Weak messages that differ in the tokens by which full leaves are split, some of them with tokens like a wild card."""
    weak = [f"This view {w} the old chant is not available at the moment" for w in ("inside", "under", "behind", "<*>")]
    weak += [f"This view beyond {w} {v} chant is not available at the moment" for w, v in (("a", "dim"), ("some", "<*>"), ("each", "far"))]
    rare = [f"This view {a} stone {b} was not available to strangers in {c}" for a, b, c in (("from", "tower", "winter"), ("over", "wall", "spring"))]
    content = " The monk wrote of it to his brother in the valley, who came to see the walls and the well."
    df = spark.createDataFrame([(k, t + "." + content) for k, t in enumerate([*weak, *rare])], "doc_id long, text string")
    told = []
    for rows in (1_000, 3):
        monkeypatch.setattr(R, "LEAF_ROWS", rows)
        told.append((sorted(r["doc_id"] for r in residue_ids(df, "doc_id", "text").collect()), sorted(map(tuple, message_templates(df, "doc_id", "text").collect()))))
    assert told[0] == told[1] and told[0][0] == list(range(len(weak)))


def made(n, seed):
    """Messages of all lengths up to 24 tokens in few leaves, many of them similar, in the order of mining."""
    r = random.Random(seed)
    out = set()
    for _ in range(n // 4):
        own = ["page", r.choice("ab"), *(r.choice(["u", "v", "w", "x", "y", "z", R.WILD]) + r.choice(["", "", "1", "2"]) for _ in range(r.randint(0, 22)))]
        for _ in range(4):
            out.add(" ".join(t if k < 2 or r.random() > 0.15 else r.choice("uvwxyz") for k, t in enumerate(own)))
    return sorted(out)


def test_tree_against_every_template():
    tree, leaves = PrefixTree(), {}
    for message in made(4_000, 1):
        tokens = message.split(" ")
        leaf = leaves.setdefault((len(tokens), *tokens[:2]), [])
        shares = [sum(a == b != R.WILD for a, b in zip(t, tokens, strict=True)) / len(tokens) for t in leaf]
        best = leaf[shares.index(max(shares))] if shares and max(shares) >= R.SIMILAR else None
        if best is None:
            leaf.append(best := tokens)
        else:
            best[:] = [a if a == b else R.WILD for a, b in zip(best, tokens, strict=True)]
        assert tree.add(message) == best


def test_pieces_of_leaves_against_whole_leaves(spark, monkeypatch):
    rows = [(m, 1 + k % 3, k % 2) for k, m in enumerate(made(3_000, 2))]
    messages = spark.createDataFrame(rows, "message string, seen long, alone long")
    mined = lambda leaves: sorted(map(tuple, leaves.groupBy("leaf").applyInArrow(R._mine, "message string, template string, documents long, residue boolean").collect()))
    want = mined(messages.withColumn("leaf", R._prefix(R.DEPTH)))
    monkeypatch.setattr(R, "LEAF_ROWS", 10)
    assert mined(R._joined(R._leaves(messages))) == want and mined(R._leaves(messages)) != want
    assert R._joined(R._leaves(messages)).select("leaf").distinct().count() > messages.select(R._prefix(R.DEPTH)).distinct().count()
