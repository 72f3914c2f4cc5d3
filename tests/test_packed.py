from quillspark.operators.packed import explode_packed

CASES = {
    "book//chapter/ Section ": ["book", "chapter", "section"],
    'a,"b, ""c"""; d': ["a", 'b, "c"', "d"],
    "editor's page: column": ["editor's page", "column"],
    "'Section'\nPage": ["section", "page"],
    "'editor's page'/x": ["editor's page", "x"],
    "PAGE (ED. 2) \\ FRAGMENT;CANON": ["page (ed. 2)", "fragment", "canon"],
    "«fragment; testimony»|sub-chapter > st. page": ["fragment; testimony", "sub-chapter", "st. page"],
    "“Line | Half-Line” · \t·Old  page": ["line | half-line", "old  page"],
    '""/ /x': ["x"],
    'old "a/b" page': ['old "a/b" page'],
    'a "b/c': ["a", "b", "c"],
    "0/1": ["0", "1"],
    "": [],
    "  \n": [],
    "///": [],
}


def test_cases(spark):
    rows = [(f"w{k}", s, k, "clash") for k, s in enumerate(CASES)] + [("null", None, 1, "clash")]
    df = spark.createDataFrame(rows, "work_id string, scheme string, loaded long, level_name string")
    got: dict = {}
    for r in explode_packed(df, "work_id", "scheme", "loaded").collect():
        got.setdefault(r["work_id"], []).append((r["pos"], r["level_name"]))
    for k, (s, want) in enumerate(CASES.items()):
        assert sorted(got.get(f"w{k}", [])) == list(enumerate(want, 1)), s
    assert "null" not in got


def test_once_for_each_work_nulls_and_empty(spark):
    schema = "id string, scheme string, loaded long"
    df = spark.createDataFrame([("a", "x/y", 2), ("a", "x/y", 1), ("a", "old", None), (None, "p", 1), (None, "q", 1), (None, "q", 2)], schema)
    assert sorted(map(tuple, explode_packed(df, "id", "scheme", "loaded").collect()), key=str) == sorted([("a", 1, "x"), ("a", 2, "y"), (None, 1, "p"), (None, 1, "q")], key=str)
    assert explode_packed(spark.createDataFrame([], schema), "id", "scheme", "loaded").count() == 0
    assert explode_packed(spark.createDataFrame([("l", "ab/" * 20_000, 1)], schema), "id", "scheme").count() == 20_000
