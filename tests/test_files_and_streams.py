"""Sources, sinks and incremental runs."""

import pytest
from pyspark.sql import functions as F

from quillspark.sources import files, sinks
from quillspark.streaming import incremental


def test_delimited_and_discovery(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.tsv").write_text('Chapter\tText\n1\t"two\nlines"\n')
    (tmp_path / "b.md").write_text("skip")
    assert [r["name"] for r in files.list_files(spark, str(tmp_path)).collect()] == ["x.tsv"]
    df = files.read_delimited(spark, str(tmp_path / "a" / "x.tsv"))
    assert df.columns == ["chapter", "text"] and [tuple(r) for r in df.collect()] == [("1", "two\nlines")]
    with pytest.raises(ValueError):
        files.read_delimited(spark, str(tmp_path / "a" / "x.tsv"), header=["one"])
    sinks.write_tsv(df, str(tmp_path / "out"))
    assert [tuple(r) for r in files.read_delimited(spark, str(tmp_path / "out"), sep="\t").collect()] == [("1", "two\nlines")]


def test_lemma_sources(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("f\tg\tm\tx\nh\th\tm\ty\n")
    assert sorted(map(tuple, files.read_lemma_tsv(spark, str(tmp_path / "l.tsv")).collect())) == [("f", "x"), ("g", "x"), ("h", "y")]
    (tmp_path / "l.xml").write_text("<r><t><f>f</f><b>g</b><l>x</l></t></r>")
    assert sorted(map(tuple, files.read_lemma_xml(spark, str(tmp_path / "l.xml")).collect())) == [("f", "x"), ("g", "x")]
    (tmp_path / "c.txt").write_text("1.1\ta\r\nb")
    assert [r["line"] for r in files.read_citation_text(spark, str(tmp_path / "c.txt")).orderBy("line_no").collect()] == ["1.1\ta", "b"]


def test_graph_sinks(spark, tmp_path):
    f = spark.createDataFrame([("1", 5, "x", "a"), ("1", 6, "x", "b\n"), ("1", 9, "x", None)], "doc_id string, node long, feature string, feature_value string")
    sinks.write_feature_text(f, "doc_id", str(tmp_path / "tf"))
    got = spark.read.text(str(tmp_path / "tf")).collect()
    assert sorted(r["value"] for r in got) == ["5\ta", "9\t", "b\\n"]
    for mode in ("errorifexists", "ignore"):
        sinks.write_graph(f, f, f, f, str(tmp_path / "g"), mode)
    assert spark.read.parquet(str(tmp_path / "g" / "nodes")).count() == 3
    w = spark.createDataFrame([("m", "c1", "text")], "m string, hand string, text string")
    sinks.write_witnesses(w, "m", "hand", "text", str(tmp_path / "w"))
    assert (tmp_path / "w" / "witness=m_c1").exists()
    p = w.select(sinks.output_path([[F.lit(None).cast("string"), F.lit("a/b")], [F.lit("")]], [["x", "y"], ["z"]]))
    assert p.collect()[0][0] == "a-b/unknown z/1.0"


def test_streams(spark, tmp_path):
    src = "/root/testdata/sf0.001/documents.parquet"
    spark.read.parquet(src).repartition(3).write.parquet(str(tmp_path / "in"))
    docs = incremental.read_documents(spark, str(tmp_path / "in"), 1)
    q = incremental.stream_slots(docs, str(tmp_path / "slots"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert q.exception() is None
    out = spark.read.parquet(str(tmp_path / "slots"))
    assert out.select("doc_id", "slot").distinct().count() == out.count() > 1000
    counts = incremental.stream_counts(docs).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert spark.sql("SELECT sum(documents) FROM counts").collect()[0][0] == spark.read.parquet(src).count()


def test_feature_files_paths_and_lexicons(spark, tmp_path):
    f = spark.createDataFrame([("1", 5, "x", "a"), ("1", 6, "x", "b"), ("2", 9, "x", "c")], "doc_id string, node long, feature string, feature_value string")
    head = spark.createDataFrame([("x", "@node\n@valueType=str")], "feature string, header string")
    sinks.write_feature_files(f, head, "doc_id", str(tmp_path / "tf"))
    got = "".join(p.read_text() for p in (tmp_path / "tf" / "feature=x").glob("*.txt"))
    assert sorted(got.split("@node\n@valueType=str\n\n")[1:]) == ["5\ta\nb\n\n", "9\tc\n\n"]
    p = spark.createDataFrame([("a/b/1.0", 1), ("a/b/1.0", 2), ("c/1.0", 3)], "path string, n int")
    assert [(r["n"], r["folder"]) for r in sinks.numbered_paths(p, "path", "n").orderBy("n").collect()] == [(1, "a/b/1/1.0"), (2, "a/b/2/1.0"), (3, "c/1/1.0")]
    sinks.write_lexicon(spark.createDataFrame([("b", ["x"]), ("a", ["y"])], "form string, lemma array<string>"), str(tmp_path / "lex"))
    assert spark.read.parquet(str(tmp_path / "lex")).count() == 2


def test_citation_files(spark, tmp_path):
    (tmp_path / "w1.txt").write_text("1.1\tone\n1.\n2\ttwo\n1.3\n" + "".join(f"2.{k}\tline {k}\n" for k in range(500)))
    (tmp_path / "w2.txt").write_text("5\tx\r\n6\ty\r\n")
    schemes = spark.createDataFrame([("w1.txt", "Book//Chapter"), ("w2.txt", "line")], "file string, citation_scheme string")
    got = files.read_citations(spark, str(tmp_path), schemes).orderBy("path", "line_no").collect()
    assert [(r["line_no"], r["refs"], r["text"]) for r in got][:3] == [(1, ["1", "1"], "one"), (3, ["1", "2"], "two"), (5, ["2", "0"], "line 0")]
    assert [(r["refs"], r["text"]) for r in got][-2:] == [(["5"], "x"), (["6"], "y")] and len(got) == 504 and got[0]["levels"] == ["book", "chapter"]
