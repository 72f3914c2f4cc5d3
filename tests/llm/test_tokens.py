"""Ids by chunks and stitches against the encoding of whole texts; exact round trips; packing."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import tokens as K
from quillspark.llm.packing import CAPACITY, assign, pack_sizes, pack_texts

V = K.default_vocabulary()


def long_texts():
    rnd = random.Random(3)
    words = ["the", "Zum", "λόγος", "1.23", "don't", "we're", "  ", "\n\n", "。", "字字", "…", "<|endoftext|>", "é", "x​y", "\x1c", "\x85"]
    yield " ".join(rnd.choices(words, k=20_000))
    yield "".join(rnd.choices(words, k=20_000))
    yield "字" * 40_000
    yield "a" * 50_000
    yield " " * 40_000 + "x"
    yield ("a" * 17_000 + " ") * 4
    yield "'s" * 30_000
    yield ("ab'" * 5_461 + "re ") * 5
    yield "x" * K.CHUNK
    yield "x" * K.CHUNK + " y"


def test_every_text_as_a_whole(spark):
    texts = [None, "", " ", "a", "<|endoftext|> it's", *long_texts()]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(5, texts[5], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = K.encode_column(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in got:
        t = texts[r["doc_id"]]
        assert r["ids"] == list(K.encode(t, V)), r["doc_id"]
        assert K.decode(r["ids"], V) == (t or "")
    counts = {(r["doc_id"], r["n_tokens"]) for r in K.encode_column(df, "doc_id", "text", count_only=True).collect()}
    assert counts == {(k, len(K.encode(t, V))) for k, t in enumerate(texts)}
    assert K.encode_column(df.limit(0), "doc_id", "text").count() == 0


def test_long_texts_with_null_ids_or_from_a_shuffle_stay(spark, tmp_path):
    texts = [f"{k} " + "word, " * (3_000 if k % 3 else 7) for k in range(180)]
    ids = [None if k % 20 == 1 else k // 2 for k in range(180)]
    want = Counter((i, len(K.encode(t, V))) for i, t in zip(ids, texts, strict=True))
    path = str(tmp_path / "texts")
    spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").coalesce(1).write.parquet(path)
    one_file = spark.read.parquet(path)
    for df in (one_file, one_file.repartition(7)):
        for _ in range(2):
            got = K.encode_column(df, "doc_id", "text", count_only=True).collect()
            assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == want


def test_same_as_the_other_library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in ("It's 12.5 — «λόγος»\n\n 字", "<|endoftext|>", *list(long_texts())[:2]):
        assert t.encode(text, add_special_tokens=False).ids == list(K.encode(text, V))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'sre 1\n\x1c\x85 字.é", min_size=1, max_size=60), st.integers(0, 59))
def test_firm_boundaries_hold_in_any_context(text, cut):
    """What a chunk calls firm is a boundary of the whole text, wherever the chunk begins."""
    cut = cut % len(text)
    whole = {m.end() for m in K._PRE.finditer(text)}
    firm = [cut + b for b in K._firm_boundaries(text[cut:], 1, len(text) - cut, True)]
    assert set(firm) <= whole


def test_assign_wastes_little_and_splits_nothing():
    rnd = np.random.default_rng(0)
    sizes = np.minimum(rnd.lognormal(6, 1, 4000).astype(np.int64), CAPACITY)
    own = assign(sizes, CAPACITY)
    fill = np.bincount(own, weights=sizes)
    assert fill.max() <= CAPACITY and len(fill) <= 1.01 * -(-sizes.sum() // CAPACITY)
    assert (assign(np.zeros(3, np.int64), 10) == 0).all() and len(assign(np.empty(0, np.int64), 10)) == 0


def test_containers(spark):
    rnd = random.Random(5)
    sizes = {k: rnd.choice([0, None, 1, 5, 9, 10, 11, 25, 30]) for k in range(900)}
    df = spark.createDataFrame(list(sizes.items()), "id long, n long")
    rows = pack_sizes(df, "id", "n", capacity=10, items=100).collect()
    fill, own, parts = Counter(), Counter(), Counter()
    for r in rows:
        fill[r["container"]] += r["n_tokens"]
        own[r["id"]] += r["n_tokens"]
        parts[r["id"]] += 1
    assert max(fill.values()) <= 10
    assert own == Counter({k: n or 0 for k, n in sizes.items()}) and set(own) == set(sizes)
    assert all(parts[k] == max(1, -(-(n or 0) // 10)) for k, n in sizes.items())
    assert pack_sizes(df.limit(0), "id", "n").count() == 0
    texts = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "word " * 5000)], "id long, text string")
    got = pack_texts(texts, "id", "text").collect()
    assert {r["id"] for r in got} == {1, 2, 3, 4} and sum(r["n_tokens"] for r in got) == sum(len(K.encode(t, V)) for t in ("a b", "word " * 5000))


def test_cost_balance_and_exchanges():
    """One rule for all sizes: the first texts go to the least cost, containers stay even, and exchanges leave little room."""
    own = assign(np.array([6, 5, 4, 3]), 10)
    assert own.tolist() == [0, 1, 1, 0]
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(1, CAPACITY + 1, 2000)
    own = assign(sizes, CAPACITY)
    costs = np.bincount(own, weights=sizes + sizes**2 / 4096)
    bound = -(-sizes.sum() // CAPACITY)
    assert len(costs) <= 1.03 * bound and costs.max() < 1.6 * costs.mean()
    assert len(np.bincount(assign(sizes, CAPACITY, slack=0.2))) >= 1.2 * bound - 1


def test_rows_of_one_id_or_none(spark):
    """A third of the rows has no id: they are spread over runs and all kept."""
    df = spark.range(6000).selectExpr("CASE WHEN id % 3 > 0 THEN id END AS id", "CASE WHEN id % 3 = 0 THEN 3 ELSE id % 7 END AS n", "'x' AS container")
    got = pack_sizes(df, "id", "n", capacity=10, items=100)
    assert got.count() == 6000 and got.where("id IS NULL").count() == 2000
    assert got.groupBy("container").sum("n_tokens").agg({"sum(n_tokens)": "max"}).collect()[0][0] <= 10


def test_decoding(spark):
    df = spark.createDataFrame([(1, list(map(int, K.encode("λόγος 字", V)))), (2, []), (3, None)], "id long, ids array<int>")
    assert {(r["id"], r["text"]) for r in K.decode_column(df, "id", "ids").collect()} == {(1, "λόγος 字"), (2, ""), (3, None)}
