"""Term counts against a plain count; runs that cross batches."""

import random
from collections import defaultdict

import pyarrow as pa

from quillspark.llm.frequency import last_seen, marked_terms


def brute(rows, cols):
    once = {}
    for r in rows:
        if r[0] is not None:
            key = (r[0], r[1])
            if key not in once or (r[-1] or 0) > (once[key][-1] or 0):
                once[key] = r
    n, docs = defaultdict(int), defaultdict(set)
    for r in once.values():
        for k, c in enumerate(cols):
            if r[2 + k]:
                n[c, r[2 + k]] += 1
                docs[c, r[2 + k]].add(r[0])
    total = len({k[0] for k in once})
    out = set()
    for key, k in n.items():
        d = len(docs[key])
        out.add((*key, k, d, "rare" if k < 5 or d < 3 else "common" if d * 10 > total else None))
    return out


def test_counts(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(4000):
        doc = rnd.choice(["hot", *[f"d{k}" for k in range(40)], None]) if rnd.random() < 0.7 else "hot"
        slot = rnd.choice([None, rnd.randrange(3000)])
        rows.append((doc, slot, *random.Random(f"{doc}{slot}").choices(["the", "a", "", None, "x", "y", *[f"w{k}" for k in range(60)]], k=2), 1))
    rows += rows[:500]
    df = spark.createDataFrame(rows, "doc string, slot long, lemma string, plain string, term long")
    got = {tuple(r) for r in marked_terms(df, "doc", "slot", ["lemma", "plain"], "term").collect()}
    assert got == brute(rows, ["lemma", "plain"])


def test_empty(spark):
    df = spark.createDataFrame([], "doc string, slot long, lemma string, at long")
    assert marked_terms(df, "doc", "slot", ["lemma"], "at").count() == 0


def test_runs_cross_batches():
    rows = sorted((f, t, d) for f in "ab" for t in ("x", "y") for d in ("1", "1", "2", "3"))
    for size in (1, 2, 3, 100):
        batches = []
        for at in range(0, len(rows), size):
            part = rows[at : at + size]
            batches.append(pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part, strict=True)] + [pa.array([2] * len(part), pa.int64())], names=["f", "t", "r", "n"]))
        out = [tuple(r.values()) for b in last_seen(iter(batches)) for r in b.to_pylist()]
        assert sorted(out) == [(f, t, 8, 3) for f in "ab" for t in ("x", "y")]
