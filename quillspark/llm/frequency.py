"""How often every distinct term occurs, in how many records, and which terms are too rare or too common.

Last-seen counters: tokens are hash-partitioned by term and ordered by record,
so that a term needs its occurrences, its records and the last record only, and
no set of records. Before that, each stretch of a record's slots is reduced to
one row for each term; a term's partition is salted by record, so that a term
that holds a third of all tokens is spread over as many tasks as the session's
shuffles have, and over ``SALTS`` at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRETCH = 1024
SALTS = 16
_OUT = pa.schema([("field_name", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


def _changed(col: pa.Array, last: str | None, first: bool) -> np.ndarray:
    out = np.ones(len(col), dtype=bool)
    if len(col) > 1:
        out[1:] = pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)
    out[0] = first or col[0].as_py() != last
    return out


def last_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (field_name, term, record, n) in that order → one row for each run of a term."""
    held: list | None = None  # field, term, occurrences, records, last record
    for batch in batches:
        if not batch.num_rows:
            continue
        field, term, record = batch.column(0), batch.column(1), batch.column(2)
        n = batch.column(3).to_numpy()
        new_term = _changed(field, held and held[0], held is None) | _changed(term, held and held[1], held is None)
        new_record = new_term | _changed(record, held and held[4], held is None)
        starts = np.flatnonzero(np.r_[True, new_term[1:]])
        occurrences = np.add.reduceat(n, starts)
        records = np.add.reduceat(new_record.astype(np.int64), starts)
        fields, terms = field.take(pa.array(starts)), term.take(pa.array(starts))
        if held is not None:
            if new_term[0]:
                yield pa.RecordBatch.from_arrays([pa.array([held[k]], _OUT.field(k).type) for k in range(4)], schema=_OUT)
            else:
                occurrences[0] += held[2]
                records[0] += held[3]
        k = len(starts) - 1
        held = [fields[k].as_py(), terms[k].as_py(), int(occurrences[k]), int(records[k]), record[len(record) - 1].as_py()]
        yield pa.RecordBatch.from_arrays([fields.slice(0, k), terms.slice(0, k), pa.array(occurrences[:k], pa.int64()), pa.array(records[:k], pa.int64())], schema=_OUT)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held[k]], _OUT.field(k).type) for k in range(4)], schema=_OUT)


def term_counts(df: DataFrame, record_col: str, slot_col: str, term_cols: list[str], order_col: str | None = None) -> DataFrame:
    """Rows (field_name, term, occurrences, records) of every distinct non-empty term.

    Rows with the same record and slot count once, by the greatest ``order_col``;
    rows with a null record are left out, as they belong to none; a null slot is
    a value like any other. Null and empty terms don't count.
    """
    src = df.select(
        F.col(record_col).cast("string").alias("record"),
        F.col(slot_col).cast("long").alias("slot"),
        (F.col(order_col) if order_col else F.lit(None).cast("timestamp")).alias("ord"),
        *[F.col(c).cast("string").alias(f"t{k}") for k, c in enumerate(term_cols)],
    ).where(F.col("record").isNotNull())
    salts = max(SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    stretch = F.floor(F.col("slot") / STRETCH).alias("stretch")
    terms = [F.struct(F.lit(c).alias("field_name"), F.col(f"last.t{k}").alias("term")) for k, c in enumerate(term_cols)]
    reduced = (
        src.withColumn("stretch", stretch)
        .repartition("record", "stretch")
        .groupBy("record", "stretch", "slot")
        .agg(F.max(F.struct("ord", *[f"t{k}" for k in range(len(term_cols))])).alias("last"))
        .select("record", "stretch", F.inline(F.array(*terms)))
        .where(F.col("term") != "")
        .groupBy("record", "stretch", "field_name", "term")
        .agg(F.count("*").alias("n"))
    )
    runs = (
        reduced.select("field_name", "term", "record", "n", F.pmod(F.xxhash64("record"), F.lit(salts)).alias("salt"))
        .repartition("field_name", "term", "salt")
        .sortWithinPartitions("field_name", "term", "record")
        .select("field_name", "term", "record", "n")
        .mapInArrow(last_seen, "field_name string, term string, occurrences long, records long")
    )
    return runs.groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(df: DataFrame, record_col: str, slot_col: str, term_cols: list[str], order_col: str | None = None, min_occurrences: int = 5, min_records: int = 3, max_share: tuple[int, int] = (1, 10)) -> DataFrame:
    """``term_counts`` with ``verdict``: rare, common, or null for a useful term."""
    total = df.where(F.col(record_col).isNotNull()).agg(F.count_distinct(F.col(record_col))).scalar()
    part, whole = max_share
    rare = (F.col("occurrences") < min_occurrences) | (F.col("records") < min_records)
    common = F.col("records") * whole > total * part
    return term_counts(df, record_col, slot_col, term_cols, order_col).withColumn("verdict", F.when(rare, "rare").when(common, "common"))
