"""Containers of fixed token capacity filled with texts.

Cost-balanced packing: a text costs its length plus a share of its squared
length, as attention does; texts go in descending order to the container of
least cost that still has room, whatever their size. As many containers are
open as the total asks for, times one plus ``SLACK``. A text that no container
has room for is given room by exchanges: a text of one container is swapped
with a smaller one of another that has room for the difference, so that the
gaps of containers come together; only where none makes room is another
container opened. Texts are spread over the tasks by hash and packed in
runs of ``ITEMS`` texts apart from each other, so that no task grows with the
data; a run leaves less than one container's room more than one packing of
everything would.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.tokens import encode_column

CAPACITY = 2048
ITEMS = 4096
#: Length at which the quadratic part of the cost equals the linear part.
EVEN_AT = 4096
#: Share of containers opened at first beyond those that the total asks for.
SLACK = 0.0
#: Containers, those with most room, in which a swap is looked for, and swaps made for one text, before another container is opened.
TRIED, EXCHANGES = 64, 16
_PARTITION_SPAN = 1 << 40


def cost(n: np.ndarray) -> np.ndarray:
    return n + n.astype(np.float64) ** 2 / EVEN_AT


@dataclass
class _State:
    sizes: np.ndarray
    costs: np.ndarray
    own: np.ndarray  # container of each text, -1 before it has one
    room: np.ndarray
    load: np.ndarray

    def put(self, i: int, at: int) -> None:
        self.own[i] = at
        self.room[at] -= self.sizes[i]
        self.load[at] += self.costs[i]

    def swap(self, a: int, b: int) -> None:
        for i, at in ((a, self.own[b]), (b, self.own[a])):
            self.room[self.own[i]] += self.sizes[i]
            self.load[self.own[i]] -= self.costs[i]
            self.put(i, at)


def _make_room(size: int, s: _State, placed: np.ndarray, used: int) -> int | None:
    """The container that swaps gave room for ``size``, or None, and then all is as before.

    One swap is looked for in all the tried containers at once: the smallest
    difference that is enough. Else the container with most room takes the
    greatest differences one after another.
    """
    sizes, own, room = s.sizes, s.own, s.room
    tried = np.argpartition(-room[:used], min(TRIED, used) - 1)[:TRIED]
    is_tried = np.zeros(used, bool)
    is_tried[tried] = True
    where = own[placed]
    inside = placed[is_tried[where]]
    more = (sizes[inside][:, None] - sizes[placed][None, :]).astype(np.int32)
    lacking = (size - room[own[inside]]).astype(np.int32)[:, None]
    none = np.iinfo(np.int32).max
    enough = np.where((more >= lacking) & (more <= room[where].astype(np.int32)[None, :]) & (own[inside][:, None] != where[None, :]), more, none)
    k = int(np.argmin(enough)) if enough.size else 0
    if enough.size and enough.flat[k] != none:
        mine, other = int(inside[k // len(placed)]), int(placed[k % len(placed)])
        at = int(own[mine])
        s.swap(mine, other)
        return at
    at = int(np.argmax(room[:used]))
    swaps: list[tuple[int, int]] = []
    while room[at] < size and len(swaps) < EXCHANGES:
        where = own[placed]
        inside = placed[where == at]
        more = sizes[inside][:, None] - sizes[placed][None, :]
        more[(more > room[where][None, :]) | (where == at)[None, :]] = 0
        if not more.size or more.max() <= 0:
            break
        enough = np.where(more >= size - room[at], more, np.iinfo(np.int64).max)
        k = int(np.argmin(enough)) if enough.min() < np.iinfo(np.int64).max else int(np.argmax(more))
        mine, other = int(inside[k // len(placed)]), int(placed[k % len(placed)])
        s.swap(mine, other)
        swaps.append((mine, other))
    if room[at] >= size:
        return at
    for mine, other in reversed(swaps):
        s.swap(mine, other)
    return None


def assign(sizes: np.ndarray, capacity: int, slack: float = SLACK) -> np.ndarray:
    """The container of each size (none above the capacity)."""
    order = np.argsort(-sizes, kind="stable")
    used = max(1, int(np.ceil(-(-int(sizes.sum()) // capacity) * (1 + slack))))
    n = max(len(sizes), used)
    s = _State(sizes, cost(sizes), np.full(len(sizes), -1, np.int64), np.full(n, -1, np.int64), np.full(n, np.inf))
    s.room[:used], s.load[:used] = capacity, 0.0
    for k, i in enumerate(order.tolist()):
        size = sizes[i]
        at = int(np.argmin(np.where(s.room[:used] >= size, s.load[:used], np.inf)))
        if s.room[at] < size:
            made = _make_room(size, s, order[:k], used)
            if made is None:
                at, used = used, used + 1
                s.room[at], s.load[at] = capacity, 0.0
            else:
                at = made
        s.put(i, at)
    return s.own


_OUT = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("container", pa.int64()), ("n_tokens", pa.int64())])


def _pack_run(ids: pa.Array, n: np.ndarray, capacity: int, base: int) -> tuple[pa.RecordBatch, int]:
    """The rows of one run of items, and how many containers it has."""
    full = np.where(n > capacity, n // capacity, 0)
    rest = n - full * capacity
    item = np.flatnonzero((rest > 0) | (full == 0))
    own = assign(rest[item], capacity)
    after = int(own.max()) + 1 if len(own) else 0
    owner = np.repeat(np.arange(len(n)), full)
    part = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
    rows = np.r_[owner, item]
    columns = [
        ids.take(pa.array(rows)),
        pa.array(np.r_[part, full[item]], pa.int32()),
        pa.array(base + np.r_[after + np.arange(len(owner)), own], pa.int64()),
        pa.array(np.r_[np.full(len(owner), capacity), rest[item]], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_OUT), after + len(owner)


def _pack(capacity: int, items: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) * _PARTITION_SPAN
        held: list[tuple[pa.Array, np.ndarray]] = []
        count = 0
        for batch in batches:
            times = batch.column("copies").to_numpy()
            rows = np.repeat(np.arange(batch.num_rows), times)
            ids, n = batch.column("id").take(pa.array(rows)), batch.column("n").to_numpy()[rows]
            at = 0
            while at < len(rows):
                step = min(items - count, len(rows) - at)
                held.append((ids.slice(at, step), n[at : at + step]))
                count, at = count + step, at + step
                if count == items:
                    out, opened = _pack_run(pa.concat_arrays([a for a, _ in held]), np.concatenate([b for _, b in held]), capacity, base)
                    yield out
                    held, count, base = [], 0, base + opened
        if count:
            yield _pack_run(pa.concat_arrays([a for a, _ in held]), np.concatenate([b for _, b in held]), capacity, base)[0]

    return run


def pack_sizes(sizes: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY, items: int = ITEMS) -> DataFrame:
    """Rows (id, part, container, n_tokens), one for each row of ``sizes`` and each further part.

    A size above the capacity alone is split: full parts in containers of their
    own, then the rest as an item like any other. An item of size 0 or null
    takes no room, but has a container. Rows with the same id and size, as many
    as there are, and rows with a null id are spread like others: they are
    counted first, and their counts cut to runs. Containers are numbered by
    task, so their numbers have gaps and hold within one result.
    """
    src = sizes.select(F.col(id_col).cast("long").alias("id"), F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    counted = src.groupBy("id", "n").agg(F.count("*").alias("all"))
    runs = counted.select("id", "n", "all", F.explode(F.sequence(F.lit(0), F.floor((F.col("all") - 1) / items))).alias("k"))
    runs = runs.select("id", "n", F.least(F.lit(items), F.col("all") - F.col("k") * items).cast("long").alias("copies"), F.xxhash64("id", "n", "k").alias("at"))
    # a fixed number of tasks: by size alone a few would do all the packing
    tasks = 2 * sizes.sparkSession.sparkContext.defaultParallelism
    ordered = runs.repartition(tasks, "at").sortWithinPartitions("at", "id", "n").select("id", "n", "copies")
    return ordered.mapInArrow(_pack(capacity, items), "id long, part int, container long, n_tokens long").withColumnRenamed("id", id_col)


def pack_texts(df: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """``pack_sizes`` of texts in tokens of a public tokenizer; null and empty texts have size 0."""
    return pack_sizes(encode_column(df, id_col, text_col, vocabulary, count_only=True), id_col, "n_tokens", capacity)
