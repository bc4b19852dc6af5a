"""Best-fit packing of token sequences into fixed-length training sequences, improved by swaps.

1. Documents are tokenised once; a longer one is cut into full pieces, its first piece taking the remainder.
2. Only the histogram of piece lengths (at most ``capacity`` rows) reaches the driver. There, groups of equal bins are
   filled best-fit decreasing, a group at a time, so the plan's size depends on the capacity, not on the corpus.
3. Local search moves one item, or exchanges one for one, two for one or one for two, between underfull groups wherever the sum of squared
   fills rises, so that light bins drain into heavier ones until they are empty. Sizes on offer are indexed, the
   lightest giver first. It ends at the lower bound of bins, or after a pass over all bins that finds no exchange.
4. Each piece finds its place by its rank among the pieces of its length. Ranks are a count within the task that
   read the document plus a running count over tasks, so nothing is sorted and no length meets in one task.

Defined results: a null or empty text is one piece that holds only the end id; repeated rows and repeated or null
``doc_id`` values are packed one by one; a text of any length is cut and packed whole; of equal gains the first found
is taken, which places pieces otherwise but packs no worse; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, tidy, written
from .tokens import MEMO, encoder, file_bytes

_RANK_BITS = 44


class Group:
    """``count`` bins that hold the same ``items``, a Counter of lengths."""

    def __init__(self, count: int, items: Counter):
        self.count, self.items = count, items
        self.fill = sum(s * m for s, m in items.items())


def best_fit(histogram: dict[int, int], capacity: int) -> list[Group]:
    """Best-fit decreasing on a histogram of lengths, over groups of equal bins."""
    by_room: list[list[Group]] = [[] for _ in range(capacity + 1)]

    def put(g: Group) -> None:
        if g.count:
            by_room[capacity - g.fill].append(g)

    for s in sorted(histogram, reverse=True):
        left = histogram[s]
        for room in range(s, capacity + 1):
            if not left:
                break
            each, groups = room // s, by_room[room]
            by_room[room] = []
            for g in groups:
                full = min(g.count, left // each)
                part = 1 if full < g.count and left - full * each > 0 else 0
                last = left - full * each if part else 0
                put(Group(full, g.items + Counter({s: each})))
                put(Group(part, g.items + Counter({s: last})))
                put(Group(g.count - full - part, g.items))
                left -= full * each + last
        each = capacity // s
        put(Group(left // each, Counter({s: each})))
        if left % each:
            put(Group(1, Counter({s: left % each})))
    return [g for groups in by_room for g in groups]


class Content:
    """What one bin of a group holds, and the single items and pairs that it may give, by their size."""

    def __init__(self, items: Counter):
        self.items = items
        self.fill = sum(s * m for s, m in items.items())
        singles = sorted(items)
        pairs = [*combinations(singles, 2), *((s, s) for s in singles if items[s] > 1)]
        self.singles = {s: (s,) for s in singles}
        self.gives = {sum(p): p for p in pairs} | self.singles


class Offers:
    """For each size that underfull bins may give, the bins that may, lightest first."""

    def __init__(self, capacity: int):
        self.at: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        #: Fill of the lightest giver less the size, what is left of it; a large number where nobody gives.
        self.left = np.full(capacity + 1, 1 << 40)

    def change(self, sizes, fill: int, number: int, add: bool) -> None:
        for s in sizes:
            at = self.at[s]
            if add:
                insort(at, (fill, number))
            else:
                del at[bisect_left(at, (fill, number))]
            self.left[s] = at[0][0] - s if at else 1 << 40


def local_search(groups: list[Group], capacity: int) -> list[Group]:
    """Groups without an exchange that raises the sum of squared fills, or at the lower bound of bins.

    A bin takes one item for none, one or two smaller, or two for one; the rise is positive if it ends fuller than the giver was.
    """
    bound = -(-sum(g.fill * g.count for g in groups) // capacity)
    contents: list[Content] = []
    counts: list[int] = []
    numbers: dict[tuple, int] = {}
    singles, offers = Offers(capacity), Offers(capacity)

    def add(items: Counter, count: int) -> None:
        key = tuple(sorted(items.items()))
        if not key or not count:
            return
        if key not in numbers:
            numbers[key] = len(contents)
            contents.append(Content(items))
            counts.append(0)
        i = numbers[key]
        before, counts[i] = counts[i], counts[i] + count
        c = contents[i]
        if c.fill < capacity and (before > 0) != (counts[i] > 0):
            singles.change(c.singles, c.fill, i, counts[i] > 0)
            offers.change(c.gives, c.fill, i, counts[i] > 0)

    def exchange(i: int) -> tuple[int, tuple, tuple] | None:
        """Giver, what it gives and what it takes back, so that bin ``i`` becomes as full as it can."""
        c, best, least = contents[i], None, 0
        room = capacity - c.fill
        for back, take in [(0, ()), *c.gives.items()]:
            if least == room:
                break
            book = offers if len(take) == 1 else singles
            low = back + least + 1
            for at in np.flatnonzero(book.left[low : back + room + 1] < c.fill - back)[::-1]:
                size = low + int(at)
                j = next((j for fill, j in book.at[size][:2] if fill - size < c.fill - back and (j != i or counts[i] > 1)), None)
                if j is not None:
                    best, least = (j, contents[j].gives[size], take), size - back
                    break
        return best

    for g in groups:
        add(g.items, g.count)
    n, going = sum(counts), True
    while going and n > bound:
        going = False
        under = [i for i, c in enumerate(contents) if counts[i] and c.fill < capacity]
        for i in sorted(under, key=lambda i: -contents[i].fill):
            while counts[i] and n > bound and (found := exchange(i)):
                j, give, take = found
                times = counts[i] // 2 if i == j else min(counts[i], counts[j])
                lighter = contents[j].items - Counter(give) + Counter(take)
                fuller = contents[i].items - Counter(take) + Counter(give)
                for items, count in ((contents[i].items, -times), (contents[j].items, -times), (fuller, times), (lighter, times)):
                    add(items, count)
                n -= 0 if lighter else times
                going = True
    return [Group(counts[i], c.items) for i, c in enumerate(contents) if counts[i]]


def plan(histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Segments of ranks, sorted by (length, first rank): where the pieces of a length go, in order of rank."""
    groups = local_search(best_fit(histogram, capacity), capacity)
    used: Counter = Counter()
    rows, base = [], 0
    for g in groups:
        offset = 0
        for s in sorted(g.items, reverse=True):
            m = g.items[s]
            rows.append((s << _RANK_BITS | used[s], used[s], base, m, offset, s))
            used[s] += m * g.count
            offset += s * m
        base += g.count
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    return dict(zip(("key", "first", "base", "each", "offset", "size"), table.T, strict=True)) | {"bins": np.array([base])}


def _pieces(sent, capacity: int, end_id: int, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, task = encoder(sent, remembered), Counter(), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc, piece, start, length, crc, rank = [], [], [], [], [], []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.batch(batch.column(1).to_pylist()), strict=True):
                data = memoryview(ids.tobytes() + end)
                n = len(ids) + 1
                at, k, size = 0, 0, n % capacity or capacity
                while at < n:
                    doc.append(doc_id), piece.append(k), start.append(at), length.append(size)
                    crc.append(zlib.crc32(data[4 * at : 4 * (at + size)]))
                    rank.append(seen[size])
                    seen[size] += 1
                    at, k, size = at + size, k + 1, capacity
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([task] * len(doc), pa.int32()), pa.array(rank, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])
        tidy()

    return run


def _place(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for batch in batches:
            size, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(p["key"], (size << _RANK_BITS) | rank, "right") - 1
            nth = rank - p["first"][at]
            sequence = p["base"][at] + nth // p["each"][at]
            offset = p["offset"][at] + nth % p["each"][at] * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", remembered: int = MEMO) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = documents.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(file_bytes(tokenizer_path))
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = written(docs.mapInArrow(_pieces(sent, capacity, end_id, remembered), schema + ", task int, rank long"), "pack-pieces")
    counts = written(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = spark.sparkContext.broadcast(plan(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = written(counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("before")), "pack-starts")
    ranked = pieces.join(starts, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(_place(placed), schema + ", sequence_id long, offset long")
