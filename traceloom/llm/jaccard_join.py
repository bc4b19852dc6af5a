"""N-gram Jaccard join: the size-aware heavy-light join over sets of word n-grams, exact.

Documents with equal sets form one class, and only classes are joined. A class is light if its set has at most
``boundary`` elements, else heavy:

* two light sets that link share a subset of a fixed size, which their sizes determine: each light set enumerates its
  subsets of those sizes and equal subsets meet;
* any link with a heavy set is found by scanning inverted lists: each set enters the lists of its first
  ``n - ceil(t n) + 1`` elements in one global order, and linked sets share at least one of them.

The boundary is the largest size up to which enumerating costs no more than scanning lists of the average length over
all documents: shingles of all classes by distinct shingles, which a HyperLogLog sketch counts. The global order puts
shingles that are frequent in some stretch of documents last, the more frequent the later, then longer shingles first.
Any total order gives whole results; this one keeps lists short. Lists and subsets are buckets for
``linkage.link_components``; exact Jaccard similarity decides.

Defined results: a null or wordless text has an empty set and links with nothing; rows with a null ``doc_id`` take part
and are returned with their set size and a null component; rows that repeat a ``doc_id`` each count; equal sets are
linked, whatever their number; a text of any length is one set; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import discard, private, release, sized, small_batches, tidy, written
from .linkage import BITS, SKETCH, WORDS, least_difference, link_components, wide_bits, xor_bits

#: Most shingles that the global order treats as frequent: 16 bytes each when sent to the executors.
FREQUENT = 1 << 16
#: Shingles are counted in stretches of this many; one seen at least so often in a stretch counts as frequent there.
STRETCH, OFTEN = 1 << 20, 8
#: Up to so many keys or pairs of numbers (8 to 24 bytes each) are sent to the executors; more are joined by a shuffle.
FEW_IDS = 200_000
#: Registers of the count of distinct shingles: a standard error of 1.6 %.
REGISTERS = 1 << 12


def overlap(n: int, m: int, percent: int) -> int:
    """Least intersection of sets of n and m elements with a Jaccard similarity of ``percent`` / 100."""
    return -(-percent * (n + m) // (100 + percent))


def subset_sizes(n: int, percent: int) -> list[int]:
    """Sizes of the subsets that a set of n elements shares with the sets it can link with."""
    sizes = {overlap(n, m, percent) for m in range(-(-percent * n // 100), 100 * n // percent + 1) if m > 0}
    return sorted(c for c in sizes if 0 < c <= n)


def prefix_length(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1


def light_boundary(mean_list: float, percent: int) -> int:
    """The largest size up to which no set has more subsets to enumerate than rows to scan."""
    n = 1
    while sum(math.comb(n, c) for c in subset_sizes(n, percent)) <= prefix_length(n, percent) * (1 + mean_list):
        n += 1
    return n - 1


def distinct_count(registers: np.ndarray) -> float:
    """What a HyperLogLog sketch of ``REGISTERS`` registers estimates."""
    m = REGISTERS
    raw = 0.7213 / (1 + 1.079 / m) * m * m / np.sum(np.exp2(-registers.astype(float)))
    empty = int((registers == 0).sum())
    return m * math.log(m / empty) if raw <= 2.5 * m and empty else float(raw)


_SURVEY = f"kind int, row long, doc_id long, n long, cls long, {SKETCH}, wide binary"
#: Sets of more elements get a wide sketch, too: over so many the short one, of 512 bits, tells unlike sets apart.
LONG = 1000


def _survey(k: int):
    """(row, doc_id, n, cls, sketch) of each document; then rows of what is counted: kind 1 a frequent shingle, 2 a register."""

    def counted(kind: int, n: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(n), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), none, none, pa.array(n), pa.array(cls), *[none] * WORDS, pa.nulls(len(n), pa.binary())], names)

    names = ["kind", "row", "doc_id", "n", "cls", *BITS, "wide"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        registers = np.zeros(REGISTERS, np.int64)

        def stretch() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            np.maximum.at(registers, (values % REGISTERS).astype(np.int64), 53 - np.frexp((values >> np.uint64(12)).astype(float))[1])
            often = counts >= OFTEN
            return counted(1, counts[often], values[often].view(np.int64))

        for batch in batches:
            ns, cls, bits, wide = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles.shingle_set(text, k)
                ns.append(len(s))
                cls.append(shingles.digest(s) if len(s) else None)
                bits.append(xor_bits(s))
                wide.append(wide_bits(s) if len(s) > LONG else None)
                held.append(s)
                size += len(s)
            if ns:
                bits = np.array(bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ns), np.int32)), batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(cls, pa.int64()), *(pa.array(bits[:, w]) for w in range(WORDS)), pa.array(wide, pa.binary())], names)
            if size >= STRETCH:
                yield stretch()
                held, size = [], 0
        if size:
            yield stretch()
        used = np.flatnonzero(registers)
        yield counted(2, registers[used], used)
        tidy()

    return run


def _keys(h: np.ndarray, length: np.ndarray, frequent: np.ndarray, rank: np.ndarray, boundary: int, percent: int) -> np.ndarray:
    n = len(h)
    out = []
    if n <= boundary:
        mixed = shingles.mix(h)
        for c in subset_sizes(n, percent):
            total = mixed.sum(dtype=np.uint64)
            gone = [total - mixed[list(x)].sum(dtype=np.uint64) for x in combinations(range(n), n - c)]
            out.append(shingles.mix(np.array(gone, np.uint64) * np.uint64(2) + np.uint64(c)))
    if 100 * n // percent > boundary:
        score = (65535 - np.minimum(length, 65535)).astype(np.int64)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
            score += np.where(frequent[at] == h, rank[at] << 16, 0)
        first = np.argsort(score, kind="stable")[: prefix_length(n, percent)]
        out.append(shingles.mix(h[first] ^ np.uint64(0x5851F42D4C957F2D)))
    return np.unique(np.concatenate(out))


def _postings(k: int, percent: int, boundary: int, frequent_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = frequent_b.value
        seen: set[int] = set()
        for batch in batches:
            keys, ids, ns = [], [], []
            for text in batch.column(0).to_pylist():
                h, length = shingles.shingle_set(text, k, with_length=True)
                if not len(h):
                    continue
                cls = shingles.digest(h)
                if cls in seen:
                    continue
                if len(seen) >= 1 << 18:
                    seen.clear()  # only spares repeated rows
                seen.add(cls)
                got = _keys(h, length, frequent, rank, boundary, percent)
                keys.append(got.view(np.int64))
                ids.append(np.full(len(got), cls, np.int64))
                ns.append(np.full(len(got), len(h), np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, ids, ns)], ["key", "id", "n"])
        seen.clear()
        tidy()

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shingles.shingle_set(t, k).view(np.int64) for t in batch.column(1).to_pylist()]
            grams = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(s) for s in got])]).astype(np.int32), np.concatenate(got) if got else np.empty(0, np.int64))
            sizes, wide = pa.array([len(s) for s in got], pa.int64()), pa.array([wide_bits(s.view(np.uint64)) for s in got], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, wide, grams], ["id", "n", "wide", "grams"])
        tidy()

    return run


def _near_enough(percent: int):
    """Over rows (a, b, n_a, wide_a, n_b, wide_b): the (a, b) whose sketches leave a link possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[2:]]
            # A link's sets differ in at most (100 - percent) / (100 + percent) of the sum of their sizes.
            keep = [(100 + percent) * least_difference(x, y) <= (100 - percent) * (n + m) for n, x, m, y in zip(*columns, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        tidy()

    return run


def rule_out(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` that sketches ``wide`` of a bit or two per element in ``sets`` (id, n, wide) do not rule out.

    The short sketches of ``linkage`` tell long sets nothing; whole sets meet only for what these leave.
    """
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("wide").alias(f"wide_{end}")), end)
    named = pairs.select("a", "b", "n_a", "wide_a", "n_b", "wide_b")
    return named.mapInArrow(_near_enough(percent), "a long, b long").distinct()


#: Copies of one set of shingles that a much compared class may get, so that no task verifies all its pairs.
SALTS = 1024


def verify_sets(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose arrays ``grams`` in ``sets`` (id, grams) link, compared as whole numbers.

    Pairs that name a class a meet its set by salts, and ``pairs`` holds few of each b: ``linkage`` asks for one first.
    """
    salted = written(pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS))), "join-salted")
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")).join(sized(salted.select("a", "salt").distinct(), FEW_IDS), "a")
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")).join(sized(salted, FEW_IDS), "b")
    both = right.join(left, ["a", "salt"])
    shared = F.size(F.array_intersect("ga", "gb")).cast("long")
    return both.select("a", "b", shared.alias("i"), (F.size("ga") + F.size("gb")).alias("s")).where(f"{100 + percent} * i >= {percent} * s").select("a", "b")


def _classes(documents: DataFrame, k: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Written (row, doc_id, n, cls, comp) of each document; ``row`` hashes id and text; comp and cls null: an empty set."""
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).select(row_key("doc_id", "text").alias("row"), "doc_id", "text")
    surveyed = written(docs.mapInArrow(_survey(k), _SURVEY), "join-survey")
    info = surveyed.where("kind = 0 AND cls IS NOT NULL")
    first = written(info.groupBy("cls").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("wide").alias("wide"), *[F.first(b).alias(b) for b in BITS]), "join-first")
    often = surveyed.where("kind = 1").groupBy("cls").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "cls").limit(FREQUENT).collect()
    frequent = np.array([r["cls"] for r in often], np.int64).view(np.uint64)
    order = np.argsort(frequent)
    counts = np.array([r["n"] for r in often], np.int64)
    sent = spark.sparkContext.broadcast((frequent[order], np.minimum(counts, 1 << 40)[order]))
    registers = np.zeros(REGISTERS, np.int64)
    for r in surveyed.where("kind = 2").groupBy("cls").agg(F.max("n").alias("n")).collect():
        registers[r["cls"]] = r["n"]
    total = first.agg(F.sum("n")).first()[0] or 0
    boundary = light_boundary(total / max(distinct_count(registers), 1.0), percent)

    postings = written(docs.select("text").mapInArrow(_postings(k, percent, boundary, sent), "key long, id long, n long"), "join-postings")

    def verify(pairs: DataFrame) -> DataFrame:
        """Sets are made again from the texts, but only of the classes that a pair names."""
        needed = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(first.select("cls", "row"), "cls")
        texts = docs.join(sized(written(needed, "join-needed"), FEW_IDS), "row").select("cls", "text")
        # A repeated row only repeats a pair.
        sets = written(texts.mapInArrow(_sets(k), "id long, n long, wide binary, grams array<long>"), "join-sets")
        near = written(rule_out(pairs, sets, percent), "join-near")
        linked = written(verify_sets(near, sets, percent), "join-linked")
        discard(sets)
        return linked

    # The prefixes of two sets share at least this many elements, if neither is light and they link.
    lack = f"ceil({percent} * (a_n + b_n) / {100 + percent})"
    spare = [f"({x}_n - ceil({percent} * {x}_n / 100) + 1 - ({x}_n - {lack}))" for x in "ab"]
    enough = f"least(a_n, b_n) <= {boundary} OR common >= least({spare[0]}, {spare[1]})"
    sketches = first.select(F.col("cls").alias("id"), "n", *BITS)
    wide = first.where("wide IS NOT NULL").select(F.col("cls").alias("id"), "wide")
    comp = link_components(postings, sketches, verify, percent / 100, sized_sets=True, enough=enough, wide=wide)
    discard(postings)
    labelled = surveyed.where("kind = 0").select("row", "doc_id", "n", "cls").join(comp.select(F.col("id").alias("cls"), "comp"), "cls", "left")
    # Rows without a class need none of the joins; a class that links with no other is a component by itself.
    return written(labelled.select("row", "doc_id", "n", "cls", F.when(F.col("cls").isNotNull(), F.coalesce("comp", F.xxhash64("cls"))).alias("comp")), "join-labelled")


def row_key(doc_id: str, text: str):
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


def jaccard_join(documents: DataFrame, k: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (first of its component, or linked with nothing)."""
    labelled = _classes(documents, k, percent, doc_id, text)
    least = written(labelled.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component_id")), "join-components")
    # Documents without a component get keys of their own, so that they do not meet in one task of the join.
    out = labelled.withColumn("comp", F.coalesce("comp", F.xxhash64("row", F.lit(1)))).join(least, "comp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_first(documents: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with one row of each component, all columns as they are, whatever their names.

    The row with the least ``doc_id`` stays; null ids come last, rows with one id go by a hash of their text, and of rows
    equal in both one stays. Documents without words stay.
    """
    labelled = _classes(documents, k, percent, doc_id, text).where("comp IS NOT NULL")
    best = labelled.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("m"), F.count("*").alias("n")).where("n > 1")
    best = written(best.select("comp", F.col("m.row").alias("stays")), "join-best")
    fate = written(labelled.join(best, "comp").groupBy("row", "stays").agg(F.count("*").alias("n")), "join-fate")
    (mark,) = private(documents, "row_key")
    gone = written(fate.where("row <> stays").select(F.col("row").alias(mark)).distinct(), "join-gone")
    again = written(fate.where("row = stays AND n > 1").select(F.col("row").alias(mark)).distinct(), "join-again")
    left = documents.withColumn(mark, row_key(doc_id, text)).join(sized(gone, FEW_IDS), mark, "left_anti")
    if not again.isEmpty():
        again = sized(again, FEW_IDS)
        left = left.join(again, mark, "left_anti").unionByName(left.join(again, mark, "left_semi").dropDuplicates([mark]))
    return left.select(*documents.columns)
