"""Spelling variants: words one edit apart, found by Aho-Corasick automata over word halves.

1. Tasks count words of whole texts; partial counts meet by word.
2. Every word has two segments, its first and its last half. One inserted, deleted or replaced code point leaves a
   half of the one word whole, at the beginning or at the end of the other.
3. The segments are dealt to automaton shards of bounded size by the end of the word that they hold (its first or last
   three code points), and every word is scanned in the shards that can hold a half of a near word: those of its own
   ends. Ends that many words share are split: their segments go to several shards, and their words are scanned in
   each. A match counts where its offset (at the beginning, or up to the end) and the lengths of both words allow one
   edit; words under a segment are looked up by the halves of what is left, and the distance is verified.
4. A scan yields counts and the best form, never pairs; partial results meet by word. Forms have ten times the
   occurrences, so chains of forms are short, and roots come from pointer doubling.

Defined results: null and empty texts have no words; a null ``doc_id`` reads as an empty one; repeated rows count one by
one; forms of equal counts are decided by code-point order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, release, sized, small_batches, tidy, written

#: Distinct words that a counting task holds, and the segments of one automaton (at least, at most).
HELD_WORDS, LEAST_SHARD, MOST_SHARD = 400_000, 2_000, 50_000
#: Code points of the ends that segments are dealt by; no segment is shorter, as words have seven at least.
END = 3
#: Rows of a broadcast list of hot ends.
HOT_ENDS = 100_000


def _counts(shortest: int, thinning: int):
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % shortest).findall

    def flush(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                lowered = text.lower() if text.isascii() else text.encode().lower().decode()  # bytes: A to Z only
                begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(runs(lowered)).items():
                    h = zlib.crc32(word.encode(), begun)
                    if h % thinning == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    counts[word] += n
                if len(counts) > HELD_WORDS:
                    yield flush(counts)
                    counts.clear()
        if counts:
            yield flush(counts)
        tidy()

    return run


def word_counts(documents: DataFrame, shortest: int = 7, least: int = 2, thinning: int = 31, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters with at least ``least`` occurrences; a code point of every run whose hash with the
    document ``thinning`` divides is deleted first."""
    small_batches(documents.sparkSession)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(_counts(shortest, thinning), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def one_edit(a: str, b: str, same: int = 0) -> bool:
    """Whether one inserted, deleted or replaced code point leads from ``a`` to ``b``; the first ``same`` are known to agree."""
    if len(a) > len(b):
        a, b = b, a
    for i in range(same, len(a)):
        if a[i] != b[i]:
            return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]
    return len(b) == len(a) + 1


class Under:
    """Words of one length that share a segment, by the halves of the rest of each."""

    def __init__(self, rest: int):
        self.head, self.tail = rest // 2, rest - rest // 2
        self.heads: dict[str, list[tuple[str, str, int]]] = {}
        self.tails: dict[str, list[tuple[str, str, int]]] = {}

    def add(self, word: str, rest: str, n: int) -> None:
        self.heads.setdefault(rest[: self.head], []).append((word, rest, n))
        self.tails.setdefault(rest[self.head :], []).append((word, rest, n))

    def near(self, rest: str) -> Iterator[tuple[str, int]]:
        head = rest[: self.head]
        for word, other, n in self.heads.get(head, ()):
            if other != rest and one_edit(other, rest, self.head):
                yield word, n
        for word, other, n in self.tails.get(rest[-self.tail :], ()):
            if other[: self.head] != head and one_edit(other, rest):
                yield word, n


class Shard:
    """An automaton over segments; what it finds at ends is verified."""

    FIRST, LAST = 0, 1

    def __init__(self):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        self._open = True

    def add(self, role: int, word: str, n: int) -> None:
        half = len(word) // 2
        segment, rest = (word[:half], word[half:]) if role == self.FIRST else (word[half:], word[:half])
        _, ends = self._entry(segment)
        if len(word) not in ends[role]:
            ends[role][len(word)] = Under(len(rest))
        ends[role][len(word)].add(word, rest, n)

    def _entry(self, segment: str):
        entry = self._automaton.get(segment, None)
        if entry is None:
            entry = (len(segment), ({}, {}))
            self._automaton.add_word(segment, entry)
        return entry

    def near(self, role: int, word: str) -> Iterator[tuple[str, int]]:
        """The near words that share the half of ``role`` with ``word``; those that share their first half are not found by their last."""
        if self._open:
            self._automaton.make_automaton()
            self._open = False
        if not len(self._automaton):
            return
        size = len(word)
        for end, (length, ends) in self._automaton.iter(word):
            if not ends[role] or (end != length - 1 if role == self.FIRST else end != size - 1):
                continue
            rest = word[length:] if role == self.FIRST else word[: size - length]
            for other in (size - 1, size, size + 1):
                under = ends[role].get(other)
                if under is None:
                    continue
                for found, n in under.near(rest):
                    if role == self.FIRST or found[: other // 2] != word[: other // 2]:
                        yield found, n


def _scan():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            words, counts, best_n, best = [], [], [], []
            for number, scanned, role, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != at:
                    at, shard = number, Shard()
                if not scanned:
                    shard.add(role, word, n)
                    continue
                found = list(shard.near(role, word))
                if found:
                    top = min((-k, w) for w, k in found)
                    words.append(word), counts.append(len(found)), best_n.append(-top[0]), best.append(top[1])
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(counts, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best)], ["word", "n_near", "best_n", "best"])
        tidy()

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words of ``words`` (word, n), all distinct and of seven code points at least,
    that have near words among them; ``best`` is the near word of largest n, by code points among equals."""
    spark = words.sparkSession
    small_batches(spark)
    segments = 2 * words.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = min(MOST_SHARD, max(LEAST_SHARD, segments // (2 * parts)))
    shards = max(1, math.ceil(segments / limit))
    ends = F.array(*[F.struct(F.lit(role).alias("role"), end.alias("end")) for role, end in ((Shard.FIRST, F.left("word", F.lit(END))), (Shard.LAST, F.right("word", F.lit(END))))])
    both = words.select("word", "n", F.inline(ends))
    load = both.groupBy("role", "end").agg(F.ceil(F.count("*") / limit).cast("int").alias("split"))
    hot = sized(load.where("split > 1"), HOT_ENDS)
    dealt = both.join(hot, ["role", "end"], "left").withColumn("split", F.coalesce("split", F.lit(1)))
    shard = lambda salt: F.pmod(F.xxhash64("role", "end", salt.cast("int")), F.lit(shards)).cast("int")
    held = dealt.select(shard(F.pmod(F.xxhash64("word"), F.col("split"))).alias("shard"), F.lit(False).alias("scanned"), "role", "word", "n")
    visits = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("split") - 1), shard))  # two parts of an end may lie in one shard
    scans = dealt.select(F.explode(visits).alias("shard"), F.lit(True).alias("scanned"), "role", "word", "n")
    found = held.union(scans).repartition("shard").sortWithinPartitions("shard", "scanned").mapInArrow(_scan(), "word string, n_near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("k"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select("word", "n_near", (-F.col("top.k")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of forms from each word of ``forms`` (word, form) ends. No chain may run in circles."""
    cur = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = cur.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = written(cur.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(cur)
        moved = not ahead.where("moved").isEmpty()
        cur = ahead
        if not moved:
            return cur.select("word", "root")


def variant_groups(documents: DataFrame, times: int = 10, doc_id: str = "doc_id", text: str = "text", **counting: int) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n. A form is the most frequent near word, if it has at least
    ``times`` the occurrences; ``root`` is the end of the chain of forms."""
    words = written(word_counts(documents, doc_id=doc_id, text=text, **counting), "spelling-words")
    release(words.sparkSession)
    near = written(near_words(words), "spelling-near")
    release(words.sparkSession)
    is_form = F.col("best_n") >= times * F.col("n")
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    judged = written(joined, "spelling-forms")
    discard(near)
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
