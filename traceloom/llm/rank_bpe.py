"""Byte-level BPE over merge ranks, with a hierarchical bitmap as the queue of merges.

Pre-tokens are linked lists of their bytes; many distinct ones share one list, with gaps between them that nothing is
joined with, and one queue, so that its costs are shared, too. Every adjacent pair whose joined bytes have a rank lies,
by its left position, in the bucket of that rank; a bitmap over ranks, itself summarised by a bitmap over its words,
gives the least rank that has a bucket by two find-first-set operations. A bucket yields its positions from left to
right, until a merge gives a lower rank, and entries that a later merge made stale are skipped. A merge thus costs a
constant plus the bucket's heap, whatever the pre-token's length, so pre-tokens of megabytes are encoded in near-linear
time. Pre-tokens do not meet, so that each is merged as it would be alone.

Defined results: a null or empty text has no tokens; any valid text decodes to its own UTF-8 bytes; repeated rows
are encoded alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from typing import AnyStr

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .tokens import MEMO_CHARS, PATTERN, PLAIN, Memo, PieceEncoder, file_bytes

#: Bits in one word of the lower bitmap.
WORD = 256
#: Pre-tokens that a worker remembers at most, and half as many pieces.
MEMO = 800_000
#: Length of the pre-tokens that share one queue, and of the pieces that are cut together; a longer one ends its run.
RUN = 1 << 16


def runs(texts: Iterable[AnyStr]) -> Iterator[list[AnyStr]]:
    """``texts`` in lists of ``RUN`` characters or bytes."""
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size >= RUN:
            yield some
            some, size = [], 0
    if some:
        yield some


class RankQueue:
    """Heaps of positions by rank; ``pop`` gives the least rank and, within it, the least position."""

    __slots__ = ("_top", "_words", "buckets")

    def __init__(self):
        self._top, self._words, self.buckets = 0, {}, {}

    def put(self, rank: int, positions: list[int]) -> None:
        """A bucket of ascending positions for a rank that has none."""
        self.buckets[rank] = positions
        word, bit = divmod(rank, WORD)
        self._words[word] = self._words.get(word, 0) | 1 << bit
        self._top |= 1 << word

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
        else:
            self.put(rank, [position])

    def least(self) -> int | None:
        """The least rank that has a bucket."""
        top = self._top
        if not top:
            return None
        word = (top & -top).bit_length() - 1
        bits = self._words[word]
        return word * WORD + (bits & -bits).bit_length() - 1

    def remove(self, rank: int) -> None:
        """Forget the bucket of a rank."""
        del self.buckets[rank]
        word, bit = divmod(rank, WORD)
        self._words[word] ^= 1 << bit
        if not self._words[word]:
            self._top ^= 1 << word

    def pop(self) -> tuple[int, int] | None:
        if (rank := self.least()) is None:
            return None
        position = heappop(self.buckets[rank])
        if not self.buckets[rank]:
            self.remove(rank)
        return rank, position


class RankEncoder(PieceEncoder):
    """Encodes and decodes texts by ``ranks`` (bytes -> id) and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = MEMO):
        import regex

        super().__init__(remembered // 2)
        # White space by its Unicode property, whatever the library's own \s holds.
        self._cut = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self._by_pieces = pattern == PATTERN and b"\n" in ranks
        self._ranks = ranks
        self._bytes = {i: b for b, i in ranks.items()}
        self._words = Memo(remembered)
        #: Bytes without a rank may still be parts of tokens; they get ids beyond the ranks.
        self._end = max(ranks.values(), default=-1) + 1
        parts = ranks | {b: self._end + k for k, b in enumerate(b for b in map(bytes, zip(range(256))) if b not in ranks)}
        #: An id that no token has: it stands between pre-tokens.
        self._gap = max(parts.values()) + 1
        #: Rank of two joined tokens, by left * (gap + 1) + right, and for two bytes (none: -1).
        self._pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                if (left := parts.get(token[:at])) is not None and (right := parts.get(token[at:])) is not None:
                    self._pairs[left * (self._gap + 1) + right] = rank
        self._byte = np.array([parts[bytes([b])] for b in range(256)])
        self._two = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])
        self._newline = array("I", [ranks[b"\n"]]).tobytes() if b"\n" in ranks else b""

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        if (whole := self._ranks.get(piece)) is not None:
            return [whole]
        return np.frombuffer(self.merge_all([piece])[0], "<u4").tolist()

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token. Their bytes are one linked list, with a gap after each, and share one queue."""
        data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        gaps = np.cumsum(np.array(list(map(len, pieces))) + 1) - 1
        pairs = self._two[data[:-1].astype(np.int64) << 8 | data[1:]]
        pairs = np.append(pairs, -1)
        pairs[gaps] = pairs[gaps - 1] = -1
        ids = self._byte[data]
        ids[gaps] = self._gap
        queue = RankQueue()
        some = np.flatnonzero(pairs >= 0)
        some = some[np.argsort(pairs[some], kind="stable")]
        ranks, starts = np.unique(pairs[some], return_index=True)
        for rank, bucket in zip(ranks.tolist(), np.split(some, starts[1:])):
            queue.put(rank, bucket.tolist())
        self._merge(queue, token := ids.tolist(), pairs.tolist())
        ids = np.array(token)
        ids = ids[ids >= 0]
        if ((ids >= self._end) & (ids < self._gap)).any():
            raise KeyError("a byte without a rank is no token")
        cuts = (4 * np.flatnonzero(ids == self._gap)).tolist()
        out = ids.astype("<u4").tobytes()
        return [out[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], cuts)]

    def _merge(self, queue: RankQueue, token: list[int], pair: list[int]) -> None:
        """Merges by least rank, then position, in place.

        ``token``: the id of the token that starts at each position (-1 inside of tokens), ``pair``: the rank of that
        token joined with the next one (none: -1).
        """
        n, step, get, buckets, push = len(token), self._gap + 1, self._pairs.get, queue.buckets, queue.push
        at = list(range(n + 1))
        after, before = at[1:], [n - 1, *at[: n - 1]]  # the gap at the end is also before the first
        while (r := queue.least()) is not None:
            bucket, low = buckets[r], r
            while bucket:
                i = heappop(bucket)
                if pair[i] != r:
                    continue  # stale
                j, p = after[i], before[i]
                k = after[j]
                token[i], token[j], pair[j] = r, -1, -1
                after[i], before[k] = k, i
                pair[i] = new = get(r * step + token[k], -1)
                if new >= 0:
                    if there := buckets.get(new):
                        heappush(there, i)
                    else:
                        push(new, i)
                    if new < low:
                        low = new
                pair[p] = new = get(token[p] * step + r, -1)
                if new >= 0:
                    if there := buckets.get(new):
                        heappush(there, p)
                    else:
                        push(new, p)
                    if new < low:
                        low = new
                if low < r:
                    break  # it goes first
            else:
                queue.remove(r)

    def _known(self, words: list[str]) -> dict[str, bytes]:
        """The ids of pre-tokens by their text, remembered or merged now."""
        known = dict(zip(distinct := list(set(words)), self._words.recall(distinct), strict=True))
        new = {w.encode(): w for w in distinct if known[w] is None}
        known.update((w, array("I", [self._ranks[data]]).tobytes()) for data, w in new.items() if data in self._ranks)
        for run in runs(data for data in new if data not in self._ranks):
            known.update(zip(map(new.__getitem__, run), self.merge_all(run), strict=True))
        self._words.young.update((w, known[w]) for w in new.values() if len(w) <= MEMO_CHARS)
        return known

    def _joined(self, words: list[str]) -> bytes:
        """The ids of pre-tokens in a row."""
        return b"".join(map(self._known(words).__getitem__, words))

    def _lines(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces without white space but a first blank; they are cut as lines of one text."""
        out: list[bytes] = []
        for run in runs(pieces):
            words = self._cut.findall("\n".join(run))
            ids = list(map(self._known(words).__getitem__, words))
            ends = [*(k for k, w in enumerate(words) if w == "\n"), len(words)]
            out += [b"".join(ids[a:b]) for a, b in zip([0, *(e + 1 for e in ends)], ends)]
        return out

    def _encoded(self, pieces: list[str], lead: str) -> Iterator[tuple[str, bytes]]:
        plain = list(filter(PLAIN, pieces))
        words, lines = [p for p in plain if p[0] != "\n"], [p for p in plain if p[0] == "\n"]
        yield from zip(words, self._lines([lead + p for p in words]), strict=True)
        yield from zip(lines, [self._newline + x for x in self._lines([p[1:] for p in lines])], strict=True)
        for p in set(pieces).difference(plain):
            yield p, self._joined(self._cut.findall(p if p[0] == "\n" else lead + p))

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text (null: empty)."""
        if self._by_pieces:
            return super().batch(texts)
        return [np.frombuffer(self._joined(self._cut.findall(text or "")), "<u4") for text in texts]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids.tolist()))


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


_encoders: dict[int, RankEncoder] = {}


def _encoder(data: bytes, pattern: str) -> RankEncoder:
    key = hash((data, pattern))
    if key not in _encoders:
        _encoders.clear()
        gc.disable()  # as in ``tokens.encoder``
        _encoders[key] = RankEncoder(read_ranks(data), pattern)
    return _encoders[key]


def _round_trip(sent, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(sent.value, pattern)
        for batch in batches:
            got = enc.batch(batch.column(1).to_pylist())
            columns = [
                batch.column(0),
                pa.array([len(i) for i in got], pa.int64()),
                pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in got], pa.string()),
                pa.array([hashlib.sha256(enc.decode(i)).hexdigest() for i in got], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(sent, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(sent.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.astype(np.int32) for i in enc.batch(batch.column(1).to_pylist())], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _prepared(documents: DataFrame, ranks_path: str, doc_id: str, text: str):
    spark = documents.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(file_bytes(ranks_path))
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), sent


def encode(documents: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and its ids."""
    docs, sent = _prepared(documents, ranks_path, doc_id, text)
    return docs.mapInArrow(_ids(sent, pattern), "doc_id long, ids array<int>")


def round_trip(documents: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, and the SHA-256 of its ids and of the bytes they decode to."""
    docs, sent = _prepared(documents, ranks_path, doc_id, text)
    return docs.mapInArrow(_round_trip(sent, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
