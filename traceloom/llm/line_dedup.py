"""Line dedup: fuzzy duplicates of lines by MinHash, one line kept per component.

1. Every non-blank line gets the set of its character shingles and a one-permutation MinHash signature, densified so
   that empty bins borrow from full ones. Lines are reduced to a 64-bit hash, so equal lines are one item from here on.
2. Bands of the signature bring lines together; ``linkage`` rules out pairs by a bitmap sketch of their shingles, which
   loses none, and the Jaccard similarity of the shingle sets of the texts, fetched only for pairs left, decides.
3. Distributed union-find joins linked lines; of each component the first line, by (doc_id, row, position), stays.

Blank lines are layout: they never count as duplicates and stay where any line of their document stays.

Defined results: a null text counts as empty; of rows equal in ``doc_id`` and text one keeps its lines and the others
lose all; rows with a null ``doc_id`` come first; lines shorter than a shingle are one shingle; a line of any length is
compared whole; an empty table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import private, scratch, sized, small_batches, tidy, written
from .linkage import BITS, FEW_KEYS, WORDS, link_components, meeting, xor_rows
from .shingles import mix, powers

_U = np.uint64
#: Characters in a shingle; bins of the signature; bands and the bins in each. Lines at a similarity of 0.8 share a band
#: with a probability of 0.991. Unrelated lines of one language are at 0.03 to 0.13, so that bands of fewer bins bring
#: together ever more of them the more lines there are.
WIDTH, BINS, BANDS, BAND = 5, 64, 12, 5
_RNG = np.random.Generator(np.random.PCG64(977))
_LOW = _RNG.integers(1, 2**63, 1 << 16, dtype=np.uint64)
_HIGH = _RNG.integers(1, 2**63, 1 << 5, dtype=np.uint64)
_BAND = _RNG.integers(2**62, 2**63, BAND, dtype=np.uint64) | _U(1)
#: For densification, the bin that each bin asks at each attempt.
_ASK = _RNG.integers(0, BINS, (256, BINS))
#: Code points of one piece of a text when signatures are made; a longer line is one piece.
PIECE = 1 << 20
#: Characters of the documents that are taken together: few enough for a processor's caches.
GROUP = 1 << 16
#: Bits of a shingle's hash that tell it from the others of its line, with the line's number (below PIECE) before them.
KEPT = 44
#: Where rows with a null id come in the order of documents.
NO_ID = -(1 << 63)


def _windows(code: np.ndarray) -> np.ndarray:
    """Hash of each WIDTH consecutive code points, by a rolling polynomial over random values of the characters."""
    out = []
    for at in range(0, max(len(code) - WIDTH + 1, 0), PIECE):
        part = code[at : at + PIECE + WIDTH - 1]
        value = _LOW[part & 0xFFFF]
        if int(part.max()) > 0xFFFF:
            value = value + _HIGH[part >> 16]
        power, inverse = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(value * power[: len(part)], out=total[1:])
        out.append(mix((total[WIDTH:] - total[:-WIDTH]) * inverse[: len(part) - WIDTH + 1]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _shingles(code: np.ndarray, start: np.ndarray, end: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of the lines [start, end) of ``code``, in order, and where each line's begin."""
    base = start[0]
    all_windows = _windows(code[base : end[-1]])
    n = np.maximum(end - start - WIDTH + 1, 1)
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - (start - base), n)
    short = np.flatnonzero(end - start < WIDTH)
    if not len(short):
        return all_windows[at], first
    h = all_windows[np.minimum(at, len(all_windows) - 1)] if len(all_windows) else np.zeros(len(at), np.uint64)
    h[first[short]] = mix(lines[short])  # a short line is one shingle
    return h, first


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of each line, densified: (lines, BINS)."""
    lines = len(first) - 1
    owner = np.repeat(np.arange(lines), np.diff(first))
    cell = owner * BINS + (h >> _U(58)).astype(np.int64)
    empty = _U(2**64 - 1)
    sig = np.full(lines * BINS, empty)
    np.minimum.at(sig, cell, h)
    sig = sig.reshape(lines, BINS)
    out = sig.copy()
    line, bin_ = np.nonzero(sig == empty)
    for ask in _ASK:
        if not len(line):
            return out
        got = sig[line, ask[bin_]]
        out[line, bin_] = got
        left = got == empty
        line, bin_ = line[left], bin_[left]
    for line, bin_ in zip(*np.nonzero(out == empty), strict=True):  # after 256 attempts hardly ever
        full = np.flatnonzero(sig[line] != empty)
        out[line, bin_] = sig[line, full[(full > bin_).argmax()]]
    return out


def line_hash(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each line."""
    from xxhash import xxh3_64_intdigest

    raw = code.tobytes()
    return np.array([xxh3_64_intdigest(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.uint64)


def _spans(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each non-blank line and its position among all lines."""
    cut = np.flatnonzero(code == 10)
    start, end = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(code)]])
    blank = np.concatenate([[0], np.cumsum(~((code == 32) | ((code >= 9) & (code <= 13))))])
    keep = np.flatnonzero(blank[end] > blank[start])
    return start[keep], end[keep], keep


def distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct elements of each line, ascending, of each hash its upper KEPT bits, and where each line's begin."""
    lines = len(first) - 1
    v = np.sort(np.repeat(np.arange(lines, dtype=np.uint64) << _U(KEPT), np.diff(first)) | h >> _U(64 - KEPT))
    v = v[np.append(True, v[1:] != v[:-1])]
    return v << _U(64 - KEPT), np.append(np.searchsorted(v, np.arange(lines, dtype=np.uint64) << _U(KEPT)), len(v))


def _groups(docs: list, rows: list, texts: list) -> Iterator[tuple[list, list, list]]:
    """Stretches of documents of about GROUP characters."""
    at = size = 0
    for upto, text in enumerate(texts):
        size += len(text or "")
        if size >= GROUP or upto == len(texts) - 1:
            yield docs[at : upto + 1], rows[at : upto + 1], [t or "" for t in texts[at : upto + 1]]
            at, size = upto + 1, 0


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    names = ["row", "place", "line", "doc", "head", "bands", "n", *BITS]
    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], [], [], [], [], [], [], []]
        for docs, rows, texts in _groups(*(batch.column(k).to_pylist() for k in range(3))):
            code = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
            start, end, place = _spans(code)
            if not len(start):
                continue
            begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
            owner = np.searchsorted(begins, start, "right") - 1
            place = place - np.searchsorted(np.flatnonzero(code == 10), begins)[owner]
            lines = line_hash(code, start, end)
            out[0].append(np.array(rows, np.int64)[owner])
            out[1].append(place)
            out[2].append(lines.view(np.int64))
            out[3].append(np.array([NO_ID if d is None else d for d in docs], np.int64)[owner])
            out[4].append(np.append(True, owner[1:] != owner[:-1]))
            # Bands and sketch only for a line's first occurrence in this task, a stretch of lines at a time.
            new = [k for k, x in enumerate(lines.tolist()) if x not in seen and not seen.add(x)]
            if len(seen) > 1 << 19:
                seen.clear()
            bands = np.zeros((len(start), BANDS), np.uint64)
            bits, size_of = np.zeros((len(start), WORDS), np.int64), np.zeros(len(start), np.int64)
            held = np.zeros(len(start), bool)
            total = np.concatenate([[0], np.cumsum((end - start)[new])])
            at = 0
            while at < len(new):
                upto = max(at + 1, int(np.searchsorted(total, total[at] + PIECE, "right")) - 1)
                k = np.array(new[at:upto])
                h, first = distinct(*_shingles(code, start[k], end[k], lines[k]))
                sig = signatures(h, first)
                size_of[k] = np.diff(first)
                bits[k] = xor_rows(h >> _U(64 - KEPT), np.repeat(np.arange(len(k)), size_of[k]), len(k))
                bands[k] = mix((sig[:, : BANDS * BAND].reshape(-1, BANDS, BAND) * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                held[k] = True
                at = upto
            for x, y in zip(out[5:], (bands, held, size_of, bits), strict=True):
                x.append(y)
        if out[0]:
            bands, held, size_of, bits = map(np.concatenate, out[5:])
            offsets = np.concatenate([[0], np.cumsum(held * (8 * BANDS))]).astype(np.int32)
            keys = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(offsets), pa.py_buffer(bands[held].tobytes())])
            sketch = [pa.array(x, mask=~held) for x in (size_of, *bits.T)]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in out[:5]), keys, *sketch], names)
    seen.clear()
    tidy()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of the wanted places of each row."""
    for batch in batches:
        ids, texts = [], []
        for text, places, lines in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            parts = (text or "").split("\n")
            ids += lines
            texts += [parts[p] for p in places]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["id", "payload"])


#: Code points below NARROW are packed into 12 bits each, others into 21; a shingle of fewer than WIDTH has a mark.
NARROW, _MARK = 1 << 12, 60
_WIDE = np.dtype([("high", np.uint64), ("low", np.uint64)])


def _grams(text: str) -> np.ndarray:
    """The distinct shingles themselves, packed: sorted numbers, or pairs of numbers where a code point needs it."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    mark = max(WIDTH - len(code), 0)
    code = np.append(code, np.zeros(mark, np.uint64))
    n = len(code) - WIDTH + 1
    c = [code[i : i + n] for i in range(WIDTH)]
    mark = _U(mark << _MARK)
    if code.max() < NARROW:
        v = np.sort(mark | c[0] << _U(48) | c[1] << _U(36) | c[2] << _U(24) | c[3] << _U(12) | c[4])
        return v[np.append(True, v[1:] != v[:-1])]
    v = np.empty(n, _WIDE)
    v["high"], v["low"] = mark | c[0] << _U(21) | c[1], c[2] << _U(42) | c[3] << _U(21) | c[4]
    return np.unique(v)


def _widened(v: np.ndarray) -> np.ndarray:
    """Numbers of ``_grams`` as the pairs that it makes of the same shingles."""
    if v.dtype == _WIDE:
        return v
    c = [v >> _U(k) & _U(NARROW - 1) for k in (48, 36, 24, 12, 0)]
    out = np.empty(len(v), _WIDE)
    out["high"], out["low"] = v >> _U(_MARK) << _U(_MARK) | c[0] << _U(21) | c[1], c[2] << _U(42) | c[3] << _U(21) | c[4]
    return out


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Shingles that two results of ``_grams`` share."""
    if x.dtype != y.dtype:
        x, y = _widened(x), _widened(y)
    v = np.concatenate([x, y])
    v.sort()
    return int(np.count_nonzero(v[1:] == v[:-1]))


def jaccard(a: str, b: str) -> float:
    x, y = _grams(a), _grams(b)
    shared = _common(x, y)
    return shared / (len(x) + len(y) - shared)


def _near(threshold: float):
    def near(x: np.ndarray, y: np.ndarray) -> bool:
        if min(len(x), len(y)) < (threshold - 1e-12) * max(len(x), len(y)):
            return False
        shared = _common(x, y)
        return shared / (len(x) + len(y) - shared) >= threshold - 1e-12

    return near


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``distinct`` of texts without line breaks."""
    code = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.array([len(t) for t in texts])
    start = np.cumsum(np.append(0, size[:-1] + 1))
    return distinct(*_shingles(code, start, start + size, line_hash(code, start, start + size)))


def _linked(threshold: float):
    same = _near(threshold)

    def verdicts(left: list[str], right: list[str]) -> np.ndarray:
        """By counts of hashes; where a few collisions could decide, by the shingles themselves."""
        number = {t: k for k, t in enumerate(dict.fromkeys(left + right))}
        sets, first = _hashed(list(number))
        text = np.array([number[t] for t in left + right])
        size = np.diff(first)[text]
        pair = np.tile(np.arange(len(left), dtype=np.uint64), 2)
        at = np.arange(size.sum()) + np.repeat(first[text] - (np.cumsum(size) - size), size)
        v = np.sort(np.repeat(pair << _U(KEPT), size) | sets[at] >> _U(64 - KEPT))
        shared = np.bincount((v[1:][v[1:] == v[:-1]] >> _U(KEPT)).astype(np.int64), minlength=len(left))
        union = size[: len(left)] + size[len(left) :] - shared
        near = shared >= threshold * union
        for i in np.flatnonzero(np.abs(shared - threshold * union) <= 4):
            near[i] = same(_grams(left[i]), _grams(right[i]))
        return near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            near, at, size = [], 0, 0
            for upto, (x, y) in enumerate(zip(left, right, strict=True), 1):
                size += len(x) + len(y)
                if size >= 2 * GROUP or upto == len(left):
                    near.append(verdicts(left[at:upto], right[at:upto]))
                    at, size = upto, 0
            if near:
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(np.concatenate(near)))
        tidy()

    return run


#: Rows with their lines' places that are sent to all executors at most, and places in all; more are joined by a shuffle.
FEW_ROWS, FEW_PLACES = 200_000, 1_000_000


def few_places(lists: DataFrame, places: str) -> DataFrame:
    """``lists``, marked for broadcast if its rows and the places that they hold are counted to be few."""
    rows, held = lists.agg(F.count("*"), F.coalesce(F.sum(F.size(places)), F.lit(0))).first()
    return F.broadcast(lists) if rows <= FEW_ROWS and held <= FEW_PLACES else lists


def duplicate_lines(rows: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` (doc_id, row, text): (row, place, line, comp, first) of the lines that have duplicates; ``first``: it stays.

    And (row, n) of the rows with a line that are there n > 1 times.
    """
    small_batches(rows.sparkSession)
    sketch = "n long, " + ", ".join(f"{b} long" for b in BITS)
    signed = written(rows.select("doc_id", "row", "text").mapInArrow(_signed, f"row long, place long, line long, doc long, head boolean, bands binary, {sketch}"), "lines-signed", hashes=True)
    new = signed.where("n IS NOT NULL")
    members = meeting(new.select(F.col("bands").alias("keys"), F.col("line").alias("id"), "n"), BANDS, threshold)

    # One occurrence of each line that shares a band.
    met = members.select(F.col("id").alias("line")).union(members.where("other IS NOT NULL").select("other")).distinct()
    shared = sized(written(met, "lines-met", hashes=True), FEW_KEYS)
    places = written(new.select("line", "row", "place", "n", *BITS).join(shared, "line").dropDuplicates(["line"]), "lines-where", hashes=True)
    texts: list[DataFrame] = []

    def fetch(ids: DataFrame) -> None:
        """Write the text of one occurrence of each line: once for all that follows, as it takes a pass over the corpus."""
        spots = places.select("line", "row", "place").join(ids.select(F.col("id").alias("line")), "line")
        wanted = written(spots.groupBy("row").agg(F.collect_list(F.struct("place", "line")).alias("w")), "lines-wanted")
        found = rows.select("row", "text").join(few_places(wanted, "w"), "row").select("text", F.col("w.place").alias("p"), F.col("w.line").alias("l"))
        texts.append(written(found.mapInArrow(_texts, "id long, payload string"), "lines-texts"))

    def verify(pairs: DataFrame) -> DataFrame:
        (text,) = texts
        both = pairs.join(text.select(F.col("id").alias("a"), F.col("payload").alias("ta")), "a").join(text.select(F.col("id").alias("b"), F.col("payload").alias("tb")), "b")
        return written(both.select("a", "b", "ta", "tb").mapInArrow(_linked(threshold), "a long, b long"), "lines-linked")

    comp = link_components(members, places.select(F.col("line").alias("id"), "n", *BITS), verify, threshold, sized_sets=True, met=True, ready=fetch, exact=(lambda ids: texts[0].join(ids, "id"), _grams, _near(threshold)))
    # A line's order is that of its document, then of its row and place.
    lines = signed.select("row", "place", "line", "doc").join(sized(comp.select(F.col("id").alias("line"), "comp"), FEW_KEYS), "line", "left")
    lines = written(lines.withColumn("comp", F.coalesce("comp", F.xxhash64("line"))), "lines-labelled", hashes=True)
    # Fixed-width minima one after the other, so that partial sums stay hash aggregates.
    first = written(lines.groupBy("comp").agg(F.min("doc").alias("doc"), F.count("*").alias("n")).where("n > 1").select("comp", "doc"), "lines-first")
    rest = written(lines.join(sized(first.select("comp", F.col("doc").alias("first_doc")), FEW_KEYS), "comp"), "lines-repeated")
    inside = rest.where("doc = first_doc").groupBy("comp").agg(F.min("row").alias("first_row"))
    rest = written(rest.join(written(inside, "lines-first-row"), "comp"), "lines-repeated")
    place = rest.where("doc = first_doc AND row = first_row").groupBy("comp").agg(F.min("place").alias("first_place"))
    rest = rest.join(written(place, "lines-first-place"), "comp")
    stays = (F.col("doc") == F.col("first_doc")) & (F.col("row") == F.col("first_row")) & (F.col("place") == F.col("first_place"))
    again = signed.where("head").groupBy("row").agg(F.count("*").alias("n")).where("n > 1")
    return rest.select("row", "place", "line", "comp", stays.alias("first")), again


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, kept, total = [], [], []
        for text, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            parts = (text or "").split("\n")
            drop = set(gone or ())
            left = [p for i, p in enumerate(parts) if i not in drop]
            n = sum(1 for p in parts if p.strip(" \t\n\r\x0b\x0c"))
            texts.append("\n".join(left) if n > len(drop) else "")
            total.append(n)
            kept.append(n - len(drop))
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(kept, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "text", "n_lines", "n_kept"])


def _gone(documents: DataFrame, doc_id: str, text: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Written (row, gone), the places that a row loses, and (row, n) of the rows with a line that are there n > 1 times."""
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("row", row_key("doc_id", "text"))
    with scratch(documents.sparkSession) as keep:
        repeated, again = duplicate_lines(rows, threshold)
        gone = repeated.where("NOT first").groupBy("row").agg(F.collect_set("place").alias("gone"))
        return keep(written(gone, "lines-gone")), keep(written(again, "lines-again"))


def dedup_lines(documents: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, text, n_lines, n_kept): each document without the lines that repeat an earlier one.

    ``row`` is a hash of id and text, which ties the result to its source row.
    """
    gone, again = _gone(documents, doc_id, text, threshold)
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("row", row_key("doc_id", "text"))
    joined = rows.join(few_places(gone, "gone"), "row", "left").select("row", "doc_id", "text", "gone")
    out = joined.mapInArrow(_without, "row long, doc_id long, text string, n_lines long, n_kept long")
    if again.isEmpty():
        return out
    # Of equal rows one keeps its lines; the others are told by their number alone.
    first = out.join(sized(again, FEW_ROWS), "row").dropDuplicates(["row"]).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    own = F.col("nth") == 1
    first = first.select("row", "doc_id", F.when(own, F.col("text")).otherwise("").alias("text"), "n_lines", F.when(own, F.col("n_kept")).otherwise(0).alias("n_kept"))
    return out.join(sized(again, FEW_ROWS), "row", "left_anti").unionByName(first)


def row_key(doc_id: str, text: str):
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


def _cut(text_at: int, chars_at: int | None, gone_at: int, keep: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stays = [], []
            for text, gone in zip(batch.column(text_at).to_pylist(), batch.column(gone_at).to_pylist(), strict=True):
                if not gone:
                    texts.append(text)
                    stays.append(True)
                    continue
                drop = set(gone)
                left = [p for i, p in enumerate(text.split("\n")) if i not in drop]
                stays.append(any(p.strip(" \t\n\r\x0b\x0c") for p in left))
                texts.append("\n".join(left))
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, pa.string())
            if chars_at is not None:
                columns[chars_at] = pa.array([None if t is None else len(t) for t in texts], batch.column(chars_at).type)
            out = pa.RecordBatch.from_arrays([columns[k] for k in keep], [batch.schema.names[k] for k in keep])
            yield out.filter(pa.array(stays, pa.bool_()))

    return run


def drop_repeated_lines(documents: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``documents`` with the lines removed that repeat an earlier one, and ``n_chars`` counted anew.

    A document that loses all its lines goes, and so do all but one of rows that are equal in id and text; one that never
    had a non-blank line stays as it is.
    """
    gone, again = _gone(documents, doc_id, text, threshold)
    names = documents.columns
    mark, places = private(documents, "row_key", "gone")
    own = documents.withColumn(mark, row_key(doc_id, text))
    if not again.isEmpty():
        again = sized(again.select(F.col("row").alias(mark)), FEW_ROWS)
        # Of equal rows one stays; those without any line stay all, and are not among ``again``.
        once = own.join(again, mark, "left_semi").dropDuplicates([mark])
        own = own.join(again, mark, "left_anti").unionByName(once)
    lists = gone.select(F.col("row").alias(mark), F.col("gone").alias(places))
    joined = own.join(few_places(lists, places), mark, "left").select(*names, places)
    chars = names.index(n_chars) if n_chars in names else None
    return joined.mapInArrow(_cut(names.index(text), chars, len(names), list(range(len(names)))), documents.schema)
