"""BPE encoding and decoding through a table of distinct words.

1. Tasks normalise whole texts and split them into words. Documents are gathered in blocks of at most ``block_words``
   words (one longer document is a block of its own); a block numbers its distinct words, and a document becomes its
   words' numbers, in order of position. So a frequent word is one row per block, however hot it is.
2. The distinct words of all blocks are the word table: each is encoded once, by the library, without normalising or
   splitting again.
3. The ids come back by a join on the word. They travel packed by block to the block's documents, where the numbers at
   every position are replaced by ids.
4. Decoding: the distinct ids of a block are joined with the id-to-piece table (as many rows as the vocabulary has, so
   it is broadcast), and the pieces replace the ids at every position.

Blocks and tables are written to the shared folder; words, codes and shuffles are deleted as soon as they were used.

Defined results: a null or empty text has no ids and decodes to an empty text; repeated rows and repeated or null
``doc_id`` values are encoded one by one; an empty table gives no rows; other columns are ignored. Strings of special
tokens in a text become their ids, as the library does by default; ``specials=False`` makes them ordinary text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, new_folder, release, small_batches, tidy, written
from .tokens import file_bytes

#: Words of a block, words of one packed row of documents, and words packed at once on their way back.
BLOCK_WORDS, CHUNK_WORDS, PACK_WORDS = 6_000_000, 1 << 18, 1 << 20
#: The join of words with their ids shuffles one slice of the words at a time, so that no more is held on disk.
SLICES = 2

#: The normaliser and the pattern that the fast splitting below is written for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Characters on which Python's Unicode tables agree with the library's (a test compares all of them).
SETTLED = re.compile("[\\0-˿Ͱ-҂Ҋ-ԯḀ-῿ -₿℀-↋←-⏿─-➿　-〩〰-ゖ゛-ヿ一-鿯가-힣！-￮\U0001f300-\U0001f64f]*")


def _classes() -> tuple[str, str, str]:
    """Letters, numbers and white space as character classes."""
    runs: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in runs:
            if runs[kind] and runs[kind][-1][1] == c - 1:
                runs[kind][-1][1] = c
            else:
                runs[kind].append([c, c])
    text = lambda k: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs[k])
    return text("L"), text("N"), "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class Splitter:
    """``words(text)``: the words that the tokenizer's normaliser and pre-tokenizer make; a special token is " " and its string."""

    def __init__(self, data: bytes, specials: bool):
        from tokenizers import Tokenizer

        spec = json.loads(data)
        whole = Tokenizer.from_buffer(data)
        self._normalizer, self._split = whole.normalizer, whole.pre_tokenizer[0]
        stages = spec["pre_tokenizer"]["pretokenizers"]
        if [s["type"] for s in stages] != ["Split", "ByteLevel"] or stages[1]["use_regex"] or stages[1]["add_prefix_space"]:
            raise ValueError("a tokenizer that splits by a pattern and then maps bytes is needed")
        self._fast = spec["normalizer"] == NORMALIZER and stages[0]["pattern"] == {"Regex": PATTERN} and stages[0]["behavior"] == "Removed" and stages[0]["invert"]
        letters, numbers, blank = _classes()
        self._ascii = re.compile("'(?:[stmd]|re|ve|ll)|[a-z]+|[0-9]|[^a-z0-9\\t-\\r ]+").findall
        self._any = re.compile(f"'(?:[stmd]|re|ve|ll)|[{letters}]+|[{numbers}]|[^{blank}{letters}{numbers}]+").findall
        names = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True) if specials else []
        self._specials = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self._specials and self._specials.search(text):
            parts = self._specials.split(text)  # every other part is a special token
            return [w for i, p in enumerate(parts) for w in ([" " + p] if i % 2 else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if self._fast and text.isascii():
            return self._ascii(text.lower())
        if self._fast and SETTLED.fullmatch(text):
            # One character at a time, as the library does: Python alone has another sigma at a word's end.
            return self._any(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        return [w for w, _ in self._split.pre_tokenize_str(self._normalizer.normalize_str(text))]


class WordEncoder:
    """Ids of words that are normalised and split already."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        spec = json.loads(data)
        self._special = {" " + t["content"]: [t["id"]] for t in spec["added_tokens"]}
        self._tokenizer = Tokenizer.from_buffer(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None, "truncation": None, "padding": None}).encode())
        self._tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._tokenizer.encode_special_tokens = True

    def encode(self, words: list[str]) -> list[list[int]]:
        return [self._special.get(w) or e.ids for w, e in zip(words, self._tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True)]


_kept: dict[tuple, object] = {}


def _once(kind, sent, *args):
    """One splitter or encoder per worker and tokenizer file."""
    key = (kind, hash(sent.value), args)
    if key not in _kept:
        _kept.clear()
        _kept[key] = kind(sent.value, *args)
    return _kept[key]


def packed(x: np.ndarray) -> bytes:
    """Non-negative integers below 2**32 as compressed byte planes."""
    width = 1 + sum(int(x.max(initial=0)) >= 1 << s for s in (8, 16, 24))
    planes = x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes()
    return len(x).to_bytes(4, "little") + bytes([width]) + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:4], "little"), data[4]
    out = np.zeros((n, 4), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(data[5:], n * width, codec="zstd"), np.uint8).reshape(width, n).T
    return out.view("<u4").reshape(-1)


SPLIT_SCHEMA = "kind string, block long, no int, word string, docs array<long>, lengths binary, codes binary"


def _split(sent, specials: bool, block_words: int, chunk_words: int):
    schema = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("no", pa.int32()), ("word", pa.string()), ("docs", pa.list_(pa.int64())), ("lengths", pa.binary()), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, blocks = _once(Splitter, sent, specials).words, count(TaskContext.get().partitionId() << 32)
        numbers, in_block = defaultdict(count().__next__), 0
        docs: list[int | None] = []
        codes: list[np.ndarray] = []

        def whole_block() -> Iterator[pa.RecordBatch]:
            # Frequent words get the small numbers, which compress best.
            block, flat = next(blocks), np.concatenate(codes)
            order = np.argsort(-np.bincount(flat, minlength=len(numbers)), kind="stable")
            ranks = np.empty(len(order), np.int64)
            ranks[order] = np.arange(len(order))
            sizes = np.array([len(c) for c in codes])
            ends = np.cumsum(sizes + 1)  # every document counts one more, so that empty ones fill a chunk, too
            for own in np.split(np.arange(len(docs)), np.flatnonzero(np.diff(ends // chunk_words)) + 1):
                part = flat[ends[own[0]] - sizes[own[0]] - 1 - own[0] : ends[own[-1]] - 1 - own[-1]]
                row = {"kind": "docs", "block": block, "docs": docs[own[0] : own[-1] + 1], "lengths": packed(sizes[own]), "codes": packed(ranks[part])}
                yield pa.RecordBatch.from_pylist([row], schema)
            names = pa.array(numbers, pa.string()).take(pa.array(order)) if len(order) else pa.array([], pa.string())
            for a in range(0, len(names), 10_000):
                part = names[a : a + 10_000]
                n = len(part)
                none = [pa.nulls(n, f.type) for f in list(schema)[4:]]
                yield pa.RecordBatch.from_arrays([pa.array(["words"] * n), pa.array(np.full(n, block)), pa.array(np.arange(a, a + n, dtype=np.int32)), part, *none], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = split(text)
                if docs and in_block + len(found) >= block_words:
                    yield from whole_block()
                    numbers, in_block, docs, codes = defaultdict(count().__next__), 0, [], []
                docs.append(doc_id)
                codes.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                in_block += len(found) + 1
        if docs:
            yield from whole_block()
        tidy()

    return run


def _encode(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _once(WordEncoder, sent)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(enc.encode(batch.column(0).to_pylist()), pa.list_(pa.int32()))], ["word", "ids"])
        tidy()

    return run


PACK_SCHEMA = "block long, numbers binary, lengths binary, ids binary, used array<int>"


def _pack():
    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        block, no, length, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        start = np.cumsum(length) - length
        order = np.lexsort((no, block))
        for own in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            flat = ids[spans(start[own], length[own])]
            row = {"block": int(block[own[0]]), "numbers": packed(np.diff(no[own], prepend=0)), "lengths": packed(length[own]), "ids": packed(flat), "used": np.unique(flat).tolist()}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int64()), ("numbers", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary()), ("used", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column(2)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy()))
            n += batch.num_rows
            if n >= PACK_WORDS:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return run


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All numbers start[i] .. start[i] + length[i] - 1, one span after the other."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


def _assemble(digest: bool):
    """Rows of a block come as packed ids of words, then pieces of ids, then documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, table, pieces = None, [], None, {}
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row["block"] != at:
                    at, parts, table, pieces = row["block"], [], None, {}
                if row["kind"] == 0:
                    parts.append(tuple(unpacked(row[c]).astype(np.int64) for c in ("x", "y", "z")))
                elif row["kind"] == 1:
                    pieces[row["id"]] = row["piece"].encode()
                else:
                    if table is None:
                        table = _ids_by_number(parts)
                        parts = []
                    start, length, ids = table
                    codes, sizes = unpacked(row["y"]), unpacked(row["x"]).astype(np.int64)
                    ends = np.cumsum(sizes)
                    for doc_id, a, b in zip(row["docs"], ends - sizes, ends, strict=True):
                        own = codes[a:b]
                        mine = ids[spans(start[own], length[own])] if b > a else ids[:0]
                        text = b" ".join(map(pieces.__getitem__, mine.tolist()))
                        out.append((doc_id, len(mine), hashlib.sha256(mine.tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()) if digest else (doc_id, mine.astype(np.int32), text.decode()))
            if out:
                columns = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string()] if digest else [pa.int64(), pa.list_(pa.int32()), pa.string()]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        tidy()

    return run


def _ids_by_number(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the ids of each number of a block start, how many they are, and the ids."""
    none = np.zeros(0, np.int64)
    number = np.concatenate([np.cumsum(n) for n, _, _ in parts] or [none])
    size = np.concatenate([s for _, s, _ in parts] or [none])
    ids = np.concatenate([i for _, _, i in parts] or [none]).astype("<u4")
    start, length = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    start[number], length[number] = np.cumsum(size) - size, size
    return start, length, ids


def id_to_piece(spark: SparkSession, tokenizer_path: str) -> DataFrame:
    """(id, piece): the vocabulary and its special tokens; as many rows as the tokenizer file names."""
    spec = json.loads(file_bytes(tokenizer_path))
    vocabulary = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return spark.createDataFrame(list(vocabulary.items()), "id int, piece string")


def word_table(words: DataFrame, tokenizer_path: str) -> DataFrame:
    """(word, ids) for every distinct word of a column ``word``, each encoded once."""
    sent = words.sparkSession.sparkContext.broadcast(file_bytes(tokenizer_path))
    return words.select("word").distinct().mapInArrow(_encode(sent), "word string, ids array<int>")


def _coded(documents: DataFrame, tokenizer_path: str, specials: bool, doc_id: str, text: str, block_words: int, chunk_words: int, digest: bool) -> DataFrame:
    spark = documents.sparkSession
    small_batches(spark)
    if json.loads(file_bytes(tokenizer_path)).get("decoder"):
        raise ValueError("a tokenizer without a decoder is needed: pieces are joined by blanks")
    sent = spark.sparkContext.broadcast(file_bytes(tokenizer_path))
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    folder = new_folder(spark, "word-blocks")
    docs.mapInArrow(_split(sent, specials, block_words, chunk_words), SPLIT_SCHEMA).write.option("compression", "zstd").partitionBy("kind").parquet(folder)
    read = lambda kind, schema: _part(spark, folder, kind, schema)
    words, chunks = read("words", "block long, no int, word string"), read("docs", "block long, docs array<long>, lengths binary, codes binary")
    table = written(word_table(words, tokenizer_path), "word-table")
    release(spark)
    slice_ = F.pmod(F.xxhash64("word"), F.lit(SLICES))
    parts = []
    for k in range(SLICES):
        joined = words.where(slice_ == k).join(table.where(slice_ == k), "word").select("block", "no", "ids")
        parts.append(written(joined.mapInArrow(_pack(), PACK_SCHEMA), "word-ids"))
        del joined
        release(spark)
    discard(words), discard(table)
    ids = reduce(DataFrame.union, parts)
    # A block's parts name at most the ids of its own distinct words, so their union is bounded by the block.
    used = ids.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("used"))).alias("used")).select("block", F.explode("used").alias("id"))
    pieces = used.join(F.broadcast(id_to_piece(spark, tokenizer_path)), "id")
    null = lambda kind: F.lit(None).cast(kind)
    row = lambda df, kind, **c: df.select("block", F.lit(kind).alias("kind"), *[c.get(n, null(t)).alias(n) for n, t in (("id", "int"), ("piece", "string"), ("x", "binary"), ("y", "binary"), ("z", "binary"), ("docs", "array<long>"))])
    col = F.col
    rows = row(ids, 0, x=col("numbers"), y=col("lengths"), z=col("ids")).union(row(pieces, 1, id=col("id"), piece=col("piece"))).union(row(chunks, 2, x=col("lengths"), y=col("codes"), docs=col("docs")))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, decoded string"
    return rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_assemble(digest), schema)


def _part(spark: SparkSession, folder: str, kind: str, schema: str) -> DataFrame:
    """One kind of the rows in ``folder``; there is no such folder where the kind has no rows."""
    path = f"{folder}/kind={kind}"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        spark.createDataFrame([], schema).write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_to = path
    return out


def encode(documents: DataFrame, tokenizer_path: str, specials: bool = True, doc_id: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """One row per document: doc_id, its ids, and the text that they decode to."""
    return _coded(documents, tokenizer_path, specials, doc_id, text, block_words, chunk_words, False)


def round_trip(documents: DataFrame, tokenizer_path: str, specials: bool = True, doc_id: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_tokens, and the SHA-256 of its ids and of the text they decode to."""
    return _coded(documents, tokenizer_path, specials, doc_id, text, block_words, chunk_words, True)
