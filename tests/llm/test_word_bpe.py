import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from traceloom.llm import word_bpe
from traceloom.llm.tokens import file_bytes

PATH = P.path("word_bpe_49k.json")
WEIRD = [
    "", None, " ", "A", "don't 's 'LL 'Re DON'T x'd'm", "x" * 3000, "a_b__c-d...!!!", "12³½Ⅷ x2y", "ΑΣ ΑΣΑ Σ", "İstanbul ẞ", "é ñ Å", "\x1c\x1d a\x85b　c",
    "᠎ a​b﻿", "\U0001f600\U0001f600 漢字かな한국어", "Hello <|endoftext|>World<|startoftext|>", "<|endoftext|", "a\x00b", "١٢٣ مرحبا हिन्दी", "ᲉꟋ\U0001e5f1", "ạ࢘́", "\U0001d400",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation(), t.no_padding()
    return t


def expected(t, text):
    ids = t.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_settled_characters_are_classed_lowered_and_composed_alike():
    data = file_bytes(PATH)
    fast, slow = word_bpe.Splitter(data, True), word_bpe.Splitter(data, True)
    slow._fast = False
    some = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and word_bpe.SETTLED.fullmatch(chr(c))]
    assert len(some) > 30_000
    for around in ("a{}a", ".{}.", " {} ", "1{}é"):
        text = "\n".join(around.format(c) for c in some)
        assert fast.words(text) == slow.words(text)
    # One by one, so that no character depends on its neighbours here.
    for c in some[:0x500]:
        assert fast.words(f"x{c} {c}y{c}{c}") == slow.words(f"x{c} {c}y{c}{c}"), hex(ord(c))


def test_query_equals_the_library(spark, library):
    r = random.Random(1)
    pool = ["the", "The", "hello,", "won't", "naïve", "ÉTÉ", "x1", "42", "…", "你好", "don't've", "\n", "é"]
    texts = WEIRD + [" ".join(r.choice(pool) for _ in range(r.randrange(60))) for _ in range(200)] + ["word " * 40_000]
    rows = [(i // 2 if i % 7 else None, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(3)
    want = sorted(((d, *expected(library, t)) for d, t, _ in rows), key=str)
    for sizes in ({}, {"block_words": 500, "chunk_words": 60}):
        got = sorted((tuple(x) for x in word_bpe.round_trip(df, PATH, **sizes).collect()), key=str)
        assert got == want


def test_ids_text_and_ordinary_specials(spark, library):
    df = spark.createDataFrame([(1, "Good <|endoftext|> day"), (2, None)], "key long, body string")
    rows = {x.doc_id: x for x in word_bpe.encode(df, PATH, doc_id="key", text="body").collect()}
    assert rows[1].ids == library.encode("Good <|endoftext|> day", add_special_tokens=False).ids and rows[1].decoded == "good</w> <|endoftext|> day</w>"
    assert rows[2].ids == [] and rows[2].decoded == ""
    library.encode_special_tokens = True
    rows = word_bpe.encode(df, PATH, specials=False, doc_id="key", text="body").where("doc_id = 1").first()
    assert rows.ids == library.encode("Good <|endoftext|> day", add_special_tokens=False).ids
    library.encode_special_tokens = False


def test_empty_table_and_table_of_empty_texts(spark):
    schema = "doc_id long, text string"
    assert word_bpe.round_trip(spark.createDataFrame([], schema), PATH).collect() == []
    (only,) = word_bpe.round_trip(spark.createDataFrame([(5, "")], schema), PATH).collect()
    assert (only.n_tokens, only.ids_sha256, only.decoded_sha256) == (0, *[hashlib.sha256(b"").hexdigest()] * 2)


def test_each_distinct_word_is_encoded_once(spark):
    words = spark.createDataFrame([("the",)] * 50 + [("other",), (" <|endoftext|>",)], "word string")
    table = {x.word: x.ids for x in word_bpe.word_table(words, PATH).collect()}
    assert len(table) == 3 and table[" <|endoftext|>"] == [49407] and table["the"] == [518]


def test_packing_of_integers():
    for x in ([], [0], [5, 300, 70_000, 1 << 24], [255] * 9):
        assert word_bpe.unpacked(word_bpe.packed(np.array(x, np.int64))).tolist() == x
    assert word_bpe.spans(np.array([3, 9, 0]), np.array([2, 0, 3])).tolist() == [3, 4, 0, 1, 2]
    assert not re.search("[0-9]", "".join(word_bpe.Splitter(file_bytes(PATH), True).words("a b")))
