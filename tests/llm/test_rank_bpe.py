import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from traceloom.llm import rank_bpe
from traceloom.llm.tokens import file_bytes

PATH = P.path("byte_bpe_multi_50k.tiktoken")
WEIRD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a\n b\n\n c \n\nd", "it's 'll DON'T don't", "x" * 3000, "ab" * 5000 + " tail", "\x1c\x1d a\x85b", "　a   b",
    "᠎ a", "é́ ñ \U0001f600\U0001f600 漢字かな", "<|endoftext|>", "a\x00b", "١٢٣ 42²", " \n", "\t\tx  \n y", "…—«»", "ßẞ ŉ ﻿z",
]


@pytest.fixture(scope="module")
def pair():
    ranks = rank_bpe.read_ranks(file_bytes(PATH))
    return rank_bpe.RankEncoder(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_reference_encoder(pair):
    own, other = pair
    r = random.Random(1)
    texts = WEIRD + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 700), r.randrange(0x4E00, 0x4F00), 10, 32, 32])) for _ in range(r.randrange(200))) for _ in range(300)]
    for text, ids in zip(texts, own.batch(texts), strict=True):
        assert ids.tolist() == other.encode_ordinary(text), repr(text[:40])
        assert own.decode(ids) == text.encode()


def test_long_pre_token_is_fast_and_exact(pair):
    own, other = pair
    r = random.Random(2)
    word = "".join(r.choice("abcdefghij") for _ in range(200_000))
    assert own.merge(word.encode()) == other.encode_ordinary(word)


def test_queue_gives_least_rank_then_least_position():
    q = rank_bpe.RankQueue()
    for rank, position in ((50_000, 3), (7, 9), (7, 2), (300, 1)):
        q.push(rank, position)
    assert [q.pop() for _ in range(5)] == [(7, 2), (7, 9), (300, 1), (50_000, 3), None]


def test_query_rows(spark):
    schema = "doc_id long, text string, ids string"
    rows = [(1, "some text", "x"), (None, None, "y"), (2, "", None), (2, "", None), (3, "word " * 20_000, "z")]
    got = {r.doc_id: r for r in rank_bpe.round_trip(spark.createDataFrame(rows, schema), PATH, P.PATTERN).collect()}
    assert got[None].n_tokens == got[2].n_tokens == 0 and got[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[1].decoded_sha256 == hashlib.sha256(b"some text").hexdigest()
    assert got[3].decoded_sha256 == hashlib.sha256(b"word " * 20_000).hexdigest()
    assert rank_bpe.round_trip(spark.createDataFrame([], schema), PATH, P.PATTERN).collect() == []
    assert rank_bpe.encode(spark.createDataFrame(rows[:1], schema), PATH, P.PATTERN).first().ids


def test_what_is_remembered_changes_nothing(pair):
    own, other = pair
    small = rank_bpe.RankEncoder(own._ranks, P.PATTERN, remembered=8)
    r = random.Random(3)
    words = ["".join(r.choice("aeiountsé.,'") for _ in range(r.randrange(1, 9))) for _ in range(60)] + ["", "\n", "\ta", "x" * 100]
    for _ in range(6):
        texts = ["".join(w + r.choice(" \n") for w in r.choices(words, k=40)).strip(" ") for _ in range(5)]
        for text, ids in zip(texts, small.batch(texts), strict=True):
            assert ids.tolist() == other.encode_ordinary(text), repr(text)


def test_pre_tokens_that_share_a_queue_are_merged_as_if_alone():
    r = random.Random(4)
    tokens = list({"".join(r.choice("ab\0") for _ in range(r.randrange(2, 7))).encode() for _ in range(150)})
    r.shuffle(tokens)  # a merge often gives a pair of lower rank
    ranks = {t: i for i, t in enumerate([bytes([b]) for b in range(256)] + tokens)}
    words = ["".join(r.choice("ab\0") for _ in range(r.randrange(1, 40))).encode() for _ in range(300)]

    def alone(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    enc = rank_bpe.RankEncoder(ranks, P.PATTERN)
    for word, ids in zip(words, enc.merge_all(words), strict=True):
        assert memoryview(ids).cast("I").tolist() == alone(word), word


def test_patterns_with_other_cuts():
    pattern = r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
    ranks = rank_bpe.read_ranks(file_bytes(PATH))
    own, other = rank_bpe.RankEncoder(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["one!\ntwo \n \nthree 12345", "a.\n\nb", "(c) d\te", ""]
    assert [ids.tolist() for ids in own.batch(texts)] == [other.encode_ordinary(t) for t in texts]


def test_long_pieces_do_not_share_a_run(pair, monkeypatch):
    own, other = pair
    enc, seen = rank_bpe.RankEncoder(own._ranks, P.PATTERN), []
    merge_all = enc.merge_all
    monkeypatch.setattr(enc, "merge_all", lambda run: seen.append(sum(map(len, run))) or merge_all(run))
    r = random.Random(5)
    texts = ["".join(r.choice("abcdef") for _ in range(50_000)) for _ in range(6)]
    for text, ids in zip(texts, enc.batch(texts), strict=True):
        assert ids.tolist() == other.encode_ordinary(text)
    assert max(seen) <= rank_bpe.RUN + 50_000
