import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from traceloom.llm import packing, quality_rules, sstable, toxicity, url_tree
from traceloom.llm.tokens import Encoder, file_bytes

TOKENIZER = P.path("byte_bpe_50k.json")
WEIRD = [
    "", " ", "a  b", " a", "a ", "a\n b\n\n c \n\nd", "it's 'll don't", "\x1c\x1d a\x85b", "　a   b", "<|endoftext|> x <|endoftext|>", "é́ ñ \U0001f600 漢字", "x" * 300, "Wort,\nnext*** end!!",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return t


def test_memoised_ids_are_the_library_s(library):
    r = random.Random(3)
    texts = WEIRD + ["".join(r.choice("ab cd.,\n\t'é*!1") for _ in range(r.randrange(120))) for _ in range(400)]
    for text, ids in zip(texts, Encoder(file_bytes(TOKENIZER)).batch(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces_around_newlines_are_learned_once_for_all_lines(library):
    r = random.Random(6)
    words = ["".join(r.choice("abcé.,'1") for _ in range(r.randrange(1, 6))) for _ in range(40)]
    texts = ["\n".join(" ".join(r.choices(words, k=3)) for _ in range(9)) for _ in range(60)]
    texts += [t[:40] + x + t[40:] for t in texts[:9] for x in ("\n", "\t\n", "\n\t", "\r\n", " \n", "\n ", "\n\n", "\xa0\n", "\x85", "\t", "\n\u3000x")]
    enc = Encoder(file_bytes(TOKENIZER))
    for text, ids in zip(texts[:60], enc.batch(texts[:60]), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert len(enc._after.young) <= 2 * len(words)  # not one for each pair of words around a newline
    for text, ids in zip(texts, enc.batch(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_and_punctuation_need_the_library_for_merging_only(library):
    r = random.Random(11)
    words = ["".join(r.choice("abcéßÄñT") for _ in range(r.randrange(1, 90))) + r.choice(["", "", ",", "...", "$$$", "'", '."']) for _ in range(700)]
    texts = [" ".join(r.choice(["", "", "\n"]) * (k > 0) + w for k, w in enumerate(r.choices(words, k=40))).replace(" \n", "\n") for _ in range(50)]
    enc = Encoder(file_bytes(TOKENIZER), remembered=2000)  # generations change
    enc._tokenizer = None  # would cut pieces itself
    for _ in range(2):
        for text, ids in zip(texts, enc.batch(texts), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_texts_of_one_batch_are_taken_in_stretches(library, monkeypatch):
    monkeypatch.setattr("traceloom.llm.tokens.STRETCH", 30)
    texts = ["ein Wort, ein Satz.\nNoch 12 Zeilen it's", None, "x", "a b", "  ", "ab\t cd\nef", "two words\n", "w " * 40 + "w"] * 3
    for text, ids in zip(texts, Encoder(file_bytes(TOKENIZER)).batch(texts), strict=True):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


def statistics(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 400 else {w for w in set(windows) if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_text_statistics(spark):
    r = random.Random(1)
    texts = [None, "", " \n\t ", "a b c a b c", "x x x x x", "a\nb\na\n \na", "é\U0001f600 #1 *<>", "one", "a b"]
    texts += ["".join(r.choice(["a ", "b ", "cd ", "e\n", "#", "\t"]) for _ in range(r.randrange(150))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = quality_rules.text_statistics(df.drop("n_words")).select("doc_id", "_q").collect()
    for r_ in got:
        assert (r_._q.n_words, r_._q.word_chars, r_._q.n_symbols, r_._q.n_dup_lines, r_._q.n_repeat_words) == statistics(texts[r_.doc_id])


def test_rules_find_junk_and_keep_the_rest(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8)))
    docs, labels = [(900, None, "x"), (901, "", "x")], []
    for i in range(400):
        bad = i % 5 == 0
        docs.append((i, " ".join(word() + ("***" if bad and r.random() < 0.8 else "") for _ in range(80)), "x"))
        if i < 300:
            labels.append((i, 0 if bad != (r.random() < 0.03) else 1))
    documents = spark.createDataFrame(docs, "doc_id long, text string, kept string")
    judged = quality_rules.judge(documents, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    kept = {x.doc_id: x.kept for x in judged}
    assert all(kept[i] == (i % 5 != 0) for i in range(300, 400)) and not kept[900]
    none = quality_rules.judge(documents, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert all(x.kept == (not x.base_failed) for x in none)
    assert quality_rules.judge(documents.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).collect() == []


def test_packing_is_gapless_and_tight(spark, library):
    r = random.Random(4)
    texts = [None, "", "a b", "a b"] + ["w%d " % i * r.choice([1, 5, 40, 400, 3000]) for i in range(60)]
    rows = packing.pack(spark.createDataFrame([(i % 50, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, rank int").repartition(3), TOKENIZER, capacity=512).collect()
    by = {}
    for x in rows:
        by.setdefault(x.sequence_id, []).append(x)
    for some in by.values():
        some.sort(key=lambda x: x.offset)
        assert [x.offset for x in some] == np.cumsum([0, *(x.length for x in some)])[:-1].tolist() and sum(x.length for x in some) <= 512
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        at, size, k = 0, len(ids) % 512 or 512, 0
        while at < len(ids):
            want.append((i % 50, k, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())))
            at, size, k = at + size, 512, k + 1
    assert sorted((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in rows) == sorted(want)
    assert len(by) <= -(-sum(x.length for x in rows) // 512) + 4
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).collect() == []


def test_local_search_empties_bins():
    groups = [packing.Group(2, packing.Counter({6: 1, 3: 1})), packing.Group(2, packing.Counter({5: 1})), packing.Group(1, packing.Counter({4: 1, 1: 1}))]
    before = packing.Counter()
    for g in groups:
        for s, m in g.items.items():
            before[s] += m * g.count
    after = packing.local_search(groups, 10)
    total = packing.Counter()
    for g in after:
        assert g.fill <= 10
        for s, m in g.items.items():
            total[s] += m * g.count
    assert total == before and sum(g.count for g in after) < 5


def test_shards_round_trip_and_lookup(spark, library):
    r = random.Random(5)
    rows = [(i * 3 - 30, "text %d " % i * r.choice([1, 30, 900]), "x") for i in range(80)] + [(None, "no id", "x"), (6, "again", "x"), (6, None, "x")]
    manifest = sstable.write_shards(spark.createDataFrame(rows, "doc_id long, text string, shard string"), TOKENIZER)
    got = sorted(sstable.read_shards(manifest).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in got] == sorted([d for d, *_ in rows], key=lambda d: (d is not None, d or 0))
    assert [x.start for x in got] == np.cumsum([0, *(x.n_tokens for x in got)])[:-1].tolist()
    ids = {d: library.encode(t or "", add_special_tokens=False).ids + [0] for d, t, _ in rows if d != 6}
    for x in got:
        if x.doc_id != 6:
            assert x.ids_crc32 == zlib.crc32(np.array(ids[x.doc_id], "<u4").tobytes())
    assert [i.tolist() for i in sstable.lookup(spark, manifest, -30)] == [ids[-30]] and sstable.lookup(spark, manifest, 7) == []
    assert len(sstable.lookup(spark, manifest, 6)) == 3 and len(sstable.lookup(spark, manifest, None)) == 1
    empty = sstable.write_shards(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER)
    assert sstable.read_shards(empty).collect() == []


def test_toxicity_on_held_out_documents(spark):
    r = random.Random(6)
    plain, vile = ["w%d" % i for i in range(300)], ["vile%d" % i for i in range(6)]
    docs, labels = [(5000, None, 1.0), (5001, "", 1.0)], []
    for i in range(900):
        toxic = i % 6 == 0
        words = [r.choice(plain) for _ in range(60)] + ([r.choice(vile) for _ in range(r.randrange(2, 9))] if toxic else [])
        r.shuffle(words)
        docs.append((i, " ".join(words), 1.0))
        if i < 600:
            labels.append((i, int(toxic)))
    documents = spark.createDataFrame(docs, "doc_id long, text string, severity double")
    model = toxicity.fit(documents, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.thresholds == sorted(model.thresholds)
    got = {x.key: x for x in toxicity.score(documents, model).collect()}
    right = sum(got[i].toxic == (i % 6 == 0) for i in range(600, 900))
    assert right >= 297 and not got[5000].toxic
    left = toxicity.drop_toxic(documents, model)
    assert left.columns == documents.columns and left.count() == sum(not x.toxic for x in got.values())
    none = toxicity.fit(documents, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not any(x.toxic for x in toxicity.score(documents, none).collect())
    assert toxicity.score(documents.limit(0), model).collect() == []


def test_grades_rise_with_severity(spark):
    rows, grades = [np.array([0] * 0), np.array([0]), np.array([0, 1]), np.array([0, 1, 2])] * 40, np.array([0, 1, 2, 3] * 40)
    w, t = toxicity.fit_cumulative_link(rows, grades, 3, 4)
    assert (w > 0).all() and (np.diff(t) > 0).all()


RULES = [url_tree.UrlRule("block", "com", "/en/"), url_tree.UrlRule("allow", "example.com", "/en/7")]


def test_urls(spark):
    rows = [(i, "http://bad.org/spam/%d" % i, True if i < 30 else None, "x") for i in range(40)]
    rows += [(100 + i, "http://bad.org/news/%d" % i, False if i < 30 else None, "x") for i in range(40)]
    rows += [(200 + i, "http://wide.org/%s/x" % "".join(chr(97 + (i * 7 + k * 11) % 26) for k in range(6)), False, "x") for i in range(40)]
    rows += [(300, "http://A.Example.COM/en/71?q", None, "x"), (301, "http://b.com/en/71", None, "x"), (302, None, None, "x"), (303, "no scheme", None, "x"), (304, "xcom://xcom/en/1", None, "x"), (304, "xcom://xcom/en/1", None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean, template string")
    got = {r.page_id: r for r in url_tree.filter_urls(df, df.bad, RULES).collect()}
    assert all(got[i].verdict == "block" for i in range(40)) and all(got[100 + i].verdict == "allow" for i in range(40))
    assert {got[200 + i].template for i in range(40)} == {"/*/x"}
    assert (got[300].host, got[300].path, got[300].rule, got[300].verdict) == ("a.example.com", "/en/71", "example.com/en/7", "allow")
    assert (got[301].rule, got[301].verdict) == ("com/en/", "block") and got[304].rule is None
    assert (got[302].host, got[302].path) == (got[303].host, got[303].path) == ("", "")
    assert url_tree.filter_urls(df.limit(0), df.bad, RULES).collect() == []
