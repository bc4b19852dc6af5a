"""The pipeline's stages, each on its own input and all together, on a small corpus of known junk, vile and copied texts."""

import random

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randrange(3, 9)))
    vile = ["vile%s" % c for c in "abcdef"]
    texts, kind = [], []
    for i in range(420):
        lines = [" ".join(word() for _ in range(25)) for _ in range(4)]
        k = "junk" if i % 7 == 0 else "vile" if i % 7 == 1 else "clean"
        if k == "junk":
            lines = [" ".join(w + r.choice(["***", "&&&", "$$$"]) for w in x.split()) for x in lines]
        if k == "vile":
            lines = [x + " " + " ".join(r.choice(vile) for _ in range(2)) for x in lines]
        texts.append("\n".join(lines))
        kind.append(k)
    # A whole copy, a copy with one word changed on one line, and a line that a later text repeats.
    copied = texts[2]
    near = texts[3].replace(texts[3].split("\n")[1].split(" ")[0], "changed", 1)
    borrowed = texts[4].split("\n")[0] + "\n" + "\n".join(" ".join(word() for _ in range(25)) for _ in range(4))
    texts += [copied, near, borrowed, "", None]
    kind += ["copy", "near", "borrowed", "empty", "empty"]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 0 if kind[i] == "junk" else 1, int(kind[i] == "vile")) for i in range(420) if i % 3 != 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, dict(enumerate(texts)), dict(enumerate(kind))


def test_stages_in_order(spark, corpus):
    d, texts, kind = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), SCHEMA)
        after[name] = {x.doc_id: x.text for x in docs.collect()}
    assert set(after["quality_rules"]) == {i for i, k in kind.items() if k not in ("junk", "empty")}
    assert set(after["toxicity"]) == {i for i in after["quality_rules"] if kind[i] != "vile"}
    lines = after["line_dedup"]
    assert 420 not in lines and 421 not in lines  # every line repeats, or nearly repeats, an earlier one
    assert lines[422] == "\n".join(texts[422].split("\n")[1:])
    assert all(lines[i] == texts[i] for i in after["toxicity"] if i < 420)
    assert set(after["ngram_jaccard_join"]) == set(lines)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert {x.doc_id for x in packed} == set(lines)


def test_near_copies_leave_one_document(spark, corpus):
    d, texts, kind = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id IN (2, 3, 5, 420, 421)")
    left = {x.doc_id for x in corpus_pipeline.distinct_documents(spark, docs, d).collect()}
    assert left == {2, 3, 5}


def test_run_and_empty_corpus(spark, corpus, tmp_path):
    d, texts, kind = corpus
    assert corpus_pipeline.run(spark, d).count() > 100
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
