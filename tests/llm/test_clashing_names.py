"""Columns of the input that are called as internals or results are."""

import random

from pyspark.sql import functions as F

from traceloom.llm import quality_rules, url_tree


def test_accepted_leaves_every_column(spark):
    r = random.Random(2)
    text = lambda junk: " ".join("".join(r.choice("abcdef") for _ in range(r.randrange(3, 9))) + (r.choice(["***", "&&&"]) if junk else "") for _ in range(80))
    rows = [(i, text(i % 4 == 0), "mine", False, 3, True, "r") for i in range(200)] + [(None, None, "mine", True, 0, False, "r"), (7, "word " * 30_000, "mine", False, 1, True, "r")] + [(8, "a b", "x", True, 1, True, "r")] * 2
    schema = "doc_id long, text string, _q string, kept boolean, fired int, base_failed boolean, row string"
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(200)], "doc_id long, quality int")
    out = quality_rules.accepted(docs, labels)
    assert out.schema == docs.schema
    got = out.collect()
    assert {x.doc_id for x in got} == {i for i in range(200) if i % 4}
    assert {(x._q, x.kept, x.fired, x.base_failed, x.row) for x in got} == {("mine", False, 3, True, "r")}
    assert quality_rules.accepted(docs.limit(0), labels).collect() == []


def test_urls_leave_other_columns(spark):
    rows = [(i, f"https://a.example.com/x/{i}", "c", "b", "r", None, "old") for i in range(20)] + [(99, None, "c", "b", "r", True, "old"), (100, "https://b.org/" + "deep/" * 5000 + "1", "c", "b", "r", None, "old")]
    df = spark.createDataFrame(rows, "page_id int, url string, coarse string, branch string, row string, bad boolean, host string")
    out = url_tree.filter_urls(df, F.col("bad"), [url_tree.UrlRule("block", "org", "/deep")])
    assert out.columns == ["page_id", "url", "coarse", "branch", "row", "bad", "host", "path", "rule", "verdict", "template", "purity"]
    got = {x.page_id: x for x in out.collect()}
    assert len(got) == 22 and {(x.coarse, x.branch, x.row) for x in got.values()} == {("c", "b", "r")}
    assert got[3].host == "a.example.com" and got[99].host == "" and got[100].verdict == "block" and len(got[100].path) > 20_000
