"""Selections, prompts, verdicts and the linear unwrapping against plain Python."""

import random
import re
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from traceloom.functions import confidence, equivalence, text
from traceloom.operators import selection


def test_runs_modes_and_observed(spark):
    df = spark.createDataFrame([("0", True, False), ("7", False, None), ("8", True, True), ("-1", True, False), ("bedrock", True, False), (None, None, False)], "run_id string, observed boolean, is_truncated boolean")
    ids = lambda d: [r.run_id for r in d.collect()]
    assert ids(selection.run_range(df)) == ["0", "7"]
    assert ids(selection.observed_only(df)) == ["0", "8", "-1", "bedrock"] and selection.observed_only(df.drop("observed")).count() == 6
    assert ids(selection.trace_mode(df, "non_truncated")) == ["0", "-1", "bedrock", None] and selection.trace_mode(df).count() == 6
    with pytest.raises(ValueError):
        selection.trace_mode(df, "some")
    wanted = spark.createDataFrame([("7",), ("7",), ("9",)], "run_id string")
    assert ids(selection.only(df, wanted, ["run_id"])) == ["7"]


def test_unknown_questions_are_counted(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "qid int")
    counts = Observation("known")
    out = selection.known(df, spark.createDataFrame([(3, "x"), (4, "y"), (99, "z")], "qid int, t string"), ["qid"], counts)
    assert sorted(map(tuple, out.collect())) == [(3, "x"), (4, "y")]
    assert counts.get == {"n": 10, "n_known": 2, "n_unknown": 8}


def test_largest_is_a_bounded_heap(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("path"), (F.col("id") % 10).alias("bytes")).repartition(4)
    top = selection.largest(df, "bytes", 3, "path")
    assert [tuple(r) for r in top.collect()] == [("109", 9), ("119", 9), ("129", 9)]
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().toString()


def test_candidates_and_skipped_prompts(spark):
    rows = [(0, 0, "b", 10, "stop"), (0, 1, "a", 10, "stop"), (0, 2, "a", 10, "gconf_threshold"), (0, 3, "b", 99, "gconf_threshold"), (0, 4, "b", 20, None), (0, 5, None, 5, "stop"), (1, 0, "c", 1, "stop")]
    df = spark.createDataFrame(rows, "q int, trace_idx int, answer string, num_tokens int, stop_reason string")
    got = {r.q: r.candidates for r in selection.candidate_answers(df, ["q"], 20, 2).collect()}
    assert got == {0: ["b", "a"]}
    asked = {(r.q, r.trace_idx): r.p for r in df.select("q", "trace_idx", selection.prompted(F.col("stop_reason"), F.col("num_tokens"), 20).alias("p")).collect()}
    assert [k for k, v in asked.items() if not v] == [(0, 2)]


def test_prompt_templates(spark):
    df = spark.createDataFrame([("2+2?", "so", ["4", "5"])], "q string, t string, c array<string>")
    row = df.select(text.chat("q").alias("a"), text.chat("q", system="S", effort="high").alias("b"), text.probe_prompt(text.chat("q"), "t").alias("p"), text.choice_prompt(text.chat("q"), "t", "c").alias("d")).first()
    assert row.a == "<|user|>\n2+2?\n<|assistant|>\n"
    assert row.b == "<|system|>\nS\nReasoning: high\n<|user|>\n2+2?\n<|assistant|>\n"
    assert row.p == row.a + "so</think>\nThe answer is \\boxed"
    assert row.d == row.a + "soI need to choose one from the candidate answers [4, 5]</think>\nThe answer is \\boxed"


def test_three_verdicts_where_equivalence_is_unsure(spark):
    rows = [("1", "1", True), ("1", "2", False), ("x ", "x", None), ("x", "x", None), ("y", "x", None), (None, "x", None), ("", "", None)]
    df = spark.createDataFrame(rows, "a string, t string, same boolean")
    got = {u: [r.v for r in df.select(equivalence.verdict(F.col("same"), "a", "t", u).alias("v")).collect()] for u in ("text", "false", "null")}
    assert got == {
        "text": [True, False, False, True, False, False, False],
        "false": [True, False, False, False, False, False, False],
        "null": [True, False, True, True, False, None, True],
    }
    with pytest.raises(ValueError):
        equivalence.verdict(F.col("same"), "a", "t", "other")


def test_an_unknown_metric_may_mean_mean(spark):
    df = spark.createDataFrame([([1.0, 2.0, 6.0],)], "c array<double>")
    assert df.select(confidence.metric("other", "c", strict=False)).first()[0] == 3.0


def one_at_a_time(s):
    while True:
        new = re.sub(r"(?s)^(.*?)\\text\{([^}]*)\}", r"\1\2", s, count=1)
        if new == s:
            return s
        s = new


def test_unwrapping_equals_one_at_a_time_and_is_fast(spark):
    r = random.Random(8)
    cases = ["".join(r.choice(["\\text{", "}", "{", "a", " b", "\n", "\\frac{1}{2}"]) for _ in range(r.randrange(14))) for _ in range(400)]
    df = spark.createDataFrame([(c,) for c in cases] + [(None,)], "a string")
    got = {x.a: x.u for x in df.select("a", text.unwrap_text("a").alias("u")).collect()}
    assert got == {c: one_at_a_time(c) for c in cases} | {None: None}
    long = spark.createDataFrame([("\\text{a" * 10_000 + "}" * 20_000,)], "a string")
    began = time.time()
    assert long.select(text.unwrap_text("a").alias("u")).first().u == "a" * 10_000 + "}" * 10_000
    assert time.time() - began < 12
