"""Quarantine, lookups with counts, error rows, answer spans and p-values against plain Python."""

import math
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from traceloom.functions import significance
from traceloom.operators import quarantine, spans


def test_over_length_keeps_its_length_and_errors_come_back(spark):
    rows = [(1, 3, [1.0, 2.0, 3.0], False), (2, 9, [1.0] * 9, False), (3, 2, [1.0, 1.0], True), (4, 5, None, None)]
    df = spark.createDataFrame(rows, "id int, num_tokens int, confs array<double>, broken boolean")
    got = {x.id: (x.status, x.num_tokens, x.confs) for x in quarantine.quarantined(df, 5, failed=F.col("broken")).collect()}
    assert got == {1: ("ok", 3, [1.0, 2.0, 3.0]), 2: ("over_length", 9, []), 3: ("error", 2, None), 4: ("ok", 5, None)}
    done = quarantine.checkpointed(quarantine.quarantined(df, 5, failed=F.col("broken")))
    assert {x.id for x in df.join(done, "id", "left_anti").collect()} == {3}


def test_lookup_counts_come_from_the_same_pass(spark, tmp_path):
    records = spark.createDataFrame([(i, i % 5 if i % 7 else None) for i in range(50)], "id int, k int")
    lookup = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k int, name string")
    counts = Observation("lookup")
    out = quarantine.checked_lookup(records, lookup, ["k"], failed=F.col("k").isNull(), counts=counts)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one-pass", "the only action")
    out.write.parquet(f"{tmp_path}/out")
    ran = len(jobs.getJobIdsForGroup("one-pass"))
    seen = counts.get
    assert len(jobs.getJobIdsForGroup("one-pass")) == ran  # reading the counts ran nothing
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert seen == {"n": 50, "n_ok": sum(x.status == "ok" for x in rows), "n_unmapped": sum(x.status == "unmapped" for x in rows), "n_failed": sum(x.status == "failed" for x in rows)}
    assert all((x.status == "ok") == (x.name is not None) for x in rows) and seen["n_failed"] == 8


def test_an_exception_is_its_rows_error(spark):
    df = spark.createDataFrame([("4",), ("x",), ("0",), (None,)], "v string")
    inverse = quarantine.attempting(lambda v: 1.0 / float(v), "double")
    got = {x.v: x.r for x in df.select("v", inverse("v").alias("r")).collect()}
    assert got["4"].result == 0.25 and got["4"].error is None
    assert got["x"].result is None and got["x"].error.startswith("ValueError: ")
    assert got["0"].error.startswith("ZeroDivisionError: ") and got[None].error.startswith("TypeError: ")
    tried = {x.v: x.r for x in df.select("v", quarantine.tried(F.col("v").try_cast("int"), F.col("v"), "no number").alias("r")).collect()}
    assert tried["4"] == (4, None) and tried["x"] == (None, "no number: x") and tried[None] == (None, None)


def by_hand(tokens, confs, answer):
    text = "".join(tokens)
    at = text.rfind(answer) if answer else -1
    if at < 0 or len(confs) != len(tokens):
        return (0, 0, 0.0, 0.0, 0.0)
    end, own = 0, []
    for i, t in enumerate(tokens):
        start, end = end, end + len(t)
        if end > at and start < at + len(answer):
            own.append(i)
    c = [confs[i] for i in own]
    return (own[0] + 1, own[-1] + 1, sum(c) / len(c), max(c), min(c))


def test_answer_spans_equal_the_scan_by_hand(spark):
    r = random.Random(6)
    rows, cases = [], {}
    for k in range(120):
        tokens = [r.choice(["a", "b", "ab", "éa", "1", " ", "\U0001f600", ""]) for _ in range(r.randrange(1, 30))]
        confs = [round(r.uniform(0, 20), 3) for _ in tokens]
        text = "".join(tokens)
        i = r.randrange(len(text) + 1)
        answer = r.choice([text[i : i + 4], "zz", "", None, text])
        cases[k] = (tokens, confs, answer)
        rows += [(k, p, t, c, answer) for p, (t, c) in enumerate(zip(tokens, confs))]
    df = spark.createDataFrame(rows, "k int, p int, t string, c double, answer string")
    traces = spans.token_texts(df, ["k"], ["p"], "t", "c").join(df.groupBy("k").agg(F.first("answer").alias("answer")), "k")
    got = {x.k: x.s for x in traces.select("k", spans.answer_span(F.col("text"), F.col("ends"), F.col("confs"), F.col("answer")).alias("s")).collect()}
    for k, case in cases.items():
        if case[2] == "".join(case[0]) and "" in case[0]:
            continue  # an empty token at an edge belongs to no character
        assert tuple(got[k]) == pytest.approx(by_hand(*case)), (k, case)
    short = spark.createDataFrame([("abc", [1, 2, 3], [1.0], "c")], "text string, ends array<long>, confs array<double>, answer string")
    assert tuple(short.select(spans.answer_span(F.col("text"), F.col("ends"), F.col("confs"), F.col("answer")).alias("s")).first().s) == (0, 0, 0.0, 0.0, 0.0)


def t_tail(r, n):
    """Simpson's rule over the density of Student's t."""
    v, m = n - 2, 20_000
    t = abs(r) * math.sqrt(v / (1 - r * r))
    c = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi)
    f = [(1 + (i * t / m) ** 2 / v) ** (-(v + 1) / 2) for i in range(m + 1)]
    return 1 - 2 * c * t / m / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))


def test_p_values(spark):
    cases = [(0.3, 10), (-0.3, 11), (0.9, 5), (0.99, 3), (0.05, 1000), (-0.02, 40_000), (0.0, 30), (0.5, 4), (0.001, 250_000)]
    df = spark.createDataFrame([*cases, (1.0, 2), (1.0, 9), (None, 8), (0.5, 1)], "rho double, n long")
    got = {(x.rho, x.n): x.p for x in df.select("rho", "n", significance.correlation_p(F.col("rho"), F.col("n")).alias("p")).collect()}
    for r, n in cases:
        assert got[r, n] == pytest.approx(t_tail(r, n), abs=1e-8), (r, n)
    assert got[1.0, 2] == 1.0 and got[1.0, 9] == 0.0 and got[None, 8] is None and got[0.5, 1] is None
