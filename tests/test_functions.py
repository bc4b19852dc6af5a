import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.functions import confidence, equivalence, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, [kind(v) for v in values.values()], strict=True)))
    return row.select(column.alias("x")).first().x


def kind(v):
    return "array<double>" if isinstance(v, list) else "string"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("so \\boxed{\\frac{1}{2}} ok", "\\frac{1}{2}"), ("boxed 5$ x", "5"), ("a boxed", ""), ("none", None), ("\\boxed{a{b}", "a{b}"),
        ("\\boxed{1} then \\boxed{2}", "2"), ("\\boxed {5}", "{5}"), ("\\boxed{" + "{x}" * 300 + "} tail }", "{x}" * 300), (None, None), ("\\boxed{}", ""),
    ],
)
def test_extract_answer(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(text.extract_answer("t").alias("x")).first().x == want


def test_small_text_functions(spark):
    assert one(spark, text.unwrap_text("t"), t="5 \\text{ cm}") == "5  cm"
    assert one(spark, text.unwrap_text("t"), t="5 \\text{") == "5 \\text{"
    assert [one(spark, text.normalize_answer("t"), t=x) for x in ("  ", " 7 ")] == ["<EMPTY>", "7"]
    assert one(spark, text.probe_answer("t"), t="12}") == "12" and one(spark, text.probe_answer("t"), t="") is None
    assert one(spark, text.shorten("t"), t="x" * 41) == "x" * 40 + "..."
    assert one(spark, text.to_boolean("t"), t=" TRUE ") is True and one(spark, text.to_boolean("t"), t="1") is None
    assert one(spark, text.join_reasoning("t", F.lit("b")), t="") == "b"
    assert one(spark, text.candidate_prompt(F.split("t", ",")), t="3,4").endswith("1. 3, 2. 4")
    assert text.budget_list(" 64, 32,,64 ") == [32, 64]
    assert one(spark, text.json_size("t"), t="[1,2,3]") == 3 and one(spark, text.json_type("t"), t='{"a":1}') == "object"
    assert one(spark, text.human_bytes(F.col("t").cast("long")), t="1536") == "1.50 KB"


@pytest.mark.parametrize(("n", "want"), [(5000, [2048, 4096, 5000]), (4096, [2048, 4096]), (100, [100])])
def test_depths(spark, n, want):
    assert spark.range(1).select(text.depths(F.lit(n)).alias("x")).first().x == want


def test_confidence_fixtures(spark):
    ten, twenty_five = [float(i) for i in range(1, 11)], [float(i) for i in range(1, 26)]
    assert one(spark, confidence.tail_confidence("c", 4), c=ten) == 8.5
    assert one(spark, confidence.bottom_window_confidence("c", 4), c=ten) == 2.5
    assert one(spark, confidence.bottom_window_confidence("c", 5), c=twenty_five) == 3.5
    assert one(spark, confidence.bottom_window_confidence("c", 4), c=[1.0, 2.0, 3.0]) == 2.0
    assert one(spark, confidence.sliding_means("c", 4), c=[]) == [0.0]
    assert one(spark, confidence.checkpoint_confidence("c", 2, 4), c=ten) == 1.5 and one(spark, confidence.checkpoint_confidence("c", 6, 4), c=ten) == 4.5
    assert one(spark, confidence.min_window_confidence("c", 4), c=ten) == 2.5
    assert one(spark, confidence.mean_confidence("c"), c=[]) == 0.0
    assert one(spark, confidence.token_confidence(F.array("c")), c=[-1.0, -2.0, -3.0]) == [2.0]
    with pytest.raises(ValueError):
        confidence.metric("other", "c")


def test_sliding_means_equal_numpy(spark):
    values = np.random.default_rng(3).normal(10, 3, 777).round(3)
    got = one(spark, confidence.sliding_means("c", 64), c=values.tolist())
    assert np.allclose(got, np.convolve(values, np.ones(64) / 64, "valid"))
    assert np.allclose(one(spark, confidence.sliding_means("c", 1), c=values.tolist()), values)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("\\dfrac{1}{576}", "\\frac{1}{576}", True), ("1 - \\dfrac{2}{\\pi}", "1-\\frac{2}{\\pi}", True), ("\\dfrac{9\\sqrt{23}}{23}", "\\frac{9 \\sqrt{23}}{23}", True),
        ("4 \\times 26!", "2^{25} \\cdot 26!", False), ("\\text{A}", "a", True), ("0.5", "\\frac12", True), ("2^{10}", "1024", True), ("1,000", "1000", True), ("x+1", "x + 1", True),
        ("x", "y", False), ("", "0", False), ("(1, 2)", "1,2", True), (None, "1", False), ("-\\sqrt[3]{8}", "-2", True), ("5!", "120", True), ("1/0", "2", False),
    ],
)
def test_same_answer(a, b, want):
    assert equivalence.same_answer(a, b) is want


def test_with_equivalence_keeps_rows(spark):
    rows = [("\\frac{1}{2}", "0.5"), ("\\frac{1}{2}", "0.5"), (None, "1"), ("7", None), ("A", "a")]
    got = equivalence.with_equivalence(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()
    assert sorted(r.is_equiv for r in got) == [False, False, True, True, True]
    assert math.isclose(equivalence.values("\\pi")[0], math.pi)


def test_braced_answers_are_stripped_and_text_unwraps_at_any_depth(spark):
    for raw, want in (("\\boxed{ 17 }", "17"), ("\\boxed{ \\frac{1}{2}\n}.", "\\frac{1}{2}"), ("\\boxed{ 5", "5"), ("\\boxed{ }", "")):
        assert one(spark, text.extract_answer("t"), t=raw) == want
    assert one(spark, text.unwrap_text("t"), t="\\text{" * 6 + "x" + "}" * 6) == "x"
    assert one(spark, text.unwrap_text("t"), t="\\text{a \\text{b} c \\text{d} e} f") == "a b c d e f"
    assert one(spark, text.unwrap_text("t"), t="}}") == "}}"
