import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from traceloom.operators import grid, sampling, statistics, voting, windows
from traceloom.plans import catalog, extras

SF = "/root/testdata/sf0.001"


def votes(spark, rows):
    return spark.createDataFrame([(1, i, a, float(w)) for i, (a, w) in enumerate(rows)], "q int, idx int, answer string, weight double")


def test_votes_break_ties_by_first_seen(spark):
    assert voting.majority_vote(votes(spark, [("a", 1), ("b", 1), ("b", 1), ("a", 1)]), ["q"]).first().voted == "a"
    assert voting.weighted_vote(votes(spark, [("a", 1), ("b", 2), ("a", 1)]), ["q"], "weight").first().voted == "a"
    assert voting.weighted_vote(votes(spark, [(None, 9), ("a", 1)]), ["q"], "weight").first().voted == "a"


def test_vote_ignores_scale(spark):
    rows = [("a", 0.1), ("b", 0.25), ("c", 0.2), ("a", 0.2)]
    base = voting.weighted_vote(votes(spark, rows), ["q"], "weight").first().voted
    assert voting.weighted_vote(votes(spark, [(a, 8 * w) for a, w in rows]), ["q"], "weight").first().voted == base


@pytest.mark.parametrize(("n", "want"), [(5, 5), (10, 9), (1, 1)])
def test_top_share(spark, n, want):
    assert voting.top_share(votes(spark, [("a", i) for i in range(n)]), ["q"], "weight", "idx", 0.9).count() == want


def test_top_percentile_of_512(spark):
    assert voting.top_percentile(votes(spark, [("a", i) for i in range(512)]), ["q"], "weight", 0.1).count() == 52
    with pytest.raises(ValueError):
        voting.top_share(votes(spark, [("a", 1)]), ["q"], "weight", "idx", 0.0)


@pytest.mark.parametrize(("confs", "window", "kept", "groups", "stopped"), [([5, 5, 1, 1, 5, 5], 2, 4, 3, True), ([1, 1], 4, 2, 1, True), ([5, 5, 5], 2, 3, 2, False)])
def test_early_stop(spark, confs, window, kept, groups, stopped):
    df = spark.createDataFrame([(1, i, float(c)) for i, c in enumerate(confs)], "t int, pos0 int, conf double")
    r = windows.early_stop(df, ["t"], ["pos0"], "conf", window, F.lit(2.0)).first()
    assert (r.kept_tokens, r.n_windows, r.stopped) == (kept, groups, stopped)


@pytest.mark.parametrize(("values", "threshold", "want"), [([2.0, 1.5, 1.0], 0.4, True), ([2.0, 1.5, 1.5], 0.4, False)])
def test_strictly_falling(spark, values, threshold, want):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "q int, step int, h double")
    last = windows.strictly_falling(df, ["q"], "step", "h", 3).orderBy(F.desc("step")).first()
    assert last.falling is want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=30), st.integers(1, 8))
def test_rolling_mean_is_the_frame_mean(spark, values, w):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "k int, i int, v double")
    got = [r["mean"] for r in windows.rolling_mean(df, ["k"], ["i"], "v", w).orderBy("i").collect()]
    want = [None if i + 1 < w else sum(values[i + 1 - w : i + 1]) / w for i in range(len(values))]
    assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, abs_tol=1e-9)) for a, b in zip(got, want, strict=True))


CELLS = {
    (True, True, False): {(0, 10): ("A", True, False, False, 10), (0, 20): ("A", False, False, True, 10), (0, 30): ("A", False, True, False, 10), (1, 10): (None, False, False, True, None), (1, 20): ("B", True, False, False, 20), (1, 30): ("B", False, True, False, 20)},
    (True, True, True): {(0, 10): ("A", True, False, False, 10), (0, 20): ("A", False, False, True, 10), (0, 30): ("A", False, True, False, 10), (1, 10): ("B", False, False, True, 20), (1, 20): ("B", True, False, False, 20), (1, 30): ("B", False, True, False, 20)},
    (False, True, False): {(0, 10): ("A", True, False, False, 10), (0, 20): ("A", False, False, True, 10), (1, 10): (None, False, False, True, None), (1, 20): ("B", True, False, False, 20)},
    (True, False, False): {(0, 10): ("A", True, False, False, 10), (0, 20): (None, False, False, False, None), (0, 30): ("A", False, True, False, 10), (1, 10): (None, False, False, False, None), (1, 20): ("B", True, False, False, 20), (1, 30): ("B", False, True, False, 20)},
}


@pytest.mark.parametrize("flags", list(CELLS))
def test_grid_fill(spark, flags):
    seen = spark.createDataFrame([(1, 0, 10, "A"), (1, 1, 20, "B")], "run_id int, trace int, prob_token int, answer string")
    depths = spark.createDataFrame([(10,), (20,), (30,)], "prob_token int")
    rows = grid.fill_grid(seen, ["run_id"], seen, depths, ["answer"], *flags).collect()
    assert {(r.trace, r.prob_token): (r.answer, r.observed, r.is_propagated_file, r.is_propagated_trace, r.source_prob_token) for r in rows} == CELLS[flags]


def test_entropy_and_geometric_mean(spark):
    def entropy(counts, base="e"):
        df = spark.createDataFrame([(1, a, n) for a, n in counts.items()], "q int, answer string, n int")
        r = statistics.entropy(df, ["q"], "n", base).withColumn("c", statistics.normalised_confidence()).first()
        return round(r.entropy, 6), r.c

    assert entropy({"a": 2, "b": 2}) == (0.693147, 0.0)
    assert entropy({"a": 3, "b": 1})[1] == 0.189 and entropy({"a": 5})[1] == 1.0
    assert entropy({"a": 3, "b": 1}, "2")[0] == 0.811278
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    assert round(df.agg(statistics.shift_geometric_mean("x").alias("g")).first().g, 6) == 1.828427
    with pytest.raises(Exception, match="shift-1"):
        spark.createDataFrame([(-1.0,)], "x double").agg(statistics.shift_geometric_mean("x")).collect()


def test_capped_tokens(spark):
    df = spark.createDataFrame([(1, 10), (1, 70000)], "q int, n int")
    r = statistics.capped_tokens(df, ["q"], "n").first()
    assert (r.n_within, r.capped_tokens) == (1, 64010)


def test_samples(spark):
    df = votes(spark, [("a", i) for i in range(30)])
    assert sampling.sample_without_replacement(df, ["q"], "idx", 10, 1).count() == 10
    assert sampling.bootstrap(df, ["q"], "idx", 4, 16).count() == 64
    small = sampling.bootstrap(df, ["q"], "idx", 2, 64, resample_when_small=False)
    assert small.where("bootstrap_idx = 1").select("idx").distinct().count() == 30


def test_streamed_stop_equals_the_batch(spark):
    got = {r.trace_id: r.pos for r in extras.streamed_stop(spark, SF).collect()}
    want = {r.trace_id: r.kept_tokens for r in catalog.early_stop(spark, SF).where("stopped").collect() if r.n_tokens >= 128}
    assert got == want


def test_python_queries(spark):
    from fractions import Fraction

    for r in extras.equivalent_answers(spark, SF).collect():
        n, m = (int(x) for x in r.a.removeprefix("\\dfrac{").removesuffix("}").split("}{"))
        other = [int(x) for x in r.b.removeprefix("\\frac{").removesuffix("}").split("}{ ")] if "frac" in r.b else None
        assert r.is_equiv == (Fraction(n, m) == (Fraction(*other) if other else Fraction(r.b)))
    assert all(r.answer.startswith("\\frac{") and r.answer.endswith("}") for r in extras.nested_answers(spark, SF).limit(50).collect())
    matched = extras.question_matching(spark, SF).collect()
    assert sum(r.left_id == r.right_id for r in matched) >= 0.9 * len(matched) > 0
    forms = extras.answer_clusters(spark, SF).collect()
    assert len({r.canonical for r in forms}) == 6
    assert extras.online_conversion(spark, SF).count() > 0


def test_carried_points_and_set_operations_cover_all_rows(spark):
    import __spark_entry__ as driver

    d = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{d}/events.parquet")
    q = driver.queries()
    assert q["carried_points_all"](spark, d).select("question_id").distinct().count() == events.select("user_id").distinct().count()
    n = q["set_operations_all"](spark, d).agg({"n": "sum"}).first()[0]
    # Only groups of a single vote of the second phase are taken out by the difference.
    alone = events.where("event_id % 8 >= 4").groupBy("user_id").count().where("count = 1").count()
    assert n == events.count() - alone


def test_warmup_entropy_of_few_traces_is_that_of_all(spark, monkeypatch):
    from traceloom.plans import adapters, catalog

    rows = [(1, i, a, 10) for i, a in enumerate("aabb")] + [(2, i, "ab"[i % 2], 1) for i in range(40)]
    monkeypatch.setattr(adapters, "traces", lambda s, d: s.createDataFrame(rows, "question_id long, trace_idx long, answer string, num_tokens long"))
    got = {r.question_id: r for r in catalog.warmup_entropy(spark, "").collect()}
    assert (got[1].draws, got[1].mean_entropy, got[1].var_entropy, got[1].tokens) == (4, 1.0, 0.0, 160)
    assert got[2].tokens == 32 and 0 <= got[2].mean_entropy <= 1


def test_carried_points_match_their_twin_on_holes_and_nulls_and_sort_no_cells(spark, tmp_path):
    import duckdb

    rows = [(1, 7, 1.0), (1, 900, 2.0), (1, 2600, None), (2, 9001, 4.0), (2, -3, 5.0), (3, None, 6.0), (None, 1100, 7.0), (4, 1101, None)]
    events = spark.createDataFrame([(e, u, "a", v) for u, e, v in rows], "event_id long, user_id long, event_type string, value double")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.carried_points_all(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE_SQL["carried_points_all"]).fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) == 5 * 6
    # Cells appear last, from points that are already filled: nothing above them sorts, joins or shuffles.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not {"Join", "Window", "Repartition"} & set(plan[: plan.index("Generate explode")].replace(",", " ").split())
