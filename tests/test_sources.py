import json
import pickle

from pyspark.sql import functions as F

from traceloom.plans import conversion
from traceloom.sources import readers, writers
from traceloom.streaming import stop


def test_questions_keep_their_line_number(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text('{"question": "a?", "answer": "1"}\n\n{"question": "b?", "answer": "\\\\frac{1}{2}"}\n')
    got = {r.question_id: (r.question, r.ground_truth) for r in readers.questions(spark, str(p)).collect()}
    assert got == {0: ("a?", "1"), 2: ("b?", "\\frac{1}{2}")}


def test_result_documents(spark, tmp_path):
    trace = {"stop_reason": "stop", "text": "t", "token_ids": [1], "num_tokens": 1, "confs": [2.0], "extracted_answer": "5", "is_correct": True}
    (tmp_path / "x_simple_qid3_rid0_20250101_000000.pkl").write_bytes(pickle.dumps({"ground_truth": "5", "all_traces": [trace, trace]}))
    (tmp_path / "x_qid4_rid1_20250101_000000.pkl").write_bytes(pickle.dumps({"ground_truth": "5", "warmup_traces": [trace], "final_traces": [trace]}))
    rows = readers.result_documents(spark, str(tmp_path)).select("method", "question_id", "phase", "trace_idx", "extracted_answer").collect()
    assert sorted(map(tuple, rows)) == [("original", 4, "final", 0, "5"), ("original", 4, "warmup", 0, "5"), ("simple", 3, "all", 0, "5"), ("simple", 3, "all", 1, "5")]


def test_a_broken_file_is_an_error_row(spark, tmp_path):
    import pytest

    trace = {"text": "t", "num_tokens": 1, "confs": [2.0]}
    (tmp_path / "x_simple_qid3_rid0_20250101_000000.pkl").write_bytes(pickle.dumps({"all_traces": [trace]}))
    (tmp_path / "x_simple_qid4_rid0_20250101_000000.pkl").write_bytes(b"no pickle")
    (tmp_path / "qid5_batch00.pkl").write_bytes(pickle.dumps(print))
    rows = {r.question_id: r for r in readers.result_documents(spark, str(tmp_path), errors="row").collect()}
    assert rows[3].error is None and rows[3].confs == [2.0] and rows[3].tag == "qid3"
    assert rows[4].error.startswith("UnpicklingError") and rows[4].confs is None
    assert "is not plain data" in rows[5].error and rows[5].tag is None
    with pytest.raises(Exception, match="UnpicklingError"):
        readers.result_documents(spark, str(tmp_path)).collect()


def test_pickles_that_load_code_are_refused():
    import io

    import pytest

    class Evil:
        def __reduce__(self):
            return print, ("x",)

    with pytest.raises(pickle.UnpicklingError):
        readers._Plain(io.BytesIO(pickle.dumps(Evil()))).load()


def test_result_documents_with_numpy_numbers_batches_and_single_traces(spark, tmp_path):
    import numpy as np

    trace = {"text": "t", "num_tokens": np.int64(2), "confs": [np.float64(1.5), np.float32(2.0)], "min_conf": np.float64(0.5), "extracted_answer": "5", "is_correct": np.bool_(True)}
    (tmp_path / "qid3_batch02.pkl").write_bytes(pickle.dumps([trace, trace]))
    one = tmp_path / "qid4_rid0"
    one.mkdir()
    (one / "trace_0007.pkl").write_bytes(pickle.dumps(trace))
    (tmp_path / "x_qid5_rid1_20250101_000000.pkl").write_bytes(pickle.dumps({"ground_truth": "5", "conf_bar": np.float64(12.5), "warmup_traces": [trace], "final_traces": []}))
    rows = readers.result_documents(spark, str(tmp_path)).select("question_id", "phase", "batch", "trace_idx", "conf_bar", "confs", "min_conf", "num_tokens", "is_correct").collect()
    want = [(3, "all", 2, 0, None), (3, "all", 2, 1, None), (4, "all", None, 7, None), (5, "warmup", None, 0, 12.5)]
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    assert {(tuple(r.confs), r.min_conf, r.num_tokens, r.is_correct) for r in rows} == {((1.5, 2.0), 0.5, 2, True)}


def test_blank_lines_with_carriage_returns_are_no_questions(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_bytes(b'{"question": "a?", "answer": "1"}\r\n\t\r\n{"question": "b?", "answer": "2"}\r\n')
    assert [r.question_id for r in readers.questions(spark, str(p)).orderBy("question_id").collect()] == [0, 2]


def test_batch_records(spark, tmp_path):
    def record(key, *content):
        return {"recordId": key, "modelOutput": {"stopReason": "end_turn", "output": {"message": {"content": list(content)}}}}

    rows = [
        record("ds__7__trace_2", {"reasoningContent": {"reasoningText": {"text": "why"}}}, {"text": "so \\boxed{4}"}),
        record("ds__8__trace_0", {"reasoningContent": {"reasoningText": "plain"}}),
        record("ds__9__trace_1"),
    ]
    (tmp_path / "a.jsonl.out").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "manifest.json.out").write_text("{}")
    got = {r.question_id: (r.dataset, r.trace_idx, r.text, r.extracted_answer) for r in readers.batch_records(spark, str(tmp_path)).collect()}
    assert got == {7: ("ds", 2, "why\nso \\boxed{4}", "4"), 8: ("ds", 0, "plain", None), 9: ("ds", 1, "", None)}


def test_probe_tree_and_csv(spark, tmp_path):
    for depth, answer in ((2048, "1"), (4096, " ")):
        d = tmp_path / "tree" / f"{depth}-probe"
        d.mkdir(parents=True)
        body = {"ground_truth": "1", "probe_results": [{"idx": 0, "answer": answer, "confidence": 1.5, "token_usage": 9, "is_warmup": True}]}
        (d / "run_qid5_rid0_20250101_000000_online_w16_p90_r1_dp_probe.json").write_text(json.dumps(body))
    rows = readers.probe_tree(spark, str(tmp_path / "tree")).orderBy("prob_token")
    got = [(r.qid, r.run_id, r.prob_token, r.trace_idx, r.answer, r.is_warmup, r.is_out_of_budget) for r in rows.collect()]
    assert got == [(5, "r1", 2048, 0, "1", True, False), (5, "r1", 4096, 0, "<EMPTY>", True, False)]
    assert readers.probe_truths(rows).first().ground_truth == "1"
    writers.table(rows, str(tmp_path / "csv"))
    back = readers.checkpoint_csv(spark, str(tmp_path / "csv"))
    assert dict(back.dtypes)["answer"] == "string" and dict(back.dtypes)["is_warmup"] == "boolean" and back.count() == 2


def test_file_sizes_and_text(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"probe_results": [1, 2, 3]}')
    (tmp_path / "b.json").write_text("{broken")
    got = {r.path.rsplit("/", 1)[1]: (r.disk_bytes, r.type, r["count"], r.error) for r in readers.file_sizes(spark, str(tmp_path)).collect()}
    assert got["a.json"] == (28, "array", 3, None) and got["b.json"][3] == "invalid JSON"
    (tmp_path / "t.txt").write_text("one\\ntwo\n")
    assert readers.text_traces(spark, str(tmp_path / "t.txt")).first().text == "one\ntwo"


def test_resume_merge_and_partitions(spark, tmp_path):
    want = spark.createDataFrame([(1, i) for i in range(4)], "question_id int, trace_idx int")
    have = spark.createDataFrame([(1, 1), (1, 3)], "question_id int, trace_idx int")
    assert sorted(r.trace_idx for r in readers.missing(want, have, ["question_id", "trace_idx"]).collect()) == [0, 2]
    traces = spark.createDataFrame([(1, 0, [1.0], 1), (1, 1, [2.0], 1)], "question_id int, trace_idx int, confs array<double>, num_tokens int")
    scored = spark.createDataFrame([(1, 1, [3.0, 4.0], 2)], "question_id int, trace_idx int, confs array<double>, num_tokens int")
    merged = {r.trace_idx: (r.confs, r.num_tokens) for r in readers.merge_confidences(traces, scored).collect()}
    assert merged == {0: ([1.0], 1), 1: ([3.0, 4.0], 2)}
    writers.by_question(merged_df := readers.merge_confidences(traces, scored), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == merged_df.count()
    assert readers.thresholds(spark, {0: 12.9}).first().bar == 12.9


def test_build_and_roll_up(spark):
    raw = spark.createDataFrame(
        [(1, 0, "x \\boxed{\\dfrac{1}{2}}", [[-1.0, -3.0], [], [-2.0]], [7, 8], None, "0.5"), (1, 1, "none", [], None, "length", "0.5")],
        "question_id int, trace_idx int, text string, logprobs array<array<double>>, token_ids array<int>, stop_reason string, ground_truth string",
    )
    t = conversion.build_traces(raw, window=2)
    first, second = t.orderBy("trace_idx").collect()
    assert (first.confs, first.num_tokens, first.is_correct, first.window_min_conf) == ([2.0, 2.0], 2, True, 2.0)
    assert (second.extracted_answer, second.is_correct, second.num_tokens) == (None, False, 0)
    q = conversion.roll_up(t, ["question_id"]).first()
    assert (q.total_traces, q.correct_traces, q.voted_answer) == (2, 1, "\\dfrac{1}{2}")


def test_watch(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    stop.watch(spark, str(tmp_path / "in"), "id long", lambda df, i: seen.append(df.agg(F.sum("id")).first()[0]), str(tmp_path / "ck")).awaitTermination()
    assert sum(x for x in seen if x) == 10
