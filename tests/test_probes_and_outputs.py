"""Records of differing shapes, probe files of which the last counts, padded matrices."""

import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from traceloom.functions import text
from traceloom.operators import probes
from traceloom.sources import outputs, writers


def test_three_shapes_in_one_file(spark, tmp_path):
    records = [
        {"text": "so \\boxed{4}", "output_ids": [1, 2, 3], "meta_info": {"finish_reason": {"type": "stop", "matched": 2}, "output_token_ids": [9]}},
        {"text": "b", "meta_info": {"output_token_ids": [7, 8], "finish_reason": "length"}},
        {"text": "c", "output_ids": [], "meta_info": {"output_token_logprobs": [[-0.5, 11, "x"], [-1, 12, None]], "output_top_logprobs": [[[-0.5, 11, "x"], [-1.5, 3, "y"]], [], [[-2.0005, 12, "z"]]], "finish_reason": {}}},
        {"text": "d", "meta_info": {"output_top_logprobs": [[[-1.0, 5, "q"]], None], "finish_reason": None}},
        {"text": "e", "output_ids": None, "meta_info": {"output_token_ids": [4], "finish_reason": {"type": None}}},
        {"text": "f", "meta_info": {}},
    ]
    path = tmp_path / "out" / "a.jsonl"
    path.parent.mkdir()
    path.write_text("\n".join([*map(json.dumps, records), "", "{broken", "[1]", '{"output_ids": [1]}']))
    rows = outputs.raw_output_lines(spark, f"{tmp_path}/out").collect()
    good = {r.text: (r.stop_reason, r.token_ids, r.num_tokens, r.confs) for r in rows if r.error is None}
    assert good == {
        "so \\boxed{4}": ("stop", [1, 2, 3], 3, []),
        "b": ("length", [7, 8], 2, []),
        "c": ("unknown", [11, 12], 2, [1.0, 2.001]),
        "d": (None, [], 1, [1.0]),
        "e": ("unknown", [], 0, []),
        "f": ("unknown", [], 0, []),
    }
    assert sorted(r.error for r in rows if r.error) == ["no JSON", "no object", "no text"]
    assert {r.file for r in rows} == {"a.jsonl"} and [r.extracted_answer for r in rows if r.extracted_answer] == ["4"]


def test_compact_bytes_of_any_json_value(spark):
    cases = ['{"b": 1.0, "a": [1, 2.5, {"x": null}], "é": "x y\\n"}', "[1, 2 , 3]", '"a b"', "17", "{}", "null", '{"other": "k"}']
    df = spark.createDataFrame([(c,) for c in [*cases, "{bad", None]], "j string")
    got = {r.j: r.n for r in df.select("j", text.json_bytes("j").alias("n")).collect()}
    assert {c: got[c] for c in cases} == {c: len(json.dumps(json.loads(c), ensure_ascii=False, separators=(",", ":")).encode()) for c in cases}
    assert got["{bad"] is None and got[None] is None


def test_the_last_file_wins_and_places_are_checked(spark):
    schema = "path string, qid int, trace_idx int, probes map<int, struct<answer: string, is_correct: boolean>>"
    files = spark.createDataFrame([
        ("t/001.pkl", 0, 0, {2048: ("a", False), 1024: ("b", True)}), ("t/009.pkl", 0, 0, {512: ("c", True)}), ("t/002.pkl", 0, 1, {1: ("d", False)}),
        ("t/003.pkl", 0, 5, {}), ("t/004.pkl", 7, 0, {3: ("e", True), 1: ("f", True), 2: (None, None)}),
    ], schema)
    stored = spark.createDataFrame([("s/1", 0, [("x",), ("y",)]), ("s/2", 0, [("z",), (None,), ("w",)]), ("s/1", 1, [])], "path string, qid int, all_traces array<struct<extracted_answer: string>>")
    counts = Observation("merge")
    traces = probes.last_wins(files, ["qid", "trace_idx"])
    merged = probes.merged_by_position(traces, probes.last_wins(stored, ["qid"]), counts=counts)
    rows = probes.probe_rows(merged).collect()
    got = [(r.qid, r.trace_idx, r.token_position, r.answer, r.n_files, r.merge, r.stored_trace and r.stored_trace.extracted_answer) for r in rows]
    assert sorted(got, key=str) == sorted([(0, 0, 512, "c", 2, "merged", "z"), (0, 1, 1, "d", 1, "merged", None), (7, 0, 1, "f", 1, "missing", None), (7, 0, 2, None, 1, "missing", None), (7, 0, 3, "e", 1, "missing", None)], key=str)
    assert [x[2] for x in got if x[0] == 7] == [1, 2, 3]
    assert counts.get == {"n": 4, "n_merged": 2, "n_missing": 1, "n_out_of_bounds": 1}


def test_ragged_rows_come_back(spark, tmp_path):
    rows = [(0, [1.0, 2.0, 3.0]), (1, []), (2, [4.0]), (3, None)]
    df = spark.createDataFrame(rows, "trace_idx int, confs array<float>")
    n = probes.width(df, "confs")
    assert n == 3
    matrix = probes.padded(df, "confs", n)
    assert {r.trace_idx: (r.confs, r.length) for r in matrix.collect()} == {0: ([1.0, 2.0, 3.0], 3), 1: ([0.0] * 3, 0), 2: ([4.0, 0.0, 0.0], 1), 3: ([0.0] * 3, 0)}
    writers.padded_matrix(df, f"{tmp_path}/m", "confs")
    back = probes.ragged(spark.read.parquet(f"{tmp_path}/m"), "confs")
    assert {r.trace_idx: r.confs for r in back.collect()} == {i: c or [] for i, c in rows}
    with pytest.raises(Exception, match="longer than 2"):
        probes.padded(df, "confs", 2).collect()
    assert probes.width(df.where("false"), "confs") == 0
    wide = writers.probe_matrix(spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 2, "c")], "trace_idx int, depth int, answer string"), ["trace_idx"], "depth", "answer", [1, 2])
    assert {tuple(r) for r in wide.collect()} == {(0, "a", "b"), (1, None, "c")}
