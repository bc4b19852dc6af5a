"""Sources over folders: rewritten files, filters that reach the listing, grids of metric files with holes."""

import json
import os

import pytest
from pyspark.sql import functions as F

from traceloom.sources import changes, folders, metric_files


def write(path, body, mtime=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body)
    if mtime:
        os.utime(path, (mtime, mtime))


def step(spark, tmp_path, name, **options):
    """All there is now, as the changes of one run of the stream; the checkpoint goes on where it was."""
    spark.dataSource.register(changes.ChangedFiles)
    got = []
    stream = spark.readStream.format("changed_files").options(log=f"{tmp_path}/{name}-log", **options).load(f"{tmp_path}/in")
    query = stream.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/{name}-ckpt").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted((os.path.basename(r.path), r.change, bytes(r.content).decode() if r.content is not None else None) for r in got)


def test_a_rewritten_file_is_handed_over_twice(spark, tmp_path):
    write(tmp_path / "in/a.pkl", "1", 1_700_000_000)
    write(tmp_path / "in/deep/b.pkl", "2", 1_700_000_000)
    write(tmp_path / "in/c.txt", "no")
    assert step(spark, tmp_path, "s", suffix=".pkl") == [("a.pkl", "new", "1"), ("b.pkl", "new", "2")]
    assert step(spark, tmp_path, "s", suffix=".pkl") == []
    write(tmp_path / "in/a.pkl", "one", 1_700_000_100)
    write(tmp_path / "in/old.pkl", "moved in", 1_600_000_000)  # older than all that was seen
    assert step(spark, tmp_path, "s", suffix=".pkl") == [("a.pkl", "modified", "one"), ("old.pkl", "new", "moved in")]
    os.remove(tmp_path / "in/a.pkl")
    assert step(spark, tmp_path, "s", suffix=".pkl") == []
    write(tmp_path / "in/a.pkl", "back", 1_700_000_100)
    assert step(spark, tmp_path, "s", suffix=".pkl") == [("a.pkl", "new", "back")]


def test_two_rewrites_within_one_running_query(spark, tmp_path):
    import time

    spark.dataSource.register(changes.ChangedFiles)
    write(tmp_path / "in/a.pkl", "1", 1_700_000_000)
    stream = spark.readStream.format("changed_files").options(log=f"{tmp_path}/log").load(f"{tmp_path}/in")
    query = stream.writeStream.format("memory").queryName("changed").option("checkpointLocation", f"{tmp_path}/ckpt").trigger(processingTime="200 milliseconds").start()
    try:
        for n, body in enumerate(("1", "2", "3"), 1):
            write(tmp_path / "in/a.pkl", body, 1_700_000_000 + n)
            end = time.time() + 40
            while not spark.table("changed").where(F.decode("content", "UTF-8") == body).count():
                assert time.time() < end and not query.exception(), query.exception()
                time.sleep(0.2)
    finally:
        query.stop()
    assert [x.change for x in spark.table("changed").orderBy("modified").collect()][-1] == "modified"


def test_the_log_is_compacted_and_outlives_restarts(tmp_path):
    (tmp_path / "in").mkdir()
    options = {"path": f"{tmp_path}/in", "log": f"{tmp_path}/log"}
    reader = changes.ChangedFilesReader(options)
    for i in range(45):
        write(tmp_path / f"in/{i % 7}", str(i), 1_700_000_000 + i)
        assert reader.latestOffset() == {"n": i + 1}
    reader.commit({"n": 45})
    assert sorted(int(f[:-5]) for f in os.listdir(tmp_path / "log")) == list(range(40, 46))
    again = changes.ChangedFilesReader(options)
    assert again.latestOffset() == {"n": 45} and len(again._known) == 7
    write(tmp_path / "in/3", "x", 1_800_000_000)
    assert again.latestOffset() == {"n": 46}
    (only,) = again.partitions({"n": 45}, {"n": 46})
    assert (os.path.basename(only.path), only.change) == ("3", "modified")


def tree(tmp_path):
    name = "run_qid{}_rid0_20250101_000000_online_w16_p90_r{}_dp_probe.json"
    for token, folder in ((4096, "4096-probe"), (1024, "1024"), (2048, "2048-probe")):
        for qid in range(3):
            write(tmp_path / "tree" / folder / name.format(qid, 1), json.dumps({"ground_truth": f" {token}-{qid} ", "probe_results": []}))
    write(tmp_path / "tree/1024" / name.format(0, 2), json.dumps({"ground_truth": "second file"}))
    write(tmp_path / "tree/1024" / name.format(2, 0), "{broken")
    write(tmp_path / "tree/1024/summary_results.json", "{}")
    write(tmp_path / "tree/1024" / name.format(9, 1), "{}")
    write(tmp_path / "tree/notes/x.json", "{}")
    return str(tmp_path / "tree")


def test_a_filter_on_the_checkpoint_prunes_the_listing(spark, tmp_path):
    path = tree(tmp_path)
    files = folders.checkpoint_files(spark, path)
    assert files.rdd.getNumPartitions() == 6 + 7
    one = files.where("prob_token = 2048")
    assert one.rdd.getNumPartitions() == 3 and {r.prob_token for r in one.collect()} == {2048}
    assert files.where("prob_token > 1024 AND prob_token < 4096").rdd.getNumPartitions() == 3
    assert files.where(F.col("prob_token").isin(1024, 4096)).rdd.getNumPartitions() == 10
    assert files.where("prob_token = 7").count() == 0
    # What the source does not take over is still applied.
    assert files.where("prob_token = 2048 AND path LIKE '%qid1%'").count() == 1


def test_truths_come_from_the_earliest_folder_alone(spark, tmp_path):
    path = tree(tmp_path)
    got = dict(folders.earliest_truths(spark, path).collect())
    assert got == {0: "1024-0", 1: "1024-1", 2: "1024-2", 9: ""}
    with pytest.raises(ValueError, match="no checkpoint folders"):
        (tmp_path / "none").mkdir()
        folders.earliest_truths(spark, f"{tmp_path}/none")


def test_missing_metric_files_repeat_the_point_before(spark, tmp_path):
    def put(qid, token, accuracy, answers, truth="5", window=1024):
        body = {"ground_truth": truth, "count_accuracy": accuracy, "entropy_metrics": {"entropy_count": accuracy / 2}, "answers": {a: {"mean_window_conf": c} for a, c in answers}}
        write(tmp_path / "m" / f"analysis_results_qid{qid}_probtoken_{token}_windowsize_{window}.json", json.dumps(body))

    put(26, 100, 0.5, [("5", 3.0), ("6", 1.0)])
    put(26, 200, 0.6, [("6", 3.0), ("5", 1.0)])
    put(26, 300, 0.7, [])
    put(2, 100, 0.1, [("7", 2.0)])
    put(2, 300, 0.3, [("5", 0.0)])
    put(3, 200, 0.9, [("5", 1.0)])
    put(3, 250, 0.8, [("5", 1.0)])  # no checkpoint of the leader
    put(2, 200, 0.99, [("5", 1.0)], window=2048)
    files = metric_files.metric_files(spark, f"{tmp_path}/m")
    questions = spark.createDataFrame([(26,), (2,), (3,)], "qid int")
    got = {(r.qid, r.prob_token): (r.accuracy, r.entropy, r.top_is_truth, r.normalized_accuracy, r.carried) for r in metric_files.carried_metrics(files, questions, 1024, leader=26).collect()}
    assert got == {
        (26, 100): (0.5, 0.25, True, 0.75, False), (26, 200): (0.6, 0.3, False, 0.25, False), (26, 300): (0.7, 0.35, None, 0.0, False),
        (2, 100): (0.1, 0.05, False, 0.0, False), (2, 200): (0.1, 0.05, False, 0.0, True), (2, 300): (0.3, 0.15, True, 0.0, False),
        (3, 100): (None, None, None, None, True), (3, 200): (0.9, 0.45, True, 1.0, False), (3, 300): (0.9, 0.45, True, 1.0, True),
    }
    assert metric_files.carried_metrics(files, questions, 1024).where("qid = 3 AND prob_token = 250").first().accuracy == 0.8
