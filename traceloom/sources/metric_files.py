"""Metric files by question, checkpoint and window: read by path, laid on a grid, repeated where a file is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.operators import windows

#: Fixed value: the name of a metric file.
NAME = r"analysis_results_qid(\d+)_probtoken_(\d+)_windowsize_(\d+)\.json$"
#: What a metric file holds, as far as it is used. A map keeps the order of the file's keys.
BODY = "ground_truth string, count_accuracy double, entropy_metrics struct<entropy_count double>, answers map<string, struct<mean_window_conf double>>"
POINT = ["accuracy", "entropy", "top_is_truth", "normalized_accuracy"]


def metric_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of the metric files of a folder."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="analysis_results_*.json")
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def share_of_truth(body: Column) -> Column:
    """Mean window confidence of the truth over that of all answers; 0 where the truth or all confidence is absent."""
    conf = lambda x: F.coalesce(x["mean_window_conf"], F.lit(0.0))
    total = F.aggregate(F.map_values(body["answers"]), F.lit(0.0), lambda a, x: a + conf(x))
    own = F.coalesce(conf(F.try_element_at(body["answers"], body["ground_truth"])), F.lit(0.0))
    return F.when(total > 0, own / total).otherwise(0.0)


def points(files: DataFrame, window: int) -> DataFrame:
    """qid, prob_token and the metrics of each of ``files`` (path, body) of one window size."""
    part = lambda k: F.regexp_extract("path", NAME, k).try_cast("int")
    rows = files.select(part(1).alias("qid"), part(2).alias("prob_token"), part(3).alias("w"), F.from_json("body", BODY).alias("b")).where(F.col("w") == window)
    b = F.col("b")
    first = F.try_element_at(F.map_keys(b["answers"]), F.lit(1))
    return rows.select("qid", "prob_token", b["count_accuracy"].alias("accuracy"), b["entropy_metrics"]["entropy_count"].alias("entropy"), (first == b["ground_truth"]).alias("top_is_truth"), share_of_truth(b).alias("normalized_accuracy"))


def carried_metrics(files: DataFrame, questions: DataFrame, window: int, leader: int | None = None) -> DataFrame:
    """qid, prob_token, the metrics, and ``carried``: a grid of ``questions`` (qid) and checkpoints, where a missing file
    repeats the question's previous point as a whole. Before a question's first file its metrics are null.

    The checkpoints are those of the question ``leader``, or all that any file has. They are a short axis, joined to
    the questions by an explode of their list.
    """
    found = points(files, window)
    axis = found if leader is None else found.where(F.col("qid") == leader)
    tokens = axis.agg(F.array_sort(F.collect_set("prob_token")).alias("tokens"))
    grid = questions.select("qid").distinct().join(tokens, F.lit(True)).select("qid", F.explode("tokens").alias("prob_token"))
    # One struct is carried, so that a point whose metric is null is not mixed with an older one.
    point = found.select("qid", "prob_token", F.struct(*POINT).alias("point"))
    laid = grid.join(point, ["qid", "prob_token"], "left").withColumn("carried", F.col("point").isNull())
    filled = windows.forward_fill(laid, ["qid"], ["prob_token"], ["point"])
    return filled.select("qid", "prob_token", "point.*", "carried")
