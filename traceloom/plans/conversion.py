"""Composite pipelines over traces: construction, question roll-up, offline-to-online conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions import confidence, text
from traceloom.functions.equivalence import exact_equal, with_equivalence
from traceloom.operators import sampling, voting


def build_traces(raw: DataFrame, window: int | None = None, answer_prefix: str = "") -> DataFrame:
    """Traces from raw generations (text, logprobs, token_ids, stop_reason, ground_truth): confidences, answer, verdict.

    With ``window`` also group_confs and window_min_conf, the online form.
    """
    out = raw.withColumn("confs", confidence.token_confidence("logprobs")).withColumn("num_tokens", F.coalesce(F.nullif(F.size("token_ids"), F.lit(-1)), F.size("confs")))
    out = out.withColumn("stop_reason", F.coalesce("stop_reason", F.lit("unknown"))).withColumn("extracted_answer", text.extract_answer(F.concat(F.lit(answer_prefix), "text")))
    out = with_equivalence(out, "extracted_answer", "ground_truth", "is_correct")
    if window:
        out = out.withColumn("group_confs", confidence.sliding_means("confs", window, 3)).withColumn("window_min_conf", confidence.min_confidence("group_confs"))
    return out.drop("logprobs")


def roll_up(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Per question: vote by count, per-trace accuracy and token statistics."""
    stats = traces.groupBy(*keys).agg(
        F.count("*").alias("total_traces"), F.sum("num_tokens").alias("total_tokens"), F.avg("num_tokens").alias("avg_tokens_per_trace"),
        F.avg(F.col("is_correct").cast("int")).alias("trace_accuracy"), F.sum(F.col("is_correct").cast("int")).alias("correct_traces"), F.max("ground_truth").alias("ground_truth"),
    )
    voted = voting.majority_vote(traces.where(voting.has_answer("extracted_answer")), keys, "extracted_answer", "trace_idx")
    out = stats.join(voted.select(*keys, F.col("voted").alias("voted_answer")), keys, "left")
    return out.withColumn("is_voted_correct", F.coalesce(exact_equal("voted_answer", "ground_truth"), F.lit(False)))


def replica_draw(keys: list[str], replica: Column, idx: str) -> Column:
    return F.xxhash64(*keys, replica, idx)


def to_online(traces: DataFrame, keys: list[str], replicas: int = 16, total: int = 512, warmup: int = 16, percentile: float = 90.0, window: int = 2048) -> DataFrame:
    """Stored offline traces replayed as online runs: sample, calibrate on the first ones, stop the others early.

    A trace of fewer tokens than the window whose mean lies below the bar keeps its tokens but still counts as
    stopped, so it loses its vote.
    """
    each = traces.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    run = Window.partitionBy(*keys, "replica")
    drawn = each.withColumn("slot", F.row_number().over(run.orderBy(replica_draw(keys, F.col("replica"), "trace_idx"), "trace_idx"))).where(F.col("slot") <= total)
    scored = drawn.withColumn("group_confs", confidence.sliding_means("confs", window)).withColumn("window_min_conf", confidence.min_confidence("group_confs"))
    scored = scored.withColumn("phase", F.when(F.col("slot") <= warmup, "warmup").otherwise("final"))
    bar = F.percentile(F.when(F.col("phase") == "warmup", F.col("window_min_conf")), F.lit(percentile / 100)).over(run)
    scored = scored.withColumn("conf_bar", bar)
    at = F.array_position(F.transform("group_confs", lambda g: g < F.col("conf_bar")), F.lit(True)).cast("int")
    stops = (F.col("phase") == "final") & (at > 0)
    kept = F.when(stops, F.least(at + window - 1, F.size("confs"))).otherwise(F.size("confs"))
    out = scored.withColumns({"kept_tokens": kept, "stop_reason": F.when(stops, F.lit("gconf_threshold")).otherwise(F.col("stop_reason"))})
    return out.withColumn("group_confs", F.when(stops, F.slice("group_confs", F.lit(1), at)).otherwise(F.col("group_confs")))


def online_votes(online: DataFrame, keys: list[str]) -> DataFrame:
    """Confidence-weighted vote of each replica: warm-up traces at or above the bar, final ones that did not stop."""
    kept = online.where(voting.has_answer("extracted_answer")).where(((F.col("phase") == "warmup") & (F.col("window_min_conf") >= F.col("conf_bar"))) | ((F.col("phase") == "final") & (F.col("stop_reason") != "gconf_threshold")))
    return voting.weighted_vote(kept, [*keys, "replica"], "window_min_conf", "extracted_answer", "slot")


__all__ = ["build_traces", "roll_up", "to_online", "online_votes", "sampling"]
