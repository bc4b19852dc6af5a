"""Views of the generic test tables as the engine's logical tables (votes, traces, checkpoints)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceloom.operators import voting, windows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, idx, answer, weight, run: one vote per event."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("question_id"), F.col("event_id").alias("idx"), F.col("event_type").alias("answer"), F.col("value").alias("weight"), (F.col("event_id") % 8).alias("run"))


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, ground_truth: the first event's type stands for the truth."""
    return votes(spark, sf_dir).groupBy("question_id").agg(F.min_by("answer", "idx").alias("ground_truth"))


TOKEN_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id, the order of tokens, conf (integral), flag: one token per line item."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("trace_id"), *TOKEN_ORDER, F.col("l_quantity").alias("conf"), F.col("l_returnflag").alias("flag"))


def trace_answers(tok: DataFrame) -> DataFrame:
    """trace_id, answer: the flag that most tokens of the trace carry, ties by name."""
    n = tok.groupBy("trace_id", "flag").agg(F.count("*").alias("n"))
    return n.groupBy("trace_id").agg(F.min_by("flag", F.struct(-F.col("n"), F.col("flag"))).alias("answer"))


def traces(spark: SparkSession, sf_dir: str, window: int = 128, tail: int = 256) -> DataFrame:
    """question_id, trace_idx, answer, num_tokens and the four confidence metrics of each trace.

    One scan, one shuffle and one sort: window means, counts and answers of a trace meet in a single aggregate over the
    partitioning that the running sums need anyway. A trace's window means, as many as it has tokens, are sorted there.
    """
    rolled = windows.rolling_mean(tokens(spark, sf_dir), ["trace_id"], TOKEN_ORDER, "conf", window)
    rolled = rolled.withColumn("_n", F.count("*").over(Window.partitionBy("trace_id")))
    each = rolled.groupBy("trace_id").agg(
        F.count("*").alias("num_tokens"), F.avg("conf").alias("mean_conf"), F.avg(F.when(F.col("pos") > F.col("_n") - tail, F.col("conf"))).alias("tail_conf"),
        F.sort_array(F.collect_list("mean")).alias("_means"), F.mode("flag", True).alias("answer"),
    )
    low = F.when(F.size("_means") > 0, F.col("_means")).otherwise(F.array("mean_conf"))
    each = each.withColumn("_low", low).withColumn("_k", F.greatest(F.floor(F.size("_low") * 0.1), F.lit(1)).cast("int"))
    bottom = F.aggregate(F.slice("_low", F.lit(1), F.col("_k")), F.lit(0.0), lambda s, x: s + x) / F.col("_k")
    return each.select((F.col("trace_id") % 10).alias("question_id"), F.col("trace_id").alias("trace_idx"), "answer", "num_tokens", "mean_conf", "tail_conf", bottom.alias("bottom_conf"), F.get("_low", F.lit(0)).alias("min_conf"))


def with_truths(traces_: DataFrame) -> DataFrame:
    """``traces_`` with the question's truth, its first trace's answer, in the partitioning that votes by question use."""
    first = F.first("answer").over(Window.partitionBy("question_id").orderBy("trace_idx"))
    return traces_.withColumn("ground_truth", first)


def question_truths(traces_: DataFrame) -> DataFrame:
    return traces_.groupBy("question_id").agg(F.min_by("answer", "trace_idx").alias("ground_truth"))


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, trace, prob_token, answer, confidence, token_usage and flags: the last event of each day's cell."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    cells = e.withColumn("prob_token", (2048 * (day + 1)).cast("long"))
    usage = windows.numbered(cells, ["user_id", "event_type"], ["ts", "event_id"], "token_usage")
    last = windows.last_row(usage, ["user_id", "event_type", "prob_token"], ["ts", "event_id"], ["event_id", "value", "token_usage"])
    flag = lambda m, r: F.col("event_id") % m == r
    return last.select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("trace"), "prob_token", (F.floor(F.col("value") / 20)).cast("string").alias("answer"), F.col("value").alias("confidence"),
        F.col("token_usage").cast("long").alias("token_usage"), flag(3, 0).alias("is_warmup"), flag(5, 0).alias("is_deep_conf_truncated"), flag(2, 0).alias("is_naturally_stopped"), flag(7, 0).alias("is_out_of_budget"),
    )


# The same views for the SQL twins.
SQL_VOTES = "votes AS (SELECT user_id AS question_id, event_id AS idx, event_type AS answer, value AS weight, event_id % 8 AS run FROM events), truths AS (SELECT question_id, arg_min(answer, idx) AS ground_truth FROM votes GROUP BY 1)"
SQL_TOKENS = (
    "tok AS (SELECT l_suppkey AS trace_id, l_quantity AS conf, l_returnflag AS flag, row_number() OVER w AS pos, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem"
    " WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey))"
)


def sql_windows(window: int, source: str = "tok", keys: str = "trace_id", name: str = "win") -> str:
    return (
        f"{name} AS (SELECT {keys}, pos, n, mean FROM (SELECT {keys}, pos, n, CASE WHEN n < {window} AND pos = n THEN avg(conf) OVER (PARTITION BY {keys})"
        f" WHEN pos >= {window} THEN avg(conf) OVER (PARTITION BY {keys} ORDER BY pos ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) END AS mean FROM {source}) WHERE mean IS NOT NULL)"
    )


SQL_TRACES = (
    f"{SQL_TOKENS}, {sql_windows(128)}, low AS (SELECT trace_id, avg(mean) FILTER (WHERE r <= greatest(floor(m * 0.1::DOUBLE), 1)) AS bottom_conf, min(mean) AS min_conf"
    " FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY mean, pos) AS r, count(*) OVER (PARTITION BY trace_id) AS m FROM win) GROUP BY 1),"
    " plain AS (SELECT trace_id, count(*) AS num_tokens, avg(conf) AS mean_conf, avg(conf) FILTER (WHERE pos > n - 256) AS tail_conf FROM tok GROUP BY 1),"
    " ans AS (SELECT trace_id, flag AS answer FROM (SELECT trace_id, flag, row_number() OVER (PARTITION BY trace_id ORDER BY count(*) DESC, flag) AS r FROM tok GROUP BY 1, 2) WHERE r = 1),"
    " traces AS (SELECT trace_id % 10 AS question_id, trace_id AS trace_idx, answer, num_tokens, mean_conf, tail_conf, bottom_conf, min_conf FROM plain JOIN low USING (trace_id) JOIN ans USING (trace_id)),"
    " gt AS (SELECT question_id, arg_min(answer, trace_idx) AS ground_truth FROM traces GROUP BY 1)"
)
SQL_CHECKPOINTS = (
    "cells AS (SELECT user_id AS run_id, event_type AS trace, 2048 * (date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1) AS prob_token, event_id, ts, value,"
    " row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS token_usage FROM events),"
    " ckpt AS (SELECT run_id, trace, prob_token, CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) AS answer, value AS confidence, CAST(token_usage AS BIGINT) AS token_usage, event_id % 3 = 0 AS is_warmup, event_id % 5 = 0 AS is_deep_conf_truncated,"
    " event_id % 2 = 0 AS is_naturally_stopped, event_id % 7 = 0 AS is_out_of_budget FROM (SELECT *, row_number() OVER (PARTITION BY run_id, trace, prob_token ORDER BY ts DESC, event_id DESC) AS r FROM cells) WHERE r = 1)"
)
