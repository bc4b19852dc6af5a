"""Registered queries over nested extraction, equivalence, matching, conversion and streaming; tested against plain Python, too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions import text
from traceloom.functions.equivalence import with_equivalence
from traceloom.operators import matching, windows

from . import adapters as A
from . import conversion


def nested_answers(spark: SparkSession, d: str) -> DataFrame:
    """Extraction with nested braces from the orders' numbers written as fractions."""
    o = A.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    body = F.concat(F.lit("thus \\boxed{\\frac{"), F.col("o_custkey").cast("string"), F.lit("}{"), (F.col("o_orderkey") % 7 + 1).cast("string"), F.lit("}} done"))
    return o.select("o_orderkey", text.extract_answer(body).alias("answer"))


def equivalent_answers(spark: SparkSession, d: str) -> DataFrame:
    """Fractions against their decimal or reduced value, decided once per distinct pair."""
    o = A.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("n"), (F.col("o_orderkey") % 4 + 1).alias("m"))
    a = F.concat(F.lit("\\dfrac{"), F.col("n").cast("string"), F.lit("}{"), F.col("m").cast("string"), F.lit("}"))
    b = F.when(F.col("m") == 4, (F.col("n") / 4).cast("string")).when(F.col("m") == 2, (F.col("n") / 2 + 1).cast("string")).otherwise(F.concat(F.lit("\\frac{"), F.col("n").cast("string"), F.lit("}{ "), F.col("m").cast("string"), F.lit("}")))
    return with_equivalence(o.select("o_orderkey", a.alias("a"), b.alias("b")), "a", "b")


def answer_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Distinct written forms of each customer group's answers with their first equivalent form."""
    o = A.table(spark, d, "orders").withColumn("question_id", F.col("o_custkey") % 20)
    n = (F.col("o_orderkey") % 6 + 1).cast("string")
    form = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("\\frac{"), n, F.lit("}{2}"))).otherwise((F.col("o_orderkey") % 6 + 1).cast("double").__truediv__(2).cast("string"))
    return matching.cluster_answers(o.select("question_id", "o_orderkey", form.alias("answer")), ["question_id"], ["o_orderkey"])


def question_matching(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items against the same items with their middle cut out, one to one within each dataset."""
    b = A.table(spark, d, "benchmark").select((F.col("item_id") % 4).cast("string").alias("dataset"), F.col("item_id").alias("id"), F.col("text").alias("question"))
    cut = F.concat(F.substring("question", 1, 40), F.right("question", F.lit(40)))
    return matching.match_questions(b, b.withColumn("question", cut))


def online_conversion(spark: SparkSession, d: str) -> DataFrame:
    """Replicas of stored traces replayed as online runs, with their votes."""
    t = A.tokens(spark, d).groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct(*A.TOKEN_ORDER, "conf"))).alias("t"))
    t = t.join(A.trace_answers(A.tokens(spark, d)), "trace_id")
    traces = t.select((F.col("trace_id") % 10).alias("question_id"), F.col("trace_id").alias("trace_idx"), F.col("t.conf").alias("confs"), F.col("answer").alias("extracted_answer"), F.lit("stop").alias("stop_reason"))
    online = conversion.to_online(traces, ["question_id"], replicas=2, total=8, warmup=3, percentile=90.0, window=128)
    return conversion.online_votes(online, ["question_id"]).select("question_id", "replica", "voted", "votes", F.round("weight", 4).alias("weight"))


def streamed_stop(spark: SparkSession, d: str) -> DataFrame:
    """The online stop run as a stream over the tokens' files, to its end."""
    import uuid

    from traceloom.streaming import stop

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    base = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    numbered = windows.numbered(A.tokens(spark, d), ["trace_id"], A.TOKEN_ORDER).select("trace_id", F.col("pos").cast("long").alias("pos"), "conf")
    numbered.write.parquet(f"{base}/tokens")
    stream = spark.readStream.schema("trace_id long, pos long, conf double").parquet(f"{base}/tokens")
    stop.run_available(stop.stop_stream(stream, 128, 23.0), f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(stop.OUTPUT).parquet(f"{base}/out").withColumn("mean", F.round("mean", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (nested_answers, equivalent_answers, answer_clusters, question_matching, online_conversion, streamed_stop)}

#: Twins where plain SQL gives the same rows by another way.
ORACLE_SQL: dict[str, str] = {
    "nested_answers": r"SELECT o_orderkey, '\frac{' || o_custkey || '}{' || (o_orderkey % 7 + 1) || '}' AS answer FROM orders",
    "equivalent_answers": r"WITH o AS (SELECT o_orderkey, o_custkey % 50 AS n, o_orderkey % 4 + 1 AS m FROM orders)"
    r" SELECT o_orderkey, '\dfrac{' || n || '}{' || m || '}' AS a, CASE m WHEN 4 THEN CAST(n / 4 AS VARCHAR) WHEN 2 THEN CAST(n / 2 + 1 AS VARCHAR) ELSE '\frac{' || n || '}{ ' || m || '}' END AS b, m <> 2 AS is_equiv FROM o",
    "answer_clusters": r"WITH o AS (SELECT o_custkey % 20 AS question_id, o_orderkey, (o_orderkey % 6 + 1) / 2 AS v, CASE WHEN o_orderkey % 2 = 0 THEN '\frac{' || (o_orderkey % 6 + 1) || '}{2}' ELSE CAST((o_orderkey % 6 + 1) / 2 AS VARCHAR) END AS answer FROM orders)"
    r" SELECT DISTINCT question_id, answer, first(answer) OVER (PARTITION BY question_id, v ORDER BY o_orderkey) AS canonical FROM o",
    "streamed_stop": f"WITH {A.SQL_TOKENS}, {A.sql_windows(128)}, s AS (SELECT trace_id, min(pos) AS pos FROM win WHERE n >= 128 AND mean < 23.0 GROUP BY 1) SELECT s.trace_id, s.pos, round(mean, 6) AS mean, true AS stopped FROM s JOIN win USING (trace_id, pos)",
}
