"""Registered queries over quarantined rows, answer spans, significance, probe files and reports, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceloom.functions import significance, text
from traceloom.operators import quarantine, selection, spans, statistics, voting, windows

from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
W = f"WITH {A.SQL_VOTES}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Traces of more tokens than this are over-length in the queries below.
LONGEST = 600


@query(
    f"WITH {A.SQL_TOKENS} SELECT trace_id, CASE WHEN trace_id % 7 = 3 THEN 'error' WHEN count(*) > {LONGEST} THEN 'over_length' ELSE 'ok' END AS status, count(*) AS num_tokens,"
    f" CASE WHEN trace_id % 7 = 3 THEN NULL WHEN count(*) > {LONGEST} THEN 0 ELSE count(*) END AS n_confs, CASE WHEN trace_id % 7 = 3 OR count(*) > {LONGEST} THEN NULL ELSE round(sum(conf), 4) END AS conf_sum FROM tok GROUP BY 1"
)
def quarantined_traces(spark, d):
    """Scored traces with a status: over-length ones keep their length and have empty confidences, failed ones have none."""
    n = F.count("*").over(Window.partitionBy("trace_id"))
    sized = A.tokens(spark, d).select("trace_id", "conf", n.alias("num_tokens"))
    # An over-length trace is never gathered: only its length goes on.
    kept = F.collect_list(F.when(F.col("num_tokens") <= LONGEST, F.col("conf")))
    traces = sized.groupBy("trace_id").agg(F.max("num_tokens").alias("num_tokens"), kept.alias("confs"))
    out = quarantine.quarantined(traces, LONGEST, failed=F.col("trace_id") % 7 == 3)
    total = F.when(F.size("confs") > 0, F.aggregate("confs", F.lit(0.0), lambda a, x: a + x))
    return out.select("trace_id", "status", "num_tokens", F.when(F.col("confs").isNotNull(), F.size("confs")).cast("long").alias("n_confs"), F.round(total, 4).alias("conf_sum"))


@query(f"WITH {A.SQL_TOKENS}, n AS (SELECT trace_id, count(*) AS n FROM tok GROUP BY 1) SELECT trace_id FROM n WHERE trace_id % 7 = 3")
def traces_to_retry(spark, d):
    """Resume: traces whose scoring failed are not checkpointed and are found missing again."""
    n = A.tokens(spark, d).groupBy("trace_id").agg(F.count("*").alias("num_tokens")).withColumn("confs", F.array().cast("array<double>"))
    done = quarantine.checkpointed(quarantine.quarantined(n, LONGEST, failed=F.col("trace_id") % 7 == 3))
    return n.select("trace_id").join(done, "trace_id", "left_anti")


@query(
    "WITH r AS (SELECT o_orderkey, o_custkey, o_orderkey % 9 = 4 AS bad FROM orders) SELECT o_orderkey, CASE WHEN bad THEN 'failed' WHEN c_custkey IS NULL THEN 'unmapped' ELSE 'ok' END AS status,"
    " CASE WHEN bad THEN 'no key: x' || o_custkey END AS error, c_name FROM r LEFT JOIN customer ON NOT bad AND c_custkey = o_custkey AND c_custkey % 4 <> 1"
)
def checked_records(spark, d):
    """Records looked up by a key that some spell wrongly and some have no entry for: none is dropped, each says why."""
    o = A.table(spark, d, "orders").select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 9 == 4, "x").otherwise(""), F.col("o_custkey").cast("string")).alias("written"))
    keyed = o.withColumn("k", quarantine.tried(F.col("written").try_cast("long"), F.col("written"), "no key"))
    known = A.table(spark, d, "customer").where("c_custkey % 4 <> 1").select(F.col("c_custkey").cast("long").alias("key"), "c_name")
    records = keyed.select("o_orderkey", F.col("k.result").alias("key"), F.col("k.error").alias("error"))
    return quarantine.checked_lookup(records, known, ["key"], failed=F.col("error").isNotNull()).select("o_orderkey", "status", "error", "c_name")


_ANSWER = "CASE trace_id % 4 WHEN 0 THEN 'RF1' WHEN 1 THEN 'O3A' WHEN 2 THEN '' ELSE 'ZZ' END"


@query(
    f"WITH {A.SQL_TOKENS.replace('l_returnflag AS flag', 'l_returnflag || l_linestatus || l_linenumber AS t')}, e AS (SELECT trace_id, pos, t, conf, sum(length(t)) OVER (PARTITION BY trace_id ORDER BY pos) AS ends FROM tok),"
    f" x AS (SELECT trace_id, string_agg(t, '' ORDER BY pos) AS body, {_ANSWER} AS answer FROM tok GROUP BY 1), a AS (SELECT trace_id, answer, CASE WHEN answer <> '' AND contains(body, answer) THEN length(body) - length(answer) - strpos(reverse(body), reverse(answer)) + 1 END AS s FROM x)"
    " SELECT a.trace_id, coalesce(min(pos), 0) AS first_token, coalesce(max(pos), 0) AS last_token, round(coalesce(avg(conf), 0), 6) AS mean_conf, coalesce(max(conf), 0)::DOUBLE AS max_conf, coalesce(min(conf), 0)::DOUBLE AS min_conf"
    " FROM a LEFT JOIN e ON e.trace_id = a.trace_id AND ends > s AND ends - length(t) < s + length(answer) GROUP BY 1"
)
def answer_span_conf(spark, d):
    """Mean, highest and lowest confidence of the tokens that spell the last occurrence of a trace's answer."""
    tok = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("trace_id"), *A.TOKEN_ORDER, F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("t"), F.col("l_quantity").alias("conf"))
    traces = spans.token_texts(tok, ["trace_id"], A.TOKEN_ORDER, "t", "conf").withColumn("answer", F.expr(_ANSWER))
    s = traces.select("trace_id", spans.answer_span(F.col("text"), F.col("ends"), F.col("confs"), F.col("answer")).alias("s"))
    return s.select("trace_id", F.col("s.first").cast("long").alias("first_token"), F.col("s.last").cast("long").alias("last_token"), F.round("s.mean", 6).alias("mean_conf"), F.col("s.max").alias("max_conf"), F.col("s.min").alias("min_conf"))


_TRACE_CONFS = (
    "m AS (SELECT l_orderkey % 8 AS grp, l_orderkey, (l_orderkey % 3 = 0)::INT AS ok, arg_min(l_quantity, (l_linenumber * 1000000 + l_partkey) * 100 + l_quantity) AS first_conf, avg(l_quantity) AS avg_conf, max(l_quantity)::DOUBLE AS max_conf FROM lineitem GROUP BY 1, 2),"
    " u AS (SELECT grp, ok, metric, x FROM m UNPIVOT (x FOR metric IN (first_conf, avg_conf, max_conf)))"
)
#: The t distribution in closed form: a finite sum for whole degrees of freedom, other than the continued fraction used in Spark.
_P = (
    "CASE WHEN v % 2 = 1 THEN 1 - 2 / pi() * (asin(abs(r)) + abs(r) * coalesce(list_sum(list_transform(range(0, (v - 1) // 2), lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1.0) - lgamma(j + 1.5)) * pow(1 - r * r, j + 0.5))), 0))"
    " ELSE 1 - abs(r) * list_sum(list_transform(range(0, v // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1.0)) / sqrt(pi()) * pow(1 - r * r, j))) END"
)


@query(f"WITH {_TRACE_CONFS}, c AS (SELECT grp, metric, corr(ok::DOUBLE, x) AS r, count(*) AS n, count(*) - 2 AS v FROM u GROUP BY 1, 2 HAVING count(DISTINCT ok) = 2 AND count(*) > 2) SELECT grp, metric, n, round(r, 4) AS r, round({_P}, 6) AS p FROM c")
def pearson_tests(spark, d):
    """Correlation of correctness with first, mean and highest confidence, with its two-sided p-value."""
    place = (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")) * 100 + F.col("l_quantity")
    m = A.table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 8).alias("grp"), "l_orderkey").agg(
        F.min_by("l_quantity", place).alias("first_conf"), F.avg("l_quantity").alias("avg_conf"), F.max("l_quantity").cast("double").alias("max_conf")
    )
    u = m.withColumn("ok", (F.col("l_orderkey") % 3 == 0).cast("int")).unpivot(["grp", "ok"], ["first_conf", "avg_conf", "max_conf"], "metric", "x")
    c = u.groupBy("grp", "metric").agg(F.corr(F.col("ok").cast("double"), F.col("x").cast("double")).alias("rho"), F.count("*").alias("n"), F.count_distinct("ok").alias("k")).where("k = 2 AND n > 2")
    # The input has a name of its own: inside of lambdas Spark would take an alias of the same select for it.
    return c.select("grp", "metric", "n", F.round("rho", 4).alias("r"), F.round(significance.correlation_p(F.col("rho"), F.col("n")), 6).alias("p"))


_METRIC_POINTS = (
    "v AS (SELECT question_id % 10 AS qid, (idx // 500 + 1) * 1024 AS prob_token, answer, weight, idx FROM votes), g AS (SELECT qid, arg_min(answer, idx) AS gt FROM v GROUP BY 1),"
    " a AS (SELECT qid, prob_token, answer, count(*) AS n, avg(weight) AS conf FROM v WHERE (qid + prob_token // 1024) % 4 <> 1 GROUP BY 1, 2, 3)"
)


@query(
    f"{W}, {_METRIC_POINTS}, p AS (SELECT qid, prob_token, struct_pack(accuracy := round(coalesce(sum(n) FILTER (WHERE answer = gt), 0) / sum(n), 6), entropy := round(count(*) / 10, 6), top_is_truth := first(answer ORDER BY n DESC, answer) = first(gt),"
    " normalized_accuracy := round(coalesce(sum(conf) FILTER (WHERE answer = gt), 0) / sum(conf), 6)) AS m FROM a JOIN g USING (qid) GROUP BY 1, 2), grid AS (SELECT * FROM (SELECT DISTINCT qid FROM g), (SELECT DISTINCT prob_token FROM p)),"
    " f AS (SELECT grid.qid, grid.prob_token, last_value(m IGNORE NULLS) OVER (PARTITION BY grid.qid ORDER BY grid.prob_token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m, m IS NULL AS carried FROM grid LEFT JOIN p ON p.qid = grid.qid AND p.prob_token = grid.prob_token)"
    " SELECT qid::INT AS qid, prob_token::INT AS prob_token, m.accuracy AS accuracy, m.entropy AS entropy, m.top_is_truth AS top_is_truth, m.normalized_accuracy AS normalized_accuracy, carried FROM f"
)
def carried_metric_files(spark, d):
    """Metric documents by question and checkpoint, some of them missing, on the whole grid: a hole repeats the point before."""
    from traceloom.sources import metric_files

    v = A.votes(spark, d).select((F.col("question_id") % 10).alias("qid"), ((F.floor(F.col("idx") / 500) + 1) * 1024).alias("prob_token"), "answer", "weight", "idx")
    truths = v.groupBy("qid").agg(F.min_by("answer", "idx").alias("ground_truth"))
    a = v.where("(qid + prob_token / 1024) % 4 <> 1").groupBy("qid", "prob_token", "answer").agg(F.count("*").alias("n"), F.avg("weight").alias("conf")).join(truths, "qid")
    own = F.coalesce(F.sum(F.when(F.col("answer") == F.col("ground_truth"), F.col("n"))), F.lit(0))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "answer", F.struct(F.col("conf").alias("mean_window_conf")).alias("m"))))
    docs = a.groupBy("qid", "prob_token", "ground_truth").agg((own / F.sum("n")).alias("count_accuracy"), F.struct((F.count("*") / 10).alias("entropy_count")).alias("entropy_metrics"), ranked.alias("r"))
    body = F.to_json(F.struct("ground_truth", "count_accuracy", "entropy_metrics", F.map_from_arrays("r.answer", "r.m").alias("answers")))
    path = F.format_string("analysis_results_qid%d_probtoken_%d_windowsize_1024.json", "qid", "prob_token")
    got = metric_files.carried_metrics(docs.select(path.alias("path"), body.alias("body")), truths.select(F.col("qid").cast("int").alias("qid")), 1024)
    return got.withColumns({c: F.round(c, 6) for c in ("accuracy", "entropy", "normalized_accuracy")})


@query(
    "WITH t AS (SELECT l_orderkey, list((l_partkey % 50000)::INT ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey) AS q FROM lineitem GROUP BY 1)"
    " SELECT l_orderkey, CASE l_orderkey % 5 WHEN 0 THEN 'stop' WHEN 1 THEN 'length' WHEN 4 THEN NULL ELSE 'unknown' END AS stop_reason, CASE WHEN l_orderkey % 5 < 3 THEN array_to_string(ids, ',') ELSE '' END AS ids,"
    " CASE WHEN l_orderkey % 5 = 4 THEN NULL ELSE len(ids) END::INT AS num_tokens, CASE WHEN l_orderkey % 5 = 3 THEN round(list_sum(q), 4) ELSE 0.0 END AS conf_sum, CASE WHEN l_orderkey % 5 = 4 THEN 'no JSON' END AS error FROM t"
)
def raw_output_ids(spark, d):
    """Inference records of three shapes, some without ids and some broken, in one table: ids, stop reasons and lengths."""
    from traceloom.sources import outputs

    at = ["l_linenumber", "l_partkey", "l_suppkey"]
    li = A.table(spark, d, "lineitem").select("l_orderkey", *at, (F.col("l_partkey") % 50_000).cast("int").alias("id"), "l_quantity")
    t = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*at, "id", "l_quantity"))).alias("t"))
    ids = F.to_json("t.id")
    pairs = F.to_json(F.transform("t", lambda x: F.array(F.lit(-0.5), x["id"].cast("double"))))
    tops = F.to_json(F.transform("t.l_quantity", lambda q: F.array(F.array(-q - 1, F.lit(7.0)), F.array(-q + 1, F.lit(8.0)))))
    text_ = F.lit('"text": "x"')
    kind = F.col("l_orderkey") % 5
    body = (
        F.when(kind == 0, F.concat(F.lit("{"), text_, F.lit(', "output_ids": '), ids, F.lit(', "meta_info": {"finish_reason": {"type": "stop"}}}')))
        .when(kind == 1, F.concat(F.lit("{"), text_, F.lit(', "meta_info": {"finish_reason": "length", "output_token_ids": '), ids, F.lit("}}")))
        .when(kind == 2, F.concat(F.lit("{"), text_, F.lit(', "output_ids": [], "meta_info": {"output_token_logprobs": '), pairs, F.lit("}}")))
        .when(kind == 3, F.concat(F.lit("{"), text_, F.lit(', "meta_info": {"finish_reason": {}, "output_top_logprobs": '), tops, F.lit("}}")))
        .otherwise(F.concat(F.lit('{"text": '), ids))
    )
    got = outputs.raw_outputs(t.select("l_orderkey", body.alias("value")), keep=["l_orderkey"])
    total = F.aggregate(F.coalesce("confs", F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)
    return got.select("l_orderkey", "stop_reason", F.coalesce(F.array_join("token_ids", ","), F.lit("")).alias("ids"), "num_tokens", F.round(total, 4).alias("conf_sum"), "error")


@query(
    "WITH f AS (SELECT o_custkey % 20 AS qid, o_custkey // 20 % 12 AS trace_idx, max(o_orderkey) AS last, count(*) AS n_files FROM orders GROUP BY 1, 2),"
    " s AS (SELECT c_custkey % 20 AS qid, row_number() OVER (PARTITION BY c_custkey % 20 ORDER BY c_custkey) - 1 AS place, c_name FROM customer WHERE c_custkey < 150 AND c_custkey % 20 <> 7), z AS (SELECT qid, count(*) AS k FROM s GROUP BY 1)"
    " SELECT f.qid, f.trace_idx, n_files, l_linenumber AS token_position, l_quantity AS answer, CASE WHEN k IS NULL THEN 'missing' WHEN f.trace_idx >= k THEN 'out_of_bounds' ELSE 'merged' END AS merge, c_name AS stored"
    " FROM f JOIN (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) l ON l.l_orderkey = last LEFT JOIN z ON z.qid = f.qid LEFT JOIN s ON s.qid = f.qid AND s.place = f.trace_idx"
)
def probe_files_merged(spark, d):
    """Probes of traces from many files, the last of a trace's files alone, with the stored trace at the same place."""
    from traceloom.operators import probes

    o = A.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("qid"), (F.floor(F.col("o_custkey") / 20) % 12).alias("trace_idx"))
    li = A.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    maps = li.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", F.struct(F.col("q").alias("answer")).alias("p")))).alias("probes"))
    files = o.join(maps, o.o_orderkey == maps.l_orderkey, "left").select("qid", "trace_idx", F.format_string("trace_%012d", "o_orderkey").alias("path"), "probes")
    c = A.table(spark, d, "customer").where("c_custkey < 150 AND c_custkey % 20 <> 7").select((F.col("c_custkey") % 20).alias("qid"), "c_custkey", "c_name")
    stored = c.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("all_traces"))
    merged = probes.merged_by_position(probes.last_wins(files, ["qid", "trace_idx"]), stored)
    return probes.probe_rows(merged).select("qid", "trace_idx", "n_files", "token_position", "answer", "merge", F.col("stored_trace.c_name").alias("stored"))


@query(
    f"{W}, r AS (SELECT question_id, count(*) AS length, list(weight ORDER BY idx) AS w FROM votes GROUP BY 1), m AS (SELECT max(length) AS width FROM r) SELECT question_id, length::INT AS length, width::INT AS width, round(list_sum(w), 4) AS total, (width - length)::INT AS filled, round(w[length], 4) AS last_value FROM r, m"
)
def padded_matrix(spark, d):
    """Each question's weights as a row of one matrix: filled up to the longest, the true length beside it."""
    from traceloom.operators import probes

    rows = A.votes(spark, d).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("r")).select("question_id", F.col("r.weight").alias("w"))
    m = probes.padded(rows, "w", probes.width(rows, "w"), F.lit(0.0))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    filled = F.size(F.filter(F.slice("w", F.col("length") + 1, F.size("w") - F.col("length")), lambda x: x == 0))
    return m.select("question_id", "length", F.size("w").alias("width"), F.round(total, 4).alias("total"), filled.alias("filled"), F.round(F.element_at("w", F.col("length")), 4).alias("last_value"))


_STRUCTURED = f"{W}, u AS (SELECT question_id, answer, idx, CASE WHEN run < 4 THEN 'completed' ELSE 'truncated' END AS grp, round(weight * 100)::BIGINT AS avg_conf, round(weight * 100)::BIGINT // (1 + run) AS min_conf, round(weight * 100)::BIGINT * (1 + run) AS max_conf, answer = ground_truth AS ok FROM votes JOIN truths USING (question_id))"


@query(
    f"{_STRUCTURED}, b AS (SELECT * FROM u UNION ALL SELECT question_id, answer, idx, 'combined', avg_conf, min_conf, max_conf, ok FROM u), i AS (SELECT question_id, answer, idx, grp, ok, indicator, x FROM b UNPIVOT (x FOR indicator IN (avg_conf, min_conf, max_conf))),"
    " t AS (SELECT question_id, grp, indicator, answer, count(*) AS n, sum(x) AS s, min(idx) AS f, sum(ok::INT) AS k FROM i GROUP BY 1, 2, 3, 4)"
    " SELECT question_id, grp, indicator, first(answer ORDER BY s DESC, f) AS voted, sum(n)::BIGINT AS votes, sum(s)::DOUBLE / sum(n)::DOUBLE AS mean_conf, sum(k)::DOUBLE / sum(n)::DOUBLE AS accuracy FROM t GROUP BY 1, 2, 3"
)
def structured_report(spark, d):
    """Votes by three indicators over completed, truncated and all traces, with mean confidences and the traces' accuracy.

    One aggregate by answer serves all: sums of the answers give the means. Weights are whole hundredths here, so that
    sums are exact in any order.
    """
    v = A.votes(spark, d).join(A.truths(spark, d), "question_id")
    grp = F.explode(F.array(F.when(F.col("run") < 4, "completed").otherwise("truncated"), F.lit("combined"))).alias("grp")
    ok = (F.col("answer") == F.col("ground_truth")).cast("int").alias("ok")
    cents = F.round(F.col("weight") * 100).cast("long")
    b = v.select("question_id", "answer", "idx", cents.alias("avg_conf"), F.floor(cents / (1 + F.col("run"))).alias("min_conf"), (cents * (1 + F.col("run"))).alias("max_conf"), ok, grp)
    i = b.unpivot(["question_id", "answer", "idx", "grp", "ok"], ["avg_conf", "min_conf", "max_conf"], "indicator", "x")
    t = i.groupBy("question_id", "grp", "indicator", "answer").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.min("idx").alias("f"), F.sum("ok").alias("k"))
    n = F.sum("n")
    return t.groupBy("question_id", "grp", "indicator").agg(
        F.max_by("answer", F.struct("s", -F.col("f"))).alias("voted"), n.alias("votes"), (F.sum("s") / n).alias("mean_conf"), (F.sum("k") / n).alias("accuracy")
    )


@query(
    f"{W}, s AS (SELECT question_id, idx // 400 AS step, answer, idx, weight FROM votes), c AS (SELECT question_id, step, answer, count(*) AS n, min(idx) AS f, sum(weight) AS w FROM s GROUP BY 1, 2, 3),"
    " h AS (SELECT question_id, step, round(-sum(p * log2(p)), 9) AS h, sum(n) AS n, first(answer ORDER BY n DESC, f) AS voted FROM (SELECT *, n / sum(n) OVER (PARTITION BY question_id, step) AS p FROM c) GROUP BY 1, 2),"
    " r AS (SELECT *, sum(n) OVER (PARTITION BY question_id ORDER BY step) AS tokens, h < lag(h) OVER w AND lag(h) OVER w < lag(h, 2) OVER w AND h <= 1.6 AS stops, row_number() OVER (PARTITION BY question_id ORDER BY step DESC) = 1 AS is_last FROM h WINDOW w AS (PARTITION BY question_id ORDER BY step))"
    " SELECT question_id, first(step ORDER BY step) AS stop_step, first(voted ORDER BY step) AS answer, first(tokens ORDER BY step)::BIGINT AS tokens, first(coalesce(stops, false) ORDER BY step) AS stopped FROM r WHERE stops OR is_last GROUP BY 1"
)
def entropy_stopped_runs(spark, d):
    """Each question's run stopped when its answers' entropy falls for three checkpoints to a low, else at its end: the
    answer and the tokens spent by then."""
    s = A.votes(spark, d).withColumn("step", F.floor(F.col("idx") / 400))
    c = s.groupBy("question_id", "step", "answer").agg(F.count("*").alias("n"), F.min("idx").alias("f"))
    h = statistics.entropy(c, ["question_id", "step"], "n", "2", "h").withColumn("h", F.round("h", 9))
    best = c.groupBy("question_id", "step").agg(F.max_by("answer", F.struct("n", -F.col("f"))).alias("voted"))
    f = windows.strictly_falling(h.join(best, ["question_id", "step"]), ["question_id"], "step", "h", 3)
    by = Window.partitionBy("question_id")
    r = f.withColumns({"tokens": F.sum("total").over(by.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)), "stops": F.coalesce(F.col("falling") & (F.col("h") <= 1.6), F.lit(False)), "last": F.max("step").over(by)})
    first = r.where("stops OR step = last").groupBy("question_id").agg(F.min_by(F.struct("step", "voted", "tokens", "stops"), "step").alias("r"))
    return first.select("question_id", F.col("r.step").alias("stop_step"), F.col("r.voted").alias("answer"), F.col("r.tokens").alias("tokens"), F.col("r.stops").alias("stopped"))


@query(
    f"{W}, m AS (SELECT question_id, run, first(answer ORDER BY n DESC, f) AS majority FROM (SELECT question_id, run, answer, count(*) AS n, min(idx) AS f FROM votes GROUP BY 1, 2, 3) GROUP BY 1, 2), j AS (SELECT question_id, majority, majority = ground_truth AS ok FROM m JOIN truths USING (question_id))"
    " SELECT question_id, count(*) AS samples, sum(ok::INT)::BIGINT AS n_correct, round(avg(ok::INT), 6) AS accuracy, array_to_string(list_sort(list_distinct(list(majority))), '|') AS majorities FROM j GROUP BY GROUPING SETS ((question_id), ())"
)
def candidate_accuracy(spark, d):
    """Accuracy of the samples' majority answers by question and over all (no question), with the distinct majorities."""
    v = A.votes(spark, d)
    m = voting.majority_vote(v, ["question_id", "run"]).select("question_id", F.col("voted").alias("majority")).join(A.truths(spark, d), "question_id")
    ok = (F.col("majority") == F.col("ground_truth")).cast("int")
    sets = m.groupingSets([[F.col("question_id")], []], F.col("question_id"))
    return sets.agg(F.count("*").alias("samples"), F.sum(ok).alias("n_correct"), F.round(F.avg(ok), 6).alias("accuracy"), F.array_join(F.array_sort(F.collect_set("majority")), "|").alias("majorities"))


@query(
    f"WITH {A.SQL_TOKENS}, t AS (SELECT trace_id % 10 AS question_id, trace_id, count(*) AS n, min(conf) AS low FROM tok GROUP BY 1, 2) SELECT question_id, count(*) AS num_traces, sum(n)::BIGINT AS total_tokens, array_to_string(list(low::INT ORDER BY trace_id), ',') AS min_confs FROM t GROUP BY 1"
)
def question_rollup(spark, d):
    """Traces, tokens and the list of lowest confidences, in order of the traces, by question."""
    t = A.tokens(spark, d).groupBy("trace_id").agg(F.count("*").alias("n"), F.min("conf").alias("low"))
    lows = F.array_sort(F.collect_list(F.struct("trace_id", F.col("low").cast("int").cast("string").alias("low"))))
    return t.groupBy((F.col("trace_id") % 10).alias("question_id")).agg(F.count("*").alias("num_traces"), F.sum("n").alias("total_tokens"), F.array_join(lows["low"], ",").alias("min_confs"))


@query(
    f"{W}, r AS (SELECT question_id, idx, answer, CASE WHEN idx % 11 = 0 THEN 'bedrock' ELSE CAST(idx % 10 - 1 AS VARCHAR) END AS run_id, CASE idx % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM votes), k AS (SELECT question_id FROM truths WHERE ground_truth <> 'click')"
    " SELECT question_id, try_cast(run_id AS INT) AS run_id, count(*) AS n, count(DISTINCT answer) AS n_answers FROM r WHERE try_cast(run_id AS INT) BETWEEN 0 AND 7 AND NOT flag AND question_id IN (SELECT question_id FROM k) GROUP BY 1, 2"
)
def selected_runs(spark, d):
    """Runs in range, traces that are known not to be truncated, questions of a list."""
    run = F.when(F.col("idx") % 11 == 0, "bedrock").otherwise((F.col("idx") % 10 - 1).cast("string"))
    flag = F.when(F.col("idx") % 3 == 0, True).when(F.col("idx") % 3 == 1, False)
    v = A.votes(spark, d).withColumns({"run_id": run, "is_truncated": flag})
    kept = selection.only(selection.trace_mode(selection.run_range(v), "non_truncated"), A.truths(spark, d).where("ground_truth <> 'click'"), ["question_id"])
    return kept.groupBy("question_id", F.col("run_id").cast("int").alias("run_id")).agg(F.count("*").alias("n"), F.count_distinct("answer").alias("n_answers"))


@query(
    f"{W}, t AS (SELECT question_id, idx, answer, floor(weight * 10)::BIGINT AS num_tokens, run % 3 = 0 AS stopped FROM votes), c AS (SELECT question_id, answer, count(*) AS n, min(idx) AS f FROM t WHERE num_tokens <= 600 GROUP BY 1, 2 HAVING count(*) >= 2),"
    " l AS (SELECT question_id, string_agg(answer, '|' ORDER BY n DESC, f) AS candidates, count(*) AS k FROM c GROUP BY 1), p AS (SELECT t.*, NOT (stopped AND num_tokens < 600) AS asked FROM t),"
    " a AS (SELECT question_id, answer, count(*) AS n, min(idx) AS f FROM p WHERE asked GROUP BY 1, 2), g AS (SELECT question_id, first(answer ORDER BY n DESC, f) AS majority, max(n) AS top, sum(n) AS total, count(*) AS n_unique FROM a GROUP BY 1),"
    " ok AS (SELECT question_id, sum(n) AS k FROM a JOIN truths USING (question_id) WHERE answer = ground_truth GROUP BY 1),"
    " u AS (SELECT question_id, count(*) FILTER (WHERE asked) AS n_prompts, sum(CASE WHEN asked THEN least(num_tokens, 600) ELSE num_tokens END)::BIGINT AS token_usage, max(CASE WHEN asked THEN length(answer) END) AS w FROM p GROUP BY 1)"
    " SELECT u.question_id, coalesce(candidates, '') AS candidates, coalesce(l.k, 0)::INT AS num_candidates, n_prompts, token_usage, majority, round(top / total, 6) AS majority_ratio, n_unique, round(coalesce(ok.k, 0) / total, 6) AS accuracy FROM u LEFT JOIN l USING (question_id) LEFT JOIN g USING (question_id) LEFT JOIN ok USING (question_id)"
)
def candidate_probe(spark, d):
    """Candidates of each question's traces within the token limit, prompts that offer them to the traces that are asked,
    and the distribution of what those answer (the trace's own answer stands for the model's)."""
    limit = 600
    t = A.votes(spark, d).select("question_id", F.col("idx").alias("trace_idx"), "answer", F.floor(F.col("weight") * 10).alias("num_tokens"), F.when(F.col("run") % 3 == 0, "gconf_threshold").alias("stop_reason"))
    offered = selection.candidate_answers(t, ["question_id"], limit, 2)
    asked = selection.prompted(F.col("stop_reason"), F.col("num_tokens"), limit)
    p = t.join(offered, "question_id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    p = p.withColumn("prompt", F.when(asked, F.concat(text.chat(F.concat(F.lit("question "), F.col("question_id").cast("string"))), text.candidate_prompt("candidates"))))
    usage = F.when(F.col("prompt").isNotNull(), F.least("num_tokens", F.lit(limit))).otherwise(F.col("num_tokens"))
    spent = p.groupBy("question_id").agg(F.array_join(F.first("candidates"), "|").alias("candidates"), F.size(F.first("candidates")).alias("num_candidates"), F.count("prompt").alias("n_prompts"), F.sum(usage).alias("token_usage"))
    tallied = voting.tally(p.where("prompt IS NOT NULL"), ["question_id"], "answer", None, "trace_idx").join(A.truths(spark, d), "question_id")
    right = F.sum(F.when(F.col("answer") == F.col("ground_truth"), F.col("n")).otherwise(0))
    got = tallied.groupBy("question_id").agg(
        F.max_by("answer", F.struct("n", -F.col("first_idx"))).alias("majority"), F.round(F.max("n") / F.sum("n"), 6).alias("majority_ratio"), F.count("*").alias("n_unique"), F.round(right / F.sum("n"), 6).alias("accuracy")
    )
    return spent.join(got, "question_id", "left")


@query("SELECT doc_id, source, bytes FROM (SELECT doc_id, source, octet_length(encode(text))::BIGINT AS bytes FROM documents) ORDER BY bytes DESC, doc_id LIMIT 20")
def largest_documents(spark, d):
    """The 20 largest documents by bytes."""
    docs = A.table(spark, d, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("bytes"))
    return selection.largest(docs, "bytes", 20, "doc_id")


@query(
    f"{W}, c AS (SELECT question_id % 10 AS q, idx % 4 AS ck, answer, count(*) AS n FROM votes GROUP BY 1, 2, 3), g AS (SELECT question_id % 10 AS q, min(ground_truth) AS gt FROM truths GROUP BY 1),"
    " top AS (SELECT q, answer FROM (SELECT *, row_number() OVER (PARTITION BY q, ck ORDER BY n DESC, answer) AS r FROM c) WHERE r <= 2 UNION SELECT q, gt FROM g) SELECT top.q, top.answer, top.answer = gt AS is_truth, coalesce(sum(n), 0)::BIGINT AS n FROM top JOIN g USING (q) LEFT JOIN c ON c.q = top.q AND c.answer = top.answer GROUP BY 1, 2, 3"
)
def displayed_answers(spark, d):
    """The most frequent answers of every checkpoint, united over checkpoints, and the truth even where it is rare."""
    v = A.votes(spark, d).select((F.col("question_id") % 10).alias("q"), (F.col("idx") % 4).alias("ck"), "answer")
    c = v.groupBy("q", "ck", "answer").agg(F.count("*").alias("n"))
    truth = A.truths(spark, d).groupBy((F.col("question_id") % 10).alias("q")).agg(F.min("ground_truth").alias("gt"))
    top = c.withColumn("r", F.row_number().over(Window.partitionBy("q", "ck").orderBy(F.desc("n"), "answer"))).where("r <= 2").select("q", "answer")
    shown = top.union(truth.select("q", "gt")).distinct()
    totals = c.groupBy("q", "answer").agg(F.sum("n").alias("n"))
    return shown.join(totals, ["q", "answer"], "left").join(truth, "q").select("q", "answer", (F.col("answer") == F.col("gt")).alias("is_truth"), F.coalesce("n", F.lit(0)).alias("n"))
