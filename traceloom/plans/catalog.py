"""Registered queries over the test tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceloom.functions import confidence, text
from traceloom.operators import grid, sampling, statistics, voting, windows

from . import adapters as A
from .scoreboard import SQL_METHOD_ROWS, experiment

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


W = f"WITH {A.SQL_VOTES}"
FIRST = "first({} ORDER BY w DESC, f)"


@query(f"{W}, t AS (SELECT question_id, answer, count(*) AS n, count(*) AS w, min(idx) AS f FROM votes GROUP BY 1, 2) SELECT question_id, {FIRST.format('answer')} AS voted, sum(n)::BIGINT AS votes FROM t GROUP BY 1")
def majority_vote(spark, d):
    return voting.majority_vote(A.votes(spark, d), ["question_id"]).select("question_id", "voted", "votes")


@query(f"{W}, t AS (SELECT question_id, answer, round(sum(weight), 9) AS w, min(idx) AS f FROM votes GROUP BY 1, 2) SELECT question_id, {FIRST.format('answer')} AS voted, round(max(w), 4) AS weight FROM t GROUP BY 1")
def weighted_vote(spark, d):
    return voting.weighted_vote(A.votes(spark, d), ["question_id"], "weight").select("question_id", "voted", F.round("weight", 4).alias("weight"))


@query(f"{W} SELECT question_id, answer, round(sum(weight), 4) AS weight FROM votes GROUP BY 1, 2")
def vote_weights_map(spark, d):
    got = voting.vote_weights(A.votes(spark, d), ["question_id"], "weight")
    return got.select("question_id", F.explode("weights").alias("answer", "weight")).select("question_id", "answer", F.round("weight", 4).alias("weight"))


@query("SELECT vec_id, round(-list_sum(embedding::DOUBLE[]) / len(embedding), 6) AS confidence FROM embeddings WHERE len(embedding) > 0")
def token_confidence(spark, d):
    e = A.table(spark, d, "embeddings").select("vec_id", F.array(F.col("embedding").cast("array<double>")).alias("lp"))
    conf = confidence.token_confidence("lp", None)
    return e.select("vec_id", F.explode(conf).alias("c")).select("vec_id", F.round("c", 6).alias("confidence"))


@query(f"WITH {A.SQL_TRACES} SELECT trace_idx, num_tokens, round(mean_conf, 6) AS mean_conf, round(tail_conf, 6) AS tail_conf FROM traces")
def mean_tail_conf(spark, d):
    return A.traces(spark, d).select("trace_idx", "num_tokens", F.round("mean_conf", 6).alias("mean_conf"), F.round("tail_conf", 6).alias("tail_conf"))


@query(f"WITH {A.SQL_TOKENS}, {A.sql_windows(128)} SELECT trace_id, pos, round(mean, 3) AS mean FROM win")
def group_confs(spark, d):
    w = windows.trace_windows(A.tokens(spark, d), ["trace_id"], A.TOKEN_ORDER, "conf", 128, 3)
    return w.select("trace_id", "pos", "mean")


@query(f"WITH {A.SQL_TRACES} SELECT trace_idx, round(bottom_conf, 6) AS bottom_conf, round(min_conf, 6) AS min_conf FROM traces")
def bottom_min_window_conf(spark, d):
    return A.traces(spark, d).select("trace_idx", F.round("bottom_conf", 6).alias("bottom_conf"), F.round("min_conf", 6).alias("min_conf"))


@query(f"WITH {A.SQL_TRACES} SELECT trace_idx, round(bottom_conf, 6) AS bottom_conf, round(min_conf, 6) AS min_conf, round(tail_conf, 6) AS tail_conf, round(mean_conf, 6) AS mean_conf FROM traces")
def array_form_conf(spark, d):
    """The metrics over arrays; same results as one token per row."""
    t = A.tokens(spark, d).groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct(*A.TOKEN_ORDER, "conf"))).alias("t"))
    t = t.select(F.col("trace_id").alias("trace_idx"), F.col("t.conf").alias("confs")).withColumn("groups", confidence.sliding_means("confs", 128))
    out = {"bottom_conf": confidence.lowest_mean("groups"), "min_conf": confidence.min_confidence("groups"), "tail_conf": confidence.tail_confidence("confs", 256), "mean_conf": confidence.mean_confidence("confs")}
    return t.select("trace_idx", *[F.round(c, 6).alias(n) for n, c in out.items()])


_PREFIX = "pre AS (SELECT trace_id, conf, pos, least(n, 300) AS n FROM tok WHERE pos <= 300)"


@query(
    f"WITH {A.SQL_TOKENS}, {_PREFIX}, {A.sql_windows(64, 'pre')}, l AS (SELECT trace_id, avg(conf) AS last_mean FROM pre WHERE pos > n - 64 GROUP BY 1)"
    " SELECT trace_id, round(min(mean), 6) AS min_mean, round(max(mean), 6) AS max_mean, round(avg(mean), 6) AS mean_mean, round(any_value(last_mean), 6) AS last_mean FROM win JOIN l USING (trace_id) GROUP BY 1"
)
def probe_window_metrics(spark, d):
    """Window metrics of each trace's first 300 tokens."""
    pre = windows.first_rows(A.tokens(spark, d), ["trace_id"], A.TOKEN_ORDER, 300)
    w = windows.trace_windows(pre, ["trace_id"], A.TOKEN_ORDER, "conf", 64)
    last = F.max_by("mean", "pos")
    return w.groupBy("trace_id").agg(F.round(F.min("mean"), 6).alias("min_mean"), F.round(F.max("mean"), 6).alias("max_mean"), F.round(F.avg("mean"), 6).alias("mean_mean"), F.round(last, 6).alias("last_mean"))


@query(
    f"WITH {A.SQL_TOKENS} SELECT trace_id, pos AS depth, round(c, 6) AS confidence FROM (SELECT trace_id, pos, n, avg(conf) OVER (PARTITION BY trace_id ORDER BY pos ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS c FROM tok) WHERE pos % 128 = 0 OR pos = n"
)
def checkpoint_conf(spark, d):
    """Mean of up to 64 tokens before each probing depth (multiples of 128 and the end)."""
    w = Window.partitionBy("trace_id").orderBy(*A.TOKEN_ORDER)
    tok = A.tokens(spark, d).withColumn("pos", F.row_number().over(w)).withColumn("s", F.sum("conf").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tok = tok.withColumn("c", (F.col("s") - F.coalesce(F.lag("s", 64).over(w), F.lit(0.0))) / F.least("pos", F.lit(64)))
    n = F.count("*").over(Window.partitionBy("trace_id"))
    return tok.withColumn("n", n).where("pos % 128 = 0 OR pos = n").select("trace_id", F.col("pos").alias("depth"), F.round("c", 6).alias("confidence"))


@query(f"WITH {A.SQL_TOKENS} SELECT trace_id, unnest(list_distinct(list_concat(range(128, n + 1, 128), [n]))) AS depth FROM (SELECT DISTINCT trace_id, n FROM tok)")
def probe_depths(spark, d):
    n = A.tokens(spark, d).groupBy("trace_id").agg(F.count("*").cast("int").alias("n"))
    return n.select("trace_id", F.explode(text.depths("n", 128).cast("array<bigint>")).alias("depth"))


@query(f"WITH {A.SQL_TRACES} SELECT question_id, round(quantile_cont(min_conf, 0.9), 6) AS bar FROM traces WHERE trace_idx % 2 = 0 GROUP BY 1")
def conf_bar(spark, d):
    """Calibration: the 90th percentile of the warm-up traces' minimum confidence."""
    warm = A.traces(spark, d).where("trace_idx % 2 = 0")
    return warm.groupBy("question_id").agg(F.round(F.percentile("min_conf", F.lit(0.9)), 6).alias("bar"))


@query(
    f"WITH {A.SQL_TOKENS}, {A.sql_windows(128)}, s AS (SELECT trace_id, max(n) AS n_tokens, min(pos) FILTER (WHERE mean < 23.0) AS stop_at FROM win GROUP BY 1)"
    " SELECT trace_id, n_tokens, least(coalesce(stop_at, n_tokens), n_tokens) AS kept_tokens, greatest(least(coalesce(stop_at, n_tokens), n_tokens) - 127, 1) AS n_windows, stop_at IS NOT NULL AS stopped FROM s"
)
def early_stop(spark, d):
    return windows.early_stop(A.tokens(spark, d), ["trace_id"], A.TOKEN_ORDER, "conf", 128, F.lit(23.0))


def _online(traces: DataFrame) -> DataFrame:
    """Votes of the online scheme: warm-up traces calibrate a bar, traces of either phase below it lose their vote."""
    traces = traces.withColumn("phase", F.when(F.col("trace_idx") % 2 == 0, 0).otherwise(1))
    bar = F.percentile(F.when(F.col("phase") == 0, F.col("min_conf")), F.lit(0.5)).over(Window.partitionBy("question_id"))
    kept = traces.withColumn("bar", F.round(bar, 9)).where(F.round("min_conf", 9) >= F.col("bar")).where(voting.has_answer("answer"))
    return voting.weighted_vote(kept.withColumn("idx", F.struct("phase", "trace_idx")).withColumn("idx", F.col("phase") * (1 << 40) + F.col("trace_idx")), ["question_id"], "min_conf")


@query(
    f"WITH {A.SQL_TRACES}, b AS (SELECT question_id, round(quantile_cont(min_conf, 0.5), 9) AS bar FROM traces WHERE trace_idx % 2 = 0 GROUP BY 1),"
    " t AS (SELECT question_id, answer, count(*) AS n, round(sum(min_conf), 9) AS w, min(trace_idx % 2 * 1099511627776 + trace_idx) AS f FROM traces JOIN b USING (question_id) WHERE round(min_conf, 9) >= bar GROUP BY 1, 2)"
    " SELECT question_id, first(answer ORDER BY w DESC, f) AS voted, sum(n)::BIGINT AS votes, round(max(w), 4) AS weight FROM t GROUP BY 1"
)
def online_vote(spark, d):
    return _online(A.traces(spark, d)).select("question_id", "voted", "votes", F.round("weight", 4).alias("weight"))


@query(
    f"{W}, b AS (SELECT question_id, quantile_cont(weight, 0.9) AS bar FROM votes GROUP BY 1), t AS (SELECT v.question_id, answer, count(*) AS n, round(sum(weight), 9) AS w, min(idx) AS f FROM votes v JOIN b ON v.question_id = b.question_id WHERE round(weight, 6) >= round(bar, 6) GROUP BY 1, 2)"
    f" SELECT question_id, {FIRST.format('answer')} AS voted, sum(n)::BIGINT AS votes FROM t GROUP BY 1"
)
def top_percentile_vote(spark, d):
    v = A.votes(spark, d)
    bar = F.percentile("weight", F.lit(0.9)).over(Window.partitionBy("question_id"))
    kept = v.withColumn("bar", bar).where(F.round("weight", 6) >= F.round("bar", 6))
    return voting.weighted_vote(kept, ["question_id"], "weight").select("question_id", "voted", "votes")


@query(
    f"WITH {A.SQL_CHECKPOINTS}, e AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY confidence DESC, trace, prob_token) AS r, count(*) OVER (PARTITION BY run_id) AS c FROM ckpt WHERE (is_warmup OR is_naturally_stopped) AND NOT is_deep_conf_truncated AND NOT is_out_of_budget),"
    " t AS (SELECT run_id, answer, count(*) AS n, round(sum(confidence), 9) AS w, min(r) AS f FROM e WHERE r <= greatest(1, ceil(0.9::DOUBLE * c)) GROUP BY 1, 2) SELECT run_id, first(answer ORDER BY w DESC, f) AS voted, sum(n)::BIGINT AS votes FROM t GROUP BY 1"
)
def top_eta_vote(spark, d):
    c = windows.numbered(A.checkpoints(spark, d).where(voting.eligible()), ["run_id"], ["trace", "prob_token"], "cell")
    kept = voting.top_share(c, ["run_id"], "confidence", "cell", 0.9)
    kept = kept.withColumn("idx", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("confidence"), "cell")))
    return voting.weighted_vote(kept, ["run_id"], "confidence").select("run_id", "voted", "votes")


def records(spark: SparkSession, d: str) -> DataFrame:
    return experiment(A.with_truths(A.traces(spark, d)), None, ["question_id"])


SQL_RECORDS = f"WITH {A.SQL_TRACES}, {SQL_METHOD_ROWS}"


@query(f"{SQL_RECORDS} SELECT voting_method, count(*) AS n, sum(is_correct::INT)::BIGINT AS n_correct, round(avg(is_correct::INT), 4) AS accuracy, round(avg(num_votes), 4) AS mean_votes, round(avg(avg_confidence), 4) AS mean_confidence FROM records GROUP BY 1")
def voting_scoreboard(spark, d):
    return statistics.scoreboard(records(spark, d), ["voting_method"])


@query(f"{SQL_RECORDS} SELECT question_id, voting_method, predicted_answer, ground_truth, is_correct, num_votes, round(avg_confidence, 6) AS avg_confidence FROM records")
def seven_method_experiment(spark, d):
    return records(spark, d).select("question_id", "voting_method", "predicted_answer", "ground_truth", "is_correct", "num_votes", F.round("avg_confidence", 6).alias("avg_confidence"))


@query(
    f"{SQL_RECORDS} SELECT CASE WHEN grouping(model) = 1 THEN NULL ELSE model END AS model, voting_method, count(*) AS n, sum(is_correct::INT)::BIGINT AS n_correct, round(avg(is_correct::INT), 4) AS accuracy"
    " FROM (SELECT *, 'm' || (question_id % 2) AS model FROM records) GROUP BY GROUPING SETS ((voting_method), (model, voting_method))"
)
def scoreboard_grouping_sets(spark, d):
    r = records(spark, d).withColumn("model", F.concat(F.lit("m"), (F.col("question_id") % 2).cast("string")))
    return statistics.scoreboard_sets(r, "model", "voting_method")


@query(
    f"{W}, m AS (SELECT answer AS method, avg(weight) AS cost, avg(CASE WHEN idx % 3 = 0 THEN 1 ELSE 0 END) AS accuracy FROM votes GROUP BY 1), v AS (SELECT * FROM m WHERE method = 'view')"
    " SELECT m.method, round(m.cost, 6) AS cost, round(m.accuracy, 6) AS accuracy, round(m.cost - v.cost, 6) AS cost_delta, round(100 * (m.cost - v.cost) / v.cost, 4) AS cost_delta_pct, round(m.accuracy - v.accuracy, 6) AS accuracy_delta FROM m, v"
)
def method_delta(spark, d):
    v = A.votes(spark, d).select(F.col("answer").alias("method"), F.col("weight").alias("cost"), F.when(F.col("idx") % 3 == 0, 1).otherwise(0).alias("accuracy"))
    got = statistics.method_delta(v, "method", "view", ["cost", "accuracy"])
    return got.select("method", F.round("cost", 6).alias("cost"), F.round("accuracy", 6).alias("accuracy"), F.round("cost_delta", 6).alias("cost_delta"), F.round("cost_delta_pct", 4).alias("cost_delta_pct"), F.round("accuracy_delta", 6).alias("accuracy_delta"))


@query(f"{W} SELECT question_id, answer, count(*) AS n, round(avg(weight), 7) AS mean_weight, count(DISTINCT run) AS n_runs FROM votes GROUP BY 1, 2")
def question_method_summary(spark, d):
    return A.votes(spark, d).groupBy("question_id", "answer").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 7).alias("mean_weight"), F.count_distinct("run").alias("n_runs"))


@query(
    f"WITH {A.SQL_TOKENS}, t AS (SELECT DISTINCT trace_id, n FROM tok) SELECT trace_id % 10 AS question_id, count(*) FILTER (WHERE n <= 600) AS n_within, sum(least(n, 600))::BIGINT AS capped_tokens, round(avg(n) FILTER (WHERE n <= 600), 6) AS mean_within FROM t GROUP BY 1"
)
def token_cap_metrics(spark, d):
    n = A.tokens(spark, d).groupBy("trace_id").agg(F.count("*").alias("n")).withColumn("question_id", F.col("trace_id") % 10)
    return statistics.capped_tokens(n, ["question_id"], "n", 600).withColumn("mean_within", F.round("mean_within", 6))


def trace_finals_of(checkpoints: DataFrame) -> DataFrame:
    """One row per (run, trace): last answer by (usage, checkpoint), usage, least confidence, any flag; a null usage ranks last."""
    order = F.struct(F.coalesce(F.col("token_usage").cast("double"), F.lit(float("inf"))), F.col("prob_token"))
    last = F.max_by(F.struct("answer", "token_usage"), order)
    flags = ["is_warmup", "is_deep_conf_truncated", "is_naturally_stopped", "is_out_of_budget"]
    got = checkpoints.groupBy("run_id", "trace").agg(
        last.alias("_l"), F.coalesce(F.min("confidence"), F.lit(0.0)).alias("trace_confidence"), *[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags]
    )
    return got.select("run_id", "trace", F.col("_l.answer").alias("final_answer"), F.coalesce("_l.token_usage", F.lit(0)).alias("final_token_usage"), "trace_confidence", *flags)


SQL_FINALS = (
    f"WITH {A.SQL_CHECKPOINTS}, finals AS (SELECT run_id, trace, arg_max(answer, token_usage * 10000000 + prob_token) AS final_answer, max(token_usage) AS final_token_usage, min(confidence) AS trace_confidence,"
    " bool_or(is_warmup) AS is_warmup, bool_or(is_deep_conf_truncated) AS is_deep_conf_truncated, bool_or(is_naturally_stopped) AS is_naturally_stopped, bool_or(is_out_of_budget) AS is_out_of_budget FROM ckpt GROUP BY 1, 2)"
)


@query(f"{SQL_FINALS} SELECT * FROM finals")
def trace_finals(spark, d):
    return trace_finals_of(A.checkpoints(spark, d))


def budget_details(finals: DataFrame, truths: DataFrame, budgets: list[int], share: float = 0.9) -> DataFrame:
    """run_id, budget, total_tokens, pred, correct, n_selected, n_voting: the vote among each run's first traces."""
    ranked = windows.numbered(finals, ["run_id"], ["trace"], "rn").withColumn("votes", voting.eligible(False, False))
    # Budgets are parameters: each row is repeated once per budget that includes it.
    spread = ranked.withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).where("rn <= budget")
    keys = ["run_id", "budget"]
    totals = spread.groupBy(*keys).agg(F.sum("final_token_usage").alias("total_tokens"), F.count("*").alias("n_selected"), F.count_if("votes").alias("n_voting"))
    voters = voting.top_share(spread.where("votes"), keys, "trace_confidence", "rn", share)
    voters = voters.withColumn("rk", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("trace_confidence"), "rn")))
    voted = voting.weighted_vote(voters, keys, "trace_confidence", "final_answer", "rk").select(*keys, F.col("voted").alias("pred"))
    return totals.join(voted, keys, "left").join(truths, "run_id", "left").withColumn("correct", F.col("pred") == F.col("ground_truth"))


@query(
    f"{SQL_FINALS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY trace) AS rn, is_warmup OR is_naturally_stopped AS votes FROM finals), budgets AS (SELECT unnest([1, 2, 3, 5]) AS budget),"
    " spread AS (SELECT * FROM ranked, budgets WHERE rn <= budget), totals AS (SELECT run_id, budget, sum(final_token_usage)::BIGINT AS total_tokens FROM spread GROUP BY 1, 2),"
    " v AS (SELECT *, row_number() OVER (PARTITION BY run_id, budget ORDER BY trace_confidence DESC, rn) AS rk, count(*) OVER (PARTITION BY run_id, budget) AS c FROM spread WHERE votes),"
    " t AS (SELECT run_id, budget, final_answer, round(sum(trace_confidence), 9) AS w, min(rk) AS f FROM v WHERE rk <= greatest(1, ceil(0.9::DOUBLE * c)) GROUP BY 1, 2, 3),"
    " p AS (SELECT run_id, budget, first(final_answer ORDER BY w DESC, f) AS pred FROM t GROUP BY 1, 2), g AS (SELECT run_id, arg_min(final_answer, trace) AS ground_truth FROM finals GROUP BY 1)"
    " SELECT budget, round(avg(total_tokens), 6) AS mean_tokens, round(avg((pred = ground_truth)::INT), 6) AS mean_acc, count(pred = ground_truth) AS n_trials FROM totals LEFT JOIN p USING (run_id, budget) JOIN g USING (run_id) GROUP BY 1"
)
def budget_curve(spark, d):
    finals = trace_finals_of(A.checkpoints(spark, d))
    truth = finals.groupBy("run_id").agg(F.min_by("final_answer", "trace").alias("ground_truth"))
    details = budget_details(finals, truth, [1, 2, 3, 5])
    return details.groupBy("budget").agg(F.round(F.avg("total_tokens"), 6).alias("mean_tokens"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("mean_acc"), F.count("correct").alias("n_trials"))


def _grid_query(leading: bool, files: bool, traces: bool):
    def run(spark: SparkSession, d: str) -> DataFrame:
        seen = A.checkpoints(spark, d)
        depths = seen.select("prob_token").distinct()
        cells = seen.select("run_id", "trace", "prob_token", "answer", "confidence", "token_usage")
        out = grid.fill_grid(cells, ["run_id"], seen, depths, None, files, traces, leading)
        return out.select("run_id", "trace", "prob_token", "answer", "confidence", "token_usage", "observed", "is_propagated_file", "is_propagated_trace", "is_propagated", "source_prob_token")

    fill = "last_value({c} IGNORE NULLS) OVER w"
    if leading:
        fill = "coalesce(last_value({c} IGNORE NULLS) OVER w, first_value({c} IGNORE NULLS) OVER (PARTITION BY run_id, trace ORDER BY prob_token ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    take = f"(observed OR (NOT f AND {files}) OR (f AND NOT observed AND {traces}))"
    values = ", ".join(f"CASE WHEN {take} THEN {c}_f END AS {c}" for c in ("answer", "confidence", "token_usage", "source_prob_token"))
    filled = ", ".join(f"{fill.format(c=c)} AS {c}_f" for c in ("answer", "confidence", "token_usage", "source_prob_token"))
    sql = (
        f"WITH {A.SQL_CHECKPOINTS}, g AS (SELECT * FROM (SELECT DISTINCT run_id, trace FROM ckpt), (SELECT DISTINCT prob_token FROM ckpt)),"
        " c AS (SELECT g.run_id, g.trace, g.prob_token, k.answer, k.confidence, k.token_usage, k.run_id IS NOT NULL AS observed, k.prob_token AS source_prob_token, bool_or(k.run_id IS NOT NULL) OVER (PARTITION BY g.run_id, g.prob_token) AS f"
        " FROM g LEFT JOIN ckpt k ON g.run_id = k.run_id AND g.trace = k.trace AND g.prob_token = k.prob_token),"
        f" x AS (SELECT run_id, trace, prob_token, observed, f, {filled} FROM c WINDOW w AS (PARTITION BY run_id, trace ORDER BY prob_token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
        f" SELECT run_id, trace, prob_token, {values}, observed, NOT f AND {files} AS is_propagated_file, f AND NOT observed AND {traces} AS is_propagated_trace, (NOT f AND {files}) OR (f AND NOT observed AND {traces}) AS is_propagated FROM x"
        + ("" if files else " WHERE f")
    )
    return run, sql


for _name, _flags in {"grid_fill": (False, True, True), "grid_fill_leading": (True, True, True), "grid_fill_no_files": (False, False, True), "grid_fill_no_traces": (False, True, False)}.items():
    QUERIES[_name], ORACLE_SQL[_name] = _grid_query(*_flags)


@query(
    f"{W}, t AS (SELECT question_id, answer, count(*) AS n FROM votes GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY question_id) AS s FROM t)"
    " SELECT question_id, round(-sum(s * ln(s)), 6) AS entropy, round(-sum(s * log2(s)), 6) AS entropy2, CASE count(*) WHEN 1 THEN 1.0 ELSE round(1 - -sum(s * ln(s)) / ln(count(*)), 3) END AS confidence FROM p GROUP BY 1"
)
def answer_entropy(spark, d):
    t = A.votes(spark, d).groupBy("question_id", "answer").agg(F.count("*").alias("n"))
    e = statistics.entropy(t, ["question_id"], "n").join(statistics.entropy(t, ["question_id"], "n", "2", "entropy2").select("question_id", "entropy2"), "question_id")
    return e.select("question_id", F.round("entropy", 6).alias("entropy"), F.round("entropy2", 6).alias("entropy2"), statistics.normalised_confidence().alias("confidence"))


@query(
    f"{W}, t AS (SELECT question_id, answer, count(*) AS n, count(*) AS w, min(idx) AS f FROM votes GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY question_id) AS s FROM t)"
    " SELECT question_id, first(answer ORDER BY w DESC, f) AS majority, round(max(s), 6) AS ratio, count(*) AS n_unique, round(-sum(s * ln(s)), 6) AS entropy, first(answer ORDER BY w DESC, f) = any_value(ground_truth) AS is_correct, round(coalesce(sum(n) FILTER (WHERE answer = ground_truth), 0) / sum(n), 6) AS accuracy FROM p JOIN truths USING (question_id) GROUP BY 1"
)
def distribution_summary(spark, d):
    """Majority, its share, distinct answers, entropy and exact-match accuracy of each question's answers."""
    v = A.votes(spark, d)
    t = voting.tally(v, ["question_id"], "answer", None, "idx")
    e = statistics.entropy(t, ["question_id"], "n").select("question_id", "entropy", F.col("k").alias("n_unique"))
    best = voting.argmax_first(t, ["question_id"], "answer", "majority").select("question_id", "majority", (F.col("weight") / F.col("votes")).alias("ratio"))
    j = t.join(A.truths(spark, d), "question_id").groupBy("question_id").agg(F.max("ground_truth").alias("gt"), (F.sum(F.when(F.col("answer") == F.col("ground_truth"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    out = best.join(e, "question_id").join(j, "question_id")
    return out.select("question_id", "majority", F.round("ratio", 6).alias("ratio"), "n_unique", F.round("entropy", 6).alias("entropy"), (F.col("majority") == F.col("gt")).alias("is_correct"), F.round("accuracy", 6).alias("accuracy"))


@query(f"WITH {A.SQL_CHECKPOINTS}, t AS (SELECT run_id, answer, count(*) AS n FROM ckpt WHERE token_usage <= 10 GROUP BY 1, 2 HAVING count(*) >= 2) SELECT run_id, string_agg(answer, ',' ORDER BY n DESC, answer) AS candidates, count(*) AS n_candidates FROM t GROUP BY 1")
def candidates(spark, d):
    """Answers seen at least twice within the token budget, most frequent first."""
    t = A.checkpoints(spark, d).where("token_usage <= 10").groupBy("run_id", "answer").agg(F.count("*").alias("n")).where("n >= 2")
    got = t.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "answer"))).alias("c"))
    return got.select("run_id", F.array_join("c.answer", ",").alias("candidates"), F.size("c").cast("long").alias("n_candidates"))


@query(
    f"{W}, c AS (SELECT question_id % 10 AS q, run, (idx % 4)::INT AS ck, answer, count(*) AS n FROM (SELECT * FROM votes) GROUP BY 1, 2, 3, 4), s AS (SELECT *, n / sum(n) OVER (PARTITION BY q, run, ck) AS share FROM c),"
    " runs AS (SELECT DISTINCT q, ck, run FROM c), tops AS (SELECT q, answer FROM (SELECT q, ck, answer, row_number() OVER (PARTITION BY q, ck ORDER BY sum(n) DESC, answer) AS r FROM c GROUP BY 1, 2, 3) WHERE r <= 3 GROUP BY 1, 2),"
    " dense AS (SELECT runs.q, runs.ck, runs.run, tops.answer, coalesce(s.share, 0.0) AS share FROM runs JOIN tops USING (q) LEFT JOIN s ON s.q = runs.q AND s.ck = runs.ck AND s.run = runs.run AND s.answer = tops.answer)"
    " SELECT q, ck, answer, round(avg(share), 6) AS mean, round(stddev_pop(share), 6) AS std, round(least(avg(share) + stddev_pop(share), 1), 6) AS high, round(greatest(avg(share) - stddev_pop(share), 0), 6) AS low FROM dense GROUP BY 1, 2, 3"
)
def answer_trends(spark, d):
    """Mean and population deviation over runs of each top answer's share at each checkpoint; absent counts as 0."""
    v = A.votes(spark, d).select((F.col("question_id") % 10).alias("q"), "run", (F.col("idx") % 4).cast("int").alias("ck"), "answer")
    c = v.groupBy("q", "run", "ck", "answer").agg(F.count("*").alias("n"))
    s = statistics.shares(c, ["q", "run", "ck"])
    totals = c.groupBy("q", "ck", "answer").agg(F.sum("n").alias("n"))
    tops = totals.withColumn("r", F.row_number().over(Window.partitionBy("q", "ck").orderBy(F.desc("n"), "answer"))).where("r <= 3").select("q", "answer").distinct()
    dense = c.select("q", "ck", "run").distinct().join(tops, "q").join(s.drop("n"), ["q", "ck", "run", "answer"], "left").fillna(0.0, ["share"])
    m, sd = F.avg("share"), F.stddev_pop("share")
    return dense.groupBy("q", "ck", "answer").agg(F.round(m, 6).alias("mean"), F.round(sd, 6).alias("std"), F.round(F.least(m + sd, F.lit(1.0)), 6).alias("high"), F.round(F.greatest(m - sd, F.lit(0.0)), 6).alias("low"))


_STEPS = "st AS (SELECT question_id, (idx // 400)::BIGINT AS step, answer, count(*) AS n FROM votes GROUP BY 1, 2, 3), h AS (SELECT question_id, step, round(-sum(s * log2(s)), 9) AS h FROM (SELECT *, n / sum(n) OVER (PARTITION BY question_id, step) AS s FROM st) GROUP BY 1, 2)"


@query(
    f"{W}, {_STEPS}, r AS (SELECT *, row_number() OVER w AS k, lag(h) OVER w AS p FROM h WINDOW w AS (PARTITION BY question_id ORDER BY step)), f AS (SELECT *, min((h < p)::INT) OVER (PARTITION BY question_id ORDER BY step ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS d FROM r)"
    " SELECT question_id, min(step) FILTER (WHERE k >= 3 AND d = 1 AND h <= 1.2) AS stop_step, max(step) AS last_step FROM f GROUP BY 1"
)
def entropy_stop(spark, d):
    """First step at which the answers' entropy has fallen strictly over three steps and is at least 0.2 below 1.4."""
    v = A.votes(spark, d).withColumn("step", F.floor(F.col("idx") / 400))
    t = v.groupBy("question_id", "step", "answer").agg(F.count("*").alias("n"))
    h = statistics.entropy(t, ["question_id", "step"], "n", "2", "h").withColumn("h", F.round("h", 9))
    f = windows.strictly_falling(h, ["question_id"], "step", "h", 3)
    stop = F.min(F.when(F.col("falling") & (F.col("h") <= 1.2), F.col("step")))
    return f.groupBy("question_id").agg(stop.alias("stop_step"), F.max("step").alias("last_step"))


@query(
    f"WITH {A.SQL_CHECKPOINTS}, g AS (SELECT run_id, arg_min(answer, prob_token * 100 + ascii(trace) % 100) AS gt FROM ckpt GROUP BY 1) SELECT prob_token, count(*) AS n_probed, sum((answer = gt)::INT)::BIGINT AS n_correct, count(DISTINCT run_id) AS n_runs FROM ckpt JOIN g USING (run_id) GROUP BY 1"
)
def depth_table(spark, d):
    c = A.checkpoints(spark, d)
    gt = c.groupBy("run_id").agg(F.min_by("answer", F.col("prob_token") * 100 + F.ascii("trace") % 100).alias("gt"))
    j = c.join(gt, "run_id")
    return j.groupBy("prob_token").agg(F.count("*").alias("n_probed"), F.sum((F.col("answer") == F.col("gt")).cast("int")).alias("n_correct"), F.count_distinct("run_id").alias("n_runs"))


@query(f"WITH {A.SQL_CHECKPOINTS} SELECT run_id, count(*) AS n_traces, sum(c::INT)::BIGINT AS n_correct FROM (SELECT run_id, trace, arg_max(is_naturally_stopped, prob_token) AS c FROM ckpt GROUP BY 1, 2) GROUP BY 1")
def final_probe_accuracy(spark, d):
    """Correctness at each trace's deepest probe (the flag stands for it), summed by run."""
    last = A.checkpoints(spark, d).groupBy("run_id", "trace").agg(F.max_by("is_naturally_stopped", "prob_token").alias("c"))
    return last.groupBy("run_id").agg(F.count("*").alias("n_traces"), F.sum(F.col("c").cast("int")).alias("n_correct"))


@query(f"{W} SELECT answer, CASE WHEN count(DISTINCT idx % 3 = 0) >= 2 THEN round(corr((idx % 3 = 0)::INT::DOUBLE, weight), 4) END AS r, count(*) AS n FROM votes GROUP BY 1")
def pearson_conf(spark, d):
    v = A.votes(spark, d).withColumn("ok", (F.col("idx") % 3 == 0).cast("int"))
    return v.groupBy("answer").agg(statistics.pearson("ok", "weight").alias("r"), F.count("*").alias("n"))


@query(f"{W} SELECT question_id, round(exp(avg(ln(weight + 1))) - 1, 6) AS geo_mean FROM votes GROUP BY 1")
def geo_mean_shift1(spark, d):
    return A.votes(spark, d).groupBy("question_id").agg(F.round(statistics.shift_geometric_mean("weight"), 6).alias("geo_mean"))


@query(f"WITH {A.SQL_CHECKPOINTS}, want AS (SELECT * FROM (SELECT DISTINCT run_id FROM ckpt), (SELECT DISTINCT prob_token FROM ckpt)) SELECT run_id, prob_token FROM want EXCEPT SELECT run_id, prob_token FROM ckpt")
def missing_indices(spark, d):
    """Resume: expected (run, checkpoint) files that do not exist."""
    c = A.checkpoints(spark, d)
    span = c.agg(F.min("prob_token"), F.max("prob_token")).first()
    want = c.select("run_id").distinct().withColumn("prob_token", F.explode(F.sequence(F.lit(span[0]), F.lit(span[1]), F.lit(2048)))) if span[0] else c.select("run_id", "prob_token")
    return want.join(c, ["run_id", "prob_token"], "left_anti")


@query(
    f"WITH {A.SQL_TOKENS}, t AS (SELECT DISTINCT trace_id, n FROM tok), e AS (SELECT trace_id, unnest(list_distinct(list_concat(range(128, n + 1, 128), [n]))) AS depth FROM t), f AS (SELECT *, (trace_id + depth) % 11 <> 0 AS found FROM e)"
    " SELECT trace_id, count(*) AS expected, count(*) FILTER (WHERE found) AS present, bool_and(found) AS done FROM f GROUP BY 1"
)
def complete_traces(spark, d):
    """Relational division: a trace is done if every expected depth is present."""
    e = probe_depths(spark, d)
    have = e.where((F.col("trace_id") + F.col("depth")) % 11 != 0).withColumn("found", F.lit(True))
    j = e.join(have, ["trace_id", "depth"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return j.groupBy("trace_id").agg(F.count("*").alias("expected"), F.count_if("found").alias("present"), F.bool_and("found").alias("done"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS answer FROM orders")
def answer_extract(spark, d):
    """Balanced-brace extraction from texts that wrap a number, some without a box."""
    o = A.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    body = F.concat(F.lit("so \\boxed{1} or \\boxed{"), F.col("o_custkey").cast("string"), F.lit("} $x$"))
    t = o.withColumn("t", F.when(F.col("o_orderkey") % 3 == 0, F.lit("no answer")).otherwise(body))
    return t.select("o_orderkey", text.extract_answer("t").alias("answer"))


@query("SELECT o_orderkey, coalesce(nullif(trim(CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE ' ' || o_orderpriority || ' ' END), ''), '<EMPTY>') AS answer FROM orders")
def normalize_answer(spark, d):
    o = A.table(spark, d, "orders")
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.lit(None)).when(F.col("o_orderkey") % 4 == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))
    return o.select("o_orderkey", text.normalize_answer(raw).alias("answer"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'original' ELSE 'unknown' END AS method, CASE WHEN o_orderkey % 3 = 2 THEN 0 ELSE CAST(o_custkey AS INT) END AS question_id, CASE WHEN o_orderkey % 3 < 2 THEN 'r' || o_orderkey END AS run_id FROM orders")
def parse_file_name(spark, d):
    o = A.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    stem = F.concat(F.lit("qid"), F.col("o_custkey").cast("string"), F.lit("_rid"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")), F.lit("_20250101_120000.pkl"))
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("run_simple_"), stem)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("run_"), stem)).otherwise(F.lit("other.pkl"))
    return o.withColumn("p", text.parse_file_name(name)).select("o_orderkey", "p.method", "p.question_id", "p.run_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 1 AS n_keys, strlen(replace(props, ' ', '')) AS compact_bytes FROM events")
def json_value_size(spark, d):
    e = A.table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), text.json_size("props").alias("n_keys"), text.json_bytes("props").alias("compact_bytes"))


_DRAW = "(((((b * 7919 + s * 104729 + 12345) % 2147483647) * 48271) % 2147483647) * 48271) % 2147483647"


@query(
    f"{W}, p AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY idx) - 1 AS pos, count(*) OVER (PARTITION BY question_id) AS c FROM votes), g AS (SELECT DISTINCT question_id, c FROM p),"
    f" sl AS (SELECT question_id, c, b, s, {_DRAW} % c AS pos FROM g, (SELECT unnest(range(0, 8)) AS b), (SELECT unnest(range(0, 32)) AS s) WHERE s < least(32, c)),"
    " t AS (SELECT sl.question_id, b, answer, count(*) AS n, round(sum(weight), 9) AS w, min(s) AS f FROM sl JOIN p ON p.question_id = sl.question_id AND p.pos = sl.pos GROUP BY 1, 2, 3),"
    " v AS (SELECT question_id, b, first(answer ORDER BY w DESC, f) AS voted FROM t GROUP BY 1, 2) SELECT question_id, count(*) AS n, round(avg((voted = ground_truth)::INT), 4) AS accuracy, round(stddev_samp((voted = ground_truth)::INT), 4) AS accuracy_std FROM v JOIN truths USING (question_id) GROUP BY 1"
)
def bootstrap_vote(spark, d):
    """Weighted votes over 8 resamples of 32 votes, with the sample deviation of their accuracy."""
    sample = sampling.bootstrap(A.votes(spark, d), ["question_id"], "idx", 8, 32)
    voted = voting.weighted_vote(sample, ["question_id", "bootstrap_idx"], "weight", "answer", "slot")
    ok = (F.col("voted") == F.col("ground_truth")).cast("int")
    j = voted.join(A.truths(spark, d), "question_id").withColumn("ok", ok)
    return j.groupBy("question_id").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 4).alias("accuracy"), F.round(F.stddev_samp("ok"), 4).alias("accuracy_std"))


@query(
    f"{W}, g AS (SELECT question_id, answer, weight, CASE WHEN run < 4 THEN 'completed' ELSE 'truncated' END AS grp, idx FROM votes), u AS (SELECT * FROM g UNION ALL SELECT question_id, answer, weight, 'combined', idx FROM g),"
    " i AS (SELECT question_id, grp, 'weight' AS indicator, answer, weight AS x, idx FROM u UNION ALL SELECT question_id, grp, 'count', answer, 1.0, idx FROM u), t AS (SELECT question_id, grp, indicator, answer, count(*) AS n, round(sum(x), 9) AS w, min(idx) AS f FROM i GROUP BY 1, 2, 3, 4)"
    " SELECT question_id, grp, indicator, first(answer ORDER BY w DESC, f) AS voted, sum(n)::BIGINT AS votes FROM t GROUP BY 1, 2, 3"
)
def structured_vote(spark, d):
    """Votes by several indicators over completed, truncated and all traces, in one plan."""
    v = A.votes(spark, d).withColumn("grp", F.explode(F.array(F.when(F.col("run") < 4, "completed").otherwise("truncated"), F.lit("combined"))))
    cells = F.explode(F.array(F.struct(F.lit("weight").alias("i"), F.col("weight").alias("x")), F.struct(F.lit("count").alias("i"), F.lit(1.0).alias("x")))).alias("c")
    rows = v.select("question_id", "grp", "answer", "idx", cells).select("question_id", "grp", F.col("c.i").alias("indicator"), "answer", "idx", F.col("c.x").alias("x"))
    return voting.weighted_vote(rows, ["question_id", "grp", "indicator"], "x").select("question_id", "grp", "indicator", "voted", "votes")


@query(
    f"{W}, s AS (SELECT question_id, answer, count(*) AS n, round(sum(weight), 6) AS total, round(min(weight), 6) AS low, round(max(weight), 6) AS high, round(avg(weight), 6) AS mean FROM votes GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, answer) AS place FROM s"
)
def answer_metric_sums(spark, d):
    """Counts and window metrics per answer, most frequent first."""
    w = F.col("weight")
    s = A.votes(spark, d).groupBy("question_id", "answer").agg(F.count("*").alias("n"), F.round(F.sum(w), 6).alias("total"), F.round(F.min(w), 6).alias("low"), F.round(F.max(w), 6).alias("high"), F.round(F.avg(w), 6).alias("mean"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("n"), "answer")))


@query(
    "SELECT o_orderkey % 100 AS question_id, count(*) AS n, count(c_custkey) AS matched, count(*) FILTER (WHERE c_custkey IS NULL) AS missing, round(sum(coalesce(c_acctbal, o_totalprice)), 2) AS total FROM orders LEFT JOIN customer ON c_custkey = o_custkey + 5 GROUP BY 1"
)
def merge_with_fallback(spark, d):
    """Left join on a position with fallback values and counters of matched and missing rows."""
    o, c = A.table(spark, d, "orders"), A.table(spark, d, "customer")
    j = o.join(c, c.c_custkey == o.o_custkey + 5, "left")
    return j.groupBy((F.col("o_orderkey") % 100).alias("question_id")).agg(
        F.count("*").alias("n"), F.count("c_custkey").alias("matched"), F.count_if(F.col("c_custkey").isNull()).alias("missing"), F.round(F.sum(F.coalesce("c_acctbal", "o_totalprice")), 2).alias("total")
    )


@query(f"{W}, a AS (SELECT question_id, list_distinct(list(answer)) AS x FROM votes WHERE run < 3 GROUP BY 1), b AS (SELECT question_id, list_distinct(list(answer)) AS y FROM votes WHERE run >= 6 GROUP BY 1) SELECT question_id, len(list_intersect(x, y))::INT AS shared, round(len(list_intersect(x, y)) / greatest(len(list_distinct(list_concat(x, y))), 1), 6) AS jaccard FROM a JOIN b USING (question_id)")
def set_overlap(spark, d):
    v = A.votes(spark, d)
    x = v.where("run < 3").groupBy("question_id").agg(F.collect_set("answer").alias("x"))
    y = v.where("run >= 6").groupBy("question_id").agg(F.collect_set("answer").alias("y"))
    j = x.join(y, "question_id")
    return j.select("question_id", F.size(F.array_intersect("x", "y")).alias("shared"), F.round(text.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query(
    "SELECT o_orderkey, CASE WHEN length(o_orderpriority || o_orderstatus || 'xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx') > 40 THEN substr(o_orderpriority || o_orderstatus || 'xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx', 1, 40) || '...' ELSE o_orderpriority || o_orderstatus || 'xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx' END AS short,"
    " right(o_orderpriority, 4) AS tail, replace(o_orderpriority, '-', chr(10)) AS lines, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp, CASE WHEN o_orderkey % 5 > 0 THEN round(o_totalprice / (o_orderkey % 5), 4) ELSE 0.0 END AS ratio,"
    " CASE WHEN o_custkey <= 2048 THEN 64 WHEN o_custkey <= 8192 THEN 16 WHEN o_custkey <= 16384 THEN 8 WHEN o_custkey <= 32768 THEN 4 ELSE 1 END AS batch, CASE lower(o_orderstatus) WHEN 'o' THEN true WHEN 'f' THEN false END AS flag FROM orders"
)
def text_scalars(spark, d):
    """Truncation, suffixes, unescaping, time stamps, guarded ratios, the batch ladder, boolean words."""
    o = A.table(spark, d, "orders")
    long = F.concat("o_orderpriority", "o_orderstatus", F.lit("x" * 35))
    word = F.when(F.lower("o_orderstatus") == "o", "True").when(F.lower("o_orderstatus") == "f", "FALSE").otherwise("maybe")
    escaped = F.replace(F.col("o_orderpriority"), F.lit("-"), F.lit("\\n"))
    return o.select(
        "o_orderkey", text.shorten(long).alias("short"), text.last_chars("o_orderpriority", 4).alias("tail"), text.unescape_newlines(escaped).alias("lines"), text.stamp("o_orderdate").alias("stamp"),
        F.round(text.ratio(F.col("o_totalprice"), F.col("o_orderkey") % 5), 4).alias("ratio"), text.batch_size("o_custkey").alias("batch"), text.to_boolean(word).alias("flag"),
    )


@query(
    f"WITH {A.SQL_TOKENS}, t AS (SELECT trace_id, count(*) AS num_tokens, avg(conf) AS conf FROM tok GROUP BY 1), x AS (SELECT trace_id % 10 AS question_id, CASE WHEN trace_id % 10 < 5 THEN 'simple' ELSE 'original' END AS method, CASE WHEN trace_id % 3 = 0 THEN 'warmup' ELSE 'final' END AS phase, num_tokens FROM t)"
    " SELECT question_id, method, CASE WHEN method = 'simple' THEN count(*) ELSE count(*) FILTER (WHERE phase = 'warmup') + count(*) FILTER (WHERE phase = 'final') END AS total_traces, sum(num_tokens)::BIGINT AS total_tokens, round(sum(num_tokens) / count(*), 6) AS avg_tokens_per_trace, count(*) FILTER (WHERE phase = 'warmup') AS warmup_traces FROM x GROUP BY 1, 2"
)
def online_metrics(spark, d):
    """Metrics of each experiment by method, with a guarded mean."""
    n = A.tokens(spark, d).groupBy("trace_id").agg(F.count("*").alias("num_tokens"))
    x = n.select((F.col("trace_id") % 10).alias("question_id"), F.when(F.col("trace_id") % 10 < 5, "simple").otherwise("original").alias("method"), F.when(F.col("trace_id") % 3 == 0, "warmup").otherwise("final").alias("phase"), "num_tokens")
    warm, final = F.count_if(F.col("phase") == "warmup"), F.count_if(F.col("phase") == "final")
    got = x.groupBy("question_id", "method").agg(F.count("*").alias("n"), warm.alias("warmup_traces"), final.alias("final_traces"), F.sum("num_tokens").alias("total_tokens"))
    total = F.when(F.col("method") == "simple", F.col("n")).otherwise(F.col("warmup_traces") + F.col("final_traces"))
    return got.select("question_id", "method", total.alias("total_traces"), "total_tokens", F.round(text.ratio("total_tokens", "n"), 6).alias("avg_tokens_per_trace"), "warmup_traces")


@query(
    f"WITH {A.SQL_TOKENS}, {_PREFIX}, {A.sql_windows(64, 'pre')}, m AS (SELECT trace_id, min(mean) AS lo, max(mean) AS hi, avg(mean) AS mid FROM win GROUP BY 1),"
    " ans AS (SELECT trace_id, flag AS answer FROM (SELECT trace_id, flag, row_number() OVER (PARTITION BY trace_id ORDER BY count(*) DESC, flag) AS r FROM tok GROUP BY 1, 2) WHERE r = 1),"
    " x AS (SELECT trace_id % 10 AS question_id, answer, count(*)::DOUBLE AS n, sum(lo) AS lo, sum(hi) AS hi, sum(mid) AS mid FROM m JOIN ans USING (trace_id) GROUP BY 1, 2), u AS (UNPIVOT x ON n, lo, hi, mid INTO NAME metric VALUE w),"
    " p AS (SELECT *, w / sum(w) OVER (PARTITION BY question_id, metric) AS s FROM u)"
    " SELECT question_id, metric, round(-sum(s * ln(s)), 6) AS entropy, CASE count(*) WHEN 1 THEN 1.0 ELSE round(1 - -sum(s * ln(s)) / ln(count(*)), 3) END AS confidence, count(*) AS k FROM p GROUP BY 1, 2"
)
def probe_distribution(spark, d):
    """Entropy and confidence of the answers' distribution by count and by each window metric, in one pass."""
    m = probe_window_rows(spark, d).join(A.trace_answers(A.tokens(spark, d)), "trace_id").withColumn("question_id", F.col("trace_id") % 10)
    x = m.groupBy("question_id", "answer").agg(F.count("*").cast("double").alias("n"), F.sum("lo").alias("lo"), F.sum("hi").alias("hi"), F.sum("mid").alias("mid"))
    u = x.unpivot(["question_id", "answer"], ["n", "lo", "hi", "mid"], "metric", "w")
    e = statistics.entropy(u, ["question_id", "metric"], "w")
    return e.select("question_id", "metric", F.round("entropy", 6).alias("entropy"), statistics.normalised_confidence().alias("confidence"), "k")


def probe_window_rows(spark: SparkSession, d: str) -> DataFrame:
    pre = windows.first_rows(A.tokens(spark, d), ["trace_id"], A.TOKEN_ORDER, 300)
    w = windows.trace_windows(pre, ["trace_id"], A.TOKEN_ORDER, "conf", 64)
    return w.groupBy("trace_id").agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"), F.avg("mean").alias("mid"))


@query(
    f"{W}, c AS (SELECT question_id % 10 AS q, idx % 4 AS ck, answer, count(*) AS n FROM votes GROUP BY 1, 2, 3), s AS (SELECT *, n / sum(n) OVER (PARTITION BY q, ck) AS share FROM c), m AS (SELECT q, answer, max(share) AS top FROM s GROUP BY 1, 2), g AS (SELECT question_id % 10 AS q, min(ground_truth) AS gt FROM truths GROUP BY 1)"
    " SELECT q, answer, round(top, 6) AS top, place FROM (SELECT m.q, m.answer, top, gt, row_number() OVER (PARTITION BY m.q ORDER BY answer <> gt, round(top, 9) DESC, answer) AS place FROM m JOIN g ON m.q = g.q) WHERE place <= 4 OR answer = gt"
)
def answer_order(spark, d):
    """Answers in display order: the truth first, then by their highest share over checkpoints."""
    c = A.votes(spark, d).groupBy((F.col("question_id") % 10).alias("q"), (F.col("idx") % 4).alias("ck"), "answer").agg(F.count("*").alias("n"))
    m = statistics.shares(c, ["q", "ck"]).groupBy("q", "answer").agg(F.max("share").alias("top"))
    g = A.truths(spark, d).groupBy((F.col("question_id") % 10).alias("q")).agg(F.min("ground_truth").alias("gt"))
    order = Window.partitionBy("q").orderBy(F.col("answer") != F.col("gt"), F.desc(F.round("top", 9)), "answer")
    placed = m.join(g, "q").withColumn("place", F.row_number().over(order)).where((F.col("place") <= 4) | (F.col("answer") == F.col("gt")))
    return placed.select("q", "answer", F.round("top", 6).alias("top"), "place")


@query(
    f"{W}, p AS (SELECT question_id, idx // 500 AS step, sum(weight) AS v FROM votes GROUP BY 1, 2), g AS (SELECT * FROM (SELECT DISTINCT question_id FROM p), (SELECT DISTINCT idx // 500 AS step FROM votes))"
    " SELECT g.question_id, g.step::BIGINT AS step, round(last_value(v IGNORE NULLS) OVER (PARTITION BY g.question_id ORDER BY g.step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS v FROM g LEFT JOIN p ON p.question_id = g.question_id AND p.step = g.step"
)
def carried_points_all(spark, d):
    """Metric points of all questions on a grid of steps; a missing one repeats the previous."""
    from traceloom.sources.readers import metric_points

    p = A.votes(spark, d).groupBy("question_id", F.expr("idx div 500").alias("step")).agg(F.round(F.sum("weight"), 4).alias("v"))
    return metric_points(p, p.select("step"), ["question_id"], "step", ["v"]).select("question_id", "step", "v")  # steps are a short axis


@query(
    f"{W}, u AS (SELECT question_id, answer, idx, 0 AS phase FROM votes WHERE run < 4 UNION ALL SELECT question_id, answer, idx, 1 FROM votes WHERE run >= 4)"
    " SELECT question_id, phase, count(*) AS n, count(DISTINCT answer) AS n_answers, first(answer ORDER BY idx) AS first_answer FROM u GROUP BY 1, 2 EXCEPT SELECT question_id, 1, 1, 1, answer FROM votes WHERE run >= 4"
)
def set_operations_all(spark, d):
    """Union of the two phases of all events, distinct answers, and a difference."""
    v = A.votes(spark, d).select("question_id", "answer", "idx", "run")
    a, b = v.where("run < 4").withColumn("phase", F.lit(0)), v.where("run >= 4").withColumn("phase", F.lit(1))
    u = a.unionByName(b).groupBy("question_id", "phase").agg(F.count("*").alias("n"), F.count_distinct("answer").alias("n_answers"), F.min_by("answer", "idx").alias("first_answer"))
    gone = b.select("question_id", F.lit(1).alias("phase"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("n_answers"), F.col("answer").alias("first_answer"))
    return u.exceptAll(u.intersect(gone))


# Both cover all questions and events under their shorter names, too.
for _name in ("carried_points", "set_operations"):
    QUERIES[_name], ORACLE_SQL[_name] = QUERIES[f"{_name}_all"], ORACLE_SQL[f"{_name}_all"]


def bootstrap_records(spark: SparkSession, d: str) -> DataFrame:
    """The seven methods on each of 64 resamples of at most 512 traces of each question."""
    t = A.with_truths(A.traces(spark, d))
    sample = sampling.bootstrap(t, ["question_id"], "trace_idx", 64, 512).drop("trace_idx").withColumnRenamed("slot", "trace_idx")
    return experiment(sample, None, ["question_id", "bootstrap_idx"])


SQL_BOOTSTRAP = (
    f"WITH {A.SQL_TRACES}, p AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY trace_idx) - 1 AS place, count(*) OVER (PARTITION BY question_id) AS c FROM traces), g AS (SELECT DISTINCT question_id, c FROM p),"
    f" sl AS (SELECT question_id, b, s, {_DRAW} % c AS place FROM g, (SELECT unnest(range(0, 64)) AS b), (SELECT unnest(range(0, 512)) AS s) WHERE s < least(512, c)),"
    " drawn AS (SELECT sl.question_id * 64 + b AS question_id, s AS trace_idx, answer, mean_conf, tail_conf, bottom_conf, min_conf FROM sl JOIN p ON p.question_id = sl.question_id AND p.place = sl.place),"
    " known AS (SELECT question_id * 64 + b AS question_id, ground_truth FROM gt, (SELECT unnest(range(0, 64)) AS b)),"
    f" boot AS (SELECT * FROM (WITH traces AS (SELECT * FROM drawn), gt AS (SELECT * FROM known), {SQL_METHOD_ROWS} SELECT question_id // 64 AS q, question_id % 64 AS b, * EXCLUDE (question_id) FROM records))"
)


@query(f"{SQL_BOOTSTRAP} SELECT q AS question_id, b AS bootstrap_idx, (SELECT max(n) FROM (SELECT least(512, c) AS n, question_id AS k FROM g) WHERE k = q) AS bootstrap_size, voting_method, predicted_answer, is_correct, num_votes, round(avg_confidence, 6) AS avg_confidence FROM boot")
def bootstrap_methods_long(spark, d):
    """One row per question, resample and method."""
    sizes = A.traces(spark, d).groupBy("question_id").agg(F.least(F.lit(512), F.count("*")).alias("bootstrap_size"))
    r = bootstrap_records(spark, d).join(sizes, "question_id")
    return r.select("question_id", "bootstrap_idx", "bootstrap_size", "voting_method", "predicted_answer", "is_correct", "num_votes", F.round("avg_confidence", 6).alias("avg_confidence"))


@query(
    f"{SQL_BOOTSTRAP}, m AS (SELECT q, voting_method, count(*) AS n, round(avg(is_correct::INT), 4) AS mean_correct, round(avg(num_votes), 4) AS mean_votes, round(avg(avg_confidence), 4) AS mean_confidence FROM boot GROUP BY 1, 2),"
    " w AS (SELECT q, voting_method, first(predicted_answer ORDER BY k DESC, f) AS winner FROM (SELECT q, voting_method, predicted_answer, count(*) AS k, min(b) AS f FROM boot GROUP BY 1, 2, 3) GROUP BY 1, 2)"
    " SELECT q AS question_id, voting_method, n, mean_correct, mean_votes, mean_confidence, winner FROM m JOIN w USING (q, voting_method)"
)
def bootstrap_methods_averaged(spark, d):
    """Means over the resamples and the answer that wins most of them, by question and method."""
    by = ["question_id", "voting_method"]
    wins = bootstrap_records(spark, d).groupBy(*by, "predicted_answer").agg(
        F.count("*").alias("k"), F.min("bootstrap_idx").alias("f"), F.sum(F.col("is_correct").cast("int")).alias("ok"), F.sum("num_votes").alias("votes"), F.sum("avg_confidence").alias("conf")
    )
    n = F.sum("k")
    return wins.groupBy(*by).agg(
        n.alias("n"), F.round(F.sum("ok") / n, 4).alias("mean_correct"), F.round(F.sum("votes") / n, 4).alias("mean_votes"), F.round(F.sum("conf") / n, 4).alias("mean_confidence"),
        F.max_by("predicted_answer", F.struct("k", -F.col("f"))).alias("winner"),
    )


@query(
    f"WITH {A.SQL_TRACES}, e AS (SELECT question_id, b AS draw, trace_idx, answer, num_tokens, {_DRAW.replace('s * 104729', 'trace_idx * 104729')} AS o FROM traces, (SELECT unnest(range(0, 4)) AS b)),"
    " s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, draw ORDER BY o, trace_idx) AS r FROM e) WHERE r <= 8),"
    " t AS (SELECT question_id, draw, answer, count(*) AS n, sum(num_tokens) AS tokens FROM s GROUP BY 1, 2, 3), h AS (SELECT question_id, draw, -sum(p * log2(p)) AS h, sum(tokens) AS tokens FROM (SELECT *, n / sum(n) OVER (PARTITION BY question_id, draw) AS p FROM t) GROUP BY 1, 2)"
    " SELECT question_id, count(*) AS draws, round(avg(h), 6) + 0.0 AS mean_entropy, round(var_pop(h), 6) AS var_entropy, sum(tokens)::BIGINT AS tokens FROM h GROUP BY 1"
)
def warmup_entropy(spark, d):
    """Base-2 entropy of the answers of 8 traces drawn without replacement, its mean and population variance over 4 draws, and the draws' tokens."""
    t = A.traces(spark, d).select("question_id", "trace_idx", "answer", "num_tokens")
    drawn = sampling.draws_without_replacement(t, ["question_id"], "trace_idx", 8, 4)
    tally = drawn.groupBy("question_id", "draw", "answer").agg(F.count("*").alias("n"), F.sum("num_tokens").alias("tokens"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("question_id", "draw"))
    h = tally.withColumn("p", p).groupBy("question_id", "draw").agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"), F.sum("tokens").alias("tokens"))
    return h.groupBy("question_id").agg(F.count("*").alias("draws"), F.round(F.avg("h"), 6).alias("mean_entropy"), F.round(F.var_pop("h"), 6).alias("var_entropy"), F.sum("tokens").alias("tokens"))


@query("SELECT c_custkey % 7 AS source, count(*) AS n, sum(strlen(c_name))::BIGINT AS bytes, min(strlen(c_name))::BIGINT AS least, max(strlen(c_name))::BIGINT AS most, round(avg(strlen(c_name)), 6) AS mean FROM customer GROUP BY 1")
def size_report(spark, d):
    """Totals and extremes of byte sizes by group."""
    n = F.octet_length("c_name").cast("long")
    return A.table(spark, d, "customer").groupBy((F.col("c_custkey") % 7).alias("source")).agg(F.count("*").alias("n"), F.sum(n).alias("bytes"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'A candidate answer is: ' || o_custkey ELSE 'Candidate answers are: 1. ' || o_custkey || ', 2. ' || o_orderstatus END AS prompt, regexp_extract_all('q' || o_custkey || ' and ' || o_orderkey % 7, '\\d+') IS NOT NULL AS has_numbers FROM orders")
def prompts(spark, d):
    """Phrases that offer no, one or several candidates; the numbers in a text."""
    o = A.table(spark, d, "orders")
    c = F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<string>")).when(F.col("o_orderkey") % 3 == 1, F.array(F.col("o_custkey").cast("string"))).otherwise(F.array(F.col("o_custkey").cast("string"), F.col("o_orderstatus")))
    t = F.concat(F.lit("q"), F.col("o_custkey").cast("string"), F.lit(" and "), (F.col("o_orderkey") % 7).cast("string"))
    return o.select("o_orderkey", text.candidate_prompt(c).alias("prompt"), (F.size(text.numbers(t)) > 0).alias("has_numbers"))
