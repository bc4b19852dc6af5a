"""The seven-method experiment: every voting method on every question, scored in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.operators import voting

#: Method names with the metric that weights their votes and, for the filtered ones, the metric of the top 10 % bar.
METHODS = [
    ("majority", None, None),
    ("mean_confidence_weighted", "mean_conf", None),
    ("tail_confidence_weighted", "tail_conf", None),
    ("bottom_window_weighted", "bottom_conf", None),
    ("min_window_weighted", "min_conf", None),
    ("top10_tail_filtered", "tail_conf", "tail_conf"),
    ("top10_bottom_window_filtered", "bottom_conf", "bottom_conf"),
]


def method_rows(traces: DataFrame, keys: list[str], top: float = 0.1) -> DataFrame:
    """One row per trace and method that counts it: keys, voting_method, trace_idx, answer, weight, conf."""
    group = Window.partitionBy(*keys)
    bars = {c: F.percentile(F.col(c), F.lit(1.0 - top)).over(group) for _, _, c in METHODS if c}
    rows = traces.where(voting.has_answer("answer")).withColumns({f"_bar_{c}": b for c, b in bars.items()})
    cells = [
        F.struct(
            F.lit(name).alias("voting_method"),
            (F.col(metric) if metric else F.lit(1.0)).cast("double").alias("weight"),
            (F.col(metric) if metric else F.lit(None)).cast("double").alias("conf"),
            (F.col(bar) >= F.col(f"_bar_{bar}") if bar else F.lit(True)).alias("counts"),
        )
        for name, metric, bar in METHODS
    ]
    carried = [c for c in ("ground_truth",) if c in traces.columns]
    spread = rows.select(*keys, *carried, "trace_idx", "answer", F.explode(F.array(*cells)).alias("m"))
    return spread.where("m.counts").select(*keys, *carried, "m.voting_method", "trace_idx", "answer", "m.weight", "m.conf")


def experiment(traces: DataFrame, truths: DataFrame | None, keys: list[str], equal=None) -> DataFrame:
    """keys, voting_method, predicted_answer, ground_truth, is_correct, num_votes, avg_confidence.

    Without ``truths`` the traces carry their ``ground_truth``. A weighted method appears only if some weight is positive; the majority has no confidence and reports 0.
    """
    rows = method_rows(traces, keys)
    by = [*keys, "voting_method"]
    known = [] if truths is not None else [F.max("ground_truth").alias("ground_truth")]
    tallied = rows.groupBy(*by, "answer").agg(
        F.count("*").alias("n"), F.round(F.sum("weight"), voting.WEIGHT_DECIMALS).alias("weight"), F.min("trace_idx").alias("first_idx"), F.sum("conf").alias("conf"), F.max("weight").alias("most"), *known
    )
    best = F.max_by("answer", F.struct("weight", -F.col("first_idx")))
    voted = tallied.groupBy(*by).agg(best.alias("predicted_answer"), F.sum("n").alias("num_votes"), (F.sum("conf") / F.sum("n")).alias("c"), F.max("most").alias("most"), *known)
    voted = voted.where("most > 0").withColumn("avg_confidence", F.coalesce("c", F.lit(0.0))).drop("c", "most")
    judged = voted if truths is None else voted.join(truths, [k for k in keys if k in truths.columns], "left")
    same = F.col("predicted_answer") == F.col("ground_truth") if equal is None else equal(F.col("predicted_answer"), F.col("ground_truth"))
    return judged.withColumn("is_correct", F.coalesce(same, F.lit(False)))


SQL_METHOD_ROWS = (
    "bars AS (SELECT question_id, quantile_cont(tail_conf, 0.9) AS tail_bar, quantile_cont(bottom_conf, 0.9) AS bottom_bar FROM traces GROUP BY 1),"
    " method_rows AS (SELECT question_id, trace_idx, answer, 'majority' AS voting_method, 1.0::DOUBLE AS weight, NULL::DOUBLE AS conf FROM traces"
    " UNION ALL SELECT question_id, trace_idx, answer, 'mean_confidence_weighted', mean_conf, mean_conf FROM traces"
    " UNION ALL SELECT question_id, trace_idx, answer, 'tail_confidence_weighted', tail_conf, tail_conf FROM traces"
    " UNION ALL SELECT question_id, trace_idx, answer, 'bottom_window_weighted', bottom_conf, bottom_conf FROM traces"
    " UNION ALL SELECT question_id, trace_idx, answer, 'min_window_weighted', min_conf, min_conf FROM traces"
    " UNION ALL SELECT t.question_id, trace_idx, answer, 'top10_tail_filtered', tail_conf, tail_conf FROM traces t JOIN bars b ON t.question_id = b.question_id WHERE tail_conf >= tail_bar"
    " UNION ALL SELECT t.question_id, trace_idx, answer, 'top10_bottom_window_filtered', bottom_conf, bottom_conf FROM traces t JOIN bars b ON t.question_id = b.question_id WHERE bottom_conf >= bottom_bar),"
    " tallied AS (SELECT question_id, voting_method, answer, count(*) AS n, round(sum(weight), 9) AS w, min(trace_idx) AS f, sum(conf) AS c FROM method_rows GROUP BY ALL),"
    " voted AS (SELECT question_id, voting_method, first(answer ORDER BY w DESC, f) AS predicted_answer, sum(n)::BIGINT AS num_votes, coalesce(sum(c) / sum(n), 0.0) AS avg_confidence FROM tallied GROUP BY 1, 2),"
    " records AS (SELECT v.*, ground_truth, predicted_answer = ground_truth AS is_correct FROM voted v JOIN gt USING (question_id))"
)
