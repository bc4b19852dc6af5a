"""Votes: arg-max of grouped weights, ties to the answer that came first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Decimals to which summed weights are rounded before they are compared, so that the order of addition cannot decide.
WEIGHT_DECIMALS = 9


def has_answer(answer: Column | str) -> Column:
    """Neither null nor empty."""
    a = F.col(answer) if isinstance(answer, str) else answer
    return a.isNotNull() & (a != "")


def tally(df: DataFrame, keys: list[str], answer: str, weight: Column | None, idx: str) -> DataFrame:
    """keys, answer, n, weight, first_idx: pre-aggregated on the map side, one shuffle."""
    w = F.lit(1.0) if weight is None else weight
    return df.groupBy(*keys, answer).agg(F.count("*").alias("n"), F.round(F.sum(w), WEIGHT_DECIMALS).alias("weight"), F.min(idx).alias("first_idx"))


def argmax_first(tallied: DataFrame, keys: list[str], answer: str, out: str = "voted") -> DataFrame:
    """keys, ``out``, votes, weight: the heaviest answer of each group; of equal ones the first seen."""
    best = F.max_by(F.struct(answer, "weight"), F.struct("weight", -F.col("first_idx")))
    got = tallied.groupBy(*keys).agg(best.alias("_best"), F.sum("n").alias("votes"), F.max("weight").alias("_w"))
    return got.select(*keys, F.col(f"_best.{answer}").alias(out), "votes", F.col("_best.weight").alias("weight"))


def majority_vote(df: DataFrame, keys: list[str], answer: str = "answer", idx: str = "idx", keep_null: bool = False) -> DataFrame:
    rows = df if keep_null else df.where(F.col(answer).isNotNull())
    return argmax_first(tally(rows, keys, answer, None, idx), keys, answer)


def weighted_vote(df: DataFrame, keys: list[str], weight: str, answer: str = "answer", idx: str = "idx") -> DataFrame:
    return argmax_first(tally(df.where(F.col(answer).isNotNull()), keys, answer, F.col(weight), idx), keys, answer)


def vote_weights(df: DataFrame, keys: list[str], weight: str, answer: str = "answer", idx: str = "idx") -> DataFrame:
    """The vote and the map of all answers' weights."""
    tallied = tally(df.where(F.col(answer).isNotNull()), keys, answer, F.col(weight), idx)
    weights = tallied.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(answer, "weight"))).alias("weights"))
    return argmax_first(tallied, keys, answer).join(weights, keys)


def top_percentile(df: DataFrame, keys: list[str], conf: str, top: float = 0.1) -> DataFrame:
    """Rows whose ``conf`` reaches the (1 - top) percentile of their group, by linear interpolation."""
    bar = F.percentile(F.col(conf), F.lit(1.0 - top)).over(Window.partitionBy(*keys))
    return df.withColumn("_bar", bar).where(F.col(conf) >= F.col("_bar")).drop("_bar")


def top_share(df: DataFrame, keys: list[str], conf: str, idx: str, share: float) -> DataFrame:
    """The ``max(1, ceil(share * n))`` rows of each group with the highest ``conf``, ties by ``idx``."""
    if not 0 < share <= 1:
        raise ValueError("the share must be in (0, 1]")
    ranked = Window.partitionBy(*keys).orderBy(F.desc(conf), F.asc(idx))
    size = F.count("*").over(Window.partitionBy(*keys))
    rows = df.withColumn("_rank", F.row_number().over(ranked)).withColumn("_n", size)
    return rows.where(F.col("_rank") <= F.greatest(F.lit(1), F.ceil(F.lit(float(share)) * F.col("_n")))).drop("_rank", "_n")


def eligible(exclude_truncated: bool = True, exclude_out_of_budget: bool = True) -> Column:
    """Warm-up or naturally stopped traces, optionally neither truncated nor out of budget."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = flag("is_warmup") | flag("is_naturally_stopped")
    if exclude_truncated:
        out = out & ~flag("is_deep_conf_truncated")
    if exclude_out_of_budget:
        out = out & ~flag("is_out_of_budget")
    return out


def confidence_weighted_vote(df: DataFrame, keys: list[str], conf: str, idx: str, share: float, answer: str = "answer", **exclude) -> DataFrame:
    """Eligible rows, then the top share by confidence, then the weighted vote."""
    return weighted_vote(top_share(df.where(eligible(**exclude)), keys, conf, idx, share), keys, conf, answer, idx)
