"""Which runs, traces, checkpoints and questions take part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .quarantine import observed


def run_range(df: DataFrame, run_id: str = "run_id", first: int = 0, below: int = 8) -> DataFrame:
    """Runs whose id is a whole number from ``first`` up to, not including, ``below``; other ids are left out."""
    return df.where(F.col(run_id).try_cast("int").between(first, below - 1))


def observed_only(df: DataFrame, flag: str = "observed") -> DataFrame:
    """Rows that were observed, where the table says so at all."""
    return df.where(F.col(flag)) if flag in df.columns else df


def trace_mode(df: DataFrame, mode: str = "all", truncated: str = "is_truncated") -> DataFrame:
    """``all``, or ``non_truncated``: rows whose flag is false; an unknown flag does not count as false."""
    if mode not in ("all", "non_truncated"):
        raise ValueError(f"unknown trace mode {mode!r}")
    return df if mode == "all" else df.where(~F.col(truncated))


def only(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are in ``wanted``, however long that is."""
    return df.join(wanted.select(*keys).distinct(), keys, "left_semi")


def known(df: DataFrame, lookup: DataFrame, keys: list[str], counts: Observation) -> DataFrame:
    """``df`` with the columns of ``lookup``, rows without an entry left out but counted: ``counts`` observes n, n_known and n_unknown."""
    joined = df.join(lookup.withColumn("_known", F.lit(True)), keys, "left").withColumn("_status", F.when(F.col("_known"), "known").otherwise("unknown"))
    return observed(joined, counts, "_status", ["known", "unknown"]).where("_known").drop("_known", "_status")


def largest(df: DataFrame, size: str, n: int, tie: str) -> DataFrame:
    """The ``n`` rows of largest ``size``, ties by ``tie``: a bounded heap in each task, then one of ``n`` rows each."""
    return df.orderBy(F.desc(size), tie).limit(n)


def prompted(stop_reason: Column, num_tokens: Column, limit: int) -> Column:
    """Whether a trace is asked at all: not if it was stopped early before ``limit`` tokens. Its tokens count either way."""
    return ~((F.coalesce(stop_reason, F.lit("")) == "gconf_threshold") & (F.coalesce(num_tokens, F.lit(0)) < limit))


def candidate_answers(traces: DataFrame, keys: list[str], limit: int, least: int, answer: str = "answer", num_tokens: str = "num_tokens", idx: str = "trace_idx") -> DataFrame:
    """keys, candidates: answers of at least ``least`` traces of at most ``limit`` tokens, most frequent first, ties by the first trace."""
    t = traces.where(F.col(answer).isNotNull() & (F.col(num_tokens) <= limit)).groupBy(*keys, answer).agg(F.count("*").alias("n"), F.min(idx).alias("f")).where(F.col("n") >= least)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "f", F.col(answer).alias("a"))))
    return t.groupBy(*keys).agg(ranked.alias("r")).select(*keys, F.col("r.a").alias("candidates"))
