"""Deterministic sampling by hash order, and bootstrap resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: Column, slot: Column) -> Column:
    """A pseudo-random number below 2^31 from small integers, in plain integer arithmetic that any SQL engine repeats."""
    x = F.pmod(seed * 7919 + slot * 104729 + 12345, F.lit(2147483647))
    for _ in range(2):
        x = F.pmod(x * 48271, F.lit(2147483647))
    return x


def sample_without_replacement(df: DataFrame, keys: list[str], idx: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each group (all if fewer), in hash order."""
    w = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *keys, idx), idx)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def draws_without_replacement(df: DataFrame, keys: list[str], idx: str, n: int, draws: int) -> DataFrame:
    """``draws`` samples of ``n`` rows of each group (all if fewer), numbered by ``draw``, in order of ``draw(number, idx)``.

    The samples are one explode of the rows and one sort; plain integer arithmetic orders them, so any engine repeats it.
    """
    each = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    w = Window.partitionBy(*keys, "draw").orderBy(draw(F.col("draw").cast("long"), F.col(idx).cast("long")), idx)
    return each.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def bootstrap(df: DataFrame, keys: list[str], idx: str, n_bootstraps: int, size: int, resample_when_small: bool = True) -> DataFrame:
    """``df`` resampled with replacement: one row per (keys, bootstrap_idx, slot).

    Slots are generated per group, never per pair of rows, and look their row up by its position, so the result has
    ``groups * n_bootstraps * size`` rows and nothing else is formed.
    """
    placed = df.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(idx)) - 1)
    groups = placed.groupBy(*keys).agg(F.count("*").alias("_n"))
    slots = groups.withColumn("bootstrap_idx", F.explode(F.sequence(F.lit(0), F.lit(n_bootstraps - 1))))
    slots = slots.withColumn("slot", F.explode(F.sequence(F.lit(0), F.least(F.lit(size), F.col("_n")).cast("int") - 1)))
    chosen = F.pmod(draw(F.col("bootstrap_idx").cast("long"), F.col("slot").cast("long")), F.col("_n"))
    if not resample_when_small:
        chosen = F.when(F.col("_n") <= size, F.col("slot").cast("long")).otherwise(chosen)
    return slots.withColumn("_pos", chosen.cast("int")).drop("_n").join(placed, [*keys, "_pos"]).drop("_pos")
