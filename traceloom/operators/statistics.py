"""Entropy, shares, reports and other aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entropy(tallied: DataFrame, keys: list[str], weight: str, base: str = "e", out: str = "entropy") -> DataFrame:
    """keys, entropy of the tally's shares, k (answers) and total; 0 for an empty or zero tally."""
    total = F.sum(weight).over(Window.partitionBy(*keys))
    log = F.ln if base == "e" else F.log2
    share = F.col(weight) / F.nullif(F.col("_total"), F.lit(0))
    term = F.when(share > 0, share * log(share)).otherwise(0.0)
    return tallied.withColumn("_total", total).groupBy(*keys).agg((-F.sum(term)).alias(out), F.count("*").alias("k"), F.sum(weight).alias("total"))


def normalised_confidence(entropy_: str = "entropy", k: str = "k") -> Column:
    """1 - H / ln k to three decimals; 1 for a single answer, 0 for none."""
    return F.when(F.col(k) == 0, 0.0).when(F.col(k) == 1, 1.0).otherwise(F.round(1 - F.col(entropy_) / F.ln(k), 3))


def shift_geometric_mean(column: str) -> Column:
    """exp(mean(ln(x + 1))) - 1; values of -1 or less are an error."""
    x = F.col(column)
    guarded = F.when(x <= -1, F.raise_error(F.lit("shift-1 geometric mean needs values above -1"))).otherwise(F.log1p(x))
    return F.expm1(F.avg(guarded.cast("double")))


def scoreboard(records: DataFrame, by: list[str], sample_std: bool = False) -> DataFrame:
    """Accuracy, votes and confidence by group, to four decimals."""
    right = F.col("is_correct").cast("int")
    columns = [
        F.count("*").alias("n"), F.sum(right).alias("n_correct"), F.round(F.avg(right), 4).alias("accuracy"),
        F.round(F.avg("num_votes"), 4).alias("mean_votes"), F.round(F.avg("avg_confidence"), 4).alias("mean_confidence"),
    ]
    if sample_std:
        columns.append(F.round(F.stddev_samp(right), 4).alias("accuracy_std"))
    return records.groupBy(*by).agg(*columns)


def scoreboard_sets(records: DataFrame, outer: str, inner: str) -> DataFrame:
    """The scoreboard by ``inner`` and by (outer, inner) in one pass of grouping sets."""
    right = F.col("is_correct").cast("int")
    sets = records.groupingSets([[F.col(inner)], [F.col(outer), F.col(inner)]], F.col(outer), F.col(inner))
    return sets.agg(F.count("*").alias("n"), F.sum(right).alias("n_correct"), F.round(F.avg(right), 4).alias("accuracy"))


def method_delta(records: DataFrame, method: str, base: str, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Mean of each column by method next to that of the base method, with absolute and relative difference."""
    keys = keys or []
    means = records.groupBy(*keys, method).agg(*[F.avg(c).alias(c) for c in columns])
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    out = means
    for c in columns:
        ref = F.max(F.when(F.col(method) == base, F.col(c))).over(own)
        out = out.withColumn(f"{c}_delta", F.col(c) - ref).withColumn(f"{c}_delta_pct", F.try_divide(100 * (F.col(c) - ref), ref))
    return out


def shares(counted: DataFrame, keys: list[str], n: str = "n", out: str = "share") -> DataFrame:
    return counted.withColumn(out, F.col(n) / F.sum(n).over(Window.partitionBy(*keys)))


def pearson(label: str, value: str) -> Column:
    """Correlation to four decimals; null with fewer than two rows or one class."""
    enough = (F.count(value) >= 2) & (F.count_distinct(F.col(label)) >= 2)
    return F.when(enough, F.round(F.corr(F.col(label).cast("double"), F.col(value)), 4))


def capped_tokens(df: DataFrame, keys: list[str], tokens: str, cap: int = 64_000) -> DataFrame:
    """Traces within the cap and tokens up to it."""
    n = F.col(tokens)
    return df.groupBy(*keys).agg(F.count_if(n <= cap).alias("n_within"), F.sum(F.least(n, F.lit(cap))).alias("capped_tokens"), F.avg(F.when(n <= cap, n)).alias("mean_within"))
