"""Window operators over ordered rows: rolling means by prefix sums, fills, prefixes, early stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """1-based position in each group."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def rolling_mean(df: DataFrame, keys: list[str], order: list[str], value: str, window: int, out: str = "mean", pos: str = "pos", decimals: int | None = None) -> DataFrame:
    """Mean of the last ``window`` rows where the frame is full, else null.

    One pass of running sums and a lag instead of a sliding frame, which Spark would sum again for each row: linear
    in the rows whatever the window, and one sort serves both.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    sums = df.withColumn(pos, F.row_number().over(w)).withColumn("_sum", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    mean = (F.col("_sum") - F.coalesce(F.lag("_sum", window).over(w), F.lit(0.0))) / window
    if decimals is not None:
        mean = F.round(mean, decimals)
    return sums.withColumn(out, F.when(F.col(pos) >= window, mean)).drop("_sum")


def trace_windows(df: DataFrame, keys: list[str], order: list[str], value: str, window: int, decimals: int | None = None) -> DataFrame:
    """Rows (keys, pos, mean) of all full windows; of a shorter trace its one plain mean."""
    rolled = rolling_mean(df, keys, order, value, window, "mean", "pos", decimals)
    whole = Window.partitionBy(*keys)
    rolled = rolled.withColumn("_n", F.count("*").over(whole)).withColumn("_all", F.avg(value).over(whole))
    short = (F.col("_n") < window) & (F.col("pos") == F.col("_n"))
    return rolled.withColumn("mean", F.when(short, F.col("_all")).otherwise(F.col("mean"))).where("mean IS NOT NULL").select(*keys, "pos", "mean", F.col("_n").alias("n"))


def lowest_means(windows: DataFrame, keys: list[str], share: float = 0.1) -> DataFrame:
    """keys, bottom_conf (mean of the lowest share of windows, at least one) and min_conf."""
    ranked = windows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("mean", "pos")))
    ranked = ranked.withColumn("_m", F.count("*").over(Window.partitionBy(*keys)))
    k = F.greatest(F.floor(F.col("_m") * F.lit(float(share))), F.lit(1))
    return ranked.groupBy(*keys).agg(F.avg(F.when(F.col("_r") <= k, F.col("mean"))).alias("bottom_conf"), F.min("mean").alias("min_conf"))


def early_stop(df: DataFrame, keys: list[str], order: list[str], value: str, window: int, bar: Column, carry: list[str] | None = None) -> DataFrame:
    """Where each trace would stop: at its first window mean below ``bar``, keeping what was read so far.

    keys, n_tokens, kept_tokens, n_windows, stopped. A trace shorter than the window whose mean lies below the bar is
    marked as stopped though nothing is cut.
    """
    windows = trace_windows(df, [*keys, *(carry or [])], order, value, window)
    below = F.min(F.when(F.col("mean") < bar, F.col("pos")))
    got = windows.groupBy(*keys).agg(F.max("n").alias("n_tokens"), below.alias("_at"))
    kept = F.least(F.coalesce("_at", "n_tokens"), F.col("n_tokens"))
    n_windows = F.greatest(kept - window + 1, F.lit(1))
    return got.select(*keys, "n_tokens", kept.alias("kept_tokens"), n_windows.alias("n_windows"), F.col("_at").isNotNull().alias("stopped"))


def forward_fill(df: DataFrame, keys: list[str], order: list[str], columns: list[str], leading: bool = False) -> DataFrame:
    """Each column filled on its own from earlier rows of its group, and with ``leading`` the first gap from later ones."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = {}
    for c in columns:
        v = F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        if leading:
            v = F.coalesce(v, F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
        out[c] = v
    return df.withColumns(out)


def strictly_falling(df: DataFrame, keys: list[str], order: str, value: str, n: int, out: str = "falling") -> DataFrame:
    """True where the last ``n`` values of the group each lie below the one before."""
    w = Window.partitionBy(*keys).orderBy(order)
    falls = (F.col(value) < F.lag(value).over(w)).cast("int")
    last = F.min("_falls").over(w.rowsBetween(-(n - 2), 0))
    return df.withColumn("_falls", falls).withColumn("_at", F.row_number().over(w)).withColumn(out, (F.col("_at") >= n) & (last == 1)).drop("_falls", "_at")


def first_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    return numbered(df, keys, order, "_n").where(F.col("_n") <= n).drop("_n")


def last_row(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each group by an aggregate, without a sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in columns])
