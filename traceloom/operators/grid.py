"""Checkpoint grids: every (trace, checkpoint) cell, filled forward with the provenance of each value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import forward_fill

VALUES = ["answer", "confidence", "token_usage"]


def fill_grid(
    observed: DataFrame,
    keys: list[str],
    traces: DataFrame,
    checkpoints: DataFrame,
    values: list[str] | None = None,
    propagate_missing_files: bool = True,
    propagate_missing_traces: bool = True,
    fill_leading: bool = False,
) -> DataFrame:
    """The dense grid of ``traces`` (keys, trace) by ``checkpoints`` (prob_token) with ``observed`` values filled.

    Adds observed, is_propagated_file, is_propagated_trace, is_propagated and source_prob_token. A checkpoint that
    no trace of the run reached is a missing file. Every column fills on its own; a leading gap stays null but counts
    as propagated. Rows of missing files are dropped after filling, so that later cells still fill from before them.
    """
    values = values or VALUES
    # The checkpoint list is a set of positions, not data: it does not grow with the traces.
    grid = traces.select(*keys, "trace").distinct().crossJoin(F.broadcast(checkpoints.select("prob_token").distinct()))
    own = observed.dropDuplicates([*keys, "trace", "prob_token"]).withColumn("observed", F.lit(True))
    cells = grid.join(own, [*keys, "trace", "prob_token"], "left").withColumn("observed", F.coalesce("observed", F.lit(False)))
    file_exists = F.max("observed").over(Window.partitionBy(*keys, "prob_token"))
    cells = cells.withColumn("_file", file_exists).withColumn("source_prob_token", F.when(F.col("observed"), F.col("prob_token")))
    filled = forward_fill(cells.withColumns({f"_{v}": F.col(v) for v in values}), [*keys, "trace"], ["prob_token"], [*values, "source_prob_token"], fill_leading)
    by_file = ~F.col("_file") & F.lit(propagate_missing_files)
    by_trace = F.col("_file") & ~F.col("observed") & F.lit(propagate_missing_traces)
    take = F.col("observed") | by_file | by_trace
    out = filled.withColumns({v: F.when(take, F.col(v)) for v in [*values, "source_prob_token"]})
    out = out.withColumns({"is_propagated_file": by_file, "is_propagated_trace": by_trace, "is_propagated": by_file | by_trace})
    if not propagate_missing_files:
        out = out.where("_file")
    return out.drop("_file", *[f"_{v}" for v in values])


def carried(points: DataFrame, axis: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """Every key of ``points`` (one row per keys and ``at``) on every position of ``axis``; a missing value repeats the previous.

    No cell is joined, shuffled or sorted: points are numbered on the axis and filled, then each is spread over the
    positions up to the next one. Only the result itself grows with keys times positions. The axis, a list of positions
    that keys share, is broadcast. Null positions come last; null keys and positions have no points of their own.
    """
    # Pairs, so that null positions are collected, too, and sorted to the end.
    axis = axis.select(F.col(at).isNull().alias("none"), F.col(at).alias("at")).distinct()
    axis = axis.agg(F.sort_array(F.collect_list(F.struct("none", "at"))).alias("_axis")).select(F.col("_axis.at").alias("_axis"))
    places = axis.select(F.posexplode("_axis").alias("_from", at)).where(F.col(at).isNotNull())
    own = points.dropna(subset=keys).join(F.broadcast(places), at).select(*keys, "_from", *values)
    # The gap before a key's first point has a row of its own, without values.
    gap = points.select(*keys).distinct().select(*keys, F.lit(-1).alias("_from"), *[F.lit(None).cast(points.schema[v].dataType).alias(v) for v in values])
    # A fixed number of tasks: the rows are few here, but each is spread over many.
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filled = forward_fill(own.unionByName(gap).repartition(n, *keys), keys, ["_from"], values)
    filled = filled.withColumn("_to", F.lead("_from").over(Window.partitionBy(*keys).orderBy("_from"))).crossJoin(F.broadcast(axis))
    first = F.greatest("_from", F.lit(0))
    cells = F.slice("_axis", first + 1, F.coalesce("_to", F.size("_axis")) - first)
    return filled.select(*keys, F.explode(cells).alias(at), *values)
