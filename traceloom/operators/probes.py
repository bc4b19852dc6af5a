"""Probes of traces from many files, merged by position with stored traces; padded matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .quarantine import observed


def last_wins(files: DataFrame, keys: list[str], path: str = "path", count: str = "n_files") -> DataFrame:
    """One row per key, that of the last file by name, and how many files there were."""
    rest = [c for c in files.columns if c not in keys]
    last = files.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(path)).alias("_r"), F.count("*").alias(count))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest], count)


def merged_by_position(traces: DataFrame, stored: DataFrame, question: str = "qid", place: str = "trace_idx", listed: str = "all_traces", counts: Observation | None = None) -> DataFrame:
    """``traces`` with ``stored_trace``, the element at their 0-based place in their question's list, and ``merge``:
    ``merged``, ``missing`` (no list for the question) or ``out_of_bounds``; ``counts`` observes how many of each.

    The lists stay whole on neither side: they are laid out as rows of (question, place), so that a question with many
    traces is joined in as many tasks as it needs.
    """
    rows = stored.select(F.col(question), F.posexplode(listed).alias("_place", "stored_trace"))
    sizes = stored.select(F.col(question), F.size(listed).alias("_n"))
    by_place = rows.withColumn(place, F.col("_place")).drop("_place")
    joined = traces.join(by_place, [question, place], "left").join(sizes, question, "left")
    merge = F.when(F.col("_n").isNull(), "missing").when((F.col(place) < 0) | (F.col(place) >= F.col("_n")), "out_of_bounds").otherwise("merged")
    out = joined.withColumn("merge", merge).drop("_n")
    return observed(out, counts, "merge", ["merged", "missing", "out_of_bounds"]) if counts is not None else out


def probe_rows(traces: DataFrame, probes: str = "probes", position: str = "token_position") -> DataFrame:
    """A row per probe, in order of position; ``probes`` is a map from position to a struct of fields."""
    sorted_ = F.array_sort(F.map_entries(probes))
    rest = [c for c in traces.columns if c != probes]
    return traces.select(*rest, F.explode(sorted_).alias("_p")).select(*rest, F.col("_p.key").alias(position), "_p.value.*")


def width(df: DataFrame, values: str) -> int:
    """Elements of the longest list: one number."""
    return df.agg(F.coalesce(F.max(F.size(values)), F.lit(0))).first()[0]


def padded(df: DataFrame, values: str, columns: int, fill: Column | None = None, length: str = "length") -> DataFrame:
    """``values`` filled up to ``columns`` elements, and their true length; null counts as empty, longer lists are an error."""
    kind = df.schema[values].dataType
    own = F.coalesce(F.col(values), F.array().cast(kind))
    n = F.size(own)
    fill = F.lit(0) if fill is None else fill
    filled = F.when(n <= columns, F.concat(own, F.array_repeat(fill.cast(kind.elementType), F.lit(columns) - n))).otherwise(F.raise_error(F.lit(f"a list is longer than {columns}")))
    return df.withColumns({values: filled, length: n})


def ragged(df: DataFrame, values: str, length: str = "length") -> DataFrame:
    """The lists as they were before they were padded."""
    return df.withColumn(values, F.slice(values, F.lit(1), F.col(length)))
