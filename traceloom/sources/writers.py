"""Sinks. Spark's committers make every write atomic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.operators import probes


def by_question(df: DataFrame, path: str, question: str = "question_id") -> None:
    """Parquet, one folder per question; an overwrite replaces only the questions that are written."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(question).parquet(path)


def table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV with a header, Parquet, or JSON lines. Nested columns of a CSV become JSON text."""
    if fmt == "csv":
        nested = {f.name: F.to_json(f.name) for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
        df = df.withColumns(nested) if nested else df
        df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    elif fmt in ("parquet", "json"):
        df.write.mode("overwrite").format(fmt).save(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def probe_matrix(df: DataFrame, keys: list[str], depth: str, value: str, depths: list[int]) -> DataFrame:
    """Wide form of probes: a column per depth, null where a trace has none."""
    return df.groupBy(*keys).pivot(depth, depths).agg(F.first(value))


def padded_matrix(df: DataFrame, path: str, values: str, length: str = "length") -> None:
    """Parquet of equally long rows: every list filled with zeros up to the longest, its true length beside it."""
    probes.padded(df, values, probes.width(df, values), length=length).write.mode("overwrite").parquet(path)
