"""Rows that cannot be used stay visible: a status column instead of a silent drop, and counts without a second scan."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scored_status(num_tokens: Column, longest: int, failed: Column | None = None) -> Column:
    """``error`` (to be retried), ``over_length`` or ``ok``."""
    out = F.when(num_tokens > longest, "over_length").otherwise("ok")
    return out if failed is None else F.when(F.coalesce(failed, F.lit(False)), "error").otherwise(out)


def quarantined(traces: DataFrame, longest: int, num_tokens: str = "num_tokens", confs: str = "confs", failed: Column | None = None) -> DataFrame:
    """``traces`` with ``status``: over-length ones keep their length and get empty confidences, failed ones have none."""
    status = scored_status(F.col(num_tokens), longest, failed)
    empty = F.array().cast(traces.schema[confs].dataType)
    kept = F.when(status == "ok", F.col(confs)).when(status == "over_length", empty)
    return traces.withColumns({"status": status, confs: kept})


def checkpointed(scored: DataFrame) -> DataFrame:
    """What counts as done: everything but errors, which the next run finds missing."""
    return scored.where(F.col("status") != "error")


def checked_lookup(records: DataFrame, lookup: DataFrame, keys: list[str], failed: Column | None = None, counts: Observation | None = None) -> DataFrame:
    """``records`` with the columns of ``lookup`` and a status: ``ok``, ``unmapped`` (no such key) or ``failed``.

    Keys of ``lookup`` are unique. ``counts`` observes n, n_ok, n_unmapped and n_failed while the result is used.
    """
    marked = lookup.withColumn("_known", F.lit(True))
    joined = records.join(marked, keys, "left")
    status = F.when(F.col("_known").isNull(), "unmapped").otherwise("ok")
    if failed is not None:
        status = F.when(F.coalesce(failed, F.lit(False)), "failed").otherwise(status)
    out = joined.withColumn("status", status).drop("_known")
    return observed(out, counts, "status", ["ok", "unmapped", "failed"]) if counts is not None else out


def observed(df: DataFrame, counts: Observation, column: str, values: list[str]) -> DataFrame:
    """``df``; ``counts`` gets n and n_<value> of ``column`` from the same pass that reads it."""
    return df.observe(counts, F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def attempting(f: Callable, returns: str) -> Callable[..., Column]:
    """``f`` of plain values as a column function that gives (result, error): an exception becomes the row's error text."""

    def attempt(*values):
        try:
            return {"result": f(*values), "error": None}
        except Exception as e:  # noqa: BLE001  whatever fails belongs to its row
            return {"result": None, "error": f"{type(e).__name__}: {e}"}

    def batch(*columns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([attempt(*values) for values in zip(*columns, strict=True)], columns=["result", "error"])

    kind = T.StructType().add("result", T._parse_datatype_string(returns) if isinstance(returns, str) else returns).add("error", "string")
    batch.__annotations__ = {"columns": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(batch, kind)


def tried(value: Column, source: Column, what: str) -> Column:
    """(result, error) of an expression that is null where it fails (``try_*``): null input is no error."""
    error = F.when(source.isNotNull() & value.isNull(), F.concat(F.lit(f"{what}: "), source.cast("string")))
    return F.struct(value.alias("result"), error.alias("error"))
