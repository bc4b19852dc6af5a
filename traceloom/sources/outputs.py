"""Traces of inference outputs whose records differ in shape, read as semi-structured values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions import text


def _at(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _filled(a: Column) -> Column:
    return F.when(F.size(a) > 0, a)


def token_ids(v: Column) -> Column:
    """The ids of a record: ``output_ids``, or ``meta_info.output_token_ids`` where that key is absent; where neither
    holds any, the second entries of ``meta_info.output_token_logprobs``. Never null."""
    top = F.when(_at(v, "$.output_ids", "variant").isNotNull(), _at(v, "$.output_ids", "array<int>")).otherwise(_at(v, "$.meta_info.output_token_ids", "array<int>"))
    pairs = F.transform(_at(v, "$.meta_info.output_token_logprobs", "array<variant>"), lambda p: _at(p, "$[1]", "int"))
    return F.coalesce(_filled(top), _filled(pairs), F.array().cast("array<int>"))


def confidences(v: Column) -> Column:
    """-mean of each token's top log-probabilities, to three places; tokens without any are left out. Never null."""
    tops = F.transform(_at(v, "$.meta_info.output_top_logprobs", "array<array<variant>>"), lambda t: F.transform(t, lambda p: _at(p, "$[0]", "double")))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.coalesce(F.transform(F.filter(tops, lambda t: F.size(t) > 0), lambda t: F.round(-mean(t), 3)), F.array().cast("array<double>"))


def stop_reason(v: Column) -> Column:
    """``meta_info.finish_reason``: the ``type`` of an object, else the text itself; unknown where it is absent."""
    whole = _at(v, "$.meta_info.finish_reason", "variant")
    is_object = F.schema_of_variant(whole).startswith("OBJECT")
    named = F.coalesce(_at(v, "$.meta_info.finish_reason.type", "string"), F.lit("unknown"))
    return F.when(whole.isNull(), "unknown").when(is_object, named).when(~F.is_variant_null(whole), _at(v, "$.meta_info.finish_reason", "string"))


def raw_outputs(lines: DataFrame, body: str = "value", keep: list[str] | None = None) -> DataFrame:
    """A trace per record of ``body``: stop_reason, text, token_ids, num_tokens, confs, extracted_answer and ``error``.

    A record of another shape, or one that is no JSON, is a row with an error instead of a failed read. ``num_tokens``
    is the number of ids or, without any, of confidences.
    """
    keep = keep or []
    v = lines.select(*keep, F.try_parse_json(body).alias("_v"))
    shaped = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    error = F.when(F.col("_v").isNull(), "no JSON").when(~shaped, "no object").when(_at(F.col("_v"), "$.text", "string").isNull(), "no text")
    rows = v.select(*keep, error.alias("error"), F.when(error.isNull(), F.col("_v")).alias("_v"))
    r = F.col("_v")
    made = rows.select(*keep, "error", stop_reason(r).alias("stop_reason"), _at(r, "$.text", "string").alias("text"), token_ids(r).alias("token_ids"), confidences(r).alias("confs"))
    n = F.when(F.size("token_ids") > 0, F.size("token_ids")).otherwise(F.size("confs"))
    fine = lambda c: F.when(F.col("error").isNull(), c)
    return made.select(
        *keep, fine(F.col("stop_reason")).alias("stop_reason"), "text", fine(F.col("token_ids")).alias("token_ids"), fine(n).alias("num_tokens"), fine(F.col("confs")).alias("confs"),
        text.extract_answer("text").alias("extracted_answer"), "error",
    )


def raw_output_lines(spark: SparkSession, path: str) -> DataFrame:
    """``raw_outputs`` of a folder of JSON lines, with the file and error rows kept."""
    return raw_outputs(spark.read.text(path).where("trim(value) <> ''").select(F.col("_metadata.file_name").alias("file"), "value"), keep=["file"])
