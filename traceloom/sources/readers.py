"""Readers of the on-disk layouts, all with explicit schemas."""

from __future__ import annotations

import io
import pickle
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom import schemas
from traceloom.functions import text
from traceloom.operators.grid import carried


def questions(spark: SparkSession, path: str) -> DataFrame:
    """question_id (0-based line number), question, ground_truth. Blank lines are skipped but keep their number."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("question_id", "line"))
    row = F.from_json("line", schemas.QUESTIONS)
    return lines.where(text.strip("line") != "").select("question_id", row.alias("q")).select("question_id", "q.question", F.col("q.answer").alias("ground_truth"))


def thresholds(spark: SparkSession, by_question: dict[int, float]) -> DataFrame:
    """A literal table of per-question bars: as many rows as the caller wrote down."""
    return spark.createDataFrame(sorted(by_question.items()), "question_id int, bar double")


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Converted traces, partitioned by question."""
    return spark.read.schema(schemas.TRACES).option("recursiveFileLookup", "true").parquet(path)


def _number(dtype, data: bytes):
    import numpy as np

    if dtype.kind not in "biuf":
        raise pickle.UnpicklingError(f"{dtype} is no number")
    return np.frombuffer(data, dtype)[0].item()


def _dtype(name: str, *_):
    import numpy as np

    if not re.fullmatch(r"[<>=|]?[biuf]\d+", name):
        raise pickle.UnpicklingError(f"{name} is no type of numbers")
    return np.dtype(name)


class _Plain(pickle.Unpickler):
    """Unpickles containers, strings and numbers only: no global may be loaded, so nothing can run.

    Numbers of numpy are read by functions of this module and become plain ones.
    """

    def find_class(self, module, name):
        if (module, name) == ("numpy", "dtype"):
            return _dtype
        if module in ("numpy._core.multiarray", "numpy.core.multiarray") and name == "scalar":
            return _number
        raise pickle.UnpicklingError(f"{module}.{name} is not plain data")


def _phases(data) -> dict[str, list]:
    """Traces by phase of a document, of a batch (a bare list) or of a file with one trace."""
    if isinstance(data, list):
        return {"all": data}
    by_phase = {phase: data.get(f"{phase}_traces") for phase in ("all", "warmup", "final")}
    return {"all": [data]} if all(v is None for v in by_phase.values()) and ("text" in data or "confs" in data) else by_phase


def _unpickled(fail: bool):
    names = [f.name for f in schemas.TRACE.fields]
    columns = ["path", "phase", "trace_idx", "ground_truth", "conf_bar", *names, "error"]

    def traces(path: str, content: bytes) -> list[dict]:
        data = _Plain(io.BytesIO(content)).load()
        whole = data if isinstance(data, dict) else {}
        nth = re.search(r"trace_(\d+)\.pkl$", path)
        rows = []
        for phase, some in _phases(data).items():
            for i, t in enumerate(some or []):
                at = {"path": path, "phase": phase, "trace_idx": int(nth[1]) if nth else i}
                rows.append(at | {"ground_truth": whole.get("ground_truth"), "conf_bar": whole.get("conf_bar"), "error": None} | {n: t.get(n) for n in names})
        return rows

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):  # one file at a time
                try:
                    rows = traces(path, content)
                except Exception as e:  # noqa: BLE001  a broken file may hold anything
                    if fail:
                        raise
                    rows = [dict.fromkeys(columns) | {"path": path, "error": f"{type(e).__name__}: {e}"}]
                yield pd.DataFrame(rows, columns=columns, dtype=object)

    return run


def result_documents(spark: SparkSession, path: str, errors: str = "fail") -> DataFrame:
    """Traces of result documents written by the pickle protocol, with method, question and run from the file name.

    Files of one trace (``qid3_rid0/trace_0007.pkl``) and batches (``qid3_batch02.pkl``, a bare list) are read, too:
    their question comes from the path, ``batch`` orders a question's batches, and ``trace_idx`` is the number in the
    file name or the place in the batch. ``conf_bar`` is null where a document has none. ``tag`` is the third part of
    the name between underscores, null in shorter names.

    With ``errors="row"`` a file that cannot be read is one row with its path and ``error``; else it fails the read.

    A one-off conversion: write the result as Parquet and read that. Only plain data is accepted.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pkl").load(path).select("path", "content")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.TRACE.fields)
    if errors not in ("fail", "row"):
        raise ValueError(f"errors must be fail or row, not {errors!r}")
    rows = files.mapInPandas(_unpickled(errors == "fail"), f"path string, phase string, trace_idx int, ground_truth string, conf_bar double, {fields}, error string")
    name = F.element_at(F.split("path", "/"), -1)
    rows = rows.withColumn("tag", F.get(F.split(name, "_"), F.lit(2)))
    rows = rows if errors == "row" else rows.drop("error")
    named = rows.withColumn("file", text.parse_file_name(name))
    number = lambda pattern: F.regexp_extract("path", pattern, 1).try_cast("int")
    out = named.select("file.*", *rows.columns, number(r"_batch(\d+)\.pkl$").alias("batch"))
    return out.withColumn("question_id", F.coalesce(number(r"qid(\d+)(?:_batch\d+\.pkl|_rid[^/]*/trace_\d+\.pkl)$"), "question_id"))


def batch_records(spark: SparkSession, path: str) -> DataFrame:
    """Traces of batch-inference output: key, stop reason and text; manifests are not read.

    The last non-empty reasoning and text of a message count. Reasoning comes as a string or as an object with
    ``text``; the string column holds either, and the object's text is taken out of its JSON.
    """
    raw = spark.read.schema(schemas.BATCH_RECORD).option("pathGlobFilter", "*.jsonl.out").json(path)
    content = F.col("modelOutput.output.message.content")
    reasoning = F.transform(content, lambda c: F.coalesce(F.get_json_object(c["reasoningContent"]["reasoningText"], "$.text"), c["reasoningContent"]["reasoningText"]))
    last = lambda a: F.try_element_at(F.filter(a, lambda x: x.isNotNull() & (x != "")), F.lit(-1))
    full = text.join_reasoning(F.coalesce(last(reasoning), F.lit("")), F.coalesce(last(F.transform(content, lambda c: c["text"])), F.lit("")))
    rows = raw.select(text.record_key("recordId").alias("k"), F.coalesce("modelOutput.stopReason", F.lit("unknown")).alias("stop_reason"), full.alias("text"))
    return rows.select("k.*", "stop_reason", "text", text.extract_answer("text").alias("extracted_answer"))


def text_traces(spark: SparkSession, path: str) -> DataFrame:
    r"""One trace per line: JSON with ``text``, or plain text with literal ``\n`` for line breaks."""
    lines = spark.read.text(path)
    parsed = F.get_json_object("value", "$.text")
    return lines.select(F.when(F.lit(path.endswith(".jsonl")), parsed).otherwise(text.unescape_newlines("value")).alias("text"))


def probe_tree(spark: SparkSession, path: str, question_ids: list[int] | None = None) -> DataFrame:
    """Tidy checkpoint rows of a tree ``{prob_token}-probe/*.json``; bare ``{prob_token}`` folders are read, too."""
    raw = spark.read.schema(schemas.PROBE_FILE).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*_dp_probe.json").json(path)
    source = F.col("_metadata.file_path")
    rows = raw.select("ground_truth", F.explode("probe_results").alias("r"), text.parse_probe_name(F.element_at(F.split(source, "/"), -1)).alias("f"), F.regexp_extract(source, r"/(\d+)(?:-probe)?/[^/]*$", 1).alias("at"))
    flag = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(False)).alias(c)
    flags = [flag(c) for c in ("is_warmup", "is_deep_conf_truncated", "is_naturally_stopped", "is_out_of_budget")]
    out = rows.where("f IS NOT NULL AND at <> ''").select(
        F.col("f.qid").cast("short").alias("qid"), "f.run_id", F.col("f.rid").try_cast("int").alias("rid"), "f.base_ts", F.col("at").cast("int").alias("prob_token"), F.col("r.idx").cast("short").alias("trace_idx"),
        text.normalize_answer("r.answer").alias("answer"), "r.confidence", "r.token_usage", *flags, "ground_truth",
    )
    return out if question_ids is None else out.where(F.col("qid").isin(question_ids))


def probe_truths(rows: DataFrame) -> DataFrame:
    """qid, ground_truth from the earliest checkpoint only."""
    return rows.groupBy("qid").agg(F.min_by("ground_truth", F.struct("prob_token", "run_id")).alias("ground_truth"))


def checkpoint_csv(spark: SparkSession, path: str) -> DataFrame:
    """Per-question CSV of (filled) checkpoints: answers stay strings; unreadable numbers become null."""
    names = [*schemas.CHECKPOINTS.fields, *schemas.FILL_FLAGS.fields]
    raw = spark.read.option("header", "true").option("enforceSchema", "false").csv(path)
    typed = {}
    for f in names:
        if f.name in raw.columns:
            kind = f.dataType.simpleString()
            typed[f.name] = text.to_boolean(f.name) if kind == "boolean" else F.col(f.name).try_cast("double").try_cast(kind) if kind in ("smallint", "int") else F.col(f.name).try_cast(kind)
    return raw.withColumns(typed)


def voting_results(spark: SparkSession, path: str) -> DataFrame:
    """Detail CSV of a scoreboard, read as text and then cast: answers mix integers and LaTeX with commas."""
    raw = spark.read.schema(schemas.VOTING_RESULTS).option("header", "true").option("escape", '"').csv(path)
    return raw.withColumns({"is_correct": text.to_boolean("is_correct"), "num_votes": F.col("num_votes").try_cast("int"), "avg_confidence": F.col("avg_confidence").try_cast("double"), "question_id": F.col("question_id").try_cast("int")})


def candidate_probes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CANDIDATE_PROBE).option("multiLine", "true").option("pathGlobFilter", "*probe.json").option("recursiveFileLookup", "true").json(path)


def metric_points(points: DataFrame, axis: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """``points`` of every key at all positions of ``axis``; a missing one repeats the previous."""
    return carried(points, axis, keys, at, values)


def file_sizes(spark: SparkSession, path: str, glob: str = "*.json", field: str = "probe_results") -> DataFrame:
    """Size on disk, and type, element count and compact JSON length of one field of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    body = F.decode("content", "UTF-8")
    value = F.get_json_object(body, f"$.{field}")
    error = F.when(F.expr("try_parse_json(decode(content, 'UTF-8')) IS NULL"), F.lit("invalid JSON"))
    return files.select("path", F.col("length").alias("disk_bytes"), text.json_type(value).alias("type"), text.json_size(value).alias("count"), F.octet_length(value).alias("bytes"), error.alias("error"))


def missing(expected: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Resume: what is expected and does not exist yet."""
    return expected.join(existing, keys, "left_anti")


def merge_confidences(traces_: DataFrame, scored: DataFrame) -> DataFrame:
    """Traces with the confidences of a later scoring run, where it has them."""
    new = scored.select("question_id", "trace_idx", F.col("confs").alias("_c"), F.col("num_tokens").alias("_n"))
    out = traces_.join(new, ["question_id", "trace_idx"], "left")
    return out.withColumns({"confs": F.coalesce("_c", "confs"), "num_tokens": F.coalesce("_n", "num_tokens")}).drop("_c", "_n")
