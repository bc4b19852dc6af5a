"""Explicit schemas of the logical tables; readers never infer types."""

from pyspark.sql import types as T

INTS, DOUBLES, STRINGS = (T.ArrayType(t()) for t in (T.IntegerType, T.DoubleType, T.StringType))

QUESTIONS = T.StructType().add("question", "string").add("answer", "string")
TRACE = (
    T.StructType()
    .add("stop_reason", "string").add("text", "string").add("token_ids", INTS).add("num_tokens", "integer").add("confs", DOUBLES).add("group_confs", DOUBLES)
    .add("min_conf", "double").add("extracted_answer", "string").add("is_correct", "boolean")
)
TRACES = T.StructType([T.StructField("question_id", T.IntegerType()), T.StructField("run_id", T.StringType()), T.StructField("phase", T.StringType()), T.StructField("trace_idx", T.IntegerType()), *TRACE.fields])
PROBE_ROW = (
    T.StructType()
    .add("idx", "integer").add("answer", "string").add("confidence", "float").add("token_usage", "integer").add("is_warmup", "boolean").add("is_deep_conf_truncated", "boolean")
    .add("is_naturally_stopped", "boolean").add("is_out_of_budget", "boolean")
)
PROBE_FILE = T.StructType().add("ground_truth", "string").add("probe_results", T.ArrayType(PROBE_ROW))
CHECKPOINTS = (
    T.StructType()
    .add("qid", "short").add("run_id", "string").add("rid", "integer").add("base_ts", "string").add("prob_token", "integer").add("trace_idx", "short").add("answer", "string").add("confidence", "float")
    .add("token_usage", "integer").add("is_warmup", "boolean").add("is_deep_conf_truncated", "boolean").add("is_naturally_stopped", "boolean").add("is_out_of_budget", "boolean")
)
FILL_FLAGS = T.StructType().add("observed", "boolean").add("is_propagated_file", "boolean").add("is_propagated_trace", "boolean").add("is_propagated", "boolean").add("source_prob_token", "integer")
VOTING_RESULTS = (
    T.StructType()
    .add("method", "string").add("question_id", "string").add("run_id", "string").add("filename", "string").add("voting_method", "string").add("predicted_answer", "string").add("ground_truth", "string")
    .add("is_correct", "string").add("num_votes", "string").add("avg_confidence", "string")
)
CANDIDATE_PROBE = (
    T.StructType()
    .add("question_id", "integer").add("question", "string").add("ground_truth", "string").add("candidates", STRINGS).add("num_candidates", "integer").add("prob_token", "integer")
    .add(
        "aggregation",
        T.StructType().add("majority_answer", "string").add("majority_ratio", "double").add("entropy", "double").add("confidence", "double").add("is_correct", "boolean").add("accuracy", "double").add("num_unique", "integer"),
    )
    .add("raw_answers", STRINGS).add("token_usages", INTS).add("token_usage", "integer")
)
_PART = T.StructType().add("reasoningContent", T.StructType().add("reasoningText", "string")).add("text", "string")
_MESSAGE = T.StructType().add("content", T.ArrayType(_PART))
BATCH_RECORD = (
    T.StructType()
    .add("recordId", "string")
    .add("modelInput", T.StructType().add("messages", T.ArrayType(T.StructType().add("content", T.ArrayType(T.StructType().add("text", "string"))))))
    .add("modelOutput", T.StructType().add("stopReason", "string").add("output", T.StructType().add("message", _MESSAGE)))
)
CONF_CHECKPOINT = T.StructType().add("question_id", "integer").add("trace_idx", "integer").add("confs", DOUBLES).add("num_tokens", "integer")
