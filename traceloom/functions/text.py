"""Text scalars: answer extraction and normalisation, file names, small formats. Column expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(_col(c), r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def extract_answer(text: Column | str) -> Column:
    """The content after the last ``boxed``: balanced braces, else up to the first ``$``; null without ``boxed``.

    An unbalanced brace runs to the end; nothing after ``boxed`` gives an empty string. White space around the content
    is dropped in either form.
    """
    t = _col(text)
    tail = F.element_at(F.split(t, "boxed"), -1)
    # Depth after each character of the tail; the content ends where it first returns to zero. Only positions of
    # braces matter, so the fold runs over them and not over all characters.
    pieces = F.split(tail, r"(?<=[{}])|(?=[{}])")
    state = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end")),
        lambda s, p: F.struct(
            (s["depth"] + F.when(p == "{", 1).when(p == "}", -1).otherwise(0)).alias("depth"),
            (s["at"] + F.length(p)).alias("at"),
            F.when((s["end"] < 0) & (p == "}") & (s["depth"] == 1), s["at"]).otherwise(s["end"]).alias("end"),
        ),
    )
    braced = F.when(state["end"] < 0, F.substring(tail, 2, 1 << 30)).otherwise(F.substring(tail, F.lit(2), state["end"] - 1))
    plain = strip(F.element_at(F.split(tail, r"\$"), 1))
    return F.when(~t.contains("boxed"), F.lit(None)).when(tail == "", F.lit("")).when(tail.startswith("{"), strip(braced)).otherwise(plain)


def extract_simple_answer(text: Column | str) -> Column:
    """``extract_answer`` where braces do not nest: one regular expression."""
    return F.nullif(F.regexp_extract(_col(text), r"(?s)^.*boxed\{([^{}]*)\}", 1), F.lit(""))


def unwrap_text(answer: Column | str) -> Column:
    r"""Each ``\text{...}`` replaced by its content, however deep; an unclosed one is left alone.

    Every closing brace after an opened ``\text{`` closes one of them, and the first opened are the ones that go. One
    fold over the parts between openings counts the closed ones, a second one joins what is left.
    """
    parts = F.split(_col(answer), r"\\text\{", -1)
    closings = F.transform(parts, lambda p: F.size(F.split(p, r"\}", -1)) - 1)
    opened = lambda s, first: s + F.when(first, 0).otherwise(1)
    step = F.struct(F.lit(0).alias("open"), F.lit(0).alias("closed"), F.lit(True).alias("first"))

    def count(s: Column, c: Column) -> Column:
        now = opened(s["open"], s["first"])
        k = F.least(now, c)
        return F.struct((now - k).alias("open"), (s["closed"] + k).alias("closed"), F.lit(False).alias("first"))

    closed = F.aggregate(closings, step, count, lambda s: s["closed"])
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("open"), F.lit(0).alias("seen"), F.lit(True).alias("first"))

    def join(most: Column):
        def fold(s: Column, part: Column) -> Column:
            now = opened(s["open"], s["first"])
            mark = F.when(s["first"] | (s["seen"] < most), "").otherwise("\\text{")
            pieces = F.split(part, r"\}", -1)
            k = F.least(now, F.size(pieces) - 1)
            rest = F.when(k < F.size(pieces) - 1, F.concat(F.lit("}"), F.array_join(F.slice(pieces, k + 2, F.size(pieces)), "}"))).otherwise("")
            out = F.concat(s["out"], mark, F.array_join(F.slice(pieces, F.lit(1), k + 1), ""), rest)
            return F.struct(out.alias("out"), (now - k).alias("open"), (s["seen"] + F.when(s["first"], 0).otherwise(1)).alias("seen"), F.lit(False).alias("first"))

        return fold

    unwrapped = F.get(F.transform(F.array(closed), lambda most: F.aggregate(parts, begin, join(most), lambda s: s["out"])), F.lit(0))
    return F.when(_col(answer).contains("\\text{"), unwrapped).otherwise(_col(answer))


def normalize_answer(answer: Column | str) -> Column:
    """Stripped; null and blank become ``<EMPTY>``."""
    return F.coalesce(F.nullif(strip(answer), F.lit("")), F.lit("<EMPTY>"))


def probe_answer(continuation: Column | str) -> Column:
    r"""Answer of a text that continues ``\boxed{``; falls back to the stripped text without closing braces."""
    c = _col(continuation)
    rest = strip(F.regexp_replace(strip(c), r"\}+$", ""))
    return F.nullif(F.coalesce(F.nullif(extract_answer(F.concat(F.lit("\\boxed{"), c)), F.lit("")), rest), F.lit(""))


def with_box(continuation: Column | str) -> Column:
    return F.concat(F.lit("\\boxed"), _col(continuation))


def shorten(c: Column | str, n: int = 40) -> Column:
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def last_chars(c: Column | str, n: int = 200) -> Column:
    return F.right(_col(c), F.lit(n))


def unescape_newlines(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("\\n"), F.lit("\n"))


def numbers(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_col(c), F.lit(r"(\d+)"), 1))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def to_boolean(c: Column | str) -> Column:
    """true / false in any case; null for all else."""
    low = F.lower(strip(c))
    return F.when(low == "true", True).when(low == "false", False)


def human_bytes(n: Column | str) -> Column:
    n = _col(n).cast("double")
    out = F.format_string("%d B", n.cast("long"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        out = F.when(n >= 1024.0**k, F.concat(F.format_string("%.2f", n / 1024.0**k), F.lit(f" {unit}"))).otherwise(out)
    return out


def stamp(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyyMMdd_HHmmss")


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, and 0 where b is not positive."""
    a, b = _col(a), _col(b)
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def batch_size(mean_length: Column | str, ladder: tuple[tuple[int, int], ...] = ((2048, 64), (8192, 16), (16384, 8), (32768, 4)), least: int = 1) -> Column:
    """Batch size by mean length: the first step whose bound is not exceeded."""
    out = F.lit(least)
    for bound, size in reversed(ladder):
        out = F.when(_col(mean_length) <= bound, F.lit(size)).otherwise(out)
    return out


def depths(n_tokens: Column | str, interval: int = 2048, most: int | None = None) -> Column:
    """Multiples of ``interval`` up to ``n_tokens`` and ``n_tokens`` itself, none beyond ``most``."""
    n = _col(n_tokens)
    steps = F.when(n >= interval, F.sequence(F.lit(interval), n, F.lit(interval))).otherwise(F.array().cast("array<int>"))
    out = F.array_distinct(F.concat(steps, F.array(n)))
    return out if most is None else F.filter(out, lambda d: d <= most)


def budget_list(text: str) -> list[int]:
    """Sorted distinct integers of a comma-separated list."""
    return sorted({int(part) for part in text.split(",") if part.strip()})


# File names of result documents: (method, question, run, time stamp). Fixed patterns of the on-disk layout.
SIMPLE_NAME = r"_simple_qid(\d+)_rid([^_]+)_(\d{8}_\d{6})\.pkl$"
ONLINE_NAME = r"_qid(\d+)_rid([^_]+)_(\d{8}_\d{6})\.pkl$"
PROBE_NAME = r"_qid(\d+)_rid([^_]+)_(\d{8}_\d{6})_online_w(\d+)_p(\d+)_(.+?)_dp_probe\.json$"


def parse_file_name(name: Column | str) -> Column:
    """Struct (method, question_id, run_id, ts): ``simple`` is tried before ``original``; else ``unknown``, question 0."""
    n = _col(name)

    def fields(pattern: str, method: str) -> Column:
        part = lambda k: F.regexp_extract(n, pattern, k)
        return F.struct(F.lit(method).alias("method"), part(1).cast("int").alias("question_id"), part(2).alias("run_id"), part(3).alias("ts"))

    none = F.struct(F.lit("unknown").alias("method"), F.lit(0).alias("question_id"), F.lit(None).cast("string").alias("run_id"), F.lit(None).cast("string").alias("ts"))
    return F.when(n.rlike(SIMPLE_NAME), fields(SIMPLE_NAME, "simple")).when(n.rlike(ONLINE_NAME), fields(ONLINE_NAME, "original")).otherwise(none)


def parse_probe_name(name: Column | str) -> Column:
    part = lambda k: F.regexp_extract(_col(name), PROBE_NAME, k)
    out = F.struct(
        part(1).cast("int").alias("qid"), part(2).alias("rid"), part(3).alias("base_ts"), part(4).cast("int").alias("warmup"), part(5).cast("int").alias("percentile"), part(6).alias("run_id")
    )
    return F.when(_col(name).rlike(PROBE_NAME), out)


def loose_question(name: Column | str) -> Column:
    return F.coalesce(F.expr("try_cast(null as int)") if name is None else F.nullif(F.regexp_extract(_col(name), r"qid(\d+)", 1), F.lit("")).cast("int"), F.lit(0))


def record_key(record_id: Column | str) -> Column:
    """``dataset__question__trace_i`` as (dataset, question_id, trace_idx)."""
    r = _col(record_id)
    return F.struct(
        F.split_part(r, F.lit("__"), F.lit(1)).alias("dataset"),
        F.split_part(r, F.lit("__"), F.lit(2)).try_cast("int").alias("question_id"),
        F.nullif(F.regexp_extract(r, r"trace_(\d+)$", 1), F.lit("")).cast("int").alias("trace_idx"),
    )


def join_reasoning(reasoning: Column | str, content: Column | str) -> Column:
    """Reasoning, newline, content; whichever of them is not empty."""
    return F.concat_ws("\n", F.nullif(_col(reasoning), F.lit("")), F.nullif(_col(content), F.lit("")))


def prompt(question: Column | str, system: str = "", cue: str = "\n\nPut the final answer within \\boxed{}.") -> Column:
    return F.concat(F.lit(system), _col(question), F.lit(cue))


def chat(question: Column | str, system: str | None = None, effort: str | None = None, template: str = "<|{role}|>\n{content}\n", answer: str = "<|assistant|>\n") -> Column:
    """A question as a chat: an optional system turn, which names the ``effort`` if there is one, the user's, and the answer's opening.

    ``template`` stands for the model's own chat template, which is not part of the engine.
    """
    head = "\n".join(x for x in (system, f"Reasoning: {effort}" if effort else None) if x)
    before, after = template.split("{content}")
    turn = lambda role, c: F.concat(F.lit(before.replace("{role}", role)), c, F.lit(after))
    turns = ([turn("system", F.lit(head))] if head else []) + [turn("user", _col(question)), F.lit(answer)]
    return F.concat(*turns)


def probe_prompt(chat_: Column, thinking: Column | str, cue: str = "</think>\nThe answer is \\boxed") -> Column:
    """A chat whose thinking is cut off by a cue that asks for the answer."""
    return F.concat(chat_, _col(thinking), F.lit(cue))


def choice_prompt(chat_: Column, thinking: Column | str, candidates: Column | str) -> Column:
    """A chat whose thinking ends in the choice among candidates."""
    named = F.array_join(_col(candidates), ", ")
    return F.concat(chat_, _col(thinking), F.lit("I need to choose one from the candidate answers ["), named, F.lit("]</think>\nThe answer is \\boxed"))


def candidate_prompt(candidates: Column | str) -> Column:
    """Phrase that offers no, one, or several numbered candidates."""
    c = _col(candidates)
    many = F.array_join(F.transform(c, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), ", ")
    return F.when(F.size(c) == 0, F.lit("")).when(F.size(c) == 1, F.concat(F.lit("A candidate answer is: "), F.get(c, F.lit(0)))).otherwise(F.concat(F.lit("Candidate answers are: "), many))


def json_type(j: Column | str) -> Column:
    """array, object or scalar; null for invalid JSON."""
    j = _col(j)
    return F.when(F.json_array_length(j).isNotNull(), "array").when(F.json_object_keys(j).isNotNull(), "object").when(j.isNotNull(), "scalar")


def json_size(j: Column | str) -> Column:
    """Number of elements of a JSON array, or keys of an object; 0 for a scalar."""
    j = _col(j)
    return F.coalesce(F.json_array_length(j), F.size(F.json_object_keys(j)), F.lit(0))


def json_bytes(j: Column | str) -> Column:
    """Bytes of any JSON value without the blanks between its parts; null for invalid JSON."""
    listed = F.get_json_object(F.concat(F.lit("["), _col(j), F.lit("]")), "$")  # in a list a string keeps its quotes
    return F.octet_length(listed).cast("long") - 2
