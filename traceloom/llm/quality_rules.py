"""Quality rules: a learned decision list over text statistics, built only from DataFrame expressions.

``text_statistics`` adds the statistics, ``learn_rules`` grows and prunes conjunctions of thresholds by
sequential covering on labelled statistics, and ``Rules.verdict`` is the ordered Spark conditional.

Defined results: a null text counts as empty, and a text of any length is measured whole; repeated rows are judged
alike; with no usable labels the list is empty and only the base rule rejects; an empty table gives no rows. ``judge``
replaces input columns that have the names of its results; ``accepted`` leaves every column as it is, whatever its name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import private, written

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"

#: Ratios that the rules may put thresholds on, as SQL over the statistics.
FEATURES = {
    "symbols_per_word": "_q.n_symbols / greatest(_q.n_words, 1)",
    "chars_per_word": "_q.word_chars / greatest(_q.n_words, 1)",
    "dup_line_share": "_q.n_dup_lines / greatest(_q.n_lines, 1)",
    "repeat_share": "_q.n_repeat_words / greatest(_q.n_words, 1)",
    "upper_share": "_q.n_upper / greatest(_q.word_chars, 1)",
    "bangs_per_word": "_q.n_bangs / greatest(_q.n_words, 1)",
    "digit_share": "_q.n_digits / greatest(_q.word_chars, 1)",
    "words_per_line": "_q.n_words / greatest(_q.n_lines, 1)",
    "n_words": "cast(_q.n_words as double)",
}


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with one more column ``_q``, a struct of the statistics of ``text`` (null: none, all zero).

    Repeated three-word windows are found by a 64-bit hash of the window, within one text only.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, WORD_BREAK), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step1 = df.withColumns({"_qt": t, "_qw": words, "_ql": lines})
    windows = F.when(
        F.size("_qw") >= 3,
        F.transform(F.sequence(F.lit(0), F.size("_qw") - 3), lambda i: F.xxhash64(F.get("_qw", i), F.get("_qw", i + 1), F.get("_qw", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    step2 = step1.withColumn("_qh", windows)
    placed = F.when(
        F.size(F.array_distinct("_qh")) < F.size("_qh"),
        F.sort_array(F.transform("_qh", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    step3 = step2.withColumn("_qs", placed)
    again = F.expr(
        "transform(filter(sequence(0, size(_qs) - 1), k -> (k > 0 AND get(_qs, k).h = get(_qs, k - 1).h)"
        " OR (k < size(_qs) - 1 AND get(_qs, k).h = get(_qs, k + 1).h)), k -> get(_qs, k).i)"
    )
    step4 = step3.withColumn("_qp", F.when(F.col("_qs").isNotNull(), again))
    covered = F.expr("size(array_union(array_union(_qp, transform(_qp, p -> p + 1)), transform(_qp, p -> p + 2)))")
    spaces = F.regexp_count("_qt", F.lit(r"[\x20\x09-\x0D]"))
    statistics = F.struct(
        F.size("_qw").cast("long").alias("n_words"),
        (F.length("_qt") - spaces).cast("long").alias("word_chars"),
        F.regexp_count("_qt", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_ql") - F.size(F.array_distinct("_ql"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_qp").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.size("_ql").cast("long").alias("n_lines"),
        F.regexp_count("_qt", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("_qt", F.lit("!")).cast("long").alias("n_bangs"),
        F.regexp_count("_qt", F.lit("[0-9]")).cast("long").alias("n_digits"),
    )
    return step4.withColumn("_q", statistics).drop("_qt", "_qw", "_ql", "_qh", "_qs", "_qp")


def base_failed() -> Column:
    return F.expr("_q.n_words < 50 OR 100 * _q.n_repeat_words > 50 * _q.n_words")


@dataclass
class Condition:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"(({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D)"


@dataclass
class Rules:
    """Ordered conjunctions; the first that fires rejects."""

    rules: list[list[Condition]] = field(default_factory=list)

    def verdict(self) -> Column:
        """True for a text that no rule rejects, over a frame with ``_q``."""
        out = None
        for rule in self.rules:
            hit = F.expr(" AND ".join(c.sql() for c in rule))
            out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def fired(self) -> Column:
        """Number of the rule that fires, from 1; 0: none."""
        out = F.lit(0)
        for k in range(len(self.rules), 0, -1):
            out = F.when(F.expr(" AND ".join(c.sql() for c in self.rules[k - 1])), F.lit(k)).otherwise(out)
        return out


def learn_rules(
    labelled: DataFrame,
    bad: str,
    max_labelled: int = 12_000,
    n_thresholds: int = 24,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_precision: float = 0.9,
    min_covered: int = 8,
) -> Rules:
    """Sequential covering over ``labelled`` (with ``_q`` and the boolean ``bad``).

    At most ``max_labelled`` rows, taken in the order of a hash of their statistics, are fitted on; two thirds
    grow rules, one third prunes them. Every step is one aggregate whose result has one row per feature and
    threshold, so the driver never holds more than ``len(FEATURES) * (2 * n_thresholds + 2)`` counts.
    """
    names = list(FEATURES)
    columns = [F.expr(FEATURES[n]).alias(n) for n in names]
    rows = (
        labelled.where(F.col(bad).isNotNull())
        .select(*columns, F.col(bad).cast("int").alias("bad"))
        .withColumn("order", F.xxhash64(*names, "bad"))
        .orderBy("order")
        .limit(max_labelled)
    )
    rows = written(rows, "quality-labelled")
    # Quantiles of all values and of the positive ones, and half the least positive value as a margin above zero.
    steps = [k / (n_thresholds + 1) for k in range(1, n_thresholds + 1)]
    positive = {n: F.when(F.col(n) > 0, F.col(n)) for n in names}
    cuts = rows.agg(
        *[F.percentile_approx(n, steps, 10_000).alias(n) for n in names],
        *[F.percentile_approx(positive[n], steps, 10_000).alias(f"p_{n}") for n in names],
        *[(F.min(positive[n]) / 2).alias(f"m_{n}") for n in names],
    ).first()
    thresholds = {n: sorted({float(x) for x in [*(cuts[n] or []), *(cuts[f"p_{n}"] or []), cuts[f"m_{n}"]] if x is not None and math.isfinite(x)}) for n in names}
    bins = [F.expr("+".join([f"int({n} > {x!r}D)" for x in thresholds[n]]) or "0").alias(f"b_{n}") for n in names]
    rows = written(rows.select(*bins, *names, "bad", (F.pmod("order", F.lit(3)) == 0).alias("held")), "quality-binned")

    rules: list[list[Condition]] = []

    def where(rule: list[Condition]) -> Column:
        return F.expr(" AND ".join(f"({c.feature} {'>' if c.above else '<='} {c.threshold!r}D)" for c in rule) or "true")

    def left() -> DataFrame:
        out = rows
        for rule in rules:
            out = out.where(~where(rule))
        return out

    def counts(frame: DataFrame) -> dict[str, list[tuple[int, int]]]:
        cell = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(f"b_{n}").alias("b")) for n in names])).alias("c")
        got = frame.select(cell, "bad").groupBy("c.f", "c.b").agg(F.sum("bad").alias("p"), F.count("*").alias("n")).collect()
        out = {n: [(0, 0)] * (len(thresholds[n]) + 1) for n in names}
        for r in got:
            out[r["f"]][r["b"]] = (r["p"], r["n"] - r["p"])
        return out

    def best(frame: DataFrame) -> tuple[float, Condition | None, float]:
        gain, chosen, precision = 0.0, None, 0.0
        for n, cells in counts(frame).items():
            pos, neg = sum(c[0] for c in cells), sum(c[1] for c in cells)
            if not pos:
                continue
            before, p, q = math.log2(pos / (pos + neg)), 0, 0
            for k, t in enumerate(thresholds[n]):
                p, q = p + cells[k][0], q + cells[k][1]
                for above, a, b in ((False, p, q), (True, pos - p, neg - q)):
                    if a < min_covered:
                        continue
                    # Information gain times a steep power of the precision: a pure rule beats a wide, impure one.
                    g = a * (math.log2(a / (a + b)) - before) * ((a + 1) / (a + b + 2)) ** 8
                    # Of equally good thresholds the one furthest from what the rule leaves alone.
                    if g > gain + 1e-9 or above and chosen and g > gain - 1e-9 and (chosen.feature, chosen.above) == (n, True):
                        gain, chosen, precision = g, Condition(n, above, t), a / (a + b)
        return gain, chosen, precision

    while len(rules) < max_rules:
        rule: list[Condition] = []
        growing = left().where(~F.col("held"))
        while len(rule) < max_conditions:
            _, condition, precision = best(growing.where(where(rule)))
            if condition is None:
                break
            rule.append(condition)
            if precision >= 0.995:
                break
        if not rule:
            break
        held = left().where("held")
        prefixes = [rule[:k] for k in range(1, len(rule) + 1)]
        got = held.agg(
            *[F.coalesce(F.sum(F.when(where(p), F.col("bad"))), F.lit(0)).alias(f"p{k}") for k, p in enumerate(prefixes)],
            *[F.count_if(where(p)).alias(f"n{k}") for k, p in enumerate(prefixes)],
        ).first()
        smoothed = [(got[f"p{k}"] + 1) / (got[f"n{k}"] + 2) if got[f"n{k}"] else 0.0 for k in range(len(prefixes))]
        covers = [got[f"p{k}"] for k in range(len(prefixes))]
        fits = [k for k in range(len(prefixes)) if smoothed[k] >= min_precision and covers[k] >= min_covered // 3]
        if not fits:
            break
        rules.append(prefixes[max(fits, key=lambda k: covers[k] * smoothed[k])])
    return Rules(rules)


def labelled_statistics(documents: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """Statistics and ``bad`` of at most ``max_labelled`` labelled documents, chosen by a hash of their id.

    The chosen ids are bounded by that parameter, so they may be broadcast and only their texts are measured.
    """
    chosen = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    picked = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return text_statistics(picked).select("_q", (F.col("quality") == 0).alias("bad"))


def judge(documents: DataFrame, labels: DataFrame, max_labelled: int = 12_000, **fit) -> DataFrame:
    """``documents`` with ``_q``, ``base_failed``, ``fired`` and ``kept``."""
    labelled = written(labelled_statistics(documents, labels, max_labelled), "quality-statistics")
    rules = learn_rules(labelled, "bad", max_labelled, **fit)
    judged = text_statistics(documents.drop("_q", "base_failed", "fired", "kept"))
    # A filter on ``kept`` must stay above the statistics: pushed below, it would repeat their expressions many times
    # over. Spark moves no filter past a value that it cannot compute twice, so a condition that always holds on such
    # a value is part of ``kept``.
    once = F.monotonically_increasing_id() >= 0
    judged = judged.withColumn("base_failed", base_failed()).withColumn("fired", rules.fired())
    return judged.withColumn("kept", once & ~F.col("base_failed") & rules.verdict())


def accepted(documents: DataFrame, labels: DataFrame, max_labelled: int = 12_000, **fit) -> DataFrame:
    """The rows of ``documents`` that are kept, all columns as they are."""
    (row,) = private(documents.select("doc_id", "text"), "row")
    whole = documents.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias(row))
    return judge(whole, labels, max_labelled, **fit).where("kept").select(f"{row}.*")
