"""Confidences of the tokens that spell an answer, found by prefix lengths of the tokens' texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.confidence import let


def last_place(text: Column, part: Column) -> Column:
    """0-based place of the last occurrence of ``part`` in ``text``; null if there is none or ``part`` is empty."""
    at = F.call_function("locate", F.reverse(part), F.reverse(text))
    return F.when((F.length(part) > 0) & (at > 0), F.length(text) - F.length(part) - at + 1)


def token_texts(tokens: DataFrame, keys: list[str], order: list[str], token: str, conf: str) -> DataFrame:
    """keys, text, ends, confs: a trace's text, where each token ends in it, and the tokens' confidences, in order.

    The ends are running sums over one sort; a trace's arrays are as long as the trace.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    ended = tokens.withColumn("_end", F.sum(F.length(token)).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_at", F.row_number().over(w))
    rows = ended.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", F.col(token).alias("t"), F.col("_end").cast("long").alias("e"), F.col(conf).alias("c")))).alias("_r"))
    return rows.select(*keys, F.array_join("_r.t", "").alias("text"), F.col("_r.e").alias("ends"), F.col("_r.c").alias("confs"))


def first_reaching(ends: Column, goal: Column) -> Column:
    """1-based place of the first of the rising ``ends`` that is ``goal`` or more (one past the last, if none), by bisection."""
    size = F.size(ends)
    begin = F.struct(F.lit(1).alias("low"), (size + 1).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        reached = F.element_at(ends, middle) >= goal
        step = F.struct(F.when(reached, s["low"]).otherwise(middle + 1).alias("low"), F.when(reached, middle).otherwise(s["high"]).alias("high"))
        return F.when(s["low"] < s["high"], step).otherwise(s)

    steps = F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int"))
    return F.aggregate(steps, begin, halve, lambda s: s["low"])


def answer_span(text: Column, ends: Column, confs: Column, answer: Column) -> Column:
    """first, last (1-based tokens), mean, max and min confidence of the answer's last occurrence; zeros where it is absent
    or confidences do not fit the tokens."""
    start = last_place(text, answer)
    usable = start.isNotNull() & (F.size(ends) == F.size(confs)) & (F.size(ends) > 0)

    def found(at: Column) -> Column:
        first = first_reaching(ends, at + 1)
        last = first_reaching(ends, at + F.length(answer))
        return let(F.struct(first.alias("first"), last.alias("last")), lambda s: let(F.slice(confs, s["first"], s["last"] - s["first"] + 1), lambda own: summary(s["first"], s["last"], own)))

    def summary(first: Column, last: Column, own: Column) -> Column:
        total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x.cast("double"))
        return F.struct(first.alias("first"), last.alias("last"), (total / F.size(own)).alias("mean"), F.array_max(own).cast("double").alias("max"), F.array_min(own).cast("double").alias("min"))

    none = F.struct(F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("max"), F.lit(0.0).alias("min"))
    return F.when(usable, found(start)).otherwise(none)
