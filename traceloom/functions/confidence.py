"""Confidence metrics of a trace, as expressions over its array of token confidences.

Sliding means come from prefix sums, so their cost is linear in the trace whatever the window. ``operators.windows``
has the same metrics for traces kept one token per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def array_mean(a: Column | str) -> Column:
    """Mean; null for an empty array."""
    a = _col(a)
    return F.when(F.size(a) > 0, _total(a) / F.size(a))


def token_confidence(logprobs: Column | str, decimals: int | None = 3) -> Column:
    """Negative mean of each token's top log-probabilities; tokens without any are skipped."""
    means = F.transform(F.filter(_col(logprobs), lambda x: F.size(x) > 0), lambda x: -array_mean(x))
    return means if decimals is None else F.transform(means, lambda x: F.round(x, decimals))


def prompt_confidence(logprobs: Column | str, prompt_length: Column | str, decimals: int | None = 3) -> Column:
    """``token_confidence`` of what follows a prompt of ``prompt_length`` tokens."""
    lp, n = _col(logprobs), _col(prompt_length)
    return token_confidence(F.slice(lp, n + 1, F.greatest(F.size(lp) - n, F.lit(0))), decimals)


def mean_confidence(confs: Column | str) -> Column:
    return F.coalesce(array_mean(confs), F.lit(0.0))


def suffix(a: Column | str, n: Column | int) -> Column:
    a = _col(a)
    k = F.least(F.lit(n) if isinstance(n, int) else n, F.size(a))
    return F.slice(a, F.size(a) - k + 1, k)


def prefix(a: Column | str, n: Column | int) -> Column:
    a = _col(a)
    return F.slice(a, F.lit(1), F.greatest(F.lit(n) if isinstance(n, int) else n, F.lit(0)))


def tail_confidence(confs: Column | str, n: int = 2048) -> Column:
    """Mean of the last ``n``; 0 if there are none."""
    return F.coalesce(array_mean(suffix(confs, n)), F.lit(0.0))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: the variable of a lambda holds it, where Spark would inline it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(a: Column | str) -> Column:
    """[0, a1, a1 + a2, ...].

    Spark has no scan over arrays, so sums are taken in blocks of about sqrt(n): block totals first, then within
    each block, for O(n sqrt(n)) additions instead of O(n^2).
    """

    def within(blocks: Column, totals: Column) -> Column:
        def block_sums(block: Column, b: Column) -> Column:
            return let(_total(F.slice(totals, F.lit(1), b)), lambda base: F.transform(block, lambda _, i: base + _total(F.slice(block, F.lit(1), i + 1))))

        return F.flatten(F.transform(blocks, block_sums))

    def blocks_of(x: Column) -> Column:
        n = F.size(x)
        width = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))
        cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda b: F.slice(x, b * width + 1, width))
        return F.when(n > 0, cut).otherwise(F.array().cast("array<array<double>>"))

    inner = let(_col(a), lambda x: let(blocks_of(x), lambda bl: let(F.transform(bl, _total), lambda t: within(bl, t))))
    return F.concat(F.array(F.lit(0.0)), inner)


def sliding_means(confs: Column | str, window: int = 2048, decimals: int | None = None) -> Column:
    """Means of all full windows; of a shorter array its one plain mean, unrounded; ``[0]`` for an empty one."""

    def means(a: Column) -> Column:
        n = F.size(a)
        mean = lambda s, e: (F.get(s, e) - F.get(s, e - window)) / window
        shown = (lambda x: x) if decimals is None else (lambda x: F.round(x, decimals))
        full = let(prefix_sums(a), lambda s: F.transform(F.sequence(F.lit(window), n), lambda e: shown(mean(s, e))))
        return F.when(n >= window, full).when(n > 0, F.array(array_mean(a))).otherwise(F.array(F.lit(0.0)))

    return let(_col(confs), means)


def min_confidence(groups: Column | str) -> Column:
    return F.array_min(_col(groups))


def lowest_mean(groups: Column | str, share: float = 0.1) -> Column:
    """Mean of the lowest ``share`` of window means, at least one; a negative share means the minimum."""
    if share < 0:
        return F.array_min(_col(groups))
    k = lambda g: F.greatest(F.floor(F.size(g) * F.lit(float(share))).cast("int"), F.lit(1))
    return let(F.sort_array(_col(groups)), lambda g: let(F.slice(g, F.lit(1), k(g)), array_mean))


def bottom_window_confidence(confs: Column | str, window: int = 2048, share: float = 0.1) -> Column:
    return lowest_mean(sliding_means(confs, window), share)


def min_window_confidence(confs: Column | str, window: int = 2048) -> Column:
    return bottom_window_confidence(confs, window, -1.0)


def probe_window_metrics(confs: Column | str, window: int, depth: Column | int | None = None) -> Column:
    """Struct (min, max, mean, last) of window means over the first ``depth`` tokens."""
    a = _col(confs) if depth is None else prefix(confs, depth)
    last = tail_confidence(a, window)
    return let(sliding_means(a, window), lambda g: F.struct(F.array_min(g).alias("min"), F.array_max(g).alias("max"), array_mean(g).alias("mean"), last.alias("last")))


def checkpoint_confidence(confs: Column | str, depth: Column | int, window: int = 2048) -> Column:
    """Mean of the up to ``window`` tokens before ``depth``; null without confidences."""
    return array_mean(suffix(prefix(confs, depth), window))


def summary_confidence(confs: Column | str) -> tuple[Column, Column]:
    """Rounded mean and maximum of all tokens."""
    a = _col(confs)
    return F.round(array_mean(a), 3), F.round(F.array_max(a), 3)


#: Pluggable trace metrics by name.
METRICS = {
    "mean": lambda c, **k: mean_confidence(c),
    "tail": lambda c, tail=2048, **k: tail_confidence(c, tail),
    "bottom_window": lambda c, window=2048, share=0.1, **k: bottom_window_confidence(c, window, share),
    "min_window": lambda c, window=2048, **k: min_window_confidence(c, window),
}


def metric(name: str, confs: Column | str, strict: bool = True, **options) -> Column:
    """The metric of that name; an unknown one is an error or, if not ``strict``, means ``mean``."""
    if name not in METRICS and strict:
        raise ValueError(f"unknown confidence metric {name!r}; known: {sorted(METRICS)}")
    return METRICS.get(name, METRICS["mean"])(confs, **options)
