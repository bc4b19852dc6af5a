"""Answer equivalence in two levels: a pure-column LaTeX normal form, and a vectorised numeric evaluator.

``normal_form`` compares as text after notation is unified; ``equivalent`` also evaluates both sides as numbers or
tuples of numbers. Lists that differ only in spacing count as equal.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip, unwrap_text


def normal_form(answer: Column | str) -> Column:
    r"""Unwrapped, with ``\dfrac``, ``\tfrac``, delimiters' sizes, spacing commands, dollars and spaces removed."""
    a = unwrap_text(answer)
    a = F.regexp_replace(a, r"\\[dt]frac", r"\\frac")
    a = F.regexp_replace(a, r"\\(left|right|,|;|!|:|quad|qquad)(?![a-zA-Z])", "")
    a = F.regexp_replace(a, r"\^\{?\\circ\}?|\\%|%|\$", "")
    a = F.regexp_replace(a, r"\s+", "")
    return F.regexp_replace(a, r"\.$", "")


def exact_equal(a: Column | str, b: Column | str) -> Column:
    """Equal normal forms; two single letters are equal in any case. Null if either is null."""
    x, y = normal_form(a), normal_form(b)
    letters = strip(x).rlike("^[A-Za-z]$") & strip(y).rlike("^[A-Za-z]$")
    return F.when(letters, F.lower(x) == F.lower(y)).otherwise(x == y)


_TOKEN = re.compile(r"\s*(\d+\.\d+|\.\d+|\d+|\\[a-zA-Z]+|[-+*/^!(){},\[\]])")


class _Parser:
    """Recursive descent over numbers, fractions, roots, powers, factorials, pi and products."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(text)
            self.tokens.append(m[1])
            at = m.end()
            while at < len(text) and text[at].isspace():
                at += 1
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, want: str | None = None) -> str:
        token = self.peek()
        if token is None or want is not None and token != want:
            raise ValueError(want)
        self.at += 1
        return token

    def items(self) -> list[float]:
        out = [self.total()]
        while self.peek() == ",":
            self.take()
            out.append(self.total())
        if self.peek() is not None:
            raise ValueError(self.peek())
        return out

    def total(self) -> float:
        sign = -1.0 if self.peek() == "-" else 1.0
        if self.peek() in ("-", "+"):
            self.take()
        value = sign * self.product()
        while self.peek() in ("+", "-"):
            value = value + self.product() if self.take() == "+" else value - self.product()
        return value

    def product(self) -> float:
        value = self.power()
        while (token := self.peek()) is not None:
            if token in ("*", "\\cdot", "\\times"):
                self.take()
                value *= self.power()
            elif token in ("/", "\\div"):
                self.take()
                value /= self.power()
            elif token in ("(", "{", "\\frac", "\\sqrt", "\\pi") or token[0].isdigit():
                value *= self.power()
            else:
                break
        return value

    def power(self) -> float:
        value = self.atom()
        while self.peek() in ("^", "!"):
            if self.take() == "!":
                if value < 0 or value != int(value) or value > 170:
                    raise ValueError("factorial")
                value = float(math.factorial(int(value)))
            else:
                exponent = self.signed()
                if abs(exponent) > 4096:
                    raise ValueError("exponent")
                value = math.pow(value, exponent)
        return value

    def signed(self) -> float:
        if self.peek() == "-":
            self.take()
            return -self.atom()
        return self.atom()

    def group(self, close: str) -> float:
        value = self.total()
        self.take(close)
        return value

    def argument(self) -> float:
        token = self.peek()
        if token and token[0].isdigit() and len(token) > 1 and "." not in token:
            self.tokens[self.at : self.at + 1] = list(token)  # \frac12 takes single digits
        return self.atom()

    def atom(self) -> float:
        token = self.take()
        if token == "{":
            return self.group("}")
        if token == "(":
            return self.group(")")
        if token == "\\frac":
            return self.argument() / self.argument()
        if token == "\\sqrt":
            degree = 2.0
            if self.peek() == "[":
                self.take()
                degree = self.group("]")
            return math.pow(self.argument(), 1.0 / degree)
        if token == "\\pi":
            return math.pi
        return float(token)


def _clean(text: str) -> str:
    text = re.sub(r"\\text\{([^}]*)\}", r"\1", text)
    text = re.sub(r"\\[dt]frac", r"\\frac", text)
    text = re.sub(r"\\(left|right|quad|qquad)(?![a-zA-Z])|\\[,;!:]|\\[ ]|\$", "", text)
    return text.replace("\\{", "{").replace("\\}", "}").strip().rstrip(".")


@lru_cache(maxsize=100_000)
def values(answer: str) -> tuple[float, ...] | None:
    """The numbers that an answer stands for, or None if it is not read as numbers."""
    text = _clean(answer)
    # A number with grouped thousands is read as one number, not as a list.
    grouped = re.fullmatch(r"-?\d{1,3}(,\d{3})+(\.\d+)?", text)
    for candidate in (text.replace(",", "") if grouped else text,):
        for inner in (candidate, candidate[1:-1] if candidate[:1] in "([" and candidate[-1:] in ")]" else None):
            if inner is None:
                continue
            try:
                got = tuple(_Parser(inner).items())
            except (ValueError, ZeroDivisionError, OverflowError, RecursionError):
                continue
            if all(math.isfinite(x) for x in got):
                return got
    return None


def same_answer(a: str | None, b: str | None, tolerance: float = 1e-9) -> bool:
    """Never raises: unreadable answers are equal only as text."""
    if a is None or b is None:
        return False
    x, y = re.sub(r"\s+", "", _clean(a)), re.sub(r"\s+", "", _clean(b))
    if x == y or len(x) == len(y) == 1 and x.isalpha() and x.lower() == y.lower():
        return True
    p, q = values(a), values(b)
    if p is None or q is None or len(p) != len(q):
        return False
    return all(math.isclose(u, v, rel_tol=tolerance, abs_tol=tolerance) for u, v in zip(p, q, strict=True))


@F.pandas_udf(T.BooleanType())
def _same(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_answer(x, y) for x, y in zip(a, b, strict=True)])


def with_equivalence(df: DataFrame, a: str, b: str, out: str = "is_equiv") -> DataFrame:
    """``df`` with ``out``: equivalence of columns a and b, decided once per distinct pair."""
    pairs = df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    decided = pairs.withColumn(out, F.coalesce(exact_equal(a, b), F.lit(False)) | _same(F.col(a), F.col(b)))
    return df.join(decided, [a, b], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def verdict(same: Column, answer: Column | str, truth: Column | str, unsure: str = "text") -> Column:
    """Correctness from ``same``, the equivalence that is null where it could not be decided.

    ``unsure`` says what counts then: ``text`` compares the plain strings, and a missing answer is wrong; ``false`` is
    wrong; ``null`` compares the stripped strings, and only a missing answer gives null.
    """
    a, t = (F.col(c) if isinstance(c, str) else c for c in (answer, truth))
    none = F.lit(None).cast("boolean")
    if unsure == "text":
        return F.when(F.coalesce(a, F.lit("")) == "", False).when(F.coalesce(t, F.lit("")) == "", False).otherwise(F.coalesce(same, a == t))
    if unsure == "false":
        return F.when(a.isNull() | t.isNull(), False).otherwise(F.coalesce(same, F.lit(False)))
    if unsure == "null":
        return F.when(a.isNull(), none).otherwise(F.coalesce(same, strip(a) == strip(t), F.lit(False)))
    raise ValueError(f"unknown rule {unsure!r}")
