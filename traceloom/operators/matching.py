"""Order-dependent matching, per question and vectorised: answer clusters and fuzzy question matching."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.functions.equivalence import same_answer
from traceloom.functions.text import jaccard, numbers


def cluster_answers(answers: DataFrame, keys: list[str], order: list[str], answer: str = "answer", truth: str | None = None) -> DataFrame:
    """keys, answer, canonical: each distinct answer with the first equivalent one, or the truth it is equivalent to.

    Distinct answers are found before the grouped step, which holds the distinct answers of one question only.
    """
    first = answers.groupBy(*keys, answer).agg(F.min(F.struct(*order)).alias("_first"), *([F.max(truth).alias("_truth")] if truth else []))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in first.select(*keys).schema.fields), f"{answer} string", "canonical string"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_k=[tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in pdf["_first"]]).sort_values(["_k", answer])
        heads: list[str] = []
        out = []
        for _, row in pdf.iterrows():
            a = row[answer]
            if truth and isinstance(row["_truth"], str) and same_answer(a, row["_truth"]):
                out.append(row["_truth"])
                continue
            head = next((h for h in heads if same_answer(a, h)), None)
            if head is None:
                heads.append(a)
                head = a
            out.append(head)
        return pdf[[*keys, answer]].assign(canonical=out)

    return first.groupBy(*keys).applyInPandas(run, schema)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts' first 300 characters."""
    return pd.Series([SequenceMatcher(None, x[:300], y[:300]).ratio() for x, y in zip(a, b, strict=True)])


def match_questions(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, score): greedy one-to-one matches by half text ratio, half shared numbers, best first.

    Both sides are question sets of some dozens of rows per dataset, so all pairs of a dataset are scored; the greedy
    choice is sequential by nature and runs once per dataset on its pairs. Columns: dataset, id, question.
    """
    a = left.select("dataset", F.col("id").alias("left_id"), F.col("question").alias("lq"))
    b = right.select("dataset", F.col("id").alias("right_id"), F.col("question").alias("rq"))
    score = 0.5 * sequence_ratio("lq", "rq") + 0.5 * jaccard(numbers("lq"), numbers("rq"))
    pairs = a.join(b, "dataset").withColumn("score", score).select("dataset", "left_id", "right_id", "score")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "left_id", "right_id"], ascending=[False, True, True])
        used_l, used_r, out = set(), set(), []
        for row in pdf.itertuples(index=False):
            if row.left_id not in used_l and row.right_id not in used_r:
                used_l.add(row.left_id), used_r.add(row.right_id)
                out.append(row)
        return pd.DataFrame(out, columns=pdf.columns)

    return pairs.groupBy("dataset").applyInPandas(greedy, pairs.schema)
