"""The local search of packing: it keeps every piece, empties bins and ends in a local optimum."""

import random
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from traceloom.llm import packing


def lengths(groups):
    return sum((Counter({s: m * g.count for s, m in g.items.items()}) for g in groups), Counter())


def bins(groups):
    return sum(g.count for g in groups)


def improves(groups, capacity):
    """Whether any move or exchange of one or two for one raises the sum of squared fills, by trying each."""
    under = [g for g in groups if g.fill < capacity]
    for a in under:
        gives = [(s,) for s in a.items] + list(combinations(a.items, 2)) + [(s, s) for s, m in a.items.items() if m > 1]
        for b in under:
            if a is b and a.count < 2:
                continue
            for give in gives:
                for back in (*((0,) if len(give) == 1 else ()), *b.items):
                    more = sum(give) - back
                    if max(b.fill + more, a.fill - more) <= capacity and (b.fill + more) ** 2 + (a.fill - more) ** 2 > a.fill**2 + b.fill**2:
                        return True
    return False


@pytest.mark.parametrize(("n", "low", "high", "at_most"), [(6000, 600, 760, 2152), (3000, 500, 1100, 1254)])
def test_hard_mixes_lose_bins_and_end_in_a_local_optimum(n, low, high, at_most):
    r = random.Random(n)
    histogram = Counter(r.randint(low, high) for _ in range(n))
    first = packing.best_fit(histogram, 2048)
    last = packing.local_search(first, 2048)
    assert lengths(last) == lengths(first) == histogram
    assert max(g.fill for g in last) <= 2048
    assert bins(last) < bins(first) and bins(last) <= at_most
    assert not improves(last, 2048)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 9), max_size=9))
def test_search_ends_at_the_bound_or_in_a_local_optimum(histogram):
    # One piece a bin is the worst start, so that the search has all the work.
    start = [packing.Group(n, Counter({s: 1})) for s, n in histogram.items()]
    last = packing.local_search(start, 20)
    assert lengths(last) == Counter(histogram)
    assert all(g.fill <= 20 for g in last)
    bound = -(-sum(s * n for s, n in histogram.items()) // 20)
    assert bins(last) == bound or not improves(last, 20)


def test_ties_and_repeats_of_one_length():
    assert bins(packing.local_search([packing.Group(9, Counter({10: 1}))], 20)) == 5
    assert packing.local_search([], 20) == []


def test_search_empties_bins_of_documents(spark):
    """Document lengths in words, one document a bin to begin with: moves alone must drain most bins."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.selectExpr("least(size(split(coalesce(text, ''), ' ')), 2048) AS n").groupBy("n").count().collect()
    start = [packing.Group(r["count"], Counter({r["n"]: 1})) for r in rows]
    last = packing.local_search(start, 2048)
    bound = -(-sum(r["n"] * r["count"] for r in rows) // 2048)
    assert lengths(last) == lengths(start)
    assert bins(last) < bins(start) and (bins(last) == bound or not improves(last, 2048))
