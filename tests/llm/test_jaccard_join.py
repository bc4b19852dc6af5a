import random
import re

from traceloom.llm import jaccard_join
from traceloom.llm.graph import components

SCHEMA = "doc_id long, text string, id int, cls string"


def brute(rows, k=3, percent=90):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def corpus(seed, n=160):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(60)]
    base = [[r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 5, 11, 12, 13, 22, 40, 90, 150]))] for _ in range(n // 5)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE  two\n")]
    while len(rows) < n:
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        if r.random() < 0.3:
            w.append(r.choice(vocabulary))
        rows.append((len(rows), " ".join(w)))
    return rows


def test_join_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = jaccard_join.jaccard_join(spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA).repartition(3)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_light_sets_meet_by_subsets(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(jaccard_join, "light_boundary", lambda mean, percent: 24)
    got = jaccard_join.jaccard_join(spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_large_group_of_near_copies_and_exact_copies(spark):
    r = random.Random(5)
    base = ["a%d" % r.randrange(200) for _ in range(100)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(2):
            w[r.randrange(len(w))] = "z%d" % r.randrange(10**6)
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, "same text of some few words over and over again here") for i in range(80)]
    got = jaccard_join.jaccard_join(spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute(rows)


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert jaccard_join.jaccard_join(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "a b c d", 1, "x"), (None, "a b c d", 1, "x"), (7, "a b c d", 1, "x"), (7, "a b c d", 1, "x"), (8, None, 1, "x")]
    got = sorted(map(tuple, jaccard_join.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (None, 2, None, True), (7, 2, 7, True), (7, 2, 7, True), (8, 0, 8, True)], key=str)


def test_boundary_follows_the_costs():
    assert jaccard_join.light_boundary(1.0, 90) == 9
    assert jaccard_join.light_boundary(8.0, 90) == 17
    assert jaccard_join.overlap(10, 11, 90) == 10 and jaccard_join.overlap(19, 19, 90) == 18


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(50)] + [(5000, 5000)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = {}
    for row in got:
        groups.setdefault(row.comp, set()).add(row.id)
    assert sorted(map(len, groups.values())) == [1, 51, 301]


def test_wide_sketches_bound_the_difference_from_below():
    import numpy as np

    from traceloom.llm import linkage

    r = np.random.default_rng(4)
    for _ in range(300):
        common = r.integers(0, 1 << 63, r.integers(0, 400), dtype=np.uint64)
        x, y = (np.unique(np.concatenate([common, r.integers(0, 1 << 63, r.integers(0, 300), dtype=np.uint64)])) for _ in range(2))
        least = linkage.least_difference(linkage.wide_bits(x), linkage.wide_bits(y))
        assert least <= len(np.setxor1d(x, y)) and least == linkage.least_difference(linkage.wide_bits(y), linkage.wide_bits(x))
    x = r.integers(0, 1 << 63, 5000, dtype=np.uint64)
    assert linkage.least_difference(linkage.wide_bits(x), linkage.wide_bits(x)) == 0
    other = r.integers(0, 1 << 63, 5000, dtype=np.uint64)
    assert linkage.least_difference(linkage.wide_bits(x), linkage.wide_bits(other)) > 2000  # unlike sets are told apart
