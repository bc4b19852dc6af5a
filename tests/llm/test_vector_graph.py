import numpy as np

from traceloom.llm import vector_graph
from traceloom.llm.vector_graph import near_duplicates

SCHEMA = "vec_id long, embedding array<double>, label long, pid string"


def brute(rows, threshold=0.98):
    usable = [(i, np.array(v, float) / np.abs(np.array(v, float)).max(), l) for i, v, l, _ in rows if l is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.abs(v).max() > 0]
    links = {i: set() for i, *_ in rows}
    for k, (i, x, a) in enumerate(usable):
        for j, y, b in usable[k + 1 :]:
            if a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[i].add(j), links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        out[i] = (len(links[i]), min(seen))
    return out


def corpus(seed, n, groups=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, 16))
    rows = []
    for i in range(n):
        v = centres[r.integers(groups)] + r.normal(size=16) * r.choice([0.0, 0.05, 0.08, 0.2, 1.0])
        rows.append((i, v.tolist(), int(r.integers(3)), "x"))
    return rows


def check(spark, rows):
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = brute(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.component_id == r.vec_id) for r in got)


def test_equals_brute_force(spark):
    odd = [[0.0] * 16, None, [], [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0], [1e300] * 16, [1e-300] * 16]
    rows = corpus(1, 150) + [(1000 + k, v, 1, "x") for k, v in enumerate(odd)] + [(2000, [1.0] * 16, None, "x"), (2001, [1.0] * 16, None, "x")]
    check(spark, rows)


def test_many_shards_keep_the_recall(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "SHARD", 60)
    monkeypatch.setattr(vector_graph, "SHARD_MOST", 120)
    rows = corpus(2, 700, 40)
    got = {r.vec_id: r.n_links for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    true, found = sum(n for n, _ in want.values()), sum(got.values())
    assert found >= 0.97 * true and all(got[i] <= want[i][0] for i in got)


def test_empty_and_copies(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame([(5, [1.0, 2.0], 1, "x")] * 3 + [(4, [2.0, 4.0], 1, "y")], SCHEMA)).collect()))
    assert got == [(4, 3, 4, True), (5, 3, 4, False), (5, 3, 4, False), (5, 3, 4, False)]


def test_graph_search_reaches_what_is_near():
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 8))
    x[150:] = x[:150] + r.normal(size=(150, 8)) * 0.02
    x /= np.linalg.norm(x, axis=1)[:, None]
    gram = x @ x.T
    found = vector_graph.search(gram, vector_graph.build(gram), 0.98)
    assert (found | found.T)[gram >= 0.98].mean() > 0.97


def at_angles(spark, degrees):
    rows = [(i, 1, [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))]) for i, d in enumerate(degrees)]
    return spark.createDataFrame(rows, "pid long, label long, unit array<double>")


def test_range_expansion_crosses_shards_until_nothing_is_new(spark):
    pair = "a long, b long"
    links, graph = spark.createDataFrame([(0, 1)], pair), spark.createDataFrame([(1, 2), (2, 3), (3, 4)], pair)
    got = vector_graph._expand(at_angles(spark, [0, 3, 6, 9, 20]), links, graph, 0.98).collect()
    assert {(r.a, r.b) for r in got} >= {(0, 1), (0, 2), (0, 3)} and all(r.b < 4 for r in got)


def test_lost_links_are_compared_exactly(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "SHARD_MOST", 60)
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(vector_graph, "_links", lambda points, threshold, overlap: (none, none))
    rows = corpus(5, 300)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), overlap=24).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)


def test_an_audit_with_too_few_links_says_so(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "AUDIT", 4)
    monkeypatch.setattr(vector_graph, "AUDIT_MOST", 4)
    points = at_angles(spark, [40 * k for k in range(8)] + [1])
    none = spark.createDataFrame([], "a long, b long")
    assert vector_graph._audited(points, none, 0.98) is None
    monkeypatch.setattr(vector_graph, "AUDIT_MOST", 64)
    assert vector_graph._audited(points, none, 0.98) == 0.0
