import random

import numpy as np

from traceloom.llm import line_dedup
from traceloom.llm.line_dedup import dedup_lines, jaccard

SCHEMA = "doc_id long, text string, row int, comp string"


def brute(rows, threshold=0.8):
    lines = [(d, i, x) for d, t in sorted(rows) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
    texts = sorted({x for _, _, x in lines})
    parent = {x: x for x in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if jaccard(a, b) >= threshold:
                parent[root(a)] = root(b)
    seen, gone = set(), set()
    for d, i, x in lines:
        if root(x) in seen:
            gone.add((d, i))
        seen.add(root(x))
    out = {}
    for d, t in rows:
        left = [x for i, x in enumerate((t or "").split("\n")) if (d, i) not in gone]
        out[d] = "\n".join(left) if any(x.strip() for x in left) else ""
    return out


def corpus(seed, n):
    r = random.Random(seed)
    base = [" ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(r.choice([1, 4, 30]))) for _ in range(n)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(r.randrange(5)):
            x = r.choice(base)
            if r.random() < 0.4 and len(x) > 60:
                at = r.randrange(len(x))
                x = x[:at] + "#" + x[at + 1 :]
            lines.append(x)
        rows.append((i, "\n".join([*lines, ""] if r.random() < 0.3 else lines)))
    return rows


def run(spark, rows):
    got = dedup_lines(spark.createDataFrame([(d, t, 1, "c") for d, t in rows], SCHEMA).repartition(3)).collect()
    return {r.doc_id: r.text for r in got}


def test_equals_brute_force(spark):
    rows = [*corpus(1, 60), (100, None), (101, ""), (102, "\n \n"), (103, "tiny"), (104, "tiny\n\ntiny\nother"), (105, "x" * 50_000)]
    assert run(spark, rows) == brute(rows)


def test_large_bucket_of_near_copies(spark):
    r = random.Random(4)
    base = "".join(r.choice("abcdefgh ") for _ in range(400))
    rows = []
    for i in range(90):
        x = list(base)
        for _ in range(2):
            x[r.randrange(400)] = r.choice("XYZ")
        rows.append((i, "own line %d of this document, %s\n%s" % (i, "".join(r.choice("klmnop") for _ in range(40)), "".join(x))))
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_null_ids(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []
    assert run(spark, [(None, "the same line"), (5, "the same line"), (5, "the same line")]) == {None: "the same line", 5: ""}


def test_short_lines_with_one_changed_letter_go(spark):
    r = random.Random(11)
    base = ["".join(r.choice("abcdefghijklmnopqrst ") for _ in range(70)) for _ in range(12)]
    got = run(spark, [(i, x) for i, x in enumerate(base)] + [(100 + i, x[:35] + "#" + x[36:]) for i, x in enumerate(base)])
    assert all(got[i] == x and got[100 + i] == "" for i, x in enumerate(base))


def test_signatures_estimate_similarity():
    r = random.Random(7)
    a = "".join(r.choice("abcdefghijklmnop ") for _ in range(3000))
    b = a[:2700] + "".join(r.choice("abcdefghijklmnop ") for _ in range(300))

    def sig(x):
        code = np.frombuffer(x.encode("utf-32-le"), "<u4")
        start, end, _ = line_dedup._spans(code)
        return line_dedup.signatures(*line_dedup._shingles(code, start, end, line_dedup.line_hash(code, start, end)))[0]

    assert abs((sig(a) == sig(b)).mean() - jaccard(a, b)) < 0.2 and (sig(a) == sig(a)).all()


def test_shared_bands_are_found_from_packed_keys(spark):
    from traceloom.llm.linkage import meeting

    r = random.Random(3)
    rows = [([r.randrange(-(2**63), 2**63) for _ in range(4)], i, i % 50) for i in range(300)]
    rows += [([rows[i][0][0], rows[i][0][1], 7], 1000 + i, 9) for i in range(0, 300, 3)]
    rows += rows[10:20] + [([-5, -5], 5000, 1), (None, 5001, 1)]  # repeated rows and keys are no second member
    got = meeting(spark.createDataFrame(rows, "keys array<long>, id long, n long").repartition(5), 4).collect()
    places = {(k, i, n) for ks, i, n in rows for k in ks or ()}
    ids = {}
    for k, i, _ in places:
        ids.setdefault(k, set()).add(i)
    assert sorted(map(tuple, got)) == sorted(p for p in places if len(ids[p[0]]) > 1)
    assert meeting(spark.createDataFrame([], "keys array<long>, id long, n long"), 4).count() == 0


def test_links_of_a_large_group_leave_their_task_as_a_forest():
    import pyarrow as pa

    from traceloom.llm import linkage

    n = 40
    texts = ["".join(f"{i:03d}-" for i in range(60)) + f"{k:02d}" for k in range(n)]
    columns = [pa.array(np.concatenate([x, x]).astype(np.int64)) for x in (np.zeros(n), np.arange(n), np.arange(n), np.full(n, 240))]
    columns.insert(1, pa.array(np.repeat([0, 1], n)))
    columns += [pa.array(np.zeros(2 * n, np.int64))] * linkage.WORDS + [pa.array([None] * 2 * n, pa.binary()), pa.array(texts * 2)]
    batch = pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(columns))])
    pairs = lambda exact: sum(b.num_rows for b in linkage._compare(1 / 9, 0.0, False, exact)(iter([batch])))
    assert pairs(None) == n * (n - 1) and pairs((line_dedup._grams, line_dedup._near(0.8))) == n - 1
    assert pairs((line_dedup._grams, line_dedup._near(0.999))) == 0


def test_tables_of_the_work_are_deleted(spark):
    import os

    from traceloom.llm.common import work_folder

    folder = f"{work_folder(spark).removeprefix('file://')}/traceloom"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = corpus(9, 30)
    out = line_dedup.drop_repeated_lines(spark.createDataFrame([(d, t, 1, "c") for d, t in rows], SCHEMA))
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == {"lines-gone", "lines-again"}
    assert {r.doc_id: r.text for r in out.collect() if r.text} == {d: t for d, t in brute(rows).items() if t}


def test_sketches_rule_out_no_link_and_most_other_pairs():
    from traceloom.llm import linkage

    r = random.Random(5)
    base = ["".join(r.choice("abcdefghijklmnop ") for _ in range(700)) for _ in range(60)]
    texts = base + [x[:350] + "#" + x[351:] for x in base]
    sets, first = line_dedup._hashed(texts)
    n = np.diff(first)
    assert n.tolist() == [len(line_dedup._grams(t)) for t in texts]
    sketch = linkage.xor_rows(sets >> np.uint64(64 - line_dedup.KEPT), np.repeat(np.arange(len(n)), n), len(n))
    near = linkage._near(sketch, sketch, n, n, 1 / 9, 0.8)
    links = np.array([[jaccard(x, y) >= 0.8 for y in texts] for x in base])
    assert (near[: len(base)] == links).all() and links.sum() == 2 * len(base)


def test_verdicts_by_hashes_are_those_of_the_shingles():
    import pyarrow as pa

    r = random.Random(8)
    pairs = [("ab", "ab"), ("ab", "ac"), ("aaaaaaaaaa", "aaaaa"), ("", "x"), ("\U0001f600" * 9, "\U0001f600" * 5)]
    for n in (6, 40, 400, 90_000):
        x = "".join(r.choice("abcdefg ") for _ in range(n))
        for edits in (0, 1, 2, 5, n // 45, n // 40):
            y = list(x)
            for _ in range(edits):
                y[r.randrange(n)] = "#"
            pairs.append((x, "".join(y)))
    ids = pa.array(range(len(pairs)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, *(pa.array(x) for x in zip(*pairs))], ["a", "b", "ta", "tb"])
    (got,) = line_dedup._linked(0.8)(iter([batch]))
    assert got["a"].to_pylist() == [i for i, (x, y) in enumerate(pairs) if jaccard(x, y) >= 0.8 - 1e-12]


def test_packed_shingles_are_the_shingles():
    def plain(t):
        return {t[i : i + 5] for i in range(max(1, len(t) - 4))}

    r = random.Random(8)
    alphabets = ["ab", "abcdefgé ", "a\x00", "ab漢\U0001f600", "a࿿က"]
    texts = ["".join(r.choice(a) for _ in range(r.randrange(1, 60))) for a in alphabets for _ in range(40)]
    texts += ["a", "a\x00", "a\x00\x00\x00\x00", "漢", "漢\x00", "漢\x00\x00\x00\x00"]
    for s in texts:
        x = line_dedup._grams(s)
        assert len(x) == len(plain(s))
        for t in r.choices(texts, k=30) + texts[-6:]:
            assert line_dedup._common(x, line_dedup._grams(t)) == len(plain(s) & plain(t)), (s, t)
    assert line_dedup._grams("a" * 9).dtype == np.uint64  # a number each, not a string


def test_small_groups_pair_their_members_in_the_task(spark):
    from traceloom.llm.linkage import SMALL_BUCKET, meeting

    r = random.Random(4)
    rows = [([r.randrange(30), 100 + r.randrange(300), 7 if k < SMALL_BUCKET + 5 else 8], k, r.choice([10, 11, 20])) for k in range(SMALL_BUCKET + 60)]
    packed = [(np.array(ks, np.int64).tobytes(), i, n) for ks, i, n in rows]
    ids = {}
    for ks, i, n in rows:
        for k in ks:
            ids.setdefault(k, set()).add((i, n))
    pairs = {(k, i, n, j, m) for k, x in ids.items() if len(x) <= SMALL_BUCKET for i, n in x for j, m in x if i < j and min(n, m) >= 0.8 * max(n, m)}
    large = {(k, i, n, None, None) for k, x in ids.items() if len(x) > SMALL_BUCKET for i, n in x}
    for keys, data in (("array<long>", rows), ("binary", packed)):
        got = meeting(spark.createDataFrame(data, f"keys {keys}, id long, n long").repartition(3), 3, 0.8).collect()
        assert len(got) == len(set(got)) and {tuple(g) for g in got} == pairs | large


def test_texts_are_fetched_once_and_equal_rows_are_found_without_the_texts(spark, monkeypatch):
    labels = []
    written = line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, label, **k: labels.append(label) or written(df, label, **k))
    line = "one line of the corpus that is long enough to be compared, number "
    docs = [(k, f"{line}{k % 7} {'x' * (k % 3)}\n \nother {k}") for k in range(60)] + [(1, docs_text := f"{line}again\n\nand more"), (1, docs_text), (2, " \n"), (2, " \n"), (3, None)]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(docs) and labels.count("lines-texts") == 1
    assert sorted(g.n_kept for g in got if g.doc_id == 1 and "again" in (g.text or "again") and g.n_lines == 2)[0] == 0
    assert [(g.text, g.n_lines, g.n_kept) for g in got if g.doc_id == 2 and g.n_lines == 0] == [("", 0, 0)] * 2
