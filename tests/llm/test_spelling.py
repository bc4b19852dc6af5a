import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from traceloom.llm import spelling


def distance_is_one(a, b):
    if a == b:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] == 1


def brute(rows):
    """Every word against every other."""
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    words = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and distance_is_one(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = []
    for w, k in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, k, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def varied(r, word):
    i, c = r.randrange(len(word) + 1), r.choice("abcdé")
    return r.choice([word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :]])


def corpus(seed, stems, docs):
    r = random.Random(seed)
    base = ["".join(r.choice("abcd") for _ in range(r.randrange(6, 12))) for _ in range(stems)] + ["École" + "x" * 3, "abcdefgh", "ABCDEFGH×"]
    pool = base + [varied(r, r.choice(base)) for _ in range(stems * 2)]
    weights = [r.choice([1, 1, 5, 60]) for _ in pool]
    rows = [(i if i % 9 else None, " ".join(r.choices(pool, weights, k=r.randrange(80))) + r.choice(["", ".", " 12", "\n"]), "w", 7) for i in range(docs)]
    return rows + [(1, None, "w", 0), (2, "", None, 0), (3, "abcdefgh " * 3000, "w", 0)] + [rows[1]] * 3


SCHEMA = "doc_id long, text string, word string, n int"


def test_groups_equal_brute_force(spark):
    rows = corpus(1, 120, 120)
    got = sorted((tuple(x) for x in spelling.variant_groups(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str)
    want = brute(rows)
    assert got == want
    assert any(x[1] and x[2] != x[1] for x in want) or any(x[1] for x in want)


def test_hot_ends_are_split(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LEAST_SHARD", 20)
    monkeypatch.setattr(spelling, "MOST_SHARD", 20)
    monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    r = random.Random(3)
    rows = [(i, " ".join("the" + "".join(r.choice("ab") for _ in range(r.randrange(4, 8))) + "ing" for _ in range(60)), "", 0) for i in range(20)]
    got = sorted((tuple(x) for x in spelling.variant_groups(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def test_chains_of_forms_reach_their_last(spark):
    rows = [("aaaaaaaa", "aaaaaaab"), ("aaaaaaab", "aaaaaabb"), ("aaaaaabb", "aaaaabbb"), ("aaaaabbb", "aaaabbbb"), ("zzzzzzzz", "zzzzzzzy")]
    got = dict(spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect())
    assert got == {w: "aaaabbbb" if w[0] == "a" else "zzzzzzzy" for w, _ in rows}


def test_empty_table(spark):
    out = spelling.variant_groups(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]


@settings(max_examples=300, deadline=None)
@given(st.text("abé", min_size=7, max_size=11), st.text("abé", min_size=7, max_size=11))
def test_one_edit_and_shards_are_exact(a, b):
    assert spelling.one_edit(a, b) == distance_is_one(a, b)
    shard = spelling.Shard()
    for role in (0, 1):
        shard.add(role, b, 5)
    found = [x for role in (0, 1) for x in shard.near(role, a)]
    assert found == ([(b, 5)] if distance_is_one(a, b) else [])
