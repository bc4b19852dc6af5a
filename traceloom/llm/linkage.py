"""Components of a similarity graph from buckets, without listing all pairs of a large bucket.

Given memberships (key, id, n) such that any two ids that link share a key, ``link_components`` returns the components
of the graph of links. Every id has a sketch, a bitmap of ``WORDS`` longs that bounds similarity from above: two sets
differ in at least as many elements as their bitmaps in bits (each distinct element flips a bit, so that no link is
lost). What a sketch rules out is never looked at again.

* Buckets of at most ``SMALL_BUCKET`` members pair their members within the bucket; sketches and the number of shared
  keys rule pairs out; of the others each id verifies one, and the rest only where its ends are still apart.
* A larger bucket first compares its most central member with the others. What is then still outside the bucket's main
  component is compared with the whole bucket, by sketches, block by block inside tasks: no pair becomes a row unless
  its sketches pass. First each task sends only a forest of such pairs, then all pairs whose ends are still apart.

Nothing is capped: what is never verified is either already connected or provably unlinked.

Where most keys have one member, ``meeting`` finds the shared ones first: keys travel packed, many to a row, are sorted
in tasks, and small buckets pair their members there. Where payloads decide links (``exact``), the last round decides inside its tasks, too, and sends only
a forest of links, so that no group makes rows by the square of its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, sized, tidy, written
from .graph import components

#: Buckets of at most this many members pair them by a join: a bound on the rows made per member.
SMALL_BUCKET = 24
#: Members in a part of what is outside, and in a block of the bucket, that one task compares.
PART, BLOCK = 512, 2048
#: Longs in a sketch.
WORDS = 8
BITS = [f"s{i}" for i in range(WORDS)]
SKETCH = ", ".join(f"{b} long" for b in BITS)
#: Large buckets (24 bytes each) that are sent to all executors; more are joined by a shuffle.
FEW_KEYS = 1_000_000
#: Places that a task packs at a time; elements of prepared payloads that it keeps.
PACKED, PREPARED = 1 << 19, 400_000


def xor_rows(h: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """(rows, WORDS) sketches as ``xor_bits`` makes them: the distinct elements ``h`` belong to the sets ``owner``."""
    counts = np.bincount(owner * (WORDS * 64) + (h & np.uint64(WORDS * 64 - 1)).astype(np.int64), minlength=rows * WORDS * 64)
    return np.packbits((counts & 1).astype(bool)).view(np.int64).reshape(rows, WORDS)


def xor_bits(h: np.ndarray) -> np.ndarray:
    """The sketch of one set of distinct elements."""
    counts = np.bincount((h & np.uint64(WORDS * 64 - 1)).astype(np.int64), minlength=WORDS * 64)
    return np.packbits((counts & 1).astype(bool)).view(np.int64)


def wide_bits(h: np.ndarray) -> bytes:
    """A sketch as ``xor_bits`` makes it, of at least a bit per element: its size is the power of two from len(h) on."""
    size = max(64, 1 << (len(h) - 1).bit_length()) if len(h) else 64
    return np.packbits((np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(bool)).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound on the elements in which two sets differ, from their ``wide_bits``; the longer one is folded first."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(p) > len(q):
        p, q = q, p
    if len(q) > len(p):
        q = np.bitwise_xor.reduce(q.reshape(-1, len(p)), axis=0)
    return int(np.bitwise_count(p ^ q).sum())


def _near(p: np.ndarray, q: np.ndarray, p_n: np.ndarray, q_n: np.ndarray, slack: float, ratio: float) -> np.ndarray:
    """Boolean (p, q): pairs that sketches, and sizes further apart than ``ratio``, do not rule out."""
    p, q = p.astype(np.int64).view(np.uint64), q.astype(np.int64).view(np.uint64)  # of a negative number the bits of its absolute value would count
    out = np.zeros((len(p), len(q)), bool)
    for at in range(0, len(p), 64):
        differ = np.zeros((len(p[at : at + 64]), len(q)), np.int32)
        for w in range(WORDS):
            differ += np.bitwise_count(p[at : at + 64, None, w] ^ q[None, :, w])
        a, b = p_n[at : at + 64, None], q_n[None, :]
        out[at : at + 64] = (differ <= slack * (a + b) + 1e-6) & (np.minimum(a, b) >= ratio * np.maximum(a, b) - 1e-6)
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of the pairs (a, b) that a spanning forest takes, first come first taken."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    taken = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            taken.append(i)
    return np.array(taken, np.int64)


def _keys(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all rows, and how many each has; a row's keys are an array of longs or their bytes."""
    if not pa.types.is_binary(lists.type):
        return lists.flatten().to_numpy(), lists.value_lengths().fill_null(0).to_numpy()
    _, offsets, data = lists.buffers()
    at = np.frombuffer(offsets, np.int32)[lists.offset : lists.offset + len(lists) + 1]
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]].view(np.int64), np.diff(at) // 8


def _dealt(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            key, id_, n = (np.concatenate(x) for x in zip(*held, strict=True))
            part = ((key.view(np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")  # of short numbers a radix sort
            key, id_, n = key[order], id_[order], n[order].astype(np.int32)
            names, at = np.unique(part[order], return_index=True)
            spans = list(zip(at.tolist(), [*at[1:].tolist(), len(key)], strict=True))
            return pa.RecordBatch.from_arrays([pa.array(names), *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (key, id_, n))], ["part", "key", "id", "n"])

        for batch in batches:
            keys, each = _keys(batch.column(0))
            held.append((keys, np.repeat(batch.column(1).to_numpy(), each), np.repeat(batch.column(2).to_numpy(), each)))
            size += len(held[-1][0])
            if size >= PACKED:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()
        held = []
        tidy()

    return run


def _rows(names: list[str], *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of rows; names without a column are null."""
    for at in range(0, len(columns[0]), 1 << 16):
        some = [pa.array(x[at : at + (1 << 16)].astype(np.int64)) for x in columns]
        yield pa.RecordBatch.from_arrays(some + [pa.nulls(len(some[0]), pa.int64())] * (len(names) - len(some)), names)


def _paired(key: np.ndarray, id_: np.ndarray, n: np.ndarray, ratio: float) -> Iterator[pa.RecordBatch]:
    """Of places sorted by key and id: the pairs of small buckets that sizes do not rule out, the members of large ones."""
    names = ["key", "id", "n", "other", "other_n"]
    begins = np.flatnonzero(np.insert(key[1:] != key[:-1], 0, True)) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begins, len(key)))
    large = np.repeat(size > SMALL_BUCKET, size)
    yield from _rows(names, key[large], id_[large], n[large])
    key, id_, n = key[~large], id_[~large], n[~large]
    for apart in range(1, SMALL_BUCKET):
        a = np.flatnonzero(key[apart:] == key[:-apart])
        if not len(a):
            break
        b = a + apart
        fit = np.minimum(n[a], n[b]) >= ratio * np.maximum(n[a], n[b]) - 1e-6
        a, b = a[fit], b[fit]
        yield from _rows(names, key[a], id_[a], n[a], id_[b], n[b])


def _met(ratio: float | None):
    """Over rows (part, key, id, n) of packed places sorted by part: the distinct places of keys that two ids have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != part:
                    if held:
                        yield from places(held)
                    part, held = row[0], []
                held.append(row[1:])
        if held:
            yield from places(held)
        held = []
        tidy()

    def places(held: list) -> Iterator[pa.RecordBatch]:
        key, id_, n = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*held, strict=True), (np.int64, np.int64, np.int32), strict=True))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        order = order[np.append(same, False) | np.insert(same, 0, False)]
        order = order[np.lexsort((id_[order], key[order]))]
        key, id_, n = key[order], id_[order], n[order]
        new = np.insert((key[1:] != key[:-1]) | (id_[1:] != id_[:-1]), 0, True) if len(key) else np.zeros(0, bool)
        key, id_, n = key[new], id_[new], n[new]
        same = key[1:] == key[:-1]
        two = np.append(same, False) | np.insert(same, 0, False) if len(key) else np.zeros(0, bool)
        key, id_, n = key[two], id_[two], n[two]
        yield from _rows(["key", "id", "n"], key, id_, n) if ratio is None else _paired(key, id_, n, ratio)

    return run


def meeting(lists: DataFrame, each: int, ratio: float | None = None) -> DataFrame:
    """Written (key, id, n): the distinct places of ``lists`` (keys, id, n; about ``each`` keys a row) whose key two ids have.

    With ``ratio`` only those of large buckets, and for each pair of a small one, if its sizes are no further apart, a
    row with the second id and its n as ``other`` and ``other_n``, too.
    """
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Several parts a task, so that tasks are even; a part is sorted in memory.
    parts = max(8 * n, lists.count() * each // PACKED)
    packed = lists.select("keys", "id", F.col("n").cast("long")).mapInArrow(_dealt(parts), "part int, key binary, id binary, n binary")
    schema = "key long, id long, n long" + ("" if ratio is None else ", other long, other_n long")
    return written(packed.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_met(ratio), schema), "link-members", hashes=True)


def _compare(slack: float, ratio: float, forest: bool, exact: tuple[Callable, Callable] | None = None):
    """Over rows (task, side, id, comp, n, sketch, wide, payload) sorted by task: near pairs of a task's part and block that are apart.

    Where both have a wide sketch it is asked, too: short ones tell little about long sets. With ``exact``, a function
    of a payload and a verdict on two of its results, only a forest of pairs that link is left.
    """

    def linked(i: np.ndarray, j: np.ndarray, x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[int]:
        """Indices of the pairs (i, j) of payloads x and y, in the components p and q, that link what was apart in this task."""
        prepare, same = exact
        parent: dict[int, int] = {}
        made: dict[int, object] = {}
        size, left, taken = 0, (None, None), []

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = c = parent.get(up, up)
            return c

        for at, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            u, v = root(int(p[a])), root(int(q[b]))
            if u == v:
                continue
            if left[0] != a:
                left = a, prepare(x[a])
            if b not in made:
                made[b] = prepare(y[b])
                size += len(made[b])
            if same(left[1], made[b]):
                parent[u] = v
                taken.append(at)
            if size > PREPARED:
                made, size = {}, 0
        return taken

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []

        def pairs() -> pa.RecordBatch | None:
            if not held:
                return None
            rows = np.concatenate([r for r, _, _ in held], axis=1)
            wide, payload = (np.array([w for part in held for w in part[k]] + [None], object)[:-1] for k in (1, 2))
            inside = rows[1] == 1
            p, q = rows[:, ~inside], rows[:, inside]
            if not p.size or not q.size:
                return None
            near = _near(p[5:].T, q[5:].T, p[4], q[4], slack, ratio) & (p[3][:, None] != q[3][None, :])
            i, j = np.nonzero(near)
            x, y = wide[~inside], wide[inside]
            most = slack * (p[4][i] + q[4][j]) + 1e-6
            kept = [u is None or v is None or least_difference(u, v) <= m for u, v, m in zip(x[i], y[j], most, strict=True)]
            i, j = i[kept], j[kept]
            if exact:
                taken = linked(i, j, payload[~inside], payload[inside], p[3], q[3])
                i, j = i[taken], j[taken]
            if not len(i):
                return None
            if forest:
                _, one = np.unique(np.stack([p[3][i], q[3][j]]), axis=1, return_index=True)
                i, j = i[one], j[one]
                taken = _forest(p[3][i], q[3][j])
                i, j = i[taken], j[taken]
            a, b = p[2][i], q[2][j]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-2]])
            wide, payload = (c.to_pylist() for c in batch.columns[-2:])
            cuts = np.flatnonzero(np.diff(rows[0])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, rows.shape[1]], strict=True):
                if lo == hi:
                    continue
                if rows[0, lo] != task:
                    if (out := pairs()) is not None:
                        yield out
                    task, held = rows[0, lo], []
                held.append((rows[:, lo:hi].copy(), wide[lo:hi], payload[lo:hi]))
        if (out := pairs()) is not None:
            yield out
        held = []
        tidy()

    return run


def link_components(members: DataFrame, sketches: DataFrame, verify: Callable[[DataFrame], DataFrame], threshold: float, sized_sets: bool = False, enough: str | None = None, wide: DataFrame | None = None, met: bool = False, ready: Callable[[DataFrame], None] | None = None, exact: tuple[Callable[[DataFrame], DataFrame], Callable, Callable] | None = None) -> DataFrame:
    """(id, comp) of the ids that link with another one.

    ``members``: (key, id, n), rows may repeat. ``sketches``: (id, n, BITS). n is at least the size of the id's set, and
    the size itself if ``sized_sets``, so that sizes rule pairs out, too. ``verify``: (a, b) -> written (a, b) of those
    that link. ``enough``: a condition that links imply over a_n, b_n and ``common``, a bound on the keys both have. ``wide``:
    (id, wide), ``wide_bits`` of the sets that are long for their sketches. ``met``: ``members`` are what ``meeting``
    gives with the ratio of sizes that links imply, and ``sketches`` has one row of each id of theirs. ``ready``: told the
    distinct (id) that ``verify`` or ``exact`` may ask for, before they do.
    ``exact``: ids -> (id, payload), what to make of a payload, and whether two of these link.
    """
    slack, ratio = (1.0 - threshold) / (1.0 + threshold), threshold if sized_sets else 0.0
    fits = lambda a, b: F.least(a, b) >= F.lit(ratio) * F.greatest(a, b) - 1e-6
    held = members.where("other IS NULL").select("key", "id", "n") if met else members
    if not met:
        shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        held = written(members.join(shared, "key").distinct(), "link-members")
    release(members.sparkSession)
    large_keys = written(held.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > SMALL_BUCKET), "link-large-keys")
    large_keys = sized(large_keys, FEW_KEYS)
    if met:
        within = members.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"), F.col("n").alias("a_n"), F.col("other_n").alias("b_n"))
    else:
        few = held.join(large_keys.select("key"), "key", "left_anti")
        x, y = few.alias("x"), few.alias("y")
        within = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & fits("x.n", "y.n"))
        within = within.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("a_n"), F.col("y.n").alias("b_n"))
    large = written(held.join(large_keys, "key"), "link-large")
    many = written(large.groupBy("id").agg(F.count("*").alias("large"), F.sum("size").alias("weight")), "link-weights")
    if not met:
        sketches = sketches.join(held.select("id").distinct(), "id").dropDuplicates(["id"])
    sketch = sketches.join(many.select("id", "large"), "id", "left")
    sketch = written(sketch.select("id", F.col("n").alias("of"), F.coalesce("large", F.lit(0)).alias("large"), *BITS), "link-sketches", hashes=True)

    def plausible(pairs: DataFrame, counted: bool) -> DataFrame:
        """Distinct (a, b) of ``pairs`` (a, b, a_n, b_n) that neither sketches nor, if they are ``counted``, shared keys rule out."""
        out = pairs.groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"), F.count("*").alias("common"))
        for end in ("a", "b"):
            out = out.join(sketch.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("of", "large", *BITS)]), end)
        differ = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in BITS), F.lit(0))
        out = out.where(differ <= F.lit(slack) * (F.col("a_of") + F.col("b_of")) + 1e-6)
        if counted and enough is not None:
            out = out.withColumn("common", F.col("common") + F.least("a_large", "b_large")).where(enough)
        return out.select("a", "b")

    none = members.sparkSession.createDataFrame([], "a long, b long")

    def settled(pairs: DataFrame, links: DataFrame, comp: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Links and components with ``pairs`` decided: one pair of each b first, then those that are still apart."""
        first = written(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "link-first")
        if first.isEmpty():
            return links, comp if comp is not None else components(links)
        links = written(links.unionByName(verify(first)), "link-found")
        comp = components(links)
        left = pairs.join(first, ["a", "b"], "left_anti")
        for end in ("a", "b"):
            left = left.join(comp.select(F.col("id").alias(end), F.col("comp").alias(f"{end}_comp")), end, "left")
        left = written(left.where("NOT (a_comp <=> b_comp) OR a_comp IS NULL").select("a", "b"), "link-apart")
        if not left.isEmpty():
            links = written(links.unionByName(verify(left)), "link-found")
            comp = components(links)
        return links, comp

    # The member that shares most places in large buckets: of copies with various edits most likely their source.
    central = large.join(many, "id").groupBy("key").agg(F.max(F.struct("weight", "id", "n")).alias("p"))
    central = written(central.select("key", F.col("p.id").alias("first"), F.col("p.n").alias("first_n")), "link-central")
    star = large.join(sized(central, FEW_KEYS), "key").where(F.col("id") != F.col("first")).where(fits("first_n", "n"))
    swap = F.col("first") > F.col("id")
    star = star.select(*[F.when(swap, F.col(p)).otherwise(F.col(q)).alias(r) for p, q, r in (("id", "first", "a"), ("first", "id", "b"), ("n", "first_n", "a_n"), ("first_n", "n", "b_n"))])
    tested = written(plausible(within, True).union(plausible(star, False)).distinct(), "link-tested")
    if ready is not None:
        ready(tested.select(F.col("a").alias("id")).union(tested.select("b")).union(many.select("id")).distinct())
    links, comp = settled(tested, none, None)

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Tasks that decide links themselves need no forest of plausible pairs first.
    for forest in (False,) if exact else (True, False):
        labelled = large.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", F.xxhash64("id")))
        labelled = written(labelled.join(sketch.drop("large"), "id"), "link-labelled")
        counted = labelled.groupBy("key", "comp").agg(F.count("*").alias("n"))
        state = counted.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("size")).where("size > m.n")
        state = state.select("key", F.col("m.comp").alias("main"), F.ceil((F.col("size") - F.col("m.n")) / PART).cast("int").alias("parts"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
        state = written(state, "link-open")
        if state.isEmpty():
            return comp
        open_ = labelled.drop("size").join(sized(state, FEW_KEYS), "key")
        open_ = open_.withColumn("wide", F.lit(None).cast("binary")) if wide is None else open_.join(wide.select("id", "wide"), "id", "left")
        decide = exact if not forest else None
        open_ = open_.withColumn("payload", F.lit(None).cast("string")) if decide is None else open_.join(decide[0](open_.select("id").distinct()), "id")
        deal = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(k)).cast("int")
        part, block = deal(1, "parts"), deal(2, "blocks")
        outside = open_.where("comp <> main").withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        every = open_.withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = [df.select(F.xxhash64("key", "part", "block").alias("task"), F.lit(side).cast("long").alias("side"), "id", "comp", F.col("of").cast("long").alias("of"), *BITS, "wide", "payload") for df, side in ((outside, 0), (every, 1))]
        dealt = rows[0].union(rows[1]).repartition(n, "task").sortWithinPartitions("task")
        if decide is not None:
            links = written(links.unionByName(dealt.mapInArrow(_compare(slack, ratio, False, decide[1:]), "a long, b long")), "link-found")
            return components(links)
        found = dealt.mapInArrow(_compare(slack, ratio, forest), "a long, b long").distinct()
        found = written(found.join(tested, ["a", "b"], "left_anti"), "link-near")
        if not found.isEmpty():
            tested = written(tested.union(found), "link-tested")
            links, comp = settled(found, links, comp)
    return comp
