"""Embedding near-dedup by a robust-pruned flat graph over overlapping cluster shards.

1. Vectors are normalised in double precision. Equal vectors with one label are one point with a weight.
2. Per label, centroids are drawn from the points by a hash; each point joins the shards of its nearest ``overlap``
   centroids, the nearest of which is its home. Shards beyond ``SHARD_MOST`` points draw centroids of their own.
3. Each shard builds a robust-pruned neighbour graph. The adjacency lists of a point's shards are united.
4. Every point searches the united lists once, among the points of its home shard: greedily from the shard's medoid with
   a beam, then through the lists of all nodes in range. A cosine is computed for visited nodes only. Entries that lead
   out of the shard are followed after that, until a round finds nothing new. Cosines near the threshold are computed
   again in double precision.
5. Recall is audited against brute force: the points of all ids divisible by 100 against all points, and more points
   until they hold ``AUDIT_LINKS`` links. Below ``target`` the shards are made again with twice the overlap; if recall
   stays below ``FLOOR``, or ``AUDIT_MOST`` points hold too few links to tell, all points of a label are compared
   exactly, block by block.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null
label, link with nothing; vectors of different lengths link with nothing; repeated rows and repeated ids each count;
a row with a null id is returned with a null component and kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, written
from .graph import components

#: Points that a shard is aimed at, and holds at most when its graph is built; centroids sent to executors, and the
#: numbers that they hold, at most.
SHARD, SHARD_MOST, CENTROIDS, CENTROID_VALUES = 400, 1500, 16_384, 1 << 22
#: Out-degree, candidates and slack of the pruning rule, width of the search beam, queries of one search task.
DEGREE, CANDIDATES, ALPHA, BEAM, QUERIES = 16, 48, 1.2, 24, 1024
#: Points that are added to an audit first, and at most; links it must hold; least recall of a graph's result; queries
#: of one audit pass.
AUDIT, AUDIT_MOST, AUDIT_LINKS, FLOOR, AUDIT_PASS = 256, 4096, 200, 0.9, 4096
_PAIR = "a long, b long"


def _matrix(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """The rows of a list column as one matrix where all are alike and whole (else an empty one), and one by one."""
    flat, size = column.flatten(), pa.compute.list_value_length(column)
    if len(column) and not column.null_count and not flat.null_count and (low := pa.compute.min_max(size).as_py())["min"] == low["max"]:
        return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), low["min"]), []
    rows = [None if v is None or None in v else np.array(v, float) for v in column.to_pylist()]
    return np.empty((0, 0)), rows


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which rows have a direction at all."""
    top = np.abs(x).max(axis=1, initial=0.0)
    good = np.isfinite(x).all(axis=1) & (top > 0) & np.isfinite(top)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        scaled = x / top[:, None]
        return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None], good


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, pid, unit): unit and pid are null where the vector cannot link."""
    for batch in batches:
        x, rows = _matrix(batch.column(3))
        label = np.array(batch.column(1).is_valid())
        if not rows:
            unit, good = _units(x)
            good &= label
            offsets = np.concatenate([[0], np.cumsum(np.where(good, x.shape[1], 0))]).astype(np.int32)
            units = pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit[good].reshape(-1)), mask=pa.array(~good))
        else:
            got = [None if v is None or not len(v) else _units(v[None, :]) for v in rows]
            good = label & np.array([g is not None and bool(g[1][0]) for g in got], bool)
            units = pa.array([g[0][0] if ok else None for g, ok in zip(got, good, strict=True)], pa.list_(pa.float64()))
        pid = pa.compute.if_else(pa.array(good), batch.column(2), pa.scalar(None, pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pid, units], ["vec_id", "label", "pid", "unit"])
    tidy()


def robust_prune(order: np.ndarray, gram: np.ndarray) -> list[np.ndarray]:
    """Out-neighbours of each point: of its candidates, nearest first, those that no chosen one covers."""
    out = []
    for i in range(len(gram)):
        left, chosen = order[i], []
        while len(left) and len(chosen) < DEGREE:
            p = left[0]
            chosen.append(p)
            # Squared chords: a candidate nearer (by ALPHA) to the chosen one than to i is reached through it.
            left = left[1:]
            left = left[ALPHA * ALPHA * (1 - gram[p, left]) > 1 - gram[i, left]]
        out.append(np.array(chosen, np.int64))
    return out


def build(gram: np.ndarray) -> list[np.ndarray]:
    """The flat graph of a shard, with reverse edges and the medoid's reach ensured by a ring."""
    n = len(gram)
    k = min(CANDIDATES, n - 1)
    near = np.argpartition(-gram - np.eye(n) * -4, k - 1, axis=1)[:, :k] if k and k < n - 1 else np.array([[j for j in range(n) if j != i] for i in range(n)]).reshape(n, n - 1)
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(gram, near, 1), axis=1, kind="stable"), 1)
    forward = robust_prune(near, gram)
    back: list[list[int]] = [[(i + 1) % n] for i in range(n)]
    for i, js in enumerate(forward):
        for j in js.tolist():
            back[j].append(i)
    return [np.unique(np.concatenate([f, np.array(b[: 2 * DEGREE], np.int64)])) for f, b in zip(forward, back, strict=True)]


def range_search(cosine: Callable[[np.ndarray, np.ndarray], np.ndarray], queries: int, lists: np.ndarray, start: int, threshold: float) -> np.ndarray:
    """Boolean (query, node): the nodes at ``threshold`` or nearer that each query finds from the node ``start``.

    ``lists``: the neighbours of each node, filled up with the node itself. ``cosine`` gets queries and nodes, pair by
    pair, and is only asked about nodes that a query visits: first a greedy search that expands the nearest node while
    it is among the ``BEAM`` nearest visited, then range expansion through all nodes in range.
    """
    n = len(lists)
    sims = np.full((queries, n), -2.0, np.float32)
    done = np.zeros((queries, n), bool)

    def visit(q: np.ndarray, node: np.ndarray) -> None:
        to = lists[node]
        q, to = np.repeat(q, to.shape[1]), to.ravel()
        new = np.unique((q * n + to)[sims[q, to] == -2.0])
        q, to = new // n, new % n
        sims[q, to] = cosine(q, to)

    live = np.arange(queries)
    sims[:, start] = cosine(live, np.full(queries, start))
    width = min(BEAM, n)
    while len(live):
        here = sims[live]
        floor = np.partition(here, n - width, axis=1)[:, n - width]
        here[done[live]] = -3.0
        pick = here.argmax(axis=1)
        best = here[np.arange(len(live)), pick]
        go = (best >= floor) & (best > -2.0)
        live, pick = live[go], pick[go]
        done[live, pick] = True
        visit(live, pick)
    while True:  # range expansion
        q, node = np.nonzero((sims >= threshold) & ~done)
        if not len(q):
            return sims >= threshold
        done[q, node] = True
        for at in range(0, len(q), 8192):
            visit(q[at : at + 8192], node[at : at + 8192])


def _padded(graph: list[np.ndarray]) -> np.ndarray:
    out = np.repeat(np.arange(len(graph))[:, None], max((len(g) for g in graph), default=0) or 1, axis=1)
    for i, g in enumerate(graph):
        out[i, : len(g)] = g
    return out


def search(gram: np.ndarray, graph: list[np.ndarray], threshold: float) -> np.ndarray:
    """``range_search`` of all points of one graph, from its medoid, where similarities are at hand."""
    return range_search(lambda q, to: gram[q, to], len(gram), _padded(graph), int(gram.sum(axis=0).argmax()), threshold)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


def _build(threshold: float):
    reach = 2 * threshold * threshold - 1  # what lies within reach of a node that is in range of a query

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows (pid, list, near): a point's neighbours in this shard, and those of them within reach."""
        ids, x = pdf["pid"].to_numpy(), _stack(pdf["unit"]).astype(np.float32)
        gram = x @ x.T
        lists = build(gram) if len(ids) > 1 else [np.empty(0, np.int64)] * len(ids)
        lists = [g[g != i] for i, g in enumerate(lists)]
        return pd.DataFrame({"pid": ids, "list": [ids[g] for g in lists], "near": [ids[g[gram[i, g] >= reach - 1e-5]] for i, g in enumerate(lists)]})

    return run


def _search(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows (a, b, sure): links of this shard's queries; sure is false where doubles must decide, null beyond the shard."""
        ids, x = pdf["pid"].to_numpy(), _stack(pdf["unit"])
        asks = np.flatnonzero(pdf["asks"].to_numpy())
        blur = (x.shape[1] + 4) * 1.2e-7  # the rounding of a cosine of float32 vectors stays below
        order = np.argsort(ids)
        known = ids[order]

        def local(lists: pd.Series) -> tuple[list[np.ndarray], list[np.ndarray]]:
            inside, outside = [], []
            for members in lists:
                members = np.asarray(members, np.int64)
                at = np.minimum(np.searchsorted(known, members), len(known) - 1)
                here = known[at] == members
                inside.append(order[at[here]])
                outside.append(members[~here])
            return inside, outside

        graph, _ = local(pdf["list"])
        _, beyond = local(pdf["near"])
        start = int((x @ x.mean(axis=0)).argmax())
        found = range_search(lambda q, to: np.einsum("ij,ij->i", x[asks[q]], x[to]), len(asks), _padded(graph), start, threshold - blur)
        q, node = np.nonzero(found)
        q = asks[q]
        sim = np.einsum("ij,ij->i", x[q], x[node])
        size = np.array([len(b) for b in beyond])
        far = np.repeat(ids[q], size[node]), np.concatenate([beyond[i] for i in node.tolist()]) if size[node].any() else np.empty(0, np.int64)
        links = q != node
        a = np.concatenate([ids[q[links]], far[0]])
        b = np.concatenate([ids[node[links]], far[1]])
        sure = np.concatenate([sim[links] >= threshold + blur, np.zeros(len(far[0]), bool)])
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "sure": sure}).drop_duplicates()

    return run


def _verified(pairs: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """Written (a, b) of ``pairs`` whose cosine in doubles reaches the threshold and whose labels and lengths are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
            size = np.array(pa.compute.list_value_length(batch.column(2)))
            ends = np.concatenate([[0], np.cumsum(size)])
            total = np.concatenate([[0.0], np.add.reduceat(x * y, ends[:-1])]) if len(size) else np.zeros(1)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(total[1:] >= threshold - 1e-12))
        tidy()

    ends = [points.select(F.col("pid").alias(end), F.col("unit").alias(f"u{end}"), F.col("label").alias(f"l{end}")) for end in "ab"]
    both = pairs.join(ends[0], "a").join(ends[1], "b").where("la = lb AND size(ua) = size(ub)")
    return written(both.select("a", "b", "ua", "ub").mapInArrow(run, _PAIR), "vectors-verified")


def _assign(sent, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_label = sent.value
        for pdf in batches:
            out = []
            for (label, size), some in pdf.groupby(["label", pdf["unit"].map(len)]):
                centroids = by_label.get((label, size))
                if centroids is None:
                    out.append(some.assign(shard=-size, home=True))
                    continue
                sims = _stack(some["unit"]) @ centroids.T
                k = min(overlap, centroids.shape[0])
                top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                out += [some.assign(shard=top[:, j] + size * (CENTROIDS * 4), home=j == 0) for j in range(k)]
            if out:
                yield pd.concat(out)[["pid", "label", "unit", "shard", "home"]]

    return run


def _split(pdf: pd.DataFrame) -> pd.DataFrame:
    """A large shard dealt over centroids of its own, two for each point."""
    if len(pdf) <= SHARD_MOST:
        return pdf
    pdf = pdf.sort_values("pid", ignore_index=True)
    x = _stack(pdf["unit"])
    m = -(-len(pdf) // SHARD)
    chosen = np.random.Generator(np.random.PCG64(len(pdf))).permutation(len(pdf))[:m]
    top = np.empty((len(pdf), 2), np.int64)
    for at in range(0, len(pdf), 8192):
        top[at : at + 8192] = np.argsort(-(x[at : at + 8192] @ x[chosen].T), axis=1, kind="stable")[:, :2]
    parts = [pdf.assign(shard=pdf["shard"] + (top[:, j] + 1) * (1 << 40), home=pdf["home"] & (j == 0)) for j in range(2)]
    return pd.concat(parts)


def _compare(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows (a, b, sim): all links of a block."""
        parts = [pd.DataFrame({"a": [], "b": [], "sim": []}).astype({"a": "int64", "b": "int64", "sim": "float64"})]
        for _, some in pdf.groupby(pdf["unit"].map(len)):
            some = some.drop_duplicates("pid")
            ids, x = some["pid"].to_numpy(), np.stack(some["unit"].to_numpy())
            gram = x @ x.T
            a, b = np.nonzero(np.triu(gram >= threshold - 1e-12, 1))
            parts.append(pd.DataFrame({"a": ids[a], "b": ids[b], "sim": gram[a, b]}))
        return pd.concat(parts)

    return run


def _brute(sent, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (label, size), some in pdf.groupby(["label", pdf["unit"].map(len)]):
                if (q := sent.value.get((label, size))) is None:
                    continue
                ids = some["pid"].to_numpy()
                i, j = np.nonzero(q[1] @ np.stack(some["unit"].to_numpy()).T >= threshold)
                a, b = q[0][i], ids[j]
                yield pd.DataFrame({"a": a[a != b], "b": b[a != b]})

    return run


def _by_label(rows) -> dict:
    out: dict = {}
    for r in rows:
        out.setdefault((r["label"], len(r["unit"])), []).append(r)
    return out


def _straight(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _blocks(shards: DataFrame) -> DataFrame:
    """The points of each shard dealt into pairs of blocks (lo, hi); a shard of ``SHARD_MOST`` points or fewer is one block."""
    counts = written(shards.groupBy("label", "shard").agg(F.count("*").alias("n")), "vectors-counts")
    half = SHARD_MOST // 2
    blocks = F.when(F.col("n") <= SHARD_MOST, F.lit(1)).otherwise(F.ceil(F.col("n") * 1.15 / half)).cast("int")
    own = F.pmod(F.xxhash64("pid", F.lit(5)), F.col("blocks")).cast("int")
    dealt = shards.join(counts, ["label", "shard"]).withColumn("blocks", blocks).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("pid", "unit", "label", "shard", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def exact_links(points: DataFrame, threshold: float) -> DataFrame:
    """Written (a, b), a < b: the links that comparing all points of each label finds."""
    every = points.select("pid", "label", "unit", F.lit(0).alias("shard"))
    found = _blocks(every).groupBy("label", "shard", "lo", "hi").applyInPandas(_compare(threshold), "a long, b long, sim double")
    return written(_straight(found), "vectors-exact-links")


def _links(points: DataFrame, threshold: float, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Written (a, b), a < b: linked points, and the edges of the united lists between points within reach."""
    spark = points.sparkSession
    sizes = written(points.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("unit")).alias("width")), "vectors-sizes")
    total, width = sizes.agg(F.sum("n"), F.max("width")).first()
    most = max(2, min(CENTROIDS, CENTROID_VALUES // (width or 1)))
    each = max(SHARD / overlap, (total or 0) / most)
    # Every point is a centroid with the same chance; labels of less than one shard need none.
    large = sizes.where(F.col("n") > SHARD).select("label")
    chance = F.pmod(F.xxhash64("pid", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) / each)
    drawn = points.where(chance).join(large, "label").select("label", "unit").limit(2 * most).collect()
    centroids = {k: np.array([r["unit"] for r in rows]) for k, rows in _by_label(drawn).items() if len(rows) > 1}
    sent = spark.sparkContext.broadcast(centroids)
    shard = "pid long, label long, unit array<float>, shard long, home boolean"
    shards = written(points.select("pid", "label", "unit").mapInPandas(_assign(sent, overlap), shard), "vectors-shards")
    held = written(shards.groupBy("label", "shard").agg(F.count("*").alias("n")), "vectors-counts")
    if not held.where(F.col("n") > SHARD_MOST).isEmpty():
        crowded = F.col("n") > SHARD_MOST
        sized_ = shards.join(held, ["label", "shard"])
        split = sized_.where(crowded).drop("n").groupBy("label", "shard").applyInPandas(_split, shard)
        shards = written(sized_.where(~crowded).drop("n").unionByName(split), "vectors-shards")
        held = written(shards.groupBy("label", "shard").agg(F.count("*").alias("n")), "vectors-counts")
    # A shard that is crowded still is built from two independent deals into blocks, so that its parts hang together.
    blocks = F.ceil(F.col("n") / SHARD_MOST).cast("int")
    deals = F.when(blocks == 1, F.array(F.lit(0))).otherwise(F.array(F.pmod(F.xxhash64("pid", F.lit(5)), blocks * 2), -1 - F.pmod(F.xxhash64("pid", F.lit(6)), blocks * 2)).cast("array<int>"))
    dealt = shards.join(held, ["label", "shard"]).select("pid", "unit", "label", "shard", F.explode(deals).alias("block"))
    built = dealt.groupBy("label", "shard", "block").applyInPandas(_build(threshold), "pid long, list array<long>, near array<long>")
    unite = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)  # noqa: E731  of at most a list a shard
    lists = written(built.groupBy("pid").agg(unite("list"), unite("near")), "vectors-lists")
    homes = written(shards.where("home").groupBy("label", "shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("asked")), "vectors-homes")
    nodes = shards.join(homes, ["label", "shard"]).join(lists, "pid").withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asked") - 1)))
    nodes = nodes.withColumn("asks", F.col("home") & (F.pmod(F.xxhash64("pid", F.lit(8)), F.col("asked")) == F.col("ask")))
    found = nodes.select("pid", "unit", "list", "near", "asks", "label", "shard", "ask").groupBy("label", "shard", "ask").applyInPandas(_search(threshold), _PAIR + ", sure boolean")
    found = written(found.groupBy("a", "b").agg(F.max("sure").alias("sure")), "vectors-found")
    links = written(found.where("sure").select("a", "b").union(_verified(found.where("NOT sure").select("a", "b"), points, threshold)), "vectors-links")
    graph = written(_straight(lists.select(F.col("pid").alias("a"), F.explode("near").alias("b"))), "vectors-graph")
    # What lay beyond a home shard leads on from there; within it all lists were followed to their ends.
    beyond = written(found.where("NOT sure").select("a", "b").join(links, ["a", "b"]), "vectors-beyond")
    return _expand(points, links, graph, threshold, beyond, found.select("a", "b")), graph


def _expand(points: DataFrame, links: DataFrame, graph: DataFrame, threshold: float, new: DataFrame | None = None, tested: DataFrame | None = None) -> DataFrame:
    """``links`` and what range expansion over the united lists finds from ``new`` (all links), until nothing is new."""
    both = lambda df: df.select("a", "b").union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    new, tested = new if new is not None else links, tested if tested is not None else links
    lists = None
    while not new.isEmpty():
        lists = lists or written(both(graph), "vectors-edges")
        hop = both(new).alias("l").join(lists.alias("g"), F.col("l.b") == F.col("g.a"))
        hop = _straight(hop.select(F.col("l.a").alias("a"), F.col("g.b").alias("b"))).join(tested, ["a", "b"], "left_anti")
        hop = written(hop, "vectors-hop")
        new = _verified(hop, points, threshold)
        links, tested = written(links.union(new), "vectors-all-links"), written(tested.union(hop), "vectors-tested")
    return links


def _recall(points: DataFrame, links: DataFrame, threshold: float, queries: DataFrame) -> tuple[int, int]:
    """Links of ``queries`` that brute force over all points finds, and how many of them ``links`` has."""
    true = got = 0
    queries = written(queries.select("pid", "label", "unit", F.pmod(F.xxhash64("pid", F.lit(4)), F.lit(1 << 30)).alias("turn")), "vectors-asked")
    passes = -(-queries.count() // AUDIT_PASS)
    for k in range(passes):
        part = queries.where((F.col("turn") * passes >= k * (1 << 30)) & (F.col("turn") * passes < (k + 1) * (1 << 30)))
        asked = {q: (np.array([r["pid"] for r in v]), np.array([r["unit"] for r in v])) for q, v in _by_label(part.collect()).items()}
        sent = points.sparkSession.sparkContext.broadcast(asked)
        found = written(points.select("pid", "label", "unit").mapInPandas(_brute(sent, threshold), _PAIR), "vectors-audit")
        counts = _straight(found).join(links.withColumn("hit", F.lit(1)), ["a", "b"], "left").agg(F.count("*"), F.count("hit")).first()
        true, got = true + counts[0], got + counts[1]
    return true, got


def audit_recall(points: DataFrame, links: DataFrame, threshold: float, n: int = AUDIT) -> tuple[float, int]:
    """Share of the links of an audit's points that brute force over all points finds and ``links`` has; their number.

    The points: all that are marked ``asked`` (of an id divisible by 100), if there is such a column, and n others.
    """
    some = points.orderBy(F.xxhash64("pid", F.lit(3))).limit(n)
    if "asked" in points.columns:
        some = some.where("NOT asked").unionByName(points.where("asked"))
    true, got = _recall(points, links, threshold, some)
    return got / true if true else 1.0, true


def _audited(points: DataFrame, links: DataFrame, threshold: float) -> float | None:
    """Recall on points that hold ``AUDIT_LINKS`` links, or on all; None if ``AUDIT_MOST`` points hold fewer."""
    total, n = points.count(), AUDIT
    while True:
        recall, true = audit_recall(points, links, threshold, n)
        if true >= AUDIT_LINKS or n >= total:
            return recall
        if n >= AUDIT_MOST:
            return None
        n *= 4


def all_links(points: DataFrame, threshold: float, overlap: int, target: float, report: dict | None = None) -> DataFrame:
    """Written (a, b), a < b: the audited links of the graph, or those of the exact comparison; ``report`` gets the recall."""
    report = {} if report is None else report
    while True:
        links, _ = _links(points, threshold, overlap)
        recall = _audited(points, links, threshold)
        report.update(overlap=overlap, recall=recall)
        if recall is not None and (recall >= target or overlap >= 24 and recall >= FLOOR):
            return links
        if recall is None or overlap >= 24:
            report.update(recall=1.0, exact=True)
            return exact_links(points, threshold)
        overlap *= 2


def near_duplicates(
    rows: DataFrame, threshold: float = 0.98, overlap: int = 3, target: float = 0.98, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label", report: dict | None = None
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. ``report``, if given, gets the audit's recall."""
    own = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vec).cast("array<double>").alias("vec"))
    own = own.select("vec_id", "label", F.xxhash64("label", "vec").alias("pid"), "vec")
    own = written(own.mapInArrow(_normalised, "vec_id long, label long, pid long, unit array<double>"), "vectors-rows")
    held = own.where("pid IS NOT NULL")
    asked = F.coalesce(F.max(F.col("vec_id") % 100 == 0), F.lit(False)).alias("asked")
    weight = written(held.groupBy("pid").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), asked), "vectors-weights")
    points = written(held.select("pid", "label", "unit").dropDuplicates(["pid"]).join(weight.select("pid", "asked"), "pid"), "vectors-points")
    weight = weight.drop("asked")
    links = all_links(points, threshold, overlap, target, report)
    ends = links.select(F.col("a").alias("pid"), F.col("b").alias("o")).union(links.select("b", "a"))
    ends = ends.join(weight.select(F.col("pid").alias("o"), "weight"), "o").groupBy("pid").agg(F.sum("weight").alias("linked"))
    comp = components(links).select(F.col("id").alias("pid"), "comp")
    state = weight.join(written(ends, "vectors-degrees"), "pid", "left").join(comp, "pid", "left").withColumn("comp", F.coalesce("comp", F.xxhash64("pid")))
    state = written(state, "vectors-state")
    least = written(state.groupBy("comp").agg(F.min("least").alias("component_id")), "vectors-components")
    state = state.join(least, "comp").select("pid", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    # Rows that cannot link get keys of their own, so that they do not meet in one task of the join.
    keyed = own.select("vec_id", F.coalesce("pid", F.xxhash64("vec_id", F.lit(7))).alias("pid"), F.col("pid").isNotNull().alias("usable"))
    out = keyed.join(written(state, "vectors-result"), "pid", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.when(F.col("usable"), F.coalesce("component_id", "vec_id")).otherwise(F.col("vec_id")))
    n_links = F.when(F.col("usable"), F.col("n_links")).otherwise(F.lit(0)).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
