"""Streams with timers: a query runs over files that come one after the other."""

import time

import pytest

from traceloom.streaming.batching import micro_batches
from traceloom.streaming.guarded import guarded_stop_stream


class Running:
    """A stream of a folder into a memory table, with a trigger that repeats."""

    def __init__(self, spark, tmp_path, schema, build, name):
        self.spark, self.folder, self.name, self.n, self.schema = spark, f"{tmp_path}/in", name, 0, schema
        self.put([])
        stream = build(spark.readStream.schema(schema).parquet(self.folder))
        self.query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/ckpt").trigger(processingTime="200 milliseconds").start()

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.folder)

    def until(self, enough, seconds=60):
        end = time.time() + seconds
        while time.time() < end:
            if self.query.exception():
                raise self.query.exception()
            rows = self.spark.table(self.name).collect()
            if enough(rows):
                return rows
            time.sleep(0.2)
        raise AssertionError(rows)


@pytest.fixture
def running(spark, tmp_path):
    started = []

    def start(schema, build, name):
        started.append(Running(spark, tmp_path, schema, build, name))
        return started[-1]

    yield start
    for r in started:
        r.query.stop()


def test_a_short_batch_is_let_go_only_by_its_timer(running):
    r = running("id long, body string", lambda s: micro_batches(s, size=4, wait_ms=6000, turn="id"), "chunks")
    r.put([(i, f"b{i}") for i in range(9)])
    first = r.until(lambda rows: len(rows) >= 8)
    began = time.time()
    assert len(first) == 8 and {x.flushed_by for x in first} == {"size"}  # the ninth waits
    rows = r.until(lambda rows: len(rows) == 9)
    assert time.time() - began > 2
    by = {x.record.id: (x.chunk, x.place, x.flushed_by) for x in rows}
    assert [by[i] for i in range(9)] == [(0, i, "size") for i in range(4)] + [(1, i, "size") for i in range(4)] + [(2, 0, "timer")]
    assert {x.record.body for x in rows} == {f"b{i}" for i in range(9)}
    r.put([(100, None)])  # a timer that went off starts again
    (last,) = [x for x in r.until(lambda rows: len(rows) == 10) if x.record.id == 100]
    assert (last.chunk, last.flushed_by, last.record.body) == (3, "timer", None)


def test_lanes_are_queues_of_their_own(running):
    r = running("id long, worker long", lambda s: micro_batches(s, size=3, wait_ms=3000, turn="id", lane="worker"), "lanes")
    r.put([(i, i % 2) for i in range(8)])
    rows = r.until(lambda rows: len(rows) == 8)
    kinds = {(x.lane, x.chunk): x.flushed_by for x in rows}
    assert kinds == {(0, 0): "size", (1, 0): "size", (0, 1): "timer", (1, 1): "timer"}
    assert [x.record.id for x in sorted(rows, key=lambda x: (x.lane, x.chunk, x.place))] == [0, 2, 4, 6, 1, 3, 5, 7]


def test_every_trace_ends_in_one_row(running):
    tokens = "trace_id long, pos long, conf double"
    r = running(tokens, lambda s: guarded_stop_stream(s, window=3, bar=2.0, longest=8, most_early=4, patience_ms=4000, keep_ms=60_000), "ends")
    rows = [(1, p, 5.0 if p < 4 else 1.0) for p in range(1, 8)]  # stops
    rows += [(2, p, 5.0) for p in range(1, 6)]  # ends
    rows += [(3, p, 5.0) for p in range(1, 11)]  # too long
    rows += [(4, p, 5.0) for p in (1, 2, 4, 5)]  # position 3 never comes
    rows += [(5, p, 5.0) for p in (1, 3, 4, 5, 6, 7)]  # more wait than may
    r.put(rows)
    ends = {x.trace_id: x for x in r.until(lambda rows: len({x.trace_id for x in rows if x.status != "late"}) == 5) if x.status != "late"}
    assert {k: x.status for k, x in ends.items()} == {1: "stopped", 2: "ended", 3: "over_length", 4: "gap", 5: "gap"}
    assert (ends[1].pos, ends[1].mean, ends[1].confs) == (6, 1.0, [1.0, 1.0, 1.0])
    assert (ends[2].pos, ends[2].num_tokens, ends[2].confs) == (5, 5, [5.0] * 3)
    assert (ends[3].num_tokens, ends[3].confs, ends[3].mean) == (10, [], None)
    assert (ends[4].pos, ends[4].held, ends[4].num_tokens, ends[4].confs) == (2, 2, 5, [])
    assert (ends[5].pos, ends[5].held) == (1, 5)
    r.put([(4, 3, 5.0), (2, 6, 5.0), (2, 7, 5.0)])
    late = {x.trace_id: x.held for x in r.until(lambda rows: {2, 4} <= {x.trace_id for x in rows if x.status == "late"}) if x.status == "late"}
    assert late[2] == 2 and late[4] == 1
