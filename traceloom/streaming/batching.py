"""Micro-batching of a stream: records of a lane wait until there are enough of them, or until the first has waited long enough."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What waits (one JSON text per record), since when, and how many chunks were let go before.
STATE = "waiting array<string>, since long, chunks long"
OUTPUT = "lane long, chunk long, place int, flushed_by string, record string"


def _collect(size: int, wait_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, since, chunks = ([], None, 0) if not state.exists else (list(state.get[0]), state.get[1], state.get[2])
        out: list[tuple] = []

        def let_go(n: int, why: str) -> None:
            nonlocal waiting, chunks
            out.extend((key[0], chunks, place, why, record) for place, record in enumerate(waiting[:n]))
            waiting, chunks = waiting[n:], chunks + 1

        if state.hasTimedOut:
            if waiting:
                let_go(len(waiting), "timer")
        else:
            now = state.getCurrentProcessingTimeMs()
            for pdf in batches:
                for record in pdf.sort_values("turn", kind="stable")["record"]:
                    since = since if waiting else now
                    waiting.append(record)
                    if len(waiting) == size:
                        let_go(size, "size")
                        since = now
                if out:
                    yield pd.DataFrame(out, columns=["lane", "chunk", "place", "flushed_by", "record"])
                    out = []
        state.update((waiting, since if waiting else None, chunks))
        if waiting:
            state.setTimeoutDuration(max(1, wait_ms - (state.getCurrentProcessingTimeMs() - since)))
        yield pd.DataFrame(out, columns=["lane", "chunk", "place", "flushed_by", "record"])

    return run


def micro_batches(stream: DataFrame, size: int, wait_ms: int, turn: str, lanes: int = 1, lane: str | None = None) -> DataFrame:
    """The records of ``stream`` in chunks: lane, chunk, place, flushed_by and the record's own columns under ``record``.

    A chunk is let go when it holds ``size`` records ("size") or when its first record has waited ``wait_ms``
    milliseconds ("timer"); records of one trigger are taken in order of ``turn``. Lanes are independent queues: by the
    column ``lane``, or by the hash of the record over ``lanes``. State is bounded by ``size - 1`` records a lane, and
    every record is let go exactly once, whatever is restarted. Timers need a trigger that repeats: with
    ``availableNow`` only full chunks are let go and the rest stays in the checkpoint.
    """
    record = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    by = F.col(lane).cast("long") if lane else F.pmod(F.xxhash64(record), F.lit(lanes))
    rows = stream.select(by.alias("lane"), F.col(turn).cast("long").alias("turn"), record.alias("record"))
    got = rows.groupBy("lane").applyInPandasWithState(_collect(size, wait_ms), OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    return got.withColumn("record", F.from_json("record", stream.schema))
