"""The online stop as a stream: a trace ends at its first full window whose mean confidence lies below its bar."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "trace_id long, pos long, mean double, stopped boolean"
#: next position, running sum, window of values, early arrivals' positions and values, stopped
STATE = "next long, total double, ring array<double>, early_pos array<long>, early_conf array<double>, stopped boolean"


def _step(window: int, bar: float):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            nxt, total, ring, ep, ec, stopped = state.get
            ring, early = list(ring), dict(zip(ep, ec, strict=True))
        else:
            nxt, total, ring, early, stopped = 1, 0.0, [], {}, False
        out = []
        for pdf in batches:
            if not stopped:
                early.update(zip(pdf["pos"].tolist(), pdf["conf"].tolist(), strict=True))
        while not stopped and nxt in early:  # a token waits until all before it have come
            conf = early.pop(nxt)
            ring.append(conf)
            total += conf
            if len(ring) > window:
                total -= ring.pop(0)
            if len(ring) == window and total / window < bar:
                stopped = True
                out.append((key[0], nxt, total / window, True))
                early = {}
            nxt += 1
        state.update((nxt, total, ring, list(early), list(early.values()), stopped))
        yield pd.DataFrame(out, columns=["trace_id", "pos", "mean", "stopped"])

    return run


def stop_stream(tokens: DataFrame, window: int, bar: float) -> DataFrame:
    """``tokens``: a stream of trace_id, pos (from 1), conf. One row per trace, when it stops.

    State is a ring of ``window`` values and what arrived early, per trace.
    """
    return tokens.groupBy("trace_id").applyInPandasWithState(_step(window, bar), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all that is there, exactly once across restarts, into Parquet."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def watch(spark: SparkSession, path: str, schema, handle, checkpoint: str, files_per_batch: int = 100, interval: str | None = None):
    """New files of a folder, in micro-batches, to ``handle(df, batch_id)``; returns the running query."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()
