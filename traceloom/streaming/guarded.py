"""The online stop with a dead-letter output: every trace ends in one row that says how it ended, and state is bounded.

A trace is closed when it stops, when more than ``most_early`` of its tokens wait for a missing position, or when no
token has come for ``patience_ms``. What comes after that is late: it is reported, never processed again, until
``keep_ms`` later the memory of the closed trace goes, too.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: status: ``stopped`` below the bar; ``ended`` whole without a stop; ``over_length`` longer than allowed (its
#: confidences are empty, its length is kept); ``gap`` a position never came; ``late`` tokens after the end, one row a trigger.
OUTPUT = "trace_id long, status string, pos long, mean double, num_tokens long, held long, confs array<double>"
STATE = "next long, total double, ring array<double>, early_pos array<long>, early_conf array<double>, top long, closed boolean"
COLUMNS = ["trace_id", "status", "pos", "mean", "num_tokens", "held", "confs"]


def _step(window: int, bar: float, longest: int, most_early: int, patience_ms: int, keep_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nxt, total, ring, ep, ec, top, closed = state.get if state.exists else (1, 0.0, [], [], [], 0, False)
        ring, early = deque(ring), dict(zip(ep, ec, strict=True))
        row = None

        def close(status: str) -> None:
            nonlocal row, closed
            full = len(ring) == window and status in ("stopped", "ended")
            row = (key[0], status, nxt - 1, total / window if full else None, top, len(early), list(ring) if status in ("stopped", "ended") else [])
            closed = True
            early.clear()
            ring.clear()

        if state.hasTimedOut:
            if closed:
                state.remove()
                yield pd.DataFrame([], columns=COLUMNS)
                return
            close("over_length" if top > longest else "gap" if early else "ended")
        else:
            late = 0
            for pdf in batches:
                for pos, conf in zip(pdf["pos"].tolist(), pdf["conf"].tolist(), strict=True):
                    if closed or pos < nxt or pos in early:
                        late += 1
                        continue
                    top = max(top, pos)
                    if top > longest:  # nothing of it will be used; only its length still grows
                        early.clear()
                        ring.clear()
                        continue
                    early[pos] = conf
                    while nxt in early:
                        value = early.pop(nxt)
                        ring.append(value)
                        total += value
                        if len(ring) > window:
                            total -= ring.popleft()
                        nxt += 1
                        if len(ring) == window and total / window < bar:
                            close("stopped")
                            break
                    if not closed and len(early) > most_early:
                        close("gap")
            if late:
                yield pd.DataFrame([(key[0], "late", None, None, top, late, [])], columns=COLUMNS)
        state.update((nxt, total, list(ring), list(early), list(early.values()), top, closed))
        state.setTimeoutDuration(keep_ms if closed else patience_ms)
        yield pd.DataFrame([row] if row else [], columns=COLUMNS)

    return run


def guarded_stop_stream(tokens: DataFrame, window: int, bar: float, longest: int, most_early: int = 10_000, patience_ms: int = 600_000, keep_ms: int = 3_600_000) -> DataFrame:
    """``tokens``: a stream of trace_id, pos (from 1), conf. One row per trace when it is closed, and rows of late tokens.

    ``pos`` is the last position that was processed, ``held`` how many tokens waited for a missing one (or were late),
    ``confs`` the last window. State per trace: a ring of ``window`` values and ``most_early`` tokens at most; a closed
    trace keeps its numbers alone. A trace that is stopped before a position over ``longest`` was seen stays stopped.
    Repeated positions count as late. Rows other than ``stopped`` and ``ended`` are the
    dead letters: write them to a place of their own by ``status``.
    """
    step = _step(window, bar, longest, most_early, patience_ms, keep_ms)
    return tokens.groupBy("trace_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
