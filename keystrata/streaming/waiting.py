"""Blocking pops as a stateful stream: waiting requests and pushed elements of a key meet in arrival order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key string, request string, value string, reply string"
STATE = "waiters array<struct<request:string,until_ms:bigint>>, elements array<string>"


def _served(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    waiters, elements = ([tuple(w) for w in state.get[0]], list(state.get[1])) if state.exists else ([], [])
    out: list[tuple] = []
    now = state.getCurrentWatermarkMs()
    rows = pd.concat(list(frames)) if not state.hasTimedOut else None
    if rows is not None:
        for r in rows.sort_values("seq").itertuples():
            waiters, late = [w for w in waiters if w[1] >= r.ms], [w for w in waiters if w[1] < r.ms]
            out += [(key[0], w[0], None, "timeout") for w in late]
            if r.kind == "push":
                elements.append(r.value)
            else:
                waiters.append((r.request, int(r.until_ms)))
            while waiters and elements:
                out.append((key[0], waiters.pop(0)[0], elements.pop(0), "popped"))
    late = [w for w in waiters if w[1] < now]
    waiters = [w for w in waiters if w[1] >= now]
    out += [(key[0], w[0], None, "timeout") for w in late]
    if waiters or elements:
        state.update(([{"request": a, "until_ms": b} for a, b in waiters], elements))
        if waiters:
            state.setTimeoutTimestamp(max(now + 1, min(b for _, b in waiters) + 1))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["key", "request", "value", "reply"])


def served(log: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Replies to blocking pops; ``log``: (key, seq, ms, at timestamp, kind push or pop, value, request, until_ms).

    Waiters of a key are first come, first served; one whose time has passed is
    told so when the watermark or the key's next row passes it.
    """
    return log.withWatermark("at", late).groupBy("key").applyInPandasWithState(_served, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
