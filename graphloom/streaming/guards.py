"""Stateful guards on streams: token buckets and circuit breakers. One small state a key; a state equal to that of a new key expires with the watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _fold(events: DataFrame, key: str, ts: str, order: str, delay: str, state_schema: str, start: tuple, step: Callable, keep_seconds: float, used: list[str]) -> DataFrame:
    """(key, order, allowed): ``step(state, seconds, row)`` gives the next state and the verdict, event by event.

    Events of a micro-batch are taken in order of time and ``order``; what a batch holds is bounded by the source's limits (``maxFilesPerTrigger``).
    """
    kept = events.withWatermark(ts, delay).select(key, order, ts, *used)

    def run(name: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values([ts, order])
        now, verdicts = (tuple(state.get) if state.exists else start), []
        for row in rows.itertuples(index=False):
            now, allowed = step(now, getattr(row, ts).timestamp(), row)
            verdicts.append(allowed)
        state.update(now)
        until = int((rows[ts].max().timestamp() + keep_seconds) * 1000)
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: name[0], order: rows[order].to_numpy(), "allowed": verdicts})

    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    return kept.groupBy(key).applyInPandasWithState(run, f"{key} {types[key]}, {order} {types[order]}, allowed boolean", state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def token_bucket(events: DataFrame, key: str, ts: str, order: str, rate: float, capacity: float, delay: str = "0 seconds") -> DataFrame:
    """Each event takes a token of its key's bucket, which fills by ``rate`` a second up to ``capacity`` and begins full; without a token it is refused."""

    def step(now: tuple, at: float, row) -> tuple[tuple, bool]:
        tokens, last = now
        # A late event adds nothing and doesn't turn the clock back.
        tokens = min(capacity, tokens + max(0.0, at - last) * rate) if last else tokens
        return ((tokens - 1, max(at, last)), True) if tokens >= 1 else ((tokens, max(at, last)), False)

    return _fold(events, key, ts, order, delay, "tokens double, last double", (float(capacity), 0.0), step, capacity / rate, [])


def circuit_breaker(events: DataFrame, key: str, ts: str, order: str, failed: str, failures: int, cooldown: float, delay: str = "0 seconds") -> DataFrame:
    """After so many failures in a row a key's events are refused for ``cooldown`` seconds; then the count begins anew. Refused events don't count."""

    def step(now: tuple, at: float, row) -> tuple[tuple, bool]:
        count, until = now
        if at < until:
            return now, False
        count = count + 1 if getattr(row, failed) else 0
        return ((0, at + cooldown), True) if count >= failures else ((count, 0.0), True)

    # A count of failures has no end by itself, so it is kept for as long as ten cooldowns.
    return _fold(events, key, ts, order, delay, "count int, until double", (0, 0.0), step, 10 * cooldown, [failed])
