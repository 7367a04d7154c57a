"""Keyed state with ends: batches that close by size or time, and registries whose members expire. State is bounded by what is open, and lies in the query's checkpoint, so it survives a crash."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def batched(records: DataFrame, columns: list[str], ts: str, size: int, seconds: float, lanes: int = 16, delay: str = "0 seconds") -> DataFrame:
    """lane, batch, place, id, body and closed_by: records in batches of ``size``, or of fewer once ``seconds`` have gone by since the oldest.

    A record's id is a digest of ``columns``, and it goes to one of ``lanes`` by its id, so equal records meet: one that is waiting already is not taken twice. Batches of a lane are
    numbered without gaps. What waits is a lane's state, ``size`` records at most; its time is event time, which ends with the watermark. After a crash the waiting records come back from the checkpoint.
    """
    body = F.to_json(F.struct(*columns))
    rows = records.withWatermark(ts, delay).select(F.col(ts).alias("ts"), F.sha2(body, 256).alias("id"), body.alias("body"))
    placed = rows.withColumn("lane", F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int"))
    out = "lane int, batch long, place int, id string, body string, closed_by string"

    def run(name: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, ids, bodies, oldest = tuple(state.get) if state.exists else (0, [], [], 0.0)
        ids, bodies, closed = list(ids), list(bodies), []

        def close(why: str) -> None:
            nonlocal batch, ids, bodies
            closed.append(pd.DataFrame({"lane": name[0], "batch": batch, "place": range(len(ids)), "id": ids, "body": bodies, "closed_by": why}))
            batch, ids, bodies = batch + 1, [], []

        if state.hasTimedOut:
            if ids:
                close("time")
        else:
            waiting = set(ids)
            for frame in frames:
                for row in frame.sort_values(["ts", "id"]).itertuples(index=False):
                    at = row.ts.timestamp()
                    if ids and at >= oldest + seconds:
                        close("time")
                        waiting = set()
                    if row.id in waiting:
                        continue
                    if not ids:
                        oldest = at
                    ids.append(row.id)
                    bodies.append(row.body)
                    waiting.add(row.id)
                    if len(ids) >= size:
                        close("size")
                        waiting = set()
        # The number of the next batch stays after all have closed.
        state.update((batch, ids, bodies, oldest))
        if ids:
            state.setTimeoutTimestamp(max(int((oldest + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield from closed

    return placed.groupBy("lane").applyInPandasWithState(run, out, "batch long, ids array<string>, bodies array<string>, oldest double", "append", GroupStateTimeout.EventTimeTimeout)


def heartbeats(beats: DataFrame, member: str, ts: str, response: str, timeout: float, share: float = 0.3, slow: float = 1000.0, degraded: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """member, at, average and status after each micro-batch, and ``OFFLINE`` once a member has not been heard of for ``timeout`` seconds.

    ``average`` is the response time, the first one whole and later ones by ``share``. A beat whose column ``degraded`` is true makes its member DEGRADED, until an answer faster than ``slow``. A member that went offline leaves no state: if it is heard of again, it begins anew.
    """
    mark = F.col(degraded) if degraded else F.lit(False)
    rows = beats.withWatermark(ts, delay).select(F.col(member).alias("member"), F.col(ts).alias("ts"), F.col(response).cast("double").alias("ms"), F.coalesce(mark, F.lit(False)).alias("bad"))
    kind = rows.schema["member"].dataType.simpleString()

    def run(name: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        average, last, status = tuple(state.get) if state.exists else (0.0, 0.0, "ACTIVE")
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"member": [name[0]], "at": [pd.Timestamp(last, unit="s")], "average": [average], "status": ["OFFLINE"]})
            return
        for row in pd.concat(list(frames)).sort_values(["ts", "ms"]).itertuples(index=False):
            average = row.ms if average == 0.0 else share * row.ms + (1 - share) * average
            last = max(last, row.ts.timestamp())
            status = "DEGRADED" if row.bad else "ACTIVE" if row.ms < slow else status
        state.update((average, last, status))
        state.setTimeoutTimestamp(max(int((last + timeout) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"member": [name[0]], "at": [pd.Timestamp(last, unit="s")], "average": [average], "status": [status]})

    return rows.groupBy("member").applyInPandasWithState(run, f"member {kind}, at timestamp, average double, status string", "average double, last double, status string", "append", GroupStateTimeout.EventTimeTimeout)


def registry(beats: DataFrame, member: str, ts: str, timeout: str) -> DataFrame:
    """member, last and status at the time of the last beat of all: ``OFFLINE`` where a member was last heard of longer ago than ``timeout``. For tables."""
    last = beats.groupBy(F.col(member).alias("member")).agg(F.max(ts).alias("last"))
    now = beats.agg(F.max(ts).alias("now"))
    late = F.col("last") < F.col("now") - F.expr(f"INTERVAL {timeout}")
    return last.crossJoin(F.broadcast(now)).select("member", "last", F.when(late, "OFFLINE").otherwise("ACTIVE").alias("status"))
