"""Pacing and message history on a stream, kept by key.

Both need a key's events in the order of their time, which a stream does not give. A
key's state holds the events that the watermark has not passed; a batch, or a timer at the
time of the earliest one, releases those that it has, in order, and no event can come
before them any more. So the rows are those of the batch forms, however events are dealt
to batches and whatever restarts come in between; events later than ``late`` are dropped, as everywhere in
Spark. State goes when it can no longer matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vellum.streaming.limits import PACE_SECONDS


def _released(batches: Iterator[pd.DataFrame], state: GroupState, held: list[tuple], columns: list[str]) -> tuple[list[tuple], list[tuple]]:
    """(events that the watermark has passed, in order; events still held) of what was held and what came: tuples that begin with time and tie."""
    for frame in batches:
        held = held + list(frame[columns].itertuples(index=False, name=None))
    mark = state.getCurrentWatermarkMs() * 1000
    held.sort()
    out = [e for e in held if e[0] < mark]
    return out, held[len(out) :]


def _wake(state: GroupState, us: int) -> None:
    """Have the key looked at once the watermark has passed ``us``."""
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, us // 1000 + 1))


def _by_key(events: DataFrame, key: str, ts: str, tie: str, more: list[str], late: str, each: Callable, out: str, state: str) -> DataFrame:
    us = F.unix_micros(F.col(ts)).alias("_us")
    rows = events.withWatermark(ts, late).select(F.col(key), F.col(ts), us, F.col(tie).alias("_tie"), *more)
    return rows.groupBy(key).applyInPandasWithState(each, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def paced(events: DataFrame, user: str = "user_id", ts: str = "ts", tie: str = "event_id", pace: float = PACE_SECONDS, late: str = "1 minute") -> DataFrame:
    """(user, tie, wait) of a stream of events: what :func:`vellum.streaming.limits.waits` says of a batch, in microseconds since the request before."""
    gap = int(pace * 1_000_000)

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, held = None, []
        if state.exists:
            before, us, ties = state.get
            held = list(zip(us, ties))
        ready, held = _released([] if state.hasTimedOut else batches, state, held, ["_us", "_tie"])
        rows = []
        for us, at in ready:
            rows.append((key[0], at, before is not None and us - before < gap))
            before = us
        if held or (before is not None and state.getCurrentWatermarkMs() * 1000 <= before + gap):
            state.update((before, [int(e[0]) for e in held], [int(e[1]) for e in held]))
            _wake(state, held[0][0] if held else before + gap)
        else:
            state.remove()  # the next request is further away than the pace
        yield pd.DataFrame(rows, columns=[user, tie, "wait"])

    kind = dict(events.dtypes)
    return _by_key(events, user, ts, tie, [], late, each, f"{user} {kind[user]}, {tie} {kind[tie]}, wait boolean", "before long, us array<long>, ties array<long>")


def histories(turns: DataFrame, conv: str = "conv_id", ts: str = "ts", tie: str = "turn", role: str = "role", most: int = 20, late: str = "1 minute") -> DataFrame:
    """(conv, tie, roles) of a stream of messages: the system's prompt and the last ``most`` messages up to each; conversations are kept apart."""

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = [], []
        if state.exists:
            last, us, ties, roles = (list(x) for x in state.get)
            held = list(zip(us, ties, roles))
        ready, held = _released([] if state.hasTimedOut else batches, state, held, ["_us", "_tie", role])
        rows = []
        for _, at, who in ready:
            last = [*last, who][-most:]
            rows.append((key[0], at, ",".join(["system", *(w for w in last if w is not None)])))
        state.update((last, [int(e[0]) for e in held], [int(e[1]) for e in held], [e[2] for e in held]))
        if held:
            _wake(state, held[0][0])
        yield pd.DataFrame(rows, columns=[conv, tie, "roles"])

    kind = dict(turns.dtypes)
    return _by_key(turns, conv, ts, tie, [role], late, each, f"{conv} {kind[conv]}, {tie} {kind[tie]}, roles string", "last array<string>, us array<long>, ties array<long>, roles array<string>")
