"""Streams with state for each key: a limiter that decides as events come, and a subscriber to a job's progress."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..io import importable
from .operators import TERMINAL, hour_key

_PROVIDER, _PARTITIONS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"


@contextmanager
def keyed_state(spark: SparkSession, parts: int | None = None) -> Iterator[None]:
    """The state store that these operators need, for streams that start and end within; what the session had before comes back.

    parts: partitions of the state, each a store that is opened and committed in every
    batch, and which adaptive execution doesn't merge: by default one for each core. A
    stream that goes on from a checkpoint keeps the number that it began with.
    """
    importable(spark)
    new = {_PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", _PARTITIONS: str(parts or spark.sparkContext.defaultParallelism)}
    before = {name: spark.conf.get(name) for name in new}
    for name, value in new.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class _Limiter(StatefulProcessor):
    """The number of each event in its user's hour; an hour is forgotten a while after its first event, however many followed. A share holds the hours of many users: one read and one write of the state, and one timer, for a share and batch."""

    def __init__(self, user: str, kind: str, tie: str, ttl_ms: int):
        self.user, self.kind, self.tie, self.ttl_ms = user, kind, tie, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getValueState("hours", f"users array<{self.kind}>, hours array<string>, counts array<long>, ends array<long>")

    def _put(self, have: dict[tuple, tuple[int, int]], timer: int | None) -> None:
        """Keeps users' hours with their counts and ends; timer: the one that is set."""
        first = min((end for _, end in have.values()), default=None)
        if have:
            users, hours = zip(*have, strict=True)
            counts, ends = zip(*have.values(), strict=True)
            self.hours.update((list(users), list(hours), list(counts), list(ends)))
        else:
            self.hours.clear()
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)

    def _have(self) -> dict[tuple, tuple[int, int]]:
        kept = self.hours.get()
        return {(u, h): (n, end) for u, h, n, end in zip(*kept, strict=True)} if kept else {}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at_ms", self.tie], kind="stable")
        have = self._have()
        timer = min((end for _, end in have.values()), default=None)
        # a share is of no null user or of that one alone, so that a column of numbers stays one
        users = [None] * len(frame) if key[0] < 0 else frame[self.user].tolist()
        numbers = []
        for user, hour, ms in zip(users, frame["hour"], frame["at_ms"].tolist(), strict=True):
            n, end = have.get((user, hour), (0, ms + self.ttl_ms))
            have[user, hour] = n + 1, end
            numbers.append(n + 1)
        frame["n"] = numbers
        self._put(have, timer)
        yield frame[[c for c in frame.columns if c not in ("at_ms", "share")]]

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Forgets all hours that are over by the watermark, so that one timer a share fires in a batch, not one for each hour."""
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        self._put({k: (n, end) for k, (n, end) in self._have().items() if end > now}, None)
        return iter(())

    def close(self) -> None:
        pass


def limited(stream: DataFrame, user: str, at: str, tie: str, limit: int, ttl_s: int = 3660, late: str = "1 day", shares: int = 256) -> DataFrame:
    """STM-04 as a stream that decides: (user, at, tie, hour, n, allowed) for each event in the batch that it comes in.

    n counts before it is compared, so the call beyond `limit` is the first one
    refused. Calls are counted by user and the hour of `at`; a count is dropped when the watermark, `late`
    behind the latest call, is ttl_s seconds past its first one. Calls that come later than the
    watermark are dropped. Within a batch calls count in order of (at, tie). A null user is a user. State is kept for each
    of `shares` by user and hour (and as many for the null user), so that a batch costs by its calls and not by its users, and a user
    of very many calls is several tasks'. A share holds the hours that are not over, and a task a share's calls of a batch: many more users want more shares.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    hour = hour_key(F.col(at))
    share = F.when(F.col(user).isNull(), -1 - F.pmod(F.hash(hour), F.lit(shares))).otherwise(F.pmod(F.xxhash64(user, hour), F.lit(shares)).cast("int"))
    named = stream.select(user, at, tie, hour.alias("hour"), F.unix_millis(at).alias("at_ms"), share.alias("share")).withWatermark(at, late)
    out = named.groupBy("share").transformWithStateInPandas(_Limiter(user, kinds[user], tie, ttl_s * 1000), f"{user} {kinds[user]}, {at} {kinds[at]}, {tie} {kinds[tie]}, hour string, n long", "append", "eventTime")
    return out.withColumn("allowed", F.col("n") <= limit)


class _Subscriber(StatefulProcessor):
    """What one subscriber gets to see. due: when the table, whose row is terminal, is read again, if no message comes before."""

    def __init__(self, kinds: dict[str, str], key: str, poll_ms: int):
        self.kinds, self.key, self.poll_ms = kinds, key, poll_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", f"started boolean, over boolean, base long, due long, status string, at long, tie {self.kinds['tie']}")

    def _out(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        return (Row(**{self.key: key[0], "tie": tie, "status": status, "via": via}) for tie, status, via in rows)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        news = sorted(((r["ms"], r["tie"], r["status"], r["via"]) for r in rows), key=lambda r: (r[0], r[1], r[3] != "table"))  # the table before the message
        started, over, base, due, status, row_at, row_tie = self.seen.get() or (False, False, 0, 0, None, 0, 0)
        if over:  # told all there is to tell
            return iter(())
        before, out = due, []
        for ms, tie, what, via in news:
            if not over and due and due < ms:
                out.append((row_tie, status, "poll"))
                over = True
            if over:
                break
            late = status in TERMINAL and (ms, tie) > (row_at, row_tie)  # nothing follows a terminal state
            if via == "table" and not late:
                status, row_at, row_tie = what, ms, tie
                if not started:
                    started, base = True, ms
                    out.append((tie, what, via))
                    over = what in TERMINAL
                elif what in TERMINAL:
                    due = base + -(-(ms - base) // self.poll_ms) * self.poll_ms
            elif via == "message" and started and not late:
                base = ms
                out.append((tie, what, via))
                over = what in TERMINAL
        self.seen.update((started, over, base, 0 if over else due, status, row_at, row_tie))
        if before and (over or before != due):
            self.handle.deleteTimer(before)
        if due and not over and due != before:
            self.handle.registerTimer(due)
        return self._out(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        started, over, base, due, status, row_at, row_tie = self.seen.get()
        if over or not due:
            return iter(())
        self.seen.update((started, True, base, 0, status, row_at, row_tie))
        return self._out(key, [(row_tie, status, "poll")])

    def close(self) -> None:
        pass


def subscribed(stream: DataFrame, key: str, late: str = "1 hour", poll_s: int = 5) -> DataFrame:
    """STM-02: (key, tie, status, via) that a subscriber to each key gets from rows (key, at, tie, status, via).

    Rows are changes of the table (via 'table') and messages about them ('message'),
    of which some may be lost. The subscriber is told the first state of the table, then
    each message, once, until a terminal state. Every poll_s seconds without a message it
    reads the table again and is told a terminal state that no message told ('poll'). Time is that of
    the rows: such a timer fires when the watermark, `late` behind the latest row, has passed it. As the table changes by rows only,
    a timer is set only once its row is terminal, for the next time that it would be read.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    rows = stream.select(key, "at", F.unix_millis("at").alias("ms"), "tie", "status", "via").withWatermark("at", late).groupBy(key)
    return rows.transformWithState(_Subscriber(kinds, key, poll_s * 1000), f"{key} {kinds[key]}, tie {kinds['tie']}, status string, via string", "append", "eventTime")
