"""Keyed jobs with their own state: comments folded into merged bursts, plays into recent edges.

Rows wait in list state until the watermark has passed them and are then folded in order
of time, so results do not depend on how the feed is cut into batches.  Timers ask for
the next fold; what is final is emitted once and leaves the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

c = F.col
MS = 1000


def _ms(us: int) -> int:
    return us // MS + 1


class Waiting(StatefulProcessor):
    """Keeps rows until the watermark passes them; subclasses fold them in order."""

    columns: tuple[str, ...] = ()
    waiting_schema = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            part = part[part["us"].notna() & part[self.columns[-1]].notna()]  # an end mark has a time only
            if len(part):
                values = [tuple(None if v is None or v != v else v for v in r) for r in part[list(self.columns)].astype(object).itertuples(index=False)]
                self.waiting.appendList([(int(v[0]), *v[1:]) for v in values])
                self.ask(int(part["us"].min()))
        return iter([])

    def ask(self, us: int) -> None:
        self.handle.registerTimer(_ms(us))

    def taken(self, watermark_ms: int) -> tuple[list[tuple], list[tuple]]:
        rows = sorted(self.waiting.get(), key=lambda r: tuple((x is not None, x) for x in r))
        return [r for r in rows if r[0] < watermark_ms * MS], [r for r in rows if r[0] >= watermark_ms * MS]

    def close(self) -> None:
        pass


class MergedBursts(Waiting):
    """Comments with gaps up to ``gap`` are a burst; a burst whose median is under ``apart`` from the first median of the open group joins that group."""

    columns = ("us", "name", "person", "event")
    waiting_schema = "us long, name string, person string, event string"
    result = ["start", "middle", "votes", "people", "label"]

    def __init__(self, gap_us: int, apart_us: int):
        self.gap, self.apart = gap_us, apart_us

    def init(self, handle) -> None:
        super().init(handle)
        self.group = handle.getValueState("group", "start long, middle long, votes long, people long, label string")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        past, future = self.taken(now)
        bursts: list[list[tuple]] = []
        for row in past:
            if bursts and row[0] - bursts[-1][-1][0] <= self.gap:
                bursts[-1].append(row)
            else:
                bursts.append([row])
        # the last burst may still grow
        still_open = bursts.pop() if bursts and bursts[-1][-1][0] + self.gap >= now * MS else []
        group, done = (self.group.get() if self.group.exists() else None), []
        for rows in bursts:
            times = [r[0] for r in rows]
            n = len(times)
            middle = (times[(n - 1) // 2] + times[n // 2]) // 2
            people = len({r[2] for r in rows if r[2]}) or n
            label = next((r[1] for r in rows if r[1] and r[1] != "ID"), None)
            if group is not None and middle - group[1] < self.apart:
                group = (group[0], group[1], group[2] + n, group[3] + people, group[4] or label)
            else:
                done += [group] if group is not None else []
                group = (times[0], middle, n, people, label)
        # no later burst can have a median before its start
        following = still_open[0][0] if still_open else future[0][0] if future and future[0][0] < now * MS else now * MS
        if group is not None and following - group[1] >= self.apart:
            done, group = [*done, group], None
        rest = still_open + future
        self.waiting.put(rest) if rest else self.waiting.clear()
        self.group.update(group) if group is not None else self.group.clear()
        if still_open:
            self.ask(still_open[-1][0] + self.gap + MS)
        if future:
            self.ask(future[0][0])
        if group is not None:
            self.ask(max(group[1] + self.apart, now * MS) + MS)
        if done:
            yield pd.DataFrame([(key[0], *g) for g in done], columns=["key", *self.result])


class RecentEdges(Waiting):
    """Steps between successive plays of a key, the last ``limit`` of them, and how often and when last each item was played."""

    columns = ("us", "event", "item")
    waiting_schema = "us long, event string, item string"

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "item string")
        self.edges = handle.getListState("edges", "us long, a string, b string")
        self.plays = handle.getMapState("plays", "item string", "n long, last long")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past, future = self.taken(timerValues.getCurrentWatermarkInMs())
        self.waiting.put(future) if future else self.waiting.clear()
        if future:
            self.ask(future[0][0])
        if not past:
            return
        last = self.last.get()[0] if self.last.exists() else None
        edges = list(self.edges.get())
        for us, _, item in past:
            if last is not None and last != item:
                edges.append((us, last, item))
            last = item
            known = self.plays.getValue((item,))
            self.plays.updateValue((item,), ((known[0] if known else 0) + 1, us))  # rows come in order of time
        edges = edges[-self.limit :]
        self.last.update((last,))
        self.edges.put(edges) if edges else self.edges.clear()
        plays = sorted((k[0], *v) for k, v in self.plays.iterator())
        yield pd.DataFrame(
            {
                "key": [key[0]], "upto": [past[-1][0]], "edges": [[{"a": a, "b": b} for _, a, b in edges[::-1]]],
                "plays": [[{"item": i, "n": n} for i, n, _ in plays]], "lasts": [[{"item": i, "us": us} for i, _, us in plays]],
            }
        )


def _keyed(stream: DataFrame, by: str, time: str, delay: str, **columns) -> DataFrame:
    """Rows as (key, us, ...) with a watermark on ``time``."""
    marked = stream.withWatermark(time, delay)
    return marked.select(c(by).cast("string").alias("key"), c(time).alias("at"), F.unix_micros(time).alias("us"), *[x.cast("string").alias(n) for n, x in columns.items()])


def merged_bursts(stream: DataFrame, by: str, time: str, person: str, label: str, event: str, gap_seconds: float = 25.0, apart_seconds: float = 45.0, delay: str = "1 minute") -> DataFrame:
    """(key, start, middle, votes, people, label) in microseconds: append mode, a row when its burst group can no longer change."""
    rows = _keyed(stream, by, time, delay, name=c(label), person=c(person), event=c(event))
    job = MergedBursts(int(gap_seconds * 1e6), int(apart_seconds * 1e6))
    return rows.groupBy("key").transformWithStateInPandas(job, "key string, start long, middle long, votes long, people long, label string", "Append", "eventTime")


def recent_edges(stream: DataFrame, by: str, time: str, item: str, event: str, limit: int = 200, delay: str = "1 minute") -> DataFrame:
    """(key, upto, edges, plays, lasts): update mode; newest edges first; plays of equal time in order of ``event``; ``lasts`` in the order of ``plays``."""
    rows = _keyed(stream, by, time, delay, event=F.lpad(c(event).cast("string"), 20, "0"), item=c(item))
    schema = "key string, upto long, edges array<struct<a: string, b: string>>, plays array<struct<item: string, n: bigint>>, lasts array<struct<item: string, us: bigint>>"
    return rows.groupBy("key").transformWithStateInPandas(RecentEdges(limit), schema, "Update", "eventTime")
