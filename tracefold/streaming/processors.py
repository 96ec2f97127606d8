"""Per-correlation state machines behind the stateful streams.

Spark shuffles the rows by a group of correlations, keeps the state and calls these per group.  Every call to the state
is a round trip out of Python, so a group's correlations share one value and one timer: a batch costs a few calls per group,
however many correlations it touches.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def ceil_ms(micros: int) -> int:
    return -(-micros // 1000)


class Correlations(StatefulProcessor):
    """Keeps for each correlation of a group when it is due, in ms of event time or never, and a tuple of plain values.

    A subclass says what to gather of new rows (``note``), and what that (``arrive``) and a passed due time (``expire``) make of
    one correlation: what to keep, as (due, value) or ``None`` for nothing, and the rows to emit.  State: one pickled dictionary a group; it leaves with its last correlation.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "timer bigint, kept binary")

    def note(self, seen, row: Row):
        """What is gathered of a batch's rows of one correlation, which is None before the first."""
        raise NotImplementedError

    def arrive(self, correlation, kept: tuple | None, seen, watermark: int) -> tuple[tuple | None, list[Row]]:
        """What is kept and what is emitted after new rows."""
        raise NotImplementedError

    def expire(self, correlation, kept: tuple, watermark: int) -> tuple[tuple | None, list[Row]]:
        """The same once the watermark has reached a correlation's due time."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        timer, kept = self._load()
        watermark, arrived = timerValues.getCurrentWatermarkInMs(), {}
        for row in rows:
            correlation = row.correlation_id
            arrived[correlation] = self.note(arrived.get(correlation), row)
        for correlation, seen in arrived.items():
            after, out = self.arrive(correlation, kept.get(correlation), seen, watermark)
            self._put(kept, correlation, after)
            yield from out
        self._store(timer, kept)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        timer, kept = self._load()
        watermark = timerValues.getCurrentWatermarkInMs()
        over = [c for c, (due, _) in kept.items() if due is not None and due <= watermark]
        for correlation in over:
            after, out = self.expire(correlation, kept[correlation], watermark)
            self._put(kept, correlation, after)
            yield from out
        # Spark drops the timer that fired
        self._store(None if timer is not None and timer <= watermark else timer, kept)

    def _load(self) -> tuple[int | None, dict]:
        state = self.state.get()
        return (None, {}) if state is None else (state[0], pickle.loads(state[1]))

    @staticmethod
    def _put(kept: dict, correlation, after: tuple | None) -> None:
        if after is None:
            kept.pop(correlation, None)
        else:
            kept[correlation] = after

    def _store(self, timer: int | None, kept: dict) -> None:
        """The state, with a timer at the earliest due time."""
        due = min((d for d, _ in kept.values() if d is not None), default=None)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and due != timer:
            self.handle.registerTimer(due)
        if kept:
            self.state.update((due, pickle.dumps(kept, protocol=4)))
        else:
            self.state.clear()

    def close(self) -> None:
        pass


class EveryProcessor(Correlations):
    """Fires once, with what stood at the first step at which every edge has been seen, in whatever order rows arrive.

    Kept: whether it fired, and the rows still needed.  Once all edges are there, a correlation is due when the
    watermark passes the firing row: then no row of an earlier step can arrive any more.  Until an edge is there, of
    the rows behind the watermark only the last per edge is held, so the state of a busy correlation spans the delay.
    With ``lifetime_ms`` a correlation's state leaves that long after its firing, or after its last row.
    """

    def __init__(self, edges: tuple[str, ...], lifetime_ms: int | None):
        self.edges, self.lifetime_ms = {e: i for i, e in enumerate(edges)}, lifetime_ms

    def note(self, seen, row):
        seen = [] if seen is None else seen
        seen.append((self.edges[row.edge], row.step, row.micros, row.id, row.body))
        return seen

    def arrive(self, correlation, kept, seen, watermark):
        fired, held = (False, []) if kept is None else kept[1]
        if fired:
            return kept, []
        held = held + seen
        fire = self._firing(held)
        if fire is None:
            held = self._last_behind(held, watermark * 1000)
            due = None if self.lifetime_ms is None else ceil_ms(max(r[2] for r in held)) + self.lifetime_ms
        else:
            held = [r for r in held if r[1] <= fire[1]]
            due = ceil_ms(fire[2])
        if due is not None and due <= watermark:
            return self._settle(correlation, held, fire, watermark)
        return (due, (False, held)), []

    def expire(self, correlation, kept, watermark):
        fired, held = kept[1]
        return (None, []) if fired else self._settle(correlation, held, self._firing(held), watermark)

    def _firing(self, held: list[tuple]) -> tuple | None:
        """The row with which the last missing edge first arrives."""
        firsts: dict[int, tuple] = {}
        for r in held:
            if r[0] not in firsts or r[1:3] < firsts[r[0]][1:3]:
                firsts[r[0]] = r
        return max(firsts.values(), key=lambda r: r[1:3]) if len(firsts) == len(self.edges) else None

    def _last_behind(self, held: list[tuple], micros: int) -> list[tuple]:
        last: dict[int, tuple] = {}
        for r in held:
            if r[2] <= micros and (r[0] not in last or (r[1], r[3]) > (last[r[0]][1], last[r[0]][3])):
                last[r[0]] = r
        return [*last.values(), *[r for r in held if r[2] > micros]]

    def _settle(self, correlation, held: list[tuple], fire: tuple | None, watermark: int) -> tuple[tuple | None, list[Row]]:
        """Emit a firing; keep the flag for the rest of the lifetime, if it is not over."""
        if fire is None:
            return None, []
        over = None if self.lifetime_ms is None else ceil_ms(fire[2]) + self.lifetime_ms
        out = {"correlation_id": correlation, "step": fire[1]}
        for edge in self.edges.values():
            _, at, _, row_id, body = max((r for r in held if r[0] == edge and r[1] <= fire[1]), key=lambda r: (r[1], r[3]))
            out |= {f"id_{edge}": row_id, f"step_{edge}": at, f"body_{edge}": body}
        return None if over is not None and over <= watermark else (over, (True, [])), [Row(**out)]


class TimeoutProcessor(Correlations):
    """Decides each correlation once: Ready in time, or TimedOut at the deadline.

    Kept: a decided flag, then the first arrival (microseconds) per edge.  With ``lifetime_ms`` the flag leaves that
    long after the span has ended.
    """

    def __init__(self, edges: tuple[str, ...], within_ms: int, lifetime_ms: int | None = None):
        self.edges, self.within_ms, self.lifetime_ms = edges, within_ms, lifetime_ms

    def note(self, seen, row):
        seen = {} if seen is None else seen
        seen[row.edge] = min(row.micros, seen.get(row.edge, row.micros))
        return seen

    def arrive(self, correlation, kept, seen, watermark):
        decided, firsts = (False, {}) if kept is None else kept[1]
        if decided:
            return kept, []
        firsts = {e: min(m[e] for m in (firsts, seen) if e in m) for e in firsts | seen}
        closes = self._closes(firsts)
        if len(firsts) == len(self.edges):
            in_time = max(firsts.values()) - min(firsts.values()) <= self.within_ms * 1000
            return self._decide(correlation, "Ready" if in_time else "TimedOut", closes, watermark)
        if closes <= watermark:
            return self._decide(correlation, "TimedOut", closes, watermark)
        return (closes, (False, firsts)), []

    def expire(self, correlation, kept, watermark):
        decided, firsts = kept[1]
        return (None, []) if decided else self._decide(correlation, "TimedOut", self._closes(firsts), watermark)

    def _closes(self, firsts: dict[str, int]) -> int:
        return ceil_ms(min(firsts.values())) + self.within_ms

    def _decide(self, correlation, outcome: str, closes: int, watermark: int) -> tuple[tuple | None, list[Row]]:
        over = None if self.lifetime_ms is None else closes + self.lifetime_ms
        kept = None if over is not None and over <= watermark else (over, (True, {}))
        return kept, [Row(correlation_id=correlation, outcome=outcome)]
