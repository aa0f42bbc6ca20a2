"""Transition events from a stream of visits that come out of order.

The state of a (subject, text) is its last visit and the visits that wait. A visit waits until the watermark has passed
its time, since an earlier one may still come; then a timer puts the visits that are due in order and gives their
events, as the batch operator would. A visit that is behind the last one that was given, or whose time the watermark had
passed when it came, is counted in a row of its own and makes no event. State goes once nothing can follow on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "subject_id string, text_id string, src_word long, dst_word long, event_type string, weight double, late long"
LAST = "word_index long, line_id long, fixation_order long, at long, seen long"
WAITING = "at long, fixation_order long, word_index long, line_id long"
#: The state store that timers and lists need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _kind(src: int, dst: int, src_line, dst_line) -> str:
    if src == dst:
        return "refixation"
    if src_line is not None and dst_line is not None and dst_line > src_line:
        return "line_return"
    return "forward" if dst > src else "regression"


#: The state before any visit.
NOTHING = (None, None, None, None, 0)


class Transitions(StatefulProcessor):
    """Buffers visits by event time and gives their transitions once no earlier visit can come."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", LAST)
        self.waiting = handle.getListState("waiting", WAITING)

    def _follows(self, last: tuple | None, at: int) -> bool:
        """Whether a visit at that time goes on from the last one, and does not begin anew."""
        return last is not None and last[2] is not None and at - last[3] <= self.idle_ms

    def _frame(self, key: tuple, events: list[tuple], late: int = 0) -> Iterator[pd.DataFrame]:
        rows = [(*key, *e, None) for e in events] + ([(*key, None, None, None, None, late)] if late else [])
        if rows:
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])
            yield frame.astype({"src_word": "Int64", "dst_word": "Int64", "weight": "float64", "late": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        watermark = timerValues.getCurrentWatermarkInMs()
        last = self.last.get() if self.last.exists() else None
        late, kept, seen = 0, [], 0
        for frame in rows:
            for at, order, word, line in zip(frame["at"], frame["fixation_order"], frame["word_index"], frame["line_id"]):
                seen = max(seen, int(at))
                if at < watermark or self._follows(last, int(at)) and order <= last[2]:
                    late += 1
                else:
                    kept.append((int(at), int(order), int(word), None if pd.isna(line) else int(line)))
        for visit in kept:
            self.waiting.appendValue(visit)
        for at in {v[0] for v in kept}:
            self.handle.registerTimer(at + 1)
        before = last if last is not None else NOTHING
        seen = max(seen, before[4], watermark)
        self.last.update((*before[:4], seen))
        self.handle.registerTimer(seen + self.idle_ms)
        yield from self._frame(key, [], late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = expiredTimerInfo.getExpiryTimeInMs()
        waiting = sorted(tuple(v) for v in self.waiting.get()) if self.waiting.exists() else []
        due, rest = [v for v in waiting if v[0] < now], [v for v in waiting if v[0] >= now]
        last = tuple(self.last.get()) if self.last.exists() else NOTHING
        events, late = [], 0
        for at, order, word, line in due:
            if self._follows(last, at):
                if order <= last[2]:
                    late += 1
                    continue
                events.append((last[0], word, _kind(last[0], word, last[1], line), 1.0))
            last = (word, line, order, at, last[4])
        if not rest and now >= last[4] + self.idle_ms:
            self.last.clear()
            self.waiting.clear()
        elif due:
            self.last.update(last)
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        yield from self._frame(key, events, late)

    def close(self) -> None:
        pass


def stream_events(visits: DataFrame, delay: str = "10 minutes", idle: int = 86_400) -> DataFrame:
    """One event for each visit that follows another in its (subject, text), by time; and the numbers of late visits.

    ``visits`` (subject_id, text_id, word_index, line_id, fixation_order, ts), orders rising with times. Visits may come
    in any order within ``delay``. Rows with ``late`` have no event. A visit more than ``idle`` seconds after the last, by
    event time, begins anew, in whatever batch it comes. The session needs the state store in ``STORE``.
    """
    timed = visits.withWatermark("ts", delay).select(
        "subject_id", "text_id", "word_index", "line_id", "fixation_order", F.unix_millis("ts").alias("at")
    )  # without its column of time, so that late visits reach the operator and are counted
    return timed.groupBy("subject_id", "text_id").transformWithStateInPandas(Transitions(1000 * idle), OUTPUT, "Append", "EventTime")
