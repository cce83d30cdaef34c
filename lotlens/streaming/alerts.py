"""The alerts of operators.alerts as a stream: one keyed state for each car, with a timer for the rule that needs no scan.

State is a value (marks and what was told), a list (cheaper offers told of) and one timer, the moment from which the car is
slow; so a car that is not scanned again is still told of, once the watermark passes that moment. Scans that arrive out of
order within a batch are sorted; one not newer than the last told is ignored, so marks never go back. The query needs the
RocksDB state store (STATE_STORE) and a checkpoint, from which a restart goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from math import floor

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.alerts import ALERT, CHEAPER_PCT, LEAST_DEMAND, LEAST_MODEL_N, MOVE_PCT, SLOW_DAYS, SLOW_FACTOR

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_MARKS = "last long, mark double, searches long, people long, slow boolean, due long"


def _half_up(x: float, places: int = 0) -> float:
    """Rounded as Spark rounds."""
    scale = 10**places
    return (floor(abs(x) * scale + 0.5) / scale) * (1 if x >= 0 else -1)


def _ms(t: datetime) -> int:
    return int(t.timestamp() * 1000)


class DealerAlerts(StatefulProcessor):
    def __init__(self, least_demand: int = LEAST_DEMAND):
        self.least_demand = least_demand

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.marks = handle.getValueState("marks", _MARKS)
        self.cheaper = handle.getListState("cheaper", "id long")

    def close(self) -> None:
        pass

    def _clear_timers(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, mark, searches, people, slow, due = self.marks.get() if self.marks.exists() else (None, None, None, None, False, None)
        known = {x[0] for x in self.cheaper.get()} if self.cheaper.exists() else set()
        before = set(known)
        for r in sorted(rows, key=lambda r: r.at):
            at = _ms(r.at)
            if last is not None and at <= last:
                continue
            last = at
            if r.gone:
                mark, searches, people, slow, due, known = None, None, None, False, None, set()
                continue
            if r.enough and (r.median or 0) > 0:
                if mark is None or mark <= 0:
                    mark = r.median
                elif abs(moved := _half_up((r.median / mark - 1) * 100, 1)) >= MOVE_PCT:
                    yield Row(item=key[0], at=r.at, kind="market_moved", key="down" if moved < 0 else "up", pct=moved)
                    mark = r.median
            if r.cheaper_id is not None and r.cheaper_id not in known and (r.price or 0) > 0 and (r.cheaper_price or 0) > 0:
                if (pct := _half_up((1 - r.cheaper_price / r.price) * 100)) >= CHEAPER_PCT:
                    yield Row(item=key[0], at=r.at, kind="cheaper_nearby", key=str(r.cheaper_id), pct=pct)
                    known.add(r.cheaper_id)
            if r.since is not None and not slow:
                days = floor(r.model_days * SLOW_FACTOR) + 1 if r.model_days is not None and (r.model_n or 0) >= LEAST_MODEL_N else SLOW_DAYS
                due = _ms(r.since + timedelta(days=days))
                if at >= due:
                    yield Row(item=key[0], at=r.at, kind="slow", key="", pct=None)
                    slow, due = True, None
            if r.searches is not None and r.people is not None:
                if people is None:
                    searches, people = r.searches, r.people
                elif r.people - people >= self.least_demand and r.searches - searches >= self.least_demand:
                    yield Row(item=key[0], at=r.at, kind="new_demand", key=f"{r.searches}:{r.people}", pct=None)
                    searches, people = r.searches, r.people
        self.marks.update((last, mark, searches, people, slow, due))
        if known != before:
            self.cheaper.clear()
            for x in sorted(known):
                self.cheaper.appendValue((x,))
        self._clear_timers()
        if due is not None:
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, mark, searches, people, slow, due = self.marks.get()
        if not slow and due is not None:
            self.marks.update((last, mark, searches, people, True, None))
            yield Row(item=key[0], at=datetime.fromtimestamp(due / 1000, timezone.utc).replace(tzinfo=None), kind="slow", key="", pct=None)


def told(scans: DataFrame, late: str = "2 days", least_demand: int = LEAST_DEMAND) -> DataFrame:
    """The stream of alerts (ALERT) of a stream of scans (operators.alerts.SCAN)."""
    return scans.withWatermark("at", late).groupBy("item").transformWithState(statefulProcessor=DealerAlerts(least_demand), outputStructType=ALERT, outputMode="Append", timeMode="EventTime")
