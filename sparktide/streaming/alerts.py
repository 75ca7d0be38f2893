"""Streaming alerts: pending and firing state per (rule, series)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktide.functions.labels import labels_of
from sparktide.operators.alerts import NotifierSet, RuleSet, alert_holds, match_rules, route_alerts
from sparktide.operators.store import MICROS_PER_SLICE
from sparktide.sinks.fanout import fan_out
from sparktide.sinks.text import alert_payloads
from sparktide.streaming.state import InOrder, with_state

_OUT = (
    "rule string, series_id string, name string, severity string, value double, since_us bigint, at_us bigint, "
    "firing boolean, notify array<string>"
)
_RUN = (
    "pending_us bigint, firing boolean, last_us bigint, last_value double, timer_ms bigint, name string, severity string, "
    "notify array<string>, silent_us bigint, reach_us bigint"
)

_TESTS = {
    ">": np.greater, "<": np.less, ">=": np.greater_equal, "<=": np.less_equal, "==": np.equal, "!=": np.not_equal,
}


def _rate_holds(rows: pd.DataFrame, us: np.ndarray, past_us: np.ndarray, past_value: np.ndarray):
    """Outcome of a rate rule for each row, and the history still in reach afterwards."""
    first = rows.iloc[0]
    reach = int(round(first["window_s"] * 1e6))
    values = rows["value"].to_numpy(dtype=float)
    all_us, all_values = np.concatenate([past_us, us]), np.concatenate([past_value, values])
    order = np.argsort(all_us, kind="stable")
    all_us, all_values = all_us[order], all_values[order]
    oldest = np.searchsorted(all_us, us - reach, side="left")
    gone = (us - all_us[oldest]) / 1e6
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = (values - all_values[oldest]) / gone
    held = (gone > 0) & _TESTS[first["operator"]](rate, first["threshold"])
    live = all_us >= us[-1] - reach
    return held, all_us[live], all_values[live]


class Alerts(InOrder):
    """Runs of holding samples of one rule on one series.

    State is the run (its start, whether it fires, the last sample) and, for
    rate rules, a list of the samples still within the window.  Neither is kept
    where it says no more than that nothing is known.  A rule with a silence has
    a timer after the last sample; once the watermark has passed it, the run
    ends as if a sample had come that does not hold.
    """

    def __init__(self, timed: bool):
        super().__init__(["us", "seq"], MICROS_PER_SLICE)
        self.timed = timed

    def init(self, handle) -> None:
        super().init(handle)
        self.run = handle.getValueState("run", _RUN)
        self.past = handle.getListState("past", "us bigint, value double")

    def begin(self, key, timers) -> None:
        self.had_run = self.run.exists()
        state = self.run.get() if self.had_run else (None, False, None, None, None, None, None, None, 0, 0)
        self.pending, self.firing, self.last_us, self.last_value, self.timer_ms, *self.about = state
        past = list(self.past.get())
        self.had_past = bool(past)
        self.past_us, self.past_value = np.array([p[0] for p in past], dtype=np.int64), np.array([p[1] for p in past], dtype=float)

    def step(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        silent_us, reach_us = int(round(first["silent_s"] * 1e6)), int(round(first["window_s"] * 1e6))
        self.about = [first["name"], first["severity"], list(first["notify"]), silent_us, reach_us]
        us = rows["us"].to_numpy(dtype=np.int64)
        held = rows["holds"].to_numpy(dtype=bool)
        values = rows["value"].to_numpy(dtype=float)
        if first["cond_type"] == "rate_of_change":
            held, self.past_us, self.past_value = _rate_holds(rows, us, self.past_us, self.past_value)
        last_us, last_value = int(us[-1]), float(values[-1])
        if silent_us:
            before = np.concatenate([[us[0] if self.last_us is None else self.last_us], us[:-1]])
            gap = np.flatnonzero(us - before > silent_us)
            value_before = np.concatenate([[0.0 if self.last_value is None else self.last_value], values[:-1]])
            us, held = np.insert(us, gap, before[gap] + silent_us), np.insert(held, gap, False)
            values = np.insert(values, gap, value_before[gap])

        before = np.concatenate([[self.pending is not None], held[:-1]])
        run = np.maximum.accumulate(np.where(held & ~before, np.arange(len(us)), -1))
        since = np.where(run >= 0, us[run], self.pending if self.pending is not None else 0)
        wait = int(round(first["for_s"] * 1e6))
        firing = held & ((us - since >= wait) | ((run < 0) & bool(self.firing)))
        turned = firing != np.concatenate([[bool(self.firing)], firing[:-1]])
        self.pending = int(since[-1]) if held[-1] else None
        self.firing, self.last_us, self.last_value = bool(firing[-1]), last_us, last_value
        return self._events(key, values[turned], np.where(firing, since, us)[turned], us[turned], firing[turned])

    def _events(self, key, value, since, at, firing) -> pd.DataFrame:
        name, severity, notify = self.about[:3]
        return pd.DataFrame({
            "rule": key[0], "series_id": key[1], "name": name, "severity": severity, "value": value, "since_us": since, "at_us": at,
            "firing": firing, "notify": [notify] * len(value),
        })

    def end(self, key, timers) -> None:
        self._store(self.last_us + self.about[3] if self.about[3] else None)

    def _store(self, timer_us: int | None) -> None:
        """Write what is known, wake up at the time given, and leave no state where nothing is known."""
        timer_ms = -(-timer_us // 1000) if self.timed and timer_us is not None else None
        if self.timer_ms is not None and self.timer_ms != timer_ms:
            self.handle.deleteTimer(self.timer_ms)
        if timer_ms is not None and timer_ms != self.timer_ms:
            self.handle.registerTimer(timer_ms)
        self.timer_ms = timer_ms
        if len(self.past_us):
            self.past.put(list(zip(self.past_us.tolist(), self.past_value.tolist())))
        elif self.had_past:
            self.past.clear()
        if self.pending is not None or self.firing or timer_ms is not None:
            self.run.update((self.pending, self.firing, self.last_us, self.last_value, timer_ms, *self.about))
        elif self.had_run:
            self.run.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.begin(key, timerValues)
        self.timer_ms = None  # it has gone off
        if self.last_us is None:
            return
        at, (silent_us, reach_us) = self.last_us + self.about[3], self.about[3:]
        if self.firing:
            yield self._events(key, np.array([self.last_value]), np.array([at]), np.array([at]), np.array([False]))
        self.pending, self.firing = None, False
        # what a rate rule still has in reach is dropped when its window has passed, too
        wake = self.last_us + max(reach_us, silent_us) + 1000
        live = len(self.past_us) and expiredTimerInfo.getExpiryTimeInMs() * 1000 < wake
        if not live:
            self.past_us, self.past_value = self.past_us[:0], self.past_value[:0]
        self._store(wake if live else None)


def stream_alerts(samples: DataFrame, rules: RuleSet, delay: str | None = None) -> DataFrame:
    """Firing and resolved events of a sample stream.

    Rules are matched and simple conditions tested in the JVM; the state keeps
    the run start, the firing flag and, for rate rules, the samples still within
    the rule's window.  Rules with a silence need ``delay``, how late a sample
    may be: their alerts resolve when the newest time seen minus ``delay`` has
    passed the silence, also without another sample.  Samples later than that
    are dropped then.
    """
    timed = bool(rules.silences_s)
    if timed and delay is None:
        raise ValueError("rules with a silence need a delay")
    if timed:
        samples = samples.withWatermark("ts", delay)
    matched = match_rules(samples, rules, early=not timed).withColumn("holds", alert_holds()).select(
        "rule", "series_id", "name", *(["ts"] if timed else []), F.unix_micros("ts").alias("us"), "seq", "value", "severity", "for_s",
        "window_s", "operator", "threshold", "cond_type", "notify", "holds", "silent_s",
    )
    events = with_state(matched.groupBy("rule", "series_id"), Alerts(timed), _OUT, time_mode="eventTime" if timed else "none")
    return events.select(
        "rule", F.col("name").alias("metric"), labels_of(F.col("series_id")).alias("labels"), "series_id", "severity",
        "value", F.timestamp_micros("since_us").alias("since"), F.timestamp_micros("at_us").alias("at"), "firing", "notify",
    )


def notify(
    notifiers: NotifierSet,
    deliver: Mapping[str, Callable[[DataFrame, int], None]],
    on_error: Callable[[str, int, Exception], None] | None = None,
):
    """A ``foreachBatch`` function over alert events that hands each notifier its payload rows.

    ``deliver`` maps notifier names to the callables that send; one failing
    notifier does not keep the others from theirs.
    """
    def only(name: str, send):
        return lambda routed, batch_id: send(routed.where(F.col("notifier") == name), batch_id)

    each = fan_out({name: only(name, send) for name, send in deliver.items()}, on_error)

    def consume(events: DataFrame, batch_id: int) -> None:
        each(alert_payloads(route_alerts(events, notifiers)), batch_id)

    return consume
