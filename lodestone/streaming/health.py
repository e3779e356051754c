"""Provider health as a keyed state machine over an event log: batch replay and Structured Streaming share one step.

Events have provider, ts (seconds), kind (success, rate_limit, timeout, server_error, error), elapsed, items. Time is event
time, so a replay gives what the stream gave.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Seconds of cooldown, counts until a provider is blocked, seconds of budget, words of error messages.
COOLDOWN = {"rate_limit": 120.0, "timeout": 10.0, "server_error": 10.0}
RATE_LIMIT_COOLDOWN = {"semantic_scholar": 5.0, "openalex": 120.0}
MOST = {"rate_limit": 2, "timeout": 2, "error": 5}
MOST_RATE_LIMITS = {"semantic_scholar": 3, "openalex": 2}
BUDGET = {"pasa_local": 10.0, "openalex": 35.0, "semantic_scholar": 20.0, "arxiv": 15.0, "pubmed": 15.0, "faiss_vector": 30.0}
OTHER_BUDGET, LEAST_BUDGET, SLOW_AND_EMPTY, SLOW_SECONDS, DEGRADED_SHARE = 45.0, 15.0, 0.7, 10.0, 0.5
ERROR_WORDS = {"rate_limit": ("429", "too many requests", "rate limit"), "timeout": ("timeout", "timed out", "handshake"), "server_error": ("500", "502", "503", "504")}
# What a provider's state outlives its last event by, in seconds; then the provider starts anew.
IDLE = 86_400.0
RECOVERED = "recovered"
OUT = "provider string, ts double, kind string, state string, errors int, allowed boolean, budget double"
STATE = "state string, errors int, successes int, rate_limits int, timeouts int, until double, base double, last double"


def error_kind(message: Column) -> Column:
    """The kind of an error by its message; the first kind whose words it holds."""
    low, kind = F.lower(F.coalesce(message, F.lit(""))), F.lit("error")
    for name, words in reversed(ERROR_WORDS.items()):
        for word in words:
            kind = F.when(low.contains(word), name).otherwise(kind)
    return kind


@dataclass
class Health:
    state: str = "healthy"
    errors: int = 0
    successes: int = 0
    rate_limits: int = 0
    timeouts: int = 0
    until: float = 0.0
    base: float = OTHER_BUDGET
    last: float | None = None

    @staticmethod
    def of(provider: str) -> Health:
        return Health(base=BUDGET.get(provider, OTHER_BUDGET))

    @property
    def budget(self) -> float:
        """Seconds that a call may take now: nothing when blocked, half when degraded."""
        return 0.0 if self.state == "blocked" else self.base * DEGRADED_SHARE if self.state == "degraded" else self.base

    def recovers(self, ts: float) -> bool:
        """Whether a cooldown is over by ts; it leaves the provider degraded."""
        over = self.state == "cooldown" and ts >= self.until
        if over:
            self.state = "degraded"
        return over

    def _cool(self, ts: float, seconds: float) -> None:
        self.state, self.until = "cooldown", ts + seconds

    def step(self, provider: str, ts: float, kind: str, elapsed: float, items: int) -> bool:
        """Take one event in; returns whether the call was allowed."""
        allowed, self.last = self.state not in ("blocked", "cooldown"), ts
        if kind == "success":
            self.successes += 1
            self.errors = max(0, self.errors - 1)
            if self.state == "degraded" and self.successes >= 2:
                self.state = "healthy"
            if items == 0 and elapsed > SLOW_SECONDS and self.successes <= 1:
                self.base = max(LEAST_BUDGET, self.base * SLOW_AND_EMPTY)
            return allowed
        self.errors += 1
        if kind == "rate_limit":
            self.rate_limits += 1
            blocked = self.rate_limits >= MOST_RATE_LIMITS.get(provider, MOST["rate_limit"])
            seconds = RATE_LIMIT_COOLDOWN.get(provider, COOLDOWN["rate_limit"])
        elif kind == "timeout":
            self.timeouts += 1
            blocked, seconds = self.timeouts >= MOST["timeout"], COOLDOWN["timeout"]
        elif kind == "server_error":
            blocked, seconds = False, COOLDOWN["server_error"]
        else:
            blocked, seconds = self.errors >= MOST["error"], None
        if blocked:
            self.state = "blocked"
        elif seconds is not None:
            self._cool(ts, seconds)
        return allowed

    def row(self, provider: str, ts: float, kind: str, allowed: bool) -> tuple:
        return (provider, ts, kind, self.state, self.errors, allowed, self.budget)


_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def _advance(health: Health, provider: str, rows: pd.DataFrame) -> tuple[Health, list[tuple]]:
    """Events in order of time, each with the state after it; the end of a cooldown is a row of its own."""
    out = []
    for r in rows.sort_values(["ts", "kind"], kind="stable").itertuples():
        if health.last is not None and r.ts >= health.last + IDLE:
            out += _expired(health, provider)
            health = Health.of(provider)
        if health.recovers(r.ts):
            out.append(health.row(provider, health.until, RECOVERED, True))
        elapsed, items = (0.0 if pd.isna(v) else v for v in (r.elapsed, r.items))
        allowed = health.step(provider, r.ts, r.kind, elapsed, int(items))
        out.append(health.row(provider, r.ts, r.kind, allowed))
    return health, out


def _expired(health: Health, provider: str) -> list[tuple]:
    """What a log's end or a long pause still brings: the end of a cooldown."""
    return [health.row(provider, health.until, RECOVERED, True)] if health.recovers(float("inf")) else []


def replay(events: DataFrame) -> DataFrame:
    """The state after every event of a finished log, and after every cooldown; a provider that pauses for IDLE seconds starts anew.

    Providers' logs run in order of time through a task in batches, so none is held whole. Equal times go by kind.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider, health, open_log = None, Health(), False
        for batch in batches:
            for name, rows in batch.groupby("provider", sort=False, dropna=False):
                name = None if pd.isna(name) else name
                if not open_log or name != provider:
                    if open_log and (rest := _expired(health, provider)):
                        yield pd.DataFrame(rest, columns=_COLUMNS)
                    provider, health, open_log = name, Health.of(name), True
                health, out = _advance(health, name, rows)
                yield pd.DataFrame(out, columns=_COLUMNS)
        if open_log and (rest := _expired(health, provider)):
            yield pd.DataFrame(rest, columns=_COLUMNS)

    columns = ["provider", "ts", "kind", "elapsed", "items"]
    ordered = events.select(columns).repartition("provider").sortWithinPartitions("provider", "ts", "kind")
    return ordered.mapInPandas(run, OUT)


class HealthProcessor(StatefulProcessor):
    """Keeps a provider's Health. One timer ends its cooldown, another, IDLE seconds after the last event, drops the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("health", STATE)

    def _timers(self, health: Health) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int((health.last + IDLE) * 1000))
        if health.state == "cooldown":
            self.handle.registerTimer(int(health.until * 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - names of the interface
        health = Health(*self.value.get()) if self.value.exists() else Health.of(key[0])
        health, out = _advance(health, key[0], pd.concat(list(rows)))
        self.value.update(tuple(asdict(health).values()))
        self._timers(health)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.value.exists():
            return
        health = Health(*self.value.get())
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        out = [health.row(key[0], health.until, RECOVERED, True)] if health.recovers(now) else []
        if now >= int((health.last + IDLE) * 1000) / 1000:
            self.value.clear()
        else:
            self.value.update(tuple(asdict(health).values()))
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def stream(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """The same over a stream. Events later than `late` behind the newest are dropped; a cooldown's end is told when the
    watermark has passed it, though no event came. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    timed = events.select("provider", "ts", "kind", "elapsed", "items", F.timestamp_seconds("ts").alias("at")).withWatermark("at", late)
    return timed.groupBy("provider").transformWithStateInPandas(HealthProcessor(), OUT, "append", "eventTime")


def windowed(events: DataFrame, time: str, by: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Extension: counts per window of event time; rows later than `late` are dropped by the watermark when streaming."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))


def visits(events: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Extension: session windows per key."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), by).agg(F.count("*").alias("n"))
