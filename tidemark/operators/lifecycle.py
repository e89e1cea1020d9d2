"""Event-sourced cases: status is derived from an append-only log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STAGES = ["DETECTION", "QUALIFICATION", "ACTIVE", "CONCLUDED"]
OPENS, ACTIVATES, ENDS = {"CONSOLIDATION", "ACCUMULATION"}, {"BREAKOUT_WATCH", "BREAKOUT_READY"}, {"UPTREND", "DISTRIBUTION", "DOWN_TREND"}
MIN_SCORE, MIN_CONFIDENCE, ACTIVE_DAYS, DETECTION_DAYS = 60.0, 50.0, 180, 365


def current_status(events: DataFrame, key: str = "case_id", sequence: str = "sequence_number") -> DataFrame:
    """Latest status per case, by sequence."""
    return events.groupBy(key).agg(F.max_by("status", sequence).alias("status"), F.max(sequence).alias("sequence_number"), F.max_by("at", sequence).alias("at"))


def regressions(events: DataFrame, key: str = "case_id", sequence: str = "sequence_number") -> DataFrame:
    """Events whose stage lies before an earlier one of the case."""
    at = F.array_position(F.array(*map(F.lit, STAGES)), F.col("status"))
    w = Window.partitionBy(key).orderBy(sequence).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("_at", at).withColumn("_top", F.max("_at").over(w)).where(F.col("_at") < F.col("_top")).drop("_at", "_top")


#: Decisions that end an open case for reasons outside price.
INVALIDATES = {"INELIGIBLE", "LOST_ELIGIBILITY"}


class Machine:
    """The state of one entity's open case; step() gives the events of one observation.

    In order: a decision that invalidates, expiry, an end state, then what the stage waits for. An active
    case whose count of backward transitions rises records a retreat and stays active. Absent evidence
    (a null score, confidence or count) never advances a case."""

    def __init__(self, number: int = 0, stage: str | None = None, since: pd.Timestamp | None = None, backward: int | None = None):
        self.number, self.stage, self.since, self.backward = number, stage, since, backward

    def due(self) -> pd.Timestamp | None:
        """When the open case expires if nothing changes: the first instant that is more whole days away than its stage allows."""
        return self.since + pd.Timedelta(days=(ACTIVE_DAYS if self.stage == "ACTIVE" else DETECTION_DAYS) + 1) if self.stage else None

    def expire(self, now: pd.Timestamp | None) -> list[tuple[pd.Timestamp, int, str, str]]:
        """The expiry that lies at or before `now`, at its own instant."""
        due = self.due()
        if due is None or now is None or pd.isna(now) or due > now:
            return []
        self.stage = None
        return [(due, self.number, "CONCLUDED", "expired")]

    def step(self, at: pd.Timestamp, state: str | None, score: float | None, confidence: float | None, decision: str | None = None,
             backward: int | None = None) -> list[tuple[int, str, str]]:
        if decision in INVALIDATES:
            if not self.stage:
                return []
            self.stage = None
            return [(self.number, "CONCLUDED", decision.lower())]
        if not self.stage:
            if state not in OPENS:
                return []
            self.number, self.stage, self.since, self.backward = self.number + 1, "DETECTION", at, backward
            return [(self.number, "DETECTION", state.lower())]
        if (at - self.since).days > (ACTIVE_DAYS if self.stage == "ACTIVE" else DETECTION_DAYS):
            self.stage = None
            return [(self.number, "CONCLUDED", "expired")]
        if state in ENDS:
            self.stage = None
            return [(self.number, "CONCLUDED", state.lower())]
        if self.stage == "DETECTION":
            if score is None or confidence is None or score < MIN_SCORE or confidence < MIN_CONFIDENCE:
                return []
            self.stage, self.since = "QUALIFICATION", at
            return [(self.number, "QUALIFICATION", "score")]
        if self.stage == "QUALIFICATION":
            if state not in ACTIVATES:
                return []
            self.stage, self.since, self.backward = "ACTIVE", at, backward
            return [(self.number, "ACTIVE", state.lower())]
        before, self.backward = self.backward, backward if backward is not None else self.backward
        if backward is None or before is None or backward <= before:
            return []
        return [(self.number, "ACTIVE", "retreat")]


def advance(observations: DataFrame, *, until=None) -> DataFrame:
    """Case events of rows (entity_id, at, state, score, confidence, and where there are such columns decision
    and backward_transitions), each entity in order of time.

    An overdue case expires with its entity's next row. With `until` it expires at its own instant instead, rows
    that come later find it closed, and cases that are due by `until` expire without any row.

    Rows are stepped through in sorted batches; only the current entity's state is kept, so no history is held whole."""
    until = None if until is None else pd.Timestamp(until)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, m, last, sequence, like = object(), Machine(), 0, 0, None
        rows: list[tuple] = []

        def add(events: list[tuple]) -> None:
            nonlocal last, sequence
            for t, n, s, why in events:
                sequence = sequence + 1 if n == last else 0
                last = n
                rows.append((now, n, t, s, why, sequence))

        def table() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["entity_id", "case_number", "at", "status", "reason", "sequence_number"])
            rows.clear()
            return out.astype(like)

        for pdf in batches:
            like = {"entity_id": pdf["entity_id"].dtype, "at": pdf["at"].dtype}
            for r in pdf.itertuples():
                nothing = lambda x: None if pd.isna(x) else x
                entity = nothing(r.entity_id)
                if entity != now:
                    add(m.expire(until))
                    now, m, last = entity, Machine(), 0
                if until is not None:
                    add(m.expire(r.at))
                add([(r.at, *e) for e in m.step(r.at, *map(nothing, (r.state, r.score, r.confidence, r.decision, r.backward_transitions)))])
            yield table()
        add(m.expire(until))
        if rows:
            yield table()

    kind = dict(observations.dtypes)
    columns = ["entity_id", "at", "state", "score", "confidence", "decision", "backward_transitions"]
    return complete(observations).select(*columns).repartition("entity_id").sortWithinPartitions("entity_id", F.col("at").asc_nulls_last(), "state", "score", "confidence", "decision", "backward_transitions").mapInPandas(
        run, f"entity_id {kind['entity_id']}, case_number int, at {kind['at']}, status string, reason string, sequence_number int")


def complete(observations: DataFrame) -> DataFrame:
    """With null columns for what the observations lack."""
    more = {"decision": "string", "backward_transitions": "int"}
    return observations.withColumns({k: F.lit(None).cast(t) for k, t in more.items() if k not in observations.columns})


def advance_stream(observations: DataFrame, watermark: str = "1 day") -> DataFrame:
    """The same machine on a stream, its state kept per entity."""
    kind = dict(observations.dtypes)

    def run(key, batches: Iterator[pd.DataFrame], state):
        m = Machine(*state.get) if state.exists else Machine()
        if state.exists and m.since is not None:
            m.since = pd.Timestamp(m.since)
        for pdf in batches:
            rows = []
            for r in pdf.sort_values(["at", "state", "score", "confidence"]).itertuples():
                nothing = lambda x: None if pd.isna(x) else x
                rows += [(key[0], n, r.at, s, why) for n, s, why in m.step(r.at, *map(nothing, (r.state, r.score, r.confidence, r.decision, r.backward_transitions)))]
            yield pd.DataFrame(rows, columns=["entity_id", "case_number", "at", "status", "reason"])
        state.update((m.number, m.stage, None if m.since is None else str(m.since), m.backward))

    return complete(observations).withWatermark("at", watermark).groupBy("entity_id").applyInPandasWithState(
        run, f"entity_id {kind['entity_id']}, case_number int, at {kind['at']}, status string, reason string",
        "number int, stage string, since string, backward int", "append", "NoTimeout")


class CaseProcessor(StatefulProcessor):
    """The machine of one entity on a stream, with one event-time timer: when its open case is due."""

    KIND = "number int, stage string, since bigint, backward int"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.case = handle.getValueState("case", self.KIND)

    def _load(self) -> Machine:
        kept = self.case.get() if self.case.exists() else None
        return Machine(kept[0], kept[1], None if kept[2] is None else pd.Timestamp(kept[2], unit="ms"), kept[3]) if kept else Machine()

    def _keep(self, m: Machine, before: pd.Timestamp | None) -> None:
        millis = lambda t: int(t.value // 1_000_000)
        if before != m.due():
            if before is not None:
                self.handle.deleteTimer(millis(before))
            if m.due() is not None:
                self.handle.registerTimer(millis(m.due()))
        self.case.update((m.number, m.stage, None if m.since is None else millis(m.since), m.backward))

    @staticmethod
    def _table(entity, events: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(entity, n, at, s, why) for at, n, s, why in events], columns=["entity_id", "case_number", "at", "status", "reason"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        nothing = lambda x: None if pd.isna(x) else x
        m, events = self._load(), []
        before = m.due()
        # of one trigger in order of time
        for r in pd.concat(list(rows)).sort_values(["at", "state", "score", "confidence"]).itertuples():
            events += m.expire(r.at)
            events += [(r.at, *e) for e in m.step(r.at, *map(nothing, (r.state, r.score, r.confidence, r.decision, r.backward_transitions)))]
        self._keep(m, before)
        yield self._table(key[0], events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        m = self._load()
        before = m.due()
        events = m.expire(pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"))
        if events:
            # the timer that fired is gone; nothing is left to wait for
            self.case.update((m.number, None, None, m.backward))
        yield self._table(key[0], events if before is not None else [])

    def close(self) -> None:
        pass


def advance_with_timers(observations: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Like advance(until=...) on a stream: a case expires when the watermark passes its due instant, whether its
    entity is heard of again or not. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    kind = dict(observations.dtypes)["entity_id"]
    return complete(observations).withWatermark("at", watermark).groupBy("entity_id").transformWithStateInPandas(
        CaseProcessor(), f"entity_id {kind}, case_number int, at timestamp, status string, reason string", "append", "eventTime")
