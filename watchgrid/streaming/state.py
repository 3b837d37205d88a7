"""Alert transitions and intervals, and the notice ledger, as state that outlives a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from watchgrid.operators.notices import LedgerRules

TRANSITIONS = "region long, poll_at timestamp, before int, level int"
INTERVALS = "region long, level int, started_at timestamp, ended_at timestamp"
NOTICES = "subscriber_id long, subject string, line_id long, verdict string"


def _ordered(parts: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    rows = list(parts)
    return pd.concat(rows).sort_values(by, kind="stable") if rows else pd.DataFrame()


def _polled(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """One row a time, in order: polls of the same time are one poll, of which the highest level counts."""
    rows = list(parts)
    return pd.concat(rows).groupby("poll_at", as_index=False)["level"].max().sort_values("poll_at") if rows else pd.DataFrame()


def alert_transitions(polls: DataFrame) -> DataFrame:
    """Changes of a region's level between accepted polls (region, poll_at, level); the first sight is silent. Polls of a region come in
    the order of time from batch to batch; one that is not newer than the batches before is passed over. Of polls of one time the highest level counts."""

    def step(key, parts, state: GroupState):
        before, at = state.get if state.exists else (None, None)
        out = []
        for row in _polled(parts).itertuples(index=False):
            if at is not None and row.poll_at <= at:
                continue
            if before is not None and row.level != before:
                out.append((key[0], row.poll_at, before, int(row.level)))
            before, at = int(row.level), row.poll_at
        if before is not None:
            state.update((before, at))
        yield pd.DataFrame(out, columns=["region", "poll_at", "before", "level"])

    return polls.groupBy("region").applyInPandasWithState(step, TRANSITIONS, "level int, poll_at timestamp", "append", GroupStateTimeout.NoTimeout)


def alert_intervals(polls: DataFrame) -> DataFrame:
    """Intervals of one level above 0, when they end; a region keeps what is open. An empty poll has no rows here, so it ends nothing.
    Order and polls of one time as in ``alert_transitions``."""

    def step(key, parts, state: GroupState):
        level, since, at = state.get if state.exists else (0, None, None)
        out = []
        for row in _polled(parts).itertuples(index=False):
            if at is not None and row.poll_at <= at:
                continue
            if row.level != level:
                if level > 0:
                    out.append((key[0], level, since, row.poll_at))
                level, since = int(row.level), row.poll_at
            at = row.poll_at
        if at is not None:
            state.update((level, since or at, at))
        yield pd.DataFrame(out, columns=["region", "level", "started_at", "ended_at"])

    return polls.groupBy("region").applyInPandasWithState(step, INTERVALS, "level int, since timestamp, poll_at timestamp", "append", GroupStateTimeout.NoTimeout)


def ledger(lines: DataFrame, rules: LedgerRules = LedgerRules()) -> DataFrame:
    """Verdicts of lines (subscriber_id, subject, line_id, at, distance_km) as ``operators.notices.ledger`` gives them; state: the
    last line sent of a subscriber and subject."""

    def step(key, parts, state: GroupState):
        said, km = state.get if state.exists else (None, None)
        out = []
        for row in _ordered(parts, ["at", "line_id"]).itertuples(index=False):
            minutes = None if said is None else (row.at - said).total_seconds() / 60
            if minutes is None or minutes >= rules.repeat_min:
                send = True
            elif minutes < rules.cooldown_min:
                send = False
            else:
                send = row.distance_km > 0 if km <= 0 else abs(row.distance_km - km) / km >= rules.material_change
            if send:
                said, km = row.at, float(row.distance_km)
            out.append((*key, row.line_id, "sent" if send else "suppressed"))
        if said is not None:
            state.update((said, km))
        yield pd.DataFrame(out, columns=["subscriber_id", "subject", "line_id", "verdict"])

    return lines.groupBy("subscriber_id", "subject").applyInPandasWithState(step, NOTICES, "at timestamp, km double", "append", GroupStateTimeout.NoTimeout)
