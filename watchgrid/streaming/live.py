"""The live state as a stream: changes in any order and any number of times, tracks that expire by timers of event time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from watchgrid.operators.live import HISTORY_MIN

CHANGES = "kind string, id long, seq long, at timestamp, seen timestamp, gone boolean, value double"


_ENTITY = ["kind", "id", "seq", "at", "seen", "alive"]
_STATE = "kind array<string>, id array<string>, seq array<long>, at array<long>, seen array<long>, alive array<boolean>"


def _ms(t: pd.Series) -> pd.Series:
    return t.astype("datetime64[ms]").astype("int64")


def live_changes(changes: DataFrame, history_min: int | None = HISTORY_MIN, buckets: int = 512) -> DataFrame:
    """The changes that took effect, and a last one, gone, for each entity that wasn't seen for ``history_min`` minutes of event time.

    State: the number and times of an entity's newest change; older and repeated changes are passed over. The watermark is as late as
    the history is long, so what it drops would expire at once; this needs ``at`` to rise with ``seq`` and ``seen`` not to be after
    ``at``. What is gone is remembered until the watermark has passed it, so that a late change can't bring it back. With None nothing
    expires, nothing is dropped and what is gone is remembered for good.

    Entities are kept together in ``buckets``, so a batch costs a call a bucket, not one an entity; the timer of a bucket is that of its first
    entity to expire. A stream that goes on from a checkpoint must keep their number.
    """
    timed = history_min is not None

    def step(key, parts, state: GroupState):
        past = state.getCurrentWatermarkMs() if timed else -1
        known = pd.DataFrame(dict(zip(_ENTITY, state.get if state.exists else [[]] * 6))).astype({"kind": "object", "id": "object", "seq": "int64", "at": "int64", "seen": "int64", "alive": "bool"})
        rows = [] if state.hasTimedOut else list(parts)
        out = []
        if rows:
            new = pd.concat(rows).sort_values(["seq", "gone"], kind="stable").drop_duplicates(["kind", "id", "seq"])
            new = new.merge(known[["kind", "id", "seq"]].rename(columns={"seq": "had"}), on=["kind", "id"], how="left")
            new = new[new["had"].isna() | (new["seq"] > new["had"].fillna(0).astype("int64"))]
            out.append(new[["kind", "id", "seq", "at", "seen", "gone", "value"]])
            last = new.drop_duplicates(["kind", "id"], keep="last")
            last = pd.DataFrame({"kind": last["kind"], "id": last["id"], "seq": last["seq"], "at": _ms(last["at"]), "seen": _ms(last["seen"].fillna(last["at"])), "alive": ~last["gone"].astype("bool")})
            known = pd.concat([known, last]).drop_duplicates(["kind", "id"], keep="last")
        if timed:
            over = known["alive"] & (known["seen"] < past)
            ended = known[over]
            out.append(pd.DataFrame({"kind": ended["kind"], "id": ended["id"], "seq": ended["seq"], "at": pd.to_datetime(ended["at"], unit="ms"), "seen": pd.to_datetime(ended["seen"], unit="ms"), "gone": True, "value": float("nan")}))
            known = known.assign(alive=known["alive"] & ~over)
            known = known[known["alive"] | (known["at"] >= past)]
        if len(known):
            state.update(tuple(known[c].tolist() for c in _ENTITY))
            if timed:
                state.setTimeoutTimestamp(int(max(known["seen"].where(known["alive"], known["at"]).min(), past + 1)))
        elif state.exists:
            state.remove()
        for rows in out:
            if len(rows):
                yield rows.astype({"value": "float64"})

    # ids as strings, since a null among them would make pandas' numbers inexact
    bucket = F.pmod(F.xxhash64("kind", "id"), F.lit(buckets)).alias("bucket")
    rows = changes.where("seq is not null").select(bucket, "kind", F.col("id").cast("string").alias("id"), "seq", "at", "seen", "gone", "value")
    if timed:
        rows = rows.withWatermark("at", f"{history_min} minutes")
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    found = rows.groupBy("bucket").applyInPandasWithState(step, CHANGES.replace("id long", "id string"), _STATE, "append", timeout)
    return found.withColumn("id", F.col("id").cast("long"))
