"""Event streams: windows with late data, deduplication, and draft rooms as a keyed state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events with a time that can carry a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and kind, tumbling or sliding."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("cents").alias("cents")).select(F.col("w.start").alias("start"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Activity of users without a pause over ``gap``."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def once(events: DataFrame) -> DataFrame:
    """The first arrival of each event while the watermark allows."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


OUT = "room long, event_id long, action string, accepted boolean, status string, next_pick int, deadline double"

#: Seconds that a late bid leaves on the clock.
EXTENSION = 10.0


def step(state: dict, event: dict) -> tuple[dict, bool]:
    """One action on a room: lobby, active, paused or completed; a player is picked once; undo takes the last pick back.

    ``event``: action, player, at (seconds), total (picks of the room), limit (seconds to a pick).
    """
    s = dict(state)
    a, ok = event["action"], False
    if a == "start" and s["status"] == "lobby" or a == "resume" and s["status"] == "paused":
        s["status"], s["deadline"], ok = "active", event["at"] + event["limit"], True
    elif a == "pause" and s["status"] == "active":
        s["status"], ok = "paused", True
    elif a == "pick" and s["status"] == "active" and event["player"] not in s["taken"]:
        s["taken"], ok = [*s["taken"], event["player"]], True
        s["deadline"] = event["at"] + event["limit"]
        s["status"] = "completed" if len(s["taken"]) >= event["total"] else "active"
    elif a == "undo" and s["status"] in ("active", "completed") and s["taken"]:
        s["taken"], s["status"], ok = s["taken"][:-1], "active", True
    elif a == "bid" and s["status"] == "active":
        ok = event["at"] <= s["deadline"]
        if ok and s["deadline"] - event["at"] < EXTENSION:
            s["deadline"] = event["at"] + EXTENSION
    return s, ok


START = {"status": "lobby", "taken": [], "deadline": 0.0}


def replay(rows: pd.DataFrame, state: dict) -> tuple[pd.DataFrame, dict]:
    """Folds the events of one room in order of event id."""
    out = []
    for e in rows.sort_values("event_id").to_dict("records"):
        state, ok = step(state, e)
        out.append((e["room"], e["event_id"], e["action"], ok, state["status"], len(state["taken"]) + 1, float(state["deadline"])))
    return pd.DataFrame(out, columns=["room", "event_id", "action", "accepted", "status", "next_pick", "deadline"]), state


def rooms_batch(events: DataFrame) -> DataFrame:
    """All rooms of a finished log; a room's log is one draft, hundreds of actions."""
    return events.groupBy("room").applyInPandas(lambda p: replay(p, dict(START))[0], OUT)


def rooms_stream(events: DataFrame, idle_ms: int | None = 3_600_000) -> DataFrame:
    """The same over a stream: state by room, dropped after an hour without actions.

    A timeout keeps a stream running for good; without one (None) a stream of what is available ends.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = dict(START) if not state.exists else {"status": state.get[0], "taken": [int(x) for x in state.get[1].split(",") if x], "deadline": state.get[2]}
        rows = pd.concat(list(parts))
        out, s = replay(rows, s)
        state.update((s["status"], ",".join(map(str, s["taken"])), float(s["deadline"])))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield out

    kind = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy("room").applyInPandasWithState(run, OUT, "status string, taken string, deadline double", "append", kind)
