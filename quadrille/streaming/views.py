"""Camera moves as a stream: which of them show something new, and how many per window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "event_id BIGINT, user_id BIGINT, ts TIMESTAMP, builds BOOLEAN"


def changes(moves: DataFrame, *, forget_after: str = "1 hour") -> DataFrame:
    """moves: event_id, user_id, ts (with a watermark), view. Of each move, whether its view differs from the session's view before; the state of a session is its last view only, and goes when the session is silent for longer than `forget_after`."""
    silence = pd.Timedelta(forget_after)

    def gate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        before = rows["view"].shift(1)
        before.iloc[0] = last
        rows["builds"] = rows["view"] != before
        if last is None:
            rows.iloc[0, rows.columns.get_loc("builds")] = True
        state.update((int(rows["view"].iloc[-1]),))
        state.setTimeoutTimestamp(int((rows["ts"].max() + silence).timestamp() * 1000))
        yield rows[["event_id", "user_id", "ts", "builds"]]

    return moves.groupBy("user_id").applyInPandasWithState(gate, OUTPUT, "view BIGINT", "append", GroupStateTimeout.EventTimeTimeout)


def views_per_window(moves: DataFrame, window: str = "10 minutes") -> DataFrame:
    """start, view, moves: counts in tumbling windows; closed windows are written as the watermark passes them."""
    return moves.groupBy(F.window("ts", window).alias("w"), "view").agg(F.count("*").alias("moves")).select(F.col("w.start").alias("start"), "view", "moves")
