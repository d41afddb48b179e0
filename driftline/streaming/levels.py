"""Streaming twin of the steady levels: proposals arrive in time, the state is three numbers a track."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from driftline.operators.rules import STEADY, steady


def hysteresis(proposals: DataFrame, needed: int = 2) -> DataFrame:
    """track_id, seq, proposed, level_rank of a stream with track_id, seq, proposed; rows of a batch are taken in order of seq.

    Rows that arrive in a later batch than one of a higher seq are taken as they come.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq", ignore_index=True)
        out = []
        for p in rows.proposed.tolist():
            now = steady(now, p, needed)
            out.append(now[0])
        state.update(now)
        yield rows[["track_id", "seq", "proposed"]].assign(level_rank=pd.array(out, "int32"))

    rows = proposals.selectExpr("cast(track_id AS long) AS track_id", "cast(seq AS long) AS seq", "cast(proposed AS int) AS proposed")
    return rows.groupBy("track_id").applyInPandasWithState(run, STEADY, "level int, pending int, count int", "append", GroupStateTimeout.NoTimeout)
