"""Streaming twin of the utterance ends: blocks of sound arrive by session; a session that falls silent is closed by its timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftline.operators.speech import ENDPOINT_STATE, HEARD, QUIET, Endpoint, frame


class Listener(StatefulProcessor):
    """Keeps a session's eight numbers between batches. idle_ms after its last block an open session is closed as lost."""

    def __init__(self, config: Endpoint, idle_ms: int | None):
        self.config, self.idle_ms = config, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("endpoint", ENDPOINT_STATE + ", last long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        *now, last, due = self.state.get() if self.state.exists() else (*QUIET, -1, -1)
        now, out = tuple(now), []
        for seq, rms, ms in pd.concat(list(rows)).sort_values("seq")[["seq", "rms", "ms"]].itertuples(index=False):
            now, told = frame(now, rms, ms, self.config)
            out.append((key[0], seq, *told))
            last = int(seq)
        if self.idle_ms is not None:
            if due >= 0:
                self.handle.deleteTimer(due)
            due = timers.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(due)
        self.state.update((*now, last, due))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in HEARD.split(", ")])

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:  # noqa: N802
        phase, _, held, spoken, *_, noise, _, last, _ = self.state.get()
        self.state.clear()
        if phase in ("speaking", "trailing"):
            yield pd.DataFrame([(key[0], last, "done", False, "lost", 0.0, held / 1000, max(noise, self.config.floor), spoken / 1000 >= self.config.least_s)], columns=[f.split()[0] for f in HEARD.split(", ")])

    def close(self) -> None:
        pass


def endpoints(blocks: DataFrame, config: Endpoint = Endpoint(), idle_ms: int | None = None) -> DataFrame:
    """HEARD of a stream of blocks (session_id, seq, rms, ms); the blocks of a batch are taken in order of seq. Needs the RocksDB state store."""
    rows = blocks.selectExpr("CAST(session_id AS long) AS session_id", "CAST(seq AS long) AS seq", "CAST(rms AS double) AS rms", "CAST(ms AS double) AS ms")
    return rows.groupBy("session_id").transformWithStateInPandas(Listener(config, idle_ms), HEARD, "Append", "None" if idle_ms is None else "ProcessingTime")
