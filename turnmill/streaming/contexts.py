"""The last utterances of conversations in a stream, kept as state that ends with the conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from turnmill.session import ship

CONTEXT = "conv string, turn bigint, context array<string>"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Contexts(StatefulProcessor):
    """Rows (conv, turn, text, ts) of a conversation in any order.

    A turn goes out with its context when all turns before it have come; one that is early waits in a map. A turn that comes again is passed over. When the watermark has passed the last row's time by
    `keep_ms`, what still waits goes out in order, gaps left open, and the conversation's state is cleared; so state holds only conversations that are going on.
    """

    def __init__(self, turns: int, end: str, keep_ms: int):
        self.keep, self.end, self.keep_ms = turns - 1, end, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getValueState("past", "next bigint, held array<string>, last bigint")
        self.early = handle.getMapState("early", "turn bigint", "text string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, held, last = self.past.get() if self.past.exists() else (0, [self.end] * self.keep, -1)
        held, out, timer = list(held), [], last
        for part in rows:
            for turn, text, ts in zip(part["turn"], part["text"], part["ts"], strict=True):
                last = max(last, int(pd.Timestamp(ts).value // 1_000_000))
                if turn >= due and not self.early.containsKey((int(turn),)):
                    self.early.updateValue((int(turn),), (text or "",))
        while self.early.containsKey((due,)):
            held = [*held, self.early.getValue((due,))[0]][-self.keep :]
            self.early.removeKey((due,))
            out.append((key[0], due, list(held)))
            due += 1
        self.past.update((due, held, last))
        if last != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer + self.keep_ms)
            self.handle.registerTimer(last + self.keep_ms)
        yield pd.DataFrame(out, columns=["conv", "turn", "context"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, held, _ = self.past.get()
        held, out = list(held), []
        for (turn,), (text,) in sorted(self.early.iterator()):
            held = [*held, text][-self.keep :]
            out.append((key[0], turn, list(held)))
        self.past.clear()
        self.early.clear()
        yield pd.DataFrame(out, columns=["conv", "turn", "context"])

    def close(self) -> None:
        pass


def chat_contexts(rows: DataFrame, turns: int, *, late: str = "10 minutes", keep_ms: int = 3_600_000, end: str = "</S>") -> DataFrame:
    """(conv, turn, context) from a stream (conv string, turn bigint, text string, ts timestamp): the last `turns` - 1 utterances up to and with each one, padded in front with the end mark.

    Turns count from 0. A conversation is over when the watermark, `late` behind the latest row, is keep_ms past its last row; rows after that begin a new one. Rows behind the watermark, which begins at 1970, are
    dropped as late.
    """
    ship(rows.sparkSession)
    return rows.withWatermark("ts", late).groupBy("conv").transformWithStateInPandas(Contexts(turns, end, keep_ms), CONTEXT, "append", "EventTime")


def started(contexts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append contexts to a Parquet table until the source is at its end; the state lies in RocksDB, which keyed timers need."""
    spark = contexts.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return contexts.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)
