"""Items that expire unless they are renewed, as state with timers.

Every key has one item in Spark's state store: when it was first and last noted, how often, and when it expires. A timer of event
time stands at that moment; a renewal moves both. When the watermark passes the timer the item comes out and its state is
gone, so state holds what is alive and no more. An item that is promoted never expires, one that is forgotten goes at once.

Results do not hang on how rows fall into batches: an item that lies still for longer than its life within one batch comes
out too, and a later note begins a new one. Rows of a key are taken in the order of their time, then note before renew, promote and forget.
Defined cases: null keys, times and actions are dropped, and so are rows later than the watermark allows; a renewal of what is not
there is a note; promoting or forgetting it does nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marlstone.streaming.tables import drain

ACTIONS = ("note", "renew", "promote", "forget")
STATE = T.StructType([T.StructField(n, T.LongType()) for n in ("first", "last", "n", "expires")])
Ended = Row("key", "first", "last", "n", "ended", "reason")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Expiry(StatefulProcessor):
    """Times are microseconds; expires is null for what is kept for good."""

    def __init__(self, life: int):
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", STATE)

    def _timer(self, micros: int) -> int:
        return -(-micros // 1000)  # timers are milliseconds: never before the item's time

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.item.get() if self.item.exists() else None
        now = tuple(before) if before else None
        for at, action in sorted((r.at, ACTIONS.index(r.action)) for r in rows):
            if now and now[3] is not None and at >= now[3]:
                yield Ended(key[0], *now, "expired")
                now = None
            match ACTIONS[action]:
                case "note" | "renew":
                    kept = now is not None and now[3] is None
                    now = (now[0] if now else at, at, (now[2] if now else 0) + 1, None if kept else at + self.life)
                case "promote" if now:
                    now = (now[0], now[1], now[2], None)
                case "forget" if now:
                    yield Ended(key[0], *now[:3], at, "forgotten")
                    now = None
        if before and before[3] is not None:
            self.handle.deleteTimer(self._timer(before[3]))
        if now is None:
            self.item.clear()
        else:
            self.item.update(now)
            if now[3] is not None:
                self.handle.registerTimer(self._timer(now[3]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.item.exists():
            first, last, n, expires = self.item.get()
            if expires is not None and self._timer(expires) <= expiredTimerInfo.getExpiryTimeInMs():
                self.item.clear()
                yield Ended(key[0], first, last, n, expires, "expired")

    def close(self) -> None:
        pass


def expired(events: DataFrame, life_seconds: int, late: str, folder: str) -> DataFrame:
    """(key, first_at, last_at, n, ended_at, reason) of items that ended, of a stream (key long, ts timestamp, action). The
    checkpoint stands in the folder: a later call goes on with the items that were alive."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.where(F.col("key").isNotNull() & F.col("ts").isNotNull() & F.col("action").isin(*ACTIONS)).withWatermark("ts", late)
    out = T.StructType([T.StructField("key", T.LongType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ended", T.LongType()), T.StructField("reason", T.StringType())])
    ended = rows.select(F.col("key").cast("long").alias("key"), "ts", F.unix_micros("ts").alias("at"), "action").groupBy("key").transformWithState(Expiry(life_seconds * 1_000_000), out, "Append", "EventTime")
    time = lambda c: F.timestamp_micros(F.col(c))
    return drain(ended.select("key", time("first").alias("first_at"), time("last").alias("last_at"), "n", time("ended").alias("ended_at"), "reason"), folder)
