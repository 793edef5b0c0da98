"""Partial outputs to finished ones: the parts of a request, in any order and more than once, to one row.

A generator sends what it makes in parts, (request, part, ids, finished, at): part counts from 0, finished marks the
last. State by request holds the parts that have come. A request is given out once all parts up to the last are there,
with its ids in the order of the parts. It is given up, with the parts that follow one another from 0, once
the watermark is `patience` past its latest part. What comes for a request that was given out or up is dropped until the
watermark is `memory` past the end of it; then it is forgotten.

Parts of one number count once, the first that is seen; a part behind the marked last does not count. State takes part
in checkpoints, so a restart neither loses nor repeats a part. It needs the state store of RocksDB.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from auralake.config import ship

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPEN, DONE, ABANDONED = 0, 1, 2
REASONS = {DONE: "finished", ABANDONED: "abandoned"}


def with_state(spark: SparkSession) -> SparkSession:
    """The session, with the state store that these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class Gather(StatefulProcessor):
    """Parts of one request; at is the event time, in milliseconds."""

    def __init__(self, patience: int, memory: int):
        self.patience, self.memory = patience, memory

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", T.StructType().add("part", "integer"), T.StructType().add("ids", T.ArrayType(T.IntegerType())))
        # Number of the last part (-1: not known), parts that have come, latest time, and how it stands.
        self.about = handle.getValueState("about", T.StructType().add("last", "integer").add("held", "integer").add("latest", "long").add("state", "integer"))

    def _end(self, key: tuple, state: int, last: int, now: int) -> Iterator[Row]:
        ids, n = [], 0
        while (last < 0 or n <= last) and self.parts.containsKey((n,)):
            ids += self.parts.getValue((n,))[0]
            n += 1
        self.parts.clear()
        self._set_timer(now + self.memory)
        self.about.update((last, n, now, state))
        yield Row(request=key[0], ids=ids, parts=n, reason=REASONS[state])

    def _set_timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, held, latest, state = self.about.get() if self.about.exists() else (-1, 0, 0, OPEN)
        if state != OPEN:
            for _ in rows:
                pass
            return
        for r in rows:
            latest = max(latest, int(r.at.timestamp() * 1000))
            if r.part is None or r.part < 0 or self.parts.containsKey((r.part,)):
                continue
            self.parts.updateValue((r.part,), (list(r.ids or []),))
            held += 1
            if r.finished and (last < 0 or r.part < last):
                last = r.part
        if last >= 0 and all(self.parts.containsKey((n,)) for n in range(last, -1, -1)):
            yield from self._end(key, DONE, last, latest)
            return
        self.about.update((last, held, latest, OPEN))
        self._set_timer(latest + self.patience)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.about.exists():
            return
        last, _, _, state = self.about.get()
        if state == OPEN:
            yield from self._end(key, ABANDONED, last, int(expiredTimerInfo.getExpiryTimeInMs()))
        else:
            self.about.clear()

    def close(self) -> None:
        pass


def finished_outputs(parts: DataFrame, patience: str = "10 minutes", memory: str = "1 hour", late: str = "1 minute") -> DataFrame:
    """request, ids, parts and reason (finished or abandoned) of a stream of parts (request, part, ids, finished, at)."""
    spark = with_state(parts.sparkSession)
    ship(spark)
    ms = [spark.sql(f"SELECT unix_millis(timestamp '1970-01-01 00:00:00Z' + INTERVAL {x})").first()[0] for x in (patience, memory)]
    kind = parts.schema["request"].dataType
    out = T.StructType().add("request", kind).add("ids", T.ArrayType(T.IntegerType())).add("parts", "integer").add("reason", "string")
    rows = parts.selectExpr("request", "cast(part AS int) part", "cast(ids AS array<int>) ids", "coalesce(finished, false) finished", "cast(at AS timestamp) at").where("at IS NOT NULL")
    return rows.withWatermark("at", late).groupBy("request").transformWithState(Gather(*ms), out, "Append", "EventTime")
