"""Streams: the running state of a job, and requests that a newer one replaces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.readwriter import DataStreamWriter

from inkgrid.plans.journal import latest_state
from inkgrid.schema import PROGRESS

REQUESTS = "key string, ts timestamp, id long, delay_s double"
#: Later than any request (and within what pandas counts in nanoseconds): when the input has ended, the watermark goes there.
END = "2262-01-01 00:00:00"


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The journal's folder as a stream: a JSON record a file."""
    return spark.readStream.schema(PROGRESS).json(path)


def stream_batch_state(progress: DataFrame) -> DataFrame:
    """The latest state of each variant, for output mode update or complete. The sequence number decides, not the time of arrival, so late and
    disordered records do no harm; the state is one row for each variant."""
    return latest_state(progress)


def write_upserts(state: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of a stream's state by key. A batch adds the rows that it changed, whole, as a folder of its own (written anew if the batch is repeated); nothing else is touched.

    Of two rows of a key the later batch's is right: it was made of all records up to then, in the order of their sequence numbers.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def read_upserts(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """The newest row of each key of what write_upserts() has written so far."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("row")).select(key, *(F.col("row")[c].alias(c) for c in columns))


def fold_upserts(spark: SparkSession, path: str, to: str, key: str = "id") -> None:
    """Writes one row for each key, as batch -1 of a new folder: what readers need once many batches have come together. The stream goes on in a folder of its own."""
    read_upserts(spark, path, key).write.parquet(f"{to}/batch=-1")


def debounce(requests: DataFrame) -> DataFrame:
    """requests: (key, ts, id, delay_s). (key, id, fires_at): those that have no newer request of their key within their own delay."""
    w = Window.partitionBy("key").orderBy("ts", "id")
    fires = F.col("ts") + F.make_dt_interval(secs=F.col("delay_s"))
    return requests.withColumn("next", F.lead("ts").over(w)).withColumn("fires_at", fires).where("next is null or next >= fires_at").select("key", "id", "fires_at")


class _Waiting(StatefulProcessor):
    """The requests of a key that wait for their time, in one value, and a timer for the earliest: a batch asks the state store a few times for a key, however many of its requests wait. A request replaced by a newer one
    leaves at once, so what is held of a key never lies closer than its delays."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.waiting = handle, handle.getValueState("waiting", "rows binary")

    def _held(self) -> np.ndarray:
        """(at, id, fires) of what waits."""
        found = self.waiting.get()
        return np.frombuffer(bytes(found[0]) if found else b"", np.int64).reshape(-1, 3)

    def _hold(self, rows: np.ndarray) -> None:
        """These wait now."""
        if not len(rows):
            return self.waiting.clear()
        self.waiting.update((np.ascontiguousarray(rows).tobytes(),))
        self.handle.registerTimer(-(-int(rows[:, 2].min()) // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [part.loc[part["real"].to_numpy(bool), ["at", "id", "fires"]].to_numpy(np.int64) for part in rows]
        if not sum(map(len, new)):
            return iter(())
        every = np.concatenate([self._held(), *new])[::-1]  # of those that are repeated the newest counts
        _, first = np.unique(every[:, :2], axis=0, return_index=True)  # in the order of at and id
        every = every[first]
        replaced = every[1:, 0] < every[:-1, 2]
        self._hold(every[np.append(~replaced, True)])
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        due = -(-held[:, 2] // 1000) <= max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        if len(held):
            self._hold(held[~due])  # its earliest gets the next timer, also where this one was that of a request that was replaced
        if due.any():
            yield pd.DataFrame({"key": np.array([key[0]] * int(due.sum()), object), "id": held[due, 1], "fires": held[due, 2]})

    def close(self) -> None:
        pass


def stateful(spark: SparkSession) -> SparkSession:
    """A session like the given one, with the state store that timers and maps need. The given session stays as it is."""
    new = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and new.conf.isModifiable(k):
            new.conf.set(k, v)
    new.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return new


def stream_debounce(requests: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """debounce() of a stream (of a stateful() session), in append mode. Each request that isn't replaced fires when the watermark passes its time, by a timer; requests may be as late as the watermark allows.

    After the last request, with_end() moves the watermark past all of them, so that none is left. Requests without id, time or delay are left out, and a request that is repeated counts once.
    """
    fires = F.unix_micros(F.col("ts") + F.make_dt_interval(secs=F.col("delay_s")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    # not a filter: the optimizer would move it below the watermark, where a mark of the end would no longer count
    r = requests.withWatermark("ts", watermark).select("key", "ts", zero(F.col("id")).alias("id"), zero(F.unix_micros("ts")).alias("at"), zero(fires).alias("fires"), (F.col("id").isNotNull() & fires.isNotNull()).alias("real"))
    out = r.groupBy("key").transformWithStateInPandas(_Waiting(), "key string, id long, fires long", "append", "eventTime")
    return out.select("key", "id", F.timestamp_micros("fires").alias("fires_at"))


def with_end(requests: DataFrame, path: str) -> DataFrame:
    """A stream of requests that end() can close: a mark in the folder `path` only moves the watermark."""
    spark = requests.sparkSession
    return requests.select(*(c.split()[0] for c in REQUESTS.split(", "))).unionByName(spark.readStream.schema(REQUESTS).option("recursiveFileLookup", "true").parquet(path))


def begin(spark: SparkSession, path: str) -> None:
    """Makes the folder for the mark, for with_end()."""
    spark.createDataFrame([], REQUESTS).write.mode("ignore").parquet(f"{path}/none")


def end(spark: SparkSession, path: str) -> None:
    """Says that no more requests come."""
    spark.createDataFrame([(None, None, 1.0)], "key string, id long, delay_s double").selectExpr("key", f"timestamp'{END}' AS ts", "id", "delay_s").coalesce(1).write.parquet(f"{path}/end")
