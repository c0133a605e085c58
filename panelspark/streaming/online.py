"""Point-in-time streams: sessions of availability, resumable batches, models that are updated row by row.

Availability follows the calendar as in batch (operators.joins): the static side
is a table of days, so the stream meets it by equality. Batches written by
sources.batches are a stream with offsets of their own; a sink keyed by the
micro-batch's id takes a replayed one as written. Model state is typed, and a key
without news for long is dropped.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.joins import lookup
from ..sources import batches as B

# ---------------------------------------------------------------- availability


def session_days(calendar: DataFrame) -> DataFrame:
    """day, is_session, next_session (strictly after) of every day from the first session to the last."""
    days = calendar.select("trade_date").distinct()
    span = days.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b")).where("a is not null")
    every = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    met = every.join(days.select(F.col("trade_date").alias("day"), F.lit(True).alias("is_session")), "day", "left")
    after = Window.orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    return met.select("day", F.coalesce("is_session", F.lit(False)).alias("is_session"), F.min(F.when(F.col("is_session"), F.col("day"))).over(after).alias("next_session"))


def available_sessions(events: DataFrame, calendar: DataFrame, late: str | None = None, cutoff: str = "15:00:00") -> DataFrame:
    """events (publish_time, publish_date) with available_date and available_time; streams and tables alike.

    The day itself if published by the cut-off on a session, else the next
    session, from its start on; without a time the publish date. Before the first
    session that one counts; after the last it is null. late: the watermark, on
    the derived time.
    """
    first = calendar.agg(F.min("trade_date")).first()[0]
    e = events.join(lookup(session_days(calendar)), F.col("publish_date") == F.col("day"), "left")
    in_time = F.coalesce(F.col("is_session"), F.lit(False)) & (F.date_format("publish_time", "HH:mm:ss") <= cutoff)
    following = F.when(F.col("publish_date") < F.lit(first), F.lit(first)).otherwise(F.col("next_session"))
    e = e.withColumn("available_date", F.when(F.col("publish_time").isNull() | in_time, F.col("publish_date")).otherwise(following))
    same = in_time & F.col("publish_time").isNotNull()
    e = e.withColumn("available_time", F.when(same, F.col("publish_time")).otherwise(F.col("available_date")).cast("timestamp")).drop("day", "is_session", "next_session")
    return e if late is None else e.withWatermark("available_time", late)


# ---------------------------------------------------------------- batches as a stream


class _Batches(DataSourceStreamReader):
    """Offsets: the name of the last batch that was read, and how many there are up to it. Names must ascend in time."""

    def __init__(self, options: dict) -> None:
        self.folder, self.table = options["folder"].rstrip("/"), options["table"]

    def _ready(self) -> list[str]:
        """Batches whose manifest lists the table, by name."""
        fs, path = pyarrow.fs.FileSystem.from_uri(self.folder)
        found = [i.base_name for i in fs.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True)) if i.type == pyarrow.fs.FileType.Directory]
        return sorted(n for n in found if self.table in (B.read_manifest(f"{self.folder}/{n}") or {"tables": {}})["tables"])

    def initialOffset(self) -> dict:
        return {"last": "", "count": 0}

    def latestOffset(self) -> dict:
        ready = self._ready()
        return {"last": ready[-1], "count": len(ready)} if ready else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        ready = self._ready()
        for offset in (start, end):
            if sum(n <= offset["last"] for n in ready) != offset["count"]:
                raise ValueError(f"batches up to {offset['last']} changed: {offset['count']} were there; names must ascend in time")
        out = []
        for n in ready:
            if start["last"] < n <= end["last"]:
                entry = B.read_manifest(f"{self.folder}/{n}")["tables"][self.table]
                out += [InputPartition((n, f"{self.folder}/{n}/{f}")) for f in entry["files"]]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        name, file = partition.value
        fs, path = pyarrow.fs.FileSystem.from_uri(file)
        with fs.open_input_file(path) as f:
            for b in pq.ParquetFile(f).iter_batches():
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([name] * b.num_rows)], names=[*b.schema.names, "batch_id"])


class BatchStream(DataSource):
    """spark.readStream.format('batch_stream').schema(...).option('folder', ...).option('table', ...): rows of batches in the folder as they are committed, with batch_id last."""

    @classmethod
    def name(cls) -> str:
        return "batch_stream"

    def schema(self) -> str:
        raise ValueError("give the table's schema, with batch_id string last")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Batches(dict(self.options))


class _Epochs(DataSourceStreamArrowWriter):
    """Each micro-batch is a table 'epoch-<id>' of one append-only batch: one that is there already is left as it is."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.one = B._Writer({"folder": options["folder"], "table": "epoch"}, schema)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> B.Written:
        return self.one.write(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        if B.read_manifest(self.one.folder) is None:
            B.begin(self.one.folder, {"provider": "stream", "start_date": None, "end_date": None, "symbols": []}, resume=True)
        self.one.table = f"epoch-{batchId:09d}"
        if self.one.table in B.read_manifest(self.one.folder)["tables"]:
            self.one.abort(messages)
        else:
            self.one.commit(messages)

    def abort(self, messages: list, batchId: int) -> None:
        self.one.abort(messages)


class EpochSink(DataSource):
    """writeStream.format('epoch_sink').option('folder', ...): idempotent by the micro-batch's id."""

    @classmethod
    def name(cls) -> str:
        return "epoch_sink"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        if overwrite:
            raise ValueError("the sink is only added to")
        return _Epochs(dict(self.options), schema)


def batch_stream(spark: SparkSession, folder: str, table: str, schema: StructType) -> DataFrame:
    spark.dataSource.register(BatchStream)
    return spark.readStream.format("batch_stream").schema(schema.add("batch_id", "string") if "batch_id" not in schema.names else schema).option("folder", folder).option("table", table).load()


def epochs(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """What an epoch_sink holds, by its manifest."""
    manifest = B.read_manifest(folder) or {"tables": {}}
    files = [f"{folder.rstrip('/')}/{f}" for t in manifest["tables"].values() for f in t["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


# ---------------------------------------------------------------- models

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "series string, at timestamp, value double, forecast double, variance double, observations bigint, accepted boolean"


class LocalLevel(StatefulProcessor):
    """A local level for each series: rows later than the last one update it, others are refused.

    A key is dropped `idle_ms` of event time after its last row; a row later than
    that starts anew, whether or not the key is gone already.
    """

    def __init__(self, q: float, r: float, idle_ms: int) -> None:
        self.q, self.r, self.idle_ms = q, r, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("level", "level double, variance double, n bigint, at_us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        level, variance, n, last = self.state.get() if self.state.exists() else (None, 10 * self.r, 0, None)
        before, out = last, []
        whole = pd.concat(list(rows)).sort_values(["at", "value"])
        for at, x in whole[["at", "value"]].itertuples(index=False):
            us = int(pd.Timestamp(at).value // 1_000)
            ok = x == x and x is not None and (last is None or us > last)
            if ok:
                if last is not None and us - last > 1_000 * self.idle_ms:  # the timer may not have fired yet
                    level, variance, n = None, 10 * self.r, 0
                prior = variance + self.q
                gain = prior / (prior + self.r)
                level = float(x) if level is None else level
                level, variance, n, last = level + gain * (x - level), (1 - gain) * prior, n + 1, us
            out.append((key[0], at, x, level, None if level is None else variance + self.q + self.r, n, ok))
        if last is not None and last != before:
            self.state.update((level, variance, n, last))
            if before is not None:
                self.handle.deleteTimer(before // 1_000 + self.idle_ms)
            self.handle.registerTimer(last // 1_000 + self.idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def online_levels(values: DataFrame, late: str = "1 day", idle_days: int = 400, q: float = 0.001, r: float = 0.01) -> DataFrame:
    """OUT of a stream (series, at, value): after each accepted row the forecast of the next value and its variance.

    Rows behind the watermark (`late`) or not later than their series' last one
    don't change the model; null values are refused. State lives in RocksDB: the
    session must name that provider, as the default one has no timers.
    """
    spark = values.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    rows = values.select("series", F.col("at").cast("timestamp").alias("at"), F.col("value").cast("double").alias("value")).withWatermark("at", late)
    return rows.groupBy("series").transformWithStateInPandas(LocalLevel(q, r, idle_days * 86_400_000), OUT, "Append", "EventTime")
