"""Market-data providers as Python data sources: a vendor's rows become standard columns, with retries.

A provider is given a `fetch` callable (method, arguments) -> list of dicts, so
nothing here needs a network; the recorded one replays rows from a JSON file.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalar import first_column, normalize_code
from .schema import conform

# Column names of the vendor's dialects by standard column.
DIALECTS = {
    "trade_date": ("日期", "date", "trade_date"),
    "open": ("开盘", "open"),
    "high": ("最高", "high"),
    "low": ("最低", "low"),
    "close": ("收盘", "close"),
    "volume": ("成交量", "volume"),
    "amount": ("成交额", "amount"),
    "ts_code": ("代码", "股票代码", "code", "symbol", "ts_code"),
    "name": ("名称", "股票简称", "name"),
}


class Provider(Protocol):
    def load_bars(self, spark: SparkSession, code: str, start: str, end: str) -> DataFrame: ...
    def load_index(self, spark: SparkSession, code: str, start: str, end: str) -> DataFrame: ...


def with_retries(call: Callable, *args, tries: int = 3, wait_s: float = 0.25):
    """The call's result; failures wait longer each time, the last is raised."""
    for k in range(tries):
        try:
            return call(*args)
        except OSError:
            if k == tries - 1:
                raise
            time.sleep(wait_s * (k + 1))


class VendorProvider:
    """Calendar, securities, bars and index closes; other tables aren't offered."""

    OFFERED = ("trade_calendar", "stock_basic", "daily_bar", "benchmark_index")

    def __init__(self, fetch: Callable[..., list[dict]], tries: int = 3, wait_s: float = 0.25) -> None:
        self.fetch, self.tries, self.wait_s = fetch, tries, wait_s

    def _rows(self, spark: SparkSession, *what) -> DataFrame:
        rows = with_retries(self.fetch, *what, tries=self.tries, wait_s=self.wait_s)
        df = spark.createDataFrame([{k: None if v is None else str(v) for k, v in r.items()} for r in rows])
        for name, dialects in DIALECTS.items():
            if any(d in df.columns for d in dialects):
                df = first_column(df, dialects, name)
        return df

    def load_bars(self, spark: SparkSession, code: str, start: str, end: str) -> DataFrame:
        """Unadjusted bars; the adjustment factor is a marked placeholder."""
        df = self._rows(spark, "bars", code, start, end).withColumn("ts_code", normalize_code(F.lit(code)))
        return conform(df.withColumns({"adj_factor": F.lit(1.0), "price_adjustment": F.lit("unadjusted_placeholder_factor")}), "daily_bar")

    def load_index(self, spark: SparkSession, code: str, start: str, end: str) -> DataFrame:
        return conform(self._rows(spark, "index", code, start, end).withColumn("index_code", F.lit(code)), "benchmark_index")

    def load(self, name: str):
        if name not in self.OFFERED:
            raise NotImplementedError(f"{name} isn't offered by this provider")


def recorded(path: str) -> Callable[..., list[dict]]:
    """A fetch that replays a JSON file: method -> rows."""
    def fetch(method: str, *_) -> list[dict]:
        with open(path, encoding="utf-8") as f:
            return json.load(f)[method]

    return fetch


class RecordedBars(DataSource):
    """spark.read.format('recorded_bars').option('path', ...): one partition for each recorded method."""

    @classmethod
    def name(cls) -> str:
        return "recorded_bars"

    def schema(self) -> str:
        return "method string, row string"

    def reader(self, schema) -> DataSourceReader:
        return _RecordedReader(self.options["path"])


class _RecordedReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        with open(self.path, encoding="utf-8") as f:
            return [InputPartition(k) for k in sorted(json.load(f))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(self.path, encoding="utf-8") as f:
            for row in json.load(f)[partition.value]:
                yield partition.value, json.dumps(row, ensure_ascii=False)
