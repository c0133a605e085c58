"""Bars from several suppliers in order of trust, as a planned data source.

A partition is a chunk of securities with the ordered list of suppliers. A
supplier that fails is tried again, then the next one is asked; after BREAK_AFTER
securities in a row that it could not be reached for, a supplier is left out for
the rest of the partition (the breaker is open). Rows carry who gave them, in one
unit: shares and money. A security that no supplier has gives one row with status
'failed' and why, so that nothing is lost silently and only failures are asked
for again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .providers import DIALECTS, with_retries

BREAK_AFTER = 3
ROW = "trade_date date, ts_code string, open double, high double, low double, close double, volume double, amount double, supplier string, status string, attempts int, detail string"
_NUMBERS = ("open", "high", "low", "close", "volume", "amount")


@dataclass(frozen=True)
class Supplier:
    """fetch(code, start, end) -> rows in the supplier's words; OSError means that it could not be reached.

    lot: shares in a unit of its volume. renamed: its own words for columns, before
    the usual dialects. delisted: whether it serves securities that are no longer
    listed. tries: calls for a security.
    """

    name: str
    fetch: Callable[[str, str, str], list[dict]]
    lot: float = 1.0
    renamed: dict[str, str] = field(default_factory=dict)
    delisted: bool = True
    tries: int = 2
    wait_s: float = 0.0

    def bars(self, code: str, start: str, end: str) -> list[dict]:
        """Standard rows; a column that the supplier doesn't have stays null."""
        raw = with_retries(self.fetch, code, start, end, tries=self.tries, wait_s=self.wait_s)
        if not raw:
            raise LookupError("no rows")
        own = {standard: theirs for theirs, standard in self.renamed.items()}
        taken = set(self.renamed)
        out = []
        for r in raw:
            row = {c: _value(r, own.get(c), [d for d in DIALECTS[c] if d not in taken]) for c in ("trade_date", *_NUMBERS)}
            row |= {c: None if row[c] is None else float(row[c]) for c in _NUMBERS}
            row["volume"] = None if row["volume"] is None else row["volume"] * self.lot
            row["trade_date"] = row["trade_date"] if isinstance(row["trade_date"], dt.date) else dt.date.fromisoformat(str(row["trade_date"])[:10])
            out.append(row)
        return out


def _value(row: dict, own: str | None, dialects: Iterable[str]):
    """A column by the supplier's own word, else by the first dialect that the row has; empty counts as missing."""
    for name in ([own] if own else list(dialects)):
        if row.get(name) not in (None, ""):
            return row[name]
    return None


class Breaker:
    """Failures in a row by supplier; open from BREAK_AFTER on."""

    def __init__(self) -> None:
        self.row: dict[str, int] = {}

    def open(self, name: str) -> bool:
        return self.row.get(name, 0) >= BREAK_AFTER

    def note(self, name: str, reached: bool) -> None:
        self.row[name] = 0 if reached else self.row.get(name, 0) + 1


def acquire(code: str, gone: bool, suppliers: list[Supplier], breaker: Breaker, start: str, end: str) -> Iterator[tuple]:
    """Rows of one security from the first supplier that has them."""
    why, asked = [], 0
    for s in suppliers:
        if gone and not s.delisted:
            why.append(f"{s.name}: serves listed ones only")
            continue
        if breaker.open(s.name):
            why.append(f"{s.name}: left out after {BREAK_AFTER} failures in a row")
            continue
        asked += 1
        try:
            rows = s.bars(code, start, end)
        except OSError as e:
            breaker.note(s.name, reached=False)
            why.append(f"{s.name}: {type(e).__name__}: {e}")
            continue
        except (LookupError, ValueError) as e:  # it answered, but with nothing of use
            breaker.note(s.name, reached=True)
            why.append(f"{s.name}: {type(e).__name__}: {e}")
            continue
        breaker.note(s.name, reached=True)
        for r in sorted(rows, key=lambda r: r["trade_date"]):
            yield (r["trade_date"], code, *(r[c] for c in _NUMBERS), s.name, "ok", asked, "; ".join(why))
        return
    yield (None, code, *[None] * len(_NUMBERS), None, "failed", asked, "; ".join(why))


def source(suppliers: list[Supplier]) -> type[DataSource]:
    """A data source 'acquired_bars' over these suppliers; options: codes, delisted (comma-separated), start, end, chunk."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            split = lambda c: [x for x in options.get(c, "").split(",") if x]
            self.codes, self.gone = list(dict.fromkeys(split("codes"))), set(split("delisted"))
            self.start, self.end, self.chunk = options["start"], options["end"], int(options.get("chunk", 100))

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(self.codes[i : i + self.chunk]) for i in range(0, len(self.codes), self.chunk)] or [InputPartition([])]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            breaker = Breaker()
            for code in partition.value:
                yield from acquire(code, code in self.gone, suppliers, breaker, self.start, self.end)

    class AcquiredBars(DataSource):
        @classmethod
        def name(cls) -> str:
            return "acquired_bars"

        def schema(self) -> str:
            return ROW

        def reader(self, schema) -> DataSourceReader:
            return Reader(dict(self.options))

    return AcquiredBars


def acquired(spark: SparkSession, suppliers: list[Supplier], codes: list[str], start: str, end: str, delisted: list[str] = (), chunk: int = 100) -> DataFrame:
    """ROW of all codes. Write it to a batch once and read it from there: each evaluation asks the suppliers."""
    spark.dataSource.register(source(suppliers))
    return spark.read.format("acquired_bars").option("codes", ",".join(codes)).option("delisted", ",".join(delisted)).option("start", start).option("end", end).option("chunk", str(chunk)).load()


def still_wanted(acquired_so_far: DataFrame, codes: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Codes (ts_code) that have no rows yet; those that failed only if they are to be tried again."""
    done = acquired_so_far if not retry_failed else acquired_so_far.where("status = 'ok'")
    return codes.join(done.select("ts_code").distinct(), "ts_code", "left_anti")


def acquisition_report(bars: DataFrame) -> DataFrame:
    """ts_code, supplier, status, rows, first_date, last_date, volume_only: what was got, and whether money amounts are missing throughout."""
    g = bars.groupBy("ts_code", "supplier", "status").agg(F.count("trade_date").alias("rows"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), F.count("amount").alias("amounts"), F.first("detail").alias("detail"))
    return g.withColumn("volume_only", (F.col("status") == "ok") & (F.col("amounts") == 0)).drop("amounts")
