"""Contracts of the twelve standard tables as Spark types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import require_columns

_TYPES = {"DATE": "date", "STR": "string", "NUM": "double", "INT": "bigint", "BOOL": "boolean", "TS": "timestamp_ntz"}


@dataclass(frozen=True)
class Contract:
    name: str
    key: tuple[str, ...]
    required: tuple[str, ...]
    types: tuple[tuple[str, str], ...]

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(", ".join(f"{n} {t}" for n, t in self.types))

    @property
    def dates(self) -> tuple[str, ...]:
        return tuple(n for n, t in self.types if t == "date")


def _contract(name: str, key: str, required: str, optional: str = "") -> Contract:
    """Columns as 'name:TYPE', the key's among the required ones."""
    parse = lambda text: [tuple(x.split(":")) for x in text.split()]
    must, may = parse(required), parse(optional)
    return Contract(name, tuple(key.split()), tuple(n for n, _ in must), tuple((n, _TYPES[t]) for n, t in must + may))


CONTRACTS = {
    c.name: c
    for c in (
        _contract("trade_calendar", "trade_date", "trade_date:DATE is_open:BOOL"),
        _contract("stock_basic", "ts_code", "ts_code:STR name:STR list_date:DATE delist_date:DATE exchange:STR"),
        _contract("daily_bar", "trade_date ts_code", "trade_date:DATE ts_code:STR open:NUM high:NUM low:NUM close:NUM volume:INT amount:NUM adj_factor:NUM", "is_suspended:BOOL is_st:BOOL up_limit:NUM down_limit:NUM price_adjustment:STR"),
        _contract("daily_basic", "trade_date ts_code", "trade_date:DATE ts_code:STR pe_ttm:NUM pb:NUM total_mv:NUM turnover_rate:NUM net_mf_amount:NUM", "ps:NUM large_order_net_mf_amount:NUM"),
        _contract("industry", "trade_date ts_code", "trade_date:DATE ts_code:STR industry_code:STR industry_name:STR"),
        _contract("index_member", "index_code ts_code in_date", "index_code:STR ts_code:STR weight:NUM in_date:DATE out_date:DATE"),
        _contract("financial_indicator", "ts_code report_period ann_date", "report_period:DATE ann_date:DATE usable_date:DATE ts_code:STR roe:NUM gross_margin:NUM debt_ratio:NUM revenue_yoy:NUM profit_yoy:NUM", "total_assets:NUM operating_revenue:NUM net_profit:NUM operating_cash_flow:NUM revision_date:DATE revision_id:INT source_id:STR"),
        _contract("suspension", "ts_code suspend_date", "ts_code:STR suspend_date:DATE resume_date:DATE"),
        _contract("st_status", "ts_code start_date", "ts_code:STR start_date:DATE end_date:DATE"),
        _contract("limit_price", "trade_date ts_code", "trade_date:DATE ts_code:STR up_limit:NUM down_limit:NUM"),
        _contract("benchmark_index", "trade_date index_code", "trade_date:DATE index_code:STR close:NUM"),
        _contract("news_event", "stock_code publish_date event_type", "stock_code:STR publish_date:DATE event_type:STR sentiment:STR impact_horizon:STR confidence:NUM reason:STR", "event_id:STR publish_time:TS"),
    )
}


def get_contract(name: str) -> Contract:
    if name not in CONTRACTS:
        raise KeyError(f"unknown table {name}; known: {', '.join(CONTRACTS)}")
    return CONTRACTS[name]


def key_of(name: str, df: DataFrame) -> list[str]:
    """The key, with the revision among financial rows that carry one."""
    own = list(get_contract(name).key)
    return own + ["revision_id"] if name == "financial_indicator" and "revision_id" in df.columns else own


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def assert_unique(df: DataFrame, key: list[str], table: str = "table") -> DataFrame:
    if found := duplicate_keys(df, key).limit(1).count():
        raise ValueError(f"{table}: key {key} isn't unique ({found}+ repeated)")
    return df


def conform(df: DataFrame, name: str) -> DataFrame:
    """Required columns checked, known columns cast, optional ones filled with typed NULL, NaN made NULL; others pass."""
    c = get_contract(name)
    require_columns(df, c.required, name)
    typed = dict(c.types)

    def cast(n: str):
        x = F.col(n).cast(typed[n])
        return F.when(~F.isnan(x), x) if typed[n] == "double" else x

    known = [(cast(n) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in c.types]
    return df.select(*known, *(F.col(x) for x in df.columns if x not in typed))


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], get_contract(name).schema)
