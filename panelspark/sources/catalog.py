"""Reading, importing and writing of standard tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite, normalize_code, normalize_dates
from .schema import CONTRACTS, assert_unique, conform, get_contract, key_of


def _path(spark: SparkSession, at: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, at: str) -> bool:
    fs, p = _path(spark, at)
    return fs.exists(p)


def read_any(spark: SparkSession, at: str, kind: str | None = None) -> DataFrame:
    """Parquet or CSV by ending or by `kind`."""
    kind = kind or ("parquet" if at.rstrip("/").endswith(".parquet") else "csv")
    if kind == "parquet":
        return spark.read.parquet(at)
    if kind == "csv":
        return spark.read.option("header", True).option("nullValue", "").csv(at)
    raise ValueError(f"unknown format {kind}")


def write_any(df: DataFrame, at: str, kind: str = "parquet", mode: str = "error", single: bool = False) -> None:
    out = (df.coalesce(1) if single else df).write.mode(mode)
    if kind == "parquet":
        out.parquet(at)
    elif kind == "csv":
        out.option("header", True).csv(at)
    else:
        raise ValueError(f"unknown format {kind}")


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table's Parquet if there is any, else its CSV; conformed to the contract."""
    get_contract(name)
    for kind in ("parquet", "csv"):
        at = f"{folder.rstrip('/')}/{name}.{kind}"
        if exists(spark, at):
            df = read_any(spark, at, kind)
            return conform(normalize_dates(df, get_contract(name).dates), name)
    raise FileNotFoundError(f"{name} in {folder}")


def load_all(spark: SparkSession, folder: str, views: bool = True) -> dict[str, DataFrame]:
    """Those of the standard tables that the folder has, as frames and as temporary views."""
    found = {}
    for name in CONTRACTS:
        if any(exists(spark, f"{folder.rstrip('/')}/{name}.{kind}") for kind in ("parquet", "csv")):
            found[name] = load_table(spark, folder, name)
            if views:
                found[name].createOrReplaceTempView(name)
    return found


def resolve_revisions(fin: DataFrame, strict: bool = False) -> DataFrame:
    """The last revision of each report; strict: revision columns must be there and complete."""
    need = ["revision_date", "revision_id", "source_id"]
    if strict:
        if missing := [c for c in need if c not in fin.columns]:
            raise ValueError(f"financial rows without {missing}")
        bad = fin.where(" or ".join(f"{c} is null" for c in need) + " or usable_date <= ann_date").limit(1).count()
        if bad:
            raise ValueError("financial rows with open revision fields or usable_date not after ann_date")
    order = [F.col(c).desc_nulls_last() for c in ("revision_date", "revision_id", "usable_date") if c in fin.columns]
    w = Window.partitionBy("ts_code", "report_period", "ann_date").orderBy(*order)
    return fin.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def import_tables(spark: SparkSession, source: str, target: str, mapping: Mapping[str, Mapping[str, str]], kind: str = "parquet", mode: str = "sample") -> dict:
    """Foreign tables renamed, typed, checked, sorted within files and written; returns the manifest. The target must be new."""
    if exists(spark, target):
        fs, p = _path(spark, target)
        if fs.listStatus(p):
            raise FileExistsError(target)
    tables = {}
    for name, renames in mapping.items():
        at = next((f"{source}/{name}.{k}" for k in ("parquet", "csv") if exists(spark, f"{source}/{name}.{k}")), None)
        if at is None:
            if mode == "real":
                raise FileNotFoundError(f"{name} in {source}")
            continue
        df = read_any(spark, at).withColumnsRenamed(dict(renames))
        df = conform(normalize_dates(df, get_contract(name).dates), name)
        if name == "financial_indicator" and mode == "real":
            df = resolve_revisions(df, strict=True)
        key = key_of(name, df)
        assert_unique(df, [k for k in key if k in df.columns], name)
        write_any(df.sortWithinPartitions(*key), f"{target}/{name}.{kind}", kind)
        tables[name] = {"format": kind, "rows": df.count(), "columns": df.columns, "primary_key": key, "sha256": content_hash(df)}
    return {"manifest_version": 2, "mode": mode, "source": source, "tables": tables, "data_version": hashlib.sha256(json.dumps(tables, sort_keys=True).encode()).hexdigest()}


def canonical(df: DataFrame) -> Column:
    """A row as text: columns by name, floats to ten significant digits, NULL told apart from text."""
    parts = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        c = F.col(f.name)
        text = F.format_string("%.9e", c + F.lit(0.0)) if f.dataType.typeName() in ("double", "float") else c.cast("string")
        parts.append(F.when(c.isNull(), "N").otherwise(F.concat(F.lit("V"), F.length(text), F.lit(":"), text)))
    return F.concat_ws("|", *parts)


def content_hash(df: DataFrame) -> str:
    """A fingerprint that depends on rows and names and not on their order: sums of row hashes, so it combines before the shuffle."""
    h = df.select(F.sha2(canonical(df), 256).alias("h"))
    limbs = [F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)").alias(f"p{i}") for i in range(5)]
    row = h.select(*limbs).agg(F.count("*").alias("n"), *(F.sum(f"p{i}").cast("string").alias(f"p{i}") for i in range(5))).first()
    return hashlib.sha256(json.dumps([sorted(df.columns), *(str(x) for x in row)]).encode()).hexdigest()


def security_master(listed: DataFrame, delisted: DataFrame) -> DataFrame:
    """Union of both lists; of a repeated code the row with a delisting date stays."""
    both = listed.unionByName(delisted, allowMissingColumns=True)
    w = Window.partitionBy("ts_code").orderBy(F.col("delist_date").isNotNull().desc(), F.col("delist_date").desc(), "list_date", "name")
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def clip_calendar(calendar: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Calendar up to the benchmark's last date."""
    last = benchmark.agg(F.max("trade_date").alias("last"))
    return calendar.join(F.broadcast(last), F.col("trade_date") <= F.col("last")).drop("last")


def staging_profile(bar: DataFrame) -> DataFrame:
    """Rows, missing rates and quantiles of amount / (volume * close)."""
    ratio = F.try_divide(F.col("amount"), F.col("volume") * F.col("close"))
    q = F.percentile(ratio, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    miss = [F.avg(F.col(c).isNull().cast("double")).alias(f"missing_{c}") for c in ("open", "close", "amount", "adj_factor")]
    out = bar.agg(F.count("*").alias("rows"), *miss, q.alias("q"))
    return out.select("rows", *(f"missing_{c}" for c in ("open", "close", "amount", "adj_factor")), *(F.col("q")[i].alias(f"ratio_p{p}") for i, p in enumerate(("05", "50", "95"))))


def convert_divisor(df: DataFrame, column: str = "adj_factor") -> DataFrame:
    """A legacy divisor as a factor, 1 / divisor; a missing one stays missing, others that aren't positive and finite raise when run."""
    x = F.col(column)
    good = (x > 0) & finite(x).isNotNull()
    return df.withColumn(column, F.when(x.isNull(), None).when(good, F.try_divide(F.lit(1.0), x)).otherwise(F.raise_error(F.concat(F.lit("bad divisor "), x.cast("string")))))


def with_codes(df: DataFrame, column: str = "ts_code") -> DataFrame:
    return df.withColumn(column, normalize_code(column))


def upsert_cache(cache: DataFrame, fresh: DataFrame, key: str = "cache_key", at: str = "written_at") -> DataFrame:
    """Key-value cache where the last write wins."""
    both = cache.unionByName(fresh, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last())
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def read_artifact(spark: SparkSession, at: str, required: list[str] | None = None, run_id: str | None = None) -> tuple[str, DataFrame | None]:
    """(status, frame): ok, missing, empty, schema_mismatch, run_id_mismatch or error; never raises."""
    try:
        if not exists(spark, at):
            return "missing", None
        df = read_any(spark, at)
        if set(required or ()) - set(df.columns):
            return "schema_mismatch", df
        if not df.limit(1).count():
            return "empty", df
        if run_id is not None and "run_id" in df.columns and df.where(F.col("run_id") != run_id).limit(1).count():
            return "run_id_mismatch", df
        return "ok", df
    except Exception as e:  # a reader of other runs' files reports and goes on
        return f"error: {type(e).__name__}", None


def discover_runs(spark: SparkSession, folder: str, marker: str = "run_metadata.json") -> list[dict]:
    """Sub-folders with a marker file, newest first."""
    if not exists(spark, folder):
        return []
    fs, p = _path(spark, folder)
    found = [{"run_id": s.getPath().getName(), "path": s.getPath().toString(), "modified": s.getModificationTime()} for s in fs.listStatus(p) if s.isDirectory() and exists(spark, f"{s.getPath()}/{marker}")]
    return sorted(found, key=lambda r: (-r["modified"], r["run_id"]))
