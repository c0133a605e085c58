"""Append-only raw batches with a manifest that only a commit writes.

A table goes to its batch through a Python data source: tasks write files under
names that no other attempt takes, and send back what they wrote. The commit
names those files in the manifest (written beside it and moved over it in one
step); an abort removes them. So a run that is killed leaves a batch whose
manifest lists whole tables alone: resuming skips these, writes the others anew,
and readers never see a file that is not listed. Nothing is ever changed in
place; a batch that exists is an error unless it is resumed, and its parameters
must then be those it was begun with.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "fetch_manifest.json"
#: What a batch was begun with; a resumed run must agree.
PARAMETERS = ("provider", "start_date", "end_date", "symbols")
_DIGITS = 1 << 256


def _at(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


def read_manifest(folder: str) -> dict | None:
    fs, path = _at(folder)
    at = posixpath.join(path, MANIFEST)
    if fs.get_file_info(at).type == pyarrow.fs.FileType.NotFound:
        return None
    with fs.open_input_file(at) as f:
        return json.loads(f.read().decode())


def _replace_manifest(folder: str, manifest: dict) -> None:
    fs, path = _at(folder)
    fresh = posixpath.join(path, f"{MANIFEST}.{uuid.uuid4().hex}")
    with fs.open_output_stream(fresh) as f:
        f.write(json.dumps(manifest, ensure_ascii=False, indent=2, sort_keys=True).encode())
    fs.move(fresh, posixpath.join(path, MANIFEST))


@dataclass
class Written(WriterCommitMessage):
    """A task's file: its name, rows, digest of its bytes and sum of its rows' digests (None: the task had no rows)."""

    file: str | None
    rows: int
    bytes_sha256: str
    row_sum: int


def _row_sum(batch: pa.RecordBatch) -> int:
    """Sum of the rows' digests: the same whatever the order and the files."""
    names = sorted(batch.schema.names)
    total = 0
    for row in batch.select(names).to_pylist():
        total += int.from_bytes(hashlib.sha256(json.dumps(row, default=str, ensure_ascii=False, sort_keys=True).encode()).digest(), "big")
    return total % _DIGITS


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.folder, self.table, self.entry = options["folder"].rstrip("/"), options["table"], json.loads(options.get("entry", "{}"))
        self.columns = {f.name: f.dataType.simpleString() for f in schema.fields}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = _at(self.folder)
        name, rows, total, out = f"{self.table}-{uuid.uuid4().hex}.parquet", 0, 0, None
        at = posixpath.join(path, self.table, name)
        for batch in iterator:
            if out is None:
                fs.create_dir(posixpath.dirname(at), recursive=True)
                out = pq.ParquetWriter(at, batch.schema, filesystem=fs)
            out.write_batch(batch)
            rows, total = rows + batch.num_rows, (total + _row_sum(batch)) % _DIGITS
        if out is None:
            return Written(None, 0, "", 0)
        out.close()
        digest = hashlib.sha256()
        with fs.open_input_stream(at) as f:
            while block := f.read(1 << 20):
                digest.update(block)
        return Written(f"{self.table}/{name}", rows, digest.hexdigest(), total)

    def commit(self, messages: list[Written | None]) -> None:
        done = sorted((m for m in messages if m is not None and m.file), key=lambda m: m.file)
        manifest = read_manifest(self.folder)
        if manifest is None:
            raise ValueError(f"{self.folder} has no manifest: begin the batch first")
        if self.table in manifest["tables"]:
            self.abort(messages)
            raise ValueError(f"{self.table} is in the batch already; a batch is only added to")
        manifest["tables"][self.table] = self.entry | {
            "files": [m.file for m in done], "rows": sum(m.rows for m in done), "columns": list(self.columns), "dtypes": self.columns,
            "file_sha256": hashlib.sha256("".join(m.bytes_sha256 for m in done).encode()).hexdigest(),
            "content_sha256": hashlib.sha256(f"{sorted(self.columns)}{sum(m.row_sum for m in done) % _DIGITS}".encode()).hexdigest(),
        }
        _replace_manifest(self.folder, manifest)

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = _at(self.folder)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(posixpath.join(path, m.file))


class AppendBatch(DataSource):
    """df.write.format('append_batch').mode('append').option('folder', ...).option('table', ...).save()."""

    @classmethod
    def name(cls) -> str:
        return "append_batch"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a batch is only added to: use mode('append')")
        return _Writer(dict(self.options), schema)


def begin(folder: str, parameters: dict, resume: bool = False) -> dict:
    """The batch's manifest: a new one, or with resume the one that is there, if its parameters agree."""
    missing = [p for p in PARAMETERS if p not in parameters]
    if missing:
        raise ValueError(f"parameters needed: {missing}")
    fs, path = _at(folder)
    found = read_manifest(folder)
    used = fs.get_file_info(path).type == pyarrow.fs.FileType.Directory and bool(fs.get_file_info(pyarrow.fs.FileSelector(path)))
    if used and not resume:
        raise FileExistsError(f"{folder} exists; take a new batch or resume it")
    if found is not None:
        other = [p for p in PARAMETERS if found[p] != parameters[p]]
        if other:
            raise ValueError(f"the batch was begun with other {other}")
        return found
    fs.create_dir(path, recursive=True)
    manifest = {"manifest_version": 2, "batch_id": posixpath.basename(path), "fetched_at": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"), **parameters, "tables": {}}
    _replace_manifest(folder, manifest)
    return manifest


def sweep(folder: str) -> list[str]:
    """Removes files that the manifest doesn't list, such as those of a run that was killed; returns their names."""
    manifest = read_manifest(folder) or {"tables": {}}
    listed = {f for t in manifest["tables"].values() for f in t["files"]}
    fs, path = _at(folder)
    strays = []
    for info in fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True)):
        name = posixpath.relpath(info.path, path)
        if info.type == pyarrow.fs.FileType.File and name != MANIFEST and name not in listed:
            fs.delete_file(info.path)
            strays.append(name)
    return sorted(strays)


def fetch(spark: SparkSession, folder: str, tables: dict[str, Callable[[], DataFrame]], parameters: dict, resume: bool = False, entries: dict[str, dict] | None = None) -> dict:
    """Writes each table that the batch doesn't hold yet; the manifest after the last.

    tables: name -> a call that gives its rows, made only for tables to be written.
    entries: more for a table's entry in the manifest (endpoint, limits).
    """
    spark.dataSource.register(AppendBatch)
    manifest = begin(folder, parameters, resume)
    if resume:
        sweep(folder)
    for name, load in tables.items():
        if name not in manifest["tables"]:
            entry = {"requested_start": parameters["start_date"], "requested_end": parameters["end_date"], **(entries or {}).get(name, {})}
            load().write.format("append_batch").mode("append").option("folder", folder).option("table", name).option("entry", json.dumps(entry)).save()
    return read_manifest(folder)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of a table that the manifest lists, and no others."""
    entry = (read_manifest(folder) or {"tables": {}})["tables"].get(name)
    if entry is None:
        raise KeyError(f"{name} is not in {folder}")
    schema = ", ".join(f"`{c}` {kind}" for c, kind in entry["dtypes"].items())
    if not entry["files"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{folder.rstrip('/')}/{f}" for f in entry["files"]))
