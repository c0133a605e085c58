"""Token ids in directly addressable codes: files that give any token without decoding a block.

An id is split into chunks, low bits first. Level 0 holds the first chunk of
every id, level 1 the second chunk of those that need one, and so on. A bitmap a
level tells which ids go on; the number of ones before a place (rank) is where
the id's next chunk stands on the next level. A directory holds that number for
every 512 places, so a lookup reads one chunk, one bit and at most eight words
of the bitmap a level. Chunk widths are whole bytes, chosen for each by dynamic programming over how many ids have how many bits.

A file holds whole documents in ascending order of doc_id (null first; equal ids
by their place in the scan), each with its end id, and where each starts. Files follow one another in that order too. They are written where tasks
run, under names that no other attempt of a task takes; the manifest, a Parquet
table that Spark commits, names those that count. So a lost executor leaves a
stray file at most, which write() removes at the end.

Null text counts as empty: the end id alone. Rows that repeat are all written,
one behind the other. Texts are encoded whole; one text is one task's work. A
file is closed after FILE_TOKENS ids, so a task holds that many and one document
more. An empty table gives a manifest without rows. doc_id must be an integer;
columns other than key and text are not read, whatever their names. Texts that
spell a special token are ordinary text.

Rows are dealt to tasks by ranges of doc_id and their place in the scan, so that
an id with a third of all rows is split. A scan gives the same places again after
a lost executor; rows from behind a shuffle are written once before.
"""

from __future__ import annotations

import json
import os
import posixpath
import struct
import uuid
import zlib
from array import array
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import pieces, repeatable

MAGIC = b"PSDAC\x00\x00\x01"
END = 0
FILE_TOKENS = 1 << 24
BLOCK = 512
#: Stretches kept with their ids: two generations of so many at most, none longer than so many characters.
MEMO, MEMO_CHARS = 450_000, 64
#: Characters of the texts that are encoded together, about, and chunks whose ids are put together at once.
TOGETHER, GATHERED = 1 << 24, 1 << 18
FILES_SENT = 1 << 20
_HEAD = struct.Struct("<8sQQQ")
_LEVEL = struct.Struct("<QQ")
MANIFEST = "partition int, sequence int, file string, n_docs bigint, n_tokens bigint"


#: The character that stands for each byte in byte-level vocabularies; printable ones for themselves, the others from 256 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SIGN = {b: b if b in _PRINTABLE else 256 + sum(x not in _PRINTABLE for x in range(b)) for b in range(256)}

_SPACE = chr(_SIGN[0x20])
_MARK = "\x01"


class Encoder:
    """Ids of texts by a tokenizer file, with the library.

    A byte-level file encodes each match of the pattern by itself, so the library
    encodes a match once and its ids are kept. A space that something other than
    a space follows always starts a match, so a batch of texts is cut there, equal
    chunks are told by Arrow's dictionary, and only distinct ones are looked up,
    matched and encoded. Texts with two spaces in a row are matched whole; other
    files get whole texts.
    """

    def __init__(self, path: str, pattern: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        kind = json.loads(Path(path).read_text(encoding="utf-8"))
        step = kind.get("pre_tokenizer") or {}
        plain = step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space")
        self.pattern = regex.compile(pattern) if plain and not kind.get("normalizer") and not kind.get("post_processor") else None
        self.young: dict[str, array] = {}
        self.old: dict[str, array] = {}

    def _match(self, match: str) -> array:
        if match.isascii() and match.isprintable():
            signs = match.replace(" ", _SPACE)
        else:
            signs = match.encode("utf-8", "surrogatepass").decode("latin-1").translate(_SIGN)
        return array("I", [t.id for t in self.model.tokenize(signs)])

    def _stretch(self, s: str) -> array:
        """Ids of what stands between two starts of matches."""
        found = self.young.get(s)
        if found is not None:
            return found
        found = self.old.get(s)
        if found is None:
            matches = [s] if s.isalpha() or (s[0] == " " and s[1:].isalpha()) else self.pattern.findall(s)
            found = self._match(s) if len(matches) == 1 else array("I", chain.from_iterable(map(self._stretch, matches)))
        if len(s) <= MEMO_CHARS:
            if len(self.young) >= MEMO:
                self.old, self.young = self.young, {}
            self.young[s] = found
        return found

    def _whole(self, text: str) -> array:
        if self.pattern is None:
            return array("I", self.library.encode(text, add_special_tokens=False).ids)
        return array("I", chain.from_iterable(map(self._stretch, self.pattern.findall(text))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one behind the other, and how many each has."""
        if self.pattern is None or not texts:
            own = list(map(self._whole, texts))
            return np.array(array("I", chain.from_iterable(own)), np.uint32), np.array(list(map(len, own)), np.int64)
        # by itself: the start of a text up to its first cut, which no space leads, or all of a text that isn't cut
        apart = ["  " in x or _MARK in x for x in texts]
        heads = [self._whole(x) if alone else array("I") for x, alone in zip(texts, apart, strict=True)]
        cut = pc.replace_substring_regex(pa.array(["" if alone else x for x, alone in zip(texts, apart, strict=True)], pa.large_string()), r"(\pL)([.,;:!?])", rf"\1 {_MARK}\2")
        lists = pc.split_pattern(cut, " ")
        edges = lists.offsets.to_numpy().astype(np.int64)
        chunks = lists.flatten().dictionary_encode()
        place = chunks.indices.to_numpy().astype(np.int32)
        first = edges[:-1] - edges[0]
        starts = chunks.dictionary.take(pa.array(place[first])).to_pylist()
        heads = [head if alone else self._stretch(x) if x else head for head, alone, x in zip(heads, apart, starts, strict=True)]
        place[first] = len(chunks.dictionary) + np.arange(len(texts))
        led = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), chunks.dictionary, pa.scalar("", pa.large_string()))
        led = pc.replace_substring_regex(led, f"^ {_MARK}", "").to_pylist()
        kept = self.young.get  # of the generation that was young when the batch began
        stretches = [kept(s) or self._stretch(s) for s in led] + heads
        sizes = np.fromiter(map(len, stretches), np.int32, len(stretches))
        flat = np.frombuffer(array("I", chain.from_iterable(stretches)) or array("I", [0]), np.uint32)
        del stretches, led, chunks, starts
        begin = np.cumsum(sizes) - sizes
        counts = sizes[place]
        ids, at = np.empty(int(counts.sum()), np.uint32), 0
        for i in range(0, len(place), GATHERED):
            each = counts[i : i + GATHERED]
            n = int(each.sum())
            shift = begin[place[i : i + GATHERED]] - (np.cumsum(each) - each)
            ids[at : at + n] = flat[np.repeat(shift, each) + np.arange(n)]
            at += n
        return ids, np.add.reduceat(counts, first)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder_of(path: str, pattern: str) -> Encoder:
    """One encoder for each Python worker and tokenizer file; what it keeps is bounded (MEMO)."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def widths(ids: np.ndarray) -> list[int]:
    """Chunk widths, multiples of eight bits, that take least space for these ids: chunks, bitmaps and directories."""
    more = [max(1, len(ids))]  # how many ids have bits beyond 8 * q
    while n := int(np.count_nonzero(ids >> np.uint64(8 * len(more)))) if len(more) < 4 else 0:
        more.append(n)
    top = len(more)
    cost, first = [0.0] * (top + 1), [0] * (top + 1)
    for at in range(top - 1, -1, -1):
        choices = [(more[at] * 8 * (to - at) + (more[at] * (1 + 64 / BLOCK) if to < top else 0) + cost[to], to) for to in range(at + 1, top + 1)]
        cost[at], first[at] = min(choices)
    out, at = [], 0
    while at < top:
        out.append(8 * (first[at] - at))
        at = first[at]
    return out


def _packed(chunks: np.ndarray, width: int) -> bytes:
    """Chunks of so many bits (whole bytes), one behind the other, low bytes first."""
    if width != 24:
        return chunks.astype(f"<u{width // 8}").tobytes()
    return chunks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _aligned(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def packed(ids: np.ndarray, starts: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """A file: head, widths and sizes of the levels, documents, then bitmap, directory and chunks a level."""
    ids = np.ascontiguousarray(ids, np.uint32)
    levels, rest, shape = [], ids, widths(ids)
    for k, width in enumerate(shape):
        last = k == len(shape) - 1
        chunk = rest if width == 32 else rest & np.uint32((1 << width) - 1)
        head = _LEVEL.pack(width, len(rest))
        if last:
            levels.append((head, b"", b"", _packed(chunk, width)))
            break
        above = rest >> np.uint32(width)
        goes_on = above > 0
        bits = np.packbits(goes_on, bitorder="little").tobytes()
        words = np.frombuffer(bits + bytes(-len(bits) % (BLOCK // 8)), "<u8")
        ones = np.bitwise_count(words).astype(np.uint64).reshape(-1, BLOCK // 64).sum(1)
        directory = np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u8") if len(ones) else np.zeros(0, "<u8")
        levels.append((head, words.tobytes(), directory.tobytes(), _packed(chunk, width)))
        rest = above[goes_on]
    known = np.array([d is not None for d in doc_ids], bool)
    numbers = np.array([0 if d is None else d for d in doc_ids], "<i8")
    parts = [_HEAD.pack(MAGIC, len(levels), len(ids), len(doc_ids)), *(x[0] for x in levels), numbers.tobytes(), np.asarray(starts, "<u8").tobytes(), _aligned(np.packbits(known, bitorder="little").tobytes())]
    for _, bitmap, directory, chunks in levels:
        parts += bitmap, directory, _aligned(chunks)
    return b"".join(parts)


class Codes:
    """Random access to the ids of one file; data is anything with a buffer, such as a memory map."""

    def __init__(self, data) -> None:
        view = memoryview(data)
        magic, n_levels, self.n_tokens, self.n_docs = _HEAD.unpack_from(view, 0)
        if magic != MAGIC:
            raise ValueError("no file of directly addressable codes")
        shapes = [_LEVEL.unpack_from(view, _HEAD.size + k * _LEVEL.size) for k in range(n_levels)]
        at = _HEAD.size + n_levels * _LEVEL.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(view, kind, n, at)
            at += -(-out.nbytes // 8) * 8
            return out

        numbers, self.starts = take("<i8", self.n_docs), take("<u8", self.n_docs + 1)
        known = np.unpackbits(take("u1", -(-self.n_docs // 8)), count=self.n_docs, bitorder="little").astype(bool)
        self.doc_ids = pa.array(numbers, pa.int64(), mask=~known)
        self.levels = []
        for k, (width, n) in enumerate(shapes):
            blocks = -(-n // BLOCK) if k < n_levels - 1 else 0
            bitmap, directory = take("<u8", blocks * (BLOCK // 64)), take("<u8", blocks)
            self.levels.append((width, n, bitmap, directory, take("u1", n * width // 8)))

    def __len__(self) -> int:
        return self.n_tokens

    def __getitem__(self, i: int) -> int:
        """The i-th id: a chunk and a bit a level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for width, _, bitmap, directory, chunks in self.levels:
            value |= int.from_bytes(chunks[i * width // 8 : (i + 1) * width // 8].tobytes(), "little") << shift
            if not len(bitmap) or not (int(bitmap[i >> 6]) >> (i & 63)) & 1:
                break
            block = i // BLOCK
            before = bitmap[block * (BLOCK // 64) : i >> 6]
            i = int(directory[block]) + int(np.bitwise_count(before).sum()) + (int(bitmap[i >> 6]) & ((1 << (i & 63)) - 1)).bit_count()
            shift += width
        return value

    @staticmethod
    def _chunks(width: int, n: int, raw: np.ndarray) -> np.ndarray:
        """All chunks of a level."""
        if width != 24:
            return raw.view(f"<u{width // 8}")[:n]
        whole = np.zeros((n, 4), np.uint8)
        whole[:, :3] = raw.reshape(n, 3)
        return whole.view("<u4").ravel()

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out, at, shift = np.zeros(self.n_tokens, np.uint32), None, 0
        for width, n, bitmap, _, raw in self.levels:
            chunks = self._chunks(width, n, raw)
            if at is None:
                out[:] = chunks
            else:
                out[at] |= chunks.astype(np.uint32) << np.uint32(shift)
            on = np.unpackbits(bitmap.view(np.uint8), count=n, bitorder="little").astype(bool) if len(bitmap) else np.zeros(n, bool)
            at = np.flatnonzero(on) if at is None else at[on]
            shift += width
        return out

    def document(self, k: int) -> list[int]:
        """Ids of the k-th document, read one by one."""
        return [self[i] for i in range(int(self.starts[k]), int(self.starts[k + 1]))]


def opened(uri: str) -> Codes:
    """A file's codes: mapped, where it lies on a local or mounted disk, else read whole."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        with pa.memory_map(path) as f:
            return Codes(f.read_buffer())
    with fs.open_input_file(path) as f:
        return Codes(f.read_buffer())


def _together(batches):
    """Keys and texts in lists of about TOGETHER characters, or of one longer text."""
    keys, texts, size = [], [], 0
    for b in pieces(batches):
        for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            keys.append(k)
            texts.append(x)
            size += len(x)
            if size >= TOGETHER:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def write(df: DataFrame, folder: str, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every row and writes the files to folder (a URI that all executors reach); returns the manifest.

    One shuffle, by ranges of key. The manifest has a row a file.
    """
    kind = df.schema[key].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{key} must be an integer, not {kind}")
    folder = folder.rstrip("/")

    def work(batches):
        encoder, name = encoder_of(path, pattern), uuid.uuid4().hex
        fs, place = pyarrow.fs.FileSystem.from_uri(folder)
        partition, sequence = TaskContext.get().partitionId(), 0
        ids, starts, docs = array("I"), [0], []

        def close():
            nonlocal sequence, ids, starts, docs
            file = f"ids-{partition:06d}-{sequence:04d}-{name}.dac"
            with fs.open_output_stream(posixpath.join(place, file)) as out:
                out.write(packed(np.frombuffer(ids, np.uint32), np.array(starts, np.uint64), docs))
            row = pa.RecordBatch.from_arrays([pa.array([partition], pa.int32()), pa.array([sequence], pa.int32()), pa.array([file]), pa.array([len(docs)], pa.int64()), pa.array([len(ids)], pa.int64())], ["partition", "sequence", "file", "n_docs", "n_tokens"])
            sequence, ids, starts, docs = sequence + 1, array("I"), [0], []
            return row

        fs.create_dir(place, recursive=True)
        for keys, texts in _together(batches):
            found, sizes = encoder.encode(texts)
            ends = np.cumsum(sizes)
            for doc, a, z in zip(keys, (ends - sizes).tolist(), ends.tolist(), strict=True):
                ids.frombytes(found[a:z].tobytes())
                ids.append(END)
                starts.append(len(ids))
                docs.append(doc)
                if len(ids) >= FILE_TOKENS:
                    yield close()
        if docs:
            yield close()

    rows = repeatable(df.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")))
    order = [F.col("k").asc_nulls_first(), F.col("place")]
    dealt = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    made = dealt.select("k", "t").mapInArrow(work, MANIFEST)
    made.write.mode("overwrite").parquet(f"{folder}/manifest")
    _sweep(df.sparkSession, folder)
    return manifest(df.sparkSession, folder)


def _sweep(spark: SparkSession, folder: str) -> None:
    """Removes files that the manifest doesn't name: those of attempts that were lost or that another overtook."""
    named = {r["file"] for r in spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file").toLocalIterator()}
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(at) if fs.exists(at) else []:
        if status.getPath().getName().endswith(".dac") and status.getPath().getName() not in named:
            fs.delete(status.getPath(), False)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A row a file, with start: ids in all files before it. The window has as many rows as there are files."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")
    before = Window.orderBy("partition", "sequence").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("bigint"))


def read(spark: SparkSession, folder: str, checksums: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and token_ids (little-endian unsigned 32-bit integers) of every document, from the files.

    checksums: ids_crc32, the unsigned CRC-32 of token_ids, in their place, so that ids don't leave the worker that decodes them.
    """
    folder = folder.rstrip("/")
    last, kind = ("ids_crc32", "bigint") if checksums else ("token_ids", "binary")

    def work(batches):
        for b in batches:
            for file, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                codes = opened(f"{folder}/{file}")
                data, starts = codes.all().astype("<u4").tobytes(), codes.starts.astype(np.int64)
                for i in range(0, codes.n_docs, 512):
                    edges = starts[i : i + 513]
                    own = (data[4 * a : 4 * z] for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
                    out = pa.array(map(zlib.crc32, own), pa.int64()) if checksums else pa.array(own, pa.binary())
                    yield pa.RecordBatch.from_arrays([codes.doc_ids[i : i + 512], pa.array(edges[:-1] + first), pa.array(np.diff(edges)), out], ["doc_id", "start", "n_tokens", last])

    files = manifest(spark, folder).select("file", "start")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(tasks, "file").mapInArrow(work, f"doc_id bigint, start bigint, n_tokens bigint, {last} {kind}")


def tokens_at(positions: DataFrame, folder: str, position: str = "position") -> DataFrame:
    """The id at each position of the whole sequence (from 0): position, token; positions outside have no row.

    Each is read from its file by itself; no block is decoded. Where files start is sent to the tasks, for up to FILES_SENT files.
    """
    spark, folder = positions.sparkSession, folder.rstrip("/")
    n_files, total = manifest(spark, folder).agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    if n_files > FILES_SENT:
        raise ValueError(f"{n_files} files: look positions up folder by folder, or write with a larger FILE_TOKENS")
    files = [(r["start"], r["file"]) for r in manifest(spark, folder).orderBy("start").select("start", "file").collect()]
    shared = spark.sparkContext.broadcast((np.array([s for s, _ in files], np.int64), [f for _, f in files]))

    def work(batches):
        starts, names = shared.value
        codes: dict[int, Codes] = {}
        for b in batches:
            places = b.column(0).to_pylist()
            at = (np.searchsorted(starts, places, "right") - 1).tolist()
            out = []
            for p, f in zip(places, at, strict=True):
                if f not in codes:
                    codes = {f: opened(f"{folder}/{names[f]}")}
                out.append(codes[f][p - int(starts[f])])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], ["position", "token"])

    inside = positions.select(F.col(position).cast("long").alias("position")).where((F.col("position") >= 0) & (F.col("position") < total))
    return inside.sortWithinPartitions("position").mapInArrow(work, "position bigint, token bigint")


def digests(df: DataFrame, folder: str, path: str, pattern: str) -> DataFrame:
    """Writes documents to folder and returns doc_id, start, n_tokens and ids_crc32 of every document as read back."""
    write(df, folder, path, pattern)
    return read(df.sparkSession, folder, checksums=True)

