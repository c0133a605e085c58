"""Byte-level BPE by a hierarchical-bitmap rank queue.

A piece (one match of the pre-token pattern) starts as a linked list of bytes.
Every adjacent pair that has a merge rank waits in the bucket of that rank; a
three-level bitmap over ranks tells which buckets hold something, and
find-first-set on it yields the lowest rank in constant time however long the
piece is. Within a bucket positions leave from left to right. A merge changes
its neighbours' pairs, so entries may be stale; they are recognised on leaving
(the position is gone or its pair has another rank now) and skipped.

Null text counts as empty: no tokens, empty bytes. Text may be of any length:
pieces are taken from an iterator in runs, so a long text is never held as a
list of pieces. The vocabulary file is a parameter (a path that every executor
can open, or the bytes of the file).
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import pieces

#: Pieces kept with their ids: two generations of so many at most. A piece is kept from its second time on, as most that are rare come once.
CACHE_PIECES = 500_000
CACHE_BYTES = 64
#: Bytes (a power of two) that tell by a piece's hash whether it came before; a clash keeps one early.
MET = 1 << 22
RUN = 1 << 18
_BIT = [1 << i for i in range(64)]


def load_ranks(path: str) -> dict[bytes, int]:
    """token -> rank of a file of 'base64 rank' lines."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


class Codec:
    """Encodes and decodes by a rank table; rank = token id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.vocabulary: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.of_byte = [ranks[bytes([b])] for b in range(256)]
        self.pattern = regex.compile(pattern)
        # the bitmap over ranks: a bit a rank, a bit a word of those, and (in merge) a bit a word of these; all zero between calls
        self.low = [0] * (len(self.vocabulary) // 64 + 1)
        self.mid = [0] * (len(self.vocabulary) // 4096 + 1)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.met = bytearray(MET)

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, rank_of, words = len(piece), self.ranks.get, self.vocabulary
        of_byte, low, mid, top = self.of_byte, self.low, self.mid, 0
        ids = [of_byte[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waits = [-1] * n  # the rank of the pair that starts here
        buckets: dict[int, list[int]] = {}
        for i in range(n - 1):
            rank = rank_of(piece[i : i + 2])
            if rank is not None:
                waits[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)  # ascending, so a heap
                else:
                    buckets[rank] = [i]
                    j = rank >> 6
                    low[j] |= _BIT[rank & 63]
                    mid[j >> 6] |= _BIT[j & 63]
                    top |= _BIT[j >> 6]
        while top:
            i = (top & -top).bit_length() - 1
            word = mid[i]
            j = (i << 6) + (word & -word).bit_length() - 1
            word = low[j]
            rank = (j << 6) + (word & -word).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                at = heappop(bucket)
            else:
                at = bucket[0]
                del buckets[rank]
                low[j] = word & (word - 1)
                if not low[j]:
                    mid[i] &= mid[i] - 1
                    if not mid[i]:
                        top &= top - 1
            if waits[at] != rank:
                continue
            gone = after[at]
            ids[at], ids[gone], waits[gone], waits[at] = rank, -1, -1, -1
            after[at] = right = after[gone]
            left = before[at]
            token = words[rank]
            for start, other in ((left, right), (at, right)):
                if start == at:
                    if right >= n:
                        continue
                    before[right] = at
                    new = rank_of(token + words[ids[other]])
                else:
                    if left < 0:
                        continue
                    new = rank_of(words[ids[left]] + token)
                if new is None:
                    waits[start] = -1
                    continue
                waits[start] = new
                if new in buckets:
                    heappush(buckets[new], start)
                else:
                    buckets[new] = [start]
                    j = new >> 6
                    low[j] |= _BIT[new & 63]
                    mid[j >> 6] |= _BIT[j & 63]
                    top |= _BIT[j >> 6]
        return [x for x in ids if x >= 0]

    def packed(self, piece: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        found = self.young.get(piece)
        if found is not None:
            return found
        found = self.old.get(piece)
        if found is None:
            ids = array("I", self.merge(piece.encode("utf-8", "surrogatepass")))
            if ids.itemsize != 4 or array("H", [1]).tobytes() != b"\x01\x00":
                found = b"".join(i.to_bytes(4, "little") for i in ids)
            else:
                found = ids.tobytes()
            if len(piece) > CACHE_BYTES:
                return found
            at = hash(piece) & (MET - 1)
            if not self.met[at]:
                self.met[at] = 1
                return found
        if len(self.young) >= CACHE_PIECES:
            self.old, self.young, self.met = self.young, {}, bytearray(MET)
        self.young[piece] = found
        return found

    def runs(self, text: str) -> Iterator[bytes]:
        """The packed ids of a text, in runs of many pieces."""
        packed = self.packed
        if len(text) <= RUN:
            yield b"".join(map(packed, self.pattern.findall(text)))
            return
        matches = self.pattern.finditer(text)
        while run := [m[0] for m in islice(matches, RUN)]:
            yield b"".join(map(packed, run))

    def encode(self, text: str) -> bytes:
        return b"".join(self.runs(text or ""))

    def decode(self, packed: bytes) -> bytes:
        ids = memoryview(packed).cast("I") if len(packed) else ()
        return b"".join(map(self.vocabulary.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker and vocabulary."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, token_ids (little-endian unsigned 32-bit integers) of every row; map-side, no shuffle."""
    def work(batches):
        own = codec(path, pattern)
        for b in pieces(batches):
            out = [own.encode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())], ["k", "n_tokens", "token_ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(work, f"k {kind}, n_tokens bigint, token_ids binary").withColumnRenamed("k", key)


def decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """key, n_tokens, token_ids and the decoded bytes of every row."""
    def work(batches):
        own = codec(path, pattern)
        for b in pieces(batches):
            packed = b.column(2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed, pa.array([own.decode(x) for x in packed.to_pylist()], pa.binary())], ["k", "n_tokens", "token_ids", "decoded"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col("n_tokens"), F.coalesce(F.col(ids), F.lit(b"")).alias("token_ids")).mapInArrow(work, f"k {kind}, n_tokens bigint, token_ids binary, decoded binary").withColumnRenamed("k", key)


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of decode(encode(df)) by one pass: a task has one Python worker and codec, not two."""
    def work(batches):
        own = codec(path, pattern)
        for b in pieces(batches):
            out = [own.encode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary()), pa.array(map(own.decode, out), pa.binary())], ["k", "n_tokens", "token_ids", "decoded"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(work, f"k {kind}, n_tokens bigint, token_ids binary, decoded binary").withColumnRenamed("k", key)


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of documents."""
    both = round_trip(df, path, pattern)
    return both.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
