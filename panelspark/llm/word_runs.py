"""Maximal periodic runs of words by Main-Lorentz divide and conquer.

A run is a stretch of words with smallest period q, at least max(LEAST, 2 * q)
words long, that no neighbouring word extends. Words are interned as numbers per
text. A text is halved again and again; the runs that cross a midpoint are read
off Z-functions of both halves: for each q, how far the words right of the
midpoint go on with period q, and how far those to its left do. What was found
is extended as far as its half goes; a piece that a neighbouring word would
extend belongs to a run that crosses an earlier midpoint and was found there
whole. Equal stretches found with several periods keep the smallest.

A midpoint is worked on only if a group of words beside it comes again within
reach, which a run across it needs: for a period below LEAST a quarter of LEAST
words, for longer ones half of LEAST. These groups are compared by hashes, so a
clash costs time, never a run. Ordinary prose thus needs no Z-function; a text
that is one long repetition takes n log n steps.

Null text counts as empty: no runs, empty collapsed text. A null key is carried
through. Rows that repeat give equal rows; ties between runs are settled where
they are ranked (greatest length, then smallest start, then period). Texts are
taken whole, one at a time in a task, however long. An empty table gives an
empty table; columns other than key and text are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import bytes_of, mix, pieces

LEAST = 12
FAR = np.iinfo(np.int64).max
Run = tuple[int, int, int]
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def z_function(s: list[int]) -> list[int]:
    """For each place but the first, how many items from there on equal those from the start on."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if k:
            z[i] = k
            left, right = i, i + k
    return z


def _to_the_right(u: list[int], v: list[int], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs across the seam of u and v with a whole period in v: words in u, words in v, period."""
    k, back = len(v), u[::-1]
    after = np.array([*z_function(v)[1:], 0])
    before = np.array(z_function([*back, -1, *v[::-1], *back])[len(u) + 1 : len(u) + 1 + k])[::-1]
    q = np.arange(1, k + 1)
    at = np.flatnonzero((before > 0) & (after + before >= np.maximum(least - q, q)))
    return before[at], q[at] + after[at], q[at]


def _again(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place: whether the quarter-length group from there comes again less than `least` words away, and the distance to the next equal half-length group."""
    h = mix(ids)
    def groups(size):
        out = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for j in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
        return out

    near, far = np.zeros(len(ids), bool), np.full(len(ids), FAR)
    short, half = groups((least + 3) // 4), groups((least + 1) // 2)
    for d in range(1, min(least, len(short))):
        same = short[d:] == short[:-d]
        near[d : len(short)] |= same
        near[: len(short) - d] |= same
    order = np.argsort(half, kind="stable")
    same = half[order[1:]] == half[order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    far[a] = b - a
    far[b] = np.minimum(far[b], b - a)
    return near, far


def find_runs(words: list, least: int = LEAST) -> list[Run]:
    """(start, length, period) of every run, by start, then period."""
    n = len(words)
    if n < least:
        return []
    numbers: dict = {}
    x = [numbers.setdefault(w, len(numbers)) for w in words]
    near, far = _again(np.array(x), least)
    hints = near | (far < FAR)
    if not hints.any():
        return []
    hinted = np.concatenate(([0], np.cumsum(hints))).tolist()
    short, half = (least + 3) // 4, (least + 1) // 2
    found: dict[tuple[int, int], int] = {}
    open_ = [(0, n)]
    while open_:
        lo, hi = open_.pop()
        m = (lo + hi) // 2
        if hi - lo < least or hinted[hi] == hinted[lo]:
            continue
        open_ += (lo, m), (m, hi)
        if not (near[m] or near[max(0, m - short)] or far[m] < hi - lo or far[max(0, m - half)] < hi - lo):
            continue
        u, v = x[lo:m], x[m:hi]
        left, right, q = _to_the_right(u, v, least)
        right2, left2, q2 = _to_the_right(v[::-1], u[::-1], least)
        for a, b, p in zip(np.concatenate((m - left, m - left2)).tolist(), np.concatenate((m + right, m + right2)).tolist(), np.concatenate((q, q2)).tolist(), strict=True):
            if (a == lo > 0 and x[a - 1] == x[a - 1 + p]) or (b == hi < n and x[b] == x[b - p]):
                continue
            if p < found.get((a, b), n):
                found[a, b] = p
    return sorted((a, b - a, p) for (a, b), p in found.items())


def without_repeats(words: list, runs: list[Run]) -> list:
    """words less those that any run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def runs_of(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, change: Callable[[object, list], list] | None = None) -> DataFrame:
    """key, runs (by start, then period) and collapsed (the words that are no repeats, joined by one space) of every row; map-side, no shuffle.

    change(key, words), where given, makes the words that are searched.
    """
    def work(batches):
        for b in pieces(batches):
            offsets, flat, collapsed = [0], [], []
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = change(k, data.split()) if change else data.split()
                runs = find_runs(words, least)
                flat += runs
                offsets.append(len(flat))
                collapsed.append(b" ".join(without_repeats(words, runs)))
            fields = [pa.array(list(c), pa.int64()) for c in zip(*flat, strict=True)] or [pa.array([], pa.int64())] * 3
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_RUNS.value_type)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], ["k", "runs", "collapsed"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), bytes_of(text).alias("t")).mapInArrow(work, f"k {kind}, runs {RUNS}, collapsed string").withColumnRenamed("k", key)


def planted(doc_id: int | None, words: list) -> list:
    """words with a periodic tail in one text of ten, as the id's crc32 decides; without an id or words as they are."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def longest(runs: str = "runs") -> Column:
    """The run of greatest length (ties: smallest start, then period) as a struct with negated start and period; null without runs."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run and digests of the runs and of the collapsed text, of every row of documents."""
    top, line = F.col("__top"), F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    length, period = top["length"], -top["period"]
    return runs_of(df, change=planted).withColumn("__top", longest()).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-top["start"]).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
