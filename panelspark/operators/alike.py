"""Sets of character n-grams that are alike, found by parity sketches.

A sketch has a bit for each bucket of n-grams: whether the set holds an odd number
of them. An n-gram that only one of two sets holds turns one bit, so sketches differ
in as many bits at most as the sets do in items, and pairs beyond the difference
that a similarity allows are left out without loss. Texts of one language share most
of their n-grams, which leaves no rare ones to join on; their sketches still differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a sketch by the most items of its set; wider ones fold to narrower ones.
WIDTHS = ((700, 1024), (2800, 4096), (1 << 62, 16384))
BASE = WIDTHS[0][1]
SPACE = np.zeros(33, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Rows of a block at least, and blocks of an entity at most: a row goes to so many cells at most, whatever the entity's size.
LEAST, BLOCKS = 4096, 12


def grams_of(text: str, n: int = 3) -> np.ndarray:
    """Distinct character n-grams (3 at most) without spaces as numbers; a shorter text is its own n-gram."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    c = c[~SPACE[np.minimum(c, 32)] | (c > 32)].astype(np.uint64) + np.uint64(1)
    if 0 < len(c) < n:
        c = np.concatenate([c, np.zeros(n - len(c), np.uint64)])
    out = np.zeros(max(len(c) - n + 1, 0), np.uint64)
    for i in range(n):
        out |= c[i : len(c) - n + 1 + i] << np.uint64(21 * i)
    return np.unique(out)


def sketch(g: np.ndarray) -> bytes:
    width = next(w for most, w in WIDTHS if len(g) <= most)
    h = g * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) & np.uint64(width - 1)
    return np.packbits((np.bincount(h.astype(np.int64), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketched(df: DataFrame, text: str) -> DataFrame:
    """df with n and sketch of the text's trigrams in its place; both are null for a null text."""
    names, at = [c for c in df.columns if c != text], df.columns.index(text)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, max(whole.num_rows, 1), 512):
                b = whole.slice(start, 512)
                sets = [None if t is None else grams_of(t) for t in b.column(at).to_pylist()]
                cols = [b.column(i) for i in range(b.num_columns) if i != at]
                cols += [pa.array([None if g is None else len(g) for g in sets], pa.int32()), pa.array([None if g is None else sketch(g) for g in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "n", "sketch"])

    return df.mapInArrow(run, f"{schema}, n int, sketch binary")


def folded(s: list[bytes], width: int) -> np.ndarray:
    """Sketches of `width` bits or more as rows of 64-bit words, folded to `width`."""
    out = np.empty((len(s), width // 64), np.uint64)
    sizes = np.array([len(x) * 8 for x in s])
    for w in np.unique(sizes):
        at = np.flatnonzero(sizes == w)
        out[at] = np.bitwise_xor.reduce(np.frombuffer(b"".join(s[i] for i in at), np.uint64).reshape(len(at), w // width, width // 64), axis=1)
    return out


def close(n: np.ndarray, sketches: list[bytes], right: np.ndarray | None, threshold: float, rows: int = 64, columns: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions (smaller set first) whose sketches allow the similarity; n ascends. right: which rows are right ones only, all against all if None."""
    share, wide = (1 - threshold) / (1 + threshold), {}
    base = np.ascontiguousarray(folded(sketches, BASE).T)
    lefts = np.arange(len(n)) if right is None else np.flatnonzero(~right)
    rights = np.arange(len(n)) if right is None else np.flatnonzero(right)
    nr = n[rights]
    for at in range(0, len(lefts), rows):
        a = lefts[at : at + rows]
        first = at if right is None else 0
        last = np.searchsorted(nr, n[a[-1]] / threshold + 1e-9, "right")
        for lo in range(first, last, columns):
            b = rights[lo : min(lo + columns, last)]
            most = ((n[a][:, None] + n[b][None, :]) * share + 1e-6).astype(np.int32)
            d = np.zeros((len(a), len(b)), np.int32)
            for w in range(4):
                d += np.bitwise_count(base[w, a][:, None] ^ base[w, b][None, :])
            i, j = np.nonzero(d <= most)
            ok = n[a[i]] >= threshold * n[b[j]] - 1e-9
            if right is None:
                ok &= a[i] < b[j]
            i, j = i[ok], j[ok]
            for ws in (range(4, 8), range(8, BASE // 64)):
                for w in ws:
                    d[i, j] += np.bitwise_count(base[w, a[i]] ^ base[w, b[j]])
                ok = d[i, j] <= most[i, j]
                i, j = i[ok], j[ok]
            x, y, m = a[i], b[j], most[i, j]
            for _, width in WIDTHS[1:]:
                if not len(x):
                    break
                if width not in wide:
                    have = np.array([len(s) * 8 >= width for s in sketches])
                    wide[width] = have, np.cumsum(have) - 1, folded([s for s, h in zip(sketches, have, strict=True) if h], width)
                have, place, words = wide[width]
                both = have[x] & have[y]
                ok = ~both
                ok[both] = np.bitwise_count(words[place[x[both]]] ^ words[place[y[both]]]).sum(axis=1) <= m[both]
                x, y, m = x[ok], y[ok], m[ok]
            if len(x):
                yield x, y


def cell(threshold: float, names: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Candidates of one cell of blocks: within a block, or of a block's rows against another's."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("n")
        one = t["i"][0].as_py() == t["j"][0].as_py()
        side = None if one else t["right"].to_numpy()
        pairs = list(close(t["n"].to_numpy().astype(np.int64), t["sketch"].to_pylist(), side, threshold))
        x, y = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
        ids = t["ident"].combine_chunks()
        return pa.table([t["entity"].combine_chunks().take(pa.array(x)), ids.take(pa.array(x)), ids.take(pa.array(y))], names=names)

    return run


def candidates(rows: DataFrame, threshold: float, entity: str, ident: str) -> DataFrame:
    """(entity, a_id, b_id), each pair once: all pairs of an entity alike by `threshold` or more, and few others. rows: entity, ident, n, sketch.

    Rows are laid in blocks by the size of their sets; only blocks with sizes near
    enough meet, each pair of blocks in a cell of its own. Work grows with the pairs
    of near sizes, a bit count each; memory and what is moved do not.
    """
    rows = rows.where(F.col(entity).isNotNull() & (F.col("n") > 0)).select(F.col(entity).alias("entity"), F.col(ident).alias("ident"), "n", "sketch")
    whole = Window.partitionBy("entity")
    sizes = rows.groupBy("entity", "n").agg(F.count("*").alias("k"))
    sizes = sizes.withColumn("size", F.greatest(F.lit(LEAST), F.ceil(F.sum("k").over(whole) / BLOCKS))).withColumn("start", F.sum("k").over(whole.orderBy("n")) - F.col("k"))
    sizes = sizes.withColumn("parts", F.greatest(F.ceil(F.col("k") / F.col("size")), F.lit(1)))  # sets of one size may be more than a block
    block = lambda part: F.floor((F.col("start") + part * F.col("k") / F.col("parts")) / F.col("size")).cast("int")
    placed = rows.join(sizes, ["entity", "n"]).withColumn("block", block(F.pmod(F.xxhash64("ident"), F.col("parts")))).select("entity", "ident", "n", "sketch", "block")
    spans = sizes.select("entity", "n", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), "start", "k", "parts", "size").withColumn("block", block(F.col("p"))).groupBy("entity", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    a, b = spans.select("entity", F.col("block").alias("i"), "hi"), spans.select("entity", F.col("block").alias("j"), "lo")
    cells = a.join(b, "entity").where((F.col("i") <= F.col("j")) & (F.col("lo") * threshold <= F.col("hi") + 1e-9)).select("entity", "i", "j")  # BLOCKS^2 an entity at most
    left = placed.withColumnRenamed("block", "i").join(cells, ["entity", "i"]).withColumn("right", F.lit(False))
    right = placed.withColumnRenamed("block", "j").join(cells.where("i < j"), ["entity", "j"]).withColumn("right", F.lit(True))
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("entity", "ident")}
    out = f"entity {kind['entity']}, a_id {kind['ident']}, b_id {kind['ident']}"
    both = left.unionByName(right).repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "entity", "i", "j")  # cells weigh more than their bytes
    return both.groupBy("entity", "i", "j").applyInArrow(cell(threshold, ["entity", "a_id", "b_id"]), out).withColumnRenamed("entity", entity)
