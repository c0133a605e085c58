"""Near-duplicate groups by HyperMinHash registers, banding and exact confirmation.

A text's set holds its distinct 5-word shingles as 64-bit hashes. Its sketch has
PASSES * BUCKETS registers: in each pass the shingles are mixed anew, their top
bits choose a bucket, and a bucket keeps its smallest value as a HyperMinHash
register: six bits with the count of leading zeros, ten with the mantissa behind
them. A band is BAND registers of one bucket in different passes; texts that
share a band are candidates. At a similarity of 0.75 a pair of texts misses all
bands with a chance of about 3e-11, and less above.

1. Texts with equal sets form a class, held by its smallest id.
2. Every holder is paired with two of each band it shares, the one with most
   company over all bands and the smallest (stars, so pairs grow with the rows
   and not with their squares). Pairs whose
   estimate, corrected for chance collisions of registers, is well below the
   bound are dropped; the others are confirmed on full shingle sets, rebuilt
   from the texts. Confirmed links give components.
3. What stars may miss are links between different components of one band.
   Bands with more than one component left are searched again, in chunks of
   holders, by sketches; pairs of different components that pass the estimate,
   and one by a finer sketch of FINE registers, are confirmed on full sets where
   their chunks meet, so no pair ever is a row; only links that join what was
   apart are. Components are then formed anew. No band is capped or skipped.

Registers and texts move only for rows that are wanted, and only bands that are
shared are shuffled to them: the keys wanted are broadcast, or a filter of bits
if they are many. A filter lets some others pass, which exact joins then drop.

Texts without words, null texts among them, have an empty set and no links.
Fewer than 5 words form one shingle of their own kind. A null id takes no part
and stays, with null component. Rows that repeat an id are joined by it. Texts
are used whole, however long; a sketch has the same size for all. An empty table
gives no rows. Columns other than key and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import U64, bytes_of, cut, mix, pieces, settled, spaced_words, word_hashes

WIDTH, PERCENT = 5, 75
PASSES, BUCKETS, BAND = 16, 16, 4
LEADING, MANTISSA = 6, 10
EMPTY = 0xFFFF
#: Pairs with an estimate below this are not confirmed: over six standard errors of 256 registers from 0.75.
LEAST_ESTIMATE = 0.57
#: Registers of the finer sketch that pairs beyond the stars must pass, and its least estimate (five standard errors).
FINE_BITS = 10
FINE, LEAST_FINE = 1 << FINE_BITS, 0.68
#: A crowd's chunks have CHUNK rows, more if they were over SIDE, but MOST_ROWS and MOST_BYTES of text at most: what a task holds.
CHUNK, SIDE, MOST_ROWS, MOST_BYTES = 256, 16, 2048, 16 << 20
LOT_ROWS = 1000
ROUNDS = 40
#: Keys that pick rows are broadcast up to this number. Beyond it a filter of a bit for each is, and only rows that pass it are shuffled to the keys.
BROADCAST_IDS = 500_000
#: A filter's bits for each key, at least, and its most bits: as joined words, and as an array in Python for bands (16 MB). A filter that is full lets more rows pass, none less.
KEY_BITS, JOINED_BITS, BAND_BITS = 16, 1 << 25, 1 << 27
#: A key of more than HOT rows may be hot; HOT_KEYS keys are treated so at most.
HOT, HOT_KEYS = 256, 100_000
#: Pairs that meet one copy of a hot text.
PAIRS_A_TEXT = 64


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = spaced_words(text)
    if not words:
        return np.empty(0, U64)
    number: dict[bytes, int] = {}
    line = np.fromiter([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    h = word_hashes(list(number))[line]
    if len(words) < width:  # a shingle of another length never equals one of the full length
        return mix(np.array([np.bitwise_xor.reduce(mix(h + U64(0x9E3779B97F4A7C15) * np.arange(1, len(h) + 1, dtype=U64)))], U64) + U64(len(h)))
    n = len(h) - width + 1
    out = np.zeros(n, U64)
    for k in range(width):
        out = mix(out + h[k : k + n])
    return np.unique(out)


_PASS = mix(np.arange(1, PASSES + 1, dtype=U64) * U64(0xD6E8FEB86659FD93))
_BOUNDS = np.arange(BUCKETS, dtype=U64) << U64(60)


def sketch(own: np.ndarray) -> np.ndarray:
    """Registers of a set, [pass, bucket]."""
    out = np.full((PASSES, BUCKETS), EMPTY, np.uint16)
    for p in range(PASSES):
        h = np.sort(mix(own ^ _PASS[p]))
        at = np.searchsorted(h, _BOUNDS)
        full = at < np.append(at[1:], len(h))
        low = h[at[full]] & U64((1 << 60) - 1)
        top = 60 - np.frexp(low.astype(np.float64))[1]  # leading zeros of 60 bits
        top = np.minimum(top, (1 << LEADING) - 2)
        rest = (low << (top + 5).astype(U64)) >> U64(64 - MANTISSA)  # the bits behind the leading one
        out[p, full] = (top.astype(np.uint16) << MANTISSA) | rest.astype(np.uint16)
    return out


def fine_sketch(own: np.ndarray) -> np.ndarray:
    """FINE registers of one pass, by the set's own hashes: nearly the set itself if that is small."""
    out = np.full(FINE, EMPTY, np.uint16)
    at = np.searchsorted(own, np.arange(FINE, dtype=U64) << U64(64 - FINE_BITS))
    full = at < np.append(at[1:], len(own))
    low = own[at[full]] & U64((1 << (64 - FINE_BITS)) - 1)
    top = np.minimum(64 - FINE_BITS - np.frexp(low.astype(np.float64))[1], (1 << LEADING) - 2)
    rest = (low << (top + FINE_BITS + 1).astype(U64)) >> U64(64 - MANTISSA)
    out[full] = (top.astype(np.uint16) << MANTISSA) | rest.astype(np.uint16)
    return out


def bands(registers: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands that aren't all empty."""
    grouped = registers.reshape(PASSES // BAND, BAND, BUCKETS).transpose(0, 2, 1).reshape(-1, BAND)
    keys = grouped.astype(U64) @ (U64(1) << (np.arange(BAND, dtype=U64) * U64(16)))
    keys = mix(mix(keys) + np.arange(1, len(keys) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return keys[(grouped != EMPTY).any(axis=1)]


# Fixed value: HyperMinHash's expected share of colliding registers (Yu & Weber), for sets of equal size, before the mantissa halves it bit by bit.
COLLISIONS = 0.169919487159739093975315012348


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that registers of unlike minima agree, for sets of n and m shingles: the mantissa's bits, less where the sizes differ."""
    ratio = np.maximum(n, 1) / np.maximum(m, 1)
    return COLLISIONS * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers of sets with n and m shingles, corrected for collisions; buckets empty on both sides tell nothing."""
    used = (a != EMPTY) | (b != EMPTY)
    agree = ((a == b) & used).sum(axis=-1) / np.maximum(used.sum(axis=-1), 1)
    chance = collisions(n, m)
    return (agree - chance) / (1 - chance)


def meet(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with table, which has a row for each key and, as n, the key's number of rows; total: an upper bound of all rows.

    Keys of more than a HOT_KEYS-th of the rows (and of HOT) are HOT_KEYS at most:
    they are broadcast, and their rows stay spread. The others are shuffled.
    """
    bound, others = max(HOT, total // HOT_KEYS), [c for c in table.columns if c != key]
    spread = F.xxhash64(*rows.columns)  # no key, or a key by a rare chance that changes nothing
    if rows.schema[key].dataType.simpleString() != "bigint":
        spread = spread.cast("string").cast(rows.schema[key].dataType)
    hot = table.where(F.col("n") > bound).select(key, F.struct(*others).alias("__hot"))
    cold = table.where(F.col("n") <= bound).select(F.col(key).alias("__at"), F.struct(*others).alias("__cold"))
    marked = rows.join(F.broadcast(hot), key, "left").withColumn("__at", F.when(F.col("__hot").isNull(), F.col(key)).otherwise(spread))
    met = marked.join(cold, "__at", "left").withColumn("__found", F.coalesce("__hot", "__cold")).where("__found is not null")
    return met.select(*rows.columns, *(F.col("__found")[c].alias(c) for c in others))


def filter_words(keys: DataFrame, at, size: int) -> DataFrame:
    """word, bits: 64-bit words of a filter of size bits (a power of two) in which those at a key's hash are set."""
    places = keys.select(at.bitwiseAND(F.lit(size - 1)).alias("at"))
    return places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))


def filter_size(keys: int, most: int) -> int:
    return min(most, 1 << max(6, (KEY_BITS * keys - 1).bit_length()))


def marked(rows: DataFrame, keys: DataFrame, on: list[str], n: int) -> DataFrame:
    """rows with maybe: true if on is among the n keys, and for few others, by a filter that is broadcast."""
    size, key = filter_size(n, JOINED_BITS), F.xxhash64(*on)
    words = filter_words(keys, key, size)
    placed = rows.withColumn("word", F.shiftright(key.bitwiseAND(F.lit(size - 1)), 6)).join(F.broadcast(words), "word", "left")
    bit = F.expr(f"coalesce(shiftright(bits, cast(xxhash64({', '.join(on)}) & 63 as int)) & 1, 0) = 1")
    return placed.select(*rows.columns, bit.alias("maybe"))


def among(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """rows joined with distinct keys, left_semi or left_anti; of many keys, only rows that a filter lets pass are shuffled."""
    n = keys.count()
    if n <= BROADCAST_IDS:
        return rows.join(F.broadcast(keys), on, how)
    sorted_out = marked(rows, keys, on, n)
    met = sorted_out.where("maybe").drop("maybe").join(keys, on, how).select(*rows.columns)
    return met if how == "left_semi" else met.unionByName(sorted_out.where("not maybe").drop("maybe"))


def band_filter(crowds: DataFrame) -> np.ndarray:
    """Words of a filter of the bands of crowds."""
    size = filter_size(crowds.count(), BAND_BITS)
    got = filter_words(crowds, F.col("band"), size).toArrow()
    out = np.zeros(size >> 6, U64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(U64)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """id, n_shingles, set_key (128 bits of the whole set) and registers. docs: id, t."""
    def work(batches):
        for b in pieces(batches):
            out = []
            for text in b.column(1).to_pylist():
                own = shingles(text)
                key = np.array([np.add.reduce(mix(own)), np.bitwise_xor.reduce(mix(own + U64(77)))], U64).tobytes()
                out.append((len(own), key, sketch(own).tobytes()) if len(own) else (0, None, None))
            n, key, r = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(r, pa.binary())], ["id", "n_shingles", "set_key", "registers"])

    return docs.select("id", "t").mapInArrow(work, "id bigint, n_shingles bigint, set_key binary, registers binary")


def banded(holders: DataFrame, held=None) -> DataFrame:
    """band, id: a row for each band of each holder; held: a broadcast filter, whose bands (and others by chance) are all that is wanted."""

    def passing(keys):
        if held is None:
            return keys
        at = keys & U64(64 * len(held.value) - 1)
        return keys[(held.value[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1]

    def work(batches):
        for b in pieces(batches):
            keys = [passing(bands(np.frombuffer(x, np.uint16).reshape(PASSES, BUCKETS))) for x in b.column(1).to_pylist()]
            ids = np.repeat(b.column(0).to_numpy(), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, U64), *keys]).view(np.int64)), pa.array(ids, pa.int64())], ["band", "id"])

    return holders.select("id", "registers").mapInArrow(work, "band bigint, id bigint")


def likely(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, registers of both as ra, rb, sizes na, nb) that pass the size bound and the estimate."""

    def work(batches):
        for b in pieces(batches):
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(b.num_rows, -1) for k in (2, 3))
                b = b.filter(pa.array(estimate(x, y, b.column(4).to_numpy(), b.column(5).to_numpy()) >= LEAST_ESTIMATE))
            yield b.select([0, 1])

    sized = pairs.where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
    return sized.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(work, "a bigint, b bigint")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles are similar enough."""
    return PERCENT * (len(a) + len(b)) <= (100 + PERCENT) * len(np.intersect1d(a, b, assume_unique=True))


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b) those whose full sets are similar enough.

    Only texts of candidates move. A text that is in many pairs is the first of
    each; it goes, once for every PAIRS_A_TEXT of them, before the others' texts
    in the order of one partition, and sets are rebuilt where they meet.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    total = 2 * pairs.count()
    hot = ends.where(F.col("n") > max(HOT, total // HOT_KEYS))  # HOT_KEYS ids at most
    known = lambda c: F.broadcast(hot.select(F.col("id").alias(c), F.ceil(F.col("n") / PAIRS_A_TEXT).cast("int").alias(f"parts_{c}")))
    marked = pairs.join(known("a"), "a", "left").join(known("b"), "b", "left")
    swap = F.coalesce("parts_b", F.lit(1)) > F.coalesce("parts_a", F.lit(1))
    ordered = marked.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), F.greatest(F.coalesce("parts_a", F.lit(1)), F.coalesce("parts_b", F.lit(1))).alias("parts"))
    ordered = cut(ordered.select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")), "near_pairs")

    def work(batches):
        at, own, other = None, [], (None, None)
        for batch in pieces(batches, 64):
            a, part, b, texts = (batch.column(k) for k in range(4))
            keep = []
            for i in range(batch.num_rows):
                here, text = (a[i].as_py(), part[i].as_py()), texts[i].as_py()
                if not b[i].is_valid:  # the first text of the pairs that follow; several if its id is repeated
                    own = [*own, shingles(text)] if here == at else [shingles(text)]
                    at = here
                    keep.append(False)
                    continue
                if text != other[0]:
                    other = text, shingles(text)
                keep.append(here == at and any(alike(x, other[1]) for x in own))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            left, right = kept.column(0).to_numpy(), kept.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], ["a", "b"])

    texts = docs.select("id", "t")
    first = ordered.select("a", "part").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", "part", F.lit(None).cast("bigint").alias("b"), "t")
    second = ordered.join(texts.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "t")
    met = first.unionByName(second).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return met.mapInArrow(work, "a bigint, b bigint")  # pairs of a repeated id may come more than once


def with_least(rows: DataFrame, total: int) -> DataFrame:
    """rows (u, v) with m, the least v of u."""
    return meet(rows, rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "u", total).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every linked id, by rounds of large-star and small-star.

    Every round's links are written to the shared folder; each is at most as many
    rows as before it. Hubs are no hot keys: see meet().
    """
    now = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    for _ in range(ROUNDS):
        total = 2 * now.count()
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(with_least(both, total).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "links")
        small_star = with_least(large, total).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = cut(small_star.where("u != v").distinct(), "links")
        # stars only, and each hub is nobody's leaf: done
        leaves = now.groupBy("u").count()
        hubs = now.select("v").distinct()
        if not (leaves.where("count > 1").limit(1).count() or hubs.join(leaves, F.col("v") == F.col("u"), "left_semi").limit(1).count()):
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(hubs.select(F.col("v").alias("id"), F.col("v").alias("component")))
    raise RuntimeError(f"components not settled after {ROUNDS} rounds")


def mixed_links(bands_: DataFrame, holders: DataFrame, of: DataFrame) -> DataFrame:
    """Links (a, b) that join the components of rows that share a band: a forest in each lot. holders: id, n_shingles, registers, t, bytes.

    Each band has a home, its largest component. Bands of one home are searched
    together, so a pair that shares many bands is looked at once. All rows of a
    home stay in chunks; those outside its component visit in chunks of their
    own. A cell is a chunk that stays and one that visits, so a task's rows and
    bytes are bounded however large the crowd is; rows of the component itself
    never visit, as they need no look among themselves. A row comes to SIDE + 1
    cells or so in each direction, or to one for every MOST_ROWS (MOST_BYTES) of
    a crowd beyond SIDE of them.

    Pairs are looked at and confirmed inside a cell and never become rows; finer
    sketches are made there too, of the texts that come so far. Those
    of components that a link of the lot has joined need no look, so a lot gives
    fewer links than it has rows, whatever the number of pairs.
    """
    named = bands_.join(of, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    sizes = named.groupBy("band", "component").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("band").agg(F.count("*").alias("parts"), F.max(F.struct("k", "component"))["component"].alias("home"), F.sum("k").alias("n")).where("parts > 1")
    total = bands_.count()
    rows = meet(named, mixed, "band", total).select("home", "id", "component").distinct()
    rows = cut(rows.join(holders.groupBy("id").agg(F.sum("bytes").alias("bytes")), "id").select("home", "id", "component", "bytes"), "near_homes")
    guest = F.col("component") != F.col("home")
    crowd = rows.groupBy("home").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), F.count_if(guest).alias("gn"), F.sum(F.when(guest, F.col("bytes"))).alias("gb"))
    chunk = F.greatest(F.lit(CHUNK), F.least(F.col("n") / SIDE, F.lit(MOST_ROWS)))
    chunks = lambda n, b: F.ceil(F.greatest(F.col(n) / chunk, F.col(b) / MOST_BYTES)).cast("int")
    crowd = crowd.select("home", chunks("n", "b").alias("stays"), chunks("gn", "gb").alias("visits"), "n")
    rows = meet(rows, cut(crowd, "near_crowds"), "home", total).withColumn("h", F.xxhash64("id"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stay = rows.select("home", "id", "component", "bytes", F.lit(False).alias("visiting"), F.pmod("h", F.col("stays")).cast("int").alias("i"), every("visits").alias("j"))
    visit = rows.where(guest).select("home", "id", "component", "bytes", F.lit(True).alias("visiting"), every("stays").alias("i"), F.pmod("h", F.col("visits")).cast("int").alias("j"))
    cells = cut(stay.unionByName(visit), "near_cells")
    n, heavy = cells.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    lots = max(256, n // LOT_ROWS, heavy // MOST_BYTES)
    cells = cells.withColumn("lot", F.pmod(F.xxhash64("home", "i", "j"), F.lit(lots)).cast("int")).drop("bytes").join(holders.drop("bytes"), "id")

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        homes, i, j, ids, comps, sizes_ = (table.column(c).to_numpy() for c in ("home", "i", "j", "id", "component", "n_shingles"))
        visiting = table.column("visiting").to_numpy(zero_copy_only=False).astype(bool)
        regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(len(ids), -1)
        order = np.lexsort((ids, j, i, homes))
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.any([np.diff(x[order]) != 0 for x in (homes, i, j)], axis=0)
        edges, links, now = np.append(np.flatnonzero(new), len(order)), [], comps.copy()  # now: components as the links join them
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            cell, sets, sketched = order[lo:hi], {}, {}

            def full(at, sets=sets):
                if at not in sets:
                    sets[at] = shingles(table.column("t")[int(at)].as_py())
                return sets[at]

            def fine(at, sketched=sketched, full=full):
                if at not in sketched:
                    sketched[at] = fine_sketch(full(at))
                return sketched[at]

            own = cell[~visiting[cell]]
            settled = comps[own] == homes[own]
            for a in cell[visiting[cell]]:
                at = own[(now[own] != now[a]) & (settled | (ids[own] < ids[a])) & (100 * np.minimum(sizes_[own], sizes_[a]) >= PERCENT * np.maximum(sizes_[own], sizes_[a]))]
                if len(at):
                    at = at[estimate(regs[at], regs[a][None, :], sizes_[at], sizes_[a]) >= LEAST_ESTIMATE]
                if len(at):
                    near = estimate(np.stack([fine(x) for x in at]), fine(a)[None, :], sizes_[at], sizes_[a])
                    best = np.argsort(-near, kind="stable")
                    for x in at[best[: np.count_nonzero(near >= LEAST_FINE)]]:
                        if now[x] != now[a] and alike(full(x), full(a)):
                            links.append((min(ids[a], ids[x]), max(ids[a], ids[x])))
                            now[now == now[a]] = now[x]
        pairs = np.array(links, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return cells.groupBy("lot").applyInArrow(compare, "a bigint, b bigint").distinct()


def groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id and kept of every row; key must be an integer."""
    docs = df.select(F.col(key).cast("bigint").alias("id"), bytes_of(text).alias("t"))
    every = cut(sketches(docs), "near_sketches")
    sets = every.where("id is not null and set_key is not null")
    total = sets.count()
    owners = cut(sets.groupBy("set_key").agg(F.min("id").alias("holder"), F.count("*").alias("n")), "near_sets")
    # rows of sets held by several rows; all others hold their own
    copies = meet(sets.select("id", "set_key"), owners.where("n > 1"), "set_key", total).where("id != holder").select("id", "set_key", "holder").distinct()
    copies = cut(copies, "near_copies")
    # a repeated id may hold other sets than those it copies
    holders = among(sets, copies.select("id", "set_key"), ["id", "set_key"], "left_anti").select("id", "registers")
    crowds = cut(banded(holders).groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "near_shared")
    held = docs.sparkSession.sparkContext.broadcast(band_filter(crowds))
    shared = cut(meet(banded(holders, held), crowds, "band", total * PASSES * BUCKETS // BAND), "near_bands")
    held.destroy()
    # a text that others were made from shares more bands with them than they share: it makes the better hub
    degree = cut(shared.groupBy("id").agg(F.sum("n").alias("degree")), "near_degrees")
    best = F.max(F.struct("degree", (-F.col("id")).alias("id")))["id"]
    hubs = shared.join(degree, "id").groupBy("band").agg((-best).alias("hub"), F.min("id").alias("low"), F.count("*").alias("n"))
    active = cut(shared.select("id").distinct(), "near_active")
    sizes = cut(among(sets.select("id", "n_shingles", "registers"), active, ["id"], "left_semi").dropDuplicates(["id", "registers"]), "near_active_sketches")
    whole = cut(among(docs, active, ["id"], "left_semi").dropDuplicates(["id", "t"]).withColumn("bytes", F.octet_length("t").cast("bigint")), "near_active_texts")
    spokes = meet(shared.select("band", "id"), cut(hubs, "near_hubs"), "band", shared.count()).select("id", F.explode(F.array("hub", "low")).alias("hub")).where("id != hub")
    stars = spokes.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    stars = stars.join(sizes.toDF("b", "nb", "rb"), "b").join(sizes.toDF("a", "na", "ra"), "a")
    stars = cut(likely(stars), "near_stars")
    links = cut(confirmed(stars, whole), "near_links")
    same = copies.select(F.col("holder").alias("a"), F.col("id").alias("b")).distinct()
    first = settled(lambda: components(links), "near_first")
    more = cut(mixed_links(shared.select("band", "id"), sizes.join(whole, "id"), first), "near_mixed")
    found = settled(lambda: components(links.unionByName(more).unionByName(same)), "near_found")
    rows = every.select("id", "n_shingles")
    component = F.coalesce("component", "id")
    linked = rows.where("id is not null").join(found, "id", "left").select("id", "n_shingles", component.alias("component_id"), (F.col("id") == component).alias("kept"))
    alone = rows.where("id is null").select("id", "n_shingles", F.lit(None).cast("bigint").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone).withColumnRenamed("id", key)
