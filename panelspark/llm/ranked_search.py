"""Ranked lexical search over dual-sorted wavelet trees, one a shard of documents.

A shard's postings stand term by term, each term's by falling impact. A wavelet
tree over their document numbers halves the documents level by level and keeps
that order, so within any node a term is one interval whose first posting has the
largest impact there: the tree is sorted by impact and navigable by document at
once. The sum of an item's first impacts bounds every document below a node.

Nodes are taken best bound first, for all items of a shard together: each round
opens an item's better half of open nodes (BEAM at least) in vector steps. A
leaf is one document and its bound is the score. What cannot beat an item's
k-th best (by score, then smaller doc_id) is dropped; bests go from shard to
shard of a task. Every task gives its k best per item, and a window over those
gives the k best of all: exact, no posting is shuffled.

Documents are dealt to shards as they are scanned, SHARD_DOCS or SHARD_POSTINGS
at most, and numbered within it so that like documents (by language and length)
stand together, which tightens bounds. Only terms of the items are indexed. Two
scans: the first counts documents, terms and each term's documents. Items go in
blocks of about ITEM_BYTES of text, a block at a time through the driver.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters; A-Z
are lower-cased. Null text has none. Null doc_id counts, and ranks last among
ties; rows that repeat an id are documents of their own. An item is a distinct
row (item_id, text); null item_id is kept. Texts are taken whole. Empty tables
give an empty result. Columns other than ids and texts are not read.
"""

from __future__ import annotations

import math
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import bytes_of, cut, pieces

K = 10
SHARD_DOCS, SHARD_POSTINGS = 1 << 13, 1 << 20
ITEM_BYTES = 1 << 20
BEAM, ITEMS_AT_ONCE = 16, 32
NULL = np.iinfo(np.int64).max
_TERM = bytes(c if c >= 0x80 or bytes([c]).isalnum() else 0x20 for c in range(256)).lower()


def terms(data: bytes) -> list[bytes]:
    return data.translate(_TERM).split()


def _ranks(groups: np.ndarray) -> np.ndarray:
    """Places 0, 1, ... within each stretch of equal groups."""
    first = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))) if len(groups) else np.zeros(0, int)
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups))))


class Best:
    """The k best (score, then smaller id) of each item so far."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k = k
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.least, self.last = np.zeros(n_items, np.int64), np.full(n_items, -NULL)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = np.append(self.item, item), np.append(self.score, score), np.append(self.doc, doc)
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        place = _ranks(item)
        keep = place < self.k
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]
        full = place == self.k - 1
        self.least[item[full]], self.last[item[full]] = score[full], doc[full]

    def hopeless(self, item: np.ndarray, bound: np.ndarray, smallest: np.ndarray) -> np.ndarray:
        """Nodes below which nothing can enter; smallest: the smallest id below."""
        return (bound < self.least[item]) | ((bound == self.least[item]) & (smallest >= self.last[item]))


class Shard:
    """The wavelet tree of a shard, level by level: bitmaps, ranks of ones, and the postings' impacts in each level's order."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, ids: np.ndarray, n_terms: int) -> None:
        """doc: numbers 0 to len(ids) - 1 of the postings' documents; a document holds a term once."""
        order = np.lexsort((doc, -impact, term))
        doc, impact = doc[order], impact[order].astype(np.int32)
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.depth = max(1, (len(ids) - 1).bit_length())
        n = len(doc)
        self.width = n // 64 + 1
        self.bits = np.zeros((self.depth, self.width), np.uint64)
        self.ones = np.zeros((self.depth, self.width), np.int64)
        self.zeros = np.zeros(self.depth, np.int64)
        self.impact = np.zeros((self.depth + 1, max(1, n)), np.int32)
        for k in range(self.depth):
            self.impact[k, :n] = impact
            bit = (doc >> (self.depth - 1 - k)) & 1 == 1
            raw = np.packbits(bit, bitorder="little").tobytes()
            self.bits[k] = np.frombuffer(raw + bytes(self.width * 8 - len(raw)), "<u8")
            counts = np.bitwise_count(self.bits[k]).astype(np.int64)
            self.ones[k, 1:] = np.cumsum(counts)[:-1]
            self.zeros[k] = n - int(bit.sum())
            doc, impact = np.concatenate((doc[~bit], doc[bit])), np.concatenate((impact[~bit], impact[bit]))
        self.impact[self.depth, :n] = impact
        self.ids = np.append(ids, np.full((1 << self.depth) - len(ids), NULL))
        self.smallest = np.concatenate([self.ids.reshape(1 << k, -1).min(1) for k in range(self.depth + 1)])
        self.opened = 0

    def _rank(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ones before a place of a level."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[level, word] + np.bitwise_count(self.bits[level, word] & below)

    def search(self, item: np.ndarray, term: np.ndarray, weight: np.ndarray, best: Best) -> None:
        """Adds to best what the shard has for the items; item, term, weight: one element a term of an item, in the order of items."""
        held = (self.start[term] < self.start[term + 1]) & (weight > 0)
        item, term, weight = item[held], term[held], weight[held]
        of = np.unique(item, return_inverse=True)
        nodes = {"item": of[0], "level": np.zeros(len(of[0]), np.int64), "prefix": np.zeros(len(of[0]), np.int64)}
        elements = {"node": of[1], "l": self.start[term], "r": self.start[term + 1], "w": weight}
        nodes["bound"] = self._bounds(nodes, elements)
        nodes, elements = self._promising(nodes, elements, best)
        while len(nodes["item"]):
            order = np.lexsort((-nodes["bound"], nodes["item"]))
            size = np.bincount(nodes["item"])
            taken = np.zeros(len(order), bool)
            taken[order] = _ranks(nodes["item"][order]) < np.maximum(BEAM, size // 2)[nodes["item"][order]]
            self.opened += int(taken.sum())
            below = self._children(nodes, elements, taken)
            leaf = below[0]["level"] == self.depth
            best.add(below[0]["item"][leaf], below[0]["bound"][leaf], self.ids[below[0]["prefix"][leaf]])
            parts = [self._only(nodes, elements, ~taken), self._only(*below, ~leaf)]
            shift = len(parts[0][0]["item"])
            parts[1][1]["node"] = parts[1][1]["node"] + shift
            nodes, elements = ({c: np.concatenate((a[c], b[c])) for c in a} for a, b in zip(*parts, strict=True))
            nodes, elements = self._promising(nodes, elements, best)

    def _bounds(self, nodes: dict, elements: dict) -> np.ndarray:
        largest = elements["w"] * self.impact[nodes["level"][elements["node"]], elements["l"]]
        return np.bincount(elements["node"], largest, len(nodes["item"])).astype(np.int64)  # below 2**53, so exact

    @staticmethod
    def _only(nodes: dict, elements: dict, keep: np.ndarray) -> tuple[dict, dict]:
        inside = keep[elements["node"]]
        number = np.cumsum(keep) - 1
        elements = {c: x[inside] for c, x in elements.items()}
        elements["node"] = number[elements["node"]]
        return {c: x[keep] for c, x in nodes.items()}, elements

    def _promising(self, nodes: dict, elements: dict, best: Best) -> tuple[dict, dict]:
        smallest = self.smallest[(1 << nodes["level"]) - 1 + nodes["prefix"]]
        keep = ~best.hopeless(nodes["item"], nodes["bound"], smallest)
        return (nodes, elements) if keep.all() else self._only(nodes, elements, keep)

    def _children(self, nodes: dict, elements: dict, taken: np.ndarray) -> tuple[dict, dict]:
        nodes, elements = self._only(nodes, elements, taken)
        level, n = nodes["level"][elements["node"]], len(nodes["item"])
        l1, r1 = self._rank(level, elements["l"]), self._rank(level, elements["r"])
        zeros = self.zeros[level]
        both = {
            "node": np.append(elements["node"], elements["node"] + n), "l": np.append(elements["l"] - l1, zeros + l1),
            "r": np.append(elements["r"] - r1, zeros + r1), "w": np.append(elements["w"], elements["w"]),
        }
        some = both["l"] < both["r"]
        both = {c: x[some] for c, x in both.items()}
        below = {"item": np.tile(nodes["item"], 2), "level": np.tile(nodes["level"] + 1, 2), "prefix": np.append(2 * nodes["prefix"], 2 * nodes["prefix"] + 1)}
        below["bound"] = self._bounds(below, both)
        return self._only(below, both, np.bincount(both["node"], minlength=2 * n) > 0)


def postings(texts: list[bytes], number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of terms of each text; of each numbered term in a text: the text, the term, how often."""
    found = [terms(x) for x in texts]
    lengths = np.array([len(x) for x in found], np.int64)
    codes = np.fromiter(map(number.get, chain.from_iterable(found), repeat(-1)), np.int64, int(lengths.sum()))
    at = np.repeat(np.arange(len(texts)), lengths)[codes >= 0]
    keys, tf = np.unique(at * max(1, len(number)) + codes[codes >= 0], return_counts=True)
    return lengths, keys // max(1, len(number)), keys % max(1, len(number)), tf


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - 90 + (90 * n * n_docs) // max(1, n_terms)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _statistics(docs: DataFrame, number: dict[bytes, int]) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, all their terms, and documents of each numbered term; a task sends a row a term."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def work(batches):
        own = shared.value
        total, held = np.zeros(2, np.int64), np.zeros(len(own), np.int64)
        for b in pieces(batches):
            lengths, _, term, _ = postings(b.column(0).to_pylist(), own)
            total += (lengths > 0).sum(), lengths.sum()
            held += np.bincount(term, minlength=len(own))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append([-1, -2], some)), pa.array(np.append(total, held[some]))], ["term", "n"])

    rows = docs.select(bytes_of("text")).mapInArrow(work, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    return found.pop(-1, 0), found.pop(-2, 0), found


def _block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """k best per item of a block (number, item_id, doc_id, score), by task."""
    rows = items.collect()
    words = [sorted(set(terms(bytes(r["text"])))) for r in rows]
    number = {t: i for i, t in enumerate(sorted(set().union(*words)))}
    n_docs, n_terms, df = _statistics(docs, number)
    weights = {i: weight(n_docs, d) for i, d in df.items()}
    flat = [(i, number[t], weights.get(number[t], 0)) for i, ts in enumerate(words) for t in ts]
    common = np.array(sorted(df, key=lambda i: (-df[i], i))[:12], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((number, np.array(flat, np.int64).reshape(-1, 3), common, pa.array([r["item_id"] for r in rows], pa.int64())))

    def work(batches):
        own, flat, common, names = shared.value
        best = Best(len(names), k)
        ids, lengths, doc, term, tf, held, size = [], [], [], [], [], 0, 0

        def finish():
            n, d, t, f = np.concatenate(lengths), np.concatenate(doc), np.concatenate(term), np.concatenate(tf)
            order = _alike(n, d, t, common)
            place = np.empty(len(n), np.int64)
            place[order] = np.arange(len(n))
            shard = Shard(place[d], t, impacts(f, n[d], n_docs, n_terms), np.concatenate(ids)[order], len(own))
            for i in range(0, len(names), ITEMS_AT_ONCE):
                part = flat[(flat[:, 0] >= i) & (flat[:, 0] < i + ITEMS_AT_ONCE)]
                shard.search(part[:, 0], part[:, 1], part[:, 2], best)

        for b in pieces(batches):
            n, d, t, f = postings(b.column(1).to_pylist(), own)
            for store, x in zip((ids, lengths, doc, term, tf), (b.column(0).fill_null(NULL).to_numpy(), n, d + held, t, f), strict=True):
                store.append(x)
            held, size = held + len(n), size + len(t)
            if held >= SHARD_DOCS or size >= SHARD_POSTINGS:
                finish()
                ids, lengths, doc, term, tf, held, size = [], [], [], [], [], 0, 0
        if held:
            finish()
        known = pa.array(best.doc, mask=best.doc == NULL)
        yield pa.RecordBatch.from_arrays([pa.array(best.item), names.take(pa.array(best.item)), known, pa.array(best.score)], ["item", "item_id", "doc_id", "score"])

    found = docs.mapInArrow(work, "item bigint, item_id bigint, doc_id bigint, score bigint")
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _alike(n: np.ndarray, doc: np.ndarray, term: np.ndarray, common: np.ndarray) -> np.ndarray:
    """An order of documents in which those that hold the same of the commonest terms stand together, then by length."""
    sign = np.zeros(len(n), np.int64)
    for i, t in enumerate(common):
        sign[doc[term == t]] |= 1 << (len(common) - 1 - i)
    return np.lexsort((n, sign))


def search(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score (above 0) of the k best documents of each item."""
    kind = "integer item and document ids"
    for df, c in ((docs, key), (items, item)):
        if df.schema[c].dataType.typeName() not in ("byte", "short", "integer", "long"):
            raise ValueError(f"{c}: the search takes {kind}")
    own = docs.select(F.col(key).cast("long").alias("doc_id"), bytes_of(text).alias("text"))
    asked = items.select(F.col(item).cast("long").alias("item_id"), bytes_of(item_text).alias("text")).distinct()
    size = asked.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // ITEM_BYTES))
    if blocks == 1:
        return _block(own, asked, k)
    out = None
    for i in range(blocks):
        part = cut(_block(own, asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i), k), "search")
        out = part if out is None else out.unionByName(part)
    return out
