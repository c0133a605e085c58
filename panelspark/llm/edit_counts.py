"""Edit-aware token counts: a segment tree over pre-tokens for each document.

Leaves hold runs of pre-tokens with their characters and tokens; inner nodes
hold sums. An edit (from, to, new text) descends by characters to the leaves it
touches. From there the edited text is split anew, until a new pre-token ends
where an old one ended behind the edit: from that point on the old pre-tokens
hold, as a match depends on the text from its start on alone (a pattern with
look-behind is refused). Only the pre-tokens in between are encoded; sums of the
changed leaves and their ancestors are updated. A text is put together once for
all its edits.

Splitting starts before the edit, as a match may look ahead: over the spaces
right before the edit, however many, and CONTEXT characters more. That is enough
for patterns whose matches look no further ahead than a run of spaces and
CONTEXT characters, as those of public tokenizers do.

trees() keeps a document's tree as a row, edited() applies edits to such rows: a
later edit again encodes its own region alone, and a document without edits is
passed on as it is. edited_counts() does both at once, and counts documents
without edits without a tree.

Edits are (from, to, new) over the text's characters, in ascending order and
without overlap; others raise. Null text counts as empty, a null list of edits as
none. A null key is carried through and meets no edits. Texts are counted whole.
Rows that repeat give equal rows, each with the edits of its key; keys of edits
must not repeat. An empty table gives an empty table. Columns other than key,
text and edits are not read. Only the join with edits shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import Codec, codec
from .util import pieces

CONTEXT, LEAF = 4, 64
Edit = tuple[int, int, str]

#: What the query's edits mask: mail addresses, key-like assignments, long digit runs. Each is found by its rare part first, then matched backwards from there, as far as it goes.
HOST, MAILBOX = regex.compile(r"@[\w-]+(?:\.[\w-]+)+"), regex.compile(r"(?r)[\w.+-]+")
VALUE, NAME = regex.compile(r"=\s*\"?[\w-]{8,}\"?"), regex.compile(r"(?r)(?i:token|key|secret|password)\s*")
DIGITS = regex.compile(r"\d[\d -]{7,}\d")
MASK = "[masked]"


class TokenTree:
    """Sums over leaves of (characters, tokens); leaves: lists of (characters, tokens) of pre-tokens."""

    def __init__(self, text: str, own: Codec, pieces: list[tuple[int, int]] | None = None) -> None:
        """pieces: those of the text, if they are known; else they are made."""
        if regex.search(r"\(\?<[=!]", own.pattern.pattern):
            raise ValueError("patterns with look-behind can't be split from the middle")
        self.text, self.own, self.encoded = text, own, 0
        self._build([(len(p), self._tokens(p)) for p in own.pattern.findall(text)] if pieces is None else pieces)

    def _tokens(self, piece: str) -> int:
        self.encoded += 1
        return len(self.own.packed(piece)) // 4

    def _build(self, pieces: list[tuple[int, int]]) -> None:
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = [(0, 0)] * (2 * self.width)
        for i, leaf in enumerate(self.leaves):
            self.sums[self.width + i] = (sum(p[0] for p in leaf), sum(p[1] for p in leaf))
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, node: int) -> None:
        a, b = self.sums[2 * node], self.sums[2 * node + 1]
        self.sums[node] = (a[0] + b[0], a[1] + b[1])

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    @property
    def pieces(self) -> int:
        return sum(map(len, self.leaves))

    def packed(self) -> bytes:
        """Characters and tokens of every pre-token, as little-endian unsigned 32-bit integers."""
        return np.array([p for leaf in self.leaves for p in leaf], "<u4").tobytes()

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at`, and where the leaf starts."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at - start >= self.sums[node][0] and self.sums[node + 1][0]:
                start += self.sums[node][0]
                node += 1
        return node - self.width, start

    def _set(self, i: int, leaf: list[tuple[int, int]]) -> None:
        self.leaves[i] = leaf
        node = self.width + i
        self.sums[node] = (sum(p[0] for p in leaf), sum(p[1] for p in leaf))
        while node > 1:
            node //= 2
            self._sum(node)

    def edit(self, start: int, end: int, new: str) -> None:
        """Characters start to end - 1 become new."""
        self.apply([(start, end, new)])

    def apply(self, edits: list[Edit]) -> None:
        """All edits, which count characters of the text as it is before them."""
        last, parts = 0, []
        for start, end, new in edits:
            if not last <= start <= end <= len(self.text):
                raise ValueError(f"edits must ascend, not overlap and lie in the text: {start}, {end}")
            parts += self.text[last:start], new
            last = end
        self.text = "".join([*parts, self.text[last:]])
        # places are those of the text in which the edits up to k - 1 are done, and `shift` longer than before them
        k = shift = 0
        while k < len(edits):
            k, by = self._region(edits, k, shift)
            shift += by

    def _region(self, edits: list[Edit], k: int, shift: int) -> tuple[int, int]:
        """Edit k, and those that follow before old and new pre-tokens meet again; the next edit and the growth in length."""
        text, (start, end, new) = self.text, edits[k]
        start, end, by, k = start + shift, end + shift, len(new) - (end - start), k + 1
        safe = start
        while safe and text[safe - 1].isspace():
            safe -= 1
        safe = max(0, safe - CONTEXT)
        i, at = self._find(safe)
        kept, n = [], 0
        while n < len(self.leaves[i]) and at + self.leaves[i][n][0] <= safe:
            kept.append(self.leaves[i][n])
            at += self.leaves[i][n][0]
            n += 1
        # old pre-tokens from here on: (leaf j, index n); `old` is where they end without the region's edits
        j, old, fresh, met = i, at, [], False
        for match in self.own.pattern.finditer(text, at) if at < len(text) else ():
            pos = match.end()
            fresh.append((pos - match.start(), self._tokens(match[0])))
            while k < len(edits) and edits[k][0] + shift + by < pos:  # the new pre-token reaches into the next edit
                end = edits[k][1] + shift
                by += len(edits[k][2]) - (edits[k][1] - edits[k][0])
                k += 1
            while j < len(self.leaves) and (old < end or old + by < pos):
                if n < len(self.leaves[j]):
                    old += self.leaves[j][n][0]
                    n += 1
                else:
                    j, n = j + 1, 0
            if old >= end and old + by == pos and (k == len(edits) or old <= edits[k][0] + shift):
                met = True
                break
        if not met:
            j, n, k = len(self.leaves), 0, len(edits)
        rest = self.leaves[j][n:] if j < len(self.leaves) else []
        for between in range(i + 1, min(j + 1, len(self.leaves))):
            self._set(between, [])
        whole = kept + fresh + rest
        if len(whole) > 4 * LEAF:
            self.leaves[i] = whole
            self._build([p for leaf in self.leaves for p in leaf])
        else:
            self._set(i, whole)
        return k, by


def masking(text: str) -> list[Edit]:
    """Edits that mask personal data and secrets; of overlapping finds, one edit over all of them."""
    found = [m.span() for m in DIGITS.finditer(text)]
    for sign, right, left in (("@", HOST, MAILBOX), ("=", VALUE, NAME)):
        if sign in text:
            for m in right.finditer(text):
                if head := left.match(text, 0, m.start()):
                    found.append((head.start(), m.end()))
    out: list[Edit] = []
    for start, end in sorted(found):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), MASK)
        else:
            out.append((start, end, MASK))
    return out


def recount(text: str, edits: list[Edit], own: Codec) -> tuple[int, int, int, int]:
    """Tokens before, tokens after, pre-tokens after, pre-tokens that the edits encoded anew."""
    if not edits:
        n = sum(len(run) // 4 for run in own.runs(text))
        return n, n, sum(1 for _ in own.pattern.finditer(text)), 0
    tree = TokenTree(text, own)
    before, tree.encoded = tree.tokens, 0
    tree.apply(edits)
    return before, tree.tokens, tree.pieces, tree.encoded


def edited_counts(df: DataFrame, path: str, pattern: str, edits_of: Callable[[str], list[Edit]] = masking, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_edits, tokens_before, n_tokens (after) and n_recoded (pre-tokens encoded for the edits) of every row."""
    def work(batches):
        own = codec(path, pattern)
        for b in pieces(batches):
            rows = []
            for x in b.column(1).to_pylist():
                edits = edits_of(x)
                if edits:
                    before, after, _, anew = recount(x, edits, own)
                else:
                    before = after = sum(len(run) // 4 for run in own.runs(x))
                    anew = 0
                rows.append((len(edits), before, after, anew))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), pa.int64()) for c in columns)], ["k", "n_edits", "tokens_before", "n_tokens", "n_recoded"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(work, f"k {kind}, n_edits bigint, tokens_before bigint, n_tokens bigint, n_recoded bigint").withColumnRenamed("k", key)


EDITS = "array<struct<from:int,to:int,new:string>>"


def trees(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, pieces (TokenTree.packed) and n_tokens of every row: what edited() goes on from."""
    def work(batches):
        own = codec(path, pattern)
        for b in pieces(batches):
            made = [TokenTree(x, own) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t.packed() for t in made], pa.binary()), pa.array([t.tokens for t in made], pa.int64())], ["k", "text", "pieces", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(work, f"k {kind}, text string, pieces binary, n_tokens bigint").withColumnRenamed("k", key)


def edited(kept: DataFrame, edits: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """The rows of trees() after the edits (key, edits as EDITS) of their keys, with tokens_before, n_edits and n_recoded."""
    def work(batches):
        own = codec(path, pattern)
        for b in pieces(batches):
            rows = []
            for text, packed, n, todo in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                if not todo:
                    rows.append((text, packed, n, n, 0, 0))
                    continue
                tree = TokenTree(text, own, list(map(tuple, np.frombuffer(packed, "<u4").reshape(-1, 2).tolist())))
                tree.apply([(e["from"], e["to"], e["new"]) for e in todo])
                rows.append((tree.text, tree.packed(), tree.tokens, n, len(todo), tree.encoded))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.binary(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], ["k", "text", "pieces", "n_tokens", "tokens_before", "n_edits", "n_recoded"])

    kind = kept.schema[key].dataType.simpleString()
    todo = edits.select(F.col(key).alias("k"), F.col("edits").cast(EDITS).alias("edits"))
    rows = kept.select(F.col(key).alias("k"), "text", "pieces", "n_tokens").join(todo, "k", "left")
    return rows.mapInArrow(work, f"k {kind}, text string, pieces binary, n_tokens bigint, tokens_before bigint, n_edits bigint, n_recoded bigint").withColumnRenamed("k", key)
