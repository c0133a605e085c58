"""LM scoring by a weighted backoff automaton over counts of the whole corpus.

The model is a trigram one. States are the root, one for each training word (and
the text start), and one for each training word pair. A state has an arc for
every word that followed it in training, weighted with the smoothed log10
P(word | state), and a failure arc to the state without its first word (a pair
to its second word, a word to the root), weighted with log10 of its backoff.
The root has an arc for every word; unknown ones share the unknown word's
weight and lead back to the root. A text is read once from left to right: while
the state has no arc for the next word, follow failure arcs and add their
weights; then take the arc, add its weight and be in the state that it leads to,
the longest context that training knows. Smoothing is Dirichlet's, level by
level: P(w|uv) = (c(uvw) + MU P(w|v)) / (c(uv) + MU), likewise P(w|v) from P(w)
= (c(w) + 1) / (N + V + 1); a state's backoff is MU / (c(state) + MU). Each
sums to one over all words and the unknown one.

No model of the whole corpus is ever in one place. Texts are gathered, where
they are read, to blocks of about BLOCK_BYTES, and words become numbers there,
once. A block knows its distinct words, pairs and triples as sorted keys; it sends
keys and training counts, packed, to the shards that own the key ranges; a
shard sums the counts of equal keys over all blocks and returns each block its
sums in the order of its keys. So a block builds exactly the part of the
automaton that its texts can reach, traffic follows the input, and keys are
summed in the block before they move: a word that fills a third of the corpus
is one key a block, and a third of all rows being one text or id changes nothing.

Words are told apart by 64-bit hashes. Keys of pairs and triples are KEY_SPARE
bits wider than the corpus' size in bytes asks for, so a key that training
lacks is taken for another about once in 2 ** KEY_SPARE lookups.

Null text counts as empty (one end token). A null id is a row like any other.
Repeated rows count and are scored each time. Texts are read whole, a very long
one as a block of its own. With no training document N = V = 0 and every token
has probability 1 / (0 + 0 + 1). An empty table gives no rows. Other columns
than key and text are not looked at, whatever their names.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import U64, bytes_of, mix, repeatable, spaced_words, word_hashes

MU = 20.0
BLOCK_BYTES, MIN_SHARDS = 8 << 20, 64
KEY_SPARE, KEY_BITS = 20, (40, 63)
#: A space can't be in a word, so these are no word's bytes. They are numbers 0 and 1 of every block.
END, START = b" end", b" start"
_ODD = U64(0x9E3779B97F4A7C15)


def planes(x: np.ndarray) -> bytes:
    """Integers by byte place, so that places of zeros compress away."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).reshape(-1)


_ZSTD = pa.Codec("zstd", 1)


def packed(*parts: bytes) -> bytes:
    """Byte strings as one, compressed one by one."""
    out = [np.array([len(parts), *map(len, parts)], np.int64).tobytes()]
    small = [_ZSTD.compress(p, asbytes=True) for p in parts]
    out.append(np.array(list(map(len, small)), np.int64).tobytes())
    return b"".join(out + small)


def unpacked(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, 2 * n, 8)
    at, out = 8 * (2 * n + 1), []
    for whole, small in zip(sizes[:n].tolist(), sizes[n:].tolist(), strict=True):
        out.append(_ZSTD.decompress(data[at : at + small], whole, asbytes=True) if whole else b"")
        at += small
    return out


def numbered(texts: list[bytes], train: list[bool]) -> bytes:
    """Texts as runs of word numbers with an end each, the words' hashes and who is trained on, packed."""
    number = {END: 0, START: 1}
    put, runs = number.setdefault, []
    for text in texts:
        runs.append(np.fromiter([*[put(w, len(number)) for w in spaced_words(text)], 0], dtype=np.uint32))
    hashes = word_hashes(list(number))
    del number, put
    lengths = np.array([len(r) for r in runs], dtype=np.uint32)
    return packed(planes(lengths), np.array(train, np.uint8).tobytes(), hashes.tobytes(), planes(np.concatenate(runs)))


class Block:
    """A block's n-grams: pairs and triples as distinct sorted numbers, the place of each token among them, and their keys."""

    def __init__(self, data: bytes, bits: int) -> None:
        lengths, train, hashes, line = unpacked(data)
        self.lengths = unplanes(lengths, np.uint32).astype(np.int64)
        self.word = unplanes(line, np.uint32).astype(np.int64)
        self.hashes = np.frombuffer(hashes, U64)
        self.words, n = len(self.hashes), len(self.word)
        first = np.cumsum(self.lengths) - self.lengths
        before = np.empty(n, np.int64)
        before[1:] = self.word[:-1]
        before[first] = 1
        self.pairs, self.pair_at = np.unique(before * self.words + self.word, return_inverse=True)
        # a text's first word follows no pair; its place among the triples is never read
        self.inner = np.ones(n, bool)
        self.inner[first] = False
        at = np.flatnonzero(self.inner)
        self.triples, self.triple_first, self.triple_at = np.unique(self.pair_at[at - 1] * self.words + self.word[at], return_index=True, return_inverse=True)
        self.triple_first = at[self.triple_first]
        self.trained = np.repeat(np.frombuffer(train, np.uint8), self.lengths)
        self.starts = int(np.frombuffer(train, np.uint8).sum())
        self.bits = bits

    def keyed(self) -> tuple[np.ndarray, np.ndarray]:
        """Order of the words by key, and of pairs and triples by key; sets word_keys and gram_keys."""
        own = (mix(self.hashes + U64(1)) & ~U64(1)) | U64(1)  # the lowest bit: a token
        own[1] &= ~U64(1)  # the start is a context but no token
        whole = mix(mix(self.hashes[self.pairs // self.words]) * _ODD + self.hashes[self.pairs % self.words])
        three = mix(mix(whole[self.triples // self.words] + U64(3)) * _ODD + self.hashes[self.triples % self.words])
        grams = np.concatenate([whole, three]) >> U64(64 - self.bits)
        del whole, three
        words, order = np.argsort(own, kind="stable"), np.argsort(grams, kind="stable")
        self.word_keys, self.gram_keys = own[words], grams[order]
        return words, order

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of words, and of pairs then triples."""
        weights = self.trained.astype(np.float64)
        single = np.bincount(self.word, weights=weights, minlength=self.words)
        single[1] = self.starts
        pair = np.bincount(self.pair_at, weights=weights, minlength=len(self.pairs))
        triple = np.bincount(self.triple_at, weights=weights[self.inner], minlength=len(self.triples))
        return single.astype(np.uint32), np.concatenate([pair, triple]).astype(np.uint32)


class Automaton:
    """The states that a block's texts can reach, with arcs sorted by word: state s has arcs first[s] to first[s + 1] - 1.

    State 0 is the root, 1 + w is word w's, 1 + words + p is pair p's.
    """

    def __init__(self, block: Block, word: np.ndarray, pair: np.ndarray, triple: np.ndarray, n: int, v: int, mu: float) -> None:
        """word, pair, triple: counts in the whole training corpus."""
        w = block.words
        self.root = np.log10((word + 1) / (n + v + 1))
        self.root[1] = np.log10(1 / (n + v + 1))
        # the root's arcs go to the word's state if training has it, else back to the root
        word_state = np.where(word > 0, 1 + np.arange(w), 0)
        seen_pair, seen_triple = np.flatnonzero(pair > 0), np.flatnonzero(triple > 0)
        start, to = block.pairs // w, block.pairs % w
        p_pair = (pair + mu * 10.0 ** self.root[to]) / (word[start] + mu)
        pair_state = np.where(pair > 0, 1 + w + np.arange(len(pair)), word_state[to])
        from_pair, last = block.triples // w, block.triples % w
        end = block.pair_at[block.triple_first]  # the pair of a triple's last two words
        p_triple = (triple + mu * p_pair[end]) / (pair[from_pair] + mu)
        states = 1 + w + len(pair)
        source = np.concatenate([1 + start[seen_pair], 1 + w + from_pair[seen_triple]])
        self.first = array("q", np.concatenate([[0, 0], np.cumsum(np.bincount(source, minlength=states)[1:])]).astype(np.int64).tobytes())
        self.label = array("I", np.concatenate([to[seen_pair], last[seen_triple]]).astype(np.uint32).tobytes())
        self.weight = array("d", np.log10(np.concatenate([p_pair[seen_pair], p_triple[seen_triple]])).tobytes())
        self.target = array("I", np.concatenate([pair_state[seen_pair], pair_state[end[seen_triple]]]).astype(np.uint32).tobytes())
        count = np.concatenate([[0.0], word, pair])
        self.failure = array("d", np.log10(mu / (count + mu)).tobytes())
        self.fails_to = array("I", np.concatenate([[0], np.zeros(w, np.int64), word_state[to]]).astype(np.uint32).tobytes())
        self.root_to = array("I", word_state.astype(np.uint32).tobytes())
        self.root_weight = array("d", self.root.tobytes())
        self.start = int(word_state[1])

    def read(self, words: list[int]) -> float:
        """log10 probability of a text, its end included."""
        first, label, weight, target = self.first, self.label, self.weight, self.target
        failure, fails_to, root_to, root_weight = self.failure, self.fails_to, self.root_to, self.root_weight
        state, total = self.start, 0.0
        for word in words:
            while state:
                lo, hi = first[state], first[state + 1]
                if hi - lo > 1:
                    lo = bisect_left(label, word, lo, hi)
                if lo < hi and label[lo] == word:
                    total += weight[lo]
                    state = target[lo]
                    break
                total += failure[state]
                state = fails_to[state]
            else:
                total += root_weight[word]
                state = root_to[word]
        return total


def score(df: DataFrame, train, key: str = "doc_id", text: str = "text", mu: float = MU) -> DataFrame:
    """key, trained, n_tokens, n_known, train_tokens, base_score and score of every row. train: a boolean column."""
    size = df.select(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"] or 0
    shard_bits = (max(MIN_SHARDS, -(-size // BLOCK_BYTES)) - 1).bit_length()
    bits = min(max(size.bit_length() + KEY_SPARE, KEY_BITS[0]), KEY_BITS[1])
    kind = df.schema[key].dataType.simpleString()
    # blocks are read twice and numbered by task, so they must come out alike each time
    docs = repeatable(df.select(F.col(key).alias("k"), bytes_of(text).alias("t"), F.coalesce(train, F.lit(True)).alias("train")))

    def gather(batches):
        task = TaskContext.get().partitionId() << 32  # blocks are numbered by task
        keys, texts, flags, held = [], [], [], 0

        def block():
            own = pa.concat_arrays(keys)
            keys_ = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            return pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), keys_, pa.array([bytes(flags)], pa.binary()), pa.array([numbered(texts, flags)], pa.binary())], ["block", "ks", "train", "data"])

        for b in batches:
            start = 0
            for i in range(b.num_rows):
                t = b.column(1)[i].as_py()
                texts.append(t)
                flags.append(b.column(2)[i].as_py())
                held += len(t)
                if held >= BLOCK_BYTES or i == b.num_rows - 1:
                    keys.append(b.column(0).slice(start, i + 1 - start))
                    start = i + 1
                if held >= BLOCK_BYTES:
                    yield block()
                    task, keys, texts, flags, held = task + 1, [], [], [], 0
        if texts:
            yield block()

    def ask(key_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = Block(table.column("data")[0].as_py(), bits)
        words, grams = own.keyed()
        single, more = own.counted()
        single, more = single[words], more[grams]
        edges = [np.searchsorted(k, np.arange(1, 1 << shard_bits, dtype=U64) << U64(width - shard_bits)) for k, width in ((own.word_keys, 64), (own.gram_keys, bits))]
        (a, b), (c, d) = ((np.append(0, e), np.append(e, len(k))) for e, k in zip(edges, (own.word_keys, own.gram_keys), strict=True))
        used = np.flatnonzero((a < b) | (c < d))
        deltas = lambda k, i, j: planes(np.diff(k[i:j], prepend=U64(0)))
        rows = [packed(deltas(own.word_keys, a[s], b[s]), planes(single[a[s] : b[s]]), deltas(own.gram_keys, c[s], d[s]), planes(more[c[s] : d[s]])) for s in used]
        return pa.table({"shard": pa.array(used, pa.int32()), "block": pa.array([key_[0].as_py()] * len(rows), pa.int64()), "counts": pa.array(rows, pa.binary())})

    def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.uint64)
        return distinct, sums, np.split(sums[at], np.cumsum([len(k) for k in keys])[:-1])

    def answer(key_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = [unpacked(x) for x in table.column("counts").to_pylist()]
        keys, sums, words = summed([np.cumsum(unplanes(p[0], U64), dtype=U64) for p in parts], [unplanes(p[1], np.uint32) for p in parts])
        _, _, grams = summed([np.cumsum(unplanes(p[2], U64), dtype=U64) for p in parts], [unplanes(p[3], np.uint32) for p in parts])
        tokens = (keys & U64(1)) == 1
        total = np.array([sums[tokens].sum(), (sums[tokens] > 0).sum()], np.int64)  # told once a shard
        out = [packed((total if i == 0 else total * 0).tobytes(), planes(w), planes(g)) for i, (w, g) in enumerate(zip(words, grams, strict=True))]
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "sums": pa.array(out, pa.binary())})

    def totals(batches):
        for b in batches:
            both = np.array([np.frombuffer(unpacked(x)[0], np.int64) for x in b.column(2).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["n", "v"])

    def traverse(key_: tuple[pa.Scalar, ...], docs_: pa.Table, sums_: pa.Table) -> pa.Table:
        own = Block(docs_.column("data")[0].as_py(), bits)
        words, grams = own.keyed()
        column = sums_.column("sums")
        parts = [unpacked(column[i].as_py()) for i in np.argsort(sums_.column("shard").to_numpy())]
        single, more = np.empty(len(words)), np.empty(len(grams))
        single[words] = np.concatenate([unplanes(p[1], np.uint64) for p in parts])
        more[grams] = np.concatenate([unplanes(p[2], np.uint64) for p in parts])
        del own.word_keys, own.gram_keys, words, grams, parts
        total = sums_.column("total")[0].as_py()
        model = Automaton(own, single, more[: len(own.pairs)], more[len(own.pairs) :], total["n"], total["v"], mu)
        del more
        ends = np.cumsum(own.lengths)
        owner = np.repeat(np.arange(len(ends)), own.lengths)
        known = np.bincount(owner, weights=single[own.word] > 0, minlength=len(ends)).astype(np.int64)
        base = np.bincount(owner, weights=model.root[own.word], minlength=len(ends))
        line = own.word.astype(np.uint32)
        whole = [model.read(line[end - n : end].tolist()) for n, end in zip(own.lengths.tolist(), ends.tolist(), strict=True)]
        train_ = np.frombuffer(docs_.column("train")[0].as_py(), np.uint8).astype(bool)
        return pa.table({"k": docs_.column("ks").combine_chunks().flatten(), "train": pa.array(train_), "n_tokens": pa.array(own.lengths), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(ends), total["n"]), pa.int64()), "base_score": pa.array(base), "score": pa.array(whole, pa.float64())})

    blocks = docs.mapInArrow(gather, f"block bigint, ks array<{kind}>, train binary, data binary")
    asked = blocks.groupBy("block").applyInArrow(ask, "shard int, block bigint, counts binary")
    sums = asked.groupBy("shard").applyInArrow(answer, "block bigint, shard int, sums binary").repartition("block")
    total = sums.mapInArrow(totals, "n bigint, v bigint").agg(F.struct(F.sum("n").alias("n"), F.sum("v").alias("v")).alias("total"))
    sums = sums.withColumn("total", total.scalar())
    scored = blocks.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(traverse, f"k {kind}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return scored.withColumnsRenamed({"k": key, "train": "trained"})
