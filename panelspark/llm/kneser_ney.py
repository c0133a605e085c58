"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text.

Training: of the documents labelled good, a hashed sample of half, and of
TRAIN_DOCS at most on average (a documented bound). The others are always held
out to set thresholds. A text is a run of words behind two starts; its n-grams
become 64-bit keys; counts are grouped sums, sharded by key, and the model is
made of joins of those counts. Trigrams count occurrences, pairs the distinct
words seen before them, words the distinct pairs that end in them; each level
has its discounts D1, D2, D3+ by language from counts of counts, its contexts'
totals and what discounting leaves to the level below:
P(w|uv) = (c(uvw) - D) / c(uv.) + left(uv) P(w|v), down to words and a share for
the unknown word.

Scoring: every document, whole, meets the model by sorted or sharded joins. A
model of MODEL_KEYS keys at most (counted) goes to all executors as sorted
arrays that batches of documents are merged with; a larger one stays where it
is, and documents' distinct trigrams are joined with its tables by key. Both give
the same perplexities. A document's perplexity is drawn towards the language's
median as if it had PRIOR more words, which keeps short clean texts. The
threshold of a language is the QUANTILE of good documents outside the sample,
times MARGIN. Documents above it are rejected. A language with fewer than
MIN_JUDGED such documents takes its own median and a pooled distance from the
median to the threshold: the larger of the QUANTILE over all languages and over
those small ones, times MARGIN, and POOLED_LEAST at least. If it has none, its
median is that of all languages.

Null text is empty; documents without words are kept. So are documents, with
null threshold, where nothing can be compared: in a language of which no good
document is in the sample, or if none at all is outside it. Null language is a
language of its own. Repeated rows are judged alike, ties with a threshold are
kept. Texts are read whole, however long. Without labels nothing is rejected; an
empty table gives no rows. Columns other than those named are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import small
from .util import U64, bytes_of, cut, mix, pieces, spaced_words, word_hashes

TRAIN_DOCS, MIN_JUDGED = 3000, 50
QUANTILE, MARGIN, PRIOR = 0.995, 1.15, 60.0
#: Nats a word from the median to a pooled threshold, at least: a few documents show too little of the spread.
POOLED_LEAST = 0.5
#: Keys of the largest model that is sent to executors as arrays (12 bytes each).
MODEL_KEYS = 8_000_000
#: Keys at most that count as hot in a join with a larger model.
HOT_KEYS = 100_000
START = b" start"
_ODD = U64(0x9E3779B97F4A7C15)
#: The tables of a model and what a key that is missing in them means.
TABLES = {"triple": 0.0, "pair_left": 1.0, "pair": 0.0, "word_left": 1.0, "word": -1.0}


def language_key(lang: str | None) -> np.uint64:
    return U64(xxhash.xxh64_intdigest("" if lang is None else "=" + lang, seed=5))


def numbered(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of each word: the hashes of the two before it and its own, its text; and words by text."""
    number, runs = {START: 0}, []
    put = number.setdefault
    for text in texts:
        runs.append(np.fromiter([0, 0, *[put(w, len(number)) for w in spaced_words(text)]], dtype=np.int64))
    lengths = np.array([len(r) for r in runs], dtype=np.int64)
    line = np.concatenate(runs) if runs else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(runs)), lengths)
    inner = np.ones(len(line), dtype=bool)
    starts = np.cumsum(lengths) - lengths
    inner[starts] = inner[starts + 1] = False
    hashes = word_hashes(list(number))
    at = np.flatnonzero(inner)
    return hashes[line[at - 2]], hashes[line[at - 1]], hashes[line[at]], owner[at], lengths - 2


def gram_keys(first: np.ndarray, second: np.ndarray, word: np.ndarray, lang) -> dict[str, np.ndarray]:
    """Keys of each word's n-grams in the tables of a model."""
    v, w = mix(second + lang), mix(word ^ lang)
    uv = mix(mix(first + lang + U64(7)) * _ODD + second)
    return {"triple": mix(uv * _ODD + word), "pair_left": uv, "pair": mix(v * _ODD + word), "word_left": v, "word": w}


def train(docs: DataFrame) -> dict[str, DataFrame]:
    """The model as tables of key and value (and c, a count that tells frequent keys); unknown: by language.

    docs: lang and t (bytes) of the sample.
    """
    names = list(TABLES)

    def triples(batches):
        for b in pieces(batches):
            *grams, owner, _ = numbered(b.column(1).to_pylist())
            langs = [language_key(x) for x in b.column(0).to_pylist()]
            lang = np.array(langs, dtype=U64)[owner] if len(langs) else np.empty(0, U64)
            keys = gram_keys(*grams, lang)
            _, at, n = np.unique(keys["triple"], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (lang[at], *(keys[k][at] for k in names), n.astype(np.int64))], ["lang", *names, "n"])

    counted = docs.select("lang", "t").mapInArrow(triples, ", ".join(f"{c} bigint" for c in ("lang", *names, "n")))
    three = cut(counted.groupBy("lang", *names).agg(F.sum("n").alias("c")), "kn_triples")
    two = cut(three.groupBy("lang", "pair", "word_left", "word").agg(F.count("*").alias("c")), "kn_pairs")  # words before them
    one = cut(two.groupBy("lang", "word").agg(F.count("*").alias("c")), "kn_words")

    def discounted(rows: DataFrame) -> DataFrame:
        """rows with off, what is taken from their count, and the language's types and total."""
        n = [F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
        d = rows.groupBy("lang").agg(*n, F.count("*").alias("types"), F.sum("c").alias("total"))
        y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
        more = lambda i: F.least(F.greatest(F.coalesce(i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.5 * i)), F.lit(0.1)), F.lit(i - 0.05))
        d = cut(d.select(F.col("lang").alias("l"), *(more(i).alias(f"d{i}") for i in (1, 2, 3)), "types", "total"), "kn_discounts")
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        return rows.join(small(d), F.col("lang") == F.col("l")).withColumn("off", off)

    def level(rows: DataFrame, key: str, context: str) -> tuple[DataFrame, DataFrame]:
        rows = discounted(rows)
        contexts = rows.groupBy(context).agg(F.sum("c").alias("all"), F.sum("off").alias("taken"))
        shares = rows.join(contexts, context).select(F.col(key).alias("key"), ((F.col("c") - F.col("off")) / F.col("all")).alias("value"), "c")
        return shares, contexts.select(F.col(context).alias("key"), (F.col("taken") / F.col("all")).alias("value"), F.col("all").alias("c"))

    triple, pair_left = level(three, "triple", "pair_left")
    pair, word_left = level(two, "pair", "word_left")
    words = discounted(one)
    unknown = cut(words.groupBy(F.col("lang").alias("key")).agg((F.sum("off") / F.first("total") / (F.first("types") + 1)).alias("value")), "kn_unknown")
    word = words.join(small(unknown.toDF("m", "flat")), F.col("lang") == F.col("m")).select(F.col("word").alias("key"), ((F.col("c") - F.col("off")) / F.col("total") + F.col("flat")).alias("value"), "c")
    model = {"triple": triple, "pair_left": pair_left, "pair": pair, "word_left": word_left, "word": word}
    return {name: cut(table.withColumn("value", F.col("value").cast("float")), f"kn_{name}") for name, table in model.items()} | {"unknown": unknown.withColumn("value", F.col("value").cast("float"))}


def arrays(model: dict[str, DataFrame]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The model as sorted keys and their values. Its size must have been checked."""
    out = {}
    for name, table in model.items():
        got = table.select("key", "value").toArrow()
        keys, values = got.column("key").to_numpy().view(U64), got.column("value").to_numpy()
        order = np.argsort(keys)
        out[name] = keys[order], values[order]
        del got, keys, values, order
    return out


def find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
    """Values of sorted keys, which are joined with the sorted table."""
    own, values = table
    if not len(own):
        return np.full(len(keys), missing)
    at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
    return np.where(own[at] == keys, values[at].astype(np.float64), missing)


def looked_up(table, keys: np.ndarray, missing: float) -> np.ndarray:
    distinct, at = np.unique(keys, return_inverse=True)
    return find(table, distinct, missing)[at]


def log_likelihoods(model, langs: list[str | None], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words and natural-log likelihood of each text; nan in a language without a model. model: arrays."""
    *grams, owner, n = numbered(texts)
    lang_of = np.array([language_key(x) for x in langs], dtype=U64)
    flat = looked_up(model["unknown"], lang_of, np.nan)
    keys = gram_keys(*grams, lang_of[owner] if len(owner) else np.empty(0, U64))
    value = {name: looked_up(model[name], keys[name], missing) for name, missing in TABLES.items()}
    low = np.where(value["word"] < 0, flat[owner], value["word"])
    p = value["triple"] + value["pair_left"] * (value["pair"] + value["word_left"] * low)
    with np.errstate(divide="ignore", invalid="ignore"):
        total = np.bincount(owner, weights=np.log(p), minlength=len(texts)).astype(np.float64)
    total[np.isnan(flat)] = np.nan
    return n, total


def by_arrays(docs: DataFrame, model: dict[str, DataFrame], fields: str) -> DataFrame:
    """docs (k, lang, t, also) with n_tokens and ll; the model goes to the executors."""
    held = docs.sparkSession.sparkContext.broadcast(arrays(model))

    def work(batches):
        own = held.value
        for b in pieces(batches):
            n, total = log_likelihoods(own, b.column(1).to_pylist(), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(n, pa.int64()), pa.array(total, pa.float64(), from_pandas=True)], ["k", "lang", "also", "n_tokens", "ll"])

    return docs.mapInArrow(work, f"{fields}, n_tokens bigint, ll double")


def by_joins(docs: DataFrame, model: dict[str, DataFrame], fields: str) -> DataFrame:
    """The same by joins on keys: a row for each distinct trigram of a document, one at least."""

    def work(batches):
        row = TaskContext.get().partitionId() << 32
        for b in pieces(batches):
            langs = np.array([language_key(x) for x in b.column(1).to_pylist()], dtype=U64)
            *grams, owner, _ = numbered(b.column(2).to_pylist())
            keys = gram_keys(*grams, langs[owner] if len(owner) else np.empty(0, U64))
            order = np.lexsort((keys["triple"], owner))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(owner[order]) != 0) | (np.diff(keys["triple"][order]) != 0)
            first = np.flatnonzero(new)
            at, n = order[first], np.diff(np.append(first, len(order)))
            none = np.setdiff1d(np.arange(b.num_rows), owner)
            rows = np.concatenate([owner[at], none])
            column = lambda x, pad=len(none): pa.array(np.concatenate([x.view(np.int64), np.zeros(pad, np.int64)]))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(pa.array(rows)) for c in (0, 1, 3)), pa.array(row + rows), pa.array(langs[rows].view(np.int64)), *(column(keys[k][at]) for k in TABLES), column(n.astype(np.int64))],
                ["k", "lang", "also", "row", "unknown", *TABLES, "n"],
            )
            row += b.num_rows

    rows = docs.mapInArrow(work, f"{fields}, row bigint, unknown bigint, {', '.join(f'{k} bigint' for k in TABLES)}, n bigint")
    for name, missing in TABLES.items():
        # keys of a HOT_KEYS-th of the training tokens are HOT_KEYS at most; other skew is split at run time
        bound = (model[name].agg(F.sum("c")).first()[0] or 0) // HOT_KEYS
        hot = F.broadcast(model[name].where(F.col("c") > bound).select(F.col("key").alias("h"), F.col("value").alias("hv")))
        cold = model[name].where(F.col("c") <= bound).select(F.col("key").alias("x"), F.col("value").alias("xv"))
        rows = rows.join(hot, F.col(name) == F.col("h"), "left")
        rows = rows.withColumn("at", F.when(F.col("hv").isNull(), F.col(name)).otherwise(F.xxhash64("row", name))).join(cold, F.col("at") == F.col("x"), "left")
        rows = rows.withColumn(f"p_{name}", F.coalesce("hv", "xv", F.lit(missing)).cast("double")).drop(name, "h", "hv", "x", "xv", "at")
    rows = rows.join(small(model["unknown"].toDF("m", "flat")), F.col("unknown") == F.col("m"), "left")
    low = F.when(F.col("p_word") < 0, F.col("flat").cast("double")).otherwise(F.col("p_word"))
    p = F.col("p_triple") + F.col("p_pair_left") * (F.col("p_pair") + F.col("p_word_left") * low)
    ll = F.when(F.first("flat").isNotNull(), F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n") * F.log(p))), F.lit(0.0)))
    return rows.groupBy("row").agg(F.first("k").alias("k"), F.first("lang").alias("lang"), F.first("also").alias("also"), F.sum("n").alias("n_tokens"), ll.alias("ll")).drop("row")


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS, also=None, model_keys: int = MODEL_KEYS) -> DataFrame:
    """key, n_tokens, perplexity, threshold and kept of every row, and also (a bigint column) if given. labels: key and quality (1: good)."""
    good = labels.where(F.col("quality") == 1).select(F.col(key).alias("g")).where("g is not null").distinct()
    n_good = max(1, good.count())
    share = min(0.5, train_docs / n_good)
    good = cut(good.withColumn("in_train", F.pmod(F.xxhash64("g", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20))), "kn_good")
    sample = good.where("in_train").select("g")
    docs = df.select(F.col(key).alias("k"), F.col(lang).alias("lang"), bytes_of(text).alias("t"), (F.lit(0) if also is None else also).cast("bigint").alias("also"))
    model = train(docs.join(small(sample, 2 * train_docs + 1000), F.col("k") == F.col("g"), "left_semi"))
    keys = sum(table.count() for table in model.values())
    scored = (by_arrays if keys <= model_keys else by_joins)(docs, model, f"k {df.schema[key].dataType.simpleString()}, lang string, also bigint")
    scored = cut(scored, "kn_scores")
    mean = -F.col("ll") / F.col("n_tokens")
    trusted = scored.where("ll is not null and n_tokens > 0").join(good.where("not in_train"), F.col("k") == F.col("g"), "left_semi")
    middles = cut(trusted.groupBy("lang").agg(F.count("*").alias("judged"), F.percentile(F.round(mean, 4), F.lit(0.5)).alias("middle")).withColumnRenamed("lang", "m"), "kn_middle")
    overall = cut(trusted.agg(F.percentile(F.round(mean, 4), F.lit(0.5)).alias("all_middle")), "kn_overall")  # one row
    drawn = lambda to: (-F.col("ll") + PRIOR * F.col(to)) / (F.col("n_tokens") + PRIOR)
    high = lambda x: F.percentile(F.round(x, 4), F.lit(QUANTILE))
    apart = trusted.join(small(middles), F.col("lang").eqNullSafe(F.col("m"))).join(F.broadcast(overall))
    above, few = drawn("middle") - F.col("middle"), F.col("judged") < MIN_JUDGED
    pooled = apart.agg(F.first("all_middle").alias("all_middle"), (MARGIN * F.greatest(high(above), high(F.when(few, above)))).alias("pooled"), (MARGIN * high(drawn("all_middle") - F.col("all_middle"))).alias("all_apart"))
    pooled = pooled.select("all_middle", F.greatest("pooled", F.lit(POOLED_LEAST)).alias("pooled"), "all_apart")
    pooled = cut(pooled, "kn_pooled")  # one row
    edge = apart.groupBy("m").agg(F.first("judged").alias("judged"), F.first("middle").alias("middle"), high(drawn("middle")).alias("edge"))
    edge = edge.join(F.broadcast(pooled)).select("m", "middle", (F.col("middle") + F.when(few, F.col("pooled")).otherwise(MARGIN * (F.col("edge") - F.col("middle")))).alias("edge"))
    judged = scored.join(small(cut(edge, "kn_edges")), F.col("lang").eqNullSafe(F.col("m")), "left").join(F.broadcast(pooled))
    other = F.when(F.col("ll").isNotNull(), F.col("all_middle"))  # a language with a model, but nothing held out
    judged = judged.withColumns({"edge": F.coalesce("edge", other + F.greatest("pooled", "all_apart")), "middle": F.coalesce("middle", other)})
    return judged.select(F.col("k").alias(key), "n_tokens", F.exp(F.when(F.col("n_tokens") > 0, drawn("middle"))).alias("perplexity"), F.exp("edge").alias("threshold"), F.coalesce((F.col("n_tokens") == 0) | (drawn("middle") <= F.col("edge")), F.lit(True)).alias("kept"), *([] if also is None else ["also"]))
