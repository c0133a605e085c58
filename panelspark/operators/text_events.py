"""Text events: preparation, selection, labels, embeddings, representation, aggregation, review, evaluation."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import cache_key, confidence_band, half_life_weight, keyword_label, safe_divide, text_sha256
from ..functions.windows import keep_one
from .joins import lookup


def _nfkc(t: str | None) -> str | None:
    return None if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t)).strip()


def _folded(t: str | None) -> str | None:
    return None if t is None else t.casefold()


#: Texts of which normalisation changes white space alone, and folding case alone: the JVM does these, and Python sees only the others.
ASCII, ASCII_SPACE = r"^[\x00-\x7F]*$", r"[\x09-\x0D\x1C-\x20]+"


def _but_ascii(x: Column, plain: Column, other: Callable[[str | None], str | None]) -> Column:
    """Python gets texts by the hundred: an Arrow batch of ten thousand whole texts, in several copies a worker, grows with the table and its texts."""
    ascii_ = x.rlike(ASCII)
    return F.when(ascii_, plain).otherwise(F.udf(other, "string", useArrow=False)(F.when(~ascii_, x)))  # made here, as types are parsed by a running session


def nfkc(x: Column | str) -> Column:
    """Compatibility-normalised text with runs of white space as one space, trimmed."""
    x = F.col(x) if isinstance(x, str) else x
    return _but_ascii(x, F.trim(F.regexp_replace(x, ASCII_SPACE, " ")), _nfkc)


def folded(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return _but_ascii(x, F.lower(x), _folded)


# Keywords of the rule labeler; growth is tested first, then the negative words, of which some mean litigation.
LEXICON_VERSION = "rule_lexicon_v1"
GROWTH = ("增长", "预增", "中标", "突破", "growth", "win")
NEGATIVE = ("下滑", "亏损", "处罚", "诉讼", "decline", "loss", "fine")
LITIGATION = ("诉讼",)
# Sentiment, horizon, confidence and reason of each label that the rules give.
LABELS = {
    "earnings_growth": ("positive", "medium", 0.78, "Positive growth or contract keyword matched."),
    "litigation": ("negative", "medium", 0.76, "Negative earnings or risk keyword matched."),
    "earnings_decline": ("negative", "medium", 0.76, "Negative earnings or risk keyword matched."),
    "other": ("neutral", "unknown", 0.55, "No high-signal keyword matched."),
}
# What labels may say.
EVENT_TYPES = ("earnings_growth", "earnings_decline", "contract_win", "policy_support", "regulatory_risk", "financing", "management_change", "litigation", "other")
SENTIMENTS, HORIZONS = ("positive", "neutral", "negative"), ("short", "medium", "long", "unknown")
PROMPT_VERSION = "llm_event_v1"
LABEL = "event_type string, sentiment string, impact_horizon string, confidence double, reason string"
LABEL_FIELDS = tuple(x.split()[0] for x in LABEL.split(", "))


def lexicon_fingerprint(growth=GROWTH, negative=NEGATIVE, litigation=LITIGATION, version: str = LEXICON_VERSION) -> str:
    return fingerprint({"version": version, "growth": growth, "negative": negative, "litigation": litigation})


def label_prompt(*, event_id="event_id", stock_code="stock_code", source="source", publish_time="publish_time", title="title", content="content") -> Column:
    """The request to a labelling model as a column; the fields that it may use follow its rules, a line each."""
    rules = (
        "Label this piece of company news for quantitative research, from the text below alone. No price forecasts, no trading advice.",
        f"Answer with one JSON object of {', '.join(LABEL_FIELDS)}.",
        f"event_type is one of {', '.join(EVENT_TYPES)}; sentiment one of {', '.join(SENTIMENTS)}; impact_horizon one of {', '.join(HORIZONS)}; confidence from 0 to 1.",
    )
    fields = {"event_id": event_id, "stock_code": stock_code, "source": source, "publish_time": publish_time, "title": title, "content": content}
    return F.concat_ws("\n", *map(F.lit, rules), *(F.concat(F.lit(f"{k}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for k, c in fields.items()))


def prepare(events: DataFrame, registry: DataFrame | None = None, refuse: bool = True) -> DataFrame:
    """Events normalised, hashed and grouped by equal text; repeated ids, empty texts and availability before publication raise, or stay as rows if `refuse` is False."""
    e = events
    if "title" not in e.columns:
        e = e.withColumn("title", F.lit(""))
    if "publish_time" not in e.columns:
        e = e.withColumn("publish_time", F.col("available_time"))
    e = e.withColumn("title", nfkc(F.coalesce("title", F.lit("")))).withColumn("content", nfkc(F.coalesce("content", F.lit(""))))
    e = e.withColumn("raw_text", F.concat("title", F.lit("\n"), "content")).withColumn("normalized_text", folded(F.trim(F.concat("title", F.lit(" "), "content"))))  # both are normalised
    if refuse:
        bad = e.agg(F.count_if(F.length("normalized_text") == 0).alias("empty"), F.count_if(F.col("available_time") < F.col("publish_time")).alias("early"), (F.count("*") - F.count_distinct("event_id")).alias("repeated")).first()
        if any(bad):
            raise ValueError(f"text events: {bad.asDict()}")
    e = e.withColumn("content_sha256", text_sha256("normalized_text")).withColumn("dedup_group_id", F.concat(F.lit("exact:"), "content_sha256"))
    e = e.withColumn("is_exact_duplicate", F.count("*").over(Window.partitionBy("stock_code", "dedup_group_id")) > 1)
    if registry is None:
        return e.withColumn("entity_status", F.lit("unchecked"))
    known = registry.select(F.col("ts_code").alias("stock_code")).distinct().withColumn("__k", F.lit(True))
    return e.join(known, "stock_code", "left").withColumn("entity_status", F.when(F.col("__k"), "matched").otherwise("unmatched")).drop("__k")


def validate_prepared(e: DataFrame) -> DataFrame:
    if e.where(~F.col("content_sha256").rlike("^[0-9a-f]{64}$") | F.col("dedup_group_id").isNull() | F.col("available_time").isNull()).limit(1).count():
        raise ValueError("prepared events with open fields")
    return e


def signal_ready(e: DataFrame, cutoff: Column, matched_only: bool = True) -> DataFrame:
    """Events available by the cutoff, of matched entities, the first arrival of each text."""
    rows = e.where(F.col("available_time") <= cutoff)
    if matched_only:
        rows = rows.where(F.col("entity_status") != "unmatched")
    return keep_one(rows, ["stock_code", "dedup_group_id"], [F.col("available_time"), F.col("event_id")])


def rule_labels(text: Column | str, growth=GROWTH, negative=NEGATIVE, litigation=LITIGATION) -> Column:
    """struct of LABEL by keywords in the lower-cased text."""
    hit = lambda words: keyword_label(text, [("hit", words)]) == "hit"
    kind = F.when(hit(growth), "earnings_growth").when(hit(negative), F.when(hit(litigation), "litigation").otherwise("earnings_decline")).otherwise("other")
    pick = lambda i: F.element_at(F.create_map(*(x for k, v in LABELS.items() for x in (F.lit(k), F.lit(v[i])))), kind)
    return F.struct(kind.alias("event_type"), *(pick(i).alias(name) for i, name in enumerate(LABEL_FIELDS[1:])))


def with_retries(labeler: Callable[[pd.Series], pd.DataFrame], retries: int) -> Callable[[pd.Series], pd.DataFrame]:
    """labeler over a batch, called again after an error or a label outside the schema, `retries` times at most."""

    def run(texts: pd.Series) -> pd.DataFrame:
        for left in reversed(range(retries + 1)):
            try:
                found = labeler(texts).reindex(columns=list(LABEL_FIELDS))
                bad = ~(found["event_type"].isin(EVENT_TYPES) & found["sentiment"].isin(SENTIMENTS) & found["impact_horizon"].isin(HORIZONS) & found["confidence"].between(0, 1))
                if len(found) != len(texts) or bad.any():
                    raise ValueError(f"{int(bad.sum())} labels outside the schema")
                return found
            except Exception as e:
                if not left:
                    raise RuntimeError(f"labelling failed after {retries + 1} calls") from e
        raise ValueError("retries must be 0 or more")

    return run


def label(e: DataFrame, cache: DataFrame | None = None, labeler: Callable[[pd.Series], pd.DataFrame] | None = None, model: str = "rule-based-event-labeler-v1", prompt_version: str = PROMPT_VERSION, configuration: str | None = None, retries: int = 2) -> DataFrame:
    """event_id, cache_key, LABEL's fields, output_json, cached: cached labels first, the rest by rules or a labeler over text batches.

    A key holds event, text, model, prompt version, the configuration's
    fingerprint (the rules' lexicon if none is given) and the label schema's;
    an event without an id has none.
    """
    own = configuration or (lexicon_fingerprint() if labeler is None else model)
    schema = fingerprint({"label": LABEL, "event_type": EVENT_TYPES, "sentiment": SENTIMENTS, "impact_horizon": HORIZONS})
    key = cache_key({"configuration": F.lit(own), "event": F.col("event_id").cast("string"), "model": F.lit(model), "prompt": F.lit(prompt_version), "schema": F.lit(schema), "text": text_sha256("normalized_text")})
    rows = e.select("event_id", "normalized_text").withColumn("cache_key", F.when(F.col("event_id").isNotNull(), key))
    have = None
    if cache is not None:
        c = cache.select("cache_key", *LABEL_FIELDS)
        have = rows.join(c, "cache_key").select("event_id", "cache_key", *LABEL_FIELDS, F.lit(True).alias("cached"))
        rows = rows.join(c, "cache_key", "left_anti")
    if labeler is None:
        fresh = rows.withColumn("__l", rule_labels("normalized_text"))
    else:
        fresh = rows.withColumn("__l", F.pandas_udf(with_retries(labeler, retries), LABEL)("normalized_text"))
    fresh = fresh.select("event_id", "cache_key", "__l.*", F.lit(False).alias("cached"))
    out = fresh if have is None else have.unionByName(fresh)
    return out.withColumn("output_json", F.to_json(F.struct(*LABEL_FIELDS)))


def invalid_labels(labels: DataFrame) -> DataFrame:
    sound = F.col("event_type").isin(*EVENT_TYPES) & F.col("sentiment").isin(*SENTIMENTS) & F.col("confidence").between(0, 1)
    if "impact_horizon" in labels.columns:
        sound = sound & F.col("impact_horizon").isin(*HORIZONS)
    return labels.where(~F.coalesce(sound, F.lit(False)))


def embed(e: DataFrame, encode: Callable[[list[str]], np.ndarray], dimension: int, cache: DataFrame | None = None) -> DataFrame:
    """cache_key, embedding of distinct texts: cached ones first, the rest encoded in batches; wrong shapes and non-finite values raise."""
    rows = e.select("normalized_text").distinct().withColumn("cache_key", cache_key({"dimension": F.lit(dimension), "text": text_sha256("normalized_text")}))

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            v = np.asarray(encode(b.tolist()), dtype=float)
            if v.shape != (len(b), dimension) or not np.isfinite(v).all():
                raise ValueError(f"embedding of shape {v.shape}")
            yield pd.Series(list(v))

    if cache is not None:
        fresh = rows.join(cache.select("cache_key"), "cache_key", "left_anti").select("cache_key", run("normalized_text").alias("embedding"))
        return cache.select("cache_key", "embedding").join(rows.select("cache_key"), "cache_key", "left_semi").unionByName(fresh)
    return rows.select("cache_key", run("normalized_text").alias("embedding"))


def hashing_encoder(dimension: int) -> Callable[[list[str]], np.ndarray]:
    """A deterministic encoder without a model: signed word hashes, normalised; words that cancel each other out leave the first one's axis, so every vector has length one."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for i, t in enumerate(texts):
            for w in t.split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dimension] += 1 if h >> 63 else -1
            if not out[i].any():
                out[i, int.from_bytes(hashlib.blake2b(t.split()[0].encode() if t.split() else b"", digest_size=8).digest(), "little") % dimension] = 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def representation(e: DataFrame, labels: DataFrame, version: str) -> DataFrame:
    """One row a label without raw text: ids, times, score; labels of unknown events raise."""
    if labels.join(e.select("event_id"), "event_id", "left_anti").limit(1).count():
        raise ValueError("labels of events that aren't prepared")
    score = F.when(F.col("sentiment") == "positive", 1.0).when(F.col("sentiment") == "negative", -1.0).otherwise(0.0) * F.col("confidence")
    j = e.select("event_id", "stock_code", "available_time", "dedup_group_id").join(labels, "event_id")
    return j.select("event_id", "stock_code", "available_time", "dedup_group_id", "event_type", "sentiment", "confidence", score.alias("score"), text_sha256(F.concat(F.col("event_id").cast("string"), F.lit(f"|{version}"))).alias("version_sha256"))


def aggregate(rep: DataFrame, signals: DataFrame, features: list[str], days: int = 30, half_life: float = 10.0) -> DataFrame:
    """(signal_time, stock_code): decay-weighted means of features over the window, texts once by first arrival, count and latest time; no text, no row."""
    s = lookup(signals.select("signal_time").distinct())
    rows = rep.join(s, (F.col("available_time") <= F.col("signal_time")) & (F.col("available_time") > F.col("signal_time") - F.make_dt_interval(F.lit(days))))
    rows = keep_one(rows, ["signal_time", "stock_code", "dedup_group_id"], [F.col("available_time"), F.col("event_id")])
    age = (F.unix_micros(F.col("signal_time").cast("timestamp")) - F.unix_micros(F.col("available_time").cast("timestamp"))) / 86_400e6
    rows = rows.withColumn("__w", half_life_weight(age, F.lit(half_life)))
    means = [safe_divide(F.sum(F.col("__w") * F.col(f)), F.sum(F.when(F.col(f).isNotNull(), F.col("__w")))).alias(f) for f in features]
    return rows.groupBy("signal_time", "stock_code").agg(*means, F.count("*").alias("texts"), F.max("available_time").alias("latest"))


def quality_report(e: DataFrame) -> DataFrame:
    """(metric, key, n): events, duplicates, distinct texts and entities; distributions by status, month of availability and, where there are such columns, source and type."""
    base = e.agg(F.count("*").alias("events"), F.count_if("is_exact_duplicate").alias("duplicates"), F.count_distinct("dedup_group_id").alias("texts"), F.count_distinct("stock_code").alias("entities"))
    flat = base.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.lit("").alias("key"), F.col(n).alias("n")) for n in base.columns))).alias("m")).select("m.*")
    of = {"entity_status": F.col("entity_status"), "month": F.date_format("available_time", "yyyy-MM")} | {c: F.col(c) for c in ("source", "event_type", "language") if c in e.columns}
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), (c if m == "month" else F.coalesce(c.cast("string"), F.lit(""))).alias("key")) for m, c in of.items())))
    return flat.unionByName(e.select(pairs.alias("p")).groupBy("p.metric", "p.key").agg(F.count("*").alias("n")))


def seeded(key: str, seed: int) -> Column:
    """A row's place in a seeded order, as a digest that any engine can work out."""
    return F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string")).cast("binary"))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A seeded sample of n rows: smallest digests of the key."""
    return df.withColumn("__h", seeded(key, seed)).orderBy("__h", key).limit(n).drop("__h")


def review_queue(labels: DataFrame, n: int, strata: list[str], key: str = "event_id", seed: int = 42) -> DataFrame:
    """n rows taken from the strata in turn."""
    w = Window.partitionBy(*strata).orderBy("__h", key)
    rows = labels.withColumn("__h", seeded(key, seed)).withColumn("turn", F.row_number().over(w))
    return rows.orderBy("turn", *strata, "__h").limit(n).drop("__h")


def with_band(labels: DataFrame) -> DataFrame:
    return labels.withColumn("confidence_band", confidence_band("confidence"))


def review_passes(reviews: DataFrame, least: float = 0.8, column: str = "passed") -> bool:
    """Whether enough of the completed reviews passed; none completed is no pass."""
    r = reviews.where(F.col(column).isNotNull()).agg(F.avg(F.col(column).cast("double")).alias("share")).first()["share"]
    return r is not None and r >= least


def negative_controls(df: DataFrame, features: list[str], shift: int = 1, seed: int = 42) -> DataFrame:
    """Rows with features of `shift` dates earlier (kind 'shift') and shuffled within the date (kind 'permute'); targets stay."""
    w = Window.partitionBy("ts_code").orderBy("trade_date")
    late = df.withColumns({f: F.lag(f, shift).over(w) for f in features}).withColumn("kind", F.lit("shift"))
    day = Window.partitionBy("trade_date")
    a = df.drop(*features).withColumn("__i", F.row_number().over(day.orderBy("ts_code")))
    b = df.select("trade_date", *features, F.row_number().over(day.orderBy(seeded("ts_code", seed), "ts_code")).alias("__i"))
    return late.unionByName(a.join(b, ["trade_date", "__i"]).drop("__i").withColumn("kind", F.lit("permute")))


def representation_increment(df: DataFrame, base: list[str], text: list[str], target: str, *, months: int = 24, embargo: int = 5, alpha: float = 1.0, least: int = 30) -> DataFrame:
    """(test_date, n_train, n_test, mse and rank IC of base and of base + text): ridge on trailing months, labels ending before the embargo, same complete rows.

    Train rows meet test dates as sums: each date's count, sums and products of
    the standardised design's raw columns are added over the window, so rows are
    read once and only (k+1)^2 numbers a date are collected into a solver.
    """
    cols = [*base, *text]
    rows = df.where(" and ".join(f"{c} is not null" for c in [*cols, target])).select("trade_date", "label_end", "ts_code", *cols, target)
    names = [*cols, target]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    daily = rows.groupBy("trade_date", "label_end").agg(F.count("*").cast("double").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(names)), *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs))
    tests = lookup(rows.select(F.col("trade_date").alias("test_date")).distinct())
    win = daily.join(tests, (F.col("trade_date") >= F.add_months("test_date", -months)) & (F.col("trade_date") < F.col("test_date")) & (F.col("label_end") < F.date_sub("test_date", embargo)))
    sums = [c for c in daily.columns if c not in ("trade_date", "label_end")]
    moments = win.groupBy("test_date").agg(*(F.sum(c).alias(c) for c in sums)).where(F.col("n") >= least)

    def solve(g: pd.Series, k: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        n, y = g["n"], len(names) - 1
        p = lambda i, j: g[f"p{max(i, j)}_{min(i, j)}"]
        m = np.array([g[f"s{i}"] / n for i in k])
        sd = np.sqrt(np.maximum([p(i, i) / n - (g[f"s{i}"] / n) ** 2 for i in k], 0))
        sd[sd < 1e-12] = 1.0
        gram = np.array([[(p(i, j) - g[f"s{i}"] * g[f"s{j}"] / n) / sd[a] / sd[b] for b, j in enumerate(k)] for a, i in enumerate(k)])
        rhs = np.array([(p(i, y) - g[f"s{i}"] * g[f"s{y}"] / n) / sd[a] for a, i in enumerate(k)])
        return np.linalg.pinv(gram + alpha * np.eye(len(k))) @ rhs, m, sd, g[f"s{y}"] / n

    def score(key: tuple, test: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        if not len(g) or not len(test):
            return pd.DataFrame(columns=[c.split()[0] for c in out.split(", ")])
        got = []
        for k in (list(range(len(base))), list(range(len(cols)))):
            beta, m, sd, y0 = solve(g.iloc[0], k)
            f = y0 + ((test[[cols[i] for i in k]].to_numpy(float) - m) / sd) @ beta
            y = test[target].to_numpy(float)
            ic = pd.Series(f).rank().corr(pd.Series(y).rank()) if len(y) > 2 and np.std(f) > 0 and np.std(y) > 0 else None
            got += [float(((f - y) ** 2).mean()), ic]
        return pd.DataFrame([(key[0], int(g.iloc[0]["n"]), len(test), *got)], columns=[c.split()[0] for c in out.split(", ")])

    out = "test_date date, n_train bigint, n_test bigint, mse_base double, ic_base double, mse_text double, ic_text double"
    test = rows.withColumn("test_date", F.col("trade_date")).drop("label_end")
    return test.groupBy("test_date").cogroup(moments.groupBy("test_date")).applyInPandas(score, out)


# ---------------------------------------------------------------- artifacts

STATES = ("draft", "reviewed", "frozen")


def canonical_json(x) -> str:
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(x) -> str:
    return hashlib.sha256(canonical_json(x).encode()).hexdigest()


def artifact(kind: str, spec: dict, rows: int, content_sha256: str, status: str = "draft") -> dict:
    body = {"kind": kind, "spec": spec, "spec_sha256": fingerprint(spec), "rows": rows, "content_sha256": content_sha256, "status": status}
    return body | {"artifact_sha256": fingerprint(body)}


def advance(a: dict, status: str) -> dict:
    """The artifact one state on; frozen ones never change, states aren't skipped."""
    if STATES.index(status) != STATES.index(a["status"]) + 1:
        raise ValueError(f"{a['status']} can't become {status}")
    body = {k: v for k, v in a.items() if k != "artifact_sha256"} | {"status": status}
    return body | {"artifact_sha256": fingerprint(body)}


MANIFEST_FIELDS = ("dataset_id", "source", "license", "start", "end", "rows", "content_sha256", "reviewed_by")


def validate_text_manifest(m: dict) -> list[str]:
    """Problems of a text dataset's manifest; none means ready for research."""
    problems = [f"missing:{f}" for f in MANIFEST_FIELDS if m.get(f) in (None, "")]
    if m.get("start") and m.get("end") and str(m["start"]) > str(m["end"]):
        problems.append("start_after_end")
    if m.get("content_sha256") and not re.fullmatch(r"[0-9a-f]{64}", str(m["content_sha256"])):
        problems.append("bad_sha256")
    return problems


def validate_protocol(p: dict) -> list[str]:
    """Problems of a text-research protocol; a frozen one must carry its own fingerprint."""
    problems = [f"missing:{f}" for f in ("train_months", "embargo_days", "alpha", "holdout_start", "features") if f not in p]
    if p.get("status") == "frozen" and p.get("sha256") != fingerprint({k: v for k, v in p.items() if k not in ("sha256", "status")}):
        problems.append("changed_after_freeze")
    return problems
