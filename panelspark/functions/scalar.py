"""Scalar expressions: safe division, calendar parts, limits, decay, codes, hashes, vectors, labels."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """NaN and infinities as NULL."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def safe_divide(a, b) -> Column:
    """a / b; a zero or missing denominator gives NULL."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def require_columns(df: DataFrame, names: Iterable[str], table: str = "table") -> DataFrame:
    """df, or ValueError that lists the columns it lacks."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{table} lacks columns: {', '.join(missing)}")
    return df


def normalize_dates(df: DataFrame, names: Iterable[str], errors: str = "raise") -> DataFrame:
    """Columns as DATE; errors='coerce' turns what can't be read into NULL."""
    have = [n for n in names if n in df.columns]
    parse = (lambda c: F.try_to_timestamp(c.cast("string")).cast("date")) if errors == "coerce" else (lambda c: c.cast("date"))
    return df.withColumns({n: parse(F.col(n)) for n in have})


def log_size(total_mv) -> Column:
    """ln of market value; not positive gives NULL."""
    x = col(total_mv)
    return F.when(x > 0, F.log(x))


def reciprocal(x) -> Column:
    return safe_divide(F.lit(1.0), x)


# Price-limit rates by board.
ST_RATE, STAR_RATE, GROWTH_RATE, NORTH_RATE, MAIN_RATE = 0.05, 0.20, 0.20, 0.30, 0.10
GROWTH_FROM = "2020-08-24"


def exchange_limit_rate(code, date, is_st) -> Column:
    """Daily price-limit rate by board prefix; ST first, growth board 20 % since its reform."""
    code, date = col(code), col(date)
    return (
        F.when(F.coalesce(col(is_st), F.lit(False)), ST_RATE)
        .when(code.startswith("688"), STAR_RATE)
        .when(code.startswith("300") & (date >= F.to_date(F.lit(GROWTH_FROM))), GROWTH_RATE)
        .when(code.startswith("8") | code.startswith("4"), NORTH_RATE)
        .otherwise(MAIN_RATE)
    )


def normalize_code(code) -> Column:
    """'1' -> '000001.SZ'; 5, 6 and 9 lead to SH; a code with a suffix stays, in upper case."""
    code = F.trim(col(code).cast("string"))
    digits = F.lpad(code, 6, "0")
    venue = F.when(F.substring(digits, 1, 1).isin("5", "6", "9"), ".SH").otherwise(".SZ")
    return F.when(code.contains("."), F.upper(code)).otherwise(F.concat(digits, venue))


def first_column(df: DataFrame, names: Iterable[str], to: str) -> DataFrame:
    """df with the first of names that exists renamed to `to`."""
    names = list(names)
    for name in names:
        if name in df.columns:
            return df.withColumnRenamed(name, to)
    raise ValueError(f"none of the columns {names} exists")


def half_life_weight(age_days, half_life) -> Column:
    return F.pow(F.lit(0.5), col(age_days) / half_life)


def clip(x, low=None, high=None) -> Column:
    """NULL stays NULL, unlike with least() and greatest() alone."""
    x = col(x)
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


RETURN_FLOOR = -0.999999


def log_return(r) -> Column:
    """log1p of a simple return, floored just above a total loss."""
    r = col(r)
    return F.when(r.isNotNull(), F.log1p(F.greatest(r, F.lit(RETURN_FLOOR))))


def confidence_band(x) -> Column:
    """Right-closed bands at 0.5 and 0.8."""
    x = col(x)
    return F.when(x <= 0.5, "low").when(x <= 0.8, "medium").when(x.isNotNull(), "high")


# Sentiment scores.
SENTIMENT = {"positive": 1.0, "neutral": 0.0, "negative": -1.0}


def sentiment_score(sentiment, confidence=1.0) -> Column:
    score = F.lit(None).cast("double")
    for name, value in SENTIMENT.items():
        score = F.when(col(sentiment) == name, value).otherwise(score)
    return score * (F.lit(confidence) if isinstance(confidence, (int, float)) else col(confidence))


def is_sha256(x) -> Column:
    return F.coalesce(col(x).rlike("^[0-9a-f]{64}$"), F.lit(False))


def text_sha256(x) -> Column:
    return F.sha2(col(x).cast("binary"), 256)


def cache_key(fields: Mapping[str, Column]) -> Column:
    """sha256 over canonical JSON: names in order, NULLs kept."""
    return F.sha2(F.to_json(F.struct(*(c.alias(n) for n, c in sorted(fields.items()))), {"ignoreNullFields": "false"}), 256)


def let(value, body) -> Column:
    """body(value), with value worked out once and not at every use of it inside lambdas."""
    return F.element_at(F.transform(F.array(col(value)), body), 1)


def character_ngrams(text, n: int = 3) -> Column:
    """Distinct character n-grams without spaces; a shorter text is its own n-gram, an empty one has none."""

    def grams(c: Column) -> Column:
        runs = F.transform(c, lambda x, i: F.concat(x, *(F.get(c, i + k) for k in range(1, n))))
        return F.array_distinct(F.filter(runs, lambda g: g.isNotNull()))

    t = F.regexp_replace(col(text), r"\s", "")
    long = let(F.split(t, ""), lambda c: F.when(F.size(c) >= n, grams(c)).otherwise(F.array(F.concat_ws("", c))))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(long)


def jaccard(a, b) -> Column:
    """Of two arrays of distinct items; two empty ones are alike."""
    a, b = col(a), col(b)
    share = let(F.size(F.array_intersect(a, b)), lambda k: F.try_divide(k.cast("double"), (F.size(a) + F.size(b) - k).cast("double")))
    return F.coalesce(share, F.lit(1.0))


def keyword_label(text, rules: Iterable[tuple[str, Iterable[str]]], default: str = "other") -> Column:
    """Label of the first rule with a keyword in the lower-cased text."""
    out = F.lit(default)
    t = F.lower(col(text))
    for label, words in reversed(list(rules)):
        hit = F.lit(False)
        for w in words:
            hit = hit | t.contains(w)
        out = F.when(hit, label).otherwise(out)
    return out


def expand_vector(df: DataFrame, column: str = "vector_json", dimension: int = 8, prefix: str = "emb_") -> DataFrame:
    """A JSON array as columns prefix0..; another number of components raises when it is run."""
    v = F.from_json(column, "array<double>")
    checked = F.when(F.size(v) == dimension, v).otherwise(F.raise_error(F.lit(f"vector without {dimension} components")))
    return df.withColumn("__v", checked).select("*", *(F.col("__v")[i].alias(f"{prefix}{i}") for i in range(dimension))).drop("__v")


def row_mean(columns: Iterable[str]) -> Column:
    """Mean over the columns that aren't NULL."""
    columns = list(columns)
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    count = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return F.try_divide(total, count.cast("double"))


def event_id(order: Iterable[Column], prefix: str = "event-") -> Column:
    """Stable ids by rank; one global sort, for small event tables."""
    from pyspark.sql import Window

    return F.format_string(f"{prefix}%06d", F.row_number().over(Window.orderBy(*order)) - 1)
