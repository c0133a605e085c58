"""Quality rules: base counts and robust multivariate outliers [DataFrame functions only].

Every text gives counts (words, their characters, symbols, repeated lines,
words in repeated 8-word windows) and from them a vector of transformed
statistics. For every language and source a minimum-covariance-determinant
estimate of centre and scatter is made by concentration steps from two
deterministic starts (medians with absolute deviations; means with the whole
scatter): keep the SUPPORT share of rows that lie nearest, re-estimate from those
(the scatter times CONSISTENCY, as the nearest half spreads less than the whole).
After TRIED steps the start whose core has the smaller determinant goes on alone,
until no pool's determinant falls any more (its root by less than a share of
SETTLED), or for STEPS steps in all. A row is an outlier if its squared
Mahalanobis distance, scaled so that the median is that of a chi-square, is above
CUTOFF. That is five times the chi-square's 0.999 quantile, as statistics of
texts have longer tails than a normal distribution and clean texts must stay. Floors on
the scatter keep statistics that are constant in most texts (no symbols, no
repeated line) from making it singular: half a unit of a log length, 4 % of a
log word length, a share of 0.16 % symbols, of 6 % repeated lines or words. The support of one half bears pools with junk up
to nearly one half; where junk is the larger part of a pool, and alike, it is
taken for the rule (as a text copied so often would be).

Vectors are integers (1/UNIT steps) and moments are exact decimal sums, so the
result does not depend on the order in which rows are added up. Medians and
quantiles run over the some ten thousand distinct integers that exist. All steps are
grouped sums that combine before the shuffle: a hot source is no hot task.

Sources with fewer than MIN_ROWS usable rows are pooled within their language,
languages whose pool is smaller in one pool; a pool that is still smaller gives
no estimate and rejects nothing. Null text has no words (and fails the base
rule); null language or source form groups of their own. Repeated rows count
each time. Other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import BROADCAST_SOURCES, small
from .util import SPACE, WORD, cut

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
UNIT = 256
SUPPORT, STEPS, SETTLED, MIN_ROWS = 0.5, 12, 0.01, 100
#: Steps that both starts take.
TRIED = 2
CUTOFF = 100.0
#: Steps of a distance to each factor of e. Coarser ones make the cores of small pools swing between two sets.
BINS = 1024
#: Median of the chi-square distribution with as many degrees of freedom as there are statistics.
CHI_MEDIAN = 4.351
#: SUPPORT over the chance that a chi-square with two more degrees of freedom is below CHI_MEDIAN.
CONSISTENCY = 1.912
STATISTICS = ("z_length", "z_word", "z_symbols", "z_lines", "z_repeats")
#: Least standard deviation of each, in its own unit.
FLOORS = (0.5, 0.04, 0.04, 0.25, 0.25)


def let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doubled(step: int):
    """From hashes of runs of words to hashes of runs twice as long."""
    return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + F.lit(step))))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """How many elements of an array of words lie in windows that occur twice or more.

    Window hashes come from doubling (1, 2, 4, 8 words), so each costs three
    hashes of two longs. Only arrays with a repeated hash are sorted.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    step = 1
    while step < window:
        hashes = let(hashes, doubled(step))
        step *= 2

    def covered(pairs: Column) -> Column:
        """pairs: sorted (hash, position). Positions with an equal neighbour, then the words they span."""
        twin = lambda x, i: (F.get(pairs, i - 1)["h"] == x["h"]) | (F.get(pairs, i + 1)["h"] == x["h"])
        marked = F.sort_array(F.transform(F.filter(pairs, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        grow = lambda a, i: F.struct((i + window).alias("end"), (a["n"] + i + window - F.greatest(a["end"], i)).alias("n"))
        return F.aggregate(marked, start, grow, lambda a: a["n"])

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(pairs, covered)).otherwise(0)

    windows = let(hashes, lambda h: F.slice(h, F.lit(1), F.greatest(F.size(h) - (window - 1), F.lit(0))))
    return let(windows, count)


def counts(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """key, lang, source, n_words and the base counts, n_lines among them, of every row."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(source).alias("source"), t.alias("t"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD))
    words = F.filter(F.split("t", SPACE, -1), lambda x: x != "")
    return rows.select(
        "key", "lang", "source",
        F.regexp_count("t", F.lit(WORD)).cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        repeat_words(words).cast("long").alias("n_repeat_words"),
    )


def vectors(rows: DataFrame) -> DataFrame:
    """rows with base_failed and the transformed statistics as integers."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    values = (
        F.log(n),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.sqrt(F.col("n_symbols") / (n + F.col("word_chars"))),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / n),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.select("*", failed.alias("base_failed"), *(F.round(v * UNIT).cast("long").alias(name) for v, name in zip(values, STATISTICS, strict=True)))


def pooled(rows: DataFrame) -> DataFrame:
    """rows with pool: the group whose estimate judges them."""
    sizes = cut(rows.where(~F.col("base_failed")).groupBy("lang", "source").count(), "rules_sizes")
    keyed = sizes.withColumn("pool", F.when(F.col("count") >= MIN_ROWS, F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})))
    spare = keyed.where("pool is null").groupBy("lang").agg(F.sum("count").alias("in_lang"))
    spare = spare.select(F.col("lang").alias("l"), F.when(F.col("in_lang") >= MIN_ROWS, F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})).otherwise("{}").alias("spare"))
    named = keyed.join(small(spare), F.col("lang").eqNullSafe(F.col("l")), "left").select(F.col("lang").alias("l"), F.col("source").alias("s"), F.coalesce("pool", "spare").alias("pool"))
    named = cut(named, "rules_pools")
    return rows.join(small(named), F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left").drop("l", "s")


def distance(centre: list[Column], scatter: dict[tuple[int, int], Column], values: list[Column]) -> tuple[list[tuple[str, Column]], Column]:
    """Columns of the scatter's Cholesky factor and its inverse (to be added in this order), and the squared distance that uses the inverse.

    The inverse is worked out once a pool, so a row's distance is p short sums and
    not a solution whose expression doubles with each statistic.
    """
    p, steps = len(values), []
    low = lambda i, j: F.col(f"c_{i}_{j}")
    inverse = lambda i, j: F.col(f"w_{i}_{j}")
    for i in range(p):
        for j in range(i + 1):
            rest = scatter[i, j] - reduce(add, (low(i, k) * low(j, k) for k in range(j)), F.lit(0.0))
            steps.append((f"c_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / low(j, j)))
    for i in range(p):
        for j in range(i + 1):
            steps.append((f"w_{i}_{j}", (F.lit(1.0) if i == j else -reduce(add, (low(i, k) * inverse(k, j) for k in range(j, i)))) / low(i, i)))
    solved = [reduce(add, (inverse(i, k) * (values[k] - centre[k]) for k in range(i + 1))) for i in range(p)]
    return steps, reduce(add, (F.pow(x, F.lit(2.0)) for x in solved))


def factor_of() -> tuple[list[Column], Column]:
    """Columns of a scatter's factor (s_i_j to c_i_j), its inverse (w_i_j) and volume, the log of its determinant's root; the squared distance of a row joined with them."""
    p = len(STATISTICS)
    steps, far = distance([F.col(f"m{i}") for i in range(p)], {(i, j): F.col(f"s_{i}_{j}") for i in range(p) for j in range(i + 1)}, [F.col(s).cast("double") / UNIT for s in STATISTICS])
    volume = reduce(add, (F.log(f"c_{i}_{i}") for i in range(p)))
    return [*(value.alias(name) for name, value in steps), F.round(volume, 9).alias("volume")], far


def edges(joined: DataFrame, far: Column, support: float) -> DataFrame:
    """By pool and start (as p, t) the edge: the first bin of distances up to which a share `support` of the rows lies."""
    bins = joined.groupBy("pool", "start", F.floor(BINS * F.log1p(far)).alias("bin")).count()
    # a task's bins of a pool become one row before they are shuffled again, so a pool with many bins is no hot key
    lists = bins.groupBy(F.col("pool").alias("p"), F.col("start").alias("t")).agg(F.sort_array(F.collect_list(F.struct("bin", F.col("count").alias("n")))).alias("bins"), F.sum("count").alias("all"))
    state = lambda upto, edge: F.struct(upto.alias("upto"), edge.alias("edge"))
    grow = lambda a, x: state(a["upto"] + x["n"], F.coalesce(a["edge"], F.when(a["upto"] + x["n"] >= support * F.col("all"), x["bin"])))
    return lists.select("p", "t", F.aggregate("bins", state(F.lit(0).cast("bigint"), F.lit(None).cast("bigint")), grow, lambda a: a["edge"]).alias("edge"))


def moments(core: DataFrame, factor: float, also: tuple[str, ...] = ("rows",)) -> DataFrame:
    """By pool and start: centre and scatter (times factor, plus the floors) from exact sums, and the columns `also`, which a pool and start has one value of."""
    p, floor = len(STATISTICS), [f * f for f in FLOORS]
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    x = [F.col(s).cast("decimal(18,0)") for s in STATISTICS]
    sums = core.groupBy("pool", "start").agg(*(F.first(c).alias(c) for c in also), F.count("*").cast("double").alias("n"), *(F.sum(x[i]).cast("double").alias(f"u{i}") for i in range(p)), *(F.sum(x[i] * x[j]).cast("double").alias(f"v_{i}_{j}") for i, j in pairs))
    moment = lambda i, j: (F.col(f"v_{i}_{j}") / F.col("n") - F.col(f"u{i}") / F.col("n") * F.col(f"u{j}") / F.col("n")) / UNIT**2
    return sums.select("pool", "start", *also, *((F.col(f"u{i}") / F.col("n") / UNIT).alias(f"m{i}") for i in range(p)), *((factor * moment(i, j) + (floor[i] if i == j else 0.0)).alias(f"s_{i}_{j}") for i, j in pairs))


def starts(used: DataFrame) -> DataFrame:
    """Two first estimates a pool: medians with absolute deviations (start 0), means with the whole scatter (start 1)."""
    p, floor, half = len(STATISTICS), [f * f for f in FLOORS], F.lit(0.5)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    centre = used.groupBy("pool").agg(*(F.percentile(s, half).alias(f"m{i}") for i, s in enumerate(STATISTICS)), F.count("*").alias("rows"))
    centre = cut(centre, "rules_medians")
    spread = used.join(small(centre), "pool").groupBy("pool").agg(*(F.first(f"m{i}").alias(f"m{i}") for i in range(p)), F.first("rows").alias("rows"), *(F.percentile(F.round(F.abs(F.col(s) - F.col(f"m{i}"))), half).alias(f"d{i}") for i, s in enumerate(STATISTICS)))
    robust = spread.select("pool", F.lit(0).alias("start"), "rows", *((F.col(f"m{i}") / UNIT).alias(f"m{i}") for i in range(p)), *((F.pow(F.col(f"d{i}") / UNIT * 1.4826, 2) + floor[i] if i == j else F.lit(0.0)).alias(f"s_{i}_{j}") for i, j in pairs))
    plain = moments(used.join(small(centre.select(F.col("pool").alias("c"), "rows")), F.col("pool") == F.col("c")).withColumn("start", F.lit(1)), 1.0)
    return robust.unionByName(plain)


def better(wide: DataFrame) -> DataFrame:
    """Of each pool's starts the one whose core has the smallest determinant."""
    chosen = F.row_number().over(Window.partitionBy("pool").orderBy("volume", "start"))
    return wide.withColumn("chosen", chosen).where("chosen = 1").drop("chosen")


def estimates(rows: DataFrame, support: float = SUPPORT, steps: int = STEPS) -> tuple[DataFrame, Column]:
    """One row a pool (pool, rows, centre, factor, scale), and the squared distance of a row joined with it."""
    if steps < 0:
        raise ValueError("steps must be 0 or more")
    p = len(STATISTICS)
    used = rows.where(~F.col("base_failed")).select("pool", *STATISTICS)
    factor, far = factor_of()
    kept = ("pool", "start", "rows", *(f"m{i}" for i in range(p)), *(f"w_{i}_{j}" for i in range(p) for j in range(i + 1)), "volume")
    wide = cut(starts(used).select("*", *factor).select(*kept), "rules_start")
    # every table below has two rows a pool at most, so their number is counted once
    few = wide.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    sent = F.broadcast if few else (lambda table: table)
    for step in range(steps):
        joined = used.join(sent(wide), "pool")
        core = joined.join(sent(edges(joined, far, support)), (F.col("pool") == F.col("p")) & (F.col("start") == F.col("t"))).where(F.floor(BINS * F.log1p(far)) <= F.col("edge"))
        core = core.select("pool", "start", "rows", F.col("volume").alias("larger"), *STATISTICS)
        wide = cut(moments(core, CONSISTENCY, ("rows", "larger")).select("*", *factor).select(*kept, "larger"), "rules_step")
        if step == TRIED - 1:
            wide = better(wide)
        if step >= TRIED - 1 and not wide.where(F.col("larger") - F.col("volume") > SETTLED).limit(1).count():
            break
    wide = better(wide).select(*kept).drop("volume")
    middle = edges(used.join(sent(wide), "pool"), far, 0.5)
    scale = middle.select("p", F.greatest(F.expm1((F.col("edge") + 0.5) / BINS) / CHI_MEDIAN, F.lit(0.25)).alias("scale"))
    return cut(wide.join(scale, F.col("pool") == F.col("p")).drop("p", "start"), "rules_estimates"), far


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """key, counts, base_failed, distance (null without an estimate) and kept of every row."""
    rows = pooled(cut(vectors(counts(df, key, text, lang, source)), "rules_counts"))
    table, far = estimates(rows)
    apart = F.when(F.col("rows") >= MIN_ROWS, far / F.col("scale"))
    judged = rows.join(small(table), "pool", "left").withColumn("distance", apart)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)
    return judged.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
