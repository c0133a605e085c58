"""Mixing sources to target weights by capped water-filling [DataFrame functions only].

Sources share the whole supply by weight. A source whose share passes
max_epochs times its own size is clamped there and the excess is shared among
the others by weight, until no share is above its cap. The fixed point has a
closed form: with sources sorted by cap / weight, the first one for which
level = (total - caps before) / (weights from here on) is no more than its own
cap / weight ends the clamping, and every target is least(cap, level * weight).

A target is target // size whole repetitions of the source plus a fraction.
The fraction is a seeded sample of whole documents: documents hash, by seed, id
and text (MD5, which any SQL engine has), to 4096 cells of 4096 sub-cells each; cells are taken in order until the fraction is
full, the boundary cell by sub-cells, the boundary sub-cell if that comes
nearer. So a source is never sorted, and a hot one is never in one task: per
source only 2 * 4096 sums exist, summed before they are shuffled.

Null text has size 0; a null source is a source of its own, last in order.
Documents of size 0 take 0 words. Texts are counted whole, however long. A null
id is an id like any other, its rows told apart by their texts. Rows that repeat
id and text are separate documents of one hash and stay or go together. An empty table gives no rows. Other columns of
the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import WORD, cut

WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, 7
CELLS = 4096
#: Source tables of so many rows at most are broadcast; larger ones join by shuffle.
BROADCAST_SOURCES = 10_000


def small(table: DataFrame, rows: int = BROADCAST_SOURCES) -> DataFrame:
    """table with a broadcast hint if its size, counted here, allows it."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def water_fill(sources: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sources (one row each: source, source_size) with target; weights repeat over sources by code point, null last."""
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("__ratio", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("__ratio", F.col("__cap") / F.col("__w"))
    rows = rows.select(
        "*",
        (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("__cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).alias("__left"),
        F.sum("__w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)).alias("__open"),
    )
    level = F.min(F.when(F.col("__left") / F.col("__open") <= F.col("__ratio"), F.struct("__ratio", (F.col("__left") / F.col("__open")).alias("level")))).over(Window.partitionBy())["level"]
    return rows.select("source", "source_size", F.least(F.col("__cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("__w")).cast("double").alias("target"))


def with_cells(df: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    """df's columns with __source, __size, __cell and __sub."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    content = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    h = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("/"), content).cast("binary"))
    digits = lambda at: F.conv(F.substring(h, at, 3), 16, 10).cast("int")
    return df.select("*", F.col(source).alias("__source"), size.alias("__size"), digits(1).alias("__cell"), digits(4).alias("__sub"))


def plan(sized: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row a source: s, source_size, target, whole (repetitions of every row), edge and sub_end (cells with one more)."""
    same = F.col("source").eqNullSafe(F.col("s"))
    cells = cut(sized.groupBy(F.col("__source").alias("source"), F.col("__cell").alias("cell")).agg(F.sum("__size").alias("words")), "mix_cells")
    targets = cut(water_fill(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs).withColumnRenamed("source", "s"), "mix_targets")
    quota = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - quota * F.col("source_size")
    sum_before = lambda order: F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = cells.join(small(targets), same).select("source", "cell", "words", rest.alias("rest"), sum_before("cell").alias("before"))
    edge = edge.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    edge = cut(edge.select(F.col("source").alias("e"), F.col("cell").alias("edge"), (F.col("rest") - F.col("before")).alias("edge_rest")), "mix_edges")
    inside = sized.join(small(edge), F.col("__source").eqNullSafe(F.col("e")) & (F.col("__cell") == F.col("edge")))
    subs = inside.groupBy(F.col("__source").alias("source"), F.col("__sub").alias("sub"), "edge_rest").agg(F.sum("__size").alias("words"))
    # the first sub-cell that stays out; none: all of the edge cell goes in
    out = subs.select("source", "sub", (sum_before("sub") + F.col("words") / 2 > F.col("edge_rest")).alias("out"))
    out = out.groupBy(F.col("source").alias("o")).agg(F.min(F.when(F.col("out"), F.col("sub"))).alias("sub_end"))
    joined = targets.join(edge, F.col("s").eqNullSafe(F.col("e")), "left").join(out, F.col("s").eqNullSafe(F.col("o")), "left")
    edges = F.coalesce("edge", F.when(rest > 0, CELLS).otherwise(-1)).alias("edge")
    return cut(joined.select("s", "source_size", "target", quota.cast("long").alias("whole"), edges, F.coalesce("sub_end", F.lit(CELLS)).alias("sub_end")), "mix_plan")


def repeated(sized: DataFrame, sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sized with its source's row of the plan and __copies, the repetitions of the row."""
    extra = (F.col("__cell") < F.col("edge")) | ((F.col("__cell") == F.col("edge")) & (F.col("__sub") < F.col("sub_end")))
    return sized.join(small(sources), F.col("__source").eqNullSafe(F.col("s"))).withColumn("__copies", F.least(F.col("whole") + extra.cast("long"), F.lit(int(max_epochs))))


def mix(df: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, size, source_size, target, copies (repetitions of the row) and taken (words) of every row."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source"))
    sized = cut(with_cells(rows, "key", "text", "source", seed).drop("text", "source"), "mix_sizes")
    out = repeated(sized, plan(sized, weights, max_epochs), max_epochs)
    return out.select(F.col("key").alias(key), F.col("__source").alias("source"), F.col("__size").alias("size"), "source_size", "target", F.col("__copies").alias("copies"), (F.col("__copies") * F.col("__size")).alias("taken"))


def mixed(df: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: df's columns, each row as often as the mix takes it."""
    own = df.columns
    sizes = cut(with_cells(df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source")), "key", "text", "source", seed).drop("text", "source"), "mix_sizes")
    sources = plan(sizes, weights, max_epochs)
    inner = df.toDF(*(f"c{i}" for i in range(len(own))))  # the plan's names may clash with df's
    name = {c: f"c{i}" for i, c in enumerate(own)}
    out = repeated(with_cells(inner, name[key], name[text], name[source], seed), sources, max_epochs)
    out = out.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return out.select(*(F.col(name[c]).alias(c) for c in own))
