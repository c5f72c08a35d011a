"""Mixing sources to target weights with distributed prefix sums (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: str = "text") -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Budgets of sources: ``sizes(source, source_size)`` plus ``target double``.

    Sources in order of code points, null last, weigh ``weights``, repeating.  They divide ``share`` times
    all words by weight; none gets over ``max_epochs`` times its size, and the excess goes to the others by
    weight.  Solved in closed form: sources sorted by cap per weight are capped as long as that ratio is
    not above the level that the sources after them would get.  One row per source goes through the two
    windows, never one per document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    n = len(weights)
    w = sizes.withColumn("_k", (F.row_number().over(order) - 1) % n)
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_k") + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * F.lit(max_epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    w = w.withColumn("total", F.sum("source_size").over(whole) * F.lit(share)).withColumn("all_w", F.sum("weight").over(whole))
    w = w.withColumn("level", F.try_divide(F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.col("all_w") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    free = w.withColumn("open", F.when(F.col("ratio") > F.col("level"), F.col("level")))
    free = free.withColumn("final", F.first("open", ignorenulls=True).over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return free.select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """How much of each document the mix takes: ``doc_id, size, source_size, target, taken``, per row.

    Each document gets a hash-random key from its id.  A source's documents are sorted by key and taken
    until its budget is used up: whole epochs first, then documents up to the cut; of the document at the
    cut, the words that still fit.  Prefix sums are built from range cells of the key: sums per (source,
    cell), prefix sums of those, then prefix sums inside a cell.  There are about sqrt(rows) cells, so
    neither level gathers a hot source in one task.

    Null text counts 0 words; null ids and null sources are ordinary values; repeated rows are separate
    documents (ties by key are ordered by id and size, so equal rows are interchangeable); an empty table
    gives no rows; other columns are ignored.
    """
    sized = docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("key"))
    return _taken(cut(sized), weights, share, max_epochs)


def _taken(d: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    cells = 1 << max(1, math.ceil(math.log2(max(1, d.count())) / 2))
    bits = cells.bit_length() - 1
    d = d.withColumn("cell", F.shiftright("key", 64 - bits)).withColumn("src", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
    sums = d.groupBy("src", "cell").agg(F.sum("size").alias("cell_size"))
    sizes = sums.groupBy("src").agg(F.sum("cell_size").alias("source_size"))
    goal = source_targets(sizes.select(F.when(~F.col("src.none"), F.col("src.name")).alias("source"), "source_size"), weights, share, max_epochs)
    goal = goal.select(F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("src"), "source_size", "target")
    upto = Window.partitionBy("src").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.withColumn("start", F.coalesce(F.sum("cell_size").over(upto), F.lit(0))).drop("cell_size").join(goal, "src")
    inside = Window.partitionBy("src", "cell").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(start, ["src", "cell"]).withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    words = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size")).cast("long")).otherwise(0)
    rest = words - F.col("epochs") * F.col("source_size")
    d = d.withColumn("epochs", epochs).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))).cast("long"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), *[c for c in d.columns if c.startswith("_")])


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: rows of ``docs``, all columns, each as often as the mix takes it.

    Documents are kept whole: the one at the cut is taken when at least half of it fits.  A document
    without words is neutral to every budget and stays once.
    """
    cols = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in cols])
    seed = options.pop("seed", 17)
    opts = {"weights": WEIGHTS, "share": 1.5, "max_epochs": 2.0} | options
    d = docs.select(F.col("doc_id"), F.col("source"), word_count().alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("key"), whole.alias("_row"))
    d = _taken(d, **opts)
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    return d.where(times > 0).select(F.explode(F.array_repeat("_row", times)).alias("r")).select(*[F.col(f"r.`{c}`") for c in cols])
