"""Baselines, fold-safe preparation, rolling backtests, metrics, intervals."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import weighted_present
from . import ranks, sketches


@dataclass
class Preparation:
    """Imputation, bounds and missing flags of features, learned from training rows only.

    ``impute`` is median, mean or zero; values are held within the ``tails`` quantiles when there are
    ``least`` rows at least; with ``scale``, features and flags are standardised (population deviation).
    """

    features: list[str]
    impute: str = "median"
    tails: tuple[float, float] = (0.005, 0.995)
    least: int = 20
    scale: bool = False
    learned: dict = field(default_factory=dict)

    def fit(self, train: DataFrame) -> Preparation:
        """One aggregate over the training rows, whatever the number of features; one more to scale."""
        f = self.features
        parts = [F.count("*").alias("n")]
        for c in f:
            x = F.col(c).cast("double")
            fill = {"median": F.median(x), "mean": F.avg(x), "zero": F.lit(0.0)}[self.impute]
            parts += [fill.alias(f"f_{c}"), F.percentile(x, F.lit(self.tails[0])).alias(f"l_{c}"), F.percentile(x, F.lit(self.tails[1])).alias(f"h_{c}"), F.count_if(x.isNull()).alias(f"m_{c}")]
        r = train.agg(*parts).first().asDict()
        self.learned = {c: (r[f"f_{c}"] or 0.0, r[f"l_{c}"] if r["n"] >= self.least else None, r[f"h_{c}"] if r["n"] >= self.least else None, bool(r[f"m_{c}"])) for c in f}
        self.scales = {}
        if self.scale:
            s = self.transform(train).agg(*[g(c).alias(f"{n}_{c}") for c in self.outputs() for n, g in (("m", F.avg), ("s", F.stddev_pop))]).first().asDict()
            self.scales = {c: (s[f"m_{c}"], s[f"s_{c}"] or 1.0) for c in self.outputs()}
        return self

    def outputs(self) -> list[str]:
        return [f"x_{c}" for c in self.features] + [f"missing_{c}" for c, v in self.learned.items() if v[3]]

    def transform(self, rows: DataFrame) -> DataFrame:
        new = {}
        for c, (fill, lo, hi, missing) in self.learned.items():
            x = F.coalesce(F.col(c).cast("double"), F.lit(float(fill)))
            new[f"x_{c}"] = x if lo is None else F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
            if missing:
                new[f"missing_{c}"] = F.col(c).isNull().cast("double")
        d = rows.withColumns(new)
        return d.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in getattr(self, "scales", {}).items()})


def minimum_volume(rows: DataFrame, guards: dict[str, tuple[str, float]]) -> DataFrame:
    """Rates become null under their volume."""
    return rows.withColumns({r: F.when(F.col(v) >= m, F.col(r)) for r, (v, m) in guards.items()})


def baselines(stat: str) -> dict[str, Column]:
    """Predictions without a model, from a pair's columns: last total, per game times 17, two and three weighted seasons."""
    x, one, two = F.col(stat), F.col(f"prev_{stat}"), F.col(f"prev2_{stat}")
    return {
        "previous_total": x.cast("double"), "per_game": F.try_divide(x.cast("double"), F.col("games")) * F.lit(17.0),
        "two_year": weighted_present([(x, 0.65), (one, 0.35)]), "three_year": weighted_present([(x, 0.5), (one, 0.3), (two, 0.2)]),
    }


def group_mean(train: DataFrame, test: DataFrame, keys: list[str], target: str, name: str, least: int = 5) -> DataFrame:
    """Mean outcome of the training rows of a group, else of its first key, else of all."""
    full = train.groupBy(*keys).agg(F.avg(target).alias("_a"), F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    part = train.groupBy(keys[0]).agg(F.avg(target).alias("_b"))
    whole = train.agg(F.avg(target).alias("_c"))
    d = test.join(full, keys, "left").join(part, keys[0], "left").join(F.broadcast(whole))  # a single row
    return d.withColumn(name, F.coalesce("_a", "_b", "_c")).drop("_a", "_b", "_c")


def tier_median(train: DataFrame, test: DataFrame, volume: str, target: str, name: str, exact: bool = False) -> DataFrame:
    """Median outcome of the quartile of volume, by quartile edges of the training rows.

    From quantile sketches, or exactly (linear between values).
    """
    if exact:
        edges = ranks.quantiles(train, [], F.col(volume), {"a": 0.25, "b": 0.5, "c": 0.75}).select(F.array("a", "b", "c").alias("q"))
    else:
        edges = sketches.states(train, [], F.col(volume)).select(F.array(*[sketches.quantile("state", p) for p in (0.25, 0.5, 0.75)]).alias("q"))
    tier = lambda: F.size(F.filter("q", lambda e: e < F.col(volume)))
    marked = train.join(F.broadcast(edges)).withColumn("_t", tier())  # a single row
    if exact:
        medians = ranks.quantiles(marked, ["_t"], F.col(target), {name: 0.5}).drop("n")
    else:
        medians = sketches.states(marked, ["_t"], F.col(target)).select("_t", sketches.quantile("state", 0.5).alias(name))
    return test.join(F.broadcast(edges)).withColumn("_t", tier()).join(F.broadcast(medians), "_t", "left").drop("_t", "q")  # four rows


#: Learners by name.  Spark has no extremely random trees and no histogram boosting: forests and boosted trees stand in.
LEARNERS = {
    "ridge": lambda x, y, n, s: LinearRegression(featuresCol=x, labelCol=y, solver="l-bfgs", standardization=False, regParam=10.0 * s / max(n, 1), elasticNetParam=0.0),
    "elastic_net": lambda x, y, n, s: LinearRegression(featuresCol=x, labelCol=y, regParam=0.1 * s, elasticNetParam=0.5),
    "random_forest": lambda x, y, n, s: RandomForestRegressor(featuresCol=x, labelCol=y, numTrees=60, maxDepth=6, seed=7),
    "boosted_trees": lambda x, y, n, s: GBTRegressor(featuresCol=x, labelCol=y, maxIter=30, maxDepth=4, seed=7),
}


def train(pairs: DataFrame, features: list[str], target: str, learner: str = "ridge"):
    """A fitted preparation, the columns it makes, and a fitted model."""
    prep = Preparation(features, scale=learner in ("ridge", "elastic_net")).fit(pairs)
    d = VectorAssembler(inputCols=prep.outputs(), outputCol="_x").transform(prep.transform(pairs)).withColumn("_y", F.col(target).cast("double"))
    n, s = d.agg(F.count("*"), F.coalesce(F.stddev_samp("_y"), F.lit(1.0))).first()
    return prep, LEARNERS[learner]("_x", "_y", n, s or 1.0).fit(d.select("_x", "_y"))


def predict(model, rows: DataFrame, name: str = "prediction") -> DataFrame:
    prep, fitted = model
    d = VectorAssembler(inputCols=prep.outputs(), outputCol="_x").transform(prep.transform(rows))
    return fitted.transform(d).withColumnRenamed("prediction", name).select(*rows.columns, name)


def backtest(pairs: DataFrame, features: list[str], target: str, seasons: list[int], learners: list[str], least: int = 150) -> DataFrame:
    """Rolling origin: each season is predicted from those before it: ``player_id, target_season, model, predicted, actual``."""
    out = []
    for season in seasons:
        past, now = pairs.where(F.col("target_season") < season), pairs.where(F.col("target_season") == season)
        if past.count() < least:
            continue
        d = now
        for k in learners:
            d = predict(train(past, features, target, k), d, f"p_{k}")
        named = {n: c for n, c in baselines(target.removeprefix("outcome_")).items()} | {k: F.col(f"p_{k}") for k in learners}
        each = F.array(*[F.struct(F.lit(n).alias("model"), c.cast("double").alias("predicted")) for n, c in named.items()])
        out.append(d.withColumn("_m", F.explode(each)).select("player_id", "target_season", "_m.model", "_m.predicted", F.col(target).cast("double").alias("actual")))
    if not out:  # no season has enough rows before it
        return pairs.where(F.lit(False)).select("player_id", "target_season", F.lit("").alias("model"), F.lit(0.0).alias("predicted"), F.col(target).cast("double").alias("actual"))
    return reduce(DataFrame.unionByName, out)


def regression_metrics(rows: DataFrame, by: list[str], predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """n, mae, rmse, median absolute error, r2 (null without variance), bias: one aggregate."""
    e = F.col(predicted) - F.col(actual)
    ok = rows.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    return ok.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.median(F.abs(e)).alias("median_error"),
        F.try_divide(F.lit(1.0) * (F.var_pop(actual) - F.avg(e * e)), F.var_pop(actual)).alias("r2"), F.avg(e).alias("bias"),
    )


def best_models(metrics: DataFrame) -> DataFrame:
    """The model with the lowest mean error over folds; baselines may win."""
    m = metrics.groupBy("model").agg(F.avg("mae").alias("mae"), F.count("*").alias("folds"))
    return m.orderBy("mae", "model").limit(1)


def ensemble_weights(metrics: DataFrame, k: int = 3) -> DataFrame:
    """The k best models, weighted by inverse error."""
    m = metrics.groupBy("model").agg(F.avg("mae").alias("mae")).where("mae > 0").orderBy("mae", "model").limit(k)
    return m.withColumn("weight", (1 / F.col("mae")) / F.sum(1 / F.col("mae")).over(Window.partitionBy()))


def rank_metrics(rows: DataFrame, by: list[str], tops: tuple[int, ...] = (12, 24, 50)) -> DataFrame:
    """Spearman correlation (mean ranks on ties), mean rank error, and overlap of the tops as a share of each size."""
    m = ranks.rank_metrics(rows, by, tops=tops, with_kendall=False, least=1, whole=False)
    return m.select(*by, "spearman", F.col("mean_rank_error").alias("rank_error"), *[f"top{k}" for k in tops])


def kendall(rows: DataFrame, by: list[str]) -> DataFrame:
    """Kendall's tau-b of predicted and actual values within groups, by counted inversions."""
    return ranks.kendall(rows, by, "predicted", "actual").select(*by, "kendall")


def interval_bounds(train: DataFrame, by: list[str], low: float = 0.2, high: float = 0.8, least: int = 40, exact: bool = False) -> DataFrame:
    """Residual quantiles by group; a group with fewer than ``least`` rows gets those of all rows.

    From quantile sketches, those of all rows merged from the groups'; or exactly (linear between values).
    """
    r = train.withColumn("_r", F.col("actual") - F.col("predicted"))
    if exact:
        own = ranks.matched(r.groupBy(*by).agg(F.count("*").alias("n")), ranks.quantiles(r, by, F.col("_r"), {"lo": low, "hi": high}).drop("n"), by)
        whole = ranks.quantiles(r, [], F.col("_r"), {"_lo": low, "_hi": high}).drop("n")
    else:
        parts = sketches.states(r, by, F.col("_r"))
        q = lambda p: sketches.quantile("state", p)
        own = parts.select(*by, "n", q(low).alias("lo"), q(high).alias("hi"))
        whole = sketches.merged(parts, []).select(q(low).alias("_lo"), q(high).alias("_hi"))
    few = F.col("n") < least
    return own.join(F.broadcast(whole)).select(*by, "n", F.when(few, F.col("_lo")).otherwise(F.col("lo")).alias("lo"), F.when(few, F.col("_hi")).otherwise(F.col("hi")).alias("hi"))  # a single row


def calibration(rows: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """Share of outcomes inside their range, and the mean width."""
    d = rows.join(bounds.select(*by, "lo", "hi"), by)
    inside = (F.col("actual") >= F.col("predicted") + F.col("lo")) & (F.col("actual") <= F.col("predicted") + F.col("hi"))
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.avg(inside.cast("double")).alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("width"))


def contributions(rows: DataFrame, weights: dict[str, float], most: int = 4, share: float = 0.12) -> DataFrame:
    """The features that move a prediction most, up and down, at least ``share`` of the strongest."""
    each = F.array(*[F.struct((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(w)).alias("effect"), F.lit(c).alias("feature")) for c, w in weights.items()])
    d = rows.withColumn("_e", F.array_sort(each, lambda a, b: F.when(F.abs(a["effect"]) > F.abs(b["effect"]), -1).when(F.abs(a["effect"]) < F.abs(b["effect"]), 1).when(a["feature"] < b["feature"], -1).otherwise(1)))
    peak = F.abs(F.get("_e", F.lit(0))["effect"])
    strong = F.filter("_e", lambda x: (F.abs(x["effect"]) >= F.lit(share) * peak) & (x["effect"] != 0))
    side = lambda up: F.slice(F.filter(strong, lambda x: (x["effect"] > 0) if up else (x["effect"] < 0)), 1, most)
    return d.withColumn("raises", F.transform(side(True), lambda x: x["feature"])).withColumn("lowers", F.transform(side(False), lambda x: x["feature"])).drop("_e")
