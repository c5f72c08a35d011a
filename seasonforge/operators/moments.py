"""Linear models from sufficient statistics: rolling backtests, tuning and a registry, each as one plan.

The sums of products of a row's features and outcomes are added up once for each group and season.  Sums
over all seasons up to one (prefix sums) are all that a fold needs: any ridge or elastic net of any fold,
target and parameter set is a small solve, and no data is read again for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import written
from .projection import adjust, compose, fallback

#: Groups of which a task holds sums at once; then they are passed on.  Bounds memory, not results.
HELD = 256


@dataclass(frozen=True)
class Design:
    """Features and targets of a family of models.  A row's vector is 1, the features, their missing flags, the targets.

    Missing features count 0 in the vector; how a model fills them is decided when it is fitted.
    """

    features: tuple[str, ...]
    targets: tuple[str, ...]

    @property
    def inputs(self) -> int:
        return 1 + 2 * len(self.features)

    def vector(self) -> Column:
        """What a model's weights are applied to."""
        x = [F.col(c).cast("double") for c in self.features]
        x = [F.when(F.isnan(c), None).otherwise(c) for c in x]
        return F.array(F.lit(1.0), *[F.coalesce(c, F.lit(0.0)) for c in x], *[c.isNull().cast("double") for c in x])

    def outcomes(self) -> Column:
        return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.targets])


def moments(rows: DataFrame, by: list[str], design: Design) -> DataFrame:
    """``by, gram``: the sums of products of the rows' vectors (inputs, then targets), row after row, for each group.

    Tasks add up their rows group by group; only those sums are shuffled, place by place.
    """
    size = design.inputs + len(design.targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            flat = pa.array([x.ravel() for x in held.values()], pa.list_(pa.float64()))
            keys = [pa.array([k[i] for k in held], kinds[i]) for i in range(len(by))]
            return pa.RecordBatch.from_arrays([*keys, flat], [*by, "gram"])

        kinds: list[pa.DataType] = []
        for b in batches:
            kinds = [b[c].type for c in by]
            z = b["z"].flatten().to_numpy().reshape(-1, size)
            keys = list(zip(*[b[c].to_pylist() for c in by], strict=True))
            code = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            of = np.array([code[k] for k in keys])
            for k, i in code.items():
                own = z[of == i]
                held[k] = held.get(k, 0.0) + own.T @ own
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    d = rows.select(*by, F.concat(design.vector(), design.outcomes()).alias("z"))
    partial = d.mapInArrow(run, ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in by) + ", gram array<double>")
    summed = partial.select(*by, F.posexplode("gram").alias("at", "v")).groupBy(*by, "at").agg(F.sum("v").alias("v"))
    return _packed(summed, by)


def _packed(places: DataFrame, by: list[str]) -> DataFrame:
    return places.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("gram"))


def through(sums: DataFrame, by: list[str], season: str) -> DataFrame:
    """Prefix sums: the moments of all seasons of a group up to each of its seasons."""
    upto = Window.partitionBy(*by, "at").orderBy(season).rowsBetween(Window.unboundedPreceding, 0)  # a row for each season
    each = sums.select(*by, season, F.posexplode("gram").alias("at", "v"))
    return _packed(each.withColumn("v", F.sum("v").over(upto)), [*by, season])


def folds(sums: DataFrame, by: list[str], season: str, holdout: int = 2) -> DataFrame:
    """``by, fold, past, held, before``: for each season of a group the last one before it, the ``holdout`` last
    ones, and the last one before those; with no more than ``holdout`` seasons before it only the last is held
    out.  ``before`` is null where nothing is left to fit on."""
    order = Window.partitionBy(*by).orderBy(season)  # a row for each season
    last = [F.lag(season, k).over(order) for k in range(1, holdout + 2)]
    d = sums.select(*by, F.col(season).alias("fold"), *[c.alias(f"_l{k}") for k, c in enumerate(last, 1)])
    enough = F.col(f"_l{holdout + 1}").isNotNull()
    held = F.when(enough, F.array(*[F.col(f"_l{k}") for k in range(1, holdout + 1)])).otherwise(F.array("_l1"))
    return d.where("_l1 is not null").select(*by, "fold", F.col("_l1").alias("past"), held.alias("held"), F.when(enough, F.col(f"_l{holdout + 1}")).otherwise(F.col("_l2")).alias("before"))


# ---- models


def parameter_sets(spark: SparkSession, space: dict[str, list[float]], n: int | None = None, seed: int = 371) -> DataFrame:
    """``trial, alpha, l1, impute, scale``: the whole grid of a search space, or ``n`` sets of it by hash: without repeats, the same for a seed.

    Parameters that the space leaves out: alpha 10, l1 0 (ridge), impute "zero", scale False.
    """
    full = {"alpha": [10.0], "l1": [0.0], "impute": ["zero"], "scale": [False]} | space
    grid = list(dict.fromkeys(product(*[full[k] for k in ("alpha", "l1", "impute", "scale")])))
    d = spark.createDataFrame([(i, float(a), float(r), m, bool(s)) for i, (a, r, m, s) in enumerate(grid, 1)], "trial int, alpha double, l1 double, impute string, scale boolean")
    return d if n is None else d.orderBy(F.xxhash64(F.lit(seed), "alpha", "l1", "impute", "scale"), "trial").limit(n)


def solve(gram: np.ndarray, inputs: int, alpha: float, l1: float = 0.0, impute: str = "zero", scale: bool = False) -> np.ndarray:
    """Weights of each target (rows) on the input vector, from the sums of products.

    ``l1`` 0: ridge with penalty ``alpha``; otherwise an elastic net with that share of absolute penalty, whose
    loss is the mean square.  ``impute`` zero or mean (of the present); with ``scale``, features are divided by
    their population deviation and missing flags are features too.  The intercept is not penalised.
    """
    p = (inputs - 1) // 2
    n, zz, zy = gram[0, 0], gram[:inputs, :inputs], gram[:inputs, inputs:]
    fill = np.zeros(p)
    if impute == "mean":
        present = n - gram[0, 1 + p : inputs]
        fill = np.divide(gram[0, 1 : 1 + p], present, out=np.zeros(p), where=present > 0)
    to = np.hstack([np.zeros((p, 1)), np.eye(p), np.diag(fill)])  # features from the vector
    if scale:
        flags = np.hstack([np.zeros((p, 1 + p)), np.eye(p)])
        to = np.vstack([to, flags[gram[0, 1 + p : inputs] > 0]])
    mean, target = to @ zz[:, 0] / n, zy[0] / n
    c, cy = to @ zz @ to.T - n * np.outer(mean, mean), to @ zy - n * np.outer(mean, target)
    if scale:
        sd = np.sqrt(np.maximum(np.diag(c) / n, 0))
        sd[sd <= 1e-12] = 1.0
        c, cy, to, mean = c / sd / sd[:, None], cy / sd[:, None], to / sd[:, None], mean / sd
    if l1 == 0:
        a = c + alpha * np.eye(len(c))
        try:
            w = np.linalg.solve(a, cy)
        except np.linalg.LinAlgError:
            w = np.linalg.lstsq(a, cy, rcond=None)[0]
    else:
        w = np.stack([_descend(c / n, y / n, alpha * l1, alpha * (1 - l1)) for y in cy.T], axis=1)
    weights = w.T @ to
    weights[:, 0] += target - w.T @ mean
    return weights


def _descend(c: np.ndarray, cy: np.ndarray, absolute: float, square: float, rounds: int = 1000, close: float = 1e-10) -> np.ndarray:
    """Elastic net by coordinate descent on covariances."""
    w = np.zeros(len(cy))
    for _ in range(rounds):
        most = 0.0
        for j in range(len(w)):
            if c[j, j] <= 0:
                continue
            rest = cy[j] - c[j] @ w + c[j, j] * w[j]
            new = np.sign(rest) * max(0.0, abs(rest) - absolute) / (c[j, j] + square)
            most = max(most, abs(new - w[j]) * np.sqrt(c[j, j]))
            w[j] = new
        if most <= close * max(1.0, float(np.sqrt(np.abs(cy).max(initial=0.0)))):
            break
    return w


def fit(prefix: DataFrame, by: list[str], design: Design, trials: DataFrame) -> DataFrame:
    """``by, trial, target, n, weights``: one small solve for each row of prefix sums and parameter set; ``n`` are the training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = design.inputs + len(design.targets)
        for b in batches:
            for i in range(b.num_rows):
                g = b["gram"][i].values.to_numpy().reshape(size, size)
                w = solve(g, design.inputs, *[b[c][i].as_py() for c in ("alpha", "l1", "impute", "scale")])
                k = len(design.targets)
                keys = [pa.array([b[c][i].as_py()] * k, b[c].type) for c in (*by, "trial")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(design.targets), pa.array([int(g[0, 0])] * k, pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], [*by, "trial", "target", "n", "weights"])

    d = prefix.join(F.broadcast(trials))  # a row for each parameter set
    kinds = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in by)
    return d.select(*by, "gram", "trial", "alpha", "l1", "impute", "scale").mapInArrow(run, f"{kinds}, trial int, target string, n long, weights array<double>")


def dot(weights: str, size: int, vector: str = "_z") -> Column:
    """The product of weights and a vector of that size, place by place, so that Spark compiles it."""
    return reduce(lambda a, i: a + F.get(weights, F.lit(i)) * F.get(vector, F.lit(i)), range(size), F.lit(0.0))


def _long(rows: DataFrame, keys: list[str], design: Design) -> DataFrame:
    """``keys, target, actual, _z``: a row for each target."""
    each = F.array(*[F.struct(F.lit(t).alias("target"), F.coalesce(F.col(t).cast("double"), F.lit(0.0)).alias("actual")) for t in design.targets])
    return rows.select(*keys, design.vector().alias("_z"), F.explode(each).alias("_t")).select(*keys, "_z", "_t.target", "_t.actual")


class Backtest:
    """Rolling-origin backtests of one family of models over all groups, targets and seasons.

    ``pairs``: rows with the group columns, ``player_id``, the outcome season, features and outcomes.  Each
    season of a group is predicted from all its seasons before, of which there must be ``least`` rows.
    """

    def __init__(self, pairs: DataFrame, design: Design, by: list[str] | None = None, season: str = "target_season", least: int = 150):
        self.design, self.by, self.season, self.least = design, by or ["position"], season, least
        self.pairs = written(pairs.where(F.col(season).isNotNull()).select(*self.by, season, "player_id", *dict.fromkeys([*design.features, *design.targets])))  # read for the sums, and once more to be predicted
        self.sums = written(moments(self.pairs, [*self.by, season], design))  # a row for each group and season
        self.prefix = through(self.sums, self.by, season)

    def models(self, trials: DataFrame) -> DataFrame:
        """``by, past, trial, target, n, weights``: what each parameter set learns from all seasons up to ``past``."""
        return fit(self.prefix.withColumnRenamed(self.season, "past"), [*self.by, "past"], self.design, trials)

    def tuned(self, trials: DataFrame, holdout: int = 2, models: DataFrame | None = None) -> DataFrame:
        """``by, fold, target, trial, mae``: for each fold the parameter set with the least mean error on its last seasons before.

        The fold's season itself is never looked at.  All parameter sets of all folds are scored in one pass;
        ties go to the first set.  Folds with nothing to fit on before their held-out seasons are left out.
        """
        models = written(self.models(trials)) if models is None else models  # a table, so that Spark knows how small it is
        inner = folds(self.sums, self.by, self.season, holdout).where("before is not null")
        held = inner.select(*self.by, "fold", "before", F.explode("held").alias(self.season))
        rows = _long(self.pairs, [*self.by, self.season], self.design).join(F.broadcast(held), [*self.by, self.season])  # rows for each group and season
        m = models.withColumnRenamed("past", "before").select(*self.by, "before", "trial", "target", "weights")
        scored = rows.join(m, [*self.by, "before", "target"])
        mae = scored.groupBy(*self.by, "fold", "target", "trial").agg(F.avg(F.abs(dot("weights", self.design.inputs) - F.col("actual"))).alias("mae"))
        best = mae.groupBy(*self.by, "fold", "target").agg(F.min(F.struct("mae", "trial")).alias("b"))
        return best.select(*self.by, "fold", "target", "b.trial", "b.mae")

    def predictions(self, trials: DataFrame, name: str, tuned: bool = False, default: int = 1, holdout: int = 2) -> DataFrame:
        """``by, season, target, player_id, model, predicted, actual`` of every fold; with ``tuned``, each by its own best parameter set."""
        models = written(self.models(trials))  # read to be tuned and to predict
        fold = folds(self.sums, self.by, self.season, holdout).select(*self.by, F.col("fold").alias(self.season), "past")
        m = models.where(F.col("n") >= self.least).join(F.broadcast(fold), [*self.by, "past"])  # a row for each group and season
        if tuned:
            best = self.tuned(trials, holdout, models).select(*self.by, F.col("fold").alias(self.season), "target", F.col("trial").alias("_best"))
            m = m.join(best, [*self.by, self.season, "target"], "left").where(F.col("trial") == F.coalesce("_best", F.lit(default)))
        else:
            m = m.where(F.col("trial") == default)
        rows = _long(self.pairs, [*self.by, self.season, "player_id"], self.design)
        out = rows.join(written(m.select(*self.by, self.season, "target", "weights")), [*self.by, self.season, "target"])
        return out.select(*self.by, self.season, "target", "player_id", F.lit(name).alias("model"), dot("weights", self.design.inputs).alias("predicted"), "actual")


def comparison(fold_metrics: DataFrame, by: list[str]) -> DataFrame:
    """Mean metrics of each model over its folds, number of folds and rows, and whether it has the least mean error (ties: first by name)."""
    m = fold_metrics.groupBy(*by, "model").agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg("r2").alias("r2"), F.avg("bias").alias("bias"), F.sum("n").alias("n"), F.count("*").alias("folds"))
    best = m.where("mae is not null").groupBy(*by).agg(F.min(F.struct("mae", "model")).alias("_b"))
    return m.join(best, by, "left").withColumn("selected", F.coalesce(F.col("model") == F.col("_b.model"), F.lit(False))).drop("_b")


# ---- registry


def register(registry: DataFrame | None, models: DataFrame) -> DataFrame:
    """A registry with more models: ``position, target, model_version, trained_at, features, weights``.

    A model replaces the one of the same position, target and version; of several new ones the last trained.
    """
    keys = ["position", "target", "model_version"]
    rest = [c for c in models.columns if c not in (*keys, "trained_at")]
    last = models.groupBy(*keys).agg(F.max(F.struct("trained_at", *rest)).alias("_m")).select(*keys, "_m.trained_at", *[F.col(f"_m.{c}") for c in rest])
    return last if registry is None else registry.join(last, keys, "left_anti").unionByName(last)


def latest(registry: DataFrame) -> DataFrame:
    """The model of each position and target that was trained last; ties to the greater version."""
    keys = ["position", "target"]
    rest = [c for c in registry.columns if c not in (*keys, "trained_at", "model_version")]
    best = registry.groupBy(*keys).agg(F.max(F.struct("trained_at", "model_version", *rest)).alias("_m"))
    return best.select(*keys, "_m.trained_at", "_m.model_version", *[F.col(f"_m.{c}") for c in rest])


def save_registry(registry: DataFrame, path: str, snapshot: int) -> None:
    """Writes a snapshot beside the earlier ones, which stay whole if the write fails."""
    registry.write.mode("errorifexists").parquet(f"{path}/snapshot={snapshot}")


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """The last snapshot."""
    d = spark.read.parquet(path)
    return d.where(F.col("snapshot") == d.agg(F.max("snapshot")).first()[0]).drop("snapshot")


def registered(rows: DataFrame, registry: DataFrame, targets: list[str]) -> DataFrame:
    """``pred_*`` and ``version_*`` of each target by its position's last trained model; null where there is none.

    A model is an intercept and weights of named features; a feature that is missing, or that the rows have
    no column of, counts 0.
    """
    names = sorted({r.f for r in registry.select(F.explode("features").alias("f")).distinct().collect()})  # as many as columns
    have = [c for c in names if c in rows.columns]
    values = F.create_map(*[x for c in have for x in (F.lit(c), F.coalesce(F.col(c).cast("double"), F.lit(0.0)))]) if have else F.create_map().cast("map<string,double>")
    m = latest(registry).where(F.col("target").isin(*targets))
    of = m.groupBy("position").agg(F.map_from_entries(F.collect_list(F.struct("target", F.struct("intercept", "features", "weights", "model_version")))).alias("_models"))  # as many as targets
    d = rows.withColumn("_v", values).join(F.broadcast(of), "position", "left")  # a row for each position
    new = {}
    for t in targets:
        model = F.try_element_at("_models", F.lit(t))
        terms = F.zip_with(model["features"], model["weights"], lambda f, w: F.coalesce(F.try_element_at(F.col("_v"), f), F.lit(0.0)) * w)
        new |= {f"pred_{t}": F.aggregate(terms, model["intercept"], lambda a, x: a + x), f"version_{t}": model["model_version"]}
    return d.withColumns(new).drop("_v", "_models")


def predicted(rows: DataFrame, registry: DataFrame, stats: list[str]) -> DataFrame:
    """``pred_*`` of statistics: models where there are any, else priors drawn to the means of their positions."""
    d = fallback(rows, stats).withColumnsRenamed({f"pred_{s}": f"_other_{s}" for s in stats})
    d = registered(d, registry, stats)
    return d.withColumns({f"pred_{s}": F.when(F.col(f"version_{s}").isNotNull(), F.col(f"pred_{s}")).otherwise(F.col(f"_other_{s}")) for s in stats}).drop(*[f"_other_{s}" for s in stats])


def project_registered(rows: DataFrame, registry: DataFrame, stats: list[str], composed: list[str] = ()) -> DataFrame:
    """A whole projection from the registry: predictions, missing totals composed, multipliers of age, move and depth."""
    return adjust(compose(predicted(rows, registry, stats)), [*stats, *composed])


def registry_report(rows: DataFrame, registry: DataFrame, targets: list[str]) -> DataFrame:
    """``position, target, model_version, source``: what each position's target is projected by: its model or "fallback"."""
    wanted = rows.where("position is not null").select("position").distinct().select("position", F.explode(F.array(*map(F.lit, targets))).alias("target"))
    d = wanted.join(latest(registry).select("position", "target", "model_version"), ["position", "target"], "left")
    return d.withColumn("source", F.when(F.col("model_version").isNull(), "fallback").otherwise("model"))
