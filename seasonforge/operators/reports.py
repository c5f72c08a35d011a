"""What a backtest leaves for its readers: tables of folds, models, ranks, calibration, and the selected models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import regression_metrics
from .moments import comparison
from .ranks import rank_metrics


def fold_summary(predictions: DataFrame) -> DataFrame:
    """``season, position, target, model, is_baseline, mae, rmse, r2, bias, n, spearman``: a row for each fold and model."""
    by = ["season", "position", "target", "model", "is_baseline"]
    errors = regression_metrics(predictions, by).drop("median_error")
    ranks = rank_metrics(predictions, by, tops=(), with_kendall=False).select(*by, "spearman")
    return errors.join(ranks, by, "left").select(*by, "mae", "rmse", "r2", "bias", "n", "spearman")


def model_comparison(summary: DataFrame) -> DataFrame:
    """Means over folds of each model of a position and target, and which model is selected: the least mean error, baselines too."""
    by = ["position", "target"]
    base = summary.groupBy(*by, "model").agg(F.max("is_baseline").alias("is_baseline"), F.avg("spearman").alias("spearman"))
    return comparison(summary, by).join(base, [*by, "model"])


def selected_models(compared: DataFrame) -> DataFrame:
    """``key, model``: the selected model by ``position:target``."""
    return compared.where("selected").select(F.concat_ws(":", "position", "target").alias("key"), "model")


def calibration_summary(rows: DataFrame, nominal: float) -> DataFrame:
    """``position, nominal_coverage, empirical_coverage, mean_interval_width, n`` of rows with ``low, high, actual``; rows without one of them are left out."""
    ok = rows.where("low is not null and high is not null and actual is not null")
    inside = F.col("actual").between(F.col("low"), F.col("high")).cast("double")
    return ok.groupBy("position").agg(F.lit(nominal).alias("nominal_coverage"), F.avg(inside).alias("empirical_coverage"), F.avg(F.col("high") - F.col("low")).alias("mean_interval_width"), F.count("*").alias("n"))


def backtest_tables(predictions: DataFrame, ranked_target: str | None = None) -> dict[str, DataFrame]:
    """All tables by name.  ``predictions``: ``season, position, target, model, is_baseline, player_id, predicted, actual``."""
    summary = fold_summary(predictions)
    compared = model_comparison(summary)
    tables = {
        "backtest-summary": summary, "model-comparison": compared, "selected-models": selected_models(compared),
        "backtest-predictions": predictions.withColumn("error", F.col("predicted") - F.col("actual")),
    }
    if ranked_target:
        tables["rank-performance"] = rank_metrics(predictions.where(F.col("target") == ranked_target), ["season", "position", "model"])
    return tables


def write_backtest(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes each table below ``folder``: predictions as Parquet, selections as JSON, the rest as CSV with a header.

    Spark writes them from its tasks; no table passes through the driver.  Earlier results of the name are replaced.
    """
    for name, d in tables.items():
        out = d.write.mode("overwrite")
        if name == "backtest-predictions":
            out.parquet(f"{folder}/{name}")
        elif name == "selected-models":
            out.json(f"{folder}/{name}")
        else:
            out.option("header", True).csv(f"{folder}/{name}")
