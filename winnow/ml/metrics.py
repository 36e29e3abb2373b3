"""Metrics of predictions, computed by aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import c
from ..operators.sample import plot_sample
from ..functions.stats import rows_to_df, stats_row


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """(label, prediction, n)."""
    return df.groupBy(c(label).alias("label"), c(pred).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """precision, recall, f1 and support per class."""
    m = confusion(df, label, pred)  # classes squared
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    t = m.groupBy(F.col("label").alias("cls")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    p = m.groupBy(F.col("prediction").alias("cls")).agg(F.sum("n").alias("said"))
    j = t.join(p, "cls", "full_outer").fillna(0, ["support", "tp", "said"])
    prec = F.coalesce(F.try_divide("tp", "said"), F.lit(0.0))
    rec = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(prec * rec * 2, prec + rec), F.lit(0.0))
    return j.select("cls", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), "support")


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "prediction") -> dict:
    """accuracy and support-weighted precision, recall, f1."""
    r = class_report(df, label, pred)
    w = F.sum("support")
    got = stats_row(r, {k: F.sum(F.col(k) * F.col("support")) / w for k in ("precision", "recall", "f1")})
    got["accuracy"] = got["recall"]  # the weighted recall is the share of hits
    return {k: got[k] for k in ("accuracy", "precision", "recall", "f1")}


def roc_auc(df: DataFrame, label: str, score: str) -> float | None:
    """Area under the ROC curve of a 0/1 label, ties counted half.

    Rows are counted per score first; the running count of negatives then goes block by block
    over the ordered scores, so no task orders the whole table."""
    from ..operators.ordered import blocked

    y = c(label).cast("double")
    g = df.groupBy(c(score).cast("double").alias("s")).agg(F.sum(y).alias("p"), F.sum(F.lit(1.0) - y).alias("q"))
    ends = stats_row(g, {"p": F.sum("p"), "q": F.sum("q")})
    if not ends["p"] or not ends["q"]:
        return None
    b = blocked(g, "s")
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offs = b.groupBy("_block").agg(F.sum("q").alias("bq"))  # one row per block
    offs = offs.select("_block", F.coalesce(F.sum("bq").over(before), F.lit(0.0)).alias("base"))
    inside = Window.partitionBy("_block").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    j = b.withColumn("less", F.coalesce(F.sum("q").over(inside), F.lit(0.0))).join(F.broadcast(offs), "_block")
    area = stats_row(j, {"a": F.sum(F.col("p") * (F.col("base") + F.col("less") + F.col("q") / 2))})["a"]
    return area / (ends["p"] * ends["q"])


def regression_metrics(df: DataFrame, features: int = 1, label: str = "label", pred: str = "prediction") -> dict:
    """r2, adjusted r2, mae, mse, rmse, mape."""
    y, p = c(label).cast("double"), c(pred).cast("double")
    e = y - p
    got = stats_row(df, {"n": F.count(e), "sse": F.sum(e * e), "sst": F.var_pop(y) * F.count(y), "mae": F.avg(F.abs(e)),
                         "mape": F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(2.220446049250313e-16)))})
    n, mse = got["n"], got["sse"] / got["n"]
    r2 = 1.0 - got["sse"] / got["sst"] if got["sst"] else 0.0
    adj = 1.0 - (1.0 - r2) * (n - 1) / max(n - features - 1, 1) if n > features + 1 else r2
    return {"r2": r2, "adjusted_r2": adj, "mae": got["mae"], "mse": mse, "rmse": mse ** 0.5, "mape": got["mape"]}


def fit_class(train: float, test: float, task: str) -> str:
    """critical, overfitting, possible_overfitting, underfitting or good_fit from two scores."""
    if task == "regression" and test < 0:
        return "critical"
    if train > 0.95 and test < 0.7:
        return "overfitting"
    if train - test > (0.2 if task == "regression" else 0.15):
        return "possible_overfitting"
    return "underfitting" if train < 0.5 and test < 0.5 else "good_fit"


def gap_level(train: float, test: float) -> str:
    gap = train - test
    return "danger" if gap > 0.2 else "warning" if gap > 0.1 else "good"


def fit_classes(df: DataFrame, train: str, test: str, task: str) -> DataFrame:
    """The same classes for a table of scores."""
    a, b = c(train), c(test)
    out = F.when((a > 0.95) & (b < 0.7), "overfitting").when(
        a - b > (0.2 if task == "regression" else 0.15), "possible_overfitting").when(
        (a < 0.5) & (b < 0.5), "underfitting").otherwise("good_fit")
    if task == "regression":
        out = F.when(b < 0, "critical").otherwise(out)
    return df.withColumn("fit", out)


def residuals(df: DataFrame, key: str, label: str = "label", pred: str = "prediction", k: int = 200) -> DataFrame:
    """(key, actual, predicted, residual) of k rows for a plot, drawn by the hash of their key."""
    return plot_sample(df, key, k).select(c(key), F.round(c(label), 4).alias("actual"), F.round(c(pred), 4).alias("predicted"),
                                          F.round(c(label) - c(pred), 4).alias("residual"))


def metrics_table(spark, m: dict) -> DataFrame:
    return rows_to_df(spark, [(k, None if v is None else float(v)) for k, v in m.items()], "metric string, value double")
