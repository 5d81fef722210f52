"""Train-only preprocessing: median imputation, missing flags, clipping, standardisation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.order import long, quantiles
from ..specs import ContractError

LOW, HIGH = 0.0001, 0.9999


@dataclass(frozen=True)
class Fitted:
    """Per feature: median, constant (at most one distinct value, null among them), low, high, mean, std."""

    features: tuple[str, ...]
    values: dict[str, dict[str, float | bool | None]]
    clip: bool

    @property
    def active(self) -> tuple[str, ...]:
        return tuple(f for f in self.features if not self.values[f]["constant"])


def finite(name: str):
    x = F.col(name).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def statistics(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """feature, median, n_distinct, low, high: a row a feature, from the distinct values of each and their counts."""
    x = long(df.select(*[finite(f).alias(f) for f in features]), features)
    distinct = x.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("feature").agg(F.count(F.lit(1)).cast("double").alias("n_distinct"))
    q = quantiles(x, "value", (0.5, LOW, HIGH), ("feature",), "q")
    return distinct.join(q, "feature", "left").select("feature", F.col("q")[0].alias("median"), "n_distinct", F.col("q")[1].alias("low"), F.col("q")[2].alias("high"))


def fit(df: DataFrame, features: tuple[str, ...], partition: str = "train", clip: bool = False) -> Fitted:
    """Fits on the train partition only; two aggregations, whose results have one row a feature."""
    if partition != "train":
        raise ContractError(f"preprocessing is fitted on train, not on {partition}")
    first = {r["feature"]: r for r in statistics(df, features).collect()}
    filled = []
    for f in features:
        x = F.coalesce(finite(f), F.lit(first[f]["median"] or 0.0))
        if clip:
            x = F.least(F.greatest(x, F.lit(first[f]["low"])), F.lit(first[f]["high"]))
        filled += [F.avg(x).alias(f"{f}__mean"), F.stddev_pop(x).alias(f"{f}__std")]
    second = df.agg(*filled).first()
    values = {}
    for f in features:
        r = first[f]
        values[f] = {"median": r["median"] if r["median"] is not None else 0.0, "constant": r["n_distinct"] <= 1, "low": r["low"], "high": r["high"], "mean": second[f"{f}__mean"], "std": second[f"{f}__std"] or 1.0}
    return Fitted(tuple(features), values, clip)


def transform(df: DataFrame, fitted: Fitted, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns, active features, `__missing` flags of all, `__clipped` flags of active ones when clipping: one select."""
    out, missing, clipped = [], [], []
    for f in fitted.features:
        v, x = fitted.values[f], finite(f)
        missing.append(x.isNull().cast("float").alias(f"{f}__missing"))
        if v["constant"]:
            continue
        y = F.coalesce(x, F.lit(v["median"]))
        if fitted.clip:
            z = F.least(F.greatest(y, F.lit(v["low"])), F.lit(v["high"]))
            clipped.append((z != y).cast("float").alias(f"{f}__clipped"))
            y = z
        out.append(((y - F.lit(v["mean"])) / F.lit(v["std"])).cast("float").alias(f))
    return df.select(*keep, *out, *missing, *clipped)
