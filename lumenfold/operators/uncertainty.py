"""Cluster bootstrap: whole groups are drawn again.

Spark reduces the rows to sufficient statistics of groups. Draws are Poisson weights from a hash of (seed, replicate,
group), so they are the same on every machine and nothing is collected: replicates are summed in one aggregation and only
the table of replicates, a row each, is left. Strata (groups with any positive, and others) are drawn alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .curves import confusion, rank_metrics, rates

METRICS = ("precision", "recall", "f05", "f1", "f2", "fpr", "specificity", "balanced_accuracy", "mcc", "fp_per_million")
#: Cumulative Poisson(1) probabilities of 0 to 6 draws.
_POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def weight(seed: int, replicate: Column, group: Column) -> Column:
    """How often a group is drawn: Poisson with mean 1."""
    u = F.pmod(F.xxhash64(F.lit(seed), replicate, group), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return sum(((u > F.lit(p)).cast("long") for p in _POISSON), F.lit(0))


def strata(df: DataFrame, group: str, label: str = "label") -> DataFrame:
    return df.groupBy(group).agg(F.max(label).alias("stratum"), F.count(F.lit(1)).alias("n_rows"))


def confusion_replicates(df: DataFrame, group: str, threshold: float, replicates: int, seed: int = 42) -> DataFrame:
    """replicate, tp, fp, tn, fn and rates; groups carry four counts each."""
    per_group = confusion(df, threshold, (group,))
    each = per_group.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    w = weight(seed, F.col("replicate"), F.col(group).cast("string"))
    drawn = each.withColumn("w", w).where("w > 0").groupBy("replicate").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("tp", "fp", "tn", "fn")])
    return rates(drawn)


def interval(replicates: DataFrame, point: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """metric, point, lower_95, upper_95."""
    spread = replicates.agg(*[F.percentile(m, F.array(F.lit(0.025), F.lit(0.975))).alias(f"q_{m}") for m in metrics])
    both = spread.crossJoin(point.select(*[F.col(m).alias(f"p_{m}") for m in metrics]))
    return both.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"p_{m}").alias("point"), F.col(f"q_{m}")[0].alias("lower_95"), F.col(f"q_{m}")[1].alias("upper_95")) for m in metrics])))


def confusion_interval(df: DataFrame, group: str, threshold: float, replicates: int = 1000, seed: int = 42) -> DataFrame:
    return interval(confusion_replicates(df, group, threshold, replicates, seed), rates(confusion(df, threshold)), METRICS)


def ranking_interval(df: DataFrame, group: str, replicates: int = 200, seed: int = 42) -> DataFrame:
    """Of ROC AUC and average precision: scores are counted by group first, then weighted."""
    counts = df.groupBy(group, "score", "label").agg(F.count(F.lit(1)).alias("n"))
    each = counts.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    each = each.withColumn("w", F.col("n") * weight(seed, F.col("replicate"), F.col(group).cast("string"))).where("w > 0")
    drawn = each.groupBy("replicate", "score", "label").agg(F.sum("w").alias("w"))
    # weights stand for repeated rows: counts by score take them as such
    from .curves import by_score_weighted

    metrics = by_score_weighted(drawn, ("replicate",))
    return interval(metrics, rank_metrics(df), ("roc_auc", "average_precision"))


def paired_difference(left: DataFrame, right: DataFrame, group: str, threshold: float, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """metric, point, lower_95, upper_95 of left less right, with the same draws for both."""
    a, b = (confusion_replicates(x, group, threshold, replicates, seed).select("replicate", *[F.col(m).alias(f"{s}_{m}") for m in METRICS]) for x, s in ((left, "a"), (right, "b")))
    drawn = a.join(b, "replicate").select(*[(F.col(f"a_{m}") - F.col(f"b_{m}")).alias(m) for m in METRICS])
    pa, pb = (rates(confusion(x, threshold)).select(*[F.col(m).alias(f"{s}_{m}") for m in METRICS]) for x, s in ((left, "a"), (right, "b")))
    point = pa.crossJoin(pb).select(*[(F.col(f"a_{m}") - F.col(f"b_{m}")).alias(m) for m in METRICS])
    return interval(drawn, point, METRICS)
