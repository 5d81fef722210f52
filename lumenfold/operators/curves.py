"""Metrics of scored data: confusion counts, rank metrics, calibration, threshold policies.

Global orders are never taken over rows: rows are counted by score first, and running totals come in two levels (score
ranges, then within a range), so no task holds all scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .order import before, same

#: Thresholds stay that much below 1.
EPSILON = 2.0**-52

def over(a: Column, b: Column) -> Column:
    """a / b in double precision, 0 where b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def confusion(df: DataFrame, threshold: float | Column, by: tuple[str, ...] = (), label: str = "label", score: str = "score") -> DataFrame:
    hit = F.col(score) >= threshold
    return df.groupBy(*by).agg(
        F.count_if((F.col(label) == 1) & hit).alias("tp"),
        F.count_if((F.col(label) == 0) & hit).alias("fp"),
        F.count_if((F.col(label) == 0) & ~hit).alias("tn"),
        F.count_if((F.col(label) == 1) & ~hit).alias("fn"),
    )


def fbeta(beta: float) -> Column:
    b = beta * beta
    return over(F.col("tp") * (1 + b), F.col("tp") * (1 + b) + F.col("fn") * b + F.col("fp"))


def rates(counts: DataFrame) -> DataFrame:
    """Counts tp, fp, tn, fn with the metrics that they give."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    recall, specificity = over(tp, tp + fn), over(tn, tn + fp)
    root = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.select(
        "*",
        over(tp, tp + fp).alias("precision"),
        recall.alias("recall"),
        specificity.alias("specificity"),
        over(fp, fp + tn).alias("fpr"),
        over(fn, tp + fn).alias("fnr"),
        over(tn, tn + fn).alias("npv"),
        over(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        ((recall + specificity) / 2).alias("balanced_accuracy"),
        fbeta(1.0).alias("f1"),
        fbeta(2.0).alias("f2"),
        fbeta(0.5).alias("f05"),
        over(tp.cast("double") * tn - fp.cast("double") * fn, root).alias("mcc"),
        over(tp + fn, tp + fp + tn + fn).alias("prevalence"),
        over(tp + fp, tp + fp + tn + fn).alias("alert_rate"),
        (over(fp, fp + tn) * 1e6).alias("fp_per_million"),
    )


def by_score(df: DataFrame, by: tuple[str, ...] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Positives and negatives of each distinct score (0 to 1), with those at higher scores: above_pos, above_neg."""
    counts = df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.col(label)).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg"))
    return _with_above(counts, by)


def _with_above(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    # ranges at quantiles of the distinct scores: the scores of rare positives crowd at one end
    x = counts.withColumn("falling", -F.col("score"))
    x = before(x, "falling", {"pos": F.sum("pos"), "neg": F.sum("neg")}, by)
    return x.select(*by, (-F.col("falling")).alias("score"), "pos", "neg", F.col("pos_before").alias("above_pos"), F.col("neg_before").alias("above_neg"))


def by_score_weighted(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """rank_metrics of rows (score, label, w) that stand for w rows each."""
    counts = df.groupBy(*by, "score").agg(F.sum(F.when(F.col("label") == 1, F.col("w")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") == 0, F.col("w")).otherwise(0)).alias("neg"))
    return _rank_metrics(_with_above(counts, by), by)


def rank_metrics(df: DataFrame, by: tuple[str, ...] = (), label: str = "label", score: str = "score") -> DataFrame:
    """roc_auc and average_precision; equal scores count half, precision steps over distinct scores. Null without both classes."""
    return _rank_metrics(by_score(df, by, label, score), by)


def _rank_metrics(s: DataFrame, by: tuple[str, ...]) -> DataFrame:
    pos, neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    won = F.sum(F.col("neg").cast("double") * (F.col("above_pos") + F.col("pos") / F.lit(2.0)))
    tp = F.col("above_pos") + F.col("pos")
    step = F.sum(F.col("pos").cast("double") * tp / (tp + F.col("above_neg") + F.col("neg")))
    return s.groupBy(*by).agg(pos.alias("n_pos"), neg.alias("n_neg"), F.when((pos > 0) & (neg > 0), won / (pos * neg)).alias("roc_auc"), F.when(pos > 0, step / pos).alias("average_precision"))


def partial_auc(df: DataFrame, limits: tuple[float, ...] = (1e-3, 1e-4), label: str = "label", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """by, max_fpr, partial_auc (null without both classes): area up to a false positive rate, the last step interpolated, standardised so that chance is 1/2."""
    s = by_score(df, by, label, score)
    total = s.groupBy(*by).agg(F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("n"))
    s = same(s, total, by) if by else s.crossJoin(F.broadcast(total))
    s = s.withColumn("limit", F.explode(F.array(*[F.lit(x) for x in limits])))
    p, n = F.nullif(F.col("p"), F.lit(0.0)), F.nullif(F.col("n"), F.lit(0.0))
    x0, x1 = F.col("above_neg") / n, (F.col("above_neg") + F.col("neg")) / n
    y0, y1 = F.col("above_pos") / p, (F.col("above_pos") + F.col("pos")) / p
    end = F.least(x1, F.col("limit"))
    y_end = F.when(x1 > x0, y0 + (y1 - y0) * (end - x0) / (x1 - x0)).otherwise(y1)
    area = F.when(n.isNotNull() & p.isNotNull(), F.when(x0 < F.col("limit"), (end - x0) * (y0 + y_end) / 2).otherwise(F.lit(0.0)))
    low = F.col("limit") * F.col("limit") / 2
    out = s.groupBy(*by, "limit").agg(F.sum(area).alias("area"))
    return out.select(*by, F.col("limit").alias("max_fpr"), ((1 + (F.col("area") - low) / (F.col("limit") - low)) / 2).alias("partial_auc"))


def bin_of(score: Column, bins: int) -> Column:
    """Equal-width bins of [0, 1], closed on the left, the last on both sides."""
    return F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int")


def reliability(df: DataFrame, bins: int = 15, label: str = "label", score: str = "score") -> DataFrame:
    """bin, low, high, n_rows, mean_score, observed: empty bins too."""
    each = df.groupBy(bin_of(F.col(score), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("observed"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(each), "bin", "left").select("bin", (F.col("bin") / F.lit(float(bins))).alias("low"), ((F.col("bin") + 1) / F.lit(float(bins))).alias("high"), F.coalesce("n", F.lit(0)).alias("n_rows"), "mean_score", "observed")


def calibration(df: DataFrame, bins: int = 15, label: str = "label", score: str = "score") -> DataFrame:
    """One row: ece, brier, n_rows."""
    each = df.groupBy(bin_of(F.col(score), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("p"), F.avg(F.col(label).cast("double")).alias("y"), F.sum((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("q"))
    return each.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"), (F.sum("q") / F.sum("n")).alias("brier"), F.sum("n").alias("n_rows"))


def candidates(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """threshold, tp, fp, tn, fn at every distinct score above 0, and where no score is 1 a threshold that alerts nothing.

    Thresholds lie strictly between 0 and 1.
    """
    s = by_score(df, (), label, score)
    total = s.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.max("score").alias("top"))
    at = s.where("score > 0").crossJoin(F.broadcast(total)).select(
        F.least(F.col("score"), F.lit(1.0 - EPSILON)).alias("threshold"),
        (F.col("above_pos") + F.col("pos")).alias("tp"),
        (F.col("above_neg") + F.col("neg")).alias("fp"),
        (F.col("n") - F.col("above_neg") - F.col("neg")).alias("tn"),
        (F.col("p") - F.col("above_pos") - F.col("pos")).alias("fn"),
    )
    zero = F.lit(0).cast("long")
    none = total.where("top < 1").select((F.col("top") + F.pow(F.lit(2.0), F.floor(F.log2(F.greatest("top", F.lit(1e-300)))) - 52)).alias("threshold"), zero.alias("tp"), zero.alias("fp"), F.col("n").alias("tn"), F.col("p").alias("fn"))
    return at.unionByName(none)


#: Threshold policies: objective (or a fixed threshold) and the largest false positive rate.
POLICIES = {"fixed_0_5": (0.5, None), "max_f1": ("f1", None), "max_f2": ("f2", None), "fpr_lte_0_001": ("f2", 1e-3), "fpr_lte_0_0001": ("f2", 1e-4)}
#: Of a development fold, which gives no threshold to be deployed.
DEVELOPMENT = {"development_f2_at_fpr": ("f2", 1e-3)}


def best_thresholds(points: DataFrame, policies: dict[str, tuple[str | float, float | None]] = POLICIES) -> DataFrame:
    """policy, threshold, tp, fp, tn, fn: the highest objective within the limit; ties to the lower FPR, higher recall, higher threshold.

    A fixed threshold has the counts of the lowest candidate that is not below it; without one, it alerts nothing.
    """
    r = rates(points)
    each, counts = [], ("tp", "fp", "tn", "fn")
    for name, (objective, limit) in policies.items():
        if isinstance(objective, float):
            each.append(F.min(F.when(F.col("threshold") >= objective, F.struct(F.col("threshold").alias("at"), F.lit(objective).alias("threshold"), *counts))).alias(name))
            continue
        key = F.struct(F.round(objective, 12).alias("objective"), (-F.col("fpr")).alias("nfpr"), F.col("recall"), F.col("threshold"), *counts)
        ok = F.lit(True) if limit is None else F.col("fpr") <= limit + 1e-15
        each.append(F.max(F.when(ok, key)).alias(name))
    row = r.agg(*each, F.max(F.struct((F.col("tp") + F.col("fn")).alias("p"), (F.col("fp") + F.col("tn")).alias("n"))).alias("all"))
    out = []
    for name, (objective, _) in policies.items():
        found = [F.col(f"`{name}`")[c].alias(c) for c in ("threshold", *counts)]
        if isinstance(objective, float):
            zero = F.lit(0).cast("long")
            none = {"threshold": F.lit(objective), "tp": zero, "fp": zero, "tn": F.col("all.n"), "fn": F.col("all.p")}
            found = [F.coalesce(x, none[c]).alias(c) for x, c in zip(found, none, strict=True)]
        out.append(F.struct(F.lit(name).alias("policy"), *found))
    return row.select(F.inline(F.array(*out))).where("threshold is not null")


def report(df: DataFrame, threshold: float, by: tuple[str, ...] = (), bins: int = 15, label: str = "label", score: str = "score") -> DataFrame:
    """The whole report at one threshold, a row a group: counts and rates, n_rows, calibration, rank metrics, partial areas.

    Rank metrics are null where a group has one class only.
    """
    x = df.select(*by, F.col(label).alias("label"), F.col(score).alias("score"))
    base = rates(confusion(x, threshold, by)).withColumn("n_rows", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    cells = x.groupBy(*by, bin_of(F.col("score"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("p"), F.avg(F.col("label").cast("double")).alias("y"), F.sum((F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))).alias("q"))
    fit = cells.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"), (F.sum("q") / F.sum("n")).alias("brier"))
    ranks = rank_metrics(x, by).withColumn("average_precision", F.when(F.col("n_neg") > 0, F.col("average_precision"))).drop("n_pos", "n_neg")
    areas = partial_auc(x, (1e-3, 1e-4), by=by).groupBy(*by).agg(*[F.max(F.when(F.col("max_fpr") == v, F.col("partial_auc"))).alias(n) for n, v in (("partial_auc_0_001", 1e-3), ("partial_auc_0_0001", 1e-4))])
    out = base
    for part in (fit, ranks, areas):
        out = same(out, part, by) if by else out.crossJoin(F.broadcast(part))
    return out.withColumn("threshold", F.lit(float(threshold)))
