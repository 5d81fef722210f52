"""Selections, decisions, robustness, agreement of methods."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from .order import quantiles, same

SIGMA, MARGIN, OOD_Z, OOD_SHARE = 2.0, 0.02, 8.0, 0.10


def hash_order(*parts: Column | str) -> Column:
    return F.sha2(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]), 256)


def outcome(threshold: float, label: str = "label", score: str = "score") -> Column:
    hit = F.col(score) >= threshold
    return F.when(F.col(label) == 1, F.when(hit, "TP").otherwise("FN")).otherwise(F.when(hit, "FP").otherwise("TN"))


def stratified(df: DataFrame, key: str, strata: tuple[str, ...], size: int, seed: str) -> DataFrame:
    """size rows: of each stratum its proportional share (half-even rounding, one at least) in hash order, then filled up or cut in hash order.

    Strata are small tables of their own: they are broadcast where Spark finds them small.
    """
    order = hash_order(f"{seed}:", F.col(key).cast("string"))
    n = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("in_stratum"))
    total = df.agg(F.count(F.lit(1)).alias("all_rows"))
    quota = n.crossJoin(F.broadcast(total)).withColumn("quota", F.greatest(F.lit(1), F.bround(F.col("in_stratum") * F.lit(float(size)) / F.col("all_rows")).cast("int")))
    ranked = same(df, quota, strata).withColumn("digest", order)
    # of no stratum more than size rows can be chosen: tasks drop the others before they meet
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*strata).orderBy("digest", key))).where(F.col("rank") <= size)
    first = F.when(F.col("rank") <= F.col("quota"), 0).otherwise(1)
    return ranked.orderBy(first, "digest", key).limit(size).drop("in_stratum", "all_rows", "quota", "rank", "digest")


def handoff(df: DataFrame, key: str, threshold: float, quota: int, size: int, seed: str) -> DataFrame:
    """size rows: quota of each outcome in hash order, then the nearest to the threshold."""
    x = df.select(key, "label", "score", outcome(threshold).alias("outcome"), hash_order(f"{seed}:", F.col(key).cast("string")).alias("digest"))
    first = x.withColumn("rank", F.row_number().over(Window.partitionBy("outcome").orderBy("digest", key))).where(F.col("rank") <= quota).drop("rank")
    gap = F.round(F.abs(F.col("score") - threshold), 12)
    # four outcomes: the nearest ones beyond those that may be chosen already
    near = x.orderBy(gap, "digest", key).limit(size + 4 * quota)
    both = first.withColumn("rest", F.lit(0)).unionByName(near.withColumn("rest", F.lit(1)))
    once = both.groupBy(key, "label", "score", "outcome", "digest").agg(F.min("rest").alias("rest"))
    return once.orderBy("rest", F.when(F.col("rest") == 1, gap), "digest", key).limit(size).select(key, "label", "score", "outcome")


def hard_errors(df: DataFrame, key: str, threshold: float, k: int, seed: str) -> DataFrame:
    """error_type, rank, sample_hash, score: the k most confident errors of each kind, ids hashed."""
    wrong = df.withColumn("error_type", outcome(threshold)).where("error_type in ('FP', 'FN')")
    worst = F.when(F.col("error_type") == "FP", -F.col("score")).otherwise(F.col("score"))
    rank = F.row_number().over(Window.partitionBy("error_type").orderBy(worst, key))
    return wrong.withColumn("rank", rank).where(F.col("rank") <= k).select("error_type", "rank", hash_order(f"{seed}:", F.col(key).cast("string")).alias("sample_hash"), "score")


def local_cases(df: DataFrame, key: str, threshold: float, k: int, abstained: str | None = None) -> DataFrame:
    """The keys of cases to explain, each once: the first k of each category, ties by key.

    Categories: the four outcomes, scores among the tenth farthest from and nearest to the threshold, and abstained rows;
    false positives and far ones from the highest score down, all others from the lowest up. Each is a top-k.
    """
    gap = F.round(F.abs(F.col("score") - threshold), 12)
    x = df.withColumn("outcome", outcome(threshold)).withColumn("gap", gap)
    edge = quantiles(x, "gap", (0.1, 0.9), (), "edge").select(F.round(F.col("edge")[0], 12).alias("near"), F.round(F.col("edge")[1], 12).alias("far"))
    x = x.crossJoin(F.broadcast(edge))
    up, down = F.asc("score"), F.desc("score")
    categories = [(F.col("outcome") == "TP", up), (F.col("outcome") == "TN", up), (F.col("outcome") == "FP", down), (F.col("outcome") == "FN", up), (F.col("gap") >= F.col("far"), down), (F.col("gap") <= F.col("near"), up)]
    if abstained:
        categories.append((F.col(abstained), up))
    parts = [x.where(mask).orderBy(order, key).limit(k).select(key) for mask, order in categories]
    return functools.reduce(DataFrame.unionByName, parts).distinct()


def worst_case(df: DataFrame, case: str, label: str, score: str, name: str) -> DataFrame:
    """case -> the variant with the lowest score of a positive, the highest of a negative."""
    bad = F.when(F.col(label) == 1, F.col(score)).otherwise(-F.col(score))
    return df.groupBy(case, label).agg(F.min(F.struct(bad.alias("bad"), F.col(name).alias(name), F.col(score).alias(score))).alias("x")).select(case, label, f"x.{name}", f"x.{score}")


def nearest_prototype(rows: DataFrame, prototypes: DataFrame, key: str, prototype: str, vector: str) -> DataFrame:
    """key, prototype, distance: squared distance to the nearest of a small table of prototypes, ties to the smaller id."""
    p = prototypes.select(F.col(prototype).alias("prototype"), F.col(vector).alias("centre"))
    near = F.aggregate(F.zip_with(vector, "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    # prototypes: one row a class
    both = rows.crossJoin(F.broadcast(p)).select(key, "prototype", near.alias("distance"))
    return both.groupBy(key).agg(F.min(F.struct("distance", "prototype")).alias("x")).select(key, F.col("x.prototype").alias("prototype"), F.col("x.distance").alias("distance"))


def indicators(columns: dict[str, str], health: tuple[str, ...] = ()) -> Column:
    """Array of (indicator, feature, observed_value, evidence_type) of what is above 0."""
    each = [F.struct(F.lit(k).alias("indicator"), F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("observed_value"), F.lit("raw_static_observation").alias("evidence_type")) for k, c in columns.items()]
    each += [F.struct(F.lit(c).alias("indicator"), F.lit(c).alias("feature"), F.when(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) > 0, 1.0).otherwise(0.0).alias("observed_value"), F.lit("parser_health_observation").alias("evidence_type")) for c in health]
    return F.filter(F.array(*each), lambda x: x["observed_value"] > 0)


def deviations(df: DataFrame, base: DataFrame, key: str, features: tuple[str, ...], risky: tuple[str, ...] = ()) -> DataFrame:
    """key, feature, value, z: values over SIGMA deviations from the baseline, or non-zero ones of risky features."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x")
    long = df.select(key, each).select(key, "x.feature", "x.value").join(F.broadcast(base), "feature")
    z = F.when(F.col("std") > 0, (F.col("value") - F.col("mean")) / F.col("std")).otherwise(0.0)
    return long.withColumn("z", z).where((F.abs("z") > SIGMA) | (F.col("feature").isin(*risky) & (F.col("value") != 0))).select(key, "feature", "value", "z")


def severity(n_risky: Column, n_all: Column) -> Column:
    return F.when((n_risky >= 3) | (n_all >= 8), "Critical").when((n_risky >= 2) | (n_all >= 5), "High").when((n_risky >= 1) | (n_all >= 3), "Medium").otherwise("Low")


def ood_share(features: tuple[str, ...], reference: dict[str, tuple[float, float]]) -> Column:
    """Share of features whose robust z is above OOD_Z."""
    far = [(F.abs(F.col(f).cast("double") - reference[f][0]) / max(reference[f][1] * 1.4826, 1e-6) > OOD_Z).cast("double") for f in features]
    return sum(far[1:], far[0]) / float(len(far))


def decide(score: Column, threshold: float, ood: Column, unhealthy: Column) -> Column:
    """struct(outcome, reasons): abstain on unhealthy input, odd profiles or scores near the threshold."""
    reasons = F.when(unhealthy, F.array(F.lit("parser_health_gate"))).otherwise(
        F.array_compact(F.array(F.when(ood > OOD_SHARE, "out_of_distribution_feature_profile"), F.when(F.round(F.abs(score - threshold), 12) <= MARGIN, "probability_within_abstention_margin")))
    )
    return F.struct(F.when(F.size(reasons) > 0, "uncertain/abstain").when(score >= threshold, "malicious").otherwise("benign").alias("outcome"), F.array_join(reasons, ";").alias("reasons"))


def robustness(scored: DataFrame, threshold: float, case: tuple[str, ...] = ("fixture", "label"), clean: str = "none") -> DataFrame:
    """A row for each mutation but the clean one, of scored(*case, mutation, score, abstained, latency_ms, rss_bytes).

    n_fixtures; attack_success_rate, mean_drop, max_drop: of positives, against the clean row of the case (an abstained one
    is no success); clean_fpr, mutated_fpr, fpr_increase: of negatives; abstention_rate; mean_latency_ms, p95_latency_ms;
    max_rss_bytes. Rates and drops without such rows are 0.
    """
    base = scored.where(F.col("mutation") == clean).select(*case, F.col("score").alias("clean"))
    x = scored.where(F.col("mutation") != clean).join(base, list(case), "left")
    positive = F.col("label") == 1
    was, now = F.coalesce(F.col("clean") >= threshold, F.lit(False)), F.col("score") >= threshold
    won = F.coalesce((F.col("clean") >= threshold) & (F.col("score") < threshold) & ~F.col("abstained"), F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = x.groupBy("mutation").agg(
        F.count(F.lit(1)).alias("n_fixtures"),
        zero(F.avg(F.when(positive, won.cast("double")))).alias("attack_success_rate"),
        zero(F.avg(F.when(positive, F.col("clean") - F.col("score")))).alias("mean_drop"),
        zero(F.max(F.when(positive, F.col("clean") - F.col("score")))).alias("max_drop"),
        zero(F.avg(F.when(~positive, was.cast("double")))).alias("clean_fpr"),
        zero(F.avg(F.when(~positive, now.cast("double")))).alias("mutated_fpr"),
        F.avg(F.col("abstained").cast("double")).alias("abstention_rate"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        F.max("rss_bytes").alias("max_rss_bytes"),
    )
    late = quantiles(x, "latency_ms", (0.95,), ("mutation",)).select("mutation", F.col("quantiles")[0].alias("p95_latency_ms"))
    return out.withColumn("fpr_increase", F.col("mutated_fpr") - F.col("clean_fpr")).join(late, "mutation", "left")


def champion(board: DataFrame, paired_lower: float | None = None, limit: float = 1e-3) -> DataFrame:
    """One row: bundle_key of the model that is selected on validation, the point winner's key and family, and the rationale.

    board: a row a finalist (bundle_key, model_family, validation_f2, validation_fpr, validation_brier, validation_precision,
    latency_ms). Eligible: no dummy, FPR within the limit. The point winner has the highest F2, then the lower FPR, lower
    Brier score, higher precision, smaller key. A neural winner stays only where it beats the best tree: the lower bound of
    the paired difference in F2 is above 0, its Brier score at most 0.005 above, its latency at most the larger of 5 times
    and 5 ms more. No eligible row, or a neural winner without a tree, is no row.
    """
    ok = board.where((F.col("model_family") != "dummy") & (F.col("validation_fpr") <= limit + 1e-15))
    names = ("bundle_key", "model_family", "validation_brier", "latency_ms")
    point = F.min(F.struct((-F.col("validation_f2")).alias("a"), F.col("validation_fpr").alias("b"), F.col("validation_brier").alias("c"), (-F.col("validation_precision")).alias("d"), *names))
    tree = F.min(F.when(F.col("model_family") == "tree", F.struct((-F.col("validation_f2")).alias("a"), *names)))
    x = ok.agg(point.alias("p"), tree.alias("t")).where(F.col("p").isNotNull() & ((F.col("p.model_family") != "neural") | F.col("t").isNotNull()))
    slow = F.col("p.latency_ms") > F.greatest(5.0 * F.col("t.latency_ms"), F.col("t.latency_ms") + 5.0)
    beaten = (F.lit(paired_lower is None or paired_lower <= 0.0)) | (F.col("p.validation_brier") > F.col("t.validation_brier") + 0.005) | F.coalesce(slow, F.lit(False))
    back = (F.col("p.model_family") == "neural") & beaten
    why = F.when(back, "best tree: the neural winner misses a condition").when(F.col("p.model_family") == "neural", "neural winner supported by the paired interval").otherwise("highest F2 within the FPR limit")
    return x.select(F.when(back, F.col("t.bundle_key")).otherwise(F.col("p.bundle_key")).alias("bundle_key"), F.col("p.bundle_key").alias("point_best"), F.col("p.model_family").alias("point_family"), why.alias("rationale"))


def agreement(long: DataFrame, feature: str = "feature", method: str = "method", value: str = "importance", methods: tuple[str, ...] = ()) -> DataFrame:
    """left, right, correlation: Spearman of mean importances, absent ones 0."""
    from .monitor import spearman

    wide = long.groupBy(feature).pivot(method, list(methods) or None).agg(F.avg(value)).na.fill(0.0)
    return spearman(wide, tuple(c for c in wide.columns if c != feature))


def supported(long: DataFrame, top: int, feature: str = "feature", method: str = "method", value: str = "importance") -> DataFrame:
    """feature, n_methods (that rank it within top), mean_rank."""
    ranked = long.withColumn("r", F.rank().over(Window.partitionBy(method).orderBy(F.desc(value))))
    return ranked.groupBy(feature).agg(F.count_if(F.col("r") <= top).alias("n_methods"), F.avg(F.col("r").cast("double")).alias("mean_rank"))


def family(name: Column, families: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """The first family that has a token in the name."""
    out = F.lit("other")
    for label, tokens in reversed(families):
        out = F.when(F.lower(name).rlike("|".join(tokens)), label).otherwise(out)
    return out


def breakdown(df: DataFrame, key: str, features: tuple[str, ...], top: int | None = None) -> DataFrame:
    """key, feature, value: wide to long; with top, each row's largest non-zero values."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x")
    long = df.select(key, each).select(key, "x.feature", "x.value")
    if top is None:
        return long
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.abs("value")), "feature"))
    return long.where("value <> 0").withColumn("rank", rank).where(F.col("rank") <= top)


def rank_stability(runs: DataFrame, run: str = "run", feature: str = "feature", value: str = "importance") -> DataFrame:
    """left, right, correlation: Spearman of the importances of each pair of runs, 0 where it isn't defined."""
    w = Window.partitionBy(run)
    n = F.count(F.lit(1)).over(Window.partitionBy(run, value))
    r = runs.select(run, feature, (F.rank().over(w.orderBy(value)) + (n - 1) / F.lit(2.0)).alias("r"))
    a = r.select(F.col(run).alias("left"), feature, F.col("r").alias("x"))
    b = r.select(F.col(run).alias("right"), feature, F.col("r").alias("y"))
    both = a.join(b, feature).where("left < right")
    c = F.corr("x", "y")
    return both.groupBy("left", "right").agg(F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c).alias("correlation"))


def natural_reference(df: DataFrame, key: str, label: str, size: int, seed: str) -> DataFrame:
    """size rows at the classes' own shares (half-even, one at least), each class in hash order."""
    return stratified(df, key, (label,), size, seed)


def compare(results: DataFrame, metrics: tuple[str, ...], by: str) -> DataFrame:
    """Models with rounded metrics, the best by one of them first."""
    return results.select("model", *[F.round(m, 4).alias(m) for m in metrics]).orderBy(F.desc(by), "model")


def whitelist(df: DataFrame, allowed: tuple[str, ...], name: str = "evidence") -> DataFrame:
    """One JSON text of allowed columns a row; another column is an error."""
    if extra := sorted(set(df.columns) - set(allowed)):
        raise ValueError(f"not allowed as evidence: {extra}")
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias(name))


def evenly_spaced(df: DataFrame, order: str, cap: int) -> DataFrame:
    """At most cap rows at even distances in the order of a unique column."""
    from .order import before

    n = df.agg(F.count(F.lit(1)).alias("n__"))
    placed = before(df, order, {"c__": F.count(F.lit(1))}).crossJoin(F.broadcast(n))
    step = F.greatest(F.lit(1.0), F.col("n__") / F.lit(float(cap)))
    keep = placed.where(F.floor(F.col("c___before") / step) != F.floor((F.col("c___before") - 1) / step)).select(order)
    return df.join(keep, order, "left_semi")


def parity(batch: DataFrame, single: DataFrame) -> DataFrame:
    """only_batch, only_single: rows that one way of computing gives and the other doesn't."""
    return batch.exceptAll(single).agg(F.count(F.lit(1)).alias("only_batch")).crossJoin(single.exceptAll(batch).agg(F.count(F.lit(1)).alias("only_single")))
