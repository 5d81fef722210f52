"""Explanations of a scorer: permutation importance, accumulated effects, interactions, faithfulness, local attribution.

A scorer turns columns into a score column, so all variants of a row are expressions of one select: no row is copied,
scored or shuffled more than once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from .order import column_quantiles, quantiles

#: Rows among which a permutation moves values.
RANGE = 1 << 16

Scorer = Callable[[Mapping[str, Column]], Column]


def logistic(weights: Mapping[str, float], bias: float) -> Scorer:
    def score(x: Mapping[str, Column]) -> Column:
        z = F.lit(float(bias))
        for name, w in weights.items():
            z = z + x[name] * F.lit(float(w))
        return 1 / (1 + F.exp(-z))

    return score


def given(features: tuple[str, ...]) -> dict[str, Column]:
    return {f: F.col(f).cast("double") for f in features}


def medians(df: DataFrame, features: tuple[str, ...]) -> dict[str, float]:
    return {f: x and x[0] for f, x in column_quantiles(df, features, (0.5,)).items()}


def unpivot(row: DataFrame, columns: dict[str, dict[str, str]], key: str) -> DataFrame:
    """One-row table -> a row for each entry: key and its named columns."""
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias(key), *[F.col(c).alias(n) for n, c in v.items()]) for k, v in columns.items()])))


def permutation_importance(df: DataFrame, score: Scorer, features: tuple[str, ...], key: str, label: str = "label", seed: int = 7) -> DataFrame:
    """feature, importance: the increase of the Brier score when a feature's values are dealt anew.

    Values move within ranges of a digest of the key: each row takes the value of the next row of its range, in the order of
    digests, the last one that of the first. There are so many ranges that one holds about RANGE rows.
    """
    bits = max(6, math.ceil(math.log2(max(1, df.count()) / RANGE)))
    out = None
    base = given(features)
    for f in features:
        digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(f), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")
        placed = df.withColumns({"digest__": digest, "value__": F.struct(F.col(f).cast("double").alias("v"))}).withColumn("range__", F.shiftright("digest__", 60 - bits))
        w = Window.partitionBy("range__").orderBy("digest__", key)
        first = F.first("value__").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        moved = placed.withColumn("moved__", F.coalesce(F.lead("value__").over(w), first)["v"])
        p, q = score(base), score(base | {f: F.col("moved__")})
        part = moved.agg(F.lit(f).alias("feature"), (F.avg((q - F.col(label)) ** 2) - F.avg((p - F.col(label)) ** 2)).alias("importance"))
        out = part if out is None else out.unionByName(part)
    return out


def effects(df: DataFrame, score: Scorer, feature: str, features: tuple[str, ...], bins: int = 10) -> DataFrame:
    """bin, lower, upper, n_rows, effect: accumulated local effects over quantile bins, centred by their rows."""
    edges = quantiles(df, feature, tuple(i / bins for i in range(bins + 1)), (), "edges").select(F.array_sort(F.array_distinct("edges")).alias("edges"))
    x = df.crossJoin(F.broadcast(edges)).where("size(edges) > 2")
    inner = F.slice("edges", F.lit(2), F.size("edges") - 2)
    x = x.withColumn("bin", F.size(F.filter(inner, lambda e: e <= F.col(feature).cast("double"))))
    base = given(features)
    low, high = F.get("edges", F.col("bin")), F.get("edges", F.col("bin") + 1)
    x = x.select("bin", low.alias("lower"), high.alias("upper"), (score(base | {feature: high}) - score(base | {feature: low})).alias("d"))
    each = x.groupBy("bin", "lower", "upper").agg(F.avg("d").alias("d"), F.count(F.lit(1)).alias("n_rows"))
    each = each.withColumn("sum", F.sum("d").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    everything = Window.partitionBy()
    centre = F.sum(F.col("sum") * F.col("n_rows")).over(everything) / F.sum("n_rows").over(everything)
    return each.select("bin", "lower", "upper", "n_rows", (F.col("sum") - centre).alias("effect"))


def interactions(df: DataFrame, score: Scorer, pairs: tuple[tuple[str, str], ...], features: tuple[str, ...]) -> DataFrame:
    """left, right, mean_interaction, mean_absolute_interaction: second differences at the 0.9 quantiles."""
    names = sorted({f for p in pairs for f in p})
    at = column_quantiles(df, tuple(names), (0.9,))
    x, base = df, given(features)
    cells = []
    for i, (a, b) in enumerate(pairs):
        qa, qb = ({f: F.lit(at[f] and at[f][0]).cast("double")} for f in (a, b))
        s = score(base | qa | qb) - score(base | qa) - score(base | qb) + score(base)
        cells += [F.avg(s).alias(f"m{i}"), F.avg(F.abs(s)).alias(f"a{i}")]
    row = x.agg(*cells)
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"m{i}").alias("mean_interaction"), F.col(f"a{i}").alias("mean_absolute_interaction")) for i, (a, b) in enumerate(pairs)])))


def faithfulness(df: DataFrame, score: Scorer, importance: Mapping[str, float], features: tuple[str, ...], k: int, draws: int = 20, seed: int = 42) -> DataFrame:
    """One row: change of the score when the k most important features are deleted or inserted, against random ones."""
    import random

    middle = {f: F.lit(v) for f, v in medians(df, features).items()}
    base = given(features)
    top = sorted(features, key=lambda f: -importance.get(f, 0.0))[:k]
    rng = random.Random(seed)
    others = [rng.sample(list(features), len(top)) for _ in range(draws)]
    deleted = lambda fs: F.avg(F.abs(score(base) - score(base | {f: middle[f] for f in fs})))
    inserted = lambda fs: F.avg(F.abs(score(middle | {f: base[f] for f in fs}) - score(middle)))
    mean = lambda cs: sum(cs[1:], cs[0]) / len(cs)
    row = df.agg(deleted(top).alias("top_deletion"), inserted(top).alias("top_insertion"), mean([deleted(o) for o in others]).alias("random_deletion"), mean([inserted(o) for o in others]).alias("random_insertion"))
    return row.withColumn("passed", (F.col("top_deletion") > F.col("random_deletion")) & (F.col("top_insertion") > F.col("random_insertion")))


def attributions(df: DataFrame, score: Scorer, features: tuple[str, ...], key: str, reference: Mapping[str, float] | None = None) -> DataFrame:
    """key, feature, attribution: the score less the score with the feature at its median."""
    middle, base = reference or medians(df, features), given(features)
    each = F.array(*[F.struct(F.lit(f).alias("feature"), (score(base) - score(base | {f: F.lit(middle[f])})).alias("attribution")) for f in features])
    return df.select(key, F.explode(each).alias("x")).select(key, "x.feature", "x.attribution")


def development_groups(per_group: DataFrame, most: int, seed: str) -> list[str]:
    """Whole groups with at most `most` rows together: a share of each stratum in hash order, then what still fits.

    per_group(group_id, stratum, n_rows) is a table of groups, bounded by the development set that it is made for; whether
    a group fits depends on all before it, so the choice is made in order on the driver.
    """
    import hashlib

    rows = sorted(((r["stratum"], hashlib.sha256(f"{seed}:{r['group_id']}".encode()).hexdigest(), str(r["group_id"]), r["n_rows"]) for r in per_group.collect()))
    total = sum(r[3] for r in rows)
    chosen: dict[str, int] = {}
    used = 0
    for stratum in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == stratum]
        target, got = max(1, round(most * sum(r[3] for r in own) / max(1, total))), 0
        for _, _, name, n in own:
            if used + n <= most:
                chosen[name] = n
                used, got = used + n, got + n
                if got >= target:
                    break
    for _, _, name, n in sorted(rows, key=lambda r: r[1]):
        if name not in chosen and used + n <= most:
            chosen[name] = n
            used += n
    return sorted(chosen)
