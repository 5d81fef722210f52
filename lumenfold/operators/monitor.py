"""Subgroups, drift, correlation, distributions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from .curves import confusion, rates
from .order import before, long as unpivoted, quantiles, same

MIN_ROWS = 100


def quantile_label(rank: Column, n: Column, q: int) -> Column:
    """Label 1 to q of a unique rank among n, as quantile cuts of the ranks give it (not ntile)."""
    return F.when(n > 1, F.greatest(F.lit(1), F.ceil((rank - 1) * q / (n - 1)))).otherwise(1).cast("int")


def quantile_labels(df: DataFrame, column: str, order: tuple[str, ...], q: int, name: str) -> DataFrame:
    """df with name: the quantile of column's rank, ties by order; rows where it is null are left out."""
    counts = before(df, column, {"c__": F.count(F.lit(1))})
    total = df.where(F.col(column).isNotNull()).agg(F.count(F.lit(1)).alias("n__"))
    rank = F.row_number().over(Window.partitionBy(column).orderBy(*order)) + F.col("c___before")
    return df.join(counts, column).crossJoin(F.broadcast(total)).withColumn(name, quantile_label(rank, F.col("n__"), q)).drop("c__", "c___before", "n__")


def right_closed(c: Column, edges: tuple[float, ...], labels: tuple[str, ...]) -> Column:
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels, strict=False))):
        out = F.when(c <= edge, label).otherwise(out)
    return F.when(c.isNotNull(), out).otherwise("nan")


# Columns that the declared subgroups are of.
ACTIVE = ("js_count", "javascript_count", "openaction_count", "action_count", "aa_count", "launch_count", "uri_count", "submitform_count")
PARSER = ("parse_failure", "recovery_mode", "invalid_eof", "extraction_timeout", "file_too_large", "extraction_limit_reached")
# End of fixed values.


def declared_subgroups(df: DataFrame, key: str) -> tuple[DataFrame, dict[str, Column]]:
    """(df, group type -> subgroup) of the declared types whose columns df has; quantile groups become columns of df.

    source, time_window (5), file_size_decile (10), encryption, active_content, parser_status, obfuscation_level,
    missingness_pattern. Quantile groups number as many as there are distinct values at most; ties in rank go by key.
    """
    out: dict[str, Column] = {}
    known = lambda names: [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names if c in df.columns]
    any_of = lambda parts: functools.reduce(Column.__add__, parts) > 0
    if "source_id" in df.columns:
        out["source"] = F.col("source_id").cast("string")
    for column, q, prefix, name in (("first_seen_at", 5, "time", "time_window"), ("pdf_size", 10, "size", "file_size_decile")):
        if column in df.columns:
            actual = min(q, max(1, df.select(column).dropna().distinct().limit(q).count()))
            if actual < 2:
                out[name] = F.lit(f"{prefix}_constant")
            else:
                missing = df.where(F.col(column).isNull()).withColumn(f"{name}__", F.lit(None).cast("int"))
                df = quantile_labels(df, column, (key,), actual, f"{name}__").unionByName(missing)
                out[name] = F.coalesce(F.concat(F.lit(f"{prefix}_"), F.lpad(F.col(f"{name}__").cast("string"), 2, "0")), F.lit("nan"))
    if "is_encrypted" in df.columns:
        e = F.coalesce(F.col("is_encrypted").cast("double"), F.lit(-1.0))
        out["encryption"] = F.when(e == 0, "not_encrypted").when(e == 1, "encrypted").when(e == -1, "unavailable").otherwise("invalid")
    if parts := known(ACTIVE):
        out["active_content"] = F.when(any_of(parts), "present").otherwise("absent")
    if parts := known(PARSER):
        out["parser_status"] = F.when(any_of(parts), "limited_or_failed").otherwise("nominal")
    if "obfuscation_count" in df.columns:
        out["obfuscation_level"] = right_closed(F.col("obfuscation_count").cast("double"), (0, 1, 5), ("none", "one", "two_to_five", "six_or_more"))
    if "missing_feature_count" in df.columns:
        out["missingness_pattern"] = right_closed(F.col("missing_feature_count").cast("double"), (0, 1), ("none", "one", "two_or_more"))
    return df, out


def subgroup_metrics(df: DataFrame, assignments: dict[str, Column], threshold: float, min_rows: int = MIN_ROWS) -> DataFrame:
    """group_type, subgroup, n_rows, counts and rates; each row is counted once for each kind of group, in one aggregation."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("group_type"), v.cast("string").alias("subgroup")) for k, v in assignments.items()])).alias("g")
    long = df.select("label", "score", each).select("label", "score", "g.group_type", "g.subgroup")
    counts = confusion(long, threshold, ("group_type", "subgroup"))
    return rates(counts).withColumn("n_rows", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).where(F.col("n_rows") >= min_rows)


def drift(df: DataFrame, is_reference: Column, features: tuple[str, ...], bins: int = 10) -> DataFrame:
    """feature, psi, js between the reference rows and the others: bins of the reference's quantiles, shares of at least 1e-8.

    Features are unpivoted; edges have one row a feature; values are binned and counted in one aggregation.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x")
    long = df.select(is_reference.alias("reference"), each).select("reference", "x.feature", "x.value").where("value is not null and not isnan(value) and abs(value) <> double('infinity')")
    edges = quantiles(long.where("reference"), "value", tuple(i / bins for i in range(bins + 1)), ("feature",), "edges").withColumn("edges", F.array_sort(F.array_distinct("edges")))
    # inner edges only: the outer bins are open; the last bin is closed, the others are closed on the left
    inner = edges.select("feature", F.expr("slice(edges, 2, greatest(size(edges) - 2, 0))").alias("inner"), F.size("edges").alias("k"))
    placed = long.join(F.broadcast(inner), "feature").withColumn("bin", F.size(F.filter("inner", lambda e: e <= F.col("value"))))
    counts = placed.groupBy("feature", "k", "bin").agg(F.count_if("reference").alias("r"), F.count_if(~F.col("reference")).alias("c"))
    every = edges.select("feature", F.size("edges").alias("k")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.greatest(F.col("k") - 2, F.lit(0)))))
    full = every.join(counts, ["feature", "k", "bin"], "left").na.fill(0, ["r", "c"])
    w = Window.partitionBy("feature")
    p = F.least(F.greatest(F.col("r") / F.sum("r").over(w), F.lit(1e-8)), F.lit(1.0))
    q = F.least(F.greatest(F.col("c") / F.sum("c").over(w), F.lit(1e-8)), F.lit(1.0))
    full = full.select("feature", "k", p.alias("p"), q.alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    psi = F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p")))
    js = F.lit(0.5) * F.sum(F.col("p") * F.log(F.col("p") / F.col("m"))) + F.lit(0.5) * F.sum(F.col("q") * F.log(F.col("q") / F.col("m")))
    return full.groupBy("feature", "k").agg(psi.alias("psi"), js.alias("js")).select("feature", F.when(F.col("k") < 3, 0.0).otherwise(F.col("psi")).alias("psi"), F.when(F.col("k") < 3, 0.0).otherwise(F.col("js")).alias("js"))


def midranks(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """df with r_<column>: average rank of each value; rows with a null are left out."""
    out = df
    for c in columns:
        n = before(df, c, {"n__": F.count(F.lit(1))})
        out = out.join(n.select(c, (F.col("n___before") + (F.col("n__") + 1) / F.lit(2.0)).alias(f"r_{c}")), c)
    return out


def pairs(df: DataFrame, columns: tuple[str, ...], prefix: str = "", least: float = 0.0) -> DataFrame:
    """left, right, correlation of all pairs of columns with an absolute value of at least least; one aggregation."""
    found = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(F.col(prefix + a).cast("double"), F.col(prefix + b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(found)])
    each = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(found)])
    return row.select(F.inline(each)).where(F.abs("correlation") >= least)


def spearman(df: DataFrame, columns: tuple[str, ...], least: float = 0.0) -> DataFrame:
    return pairs(midranks(df.select(*columns), columns), columns, "r_", least)


def class_shares(df: DataFrame, label: str) -> DataFrame:
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    return n.withColumn("percent", 100.0 * F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()))


def histogram(df: DataFrame, value: str, by: str, bins: int = 40) -> DataFrame:
    """by, bin, n_rows: equal-width bins between each group's least and greatest value, the last closed."""
    span = df.groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    x = df.join(F.broadcast(span), by)
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    return x.where(F.col(value).isNotNull()).groupBy(by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))


def quartiles(df: DataFrame, value: str, by: str) -> DataFrame:
    q = quantiles(df, value, (0.25, 0.5, 0.75), (by,), "q")
    return same(df.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high")), q, (by,)).select(by, "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high")


def class_statistics(df: DataFrame, features: tuple[str, ...], label: str) -> DataFrame:
    """label, feature, mean, std (population), q05, q50, q95."""
    x = unpivoted(df, features, (label,))
    q = quantiles(x, "value", (0.05, 0.5, 0.95), (label, "feature"), "q")
    return same(x.groupBy(label, "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")), q, (label, "feature")).select(label, "feature", "mean", "std", F.col("q")[0].alias("q05"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q95"))


def nonzero_rates(df: DataFrame, fields: tuple[str, ...], label: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) != 0).cast("double").alias("hit")) for f in fields])).alias("x")
    return df.select(label, each).groupBy(label, "x.field").agg(F.avg("x.hit").alias("rate")).select(label, "field", "rate")


def mutual_information(df: DataFrame, feature: str, label: str, bins: int = 10) -> DataFrame:
    """One row: information (nats) between label and the feature's quantile bins, an approximation of the continuous one."""
    edges = quantiles(df, feature, tuple(i / bins for i in range(1, bins)), (), "e").select(F.array_distinct("e").alias("e"))
    binned = df.crossJoin(F.broadcast(edges)).select(F.col(label).alias("y"), F.size(F.filter("e", lambda x: x < F.col(feature))).alias("b"))
    n = binned.groupBy("b", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    n = n.select("n", F.sum("n").over(Window.partitionBy("b")).alias("nb"), F.sum("n").over(Window.partitionBy("y")).alias("ny"), F.sum("n").over(Window.partitionBy()).alias("t"))
    return n.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")))).alias("information"))


def baseline(df: DataFrame, features: tuple[str, ...], label: str) -> DataFrame:
    """feature, mean, std (population) over rows with label 0."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x")
    return df.where(F.col(label) == 0).select(each).groupBy("x.feature").agg(F.avg("x.value").alias("mean"), F.stddev_pop("x.value").alias("std")).select("feature", "mean", "std")


def robust_reference(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """feature, median, mad: a row a feature."""
    x = unpivoted(df, features)
    middle = quantiles(x, "value", (0.5,), ("feature",)).select("feature", F.col("quantiles")[0].alias("median"))
    off = x.join(F.broadcast(middle), "feature").select("feature", F.abs(F.col("value") - F.col("median")).alias("value"))
    return middle.join(quantiles(off, "value", (0.5,), ("feature",)), "feature").select("feature", "median", F.col("quantiles")[0].alias("mad"))
