"""Duplicates with label conflicts, group-temporal partitions, leakage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .order import before

FRACTIONS = (0.8, 0.1, 0.1)
ROLES = (("threshold", 0.40), ("calibration", 0.65), ("policy", 1.0))


def mark_duplicates(df: DataFrame, key: str, label: str, order: tuple[str, ...], name: str = "dedup_reason") -> DataFrame:
    """'' for the row that stays. All rows of a key with two labels go; else the first by order (a total order) stays."""
    per_key = Window.partitionBy(key)
    conflict = F.min(label).over(per_key) != F.max(label).over(per_key)
    rank = F.row_number().over(per_key.orderBy(*order))
    return df.withColumn(name, F.when(conflict, "conflicting_label_for_sample_id").when(rank > 1, "duplicate_sample_id").otherwise(""))


def deduplicate(df: DataFrame, key: str, label: str, order: tuple[str, ...]) -> DataFrame:
    """The rows that mark_duplicates leaves without a reason; keys are summed up before they meet, however often one occurs."""
    rest = [c for c in df.columns if c not in order]
    first = df.groupBy(F.col(key).alias("key__")).agg(F.min(label).alias("low__"), F.max(label).alias("high__"), F.min(F.struct(*order, *rest)).alias("row__"))
    # a label of nulls only is no conflict
    return first.where(F.col("low__").eqNullSafe(F.col("high__"))).select(*[F.col("row__")[c].alias(c) for c in df.columns])


def dedup_statistics(df: DataFrame, key: str, label: str) -> DataFrame:
    """One row of counters, from a count for each key."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.min(label) != F.max(label)).alias("conflict"))
    return per_key.agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if("conflict").alias("conflict_keys"),
        F.coalesce(F.sum(F.when(F.col("conflict"), F.col("n"))), F.lit(0)).alias("conflict_rows"),
        F.coalesce(F.sum(F.when(~F.col("conflict"), F.col("n") - 1)), F.lit(0)).alias("duplicate_rows"),
        F.count_if(~F.col("conflict")).alias("kept_rows"),
        (F.count_if("conflict") / F.count(F.lit(1))).alias("conflict_key_fraction"),
        (F.coalesce(F.sum(F.when(F.col("conflict"), F.col("n"))), F.lit(0)) / F.sum("n")).alias("conflict_row_fraction"),
    )


def groups(df: DataFrame, group: str = "group_id", time: str = "first_seen_at") -> DataFrame:
    return df.groupBy(group).agg(F.min(time).alias("seen"), F.count(F.lit(1)).alias("n_rows"))


def cohorts(per_group: DataFrame) -> DataFrame:
    """seen, n_rows, n_groups, upto: groups by first time, with the running total of their rows."""
    c = before(per_group, "seen", {"n_rows": F.sum("n_rows"), "n_groups": F.count(F.lit(1))})
    return c.select("seen", "n_rows", "n_groups", (F.col("n_rows_before") + F.col("n_rows")).alias("upto"))


def nearest(target: Column) -> Column:
    """The time whose running total is nearest to target, the earliest of equals."""
    return F.min(F.struct(F.abs(F.col("upto") - target).alias("distance"), F.col("seen")))["seen"]


def cuts(per_cohort: DataFrame, fractions: tuple[float, float, float] = FRACTIONS) -> DataFrame:
    """One row: train_end, validation_end."""
    total = per_cohort.agg(F.sum("n_rows").alias("total"))
    both = per_cohort.crossJoin(F.broadcast(total))
    target = lambda x: F.bround(F.col("total") * F.lit(x))
    return both.agg(nearest(target(fractions[0])).alias("train_end"), nearest(target(fractions[0] + fractions[1])).alias("validation_end"))


def assign(df: DataFrame, group: str = "group_id", time: str = "first_seen_at", fractions: tuple[float, float, float] = FRACTIONS) -> DataFrame:
    """df with its partition: whole groups by their first time, at the cuts nearest to the fractions."""
    per_group = groups(df, group, time)
    where = per_group.crossJoin(F.broadcast(cuts(cohorts(per_group), fractions)))
    part = F.when(F.col("seen") <= F.col("train_end"), "train").when(F.col("seen") <= F.col("validation_end"), "validation").otherwise("test")
    return df.join(where.select(group, part.alias("partition")), group, "left")


def partition_statistics(df: DataFrame, group: str = "group_id", time: str = "first_seen_at", label: str = "label") -> DataFrame:
    return df.groupBy("partition").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(group).alias("n_groups"),
        F.avg((F.col(label) == 0).cast("double")).alias("benign_share"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
    )


def in_strict_order(statistics: DataFrame) -> DataFrame:
    """One row: does each partition end before the next one begins?"""
    at = lambda p, c: F.max(F.when(F.col("partition") == p, F.col(c)))
    return statistics.agg((at("train", "last_time") < at("validation", "first_time")).alias("train_before_validation"), (at("validation", "last_time") < at("test", "first_time")).alias("validation_before_test"))


def overlaps(df: DataFrame, column: str) -> DataFrame:
    """first, second, n_shared: distinct values that two partitions share."""
    seen = df.select("partition", column).distinct()
    a, b = seen.withColumnRenamed("partition", "first"), seen.withColumnRenamed("partition", "second")
    names = ["train", "validation", "test"]
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i + 1 :]]
    base = df.sparkSession.createDataFrame(pairs, "first string, second string")
    shared = a.join(b, column).groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))
    return base.join(shared, ["first", "second"], "left").select("first", "second", F.coalesce("n", F.lit(0)).alias("n_shared"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """only_left, only_right: rows of one side that the other lacks, with multiplicity."""
    return left.exceptAll(right).agg(F.count(F.lit(1)).alias("only_left")).crossJoin(right.exceptAll(left).agg(F.count(F.lit(1)).alias("only_right")))


def boundaries(per_group: DataFrame, fractions: tuple[float, ...]) -> DataFrame:
    """fraction, boundary, upto: for each fraction, the time nearest to it after which no earlier group follows.

    Groups of equal first time are one cohort; a boundary may stand after a cohort if the latest row before it is earlier
    than the earliest row after it (columns seen, last, n_rows).
    """
    first, last = F.struct(F.col("seen").alias("at"), F.lit(1).alias("starts"), F.lit(0).alias("ends"), "n_rows"), F.struct(F.col("last").alias("at"), F.lit(0).alias("starts"), F.lit(1).alias("ends"), F.lit(0).cast("long").alias("n_rows"))
    events = per_group.withColumn("n_rows", F.col("n_rows").cast("long")).select(F.inline(F.array(first, last)))
    x = before(events, "at", {"starts": F.sum("starts"), "ends": F.sum("ends"), "n": F.sum("n_rows")})
    # before a cohort, as many groups have ended as have begun
    legal = x.where("starts > 0 and starts_before > 0 and starts_before = ends_before").select(F.col("at").alias("next"), F.col("n_before").alias("upto"))
    legal = legal.crossJoin(F.broadcast(x.agg(F.sum("n").alias("total")))).withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    best = F.min(F.struct(F.abs(F.col("upto") - F.bround(F.col("total") * F.col("fraction"))).alias("distance"), "next", "upto"))
    chosen = legal.groupBy("fraction").agg(best.alias("x")).select("fraction", "x.next", "x.upto")
    # a row a fraction
    return per_group.crossJoin(F.broadcast(chosen)).where(F.col("seen") < F.col("next")).groupBy("fraction", "upto").agg(F.max("seen").alias("boundary")).select("fraction", "boundary", "upto")


def spans(df: DataFrame, group: str = "group_id", time: str = "first_seen_at") -> DataFrame:
    return df.groupBy(group).agg(F.min(time).alias("seen"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n_rows"))


def roles(df: DataFrame, group: str = "group_id", time: str = "first_seen_at", names: tuple[str, ...] = ("threshold", "calibration", "policy"), fractions: tuple[float, ...] = (0.40, 0.65)) -> DataFrame:
    """group -> role: consecutive blocks of whole groups between strict boundaries."""
    per_group = spans(df, group, time)
    found = boundaries(per_group, fractions)
    row = found.agg(*[F.max(F.when(F.col("fraction") == float(f), F.col("boundary"))).alias(f"b{i}") for i, f in enumerate(fractions)])
    role = F.lit(names[-1])
    for i in range(len(fractions) - 1, -1, -1):
        role = F.when(F.col("seen") <= F.col(f"b{i}"), names[i]).otherwise(role)
    return per_group.crossJoin(F.broadcast(row)).select(group, "n_rows", "seen", "last", role.alias("role"))


def folds(df: DataFrame, n: int, group: str = "group_id", time: str = "first_seen_at") -> DataFrame:
    """group, block: n + 1 consecutive blocks of whole groups; fold k trains on blocks below k and validates on block k."""
    fractions = tuple((i + 1) / (n + 1) for i in range(n))
    return roles(df, group, time, tuple(str(i) for i in range(n + 1)), fractions).select(group, "n_rows", F.col("role").cast("int").alias("block"))
