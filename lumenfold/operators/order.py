"""Running totals over a whole column without a task that holds it all.

Rows are summed by value first. Values are dealt into ranges at approximate quantiles; totals of ranges (RANGES rows) are
accumulated in one small window, values within a range in windows of their own. The result is exact whatever the
quantiles are; they only decide how even the ranges get.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RANGES = 128


def same(left: DataFrame, right: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """left with right's other columns, joined on by; nulls are equal."""
    named = right.withColumnsRenamed({c: f"{c}__right" for c in by})
    on = [left[c].eqNullSafe(named[f"{c}__right"]) for c in by]
    return left.join(named, on).drop(*[f"{c}__right" for c in by])


def before(df: DataFrame, column: str, sums: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """by, column, each sum of a value, and `<name>_before`: the sum over all smaller values of the group. Null values are left out."""
    df = df.where(F.col(column).isNotNull())
    cuts = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    edges = df.groupBy(*by).agg(F.array_distinct(F.percentile_approx(column, cuts, 1000)).alias("edges__"))
    each = df.groupBy(*by, column).agg(*[x.alias(n) for n, x in sums.items()])
    # without groups one row; with them a row a group, which Spark broadcasts where it is small
    each = same(each, edges, by) if by else each.crossJoin(F.broadcast(edges))
    each = each.withColumn("range__", F.size(F.filter("edges__", lambda e: e < F.col(column)))).drop("edges__")
    totals = each.groupBy(*by, "range__").agg(*[F.sum(n).alias(n) for n in sums])
    lower = Window.partitionBy(*by).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "range__", *[F.coalesce(F.sum(n).over(lower), F.lit(0)).alias(f"{n}_lower__") for n in sums])
    within = Window.partitionBy(*by, "range__").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({f"{n}_within__": F.coalesce(F.sum(n).over(within), F.lit(0)) for n in sums})
    out = same(each, totals, (*by, "range__"))
    return out.select(*by, column, *sums, *[(F.col(f"{n}_lower__") + F.col(f"{n}_within__")).alias(f"{n}_before") for n in sums])


def quantiles(df: DataFrame, column: str, shares: tuple[float, ...], by: tuple[str, ...] = (), name: str = "quantiles") -> DataFrame:
    """by and name: the exact quantiles at shares, interpolated between neighbours in order; groups without a value have no row.

    Rows are counted by value and given their places by before(), so no task holds a column's values; then each place that
    a share asks for is the value that covers it.
    """
    x = df.select(*by, F.col(column).cast("double").alias("value__"))
    placed = before(x, "value__", {"n__": F.count(F.lit(1))}, by)
    total = placed.groupBy(*by).agg(F.sum("n__").alias("all__"))
    placed = same(placed, total, by) if by else placed.crossJoin(F.broadcast(total))
    first, last = F.col("n___before"), F.col("n___before") + F.col("n__")

    def at(place: Column) -> Column:
        return F.max(F.when((place >= first) & (place < last), F.col("value__")))

    found = []
    for i, share in enumerate(shares):
        place = (F.col("all__") - 1) * F.lit(float(share))
        found += [at(F.floor(place)).alias(f"low__{i}"), at(F.ceil(place)).alias(f"high__{i}"), F.max(place - F.floor(place)).alias(f"part__{i}")]
    each = [F.col(f"low__{i}") * (1 - F.col(f"part__{i}")) + F.col(f"high__{i}") * F.col(f"part__{i}") for i in range(len(shares))]
    return placed.groupBy(*by).agg(*found).select(*by, F.array(*each).alias(name)).where(F.col(name)[0].isNotNull())


def long(df: DataFrame, columns: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, feature, value (double): a row for each column."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")
    return df.select(*keep, each).select(*keep, "x.feature", "x.value")


def column_quantiles(df: DataFrame, columns: tuple[str, ...], shares: tuple[float, ...]) -> dict[str, list[float] | None]:
    """Quantiles of several columns, nulls and NaN aside: a row a column goes to the driver."""
    x = long(df, columns).where(~F.isnan("value"))
    return dict.fromkeys(columns) | {r["feature"]: list(r["quantiles"]) for r in quantiles(x, "value", shares, ("feature",)).collect()}
