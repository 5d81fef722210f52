"""Views of the supplied tables in the shape of the feature contract, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..specs import BASE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A total order of line items, for "the first row".
FIRST = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def telemetry(spark: SparkSession, sf_dir: str, group: str = "l_orderkey") -> DataFrame:
    """Line items with their orders as labelled samples; group: l_orderkey (one date each) or o_custkey (many dates)."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    both = items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
    return both.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sample_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("o_orderpriority").alias("source_id"),
        F.col(group).alias("group_id"),
        F.col("o_orderdate").alias("first_seen_at"),
        *FIRST,
    )


def telemetry_sql(group: str = "l_orderkey") -> str:
    return f"""T AS (
  SELECT concat(l_orderkey, '-', l_linenumber) AS sample_id, CAST(l_returnflag = 'R' AS INTEGER) AS label,
         o_orderpriority AS source_id, {group} AS group_id, o_orderdate AS first_seen_at, {', '.join(FIRST)}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


DEDUP_SQL = f"""D0 AS (
  SELECT *, min(label) OVER (PARTITION BY sample_id) <> max(label) OVER (PARTITION BY sample_id) AS conflict,
         row_number() OVER (PARTITION BY sample_id ORDER BY {', '.join(FIRST)}) AS rn FROM T
), D AS (SELECT * FROM D0 WHERE NOT conflict AND rn = 1)"""

PARTITION_SQL = """G AS (SELECT group_id, min(first_seen_at) AS seen, count(*) AS n FROM D GROUP BY group_id),
C AS (SELECT seen, sum(n) AS n, count(*) AS n_groups, sum(sum(n)) OVER (ORDER BY seen) AS upto FROM G GROUP BY seen),
N AS (SELECT sum(n) AS total FROM C),
K AS (SELECT (SELECT seen FROM C, N ORDER BY abs(upto - round_even(total * 0.8, 0)), seen LIMIT 1) AS train_end,
             (SELECT seen FROM C, N ORDER BY abs(upto - round_even(total * 0.9, 0)), seen LIMIT 1) AS validation_end),
P AS (SELECT D.*, CASE WHEN seen <= train_end THEN 'train' WHEN seen <= validation_end THEN 'validation' ELSE 'test' END AS part
      FROM D JOIN G USING (group_id), K)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored samples: label error, score value / 500."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "ts", "event_type", "value", (F.col("event_type") == "error").cast("int").alias("label"), F.least(F.col("value") / F.lit(500.0), F.lit(1.0)).alias("score"))


SCORES_SQL = """S AS (
  SELECT event_id, user_id, ts, event_type, value, CAST(event_type = 'error' AS INTEGER) AS label, least(value / 500.0::DOUBLE, 1.0::DOUBLE) AS score
  FROM events
)"""


def _feature_parts(i: int, kind: str) -> tuple[int, int, int]:
    return i + 3, 2 * i + 1, {"boolean": 2, "count": 7 + i % 5, "continuous": 97}[kind]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the 37 base features, made from their keys; about one value in eleven is unknown where it may be."""
    o = table(spark, sf_dir, "orders")

    def value(i: int) -> Column:
        f = BASE[i]
        a, b, m = _feature_parts(i, f.kind)
        x = (F.col("o_orderkey") * a + F.col("o_custkey") * b) % m
        x = (x * 17 + 10 if f.kind == "continuous" else x).cast("double")
        return x if f.required else F.when((F.col("o_orderkey") + i) % 11 != 0, x)

    return o.select(F.col("o_orderkey").cast("string").alias("sample_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("Class"), F.col("o_orderpriority").alias("source_id"), F.col("o_custkey").cast("string").alias("group_id"), F.col("o_orderdate").cast("timestamp").alias("first_seen_at"), F.lit(1.0).alias("label_confidence"), *[value(i).alias(f.name) for i, f in enumerate(BASE)])


def features_sql() -> str:
    out = []
    for i, f in enumerate(BASE):
        a, b, m = _feature_parts(i, f.kind)
        x = f"(o_orderkey * {a} + o_custkey * {b}) % {m}"
        x = f"CAST({f'({x}) * 17 + 10' if f.kind == 'continuous' else x} AS DOUBLE)"
        out.append(f"{x if f.required else f'CASE WHEN (o_orderkey + {i}) % 11 <> 0 THEN {x} END'} AS {f.name}")
    return f"""F AS (SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS "Class",
  o_orderpriority AS source_id, CAST(o_custkey AS VARCHAR) AS group_id, o_orderdate AS first_seen_at, {', '.join(out)} FROM orders)"""
