"""Registered queries over the supplied tables and the SQL that checks them."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import engineered, preprocess
from ..operators import curves, evidence, monitor, quality, split, uncertainty
from ..operators.order import quantiles
from ..specs import BASE, BASE_NAMES, STATUS, Feature
from . import engineered_sql
from .views import DEDUP_SQL, FIRST, NUMBERS, PARTITION_SQL, SCORES_SQL, features, features_sql, scores, table, telemetry, telemetry_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def r(c, digits: int = 8):
    return F.round(c, digits)


T, TC = telemetry_sql(), telemetry_sql("o_custkey")
TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"
NUMERIC = tuple(Feature(n, "continuous") for n in NUMBERS)
ORDERED = tuple(Feature(n, k) for n, k in (("l_quantity", "count"), ("l_extendedprice", "continuous"), ("l_discount", "boolean"), ("l_tax", "boolean")))

# ---- scans and projections -----------------------------------------------------------------------


@query("scan_project", "SELECT l_orderkey, l_quantity, l_discount FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'")
def _(spark, d):
    return table(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz'1998-01-01 00:00:00'").select("l_orderkey", "l_quantity", "l_discount")


@query("row_counts", "SELECT 'lineitem' AS name, count(*) AS n_rows FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents")
def _(spark, d):
    each = [table(spark, d, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n_rows")) for t in ("lineitem", "orders", "events", "documents")]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


@query("limited_load", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("typed_projection", "SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, CAST(o_orderstatus = 'F' AS INTEGER) AS label, CAST(o_totalprice AS DOUBLE) AS price FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("sample_id"), (F.col("o_orderstatus") == "F").cast("int").alias("label"), F.col("o_totalprice").cast("double").alias("price"))


@query("canonical_types", f"WITH {features_sql()} SELECT sample_id, {', '.join(f'CAST(CAST({f.name} AS FLOAT) AS DOUBLE) AS {f.name}' if f.kind == 'continuous' else f'CAST({f.name} AS INTEGER) AS {f.name}' for f in BASE)} FROM F")
def _(spark, d):
    c = quality.canonical_types(quality.canonicalise(features(spark, d)))
    return c.select("sample_id", *[F.col(f.name).cast("double" if f.kind == "continuous" else "int").alias(f.name) for f in BASE])


# ---- validation ----------------------------------------------------------------------------------

_NUMBER_REASONS = """concat_ws(';', CASE WHEN l_quantity < 0 THEN 'below_minimum:l_quantity' END,
  CASE WHEN l_discount > 1 THEN 'above_maximum:l_discount' END,
  CASE WHEN abs(l_discount - round_even(l_discount, 0)) > 1e-6 THEN 'non_integral_boolean:l_discount' END,
  CASE WHEN abs(l_tax - round_even(l_tax, 0)) > 1e-6 THEN 'non_integral_boolean:l_tax' END)"""


def _checked(spark, d):
    return quality.with_reasons(telemetry(spark, d), ORDERED, metadata=False)


@query("reason_codes", f"WITH {T} SELECT sample_id, l_partkey, l_suppkey, {_NUMBER_REASONS} AS reason FROM T")
def _(spark, d):
    return _checked(spark, d).select("sample_id", "l_partkey", "l_suppkey", "reason")


@query("reason_counts", f"WITH {T}, R AS (SELECT {_NUMBER_REASONS} AS reason FROM T) SELECT code, count(*) AS n_rows FROM (SELECT unnest(string_split(reason, ';')) AS code FROM R WHERE reason <> '') GROUP BY code")
def _(spark, d):
    return quality.reason_counts(_checked(spark, d))


def _damaged(spark, d):
    """The feature view with every 50th label, 70th id and 90th size spoilt."""
    f = features(spark, d)
    k = F.col("sample_id").cast("long")
    return f.withColumns({"Class": F.when(k % 50 == 0, 7).otherwise(F.col("Class")), "sample_id": F.when(k % 70 == 0, F.concat(F.lit("http://x/"), "sample_id")).otherwise(F.col("sample_id")), "pdf_size": F.when(k % 90 == 0, F.lit(None)).otherwise(F.col("pdf_size")), "obj_count": F.when(k % 110 == 0, F.lit(0.5)).otherwise(F.col("obj_count"))})


_DAMAGED = f"""{features_sql()}, X AS (SELECT CAST(sample_id AS BIGINT) AS k, source_id, obj_count FROM F),
R AS (SELECT k, CASE WHEN k % 70 = 0 THEN concat('http://x/', k) ELSE CAST(k AS VARCHAR) END AS sample_id,
  concat_ws(';', CASE WHEN k % 50 = 0 THEN 'invalid_label' END, CASE WHEN k % 70 = 0 THEN 'non_opaque_sample_id' END,
    CASE WHEN k % 110 = 0 THEN 'non_integral_count:obj_count' END, CASE WHEN k % 90 = 0 THEN 'missing_required:pdf_size' END) AS reason FROM X)"""


@query("contract_reasons", f"WITH {_DAMAGED} SELECT sample_id, reason FROM R")
def _(spark, d):
    return quality.with_reasons(_damaged(spark, d)).select("sample_id", "reason")


@query("row_flow", f"WITH {_DAMAGED} SELECT count(*) AS received, count(*) FILTER (regexp_replace(reason, 'invalid_label', '') IN ('', ';')) AS schema_valid, count(*) FILTER (reason NOT LIKE '%invalid_label%') AS label_valid, count(*) FILTER (reason = '') AS fully_valid FROM R")
def _(spark, d):
    return quality.row_flow(quality.with_reasons(_damaged(spark, d)))


@query("quarantine_hashed_ids", f"WITH {_DAMAGED} SELECT concat('q-', sha256(sample_id)) AS sample_id, reason FROM R WHERE reason <> ''")
def _(spark, d):
    return quality.quarantine(quality.with_reasons(_damaged(spark, d)), ("sample_id",))


@query("frame_report", f"""WITH {T} SELECT * FROM (
  SELECT 'invalid_label' AS code, 'label' AS "column", count(*) FILTER (label NOT IN (0, 1)) AS n_rows FROM T
  UNION ALL SELECT 'empty_identifier', 'sample_id', count(*) FILTER (trim(sample_id) = '') FROM T
  UNION ALL SELECT 'duplicate_identifier', 'sample_id', count(*) - count(DISTINCT sample_id) FROM T
  {' '.join(f"UNION ALL SELECT 'feature_missing', '{n}', count(*) FILTER ({n} IS NULL) FROM T UNION ALL SELECT 'feature_below_minimum', '{n}', count(*) FILTER ({n} < 0) FROM T" for n in NUMBERS)})""")
def _(spark, d):
    return quality.frame_report(telemetry(spark, d), NUMERIC, "label")


@query("feature_quality", f"WITH {features_sql()} " + " UNION ALL ".join(f"SELECT '{n}' AS feature, count(*) FILTER ({n} IS NULL) AS n_missing, round(count(*) FILTER ({n} IS NULL) / count(*)::DOUBLE, 8) AS missing_fraction, min({n}) AS low, max({n}) AS high, min({n}) = max({n}) AS constant FROM F" for n in BASE_NAMES))
def _(spark, d):
    return quality.feature_quality(features(spark, d), BASE_NAMES).withColumn("missing_fraction", r("missing_fraction"))


@query("source_label_grouping_sets", f"WITH {T} SELECT source_id, label, count(*) AS n_rows FROM T GROUP BY GROUPING SETS ((label), (source_id), (source_id, label))")
def _(spark, d):
    return quality.source_label_counts(telemetry(spark, d))


@query("coverage", f"WITH {T} SELECT count(*) AS n_rows, count(DISTINCT group_id) AS n_groups, count(DISTINCT source_id) AS n_sources, strftime(min(first_seen_at), '%Y-%m-%d %H:%M:%S') AS first_time, strftime(max(first_seen_at), '%Y-%m-%d %H:%M:%S') AS last_time, round(avg(label), 8) AS positive_share FROM T")
def _(spark, d):
    return quality.coverage(telemetry(spark, d)).select("n_rows", "n_groups", "n_sources", stamp("first_time"), stamp("last_time"), r("positive_share").alias("positive_share"))


@query("gates", "SELECT 'n_rows' AS gate, count(*)::DOUBLE AS actual, 1000.0::DOUBLE AS required, count(*) >= 1000 AS passed FROM lineitem UNION ALL SELECT 'n_orders', count(DISTINCT l_orderkey)::DOUBLE, 1000000.0::DOUBLE, count(DISTINCT l_orderkey) >= 1000000 FROM lineitem")
def _(spark, d):
    counts = table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("l_orderkey").alias("n_orders"))
    return quality.gates(counts, {"n_rows": 1000, "n_orders": 1_000_000})


@query("numeric_prefix_parse", r"SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(regexp_extract(o_orderpriority, '^([0-9]+)', 1) AS DOUBLE) END AS value FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("raw", F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("-"), "o_orderpriority")).otherwise(F.col("o_orderpriority")))
    return o.select("o_orderkey", quality.leading_number("raw").alias("value"))


@query("legacy_flags", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.0::DOUBLE END AS has_text, CAST(o_orderpriority SIMILAR TO '[0-9]-.*' AS DOUBLE) AS header_valid FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("text", F.when(F.col("o_orderstatus") == "F", " Yes ").when(F.col("o_orderstatus") == "O", "no").otherwise("?"))
    return o.select("o_orderkey", quality.yes_no("text").alias("has_text"), F.col("o_orderpriority").rlike(r"^\d-").cast("double").alias("header_valid"))


@query("low_confidence_queue", "SELECT event_id, score FROM (SELECT event_id, least(value / 500.0::DOUBLE, 1.0::DOUBLE) AS score FROM events) WHERE score < 0.8 ORDER BY event_id LIMIT 1000")
def _(spark, d):
    return quality.review_queue(scores(spark, d).select("event_id", "score"), ("event_id",), "score")


@query("masked_features", "SELECT o_orderkey, CAST(NULL AS DOUBLE) AS o_totalprice FROM orders")
def _(spark, d):
    return quality.mask(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ("o_totalprice",))


@query("distinct_feature_rows", "SELECT DISTINCT l_quantity, l_discount, l_tax FROM lineitem")
def _(spark, d):
    return quality.distinct_rows(table(spark, d, "lineitem"), ("l_quantity", "l_discount", "l_tax"))


@query("constant_features", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, d):
    return quality.without_constants(table(spark, d, "orders").select("o_orderkey", "o_totalprice").withColumn("one", F.lit(1)), ("o_totalprice", "one"))


@query("text_envelope", "SELECT doc_id, CASE WHEN strlen(text) = 0 THEN 'empty' WHEN strlen(text) > 2000 THEN 'too_large' WHEN position('%PDF-' IN left(text, 1024)) = 0 THEN 'missing_header' ELSE 'missing_eof' END AS verdict FROM documents")
def _(spark, d):
    return table(spark, d, "documents").withColumn("content", F.col("text").cast("binary")).select("doc_id", quality.envelope(maximum=2000).alias("verdict"))


# ---- duplicates, partitions, sets ----------------------------------------------------------------


@query("dedup_keep", f"WITH {T}, {DEDUP_SQL} SELECT sample_id, label, l_partkey, l_suppkey, l_quantity FROM D")
def _(spark, d):
    return split.deduplicate(telemetry(spark, d), "sample_id", "label", FIRST).select("sample_id", "label", "l_partkey", "l_suppkey", "l_quantity")


@query("dedup_reasons", f"WITH {T}, {DEDUP_SQL} SELECT CASE WHEN conflict THEN 'conflicting_label_for_sample_id' WHEN rn > 1 THEN 'duplicate_sample_id' ELSE '' END AS dedup_reason, count(*) AS n_rows FROM D0 GROUP BY 1")
def _(spark, d):
    return split.mark_duplicates(telemetry(spark, d), "sample_id", "label", FIRST).groupBy("dedup_reason").agg(F.count(F.lit(1)).alias("n_rows"))


@query("dedup_stats", f"""WITH {T}, K AS (SELECT sample_id, count(*) AS n, min(label) <> max(label) AS conflict FROM T GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, count(*) FILTER (conflict) AS conflict_keys, CAST(coalesce(sum(n) FILTER (conflict), 0) AS BIGINT) AS conflict_rows,
  CAST(coalesce(sum(n - 1) FILTER (NOT conflict), 0) AS BIGINT) AS duplicate_rows, count(*) FILTER (NOT conflict) AS kept_rows,
  round(count(*) FILTER (conflict) / count(*)::DOUBLE, 8) AS conflict_key_fraction, round(coalesce(sum(n) FILTER (conflict), 0)::DOUBLE / sum(n)::DOUBLE, 8) AS conflict_row_fraction FROM K""")
def _(spark, d):
    s = split.dedup_statistics(telemetry(spark, d), "sample_id", "label")
    return s.withColumns({c: r(c) for c in ("conflict_key_fraction", "conflict_row_fraction")})


def _partitioned(spark, d, group="l_orderkey"):
    return split.assign(split.deduplicate(telemetry(spark, d, group), "sample_id", "label", FIRST))


_STATS = "SELECT part AS partition, count(*) AS n_rows, count(DISTINCT group_id) AS n_groups, round(avg(CAST(label = 0 AS DOUBLE)), 8) AS benign_share, strftime(min(first_seen_at), '%Y-%m-%d %H:%M:%S') AS first_time, strftime(max(first_seen_at), '%Y-%m-%d %H:%M:%S') AS last_time FROM P GROUP BY part"


def _stats(df):
    return split.partition_statistics(df).select("partition", "n_rows", "n_groups", r("benign_share").alias("benign_share"), stamp("first_time"), stamp("last_time"))


@query("split_partition_stats", f"WITH {T}, {DEDUP_SQL}, {PARTITION_SQL} {_STATS}")
def _(spark, d):
    return _stats(_partitioned(spark, d))


@query("split_partition_stats_by_customer", f"WITH {TC}, {DEDUP_SQL}, {PARTITION_SQL} {_STATS}")
def _(spark, d):
    return _stats(_partitioned(spark, d, "o_custkey"))


_ORDER = """SELECT max(CASE part WHEN 'train' THEN last_time END) < max(CASE part WHEN 'validation' THEN first_time END) AS train_before_validation,
  max(CASE part WHEN 'validation' THEN last_time END) < max(CASE part WHEN 'test' THEN first_time END) AS validation_before_test
FROM (SELECT part, min(first_seen_at) AS first_time, max(first_seen_at) AS last_time FROM P GROUP BY part)"""


@query("strict_time_order", f"WITH {T}, {DEDUP_SQL}, {PARTITION_SQL} {_ORDER}")
def _(spark, d):
    return split.in_strict_order(split.partition_statistics(_partitioned(spark, d)))


@query("strict_time_order_by_customer", f"WITH {TC}, {DEDUP_SQL}, {PARTITION_SQL} {_ORDER}")
def _(spark, d):
    return split.in_strict_order(split.partition_statistics(_partitioned(spark, d, "o_custkey")))


@query("group_rollup", f"WITH {T} SELECT group_id, strftime(min(first_seen_at), '%Y-%m-%d %H:%M:%S') AS seen, count(*) AS n_rows FROM T GROUP BY group_id")
def _(spark, d):
    return split.groups(telemetry(spark, d)).select("group_id", stamp("seen"), "n_rows")


@query("cohort_cumulative", f"WITH {T}, {DEDUP_SQL}, {PARTITION_SQL} SELECT strftime(seen, '%Y-%m-%d %H:%M:%S') AS seen, CAST(n AS BIGINT) AS n_rows, n_groups, CAST(upto AS BIGINT) AS upto FROM C")
def _(spark, d):
    c = split.cohorts(split.groups(split.deduplicate(telemetry(spark, d), "sample_id", "label", FIRST)))
    return c.select(stamp("seen"), "n_rows", "n_groups", "upto")


@query("split_cuts", f"WITH {T}, {DEDUP_SQL}, {PARTITION_SQL} SELECT strftime(train_end, '%Y-%m-%d %H:%M:%S') AS train_end, strftime(validation_end, '%Y-%m-%d %H:%M:%S') AS validation_end FROM K")
def _(spark, d):
    c = split.cuts(split.cohorts(split.groups(split.deduplicate(telemetry(spark, d), "sample_id", "label", FIRST))))
    return c.select(stamp("train_end"), stamp("validation_end"))


@query("group_partition_join", f"WITH {T}, {DEDUP_SQL}, {PARTITION_SQL} SELECT sample_id, part AS partition FROM P")
def _(spark, d):
    return _partitioned(spark, d).select("sample_id", "partition")


@query("overlap_intersect", f"""WITH {TC}, {DEDUP_SQL}, {PARTITION_SQL}, V AS (SELECT DISTINCT part, source_id AS v FROM P),
B(first, second) AS (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test'))
SELECT first, second, (SELECT count(*) FROM V a JOIN V b USING (v) WHERE a.part = first AND b.part = second) AS n_shared FROM B""")
def _(spark, d):
    return split.overlaps(_partitioned(spark, d, "o_custkey"), "source_id")


@query("group_overlap", "SELECT 'train' AS first, 'validation' AS second, 0::BIGINT AS n_shared UNION ALL SELECT 'train', 'test', 0 UNION ALL SELECT 'validation', 'test', 0")
def _(spark, d):
    return split.overlaps(_partitioned(spark, d), "group_id")


@query("except_both_ways", "SELECT (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders)) AS only_left, (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT ALL SELECT l_orderkey FROM lineitem)) AS only_right")
def _(spark, d):
    return split.difference(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), table(spark, d, "orders").select(F.col("o_orderkey").alias("k")))


@query("duplicate_keys", "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_duplicates FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").agg((F.count(F.lit(1)) - F.count_distinct("l_orderkey", "l_linenumber")).alias("n_duplicates"))


@query("union_all_tables", "SELECT 'customer' AS kind, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_name, s_acctbal FROM supplier")
def _(spark, d):
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))


@query("ordered_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem ORDER BY 1, 2")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct().orderBy("l_returnflag", "l_linestatus")


@query("leakage_semi", f"""WITH {T}, {DEDUP_SQL}, {PARTITION_SQL}, A AS (SELECT DISTINCT {', '.join(f'round({n}, 6) AS {n}' for n in NUMBERS)} FROM P WHERE part = 'train')
SELECT sample_id FROM P p WHERE part = 'test' AND EXISTS (SELECT 1 FROM A WHERE {' AND '.join(f'A.{n} = round(p.{n}, 6)' for n in NUMBERS)})""")
def _(spark, d):
    p = _partitioned(spark, d)
    key = [F.round(n, 6).alias(f"k_{n}") for n in NUMBERS]
    test, train = (p.where(F.col("partition") == x).select("sample_id", *key) for x in ("test", "train"))
    return test.join(train, [f"k_{n}" for n in NUMBERS], "left_semi").select("sample_id")


@query("unlabelled_anti", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("label_join_missing_keys", "SELECT count(*) FILTER (l.doc_id IS NULL) AS n_missing, count(*) AS n_rows FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.lit(1).alias("known"))
    return table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").agg(F.count_if(F.col("known").isNull()).alias("n_missing"), F.count(F.lit(1)).alias("n_rows"))


_BOUNDS = """Q AS (SELECT user_id AS group_id, min(ts) AS seen, max(ts) AS last, count(*) AS n FROM E GROUP BY 1),
C AS (SELECT seen, max(last) AS last, sum(n) AS n FROM Q GROUP BY seen),
L AS (SELECT seen, sum(n) OVER (ORDER BY seen) AS upto, max(last) OVER (ORDER BY seen) AS ll, min(seen) OVER (ORDER BY seen ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rf, sum(n) OVER () AS total FROM C),
Z AS (SELECT * FROM L WHERE ll < rf)"""
#: Events grouped by day, so that strict boundaries exist.
_DAYS = "E AS (SELECT date_trunc('day', ts) AS user_id, ts FROM events)"


def _by_day(spark, d):
    return scores(spark, d).select(F.date_trunc("day", "ts").alias("group_id"), F.col("ts").alias("first_seen_at"), "label")


@query("strict_boundaries", f"WITH {_DAYS}, {_BOUNDS}, W(fraction) AS (VALUES (0.4::DOUBLE), (0.65::DOUBLE)) SELECT fraction, strftime((SELECT seen FROM Z ORDER BY abs(upto - round_even(total * fraction, 0)), seen LIMIT 1), '%Y-%m-%d %H:%M:%S') AS boundary FROM W")
def _(spark, d):
    return split.boundaries(split.spans(_by_day(spark, d)), (0.4, 0.65)).select("fraction", stamp("boundary"))


@query("validation_roles", f"""WITH {_DAYS}, {_BOUNDS}, B AS (SELECT (SELECT seen FROM Z ORDER BY abs(upto - round_even(total * 0.4::DOUBLE, 0)), seen LIMIT 1) AS b0, (SELECT seen FROM Z ORDER BY abs(upto - round_even(total * 0.65::DOUBLE, 0)), seen LIMIT 1) AS b1)
SELECT CASE WHEN seen <= b0 THEN 'threshold' WHEN seen <= b1 THEN 'calibration' ELSE 'policy' END AS role, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows FROM Q, B GROUP BY 1""")
def _(spark, d):
    return split.roles(_by_day(spark, d)).groupBy("role").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n_rows").alias("n_rows"))


@query("role_disjointness", "SELECT 0::BIGINT AS n_shared")
def _(spark, d):
    return split.roles(_by_day(spark, d)).groupBy("group_id").agg(F.count_distinct("role").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_shared"))


@query("temporal_folds", f"""WITH {_DAYS}, {_BOUNDS}, {', '.join(f'B{i} AS (SELECT seen AS b FROM Z ORDER BY abs(upto - round_even(total * ({i + 1} / 4.0::DOUBLE), 0)), seen LIMIT 1)' for i in range(3))}
SELECT CASE WHEN seen <= B0.b THEN 0 WHEN seen <= B1.b THEN 1 WHEN seen <= B2.b THEN 2 ELSE 3 END AS block, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows FROM Q, B0, B1, B2 GROUP BY 1""")
def _(spark, d):
    return split.folds(_by_day(spark, d), 3).groupBy("block").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n_rows").alias("n_rows"))


# ---- engineered features and preprocessing -------------------------------------------------------


def _register_families():
    for family in ("scale_stable", "density", "structural_consistency", "interaction", "complexity", "parser_health"):

        def run(spark, d, family=family):
            e = engineered.engineer(features(spark, d), ("sample_id",), (family,))
            return e.select("sample_id", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in e.columns[1:]])

        names = {"scale_stable": "log1p_features", "density": "density", "structural_consistency": "gaps", "interaction": "interactions", "complexity": "entropy_concentration", "parser_health": "health"}
        query(names[family], f"WITH {features_sql()} SELECT sample_id, {', '.join(f'round(CAST(CAST({x} AS FLOAT) AS DOUBLE), 4) AS {n}' for n, x in engineered_sql.family(family))} FROM F")(run)


_register_families()


@query("feature_lineage", "SELECT * FROM (VALUES ('scale_stable', 34::BIGINT), ('density', 10), ('structural_consistency', 10), ('interaction', 6), ('complexity', 5), ('parser_health', 4)) t(family, n_features)")
def _(spark, d):
    return spark.createDataFrame([(f, n) for n, f, _, _ in engineered.catalogue()], "family string, name string").groupBy("family").agg(F.count(F.lit(1)).alias("n_features"))


@query("row_missing_count", f"WITH {features_sql()} SELECT sample_id, {' + '.join(f'CAST({n} IS NULL AS BIGINT)' for n in BASE_NAMES)} AS n_missing FROM F")
def _(spark, d):
    return features(spark, d).select("sample_id", sum((F.col(n).isNull().cast("long") for n in BASE_NAMES), F.lit(0)).cast("long").alias("n_missing"))


@query("fit_statistics", f"WITH {features_sql()} " + " UNION ALL ".join(f"SELECT '{n}' AS feature, round(quantile_cont({n}, 0.5), 6) AS median, CAST(count(DISTINCT {n}) + max(CAST({n} IS NULL AS INTEGER)) AS DOUBLE) AS n_distinct, round(quantile_cont({n}, 0.0001), 6) AS low, round(quantile_cont({n}, 0.9999), 6) AS high FROM F" for n in BASE_NAMES))
def _(spark, d):
    s = preprocess.statistics(features(spark, d), BASE_NAMES)
    return s.select("feature", r("median", 6).alias("median"), "n_distinct", r("low", 6).alias("low"), r("high", 6).alias("high"))


_SOME = ("obj_count", "pdf_size", "page_count", "title_chars")


def _scaled_sql(clip: bool) -> str:
    fill = {n: f"coalesce({n}, (SELECT quantile_cont({n}, 0.5) FROM F))" for n in _SOME}
    low = lambda n: f"(SELECT quantile_cont({n}, 0.0001) FROM F)"
    high = lambda n: f"(SELECT quantile_cont({n}, 0.9999) FROM F)"
    x = {n: f"least(greatest({fill[n]}, {low(n)}), {high(n)})" if clip else fill[n] for n in _SOME}
    out = [f"round((I.{n} - (SELECT avg({n}) FROM I)) / (SELECT stddev_pop({n}) FROM I), 4) AS {n}" for n in _SOME]
    flags = [f"CAST(I.m_{n} AS DOUBLE) AS {n}__missing" for n in _SOME] + ([f"CAST(I.c_{n} AS DOUBLE) AS {n}__clipped" for n in _SOME] if clip else [])
    inner = ", ".join([f"{x[n]} AS {n}, {n} IS NULL AS m_{n}" + (f", {x[n]} <> {fill[n]} AS c_{n}" if clip else "") for n in _SOME])
    return f"WITH {features_sql()}, I AS (SELECT sample_id, {inner} FROM F) SELECT I.sample_id, {', '.join(out + flags)} FROM I"


def _scaled(spark, d, clip):
    f = features(spark, d)
    t = preprocess.transform(f, preprocess.fit(f, _SOME, clip=clip), ("sample_id",))
    return t.select("sample_id", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in t.columns[1:]])


@query("impute_scale", _scaled_sql(False))
def _(spark, d):
    return _scaled(spark, d, False)


@query("impute_clip_scale", _scaled_sql(True))
def _(spark, d):
    return _scaled(spark, d, True)


# ---- curves --------------------------------------------------------------------------------------

_CONFUSION = "count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 0 AND score < 0.5) AS tn, count(*) FILTER (label = 1 AND score < 0.5) AS fn"
RATES = ("precision", "recall", "specificity", "fpr", "fnr", "npv", "accuracy", "balanced_accuracy", "f1", "f2", "f05", "mcc", "prevalence", "alert_rate", "fp_per_million")


def _div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE 0.0 END"


def _fb(b2: str) -> str:
    return _div(f"(tp * (1 + {b2}::DOUBLE))", f"(tp * (1 + {b2}::DOUBLE) + fn * {b2}::DOUBLE + fp)")


RATES_SQL = {
    "precision": _div("tp", "tp + fp"),
    "recall": _div("tp", "tp + fn"),
    "specificity": _div("tn", "tn + fp"),
    "fpr": _div("fp", "fp + tn"),
    "fnr": _div("fn", "tp + fn"),
    "npv": _div("tn", "tn + fn"),
    "accuracy": _div("(tp + tn)", "(tp + fp + tn + fn)"),
    "balanced_accuracy": f"({_div('tp', 'tp + fn')} + {_div('tn', 'tn + fp')}) / 2",
    "f1": _fb("1.0"),
    "f2": _fb("4.0"),
    "f05": _fb("0.25"),
    "mcc": _div("(tp::DOUBLE * tn - fp::DOUBLE * fn)", "sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))"),
    "prevalence": _div("(tp + fn)", "(tp + fp + tn + fn)"),
    "alert_rate": _div("(tp + fp)", "(tp + fp + tn + fn)"),
    "fp_per_million": f"({_div('fp', 'fp + tn')}) * 1e6",
}
_RATES = ", ".join(f"round({x}, 6) AS {n}" for n, x in RATES_SQL.items())


def rounded(df, names=RATES, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("confusion", f"WITH {SCORES_SQL} SELECT {_CONFUSION} FROM S")
def _(spark, d):
    return curves.confusion(scores(spark, d), 0.5)


@query("metric_report", f"WITH {SCORES_SQL}, C AS (SELECT {_CONFUSION} FROM S) SELECT tp, fp, tn, fn, {_RATES} FROM C")
def _(spark, d):
    return rounded(curves.rates(curves.confusion(scores(spark, d), 0.5)))


_BY_SCORE = """B AS (SELECT score, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg FROM S GROUP BY score),
A AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS ap, coalesce(sum(neg) OVER w, 0) AS an, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM B WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("rank_metrics", f"WITH {SCORES_SQL}, {_BY_SCORE} SELECT max(p) AS n_pos, max(n) AS n_neg, round(sum(neg * (ap + pos / 2.0::DOUBLE)) / max(p * n), 8) AS roc_auc, round(sum(pos * (ap + pos) / (ap + pos + an + neg)) / max(p), 8) AS average_precision FROM A")
def _(spark, d):
    return rounded(curves.rank_metrics(scores(spark, d)), ("roc_auc", "average_precision"), 8)


@query("partial_auc", f"""WITH {SCORES_SQL}, {_BY_SCORE}, L(lim) AS (VALUES (0.001::DOUBLE), (0.1::DOUBLE)),
X AS (SELECT lim, an / n AS x0, (an + neg) / n AS x1, ap / p AS y0, (ap + pos) / p AS y1 FROM A, L),
Y AS (SELECT lim, sum(CASE WHEN x0 < lim THEN (least(x1, lim) - x0) * (y0 + CASE WHEN x1 > x0 THEN y0 + (y1 - y0) * (least(x1, lim) - x0) / (x1 - x0) ELSE y1 END) / 2 ELSE 0 END) AS area FROM X GROUP BY lim)
SELECT lim AS max_fpr, round((1 + (area - lim * lim / 2) / (lim - lim * lim / 2)) / 2, 8) AS partial_auc FROM Y""")
def _(spark, d):
    return rounded(curves.partial_auc(scores(spark, d), (0.001, 0.1)), ("partial_auc",), 8)


@query("ece_brier", f"WITH {SCORES_SQL}, B AS (SELECT least(floor(score * 15), 14) AS b, count(*) AS n, avg(score) AS p, avg(label) AS y, sum((score - label) * (score - label)) AS q FROM S GROUP BY 1) SELECT round(sum(n * abs(p - y)) / sum(n), 8) AS ece, round(sum(q) / sum(n), 8) AS brier, CAST(sum(n) AS BIGINT) AS n_rows FROM B")
def _(spark, d):
    return rounded(curves.calibration(scores(spark, d)), ("ece", "brier"), 8)


@query("reliability", f"""WITH {SCORES_SQL}, B AS (SELECT CAST(least(floor(score * 15), 14) AS INTEGER) AS bin, count(*) AS n, avg(score) AS p, avg(label) AS y FROM S GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, round(i / 15.0::DOUBLE, 8) AS low, round((i + 1) / 15.0::DOUBLE, 8) AS high, coalesce(n, 0) AS n_rows, round(p, 8) AS mean_score, round(y, 8) AS observed FROM range(15) t(i) LEFT JOIN B ON bin = i""")
def _(spark, d):
    return rounded(curves.reliability(scores(spark, d)), ("low", "high", "mean_score", "observed"), 8)


@query("reliability_nonempty", f"WITH {SCORES_SQL}, B AS (SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(score) AS p, avg(label) AS y FROM S GROUP BY 1) SELECT bin, n AS n_rows, round(p, 8) AS mean_score, round(y, 8) AS observed FROM B")
def _(spark, d):
    return rounded(curves.reliability(scores(spark, d), 10).where("n_rows > 0").drop("low", "high"), ("mean_score", "observed"), 8)


_POINTS = f"""{SCORES_SQL}, {_BY_SCORE}, C AS (SELECT least(score, 1 - pow(2.0::DOUBLE, -52)) AS threshold, CAST(ap + pos AS BIGINT) AS tp, CAST(an + neg AS BIGINT) AS fp, CAST(n - an - neg AS BIGINT) AS tn, CAST(p - ap - pos AS BIGINT) AS fn FROM A WHERE score > 0
  UNION ALL SELECT nextafter(max(score), 1.0::DOUBLE), 0, 0, CAST(max(n) AS BIGINT), CAST(max(p) AS BIGINT) FROM A HAVING max(score) < 1)"""


@query("threshold_sweep", f"WITH {_POINTS} SELECT round(threshold, 8) AS threshold, tp, fp, tn, fn FROM C")
def _(spark, d):
    return rounded(curves.candidates(scores(spark, d)), ("threshold",), 8)


def _policies_sql(policies) -> str:
    each = []
    for name, (objective, limit) in policies.items():
        if isinstance(objective, float):
            # the reference counts scores, not candidates
            each.append(f"(SELECT '{name}' AS policy, {objective}::DOUBLE AS threshold, {_CONFUSION.replace('0.5', str(objective))} FROM S)")
            continue
        where = f"WHERE {RATES_SQL['fpr']} <= {limit}::DOUBLE + 1e-15" if limit is not None else ""
        each.append(f"(SELECT '{name}' AS policy, round(threshold, 8) AS threshold, tp, fp, tn, fn FROM C {where} ORDER BY round({RATES_SQL[objective]}, 12) DESC, {RATES_SQL['fpr']}, {RATES_SQL['recall']} DESC, threshold DESC LIMIT 1)")
    return f"WITH {_POINTS} " + " UNION ALL ".join(each)


@query("threshold_policies", _policies_sql(curves.POLICIES))
def _(spark, d):
    return rounded(curves.best_thresholds(curves.candidates(scores(spark, d))), ("threshold",), 8)


@query("development_threshold", _policies_sql(curves.DEVELOPMENT))
def _(spark, d):
    return rounded(curves.best_thresholds(curves.candidates(scores(spark, d)), curves.DEVELOPMENT), ("threshold",), 8)


def _report_sql(source: str, by: str) -> str:
    """All of curves.report at 0.5 over rows (by, label, score) of a table expression."""
    w = f"(PARTITION BY {by} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    area = lambda lim, name: f"CASE WHEN p > 0 AND n > 0 THEN round((1 + (sum(CASE WHEN x0 < {lim} THEN (least(x1, {lim}) - x0) * (y0 + CASE WHEN x1 > x0 THEN y0 + (y1 - y0) * (least(x1, {lim}) - x0) / (x1 - x0) ELSE y1 END) / 2 ELSE 0 END) - {lim} * {lim} / 2) / ({lim} - {lim} * {lim} / 2)) / 2, 8) END AS {name}"
    return f"""R0 AS ({source}), RC AS (SELECT {by}, {_CONFUSION} FROM R0 GROUP BY {by}),
RB AS (SELECT {by}, least(floor(score * 15), 14) AS bin, count(*) AS n, avg(score) AS p, avg(label) AS y, sum((score - label) * (score - label)) AS q FROM R0 GROUP BY ALL),
RF AS (SELECT {by}, round(sum(n * abs(p - y)) / sum(n), 8) AS ece, round(sum(q) / sum(n), 8) AS brier FROM RB GROUP BY {by}),
RD AS (SELECT {by}, score, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg FROM R0 GROUP BY {by}, score),
RA AS (SELECT *, coalesce(sum(pos) OVER {w}, 0) AS ap, coalesce(sum(neg) OVER {w}, 0) AS an, sum(pos) OVER (PARTITION BY {by}) AS p, sum(neg) OVER (PARTITION BY {by}) AS n FROM RD),
RX AS (SELECT *, an / nullif(n, 0) AS x0, (an + neg) / nullif(n, 0) AS x1, ap / nullif(p, 0) AS y0, (ap + pos) / nullif(p, 0) AS y1 FROM RA),
RK AS (SELECT {by}, CASE WHEN p > 0 AND n > 0 THEN round(sum(neg * (ap + pos / 2.0::DOUBLE)) / (p * n), 8) END AS roc_auc,
  CASE WHEN p > 0 AND n > 0 THEN round(sum(pos * (ap + pos) / (ap + pos + an + neg)) / p, 8) END AS average_precision, {area('0.001::DOUBLE', 'partial_auc_0_001')}, {area('0.0001::DOUBLE', 'partial_auc_0_0001')} FROM RX GROUP BY {by}, p, n)
SELECT {by}, 0.5::DOUBLE AS threshold, tp, fp, tn, fn, tp + fp + tn + fn AS n_rows, {_RATES}, ece, brier, roc_auc, average_precision, partial_auc_0_001, partial_auc_0_0001
FROM RC JOIN RF USING ({by}) JOIN RK USING ({by})"""


_REPORT = ("ece", "brier", "roc_auc", "average_precision", "partial_auc_0_001", "partial_auc_0_0001")


@query("full_report", f"WITH {SCORES_SQL}, {_report_sql('SELECT user_id % 7 AS part, label, score FROM S', 'part')}")
def _(spark, d):
    x = scores(spark, d).withColumn("part", F.col("user_id") % 7)
    return rounded(rounded(curves.report(x, 0.5, ("part",))), _REPORT, 8)


@query("policy_by_source", f"WITH {SCORES_SQL}, Q(policy, t) AS (VALUES ('low', 0.2::DOUBLE), ('mid', 0.5::DOUBLE), ('high', 0.8::DOUBLE)) SELECT policy, event_type, count(*) FILTER (score >= t) AS n_alerts, count(*) AS n_rows FROM S, Q GROUP BY 1, 2")
def _(spark, d):
    policies = spark.createDataFrame([("low", 0.2), ("mid", 0.5), ("high", 0.8)], "policy string, t double")
    both = scores(spark, d).crossJoin(F.broadcast(policies))
    return both.groupBy("policy", "event_type").agg(F.count_if(F.col("score") >= F.col("t")).alias("n_alerts"), F.count(F.lit(1)).alias("n_rows"))


# ---- subgroups, drift, correlation ---------------------------------------------------------------


@query("subgroup_metrics", f"""WITH {SCORES_SQL}, L AS (SELECT label, score, 'half' AS group_type, CASE WHEN day(ts) <= 15 THEN 'first' ELSE 'second' END AS subgroup FROM S
  UNION ALL SELECT label, score, 'size', CASE WHEN value <= 50 THEN 'none' WHEN value <= 150 THEN 'one' WHEN value <= 300 THEN 'two_to_five' ELSE 'six_or_more' END FROM S),
C AS (SELECT group_type, subgroup, {_CONFUSION} FROM L GROUP BY 1, 2) SELECT group_type, subgroup, tp, fp, tn, fn, tp + fp + tn + fn AS n_rows, {_RATES} FROM C WHERE tp + fp + tn + fn >= 100""")
def _(spark, d):
    groups = {"half": F.when(F.dayofmonth("ts") <= 15, "first").otherwise("second"), "size": monitor.right_closed(F.col("value"), (50, 150, 300), ("none", "one", "two_to_five", "six_or_more"))}
    return rounded(monitor.subgroup_metrics(scores(spark, d), groups, 0.5))


_ACTIVE_SUM = " + ".join(f"coalesce({c}, 0)" for c in monitor.ACTIVE)
_DECLARED = f"""{features_sql()}, X AS (SELECT *, "Class" AS label, least(pdf_size / 2000.0::DOUBLE, 1) AS score, {' + '.join(f'CAST({n} IS NULL AS INTEGER)' for n in BASE_NAMES)} AS missing_feature_count,
  row_number() OVER (ORDER BY first_seen_at, sample_id) AS rt, row_number() OVER (ORDER BY pdf_size, sample_id) AS rs, count(*) OVER () AS k FROM F),
L AS (SELECT label, score, unnest([{{'t': 'source', 'g': source_id}}, {{'t': 'time_window', 'g': 'time_' || lpad(CAST(greatest(1, CAST(ceil((rt - 1) * 5 / (k - 1)::DOUBLE) AS INTEGER)) AS VARCHAR), 2, '0')}},
  {{'t': 'file_size_decile', 'g': 'size_' || lpad(CAST(greatest(1, CAST(ceil((rs - 1) * 10 / (k - 1)::DOUBLE) AS INTEGER)) AS VARCHAR), 2, '0')}},
  {{'t': 'encryption', 'g': CASE WHEN is_encrypted IS NULL THEN 'unavailable' WHEN is_encrypted = 0 THEN 'not_encrypted' WHEN is_encrypted = 1 THEN 'encrypted' ELSE 'invalid' END}},
  {{'t': 'active_content', 'g': CASE WHEN {_ACTIVE_SUM} > 0 THEN 'present' ELSE 'absent' END}},
  {{'t': 'obfuscation_level', 'g': CASE WHEN obfuscation_count IS NULL THEN 'nan' WHEN obfuscation_count <= 0 THEN 'none' WHEN obfuscation_count <= 1 THEN 'one' WHEN obfuscation_count <= 5 THEN 'two_to_five' ELSE 'six_or_more' END}},
  {{'t': 'missingness_pattern', 'g': CASE WHEN missing_feature_count <= 0 THEN 'none' WHEN missing_feature_count <= 1 THEN 'one' ELSE 'two_or_more' END}}]) AS x FROM X),
C AS (SELECT x.t AS group_type, x.g AS subgroup, {_CONFUSION} FROM L GROUP BY 1, 2)"""


@query("declared_subgroups", f"WITH {_DECLARED} SELECT group_type, subgroup, tp, fp, tn, fn, tp + fp + tn + fn AS n_rows, {_RATES} FROM C WHERE tp + fp + tn + fn >= 100")
def _(spark, d):
    f = features(spark, d)
    f = f.withColumns({"label": F.col("Class"), "score": F.least(F.col("pdf_size") / F.lit(2000.0), F.lit(1.0)), "missing_feature_count": sum((F.col(n).isNull().cast("int") for n in BASE_NAMES), F.lit(0))})
    f, groups = monitor.declared_subgroups(f, "sample_id")
    return rounded(monitor.subgroup_metrics(f, groups, 0.5))


@query("qcut_labels", f"WITH {SCORES_SQL} SELECT event_id, CAST(greatest(1, ceil((rn - 1) * 10 / (n - 1)::DOUBLE)) AS INTEGER) AS decile FROM (SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS rn, count(*) OVER () AS n FROM S)")
def _(spark, d):
    return monitor.quantile_labels(scores(spark, d), "value", ("event_id",), 10, "decile").select("event_id", "decile")


def _drift_sql(columns: tuple[str, ...]) -> str:
    each = []
    for c in columns:
        each.append(f"""SELECT '{c}' AS feature, round(sum((q - p) * ln(q / p)), 6) AS psi, round(0.5 * sum(p * ln(p / m)) + 0.5 * sum(q * ln(q / m)), 6) AS js FROM (
  SELECT p, q, (p + q) / 2 AS m FROM (SELECT least(greatest(r / sum(r) OVER (), 1e-8), 1.0) AS p, least(greatest(c / sum(c) OVER (), 1e-8), 1.0) AS q FROM (
    SELECT coalesce(r, 0)::DOUBLE AS r, coalesce(c, 0)::DOUBLE AS c FROM range(0, (SELECT len(e) - 1 FROM E_{c})) t(i) LEFT JOIN (
      SELECT len(list_filter(list_slice(e, 2, -2), lambda z: z <= x)) AS b, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM (SELECT {c} AS x, ref FROM R), E_{c} GROUP BY 1) ON b = i)))""")
    edges = ", ".join(f"E_{c} AS (SELECT list_sort(list_distinct(quantile_cont({c}, [{', '.join(str(i / 10) for i in range(11))}]))) AS e FROM R WHERE ref)" for c in columns)
    return f"WITH R AS (SELECT l_quantity, l_extendedprice, l_tax, l_shipdate < TIMESTAMP '1997-01-01' AS ref FROM lineitem), {edges} " + " UNION ALL ".join(each)


@query("psi_js", _drift_sql(("l_quantity", "l_extendedprice", "l_tax")))
def _(spark, d):
    x = table(spark, d, "lineitem")
    return rounded(monitor.drift(x, F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"), ("l_quantity", "l_extendedprice", "l_tax")), ("psi", "js"))


_PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]


@query("pearson_pairs", "WITH C AS (SELECT * FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS left, '{b}' AS right, round(corr({a}, {b}), 8) AS correlation FROM C" for a, b in _PAIRS))
def _(spark, d):
    return rounded(monitor.pairs(table(spark, d, "lineitem"), NUMBERS), ("correlation",), 8)


@query("spearman_pairs", "WITH C AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2.0::DOUBLE AS {n}" for n in NUMBERS) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS left, '{b}' AS right, round(corr({a}, {b}), 8) AS correlation FROM C" for a, b in _PAIRS))
def _(spark, d):
    return rounded(monitor.spearman(table(spark, d, "lineitem"), NUMBERS), ("correlation",), 8)


@query("class_distributions", "SELECT o_orderstatus, count(*) AS n_rows, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 8) AS percent FROM orders GROUP BY 1")
def _(spark, d):
    return rounded(monitor.class_shares(table(spark, d, "orders"), "o_orderstatus"), ("percent",), 8)


@query("histogram", "WITH P AS (SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1) SELECT o_orderstatus, CAST(CASE WHEN hi > lo THEN least(floor((o_totalprice - lo) / ((hi - lo) / 40)), 39) ELSE 0 END AS INTEGER) AS bin, count(*) AS n_rows FROM orders JOIN P USING (o_orderstatus) GROUP BY 1, 2")
def _(spark, d):
    return monitor.histogram(table(spark, d, "orders"), "o_totalprice", "o_orderstatus")


@query("boxplot", "SELECT o_orderstatus, min(o_totalprice) AS low, round(quantile_cont(o_totalprice, 0.25), 6) AS q1, round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.75), 6) AS q3, max(o_totalprice) AS high FROM orders GROUP BY 1")
def _(spark, d):
    return rounded(monitor.quartiles(table(spark, d, "orders"), "o_totalprice", "o_orderstatus"), ("q1", "median", "q3"))


@query("class_statistics", "WITH C AS (SELECT l_returnflag, unnest(['l_quantity', 'l_tax']) AS feature, unnest([l_quantity, l_tax]) AS value FROM lineitem) SELECT l_returnflag, feature, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95 FROM C GROUP BY 1, 2")
def _(spark, d):
    return rounded(monitor.class_statistics(table(spark, d, "lineitem"), ("l_quantity", "l_tax"), "l_returnflag"), ("mean", "std", "q05", "q50", "q95"))


@query("nonzero_rates", "SELECT l_returnflag, 'l_discount' AS field, round(avg(CAST(l_discount <> 0 AS DOUBLE)), 8) AS rate FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'l_tax', round(avg(CAST(l_tax <> 0 AS DOUBLE)), 8) FROM lineitem GROUP BY 1")
def _(spark, d):
    return rounded(monitor.nonzero_rates(table(spark, d, "lineitem"), ("l_discount", "l_tax"), "l_returnflag"), ("rate",), 8)


@query("discretized_mi", f"""WITH E AS (SELECT list_distinct(quantile_cont(l_extendedprice, [{', '.join(str(i / 10) for i in range(1, 10))}])) AS e FROM lineitem),
N AS (SELECT len(list_filter(e, lambda z: z < l_extendedprice)) AS b, l_returnflag AS y, count(*)::DOUBLE AS n FROM lineitem, E GROUP BY 1, 2),
M AS (SELECT n, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM N) SELECT round(sum(n / t * ln(n * t / (nb * ny))), 8) AS information FROM M""")
def _(spark, d):
    return rounded(monitor.mutual_information(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag"), ("information",), 8)


@query("benign_baseline", f"WITH {T} " + " UNION ALL ".join(f"SELECT '{n}' AS feature, round(avg({n}), 6) AS mean, round(stddev_pop({n}), 6) AS std FROM T WHERE label = 0" for n in NUMBERS))
def _(spark, d):
    return rounded(monitor.baseline(telemetry(spark, d), NUMBERS, "label"), ("mean", "std"))


_TWO = ("l_quantity", "l_extendedprice")


@query("baseline_z", f"""WITH {T}, B AS ({' UNION ALL '.join(f"SELECT '{n}' AS feature, avg({n}) AS mean, stddev_pop({n}) AS std FROM T WHERE label = 0" for n in _TWO)}),
L AS ({' UNION ALL '.join(f"SELECT sample_id, '{n}' AS feature, {n} AS value FROM T" for n in _TWO)})
SELECT feature, count(*) AS n_rows, round(max(abs((value - mean) / std)), 6) AS largest FROM L JOIN B USING (feature) WHERE abs((value - mean) / std) > 2 GROUP BY feature""")
def _(spark, d):
    t = telemetry(spark, d)
    z = evidence.deviations(t, monitor.baseline(t, _TWO, "label"), "sample_id", _TWO)
    return z.groupBy("feature").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.max(F.abs("z")), 6).alias("largest"))


@query("severity_ladder", f"""WITH {features_sql()}, N AS (SELECT sample_id, {' + '.join(f'CAST(coalesce({n}, 0) > 0 AS INTEGER)' for n in ('js_count', 'launch_count', 'embedded_file_count'))} AS risky, {' + '.join(f'CAST(coalesce({n}, 0) > 4 AS INTEGER)' for n in BASE_NAMES[:12])} AS n FROM F)
SELECT sample_id, CASE WHEN risky >= 3 OR n >= 8 THEN 'Critical' WHEN risky >= 2 OR n >= 5 THEN 'High' WHEN risky >= 1 OR n >= 3 THEN 'Medium' ELSE 'Low' END AS severity FROM N""")
def _(spark, d):
    f = features(spark, d)
    risky = sum((F.coalesce(F.col(n) > 0, F.lit(False)).cast("int") for n in ("js_count", "launch_count", "embedded_file_count")), F.lit(0))
    every = sum((F.coalesce(F.col(n) > 4, F.lit(False)).cast("int") for n in BASE_NAMES[:12]), F.lit(0))
    return f.select("sample_id", evidence.severity(risky, every).alias("severity"))


@query("robust_reference", "WITH M AS (SELECT quantile_cont(l_quantity, 0.5) AS a, quantile_cont(l_extendedprice, 0.5) AS b FROM lineitem) SELECT 'l_quantity' AS feature, round(any_value(a), 6) AS median, round(quantile_cont(abs(l_quantity - a), 0.5), 6) AS mad FROM lineitem, M UNION ALL SELECT 'l_extendedprice', round(any_value(b), 6), round(quantile_cont(abs(l_extendedprice - b), 0.5), 6) FROM lineitem, M")
def _(spark, d):
    return rounded(monitor.robust_reference(table(spark, d, "lineitem"), _TWO), ("median", "mad"))


# ---- selections ----------------------------------------------------------------------------------


@query("stratified_reference", f"""WITH {SCORES_SQL}, X AS (SELECT *, sha256(concat('7:', event_id)) AS digest, count(*) OVER (PARTITION BY label, event_type) AS k, count(*) OVER () AS n FROM S),
Y AS (SELECT *, row_number() OVER (PARTITION BY label, event_type ORDER BY digest, event_id) AS rn, greatest(1, round_even(k * 200.0::DOUBLE / n, 0)) AS quota FROM X)
SELECT event_id, label, event_type FROM Y ORDER BY CASE WHEN rn <= quota THEN 0 ELSE 1 END, digest, event_id LIMIT 200""")
def _(spark, d):
    return evidence.stratified(scores(spark, d).select("event_id", "label", "event_type"), "event_id", ("label", "event_type"), 200, "7")


_OUTCOME = "CASE WHEN label = 1 THEN CASE WHEN score >= 0.5 THEN 'TP' ELSE 'FN' END ELSE CASE WHEN score >= 0.5 THEN 'FP' ELSE 'TN' END END"


@query("outcomes", f"WITH {SCORES_SQL} SELECT event_id, {_OUTCOME} AS outcome FROM S")
def _(spark, d):
    return scores(spark, d).select("event_id", evidence.outcome(0.5).alias("outcome"))


@query("handoff", f"""WITH {SCORES_SQL}, X AS (SELECT *, {_OUTCOME} AS outcome, sha256(concat('9:', event_id)) AS digest FROM S),
Y AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY outcome ORDER BY digest, event_id) <= 10 THEN 0 ELSE 1 END AS rest FROM X)
SELECT event_id, label, score, outcome FROM Y ORDER BY rest, CASE WHEN rest = 1 THEN round(abs(score - 0.5), 12) END NULLS FIRST, digest, event_id LIMIT 64""")
def _(spark, d):
    return evidence.handoff(scores(spark, d), "event_id", 0.5, 10, 64, "9")


@query("hard_errors", f"""WITH {SCORES_SQL}, X AS (SELECT *, {_OUTCOME} AS error_type FROM S),
Y AS (SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY CASE WHEN error_type = 'FP' THEN -score ELSE score END, event_id) AS rank FROM X WHERE error_type IN ('FP', 'FN'))
SELECT error_type, CAST(rank AS INTEGER) AS rank, sha256(concat('e:', event_id)) AS sample_hash, score FROM Y WHERE rank <= 50""")
def _(spark, d):
    return evidence.hard_errors(scores(spark, d), "event_id", 0.5, 50, "e")


_CASES = [("o = 'TP'", "score"), ("o = 'TN'", "score"), ("o = 'FP'", "score DESC"), ("o = 'FN'", "score"), ("gap >= far", "score DESC"), ("gap <= near", "score"), ("abstained", "score")]


@query("local_cases", f"""WITH {SCORES_SQL}, X AS (SELECT *, {_OUTCOME} AS o, round(abs(score - 0.5), 12) AS gap, value < 1 AS abstained FROM S),
E AS (SELECT round(quantile_cont(gap, 0.1), 12) AS near, round(quantile_cont(gap, 0.9), 12) AS far FROM X) SELECT DISTINCT event_id FROM (""" + " UNION ALL ".join(f"(SELECT event_id FROM X, E WHERE {w} ORDER BY {o}, event_id LIMIT 5)" for w, o in _CASES) + ")")
def _(spark, d):
    return evidence.local_cases(scores(spark, d).withColumn("abstained", F.col("value") < 1), "event_id", 0.5, 5, "abstained")


@query("worst_case", f"WITH {SCORES_SQL}, Y AS (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY CASE WHEN label = 1 THEN score ELSE -score END, event_id) AS rn FROM S) SELECT user_id, label, event_id, score FROM Y WHERE rn = 1")
def _(spark, d):
    return evidence.worst_case(scores(spark, d), "user_id", "label", "score", "event_id")


@query("nearest_prototype")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    centres = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centres = centres.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))
    return evidence.nearest_prototype(e, centres, "vec_id", "label", "embedding")


SQL["nearest_prototype"] = """WITH L AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i, vec_id FROM embeddings),
P AS (SELECT label AS prototype, i, avg(x) AS m FROM L GROUP BY 1, 2), D AS (SELECT vec_id, prototype, sum((x - m) * (x - m)) AS distance FROM L JOIN P USING (i) GROUP BY 1, 2)
SELECT vec_id, prototype, round(distance, 6) AS distance FROM D QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, prototype) = 1"""
QUERIES["nearest_prototype"] = lambda spark, d, f=QUERIES["nearest_prototype"]: rounded(f(spark, d), ("distance",))


_BOARD = f"""{SCORES_SQL}, K AS (SELECT event_type, {_CONFUSION.replace('label = 1', 'user_id % 2 = 1').replace('label = 0', 'user_id % 2 = 0').replace('0.5', '0.3')}, avg((score - user_id % 2) * (score - user_id % 2)) AS brier, avg(value) / 50 AS latency FROM S GROUP BY 1),
B AS (SELECT event_type AS bundle_key, CASE event_type WHEN 'click' THEN 'neural' WHEN 'error' THEN 'neural' WHEN 'purchase' THEN 'tree' WHEN 'signup' THEN 'tree' ELSE 'dummy' END AS model_family,
  round({_fb('4.0')}, 9) AS validation_f2, round({_div('fp', 'fp + tn')}, 9) AS validation_fpr, round(brier, 9) AS validation_brier, round({_div('tp', 'tp + fp')}, 9) AS validation_precision, round(latency, 9) AS latency_ms FROM K)"""


def _champion_sql(lower: float) -> str:
    return f"""WITH {_BOARD}, O AS (SELECT * FROM B WHERE model_family <> 'dummy' AND validation_fpr <= 0.9),
P AS (SELECT * FROM O ORDER BY validation_f2 DESC, validation_fpr, validation_brier, validation_precision DESC, bundle_key LIMIT 1), T AS (SELECT * FROM O WHERE model_family = 'tree' ORDER BY validation_f2 DESC, bundle_key LIMIT 1),
J AS (SELECT P.*, T.bundle_key AS tree_key, P.model_family = 'neural' AND ({lower}::DOUBLE <= 0 OR P.validation_brier > T.validation_brier + 0.005 OR P.latency_ms > greatest(5 * T.latency_ms, T.latency_ms + 5)) AS back FROM P, T)
SELECT CASE WHEN back THEN tree_key ELSE bundle_key END AS bundle_key, bundle_key AS point_best, model_family AS point_family,
  CASE WHEN back THEN 'best tree: the neural winner misses a condition' WHEN model_family = 'neural' THEN 'neural winner supported by the paired interval' ELSE 'highest F2 within the FPR limit' END AS rationale FROM J"""


def _board(spark, d):
    s = scores(spark, d).withColumn("label", (F.col("user_id") % 2).cast("int"))
    x = curves.rates(curves.confusion(s, 0.3, ("event_type",))).join(s.groupBy("event_type").agg(F.avg((F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))).alias("brier"), (F.avg("value") / 50).alias("latency")), "event_type")
    kind = F.when(F.col("event_type").isin("click", "error"), "neural").when(F.col("event_type").isin("purchase", "signup"), "tree").otherwise("dummy")
    return x.select(F.col("event_type").alias("bundle_key"), kind.alias("model_family"), *[F.round(a, 9).alias(b) for a, b in (("f2", "validation_f2"), ("fpr", "validation_fpr"), ("brier", "validation_brier"), ("precision", "validation_precision"), ("latency", "latency_ms"))])


@query("champion", _champion_sql(0.01))
def _(spark, d):
    return evidence.champion(_board(spark, d), 0.01, 0.9)


@query("champion_without_evidence", _champion_sql(-0.01))
def _(spark, d):
    return evidence.champion(_board(spark, d), -0.01, 0.9)


@query("recent_first", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 50")
def _(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "user_id")


# ---- evidence and decisions ----------------------------------------------------------------------

_INDICATORS = {"javascript_actions": "js_count", "launch_action": "launch_count", "embedded_files": "embedded_file_count", "encryption": "is_encrypted"}


@query("indicators", f"WITH {features_sql()} " + " UNION ALL ".join(f"SELECT sample_id, '{k}' AS indicator, '{c}' AS feature, {c} AS observed_value FROM F WHERE {c} > 0" for k, c in _INDICATORS.items()))
def _(spark, d):
    f = features(spark, d).select("sample_id", F.inline(evidence.indicators(_INDICATORS)))
    return f.select("sample_id", "indicator", "feature", "observed_value")


@query("feature_breakdown", f"WITH {features_sql()}, L AS ({' UNION ALL '.join(f'SELECT sample_id, ' + repr(n) + f' AS feature, {n} AS value FROM F' for n in BASE_NAMES[:10])}) SELECT sample_id, feature, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY abs(value) DESC, feature) AS rank FROM L WHERE value <> 0) WHERE rank <= 3")
def _(spark, d):
    return evidence.breakdown(features(spark, d), "sample_id", BASE_NAMES[:10], 3)


def _scored_features(spark, d):
    f = features(spark, d)
    return f.withColumn("score", F.coalesce(F.col("pdf_size"), F.lit(0.0)) / F.lit(2000.0))


@query("three_way_decision", f"""WITH {features_sql()}, X AS (SELECT sample_id, pdf_size / 2000.0::DOUBLE AS score, obj_count IS NULL AS unhealthy,
  (CAST(coalesce(abs(obj_count - 2) / 0.14826 > 8, false) AS DOUBLE) + CAST(coalesce(abs(page_count - 3) / 1.4826 > 8, false) AS DOUBLE)) / 2 AS ood FROM F),
Y AS (SELECT *, CASE WHEN unhealthy THEN 'parser_health_gate' ELSE concat_ws(';', CASE WHEN ood > 0.1 THEN 'out_of_distribution_feature_profile' END, CASE WHEN round(abs(score - 0.5), 12) <= 0.02 THEN 'probability_within_abstention_margin' END) END AS reasons FROM X)
SELECT sample_id, CASE WHEN reasons <> '' THEN 'uncertain/abstain' WHEN score >= 0.5 THEN 'malicious' ELSE 'benign' END AS outcome, reasons FROM Y""")
def _(spark, d):
    x = _scored_features(spark, d).na.fill(2.0, ["page_count"]).withColumn("page_count", F.coalesce("page_count", F.lit(3.0)))
    healthy = x.withColumn("o", F.coalesce("obj_count", F.lit(2.0)))
    ood = evidence.ood_share(("o", "page_count"), {"o": (2.0, 0.1), "page_count": (3.0, 1.0)})
    return healthy.select("sample_id", evidence.decide(F.col("score"), 0.5, ood, F.col("obj_count").isNull()).alias("x")).select("sample_id", "x.outcome", "x.reasons")


@query("ood_fraction", f"WITH {features_sql()} SELECT sample_id, (CAST(abs(coalesce(obj_count, 2) - 2) / 0.14826 > 8 AS DOUBLE) + CAST(abs(pdf_size - 800) / 148.26 > 8 AS DOUBLE)) / 2 AS ood FROM F")
def _(spark, d):
    x = features(spark, d).withColumn("o", F.coalesce("obj_count", F.lit(2.0)))
    return x.select("sample_id", evidence.ood_share(("o", "pdf_size"), {"o": (2.0, 0.1), "pdf_size": (800.0, 100.0)}).alias("ood"))


_MUTATED = f"""{SCORES_SQL}, M AS (SELECT user_id AS fixture, CAST(user_id % 3 = 0 AS INTEGER) AS label, CASE WHEN event_type = 'click' THEN 'none' ELSE event_type END AS mutation,
  round(avg(score), 9) AS score, min(value) < 20 AS abstained, round(avg(value), 9) AS latency_ms, CAST(count(*) AS BIGINT) * 1000 AS rss_bytes FROM S GROUP BY 1, 2, 3)"""


@query("robustness_by_mutation", f"""WITH {_MUTATED}, J AS (SELECT m.*, c.score AS clean FROM M m LEFT JOIN M c ON c.mutation = 'none' AND c.fixture = m.fixture AND c.label = m.label WHERE m.mutation <> 'none'),
G AS (SELECT mutation, count(*) AS n_fixtures, coalesce(avg(CAST(coalesce(clean >= 0.5 AND score < 0.5 AND NOT abstained, false) AS DOUBLE)) FILTER (label = 1), 0) AS attack_success_rate,
  coalesce(avg(clean - score) FILTER (label = 1), 0) AS mean_drop, coalesce(max(clean - score) FILTER (label = 1), 0) AS max_drop,
  coalesce(avg(CAST(coalesce(clean >= 0.5, false) AS DOUBLE)) FILTER (label = 0), 0) AS clean_fpr, coalesce(avg(CAST(score >= 0.5 AS DOUBLE)) FILTER (label = 0), 0) AS mutated_fpr,
  avg(CAST(abstained AS DOUBLE)) AS abstention_rate, avg(latency_ms) AS mean_latency_ms, quantile_cont(latency_ms, 0.95) AS p95_latency_ms, max(rss_bytes) AS max_rss_bytes FROM J GROUP BY 1)
SELECT mutation, n_fixtures, round(attack_success_rate, 6) AS attack_success_rate, round(mean_drop, 6) AS mean_drop, round(max_drop, 6) AS max_drop, round(clean_fpr, 6) AS clean_fpr, round(mutated_fpr, 6) AS mutated_fpr,
  round(mutated_fpr - clean_fpr, 6) AS fpr_increase, round(abstention_rate, 6) AS abstention_rate, round(mean_latency_ms, 6) AS mean_latency_ms, round(p95_latency_ms, 6) AS p95_latency_ms, max_rss_bytes FROM G""")
def _(spark, d):
    mutation = F.when(F.col("event_type") == "click", "none").otherwise(F.col("event_type"))
    m = scores(spark, d).groupBy(F.col("user_id").alias("fixture"), (F.col("user_id") % 3 == 0).cast("int").alias("label"), mutation.alias("mutation")).agg(
        F.round(F.avg("score"), 9).alias("score"), (F.min("value") < 20).alias("abstained"), F.round(F.avg("value"), 9).alias("latency_ms"), (F.count(F.lit(1)) * 1000).alias("rss_bytes"))
    return rounded(evidence.robustness(m, 0.5), ("attack_success_rate", "mean_drop", "max_drop", "clean_fpr", "mutated_fpr", "fpr_increase", "abstention_rate", "mean_latency_ms", "p95_latency_ms"))


@query("defense_views", f"WITH {SCORES_SQL}, L AS (SELECT event_type, label, 'raw' AS variant, score FROM S UNION ALL SELECT event_type, label, 'squared', score * score FROM S) SELECT event_type, variant, {_CONFUSION.replace('0.5', '0.25')} FROM L GROUP BY 1, 2")
def _(spark, d):
    s = scores(spark, d).select("event_type", "label", F.explode(F.array(F.struct(F.lit("raw").alias("variant"), "score"), F.struct(F.lit("squared").alias("variant"), (F.col("score") * F.col("score")).alias("score")))).alias("x"))
    return curves.confusion(s.select("event_type", "label", "x.variant", "x.score"), 0.25, ("event_type", "variant"))


@query("resource_overhead", "SELECT l_returnflag, round(avg(l_extendedprice), 6) AS mean, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, max(l_extendedprice) AS high FROM lineitem GROUP BY 1")
def _(spark, d):
    x = table(spark, d, "lineitem")
    late = quantiles(x, "l_extendedprice", (0.95,), ("l_returnflag",)).select("l_returnflag", F.col("quantiles")[0].alias("p95"))
    return rounded(x.groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("mean"), F.max("l_extendedprice").alias("high")).join(late, "l_returnflag"), ("mean", "p95"))


@query("latency_profile", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS low, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS high, round(avg(value) / (SELECT avg(value) FROM events WHERE event_type = 'error') - 1, 6) AS relative FROM events GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events")
    x = e.groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))
    x = x.join(quantiles(e, "value", (0.5, 0.95), ("event_type",), "q").select("event_type", F.col("q")[0].alias("median"), F.col("q")[1].alias("p95")), "event_type")
    base = x.where("event_type = 'error'").select(F.col("mean").alias("b"))
    x = x.crossJoin(F.broadcast(base)).withColumn("relative", F.col("mean") / F.col("b") - 1).drop("b")
    return rounded(x, ("mean", "std", "median", "p95", "relative"))


def _importance(spark, d):
    """Mean size of each kind of event, by weekday, as importances of features by method."""
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").cast("string").alias("feature"), F.col("event_type").alias("method")).agg(F.round(F.avg("value"), 6).alias("importance"))


_IMPORTANCE = "I AS (SELECT CAST(user_id AS VARCHAR) AS feature, event_type AS method, round(avg(value), 6) AS importance FROM events GROUP BY 1, 2)"
_METHODS = ("click", "error")


@query("mean_importance", f"WITH {_IMPORTANCE}, M AS (SELECT feature, round(avg(importance), 5) AS importance FROM I GROUP BY 1) SELECT feature, importance FROM M ORDER BY importance DESC, feature LIMIT 20")
def _(spark, d):
    return _importance(spark, d).groupBy("feature").agg(F.round(F.avg("importance"), 5).alias("importance")).orderBy(F.desc("importance"), "feature").limit(20)


@query("method_agreement_pivot", f"""WITH {_IMPORTANCE}, W AS (SELECT feature, coalesce(avg(importance) FILTER (method = 'click'), 0) AS a, coalesce(avg(importance) FILTER (method = 'error'), 0) AS b FROM I GROUP BY 1),
R AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM W)
SELECT 'click' AS left, 'error' AS right, round(corr(ra, rb), 8) AS correlation FROM R""")
def _(spark, d):
    return rounded(evidence.agreement(_importance(spark, d), methods=_METHODS), ("correlation",), 8)


@query("rank_support", f"WITH {_IMPORTANCE}, R AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY importance DESC) AS r FROM I) SELECT feature, count(*) FILTER (r <= 10) AS n_methods, round(avg(r), 6) AS mean_rank FROM R GROUP BY 1")
def _(spark, d):
    return rounded(evidence.supported(_importance(spark, d), 10), ("mean_rank",))


@query("feature_family", "SELECT * FROM (SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%1%' OR lower(p_name) LIKE '%2%' THEN 'low' WHEN lower(p_name) LIKE '%3%' THEN 'mid' ELSE 'other' END AS family FROM part)")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", evidence.family(F.col("p_name"), (("low", ("1", "2")), ("mid", ("3",)))).alias("family"))


@query("one_hot_month", "SELECT o_orderstatus, " + ", ".join(f"count(*) FILTER (month(o_orderdate) = {m}) AS m{m:02d}" for m in range(1, 13)) + " FROM orders GROUP BY 1")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("m", F.date_format("o_orderdate", "'m'MM"))
    return o.groupBy("o_orderstatus").pivot("m", [f"m{m:02d}" for m in range(1, 13)]).count().na.fill(0)


@query("month_text", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))


@query("logit_clip", f"WITH {SCORES_SQL}, P AS (SELECT event_id, least(greatest(score, 1e-7), 1 - 1e-7) AS p FROM S) SELECT event_id, round(ln(p / (1 - p)), 6) AS logit FROM P")
def _(spark, d):
    p = F.least(F.greatest(F.col("score"), F.lit(1e-7)), F.lit(1 - 1e-7))
    return scores(spark, d).select("event_id", F.round(F.log(p / (1 - p)), 6).alias("logit"))


@query("row_fingerprint_groups", "SELECT n_copies, count(*) AS n_fingerprints FROM (SELECT count(*) AS n_copies FROM lineitem GROUP BY l_quantity, l_discount, l_tax, l_returnflag) GROUP BY 1")
def _(spark, d):
    x = table(spark, d, "lineitem").select(F.xxhash64("l_quantity", "l_discount", "l_tax", "l_returnflag").alias("f"))
    return x.groupBy("f").agg(F.count(F.lit(1)).alias("n_copies")).groupBy("n_copies").agg(F.count(F.lit(1)).alias("n_fingerprints"))


@query("train_percentile", f"WITH {SCORES_SQL} SELECT event_id, round(cume_dist() OVER (ORDER BY value), 8) AS percentile FROM S")
def _(spark, d):
    s = scores(spark, d)
    c = curves.by_score(s.select((F.col("value") / 1000.0).alias("score"), F.lit(1).alias("label")))
    total = c.agg(F.sum("pos").alias("n"))
    share = c.crossJoin(F.broadcast(total)).select(F.col("score").alias("k"), (1 - F.col("above_pos") / F.col("n")).alias("percentile"))
    return s.join(share, F.col("value") / 1000.0 == F.col("k")).select("event_id", F.round("percentile", 8).alias("percentile"))


@query("shortcut_auc", f"""WITH {T}, B AS (SELECT l_extendedprice AS score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM T GROUP BY 1),
A AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS ap, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM B WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
R AS (SELECT sum(neg * (ap + pos / 2.0::DOUBLE)) / max(p * n) AS auc FROM A) SELECT round(greatest(auc, 1 - auc), 8) AS auc, CASE WHEN auc >= 0.5 THEN 'increasing' ELSE 'decreasing' END AS direction, greatest(auc, 1 - auc) >= 0.9 AS high_risk FROM R""")
def _(spark, d):
    t = telemetry(spark, d).select("label", (F.col("l_extendedprice") / 1e6).alias("score"))
    a = F.col("roc_auc")
    return curves.rank_metrics(t).select(F.round(F.greatest(a, 1 - a), 8).alias("auc"), F.when(a >= 0.5, "increasing").otherwise("decreasing").alias("direction"), (F.greatest(a, 1 - a) >= 0.9).alias("high_risk"))


@query("group_strata", "SELECT CAST(any_error AS INTEGER) AS stratum, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT user_id, max(CAST(event_type = 'error' AS INTEGER)) AS any_error, count(*) AS n FROM events GROUP BY 1) GROUP BY 1")
def _(spark, d):
    g = scores(spark, d).groupBy("user_id").agg(F.max("label").alias("stratum"), F.count(F.lit(1)).alias("n"))
    return g.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_rows"))


# ---- tokens, uncertainty, explanations, models -----------------------------------------------------

_TOKENS = {"n_div": "div", "n_href": "href", "n_p": "p", "n_script": "script"}


@query("html_tokens", "SELECT page_id, " + ", ".join(f"CAST(len(regexp_extract_all(' ' || regexp_replace(regexp_replace(html, '[^A-Za-z0-9_]', '  ', 'g'), '^|$', ' ', 'g'), ' {t} ')) AS BIGINT) AS {n}" for n, t in _TOKENS.items()) + " FROM pages")
def _(spark, d):
    from ..functions.extract import token_count

    return table(spark, d, "pages").select("page_id", *[token_count(F.col("html"), t).alias(n) for n, t in _TOKENS.items()])


@query("document_structure")
def _(spark, d):
    from ..functions.extract import extract

    return extract(table(spark, d, "pages").withColumn("content", F.col("html").cast("binary")), "page_id")


# draws are of a hash that SQL doesn't have: a digest in its place takes 18 times as long at sf0.1
_BOUNDS_95 = ("point", "lower_95", "upper_95")


@query("bootstrap_ci")
def _(spark, d):
    return rounded(uncertainty.confusion_interval(scores(spark, d), "user_id", 0.5), _BOUNDS_95, 8)


@query("ranking_ci")
def _(spark, d):
    return uncertainty.ranking_interval(scores(spark, d), "user_id")


@query("paired_difference")
def _(spark, d):
    s = scores(spark, d)
    return rounded(uncertainty.paired_difference(s, s.withColumn("score", F.col("score") * F.col("score")), "user_id", 0.25), _BOUNDS_95, 8)


_EXPLAINED = ("l_quantity", "l_discount", "l_tax")


def _scorer():
    from ..operators.explain import logistic

    return logistic({"l_quantity": 0.05, "l_discount": 8.0, "l_tax": -3.0}, -1.0)


_SCORE = "1 / (1 + exp(-(-1.0 + {q} * 0.05 + {d} * 8.0 + {t} * -3.0)))"


@query("local_attribution", "WITH M AS (SELECT quantile_cont(l_quantity, 0.5) AS q, quantile_cont(l_discount, 0.5) AS d, quantile_cont(l_tax, 0.5) AS t FROM lineitem), X AS (SELECT l_orderkey, " + _SCORE.format(q="l_quantity", d="l_discount", t="l_tax") + " - " + _SCORE.format(q="M.q", d="l_discount", t="l_tax") + " AS a, " + _SCORE.format(q="l_quantity", d="l_discount", t="l_tax") + " - " + _SCORE.format(q="l_quantity", d="M.d", t="l_tax") + " AS b, " + _SCORE.format(q="l_quantity", d="l_discount", t="l_tax") + " - " + _SCORE.format(q="l_quantity", d="l_discount", t="M.t") + " AS c FROM lineitem, M) SELECT 'l_quantity' AS feature, round(avg(abs(a)), 8) AS importance FROM X UNION ALL SELECT 'l_discount', round(avg(abs(b)), 8) FROM X UNION ALL SELECT 'l_tax', round(avg(abs(c)), 8) FROM X")
def _(spark, d):
    from ..operators.explain import attributions

    a = attributions(table(spark, d, "lineitem"), _scorer(), _EXPLAINED, "l_orderkey")
    return a.groupBy("feature").agg(F.round(F.avg(F.abs("attribution")), 8).alias("importance"))


def _score_sql(q: str = "l_quantity", d: str = "l_discount", t: str = "l_tax") -> str:
    return "(" + _SCORE.format(q=q, d=d, t=t) + ")"


@query("accumulated_effects", f"""WITH E AS (SELECT list_sort(list_distinct(quantile_cont(l_quantity, [{', '.join(str(i / 10) for i in range(11))}]))) AS e FROM lineitem),
X AS (SELECT len(list_filter(e[2:len(e) - 1], lambda z: z <= l_quantity)) AS bin, e, l_discount, l_tax FROM lineitem, E WHERE len(e) > 2),
Y AS (SELECT bin, e[bin + 1] AS lower, e[bin + 2] AS upper, {_score_sql('e[bin + 2]')} - {_score_sql('e[bin + 1]')} AS d FROM X),
Z AS (SELECT bin, lower, upper, avg(d) AS d, count(*) AS n_rows FROM Y GROUP BY 1, 2, 3), W AS (SELECT *, sum(d) OVER (ORDER BY bin) AS s FROM Z)
SELECT CAST(bin AS INTEGER) AS bin, lower, upper, n_rows, round(s - sum(s * n_rows) OVER () / sum(n_rows) OVER (), 8) AS effect FROM W""")
def _(spark, d):
    from ..operators.explain import effects

    return rounded(effects(table(spark, d, "lineitem"), _scorer(), "l_quantity", _EXPLAINED), ("effect",), 8)


def _interaction_sql(a: str, b: str) -> str:
    names = dict(zip("qdt", _EXPLAINED, strict=True))
    at = {k: f"(SELECT quantile_cont({c}, 0.9) FROM lineitem)" for k, c in names.items() if c in (a, b)}
    score = lambda *fixed: _score_sql(**{k: at[k] if c in fixed else c for k, c in names.items()})
    x = f"{score(a, b)} - {score(a)} - {score(b)} + {score()}"
    return f"SELECT '{a}' AS left, '{b}' AS right, round(avg({x}), 8) AS mean_interaction, round(avg(abs({x})), 8) AS mean_absolute_interaction FROM lineitem"


_TOGETHER = (("l_quantity", "l_discount"), ("l_discount", "l_tax"))


@query("interaction_strength", " UNION ALL ".join(_interaction_sql(a, b) for a, b in _TOGETHER))
def _(spark, d):
    from ..operators.explain import interactions

    return rounded(interactions(table(spark, d, "lineitem"), _scorer(), _TOGETHER, _EXPLAINED), ("mean_interaction", "mean_absolute_interaction"), 8)


def _faithfulness_sql(top: tuple[str, ...], draws: int = 20, seed: int = 42) -> str:
    names = dict(zip("qdt", _EXPLAINED, strict=True))
    middle = {c: f"(SELECT quantile_cont({c}, 0.5) FROM lineitem)" for c in _EXPLAINED}
    rng = random.Random(seed)
    others = [rng.sample(list(_EXPLAINED), len(top)) for _ in range(draws)]
    with_ = lambda fixed: _score_sql(**{k: middle[c] if c in fixed else c for k, c in names.items()})
    deleted = lambda fs: f"avg(abs({with_(())} - {with_(fs)}))"
    inserted = lambda fs: f"avg(abs({with_([c for c in _EXPLAINED if c not in fs])} - {with_(_EXPLAINED)}))"
    mean = lambda f: "(" + " + ".join(f(o) for o in others) + f") / {draws}"
    return f"""WITH X AS (SELECT {deleted(top)} AS td, {inserted(top)} AS ti, {mean(deleted)} AS rd, {mean(inserted)} AS ri FROM lineitem)
SELECT round(td, 8) AS top_deletion, round(ti, 8) AS top_insertion, round(rd, 8) AS random_deletion, round(ri, 8) AS random_insertion, td > rd AND ti > ri AS passed FROM X"""


@query("faithfulness", _faithfulness_sql(("l_quantity",)))
def _(spark, d):
    from ..operators.explain import faithfulness

    out = faithfulness(table(spark, d, "lineitem"), _scorer(), {"l_quantity": 3.0, "l_discount": 2.0, "l_tax": 1.0}, _EXPLAINED, 1)
    return rounded(out, ("top_deletion", "top_insertion", "random_deletion", "random_insertion"), 8)


def _permutation_sql(feature: str, seed: int = 7) -> str:
    names = dict(zip("qdt", _EXPLAINED, strict=True))
    moved = _score_sql(**{k: "moved" if c == feature else c for k, c in names.items()})
    return f"""SELECT '{feature}' AS feature, round(avg(({moved} - label) * ({moved} - label)) - avg(({_score_sql()} - label) * ({_score_sql()} - label)), 8) AS importance FROM (
  SELECT *, coalesce(lead({feature}) OVER w, first_value({feature}) OVER w) AS moved FROM (SELECT *, CAST('0x' || substr(md5('{seed}|{feature}|' || k), 1, 15) AS BIGINT) AS digest FROM K)
  WINDOW w AS (PARTITION BY digest >> 54 ORDER BY digest, k))"""


@query("permutation_importance", f"""WITH K AS (SELECT *, CAST(l_returnflag = 'R' AS INTEGER) AS label, concat_ws('/', l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d'), l_partkey, l_suppkey, l_returnflag, CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT)) AS k FROM lineitem) """ + " UNION ALL ".join(_permutation_sql(f) for f in _EXPLAINED))
def _(spark, d):
    from ..operators.explain import permutation_importance

    key = F.concat_ws("/", "l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd"), "l_partkey", "l_suppkey", "l_returnflag", F.col("l_quantity").cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long"))
    x = table(spark, d, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int")).withColumn("k", key)
    return rounded(permutation_importance(x, _scorer(), _EXPLAINED, "k"), ("importance",), 8)


@query("lr_scores")
def _(spark, d):
    from ..operators import models

    t = telemetry(spark, d)
    m = models.fit(models.prepared(t, NUMBERS), NUMBERS, models.candidates(4)["logistic_1.0"])
    return models.scored(m, models.prepared(t, NUMBERS)).select("sample_id", "score")


@query("platt_isotonic")
def _(spark, d):
    from ..operators import models

    s = scores(spark, d).select("event_id", "label", "score")
    out = None
    for name, df in models.calibrators(s).items():
        part = curves.calibration(df).select(F.lit(name).alias("calibrator"), "ece", "brier")
        out = part if out is None else out.unionByName(part)
    return out


@query("family_ablation")
def _(spark, d):
    from ..operators import models

    t = telemetry(spark, d).withColumn("k", F.xxhash64("sample_id", *FIRST))
    return models.ablation(t, {"amount": ("l_quantity", "l_extendedprice"), "rate": ("l_discount", "l_tax")}, "k")


@query("role_split", f"""WITH {SCORES_SQL}, U AS (SELECT label, CAST('0x' || substr(sha256('42:' || label || ':' || event_id), 1, 10) AS BIGINT) / 1099511627776.0::DOUBLE AS u FROM S)
SELECT label, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.7 + 0.1 THEN 'validation' WHEN u < 0.7 + 0.1 + 0.1 THEN 'calibration' ELSE 'test' END AS role, count(*) AS n_rows FROM U GROUP BY 1, 2""")
def _(spark, d):
    from ..operators import models

    return models.role_split(scores(spark, d), "event_id", "label").groupBy("label", "role").agg(F.count(F.lit(1)).alias("n_rows"))


_RUNS = "I AS (SELECT event_type AS run, user_id AS feature, round(avg(value), 6) AS importance FROM events GROUP BY 1, 2), R AS (SELECT run, feature, rank() OVER (PARTITION BY run ORDER BY importance) + (count(*) OVER (PARTITION BY run, importance) - 1) / 2.0::DOUBLE AS r FROM I)"


@query("rank_stability", f"WITH {_RUNS} SELECT a.run AS left, b.run AS right, round(corr(a.r, b.r), 8) AS correlation FROM R a JOIN R b USING (feature) WHERE a.run < b.run GROUP BY 1, 2")
def _(spark, d):
    runs = table(spark, d, "events").groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("feature")).agg(F.round(F.avg("value"), 6).alias("importance"))
    return rounded(evidence.rank_stability(runs), ("correlation",), 8)


@query("natural_reference", f"""WITH {SCORES_SQL}, X AS (SELECT *, sha256(concat('n:', event_id)) AS digest, count(*) OVER (PARTITION BY label) AS k, count(*) OVER () AS n FROM S),
Y AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY digest, event_id) AS rn, greatest(1, round_even(k * 500.0::DOUBLE / n, 0)) AS quota FROM X)
SELECT event_id, label FROM Y ORDER BY CASE WHEN rn <= quota THEN 0 ELSE 1 END, digest, event_id LIMIT 500""")
def _(spark, d):
    return evidence.natural_reference(scores(spark, d).select("event_id", "label"), "event_id", "label", 500, "n")


@query("model_comparison", f"WITH {SCORES_SQL}, C AS (SELECT event_type AS model, count(*) FILTER (score >= 0.5) AS alerts, count(*) AS n, avg(score) AS mean FROM S GROUP BY 1) SELECT model, round(alerts / n::DOUBLE, 4) AS alert_rate, round(mean, 4) AS mean FROM C")
def _(spark, d):
    c = scores(spark, d).groupBy(F.col("event_type").alias("model")).agg(F.avg((F.col("score") >= 0.5).cast("double")).alias("alert_rate"), F.avg("score").alias("mean"))
    return evidence.compare(c, ("alert_rate", "mean"), "mean")


@query("seed_stability", f"WITH {SCORES_SQL} SELECT CAST(user_id % 5 AS INTEGER) AS seed, {_CONFUSION} FROM S GROUP BY 1")
def _(spark, d):
    return curves.confusion(scores(spark, d).withColumn("seed", (F.col("user_id") % 5).cast("int")), 0.5, ("seed",))


@query("evidence_projection", "SELECT concat('{\"event_id\":', event_id, ',\"event_type\":\"', event_type, '\"}') AS evidence FROM events")
def _(spark, d):
    return evidence.whitelist(table(spark, d, "events").select("event_type", "event_id"), ("event_id", "event_type"))


@query("evenly_spaced_rows", """WITH X AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS b, greatest(1.0::DOUBLE, count(*) OVER () / 1000.0::DOUBLE) AS step FROM events)
SELECT event_id FROM X WHERE floor(b / step) <> floor((b - 1) / step)""")
def _(spark, d):
    return evidence.evenly_spaced(table(spark, d, "events").select("event_id"), "event_id", 1000)


@query("parity_audit", "SELECT 0::BIGINT AS only_batch, 0::BIGINT AS only_single")
def _(spark, d):
    f = features(spark, d)
    batch = engineered.engineer(f, ("sample_id",), ("density",))
    halves = engineered.engineer(f.where("Class = 1"), ("sample_id",), ("density",)).unionByName(engineered.engineer(f.where("Class <> 1"), ("sample_id",), ("density",)))
    return evidence.parity(batch, halves)
