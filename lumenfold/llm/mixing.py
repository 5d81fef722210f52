"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a digest of id and text and may pass up to REPEATS times. An item's virtual finish
time is the cumulative size of its source, over passes, divided by the source's target. Items are taken in the global
order of finish times until the total budget, the size of the whole corpus, is used up.

Cumulative sizes come in two levels (sums of hash ranges, then within a range), so a source that holds a third of all
rows is dealt over RANGES tasks. The global order is cut the same way: a histogram of finish times, then only the range
that the budget ends in is sorted. Only tables with one row a source, or a source and hash range, meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import materialise, spread, table

REPEATS = 3
RANGES_BITS = 12
#: Rows that are alike, of one range.
RUN = 4096
TIMES = 4096
BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; 0 for null."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """sizes(source, source_size) -> with weight and target.

    Weights 1, 2, 3, repeating, over sources by code point, null last. Targets share the sum of all sizes by weight; the
    excess over repeats times a source's size goes to the others by weight until none is above. That is
    min(cap, level * weight); the level is found where, by growing cap / weight, it first doesn't exceed the ratio.
    """
    ranked = sizes.withColumn("weight", (F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(3)) + 1).cast("double"))
    ranked = ranked.withColumn("cap", (repeats * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.asc_nulls_last("source"))
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    above = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(above)
    ranked = ranked.withColumn("level", level)
    # the last ratio is never exceeded: all caps together are repeats times the budget
    ranked = ranked.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    return ranked.select("source", "source_size", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _digits(text: Column) -> Column:
    """60 bits of a digest, which SQL engines have alike."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, carry: tuple[str, ...] = (), repeats: int = REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies, finish, lap, and the columns to carry: one row per row of docs(doc_id, source, text).

    copies: how often the mix takes the document (0 to repeats); taken: size times copies; finish: virtual finish time of
    its first pass, lap: what each further pass adds. The shuffle is by a digest of id and text, so rows without an id, or
    with one id, are dealt over all ranges; rows that are alike are counted first and dealt out in runs of RUN. A null text
    has size 0; a null source is a source of its own, the last; a source without words has target 0, and its documents pass
    once. An empty table gives no rows. Other columns are ignored. No text is shuffled.
    """
    carried = [f"carry_{c}" for c in carry]
    key = _digits(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col("text"), F.lit(""))))
    base = docs.select("doc_id", "source", words(F.col("text")).alias("size"), key.alias("key"), *[F.col(c).alias(n) for c, n in zip(carry, carried, strict=True)])
    alike = base.groupBy(*base.columns).agg(F.count(F.lit(1)).alias("alike"))
    alike = alike.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("alike") - 1) / RUN).cast("long"))))
    alike = alike.withColumn("key", F.when(F.col("run") == 0, F.col("key")).otherwise(_digits(F.concat_ws("+", "key", "run"))))
    # a name for each source that is never null, so that windows and joins deal rows out alike
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    alike = alike.withColumn("range", F.shiftright("key", 60 - RANGES_BITS)).withColumn("name", name)
    within = F.sequence(F.lit(1), F.least(F.col("alike") - F.col("run") * RUN, F.lit(RUN)).cast("int"))
    rows = alike.repartition("name", "range").withColumn("nth", F.explode(within))
    rows = materialise(rows.select("doc_id", "source", "name", "size", "key", "range", *carried))
    parts = materialise(rows.groupBy("source", "name", "range").agg(F.sum("size").alias("sum")))
    share = materialise(targets(parts.groupBy("source").agg(F.sum("sum").alias("source_size"))).withColumn("name", name))
    before = Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("name", "range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    offsets = materialise(offsets.join(share.drop("source"), "name"))
    within = Window.partitionBy("name", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    # offsets grow with sources; merged, they need no broadcast, and the rows lie by name and range already
    placed = rows.withColumn("upto", F.sum("size").over(within)).join(offsets.hint("merge"), ["name", "range"]).drop("name", "range")
    placed = materialise(placed.withColumn("upto", F.col("upto") + F.col("before")).drop("before"))

    def finish(p: Column) -> Column:
        return F.when(F.col("target") > 0, (p * F.col("source_size") + F.col("upto")) / F.col("target")).otherwise(p + F.lit(0.0))

    def begins(p: Column) -> Column:
        return F.when(F.col("target") > 0, p * F.col("source_size") + F.col("upto") - F.col("size") < F.col("target")).otherwise(p == 0)

    # items whose service starts before every source has its share
    items = placed.where("size > 0").select("size", "key", "doc_id", "upto", "source_size", "target", F.explode(F.array(*[F.lit(e) for e in range(repeats)])).alias("pass"))
    items = items.where(begins(F.col("pass"))).withColumn("time", finish(F.col("pass"))).withColumn("slot", F.least(F.floor(F.col("time") * TIMES), F.lit(2 * TIMES)).cast("int"))
    slots = items.groupBy("slot").agg(F.sum("size").alias("sum"))
    budget = share.agg(F.sum("source_size").alias("budget"))
    slots = slots.withColumn("upto_slot", F.sum("sum").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)))
    # two tables of one row: the budget, and the slot that it ends in
    last = slots.crossJoin(F.broadcast(budget)).where("upto_slot > budget").agg(F.min(F.struct("slot", (F.col("upto_slot") - F.col("sum")).alias("before_slot"), "budget")).alias("x")).select("x.*")
    edge = items.join(F.broadcast(last), "slot").withColumn("sum", F.sum("size").over(Window.partitionBy("slot").orderBy("time", "key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    cut = edge.where("before_slot + sum > budget").agg(F.min(F.struct("time", "key", "doc_id")).alias("cut"))
    copies = sum((F.when(begins(F.lit(e)) & (F.col("cut").isNull() | (F.struct(finish(F.lit(e)).alias("time"), F.col("key"), F.col("doc_id")) < F.col("cut"))), 1).otherwise(0) for e in range(repeats)), F.lit(0))
    placed = placed.crossJoin(F.broadcast(cut)).withColumn("copies", copies.cast("long"))
    lap = F.when(F.col("target") > 0, F.col("source_size") / F.col("target")).otherwise(1.0)
    carried = [F.col(n).alias(c) for c, n in zip(carry, carried, strict=True) if c not in ("doc_id", "source")]
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", finish(F.lit(0)).alias("finish"), lap.alias("lap"), *carried)


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the columns of docs, a row for each time that a document is taken, in the order of virtual finish times.

    The mix is made of ids, sizes and digests of whole rows; texts join it once and then go to the range of finish times
    that they belong to, which is known by then. Rows that are the same in all columns are one text until they join. A
    row's columns may have any names; null texts and sources, and empty tables, are as in mix().
    """
    # under names that none of mix's own columns has
    held = {c: f"mixed_{i}" for i, c in enumerate(docs.columns)}
    # a digest of the row: 128 bits
    whole = [F.xxhash64(F.lit(seed), *docs.columns).alias(n) for seed, n in ((1, "same_a"), (2, "same_b"))]
    named = docs.select("doc_id", "source", "text", *whole, *[F.col(c).alias(n) for c, n in held.items()])
    taken = mix(named, ("same_a", "same_b")).where("copies > 0")
    items = taken.withColumn("pass", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    items = items.select("same_a", "same_b", "size", (F.col("finish") + F.col("pass") * F.col("lap")).alias("time"))
    items = materialise(items.withColumn("slot", F.least(F.floor(F.col("time") * TIMES), F.lit(2 * TIMES)).cast("int")))
    # ranges of about as many words; a table of 2 * TIMES rows at most
    n = spread(docs.sparkSession)
    slots = items.groupBy("slot").agg(F.sum(F.col("size") + 1).alias("sum"))
    upto = F.sum("sum").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("sum")
    slots = slots.select("slot", F.least(F.floor(upto * n / F.sum("sum").over(Window.partitionBy())), F.lit(n - 1)).cast("int").alias("place"))
    items = items.join(F.broadcast(slots), "slot").select("same_a", "same_b", "time", "place")
    texts = named.drop("doc_id", "source", "text").dropDuplicates(["same_a", "same_b"])
    out = texts.join(items.hint("merge"), ["same_a", "same_b"]).repartitionById(n, F.col("place")).sortWithinPartitions("time", "same_a", "same_b")
    return out.select(*[F.col(n).alias(c) for c, n in held.items()])


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: One plain fair queue; rows that are alike differ in nothing, so their order doesn't matter.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS key
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM s),
l AS (
  SELECT *, cap / weight AS ratio,
         (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM l WHERE level <= ratio) * weight) AS target FROM l),
q AS (
  SELECT row_number() OVER () AS n, d.*, source_size, target,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), i AS (
  SELECT n, size, key, doc_id, (p * source_size + upto) / target AS time
  FROM q, range(3) AS r(p) WHERE size > 0 AND p * source_size + upto - size < target
), o AS (SELECT n, size, sum(size) OVER (ORDER BY time, key, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM i),
k AS (SELECT n, CAST(sum(size) AS BIGINT) AS taken FROM o WHERE total <= (SELECT sum(size) FROM d) GROUP BY n)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM q LEFT JOIN k USING (n)
"""
