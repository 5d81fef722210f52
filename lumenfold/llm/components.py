"""Connected components of an edge table, without collecting links to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise, spread

#: Edges that one task may hold (two node ids each, under 100 MB); beyond it edges are contracted in parallel first.
ONE_TASK_EDGES = 500_000


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest reachable index of each of n nodes, by minimum labels and pointer jumping."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(label, high, low)
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
    return label


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's edges: each node with the smallest node that it reaches inside the partition."""
    held = [pa.Table.from_batches([x]) for x in batches if x.num_rows]
    if not held:
        return
    t = pa.concat_tables(held)
    kind = t.schema.field("a").type
    both = pa.concat_arrays([t["a"].combine_chunks(), t["b"].combine_chunks()]).dictionary_encode()
    nodes = both.dictionary
    order = np.asarray(pa.compute.sort_indices(nodes))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    index = rank[np.asarray(both.indices)]
    label = roots(index[: t.num_rows], index[t.num_rows :], len(order))
    nodes = nodes.take(pa.array(order))
    for i in range(0, len(order), 100_000):
        yield pa.RecordBatch.from_arrays([nodes[i : i + 100_000].cast(kind), nodes.take(pa.array(label[i : i + 100_000])).cast(kind)], ["node", "root"])


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root): every node that has an edge, with the smallest node of its component.

    Rounds of contraction: each partition replaces its edges by stars, and a node that lies in stars of several
    partitions links their roots; these links are the next, smaller edge table. Ids must not be null; repeated
    edges and loops are harmless; no edges give no rows.
    """
    kind = edges.schema["a"].dataType.simpleString()
    schema = f"node {kind}, root {kind}"
    steps: list[DataFrame] = []
    edges = materialise(edges.select("a", "b").where("a <> b").distinct())
    while edges.limit(ONE_TASK_EDGES + 1).count() > ONE_TASK_EDGES:
        stars = materialise(edges.repartition(spread(edges.sparkSession), "a").mapInArrow(_stars, schema))
        best = materialise(stars.groupBy("node").agg(F.min("root").alias("root")))
        steps.append(best)
        edges = materialise(stars.withColumnRenamed("root", "b").join(best.withColumnRenamed("root", "a"), "node").where("a <> b").select("a", "b").distinct())
    out = edges.coalesce(1).mapInArrow(_stars, schema)
    for best in reversed(steps):
        top = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = best.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return out
