"""Connected components of links: in one task while they are few, else by large-star and small-star steps on DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import discard, in_batches, stored

#: The most links that one task joins, 16 bytes each and some 200 bytes while it works; more are made fewer by steps first.
ONE_TASK = 1 << 20


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Each node joins its larger (large) or smaller neighbours to the least of its neighbourhood. The links go."""
    both = edges.union(edges.select("v", "u")) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    # Stored, so that a node with very many neighbours is split by Spark's skew join or needs no shuffle at all.
    least = stored(least, "least")
    joined = both.join(least, both["u"] == least["w"])
    out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    out = stored(out.where("u <> v").distinct(), "large" if large else "small")
    discard(edges, least)
    return out


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links, the nodes that aren't their component's least, and that least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    rest = root != np.arange(len(nodes))
    return nodes[rest], nodes[root[rest]]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def whole(batches):
        held = [(batch.column("u").to_numpy(), batch.column("v").to_numpy()) for batch in batches if batch.num_rows]
        if held:
            node, component = joined(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(component, pa.int64())], names=["node", "component"])

    return in_batches(edges.coalesce(1), whole, "node long, component long")


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """Of links (u, v): (node, component) for every node that is not its component's least.

    Up to one_task links are joined in a single task. More take steps, each of which leaves links to lesser nodes, until they
    are so few, or a round changes no link: after about the logarithm of the longest chain. Links with nulls count for nothing.
    """
    edges = stored(links.select("u", "v").where("u <> v").distinct(), "links")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now["n"] <= one_task:
            return _in_one_task(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
        edges = _step(_step(edges, True), False)
