"""Graphs of sentences: building, sparsifying, communities, trees of a chain, summaries of a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.scores import cosine
from lexloom.sources.shared import discard, stored


def kept(df: DataFrame) -> DataFrame:
    """df cut off from its lineage: written to the folder that the cluster shares, and read again from there."""
    return stored(df, "kept")


def similarity_edges(members: DataFrame, least: float = 0.1, digits: int = 6, rows: int = 1024) -> DataFrame:
    """(cluster_id, i, j, score), i < j, of members (cluster_id, id, vector) with a cosine above `least`.

    Each two members of a cluster are an edge of it by definition of the operator. A cluster is packed into blocks of about
    so many vectors, and each two of its blocks meet in a row of their own, so that a large cluster is no single task.
    """
    kinds = dict(members.dtypes)
    sizes = members.groupBy("cluster_id").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("blocks"))
    dealt = members.select("cluster_id", "id", F.col("vector").cast("array<double>").alias("vector")).where(F.size("vector") > 0).join(sizes, "cluster_id")
    # What has another length has no cosine.
    keys = ["cluster_id", "dim", "blocks"]
    packed = dealt.groupBy("cluster_id", F.size("vector").alias("dim"), "blocks", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("b")).agg(F.collect_list(F.struct("id", "vector")).alias("x"))
    packed = packed.select(*keys, "b", F.col("x.id").alias("ids"), F.flatten("x.vector").alias("values"))
    a = packed.select(*keys, F.col("b").alias("a"), F.col("ids").alias("ids_a"), F.col("values").alias("values_a"), F.explode(F.sequence("b", F.col("blocks") - 1)).alias("b"))
    met = a.join(packed, [*keys, "b"]).select("cluster_id", "dim", (F.col("a") == F.col("b")).alias("same"), "ids_a", "values_a", "ids", "values")
    names = ["cluster_id", "i", "j", "score"]

    def score(batches):
        for pdf in batches:
            for cluster, dim, same, ia, va, ib, vb in pdf.itertuples(index=False):
                a, b = (np.asarray(v, float).reshape(-1, dim) for v in (va, vb))
                ia, ib = np.asarray(ia), np.asarray(ib)
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1))
                    hit = s > least - 10.0**-digits
                i, j = np.nonzero(hit & (ia[:, None] < ib) if same else hit)
                x, y = ia[i], ib[j]
                yield pd.DataFrame({"cluster_id": cluster, "i": np.where(x < y, x, y), "j": np.where(x < y, y, x), "score": s[i, j]}, columns=names)

    pairs = met.mapInPandas(score, f"cluster_id {kinds['cluster_id']}, i {kinds['id']}, j {kinds['id']}, score double")
    return pairs.withColumn("score", F.round("score", digits)).where(F.col("score") > least)


def sparsified(edges: DataFrame, least: float = 0.55, degree: int = 30) -> DataFrame:
    """Of (i, j, score), edges of `least` or more that are among the best `degree` of both their ends."""
    strong = edges.where(F.col("score") >= least)
    ends = strong.select("i", "j", "score", F.explode(F.array("i", "j")).alias("end"))
    order = Window.partitionBy("end").orderBy(F.desc("score"), "i", "j")
    best = ends.withColumn("k", F.row_number().over(order)).where(F.col("k") <= degree)
    return best.groupBy("i", "j").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community) by label propagation: in each of a fixed number of rounds all nodes at once take the most
    common label of their neighbours and themselves, the least of equally common ones."""
    both = edges.select(F.col("i").alias("a"), F.col("j").alias("b")).union(edges.select("j", "i")).union(nodes.select("id", "id"))
    both = kept(both.distinct())
    labels = nodes.select("id", F.col("id").alias("community"))
    for _ in range(rounds):
        votes = both.join(labels, F.col("b") == F.col("id")).groupBy("a", "community").agg(F.count(F.lit(1)).alias("n"))
        before, labels = labels, kept(votes.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("n"), "community"))["community"].alias("community")).withColumnRenamed("a", "id"))
        discard(before)
    return labels


def memberships(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, sentence_id, community) of members (doc_id, sentence_id, id) whose node has a community."""
    return members.join(labels, "id").select("doc_id", "sentence_id", "community")


def descendants(edges: DataFrame, roots: DataFrame, depth: int = 20) -> DataFrame:
    """(root, node, level): what can be reached from each root along (parent, child), at its least level.

    Ends when a level adds nothing, or at the depth given; a node is visited once, so circles do no harm.
    """
    seen = kept(roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("level")))
    edge = kept(edges.select("parent", "child").distinct())
    front = seen
    for level in range(1, depth + 1):
        step = front.join(edge, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node")).distinct()
        front = kept(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        seen = kept(seen.unionByName(front))
    return seen


def chain_trees(edges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (parent, child, label) within each chain of members (chain_id, node), and the chain's roots: members that
    no parent edge of it reaches, or all, if each is reached."""
    m = members.select("chain_id", "node").distinct()
    inside = edges.join(m.withColumnRenamed("node", "parent"), "parent").join(m.withColumnRenamed("node", "child"), ["chain_id", "child"]).select("chain_id", "parent", "child", "label")
    reached = inside.where("label <> 'corefer'").select("chain_id", F.col("child").alias("node")).distinct()
    free = m.join(reached, ["chain_id", "node"], "left_anti")
    whole = m.join(free.select("chain_id").distinct(), "chain_id", "left_anti")
    return inside, free.unionByName(whole)


def group_summary(members: DataFrame, least: float = 0.55, top: int = 5, digits: int = 6) -> DataFrame:
    """(group_id, representative, kept): of members (group_id, id, vector), the one nearest to the mean, and the first
    `top` of those with a cosine to it of `least` or more, array<struct<sim,id>>."""
    sims = centroid_similarity(members, digits)
    order = Window.partitionBy("group_id").orderBy(F.desc("sim"), "id")
    ranked = sims.withColumn("k", F.row_number().over(order))
    shown = F.when((F.col("k") <= top) & (F.col("sim") >= least), F.struct("k", "id", "sim"))
    out = ranked.where(F.col("k") <= top).groupBy("group_id").agg(F.min(F.struct("k", "id"))["id"].alias("representative"), F.sort_array(F.collect_list(shown)).alias("kept"))
    return out.withColumn("kept", F.transform("kept", lambda x: F.struct(x["id"].alias("id"), x["sim"].alias("sim"))))


def centroid_similarity(members: DataFrame, digits: int = 6) -> DataFrame:
    """(group_id, id, sim): cosine of each member to its group's mean, which is summed place by place."""
    places = members.select("group_id", F.posexplode(F.col("vector").cast("array<double>")).alias("p", "x"))
    mean = places.groupBy("group_id", "p").agg(F.avg("x").alias("x")).groupBy("group_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("centre"))
    return members.join(mean, "group_id").select("group_id", "id", F.round(cosine(F.col("vector"), F.col("centre")), digits).alias("sim"))


def extractive_summary(members: DataFrame, n: int = 3) -> DataFrame:
    """(group_id, summary): of members (group_id, id, text, vector), the n nearest to the mean, in the order of id."""
    sims = centroid_similarity(members)
    order = Window.partitionBy("group_id").orderBy(F.desc("sim"), "id")
    best = sims.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).join(members.select("group_id", "id", "text"), ["group_id", "id"])
    return best.groupBy("group_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda s: s["text"]), ". ").alias("summary"))


def metadata(pairs: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: pairs scored, communities, nodes."""
    return pairs.agg(F.count(F.lit(1)).alias("pairs_scored")).join(labels.agg(F.count_distinct("community").alias("communities"))).join(nodes.agg(F.count(F.lit(1)).alias("nodes")))
