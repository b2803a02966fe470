"""N-gram index, IDF, weighted Jaccard shortlists and their fusion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(rows: DataFrame, grams: Column, keys: list[str]) -> DataFrame:
    """(*keys, gram, cnt) of an array of grams of each row."""
    return rows.select(*keys, F.explode(grams).alias("gram")).groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("cnt"))


def local_idf(index: DataFrame, chains: DataFrame) -> DataFrame:
    """(doc_id, gram, df, idf) with idf = ln((N + 1) / (df + 0.5)), N being all chains of the document."""
    n = chains.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    df = index.groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("df"))
    return df.join(n, "doc_id").select("doc_id", "gram", "df", F.log((F.col("n") + 1) / (F.col("df") + 0.5)).alias("idf"))


def global_idf(index: DataFrame, chains: DataFrame) -> DataFrame:
    """(gram, df, idf) with idf = ln((N + 1) / (df + 1)) + 1 over all chains of all documents."""
    n = chains.agg(F.count(F.lit(1)).alias("n"))
    df = index.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    # One row, by its making.
    return df.join(F.broadcast(n)).select("gram", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def weighted(index: DataFrame, idf: DataFrame, missing: float, on: list[str]) -> DataFrame:
    """index with w, the weight of each gram; grams without an IDF weigh `missing`."""
    return index.join(idf.select(*on, F.col("idf").alias("w")), on, "left").withColumn("w", F.coalesce("w", F.lit(missing)))


def jaccard_shortlist(query: DataFrame, index: DataFrame, keys: list[str], weigh: Callable[[DataFrame], DataFrame] | None = None, digits: int = 6) -> DataFrame:
    """(query_id, *keys, score): IDF-weighted Jaccard of gram sets, for candidates that share a gram.

    query: (query_id, gram, w), index: (*keys, gram), or with w already; weigh adds w to rows with a gram, as the query's
    weights were made. The postings meet the queries on the gram alone and are summed at once; only the grams of the
    candidates so found are weighed.
    """
    mass_of = Window.partitionBy("query_id")
    q = query.withColumn("q_mass", F.sum("w").over(mass_of)).select("query_id", "gram", F.col("w").alias("q_w"), "q_mass")
    hits = index.join(q, "gram").groupBy("query_id", *keys).agg(F.sum("q_w").alias("both"), F.max("q_mass").alias("q_mass"))
    own = index.join(hits.select(*keys).distinct(), keys, "left_semi")
    mass = (weigh(own) if weigh else own).groupBy(*keys).agg(F.sum("w").alias("c_mass"))
    union = F.col("q_mass") + F.col("c_mass") - F.col("both")
    return hits.join(mass, keys).select("query_id", *keys, F.round(F.when(union > 0, F.col("both") / union).otherwise(0.0), digits).alias("score"))


def pruned(scores: DataFrame, tau: float, strict: bool) -> DataFrame:
    """F04 (strict): scores of tau and above. F06 (not strict): the same, but all scores of a query that has none."""
    if strict:
        return scores.where(F.col("score") >= tau)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return scores.withColumn("__best", best).where((F.col("score") >= tau) | (F.col("__best") < tau)).drop("__best")


def top(rows: DataFrame, by: list[Column], k: int, group: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """The first k rows of each group (or of all) in the order given, numbered from 1."""
    if not group:
        rows = rows.orderBy(*by).limit(k)
    order = Window.partitionBy(*group).orderBy(*by) if group else Window.orderBy(*by)
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def fused(a: DataFrame, b: DataFrame, keys: list[str], w_a: float = 0.6, w_b: float = 0.4, digits: int = 6) -> DataFrame:
    """(*keys, a, b, score, why): both shortlists, a missing score counting as 0; why tells which have the row."""
    x = a.select(*keys, F.col("score").alias("a"))
    y = b.select(*keys, F.col("score").alias("b"))
    both = x.join(y, keys, "full_outer")
    why = F.when(F.coalesce("a", F.lit(0.0)) > 0, F.when(F.coalesce("b", F.lit(0.0)) > 0, "both").otherwise("trie")).otherwise("cooc")
    score = w_a * F.coalesce("a", F.lit(0.0)) + w_b * F.coalesce("b", F.lit(0.0))
    return both.select(*keys, F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"), F.round(score, digits).alias("score"), why.alias("why"))


def by_phrases(scores: DataFrame, keys: list[str], n_phrases: int, every: bool) -> DataFrame:
    """(*keys, score): AND takes the least score of what all phrases have, OR the greatest of any."""
    out = scores.groupBy(*keys).agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count_distinct("query_id").alias("n"))
    return out.where(F.col("n") == n_phrases).select(*keys, F.col("low").alias("score")) if every else out.select(*keys, F.col("high").alias("score"))
