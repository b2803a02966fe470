"""Joins of points and spans with spans. Each has the document as equal key, so that Spark can deal it out by a hash; the
range is a residual predicate. Long documents can be cut further by `bucket`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stabbing(points: DataFrame, spans: DataFrame, on: str = "doc_id", point: str = "point", bucket: int | None = None) -> DataFrame:
    """Points with every span [start, end) that holds them.

    With a bucket width, spans go to each bucket that they touch, and a point looks into its own alone, so that a very long
    document is dealt over many tasks.
    """
    s = spans.withColumnRenamed(on, "__on")
    if bucket:
        s = s.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.greatest(F.col("start"), F.col("end") - 1) / bucket))))
        p = points.withColumn("__pb", F.floor(F.col(point) / bucket))
        return p.join(s, (p[on] == s["__on"]) & (p["__pb"] == s["__b"]) & (p[point] >= s["start"]) & (p[point] < s["end"])).drop("__on", "__b", "__pb")
    return points.join(s, (points[on] == s["__on"]) & (points[point] >= s["start"]) & (points[point] < s["end"])).drop("__on")


def overlapping(left: DataFrame, right: DataFrame, on: str = "doc_id") -> DataFrame:
    """Rows of left (begin, stop) with every span of right (start, end) that they overlap; touching doesn't count."""
    r = right.withColumnRenamed(on, "__on")
    return left.join(r, (left[on] == r["__on"]) & (r["start"] < left["stop"]) & (r["end"] > left["begin"])).drop("__on")


def first_of(rows: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """One row for each key: the first in the order given."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("__k = 1").drop("__k")


def containing(inner: DataFrame, outer: DataFrame, keys: list[str], by: list[Column], on: str = "doc_id") -> DataFrame:
    """Inner (begin, stop) with the first outer span that holds them whole; the others go."""
    o = outer.withColumnRenamed(on, "__on")
    held = inner.join(o, (inner[on] == o["__on"]) & (o["start"] <= inner["begin"]) & (inner["stop"] <= o["end"])).drop("__on")
    return first_of(held, keys, by)


def span_to_chain(spans: DataFrame, mentions: DataFrame, on: str = "doc_id") -> DataFrame:
    """(doc_id, span_id, chain_id): the first chain with a mention that holds the span's start, middle or last place.

    Spans without a chain stay, with null.
    """
    probes = spans.select(on, "span_id", F.explode(F.array_distinct(F.array("begin", F.floor((F.col("begin") + F.col("stop")) / 2).cast("int"), F.greatest("begin", F.col("stop") - 1)))).alias("point"))
    hit = stabbing(probes, mentions, on).groupBy(on, "span_id").agg(F.min("chain_id").alias("chain_id"))
    return spans.select(on, "span_id").join(hit, [on, "span_id"], "left")


def with_chain(spans: DataFrame, mentions: DataFrame, on: str = "doc_id") -> DataFrame:
    """Spans (on, begin, stop, …), different rows, with chain_id as of span_to_chain().

    Spans and mentions are dealt out once each, by document, and nothing is after that.
    """
    begin, stop = F.col("begin"), F.col("stop")
    held = lambda p: (F.col("__m0") <= p) & (p < F.col("__m1"))
    any_ = held(begin) | held(F.floor((begin + stop) / 2).cast("int")) | held(F.greatest(begin, stop - 1))
    m = mentions.select(F.col(on).alias("__on"), F.col("start").alias("__m0"), F.col("end").alias("__m1"), F.col("chain_id").alias("__chain"))
    met = spans.join(m, (F.col(on) == F.col("__on")) & any_, "left")
    return met.groupBy(*spans.columns).agg(F.min("__chain").alias("chain_id"))


def related_mentions(mapped: DataFrame, mentions: DataFrame, most: int = 5, on: str = "doc_id") -> DataFrame:
    """Of each span with a chain (begin, stop, chain_id), the first other mentions of it, by place."""
    joined = mapped.join(mentions.select(on, "chain_id", "start", "end", "text"), [on, "chain_id"]).where("not (start = begin and end = stop)")
    order = Window.partitionBy(on, "span_id").orderBy("start", "end")
    return joined.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)


def best_overlap(spans: DataFrame, sents: DataFrame, top: int = 0) -> DataFrame:
    """Of spans (doc_id, begin, stop, score), for each sentence the greatest score and, with it, overlap; then the
    best `top` sentences of all, or all of them for 0. Each sentence comes once."""
    hits = overlapping(spans, sents).withColumn("overlap", F.least("end", "stop") - F.greatest("start", "begin"))
    best = hits.groupBy("doc_id", "sentence_id", "start", "end").agg(F.max(F.struct("score", "overlap")).alias("b")).select("doc_id", "sentence_id", (F.col("end") - F.col("start")).alias("length"), "b.*")
    by = [F.desc("score"), F.desc("overlap"), F.col("length"), F.col("doc_id"), F.col("sentence_id")]
    return best.orderBy(*by).limit(top) if top else best


def mention_sentences(mentions: DataFrame, sents: DataFrame) -> DataFrame:
    """(doc_id, chain_id, sentence_id, spans): sentences that hold mentions of a chain, with the mentions' places in
    them."""
    s = sents.select(F.col("doc_id").alias("__d"), "sentence_id", F.col("start").alias("s0"), F.col("end").alias("s1"))
    held = mentions.drop("sentence_id").join(s, (F.col("doc_id") == F.col("__d")) & (F.col("s0") <= F.col("start")) & (F.col("end") <= F.col("s1")))
    place = F.struct((F.col("start") - F.col("s0")).alias("start"), (F.col("end") - F.col("s0")).alias("end"))
    return held.groupBy("doc_id", "chain_id", "sentence_id").agg(F.sort_array(F.collect_list(place)).alias("spans"))


def bucketed_mentions(mentions: DataFrame, sents: DataFrame) -> DataFrame:
    """(doc_id, chain_id, sentence_id, n): mentions by sentence: their own if they name one, else the first that holds
    them, else null."""
    numbered = mentions.withColumn("begin", F.col("start")).withColumn("stop", F.col("end")).drop("start", "end")
    unnamed = numbered.where("sentence_id is null").drop("sentence_id")
    found = containing(unnamed, sents, ["doc_id", "chain_id", "begin", "stop"], [F.col("sentence_id")]).select("doc_id", "chain_id", "begin", "stop", "sentence_id")
    rest = unnamed.join(found, ["doc_id", "chain_id", "begin", "stop"], "left").select("doc_id", "chain_id", "sentence_id")
    named = numbered.where("sentence_id is not null").select("doc_id", "chain_id", "sentence_id")
    return named.unionByName(rest).groupBy("doc_id", "chain_id", "sentence_id").agg(F.count(F.lit(1)).alias("n"))
