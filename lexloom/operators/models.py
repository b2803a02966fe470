"""H: where models plug in. Each kind has a default that needs none and gives the same each time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import vectors

Encode = Callable[[list[str]], np.ndarray]


@dataclass(frozen=True)
class Options:
    """The options of a run; unknown ones are an error rather than dropped in silence."""

    max_sentences: int | None = None
    max_span_len: int = 4
    top_k_spans: int = 8
    max_phrase_len: int = 5
    top_k_phrases: int = 5
    char_n: int = 4
    token_ns: tuple[int, ...] = (2, 3)
    tau: float = 0.18
    agree: float = 0.1
    disagree: float = 0.2
    least_confidence: float = 0.5
    cooc_window: int = 5
    cooc_min_count: int = 2
    cooc_neighbours: int = 10


def encoded(rows: DataFrame, column: str, load: Callable[[], Encode], out: str = "vector", batch: int = 256) -> DataFrame:
    """Rows with `out`, the vector of a text column. load() is called once by each worker, and gives the encoder."""

    @F.pandas_udf("array<float>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in texts:
            parts = [model(part.iloc[a : a + batch].fillna("").tolist()) for a in range(0, len(part), batch)]
            yield pd.Series([v.astype(np.float32).tolist() for p in parts for v in p], index=part.index)

    return rows.withColumn(out, encode(F.col(column)))


def hashed_words(dim: int = 64) -> Encode:
    """The default encoder: words, and their pairs, hashed into signed places; unit length, zero for no words."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            words = text.lower().split()
            for w in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 16 & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return encode


def looked_up(rows: DataFrame, vectors: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that have a stored vector, with it, and those that still need one."""
    return rows.join(vectors, keys), rows.join(vectors.select(*keys), keys, "left_anti")


def nearest_label(rows: DataFrame, labels: DataFrame, least: float = 0.6, digits: int = 6) -> DataFrame:
    """(id, label, score): of labels (code, vector), a list given by the caller, that nearest to each row (id, vector);
    null below `least`. Equal ones go by code."""
    named = labels.select(F.col("code").alias("id"), "vector")
    best = vectors.blocks(rows.select(F.col("id").alias("query_id"), "vector"), named, 1, own=True, digits=digits)
    best = best.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b"))
    return best.select(F.col("query_id").alias("id"), F.when(-F.col("b.s") >= least, F.col("b.id")).alias("label"), (-F.col("b.s")).alias("score"))


def argmax_label(scores: Column) -> Column:
    """struct<label,confidence> of an array of logits: softmax, the first of equals."""
    top = F.array_max(scores)
    return F.struct((F.array_position(scores, top) - 1).cast("int").alias("label"), F.round(1 / F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - top)), 6).alias("confidence"))


def word_weights(docs: DataFrame, words: int = 20_000, sample: int = 100_000, seed: int = 7) -> DataFrame:
    """(token, weight) of a linear classifier of whole texts, trained on labelled documents (text, label 0 or 1).

    Fitted on about `sample` rows at most, over the `words` words that most of them hold, two at least; weights are of
    presence, so a word's weight is its integrated gradient along the straight path from the text without words.
    """
    rows = docs.where("label is not null").select(F.col("label").cast("double").alias("label"), F.array_distinct(T.tokens(F.coalesce("text", F.lit("")))).alias("tokens"))
    n = rows.count()
    rows = (rows.sample(sample / n, seed=seed) if n > sample else rows).cache()
    try:
        vocabulary = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=words, minDF=2, binary=True).fit(rows)
        model = LogisticRegression(maxIter=30, regParam=0.05, standardization=False).fit(vocabulary.transform(rows))
    finally:
        rows.unpersist()
    return docs.sparkSession.createDataFrame(list(zip(vocabulary.vocabulary, map(float, model.coefficients), strict=True)), "token string, weight double")


def gradients(tokens: DataFrame, weights: DataFrame) -> DataFrame:
    """Tokens (…, token) with importance, the classifier's weight of the token, 0 for one that it doesn't know.

    A place holds a word that may have punctuation about it; the weight is that of its first run of letters and digits.
    """
    bare = F.coalesce(F.get(T.tokens(F.col("token")), F.lit(0)), F.lit(""))
    joined = tokens.drop("importance").withColumn("__t", bare).join(weights.select(F.col("token").alias("__w"), "weight"), F.col("__t") == F.col("__w"), "left")
    return joined.withColumn("importance", F.coalesce("weight", F.lit(0.0))).drop("__t", "__w", "weight")


def pair_score(a: Column, b: Column) -> Column:
    """The default pair scorer is word Jaccard, which has no order."""
    return T.word_jaccard(a, b)


def token_attribution(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(…, weight): a token's importance as a share of its text's."""
    return tokens.withColumn("weight", F.round(F.col("importance") / F.sum("importance").over(Window.partitionBy(*keys)), 9))


def packed_ids(sentences: DataFrame, cls: int, sep: int, most: int = 512) -> DataFrame:
    """(doc_id, ids, segments, cls_at): sentences (doc_id, sentence_id, ids), each between its marks, with alternating
    segments, cut at `most`."""
    one = F.concat(F.array(F.lit(cls)), "ids", F.array(F.lit(sep)))
    listed = sentences.withColumn("one", one).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sentence_id", "one"))).alias("s"))
    ids = F.slice(F.flatten(F.transform("s", lambda x: x["one"])), 1, most)
    segments = F.slice(F.flatten(F.transform("s", lambda x, i: F.array_repeat(i % 2, F.size(x["one"])))), 1, most)
    out = listed.select("doc_id", ids.alias("ids"), segments.alias("segments"))
    at = F.filter(F.transform("ids", lambda t, i: F.when(t == cls, i)), lambda i: i.isNotNull())
    return out.withColumn("cls_at", at)
