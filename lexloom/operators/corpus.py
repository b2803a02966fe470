"""Documents as sentences, tokens, mentions and chains."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_id, start, end, text), offsets within the document, without empty sentences."""
    return docs.select("doc_id", F.posexplode(T.sentence_spans(F.col("text"))).alias("sentence_id", "s")).select("doc_id", "sentence_id", "s.*").where(F.length("text") > 0)


def sentence_tokens(sents: DataFrame) -> DataFrame:
    """(doc_id, sentence_id, pos, token)."""
    return sents.select("doc_id", "sentence_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "token"))


def document_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, token)."""
    return docs.select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "token"))


def default_mentions(sents: DataFrame, least: int = 6) -> DataFrame:
    """H04, the default engine: two tokens in a row within a sentence, the second of which, the head, has some length.

    (doc_id, sentence_id, pos, prev, head, text). All pairs are made within a row; nothing is shuffled.
    """
    pairs = lambda w: F.when(F.size(w) > 1, F.filter(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.struct(i.alias("pos"), F.get(w, i - 1).alias("prev"), F.get(w, i).alias("head"))), lambda m: F.length(m["head"]) >= least))
    rows = sents.select("doc_id", "sentence_id", F.explode(T.let(T.tokens(F.col("text")), pairs)).alias("m"))
    return rows.select("doc_id", "sentence_id", "m.*", F.concat_ws(" ", "m.prev", "m.head").alias("text"))


def engine_mentions(docs: DataFrame, load: Callable[[], Callable[[list[str]], list[list[list[tuple[int, int]]]]]], batch: int = 64) -> DataFrame:
    """H04, by a plug-in: (doc_id, chain_id, start, end, text) of documents (doc_id, text).

    load() is called once by each worker, and gives the engine: of a list of texts, for each the chains, each a list of
    places, end exclusive. Chains are numbered from 1; places outside a text, or of no extent, go.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = load()
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                texts = part["text"].fillna("").tolist()
                rows = [(d, n, x, y, t[x:y]) for d, t, found in zip(part["doc_id"], texts, engine(texts), strict=True) for n, places in enumerate(found, 1) for x, y in places if 0 <= x < y <= len(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "chain_id", "start", "end", "text"])

    return docs.select("doc_id", "text").mapInPandas(each, f"doc_id {kind}, chain_id int, start int, end int, text string")


def repeated_words(least: int = 8) -> Callable[[list[str]], list[list[list[tuple[int, int]]]]]:
    """A plain engine: words of some length that stand in a text more than once are a chain, in the order of their first."""

    def chains_of(text: str) -> list[list[tuple[int, int]]]:
        found: dict[str, list[tuple[int, int]]] = {}
        for m in re.finditer(r"[^ \t\n\x0B\f\r]+", text):
            if len(m[0]) >= least:
                found.setdefault(m[0], []).append(m.span())
        return [places for places in found.values() if len(places) > 1]

    return lambda texts: [chains_of(t) for t in texts]


def chained(mentions: DataFrame) -> DataFrame:
    """Mentions of a document that share a head, two or more of them, with chain_id by head.

    A document's mentions are dealt to one task once, and sorted there once for both windows.
    """
    same = Window.partitionBy("doc_id", "head")
    kept = mentions.repartition("doc_id").withColumn("n_mentions", F.count(F.lit(1)).over(same)).where("n_mentions >= 2")
    return kept.withColumn("chain_id", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("head")))


def chains(mentions: DataFrame) -> DataFrame:
    """(doc_id, chain_id, head, n_mentions, representative): the longest mention text, the first by text of equals."""
    return mentions.groupBy("doc_id", "chain_id", "head").agg(F.count(F.lit(1)).alias("n_mentions"), F.min(F.struct((-F.length("text")).alias("n"), "text"))["text"].alias("representative"))


def filtered_sentences(sents: DataFrame, predicate: Callable[[Column], Column]) -> DataFrame:
    """The sentences that a predicate keeps, with their own numbers and offsets."""
    return sents.where(predicate(F.col("text")))
