"""Concordance: lexical, by inverted index, by vectors, and the choice between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import predicates as P
from lexloom.functions import text as T
from lexloom.functions.scores import cosine

#: Rows of a result unless told otherwise.
LIMIT = 500


def lexical(sents: DataFrame, docs: DataFrame, terms: list[str], mode: str = "AND", limit: int | None = LIMIT) -> DataFrame:
    """(doc_id, sentence_id, text, start, end, path, score): sentences with all or any of the terms, by id.

    Terms are literal; the score is how often they occur. path is the document's uri, or its id. No terms, no rows.
    """
    terms = list(dict.fromkeys(t for t in (t.strip().lower() for t in terms) if t))
    hits = sents.where(P.contains_any(F.col("text"), terms, mode.upper() == "AND"))
    score = sum((P.occurrences(F.col("text"), t) for t in terms), F.lit(0))
    hits = hits.withColumn("score", score.cast("double")).join(docs.select("doc_id", "uri"), "doc_id", "left")
    out = hits.select("doc_id", "sentence_id", "text", "start", "end", F.coalesce("uri", F.col("doc_id").cast("string")).alias("path"), "score")
    return out.orderBy("doc_id", "sentence_id").limit(limit) if limit else out


def inverted(sents: DataFrame) -> DataFrame:
    """(word, doc_id, sentence_id), each once; words are runs of letters, digits, underscores and inner hyphens."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_][\p{L}\p{N}_-]*"), F.lit(0)))
    return sents.select(F.explode(found).alias("word"), "doc_id", "sentence_id")


def lookup(index: DataFrame, terms: list[str], every: bool) -> DataFrame:
    """(doc_id, sentence_id) of the sentences that have all, or any, of the words."""
    wanted = sorted({t.lower() for t in terms})
    hits = index.where(F.col("word").isin(*wanted))
    if not every:
        return hits.select("doc_id", "sentence_id").distinct()
    return hits.groupBy("doc_id", "sentence_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).drop("n")


def word_positions(sents: DataFrame, spans: Column) -> DataFrame:
    """(doc_id, sentence_id, pos, word): words that overlap any of the sentence's spans (array<struct<a,b>>)."""
    rows = sents.select("doc_id", "sentence_id", spans.alias("spans"), F.posexplode(T.located(F.col("text"), r"\S+")).alias("pos", "w"))
    return rows.where(F.exists("spans", lambda s: (F.col("w.start") < s["b"]) & (F.col("w.end") > s["a"]))).select("doc_id", "sentence_id", "pos", F.col("w.match").alias("word"))


def vector(vectors: DataFrame, query: list[float], limit: int = LIMIT, digits: int = 6) -> DataFrame:
    """(*columns, score, rank): all vectors of the query's length by cosine, the nearest first, ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where(F.size("vector") == len(query)).withColumn("score", F.round(cosine(F.col("vector"), q), digits)).where("score is not null")
    best = scored.orderBy(F.desc("score"), "doc_id", "sentence_id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id", "sentence_id")))


def concordance(sents: DataFrame, docs: DataFrame, terms: list[str], mode: str = "AND", limit: int = LIMIT, vectors: DataFrame | None = None, query: list[float] | None = None, backend: str | None = None) -> tuple[DataFrame, dict]:
    """Rows of one shape, and how they came about: by vectors if there are any, else lexical.

    (doc_id, sentence_id, text, start, end, path, score, rank); rank is null for lexical rows, which come by id.
    """
    clean = [t.strip() for t in terms if t.strip()]
    meta = {"mode": mode, "vector_backend": backend, "query_text": " ".join(clean)}
    if backend and vectors is not None and query is not None and not vectors.isEmpty():
        hits = vector(vectors, query, limit).select("doc_id", "sentence_id", "score", "rank")
        # Hits without a sentence go; ranks keep their gaps.
        rows = hits.join(sents, ["doc_id", "sentence_id"]).join(docs.select("doc_id", "uri"), "doc_id", "left")
        return rows.select("doc_id", "sentence_id", "text", "start", "end", F.coalesce("uri", F.col("doc_id").cast("string")).alias("path"), "score", "rank"), meta | {"mode": "vector"}
    return lexical(sents, docs, clean, mode, limit).withColumn("rank", F.lit(None).cast("int")), meta


def kwic(hits: DataFrame, term: str, width: int = 50) -> DataFrame:
    """(doc_id, sentence_id, start, left, keyword, right) of each occurrence of a term, as it stands."""
    pattern = "(?i)" + T.escaped(term)
    rows = hits.select("doc_id", "sentence_id", "text", F.explode(T.located(F.col("text"), pattern)).alias("s"))
    return rows.select("doc_id", "sentence_id", F.col("s.start").alias("start"), T.kwic(F.col("text"), F.col("s.start"), F.col("s.end"), width).alias("k")).select("doc_id", "sentence_id", "start", "k.*")
