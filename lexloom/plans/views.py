"""The engine's inputs made of the star-schema and document tables, and the same as SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import corpus


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def spread(rows: DataFrame) -> DataFrame:
    """A scan as it is, unless it is of so few pieces that cores would idle; then its rows are dealt out once.

    That is so for a single small file alone: a large input has more pieces than there are cores.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumn("uri", F.concat(F.lit("corpus://"), "source", F.lit("/"), F.col("doc_id").cast("string")))


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.sentences(table(spark, sf, "documents"))


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions in chains: (doc_id, sentence_id, pos, prev, head, text, n_mentions, chain_id)."""
    return corpus.chained(corpus.default_mentions(sentences(spark, sf)))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def wide(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and others as double, as SQL has them."""
    kinds = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}
    return df.select(*[F.col(c).cast(kinds.get(k, k)) for c, k in df.dtypes])


def joined(value: Column, by: str = "|") -> Column:
    return F.array_join(value, by)


WS = r"[ \t\n\r\f]"
SQL = {
    "s": rf"""raw AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1)) AS ss,
    list_append(regexp_extract_all(text, '[.!?]({WS}+)', 1), '') AS gs FROM documents),
  s0 AS (SELECT doc_id, generate_subscripts(ss, 1) - 1 AS sentence_id, unnest(ss) AS text, unnest(gs) AS gap FROM raw),
  s1 AS (SELECT *, coalesce(sum(length(text) + length(gap)) OVER (PARTITION BY doc_id ORDER BY sentence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM s0),
  s AS (SELECT doc_id, sentence_id::BIGINT AS sentence_id, start, start + length(text) AS stop, text FROM s1 WHERE length(text) > 0)""",
    "t": r"""tl AS (SELECT doc_id, sentence_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ts FROM s),
  t AS (SELECT doc_id, sentence_id, generate_subscripts(ts, 1) - 1 AS pos, unnest(ts) AS token FROM tl)""",
    "m": """p AS (SELECT doc_id, sentence_id, pos, lag(token) OVER (PARTITION BY doc_id, sentence_id ORDER BY pos) AS prev, token AS head FROM t),
  m0 AS (SELECT *, prev || ' ' || head AS text, count(*) OVER (PARTITION BY doc_id, head) AS n_mentions FROM p WHERE prev IS NOT NULL AND length(head) >= 6),
  m AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY head) AS chain_id FROM m0 WHERE n_mentions >= 2)""",
    # Grams of a mention: its two tokens joined, its head, its character 4-grams.
    "g": """g0 AS (SELECT doc_id, chain_id, head, unnest(list_concat([prev || '§' || head, head], CASE WHEN length(text) >= 4
    THEN list_transform(range(1, length(text) - 2), lambda i: substr(text, i, 4)) ELSE [] END)) AS gram FROM m),
  g AS (SELECT doc_id, chain_id, head, gram, count(*) AS cnt FROM g0 GROUP BY ALL),
  ch AS (SELECT doc_id, chain_id, head, count(*) AS n_mentions FROM m GROUP BY ALL)""",
}


def with_(*parts: str) -> str:
    return "WITH " + ",\n  ".join(SQL.get(p, p) for p in parts) + "\n"


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
