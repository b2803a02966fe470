"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing to target weights, packing.

Each stage takes the documents that the one before kept, and returns documents with the same columns; the last returns
the packed pieces. A stage's result is written before the next one reads it.

In all stages a null text is empty, a null source is a source, and an empty table gives an empty one; texts of any length are
taken whole; columns beyond doc_id, text, source and n_chars pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import line_dedup, mixing, near_dups, packing, quality, tokens
from lexloom.llm.common import stored, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """4: documents that pass, without lines that are too frequent in their host.

    Empty texts fail, and go. Equal rows are one document in what is counted, and all stay or all go.
    """
    return quality.cleaned(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """10: a line of several documents stays in the first of them.

    Rows with one id are one document; those with a null id keep all their lines, which count for nothing.
    """
    return line_dedup.without_repeats(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """8: of near-duplicates, at a similarity of 0.8 or more, the first stays.

    Ties go to the smallest id. Rows with one id are one document, and all stay or all go; texts without words and rows with a
    null id stay. A pair at just 0.8 is missed with a probability of 1.6e-6.
    """
    return near_dups.without_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """1: documents as often as the mix takes them, the last cut where a source's budget ends.

    Texts without words take no budget, and go. Repeated rows are rows of their own.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """6: pieces of the documents, and their places in sequences.

    An empty text has a piece of one token. Repeated rows have pieces of their own.
    """
    return packing.pack(packing.pieces(docs, tokens.default_path()))


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]

#: Shingle sets, token ids and packing are beyond SQL; a brute-force version stands in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
