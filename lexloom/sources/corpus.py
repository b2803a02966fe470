"""A: reading documents, files and records."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import text as X



@lru_cache
def parsed(ddl: str) -> T.StructType:
    """The schema; parsing one needs a session."""
    return T.StructType.fromDDL(ddl)


#: Tables of the engine.
DOCUMENTS = "doc_id string, uri string, created_at timestamp, text_length int, full_text string"
MENTION = "struct<text:string,start_char:int,end_char:int,is_pronoun:boolean,sent_id:int>"
SENTENCES = (
    "doc_id string, sentence_id int, start int, end int, text string, label int, confidence double, consensus string, "
    "token_analysis struct<tokens:array<struct<token:string,importance:double,start_char:int,end_char:int>>,max_importance:double,num_tokens:int>, "
    "span_analysis array<struct<rank:int,text:string,start_char:int,end_char:int,importance:double,chain_id:int>>"
)
CHAINS = f"doc_id string, chain_id int, representative string, mentions array<{MENTION}>, edges array<struct<antecedent:int,anaphor:int,tag:string>>"
CLUSTERS = "doc_id string, cluster_id int, members array<int>"
EMBEDDINGS = "doc_id string, sentence_id int, model string, dim int, vector array<float>"
GRAMS = "doc_id string, chain_id int, head string, gram string, cnt bigint"
COOC_EDGES = "doc_id string, row_tok string, col_tok string, ppmi double"
#: A record of a processed document; both spellings of what has two.
RECORD = (
    "doc_id string, full_text string, sentence_analyses array<struct<sentence_id:int,sentence_text:string,text:string,doc_start:int,doc_end:int,start:int,end:int,"
    "classification:struct<label:int,class_id:int,confidence:double,score:double,consensus:string>>>, "
    f"coreference_analysis struct<chains:array<struct<chain_id:int,representative:string,mentions:array<{MENTION}>>>>, cluster_analysis struct<clusters:array<array<int>>>"
)


def files(spark: SparkSession, folder: str, pattern: str = "*.{pdf,PDF}", limit: int | None = None) -> DataFrame:
    """(path, length, modificationTime, content) of the files below a folder, each once, as one scan lists them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.orderBy("path").limit(limit) if limit else found


def pages(found: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page_no, original, cleaned) by a plug-in that gives the page texts of a file's bytes.

    Files that don't begin as PDFs, and ones that the plug-in fails on, have no pages. Page numbers begin with 1.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                if bytes(content[:5]).startswith(b"%PDF-"):
                    try:
                        rows += [(path, i, t) for i, t in enumerate(extract(bytes(content)), 1)]
                    except ValueError:
                        continue
            yield pd.DataFrame(rows, columns=["path", "page_no", "original"])

    read = found.select("path", "content").mapInPandas(each, "path string, page_no int, original string")
    return read.withColumn("cleaned", X.without_citations(X.without_artifacts(F.col("original"))))


def paged_text(rows: DataFrame) -> DataFrame:
    """(path, text): a file's pages under their headings, in order."""
    one = F.concat(F.lit("## Page "), F.col("page_no").cast("string"), F.lit("\n\n"), F.col("cleaned"))
    return rows.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", one.alias("t")))), lambda p: p["t"]), "\n\n").alias("text"))


def files_for_dois(dois: DataFrame, names: DataFrame) -> DataFrame:
    """(doi, name) of files (name) with a variant of the DOI in their name, each once.

    Names are cut into runs of letters and digits, and so are variants; both share the longest run of the variant, by which
    they meet, before the variant is looked for.
    """
    runs = lambda c: F.regexp_extract_all(c, F.lit("[0-9A-Za-z]+"), F.lit(0))
    v = dois.select("doi", F.explode(X.doi_variants(F.col("doi"))).alias("v"))
    inner = F.filter(F.transform(runs(F.col("v")), lambda r, i: F.struct(F.length(r).alias("n"), r.alias("r"))), lambda x: x["n"] > 0)
    # A run at the end of a variant may go on in the name; those strictly within can't, and serve as keys where there are any.
    within = F.slice(inner, F.lit(2), F.greatest(F.lit(0), F.size(inner) - 2))
    keyed = v.withColumn("key", F.array_max(within)["r"])
    n = names.where(F.lower("name").rlike(r"\.(pdf|txt)$"))
    first = keyed.where("key is not null").join(n.select("name", F.explode(F.array_distinct(runs(F.col("name")))).alias("key")), "key").where(F.contains("name", "v"))
    # DOIs that callers ask for are few; those without an inner run meet all names.
    rest = keyed.where("key is null").join(n, F.contains("name", "v"))
    return first.select("doi", "name").union(rest.select("doi", "name")).distinct()


def first_by_key(names: DataFrame) -> DataFrame:
    """Of (pos, name), the first file of each DOI or slug."""
    return names.withColumn("key", X.file_key(F.col("name"))).groupBy("key").agg(F.min(F.struct("pos", "name")).alias("f")).select("key", "f.*")


def csv_rows(spark: SparkSession, path: str, claim: str, dois: str | None = None) -> DataFrame:
    """(row, claim, dois) of a CSV file."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    listed = X.doi_list(F.col(dois)) if dois else F.array().cast("array<string>")
    return rows.select(F.col(claim).alias("claim"), listed.alias("dois"))


def records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Processed documents from JSON, whether bare, or in production_output: a file each, or, with lines, a line each."""
    record = parsed(RECORD)
    wrapped = T.StructType([*record.fields, T.StructField("production_output", record)])
    rows = spark.read.schema(wrapped).option("multiLine", str(not lines).lower()).json(path)
    return rows.select(*[F.coalesce(F.col(f"production_output.{f.name}"), F.col(f.name)).alias(f.name) for f in record.fields])


def record_sentences(rows: DataFrame) -> DataFrame:
    """(doc_id, sentence_id, start, end, text, label, confidence, consensus), whichever way they are spelled."""
    s = rows.select("doc_id", F.posexplode("sentence_analyses").alias("pos", "s"))
    return s.select(
        "doc_id",
        F.coalesce("s.sentence_id", "pos").alias("sentence_id"),
        F.coalesce("s.doc_start", "s.start").alias("start"),
        F.coalesce("s.doc_end", "s.end").alias("end"),
        F.coalesce("s.sentence_text", "s.text").alias("text"),
        F.coalesce("s.classification.label", "s.classification.class_id").alias("label"),
        F.coalesce("s.classification.confidence", "s.classification.score").alias("confidence"),
        F.col("s.classification.consensus").alias("consensus"),
    )


def record_chains(rows: DataFrame) -> DataFrame:
    """(doc_id, chain_id, representative, mentions), without mentions of no extent."""
    c = rows.select("doc_id", F.posexplode("coreference_analysis.chains").alias("pos", "c"))
    return c.select("doc_id", F.coalesce("c.chain_id", "pos").alias("chain_id"), "c.representative", valid_mentions(F.col("c.mentions")).alias("mentions"))


def valid_mentions(mentions: Column) -> Column:
    return F.filter(mentions, lambda m: (m["start_char"] >= 0) & (m["start_char"] < m["end_char"]))


def record_clusters(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.posexplode("cluster_analysis.clusters").alias("cluster_id", "members"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, uri, text) of whole text files, by their stem."""
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(folder).select(F.input_file_name().alias("uri"), F.col("value").alias("text"))
    return rows.select(F.regexp_extract("uri", r"([^/]+)\.txt$", 1).alias("doc_id"), "uri", "text")


def sliced(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, sentence_id, text): spans of files cut out of their texts; empty ones go."""
    joined = spans.join(documents.select("doc_id", F.col("text").alias("t")), "doc_id")
    return joined.select("doc_id", "sentence_id", F.trim(F.substring("t", F.col("start") + 1, F.col("end") - F.col("start"))).alias("text")).where("text <> ''")
