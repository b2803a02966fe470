"""A: the engine's tables: definition, migration, keyed upserts, loading, statistics, sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.sources import corpus as C

SCHEMAS = {"documents": C.DOCUMENTS, "sentences": C.SENTENCES, "chains": C.CHAINS, "clusters": C.CLUSTERS, "embeddings": C.EMBEDDINGS, "grams": C.GRAMS, "cooc_edges": C.COOC_EDGES}
KEYS = {"documents": ["doc_id"], "sentences": ["doc_id", "sentence_id"], "chains": ["doc_id", "chain_id"], "clusters": ["doc_id", "cluster_id"], "embeddings": ["doc_id", "sentence_id", "model"], "grams": ["doc_id", "chain_id", "gram"], "cooc_edges": ["doc_id", "row_tok", "col_tok"]}


def migrated(rows: DataFrame, ddl: str) -> DataFrame:
    """Rows as the schema has them: cast, with nulls for columns that lack; text_length follows the text."""
    schema = C.parsed(ddl)
    have = {c.lower() for c in rows.columns}
    out = rows.select(*[(F.col(f.name).cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
    if {"text_length", "full_text"} <= {f.name for f in schema.fields}:
        out = out.withColumn("text_length", F.coalesce("text_length", F.length("full_text")))
    return out


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Old rows whose key isn't among the new, and the new; of new rows with one key, the last by `order`."""
    if order:
        new = new.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__k = 1").drop("__k")
    else:
        new = new.dropDuplicates(keys)
    return old.join(new.select(*keys), keys, "left_anti").select(*new.columns).unionByName(new)


class Store:
    """Tables below a folder, each a Parquet table in a version of its own; a pointer names the one that counts.

    A write makes a new version first and moves the pointer after, so a reader, or a run that fails, never sees half of it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self, name: str) -> str:
        return f"{self.root}/{name}/current.txt"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def read(self, name: str) -> DataFrame:
        files, p = self._fs(self._pointer(name))
        if not files.exists(p):
            return self.spark.createDataFrame([], SCHEMAS[name])
        version = self.spark.read.text(self._pointer(name)).first()[0]
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}/{version}")

    def write(self, name: str, rows: DataFrame) -> None:
        version = uuid.uuid4().hex
        migrated(rows, SCHEMAS[name]).write.parquet(f"{self.root}/{name}/{version}")
        files, p = self._fs(self._pointer(name))
        _, fresh = self._fs(self._pointer(name) + f".{version}")
        out = files.create(fresh, True)
        out.write(bytearray(version.encode()))
        out.close()
        files.delete(p, False)
        files.rename(fresh, p)

    def upsert(self, name: str, rows: DataFrame, order: str | None = None) -> None:
        new = migrated(rows, SCHEMAS[name]) if not order else rows
        self.write(name, upserted(self.read(name), new, KEYS[name], order))

    def replace(self, name: str, ids: DataFrame, rows: DataFrame) -> None:
        """All rows of the documents (doc_id) in ids give way to these; those of others stay."""
        new = migrated(rows, SCHEMAS[name])
        self.write(name, self.read(name).join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*new.columns).unionByName(new))

    def embed(self, sents: DataFrame, model: str, load: Callable, batch: int = 256) -> None:
        """Vectors of sentences (doc_id, sentence_id, text) by a model that load() gives; empty ones are left out."""
        from lexloom.operators.models import encoded

        rows = encoded(sents.select("doc_id", "sentence_id", "text"), "text", load, batch=batch).where("vector is not null and size(vector) > 0")
        self.upsert("embeddings", rows.select("doc_id", "sentence_id", F.lit(model).alias("model"), F.size("vector").alias("dim"), "vector"))

    def vectors(self, sents: DataFrame, model: str, load: Callable) -> DataFrame:
        """(doc_id, sentence_id, vector) of sentences: the stored vectors, and the others, which are made and stored."""
        have = lambda: self.read("embeddings").where(F.col("model") == model).select("doc_id", "sentence_id", "vector")
        wanted = sents.withColumn("doc_id", F.col("doc_id").cast("string"))
        self.embed(wanted.join(have(), ["doc_id", "sentence_id"], "left_anti"), model, load)
        return have().join(wanted.select("doc_id", "sentence_id"), ["doc_id", "sentence_id"])

    def tables(self) -> list[tuple[str, int, int]]:
        """The tables that an opened store has, with their columns and rows."""
        return [(name, len(C.parsed(ddl).fields), self.read(name).count()) for name, ddl in SCHEMAS.items()]

    def export(self, records: DataFrame, uri: str | None = None) -> None:
        """A record's document, sentences, chains and clusters."""
        sents = C.record_sentences(records)
        joined = sents.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sentence_id", "text"))), lambda s: s["text"]), " ").alias("j"))
        docs = records.select("doc_id", "full_text").join(joined, "doc_id", "left").select("doc_id", F.lit(uri).alias("uri"), F.current_timestamp().alias("created_at"), F.coalesce("full_text", "j").alias("full_text"))
        self.upsert("documents", docs.withColumn("text_length", F.length("full_text")))
        self.upsert("sentences", sents)
        self.upsert("chains", C.record_chains(records))
        self.upsert("clusters", C.record_clusters(records))

    def load(self, doc_id: str) -> DataFrame:
        """The nested record of one document."""
        return assembled(self.read("documents").where(F.col("doc_id") == doc_id), self.read("sentences"), self.read("chains"))


def assembled(docs: DataFrame, sents: DataFrame, chains: DataFrame) -> DataFrame:
    """(doc_id, full_text, sentences, chains): parts in the order of their numbers; a null text is that of the
    sentences."""
    s = sents.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sentence_id", "start", "end", "text"))).alias("sentences"))
    c = chains.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chain_id", "representative"))).alias("chains"))
    out = docs.select("doc_id", "full_text").join(s, "doc_id", "left").join(c, "doc_id", "left")
    return out.withColumn("full_text", F.coalesce("full_text", F.array_join(F.transform("sentences", lambda x: x["text"]), " ")))


def index_sizes(index: DataFrame, k: int) -> DataFrame:
    """(doc_id, size): the k documents with most rows in an index, ties by id."""
    return index.groupBy("doc_id").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "doc_id").limit(k)


def with_metadata(rows: DataFrame, meta: DataFrame, path: str, columns: list[str], order: str) -> DataFrame:
    """Rows with columns of the first metadata row, by `order`, of the same path (trimmed, with forward slashes);
    others keep what they have."""
    plain = lambda c: F.replace(F.trim(F.col(c)), F.lit("\\"), F.lit("/"))
    first = meta.withColumn("__p", plain(path)).withColumn("__k", F.row_number().over(Window.partitionBy("__p").orderBy(order))).where("__k = 1")
    first = first.select("__p", *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.withColumn("__r", plain(path)).join(first, F.col("__r") == F.col("__p"), "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def uploaded(files: DataFrame, root: str) -> DataFrame:
    """Files (name, content) kept below a folder under the hash of what they hold, so that a file has one place however
    often it comes: (name, path, length). What is there already is written again, and so comes back where it was lost."""
    named = files.select("name", "content", F.sha2("content", 256).alias("key"))
    named.groupBy("key").agg(F.first("content").alias("content")).withColumn("shard", F.substring("key", 1, 2)).write.mode("overwrite").partitionBy("shard").parquet(f"{root}/uploads")
    return named.select("name", F.concat(F.lit("uploads/"), "key").alias("path"), F.length("content").alias("length"))


def write_texts(docs: DataFrame, root: str, lang: str = "lang") -> None:
    """A text column, by language, and the documents' metadata as CSV."""
    docs.select(lang, F.replace("text", F.lit("\n"), F.lit("\\n")).alias("value")).write.mode("overwrite").partitionBy(lang).text(f"{root}/texts")
    docs.select("doc_id", lang, F.length("text").alias("text_length")).write.mode("overwrite").option("header", "true").csv(f"{root}/file_metadata")


def write_evidence(result: DataFrame, evidence: DataFrame, prefix: str) -> None:
    """Nested JSON, and flat CSV."""
    result.write.mode("overwrite").json(f"{prefix}_result")
    evidence.write.mode("overwrite").option("header", "true").csv(f"{prefix}_evidence")


def write_graph(nodes: DataFrame, edges: DataFrame, meta: DataFrame, root: str) -> None:
    """Nodes with a short label, edges with a width, and metadata, as JSON."""
    nodes.withColumn("label", F.substring("text", 1, 140)).write.mode("overwrite").json(f"{root}/nodes")
    edges.withColumn("width", 1 + 3 * F.col("score")).write.mode("overwrite").json(f"{root}/edges")
    meta.write.mode("overwrite").json(f"{root}/meta")
