"""10. Line dedup: every line that several documents hold stays in the first of them alone.

Two Bloom filters, of hashes seen once and seen twice, are filled by each task over its documents and merged slice by
slice. A line whose hash isn't in the second filter is in one document only; just the others, the suspects, are shuffled
for exact confirmation and for the choice of the first document. The filters have a bounded size: beyond its capacity more
lines are suspects, and the result stays the same.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import bloom
from lexloom.llm.common import fresh_path, in_batches, stored, table
from lexloom.llm.files import opened, shard_name
from lexloom.llm.tokens import slices

#: Code points that a key needs to count.
LEAST = 10
#: Bytes of each filter at most; the second is broadcast.
FILTER_BYTES = 32 << 20
#: Bytes of a filter that are merged at once.
SLICE_BYTES = 64 << 10
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SPACE = " \t\n\v\f\r"


def key(line: str) -> str:
    """The line without white space (space, 9 to 13) at both ends, A-Z in lower case."""
    line = line.strip(_SPACE)
    return line.lower() if line.isascii() else line.translate(_FOLD)


def hashed(keys: list[str]) -> np.ndarray:
    """Two rows of 64-bit halves of a 128-bit hash."""
    raw = b"".join(xxhash.xxh3_128_digest(x) for x in keys)
    return np.frombuffer(raw, "<u8").reshape(-1, 2).T


def _texts(batches, *columns: str):
    """The texts of a part of a batch, with the values of other columns."""
    for batch in batches:
        for part in slices(batch, "text"):
            yield part.column("text").to_pylist(), *(part.column(c).to_pylist() for c in columns)


def seen_twice(docs: DataFrame, folder: str, bits: int, least: int) -> bytes:
    """The merged second filter. Tasks leave their filters in the folder, in slices; each slice is merged by one task,
    one file at a time, so memory doesn't depend on how many tasks there were."""
    step = min(SLICE_BYTES, bits // 8)

    def fill(batches):
        pair = bloom.Pair(bits)
        for (texts,) in _texts(batches):
            keys = []
            for text in texts:
                own = {k for k in map(key, (text or "").split("\n")) if len(k) >= least}
                keys += own
            if keys:
                pair.add(hashed(keys)[0].copy())
        files, root = opened(folder)
        files.create_dir(root, recursive=True)
        name, at, places = shard_name(".bloom"), 0, []
        with files.open_output_stream(f"{root}/{name}") as sink:
            for a in range(0, bits // 8, step):
                data = zlib.compress(pair.once[a : a + step].tobytes() + pair.twice[a : a + step].tobytes(), 1)
                sink.write(data)
                places.append((a // step, at, len(data)))
                at += len(data)
        yield pa.RecordBatch.from_pydict({"slice": pa.array([x[0] for x in places], pa.int32()), "file": [name] * len(places), "at": pa.array([x[1] for x in places], pa.int64()), "size": pa.array([x[2] for x in places], pa.int64())})

    def join(batches):
        files, root = opened(folder)
        current, once, twice = None, None, None
        for batch in batches:
            for number, name, at, size in zip(*(batch.column(c).to_pylist() for c in ("slice", "file", "at", "size")), strict=True):
                with files.open_input_file(f"{root}/{name}") as file:
                    data = np.frombuffer(zlib.decompress(file.read_at(size, at)), np.uint8)
                if number != current:
                    if current is not None:
                        yield pa.RecordBatch.from_pydict({"slice": pa.array([current], pa.int32()), "twice": [twice.tobytes()]})
                    current, once, twice = number, np.zeros(step, np.uint8), np.zeros(step, np.uint8)
                bloom.merge(once, twice, data[:step], data[step:])
        if current is not None:
            yield pa.RecordBatch.from_pydict({"slice": pa.array([current], pa.int32()), "twice": [twice.tobytes()]})

    filled = stored(in_batches(docs.select("text"), fill, "slice int, file string, at long, size long"), "filters")
    merged = in_batches(filled.repartition("slice").sortWithinPartitions("slice"), join, "slice int, twice binary")
    out = bytearray(bits // 8)
    for row in stored(merged, "filter").collect():
        out[row["slice"] * step : row["slice"] * step + step] = row["twice"]
    return bytes(out)


def repeated_lines(docs: DataFrame, least: int = LEAST, filter_bytes: int = FILTER_BYTES) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, text): the suspects (doc_id, a, b), and the repeated keys (a, b, first_doc).

    a and b are the halves of the key's 128-bit hash. Equal keys of one document, or of rows with one id, count once.
    Rows with a null id have no place in the order: their lines don't count, and all of them stay.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    lines = docs.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n")).first()["n"] or 0
    bits = bloom.bits_for(lines, filter_bytes)
    twice = spark.sparkContext.broadcast(seen_twice(docs, fresh_path(spark, "bloom"), bits, least))

    def suspects(batches):
        known = np.frombuffer(twice.value, np.uint8)
        for texts, ids in _texts(batches, "doc_id"):
            keys, owners = [], []
            for text, doc in zip(texts, ids, strict=True):
                own = list({k for k in map(key, text.split("\n")) if len(k) >= least})
                keys += own
                owners += [doc] * len(own)
            if keys:
                a, b = hashed(keys)
                at = np.flatnonzero(bloom.has(known, bloom.positions(a.copy(), bits)))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(owners, np.int64)[at]), pa.array(a[at].view(np.int64)), pa.array(b[at].view(np.int64))], names=["doc_id", "a", "b"])

    found = stored(in_batches(docs, suspects, "doc_id long, a long, b long"), "suspects")
    confirmed = found.groupBy("a", "b").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc").drop("last_doc")
    # Stored, so that in a join both sides are plain shuffles, of which Spark can split those of a very common line.
    return found, stored(confirmed, "repeated")


def dropped_lines(docs: DataFrame, least: int = LEAST, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, drop: the hashes (16 bytes each, one after the other) of the keys whose lines leave the document.

    A document has as many at most as it has lines.
    """
    found, confirmed = repeated_lines(docs, least, filter_bytes)
    return found.join(confirmed, ["a", "b"]).where("doc_id > first_doc").groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("drop"))


def without_repeats(docs: DataFrame, least: int = LEAST, filter_bytes: int = FILTER_BYTES, digest: bool = False) -> DataFrame:
    """docs (with doc_id, text and any other columns) without repeated lines; n_chars, if there, follows the text.

    With digest: doc_id, n_lines, n_dropped and kept_sha256 in place of the columns. A null text is one empty line, and
    stays null in documents.
    """
    every = list(docs.columns)
    drops = dropped_lines(docs, least, filter_bytes).withColumnRenamed("doc_id", "__doc").withColumnRenamed("drop", "__drop")
    keyed = docs.withColumn("__id", F.col("doc_id").cast("long"))
    joined = keyed.join(drops, F.col("__id") == F.col("__doc"), "left").drop("__doc", "__id")

    def kept(text: str | None, drop) -> tuple[list[str], int]:
        lines = (text or "").split("\n")
        if not drop:
            return lines, 0
        gone = {(x["a"] & (2**64 - 1), x["b"] & (2**64 - 1)) for x in drop}
        stay = []
        for line in lines:
            k = key(line)
            if len(k) >= least:
                raw = xxhash.xxh3_128_digest(k)
                if (int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:], "little")) in gone:
                    continue
            stay.append(line)
        return stay, len(lines) - len(stay)

    def told(batches):
        for texts, ids, drops in _texts(batches, "doc_id", "__drop"):
            rows = [kept(t, d) for t, d in zip(texts, drops, strict=True)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()),
                "n_lines": pa.array([len(r) + n for r, n in rows], pa.int64()),
                "n_dropped": pa.array([n for _, n in rows], pa.int64()),
                "kept_sha256": [hashlib.sha256("\n".join(r).encode()).hexdigest() for r, _ in rows],
            })

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                drops = part.column("__drop").to_pylist()
                texts = ["\n".join(kept(t, d)[0]) if d else t for t, d in zip(texts, drops, strict=True)]
                columns = {c: part.column(c) for c in every}
                columns["text"] = pa.array(texts, pa.string())
                if "n_chars" in columns:
                    lengths = pc.utf8_length(columns["text"]).cast(columns["n_chars"].type)
                    columns["n_chars"] = pc.if_else(pa.array([bool(d) for d in drops], pa.bool_()), lengths, columns["n_chars"])
                yield pa.RecordBatch.from_pydict(columns)

    if digest:
        return in_batches(joined.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "__drop"), told, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    return in_batches(joined.select(*every, "__drop"), cut, docs.schema)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), digest=True)


ORACLE = {
    "op10_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
r AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.doc_id, k.i, k.line, coalesce(k.doc_id <> r.first_doc, false) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
}
