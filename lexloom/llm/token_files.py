"""3. Token files: ids of fixed width, bit-packed in blocks, with offsets of blocks and documents.

A shard holds
- 8 bytes: the magic;
- the blocks, each with its ids packed in the least number of bits that holds every id of the vocabulary, the first id in
  the lowest bits, filled up to a whole byte;
- block offsets (blocks + 1), document starts (documents + 1) and document ids, 8 bytes each, and a byte for each document
  that tells whether its id is null;
- 56 bytes: the magic, bits an id, ids a block, ids, documents, blocks, and where the offsets begin, 8 bytes each.

Numbers are little-endian. What describes the file stands at its end, as a stream can't go back.

Any block unpacks by itself with numpy, and any id is found from its number alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm import tokens
from lexloom.llm.common import fresh_path, in_batches, stored, table
from lexloom.llm.files import opened, shard_name

MAGIC = int.from_bytes(b"LXTOKEN1", "little")
BLOCK = 1 << 16


def width(vocabulary: int) -> int:
    """The least bits that hold every id below vocabulary, and the end id."""
    return max(1, int(max(vocabulary - 1, tokens.END)).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return each.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class ShardWriter:
    def __init__(self, sink, bits: int, block: int = BLOCK):
        self.sink, self.bits, self.block = sink, bits, block
        self.rest: list[np.ndarray] = []
        self.held = self.n_ids = 0
        self.at = 8
        self.blocks = [8]
        self.starts, self.doc_ids, self.nulls = [np.zeros(1, np.int64)], [], []
        self.sink.write(MAGIC.to_bytes(8, "little"))

    def add(self, ids: np.ndarray, places: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray) -> None:
        """Documents that follow: their ids, and the n + 1 places where documents begin in them."""
        self.starts.append(places[1:] + self.n_ids)
        self.doc_ids.append(doc_ids)
        self.nulls.append(nulls)
        self.n_ids += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            every = np.concatenate(self.rest)
            whole = len(every) // self.block * self.block
            for a in range(0, whole, self.block):
                self._write(every[a : a + self.block])
            self.rest, self.held = [every[whole:].copy()], len(every) - whole

    def _write(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.sink.write(data)
        self.at += len(data)
        self.blocks.append(self.at)

    def close(self) -> None:
        if self.held:
            self._write(np.concatenate(self.rest))
        docs = np.concatenate(self.doc_ids) if self.doc_ids else np.zeros(0, np.int64)
        nulls = np.concatenate(self.nulls) if self.nulls else np.zeros(0, np.uint8)
        for x in (np.array(self.blocks), np.concatenate(self.starts), docs):
            self.sink.write(x.astype("<i8").tobytes())
        self.sink.write(nulls.astype(np.uint8).tobytes())
        self.sink.write(np.array([MAGIC, self.bits, self.block, self.n_ids, len(docs), len(self.blocks) - 1, self.at], "<u8").tobytes())
        self.sink.close()


class ShardReader:
    """Random access to one shard."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = file.read_at(56, size - 56)
        magic, self.bits, self.block, self.n_ids, n_docs, n_blocks, at = (int(x) for x in np.frombuffer(tail, "<u8"))
        if magic != MAGIC:
            raise ValueError("not a token file")
        index = file.read_at(size - 56 - at, at)
        words = np.frombuffer(index, "<i8", n_blocks + 1 + n_docs + 1 + n_docs)
        self.offsets, self.starts, self.doc_ids = np.split(words, [n_blocks + 1, n_blocks + n_docs + 2])
        self.nulls = np.frombuffer(index, np.uint8, n_docs, offset=8 * len(words))

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        data = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        parts = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            part = data[int(self.offsets[b] - self.offsets[first]) : int(self.offsets[b + 1] - self.offsets[first])]
            parts.append(unpack(part, self.bits, n))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self, at_once: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray]]:
        """First document, ids before it, and the ids of as many documents as have about at_once ids."""
        n, a = len(self.doc_ids), 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + at_once, "right")) - 1)
            yield a, b, self.read(int(self.starts[a]), int(self.starts[b]))
            a = b


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, block: int = BLOCK) -> DataFrame:
    """Writes the texts of docs (doc_id, text) as shards below folder, in ascending doc_id order over all shards.

    Null ids come first, equal ids in any order, a null text is empty. Returns the stored manifest: a row for each shard,
    with shard, file, n_ids, n_docs and base, the number of ids in all shards before it.
    """
    spark = docs.sparkSession

    def write(batches):
        from pyspark import TaskContext

        enc = tokens.encoder(tokenizer)
        files, root = opened(folder)
        files.create_dir(root, recursive=True)
        name, writer, n_docs = shard_name(".ids"), None, 0
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                if not part.num_rows:
                    continue
                if writer is None:
                    writer = ShardWriter(files.open_output_stream(f"{root}/{name}"), width(enc.vocabulary), block)
                ids, places = enc.encode(part.column("text"))
                doc = part.column("doc_id")
                writer.add(ids, places, pc.fill_null(doc, 0).to_numpy(zero_copy_only=False).astype(np.int64), doc.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
                n_docs += part.num_rows
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int64()), "file": [name], "n_ids": pa.array([writer.n_ids], pa.int64()), "n_docs": pa.array([n_docs], pa.int64())})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    manifest = stored(in_batches(ordered, write, "shard long, file string, n_ids long, n_docs long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return stored(manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "bases")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Of every document in the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def read(batches):
        files, root = opened(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with files.open_input_file(f"{root}/{name}") as file:
                    shard = ShardReader(file)
                    for a, b, ids in shard.documents():
                        at = shard.starts[a : b + 1] - shard.starts[a]
                        raw = memoryview(ids.astype("<u4").tobytes())
                        sums = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(shard.doc_ids[a:b], pa.int64(), mask=shard.nulls[a:b].astype(bool)), pa.array(shard.starts[a:b] + base, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(sums, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return in_batches(manifest.select("file", "base").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer or tokens.default_path())
    return read_token_files(manifest, folder)
