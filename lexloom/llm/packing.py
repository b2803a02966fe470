"""6. Best-fit packing: minimum bin slack.

A bin takes the longest piece left, and a bitset subset-sum over the lengths still available finds the fullest combination
that fits beside it. Lengths are at most the capacity, so all that packing needs is how many pieces have each length: a
combination is found once and taken as often as its lengths allow, and the work doesn't depend on the number of pieces.
The pieces then find their places by their rank among those of their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import tokens
from lexloom.llm.common import in_batches, prefix_sums, stored, table

CAPACITY = 4096
#: Pieces that one range of a length holds on average.
ROWS_A_RANGE = 256


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """The (length, number) whose sum comes nearest to room from below. lengths: those with counts, longest first.

    Bit s of the set tells that s can be made; a length that is there n times is added in steps of 1, 2, 4, ... of it.
    Once room itself is made, no further length is looked at.
    """
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in lengths:
        if length > room:
            continue
        n, step = min(counts[length], room // length), 1
        while n > 0:
            take = min(step, n)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            n -= take
            step *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return sorted(chosen.items(), reverse=True)


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many bins, their (length, number)) until every piece has its bin."""
    counts = {k: n for k, n in histogram.items() if n > 0}
    lengths = sorted(counts, reverse=True)
    out = []
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        parts = dict(fullest(counts, lengths, capacity - seed)) if capacity > seed else {}
        counts[seed] += 1
        parts[seed] = parts.get(seed, 0) + 1
        times = min(counts[k] // n for k, n in parts.items())
        for k, n in parts.items():
            counts[k] -= n * times
        if any(not counts[k] for k in parts):
            lengths = [k for k in lengths if counts[k]]
        out.append((times, sorted(parts.items(), reverse=True)))
    return out


def slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first bin, number a bin, offset): where the pieces of a length go by rank."""
    out, bins = [], 0
    used = dict.fromkeys(histogram, 0)
    for times, parts in patterns(histogram, capacity):
        offset = 0
        for length, n in parts:
            out.append((length, used[length], used[length] + n * times, bins, n, offset))
            used[length] += n * times
            offset += length * n
        bins += times
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Of docs (doc_id, text): doc_id, piece, start, length, ids_crc32. A null text is empty, and has its end id alone."""

    def cut(batches):
        enc = tokens.encoder(tokenizer)
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                if not part.num_rows:
                    continue
                ids, places = enc.encode(part.column("text"))
                raw = memoryview(ids.astype("<u4").tobytes())
                sizes = np.diff(places)
                many = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                at = places[row] + start
                sums = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_batches(rows, cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(found: DataFrame, capacity: int = CAPACITY, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """Adds sequence_id and offset to rows (doc_id, piece, start, length, ids_crc32), of lengths from 1 to capacity.

    Equal rows are pieces of their own. Reads its input once and stores it. The driver gets the number of pieces of each
    length, at most `capacity` rows, and sends the places back, a few rows for each length.
    """
    spark = found.sparkSession
    found = stored(found, "pieces")
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    lot = spark.createDataFrame([(k, -(-n // rows_a_range)) for k, n in histogram.items()], "length long, __ranges long")
    ranged = found.join(F.broadcast(lot), "length").withColumn("__range", F.pmod(F.xxhash64("doc_id", "piece"), F.col("__ranges"))).withColumn("__one", F.lit(1).cast("long"))
    ranked = prefix_sums(ranged, ["length"], ["doc_id", "piece", "ids_crc32"], "__one", "__range", "__rank")
    places = spark.createDataFrame(slots(histogram, capacity), "s_length long, s_from long, s_to long, s_bin long, s_n long, s_offset long")
    fits = (F.col("length") == F.col("s_length")) & (F.col("__rank") >= F.col("s_from")) & (F.col("__rank") < F.col("s_to"))
    nth = F.col("__rank") - F.col("s_from")
    return ranked.join(F.broadcast(places), fits).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("s_bin") + F.floor(nth / F.col("s_n")).cast("long")).alias("sequence_id"),
        (F.col("s_offset") + nth % F.col("s_n") * F.col("length")).alias("offset"),
    )


def op6_pack(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), tokenizer or tokens.default_path()))
