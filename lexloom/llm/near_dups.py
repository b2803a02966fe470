"""8. MinHash near-duplicates by a multi-index Hamming join.

Equal shingle sets collapse to one class first. A class has a signature of 16-bit minhashes, split into chunks of PLACES
each. Two signatures that differ in at most 2 * chunks - 1 places have, by the pigeonhole principle, a chunk with at most
one difference; so each chunk gives a key for every place left out, and all pairs under the distance share a key.
Keys are followed up in two steps that never list all pairs of a group:

1. in rounds, each class is held against the nearest, by signature, of the least classes of its keys; links that its full
   set confirms join classes into components;
2. only keys that still hold several components are looked at again: what shares them meets in blocks, on full sets.

A pair whose similarity is just the threshold has two or more differences in all its chunks with a probability that falls
with their number; there are as many as bring it to MISS or below: 8 at 0.85 (5.4e-7 a pair), 10 at 0.8 (1.6e-6). Pairs
that are more alike are missed more rarely still.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import discard, in_batches, stored, table
from lexloom.llm.components import components
from lexloom.llm.tokens import slices

#: Minhashes of a chunk, and the most that the probability may be to miss a pair just at the threshold.
PLACES, MISS = 5, 2e-6
#: Classes on each side that are held against each other at once, and rounds of the first step.
BLOCK, ROUNDS = 512, 2
#: Shingles on each side of a block on average.
BLOCK_SHINGLES = 1 << 20
#: Bytes of the bitmap that tells which documents are in candidate pairs.
BITMAP_BYTES = 32 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.zeros(256, np.uint8)
_LOWER[65:91] = 32


def missed(share: float, chunks: int) -> float:
    """The probability that each chunk of two signatures has two or more differences, at a similarity of share percent."""
    s = share / 100
    return (1 - s**PLACES - PLACES * s ** (PLACES - 1) * (1 - s)) ** chunks


def chunks_for(share: float) -> int:
    """The least number of chunks, four or more, that brings missed() to MISS."""
    chunks = 4
    while missed(share, chunks) > MISS:
        chunks += 1
    return chunks


@lru_cache(maxsize=4)
def _factors(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8)
    return rng.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, k, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text, one text after the other, and the n + 1 bounds.

    Words are what white space (space, 9 to 13) separates, with A-Z in lower case. A text with fewer words than a shingle,
    but at least one, is one shingle; null is the empty text.
    """
    n = len(texts)
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    space = _SPACE[data]
    first = np.zeros(len(data), bool)
    first[bounds[:-1][bounds[:-1] < len(data)]] = True
    first[1:] |= space[:-1]
    first &= ~space
    at = np.cumsum(~space, dtype=np.int64)
    places = at[first] - 1
    body = (data + _LOWER[data])[~space]
    keys = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(np.append(places, len(body)).astype("<i8")), pa.py_buffer(body)])
    coded = keys.dictionary_encode()
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    words = words[coded.indices.to_numpy(zero_copy_only=False)]
    begins = np.append(0, np.cumsum(first, dtype=np.int64))[bounds]  # words before each text
    counts = np.diff(begins)
    each = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.append(0, np.cumsum(each))
    owner = np.repeat(np.arange(n), each)
    start = begins[owner] + np.arange(bounds[-1]) - bounds[owner]
    take = np.minimum(counts, size)[owner]
    hashes = take.astype(np.uint64) * _M1
    for k in range(size):
        more = take > k
        with np.errstate(over="ignore"):
            if more.all():
                hashes = _mixed(hashes + words[start + k]) + _M1
            else:
                hashes[more] = _mixed(hashes[more] + words[start[more] + k]) + _M1
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[bounds[:-1][each > 0]] = True
    return hashes[new], np.append(0, np.cumsum(new))[bounds]


def signatures(hashes: np.ndarray, bounds: np.ndarray, chunks: int) -> np.ndarray:
    """chunks * PLACES 16-bit minhashes for each set that isn't empty, in order."""
    full = np.flatnonzero(np.diff(bounds))
    a, b = _factors(chunks * PLACES)
    out = np.zeros((len(full), len(a)), np.uint16)
    if len(full):
        starts = bounds[full]
        for k in range(len(a)):
            low = np.minimum.reduceat(hashes * a[k] + b[k], starts)
            out[:, k] = (_mixed(low) >> np.uint64(48)).astype(np.uint16)
    return out


def signature_keys(sigs: np.ndarray) -> np.ndarray:
    """As many 64-bit keys for each signature as it has places: of each chunk with one place left out."""
    n, k = sigs.shape
    out = np.empty((n, k), np.uint64)
    wide = sigs.astype(np.uint64).reshape(n, k // PLACES, PLACES)
    for c in range(k // PLACES):
        for p in range(PLACES):
            h = np.full(n, (c * PLACES + p + 1) * 0x51_7C_C1B7_2722_0A95 % 2**64, np.uint64)
            for q in range(PLACES):
                if q != p:
                    h = _mixed((h ^ wide[:, c, q]) * _M1 + np.uint64(q))
            out[:, c * PLACES + p] = h
    return out


def sketched(docs: DataFrame, chunks: int, size: int = 5) -> DataFrame:
    """Of docs (doc_id, text): doc_id, n, a, b (halves of a hash of the shingle set), sig (null for an empty set)."""

    def sketch(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                if not part.num_rows:
                    continue
                hashes, bounds = shingle_sets(part.column("text"), size)
                raw = memoryview(np.ascontiguousarray(hashes).tobytes())
                own = b"".join(xxhash.xxh3_128_digest(raw[8 * x : 8 * y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                a, b = np.frombuffer(own, "<i8").reshape(-1, 2).T
                n = np.diff(bounds)
                sigs = iter(signatures(hashes, bounds, chunks))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array([next(sigs).tobytes() if x else None for x in n.tolist()], pa.binary())], names=["doc_id", "n", "a", "b", "sig"])

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), sketch, "doc_id long, n long, a long, b long, sig binary")


def _signatures(column: pa.Array) -> np.ndarray:
    """Binary signatures, of one length, as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def keyed(classes: DataFrame) -> DataFrame:
    """Of classes (id, sig): (key, id), a row for each place of the signature."""

    def keys(batches):
        for batch in batches:
            if batch.num_rows:
                sigs = _signatures(batch.column("sig"))
                ids = np.repeat(batch.column("id").to_numpy(), sigs.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(signature_keys(sigs).ravel().view(np.int64)), pa.array(ids)], names=["key", "id"])

    return in_batches(classes.select("id", "sig"), keys, "key long, id long")


def confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Those of pairs (u, v) whose sets (id, hashes) have 100 * intersection >= share * union."""

    def links(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = 0
                if 100 * len(x) >= share * len(y):
                    at = np.searchsorted(y, x)
                    at[at == len(y)] = 0
                    both = int((y[at] == x).sum())
                keep.append(100 * both >= share * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(pa.array(keep, pa.bool_())), batch.column("v").filter(pa.array(keep, pa.bool_()))], names=["u", "v"])

    x = sets.select(F.col("id").alias("u"), F.col("hashes").alias("x"))
    y = sets.select(F.col("id").alias("v"), F.col("hashes").alias("y"))
    return in_batches(pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y"), links, "u long, v long")


def linked_in_blocks(members: DataFrame, sets: DataFrame, share: int, block: int = BLOCK, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Of members (part, comp, id, n), all links (u, v) between different components of one part that matter: for each row,
    one to each component that it links with.

    The largest component of a part is its core; all others are held against all rows. Both sides are dealt into blocks,
    and two blocks meet in one task, which counts the shared shingles of all their pairs; it returns links, not pairs. So
    a part of any size takes bounded memory, and rows of the core are never held against each other. Blocks have so many
    rows and so many shingles a side, on average; a text with more shingles than that has a block's memory by itself.
    """
    sizes = members.groupBy("part", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("size"))
    core = F.max(F.struct("n", "comp", "size"))
    parts = sizes.groupBy("part").agg(core.alias("c"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    blocks = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(size / shingles)).cast("int")
    parts = parts.select(F.col("part").alias("p"), F.col("c.comp").alias("core"), blocks(F.col("n"), F.col("size")).alias("rows"), blocks(F.col("n") - F.col("c.n"), F.col("size") - F.col("c.size")).alias("columns"))
    parts = stored(parts, "parts")
    dealt = members.join(parts, F.col("part") == F.col("p"))
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    every = dealt.select("part", F.pmod(F.xxhash64("id"), F.col("rows")).cast("int").alias("i"), numbers("columns").alias("j"), F.lit(False).alias("other"), "comp", "id")
    others = dealt.where(F.col("comp") != F.col("core")).select("part", numbers("rows").alias("i"), F.pmod(F.xxhash64("id", "part"), F.col("columns")).cast("int").alias("j"), F.lit(True).alias("other"), "comp", "id")
    rows = every.union(others).join(sets.withColumnRenamed("id", "sid"), F.col("id") == F.col("sid")).drop("sid")

    def meet(batches):
        held: list[tuple] = []

        def links():
            every, others = [r for r in held if not r[1]], [r for r in held if r[1]]
            if not every or not others:
                return None
            flat = [np.frombuffer(r[4], np.uint64) for r in every]
            own = [np.frombuffer(r[4], np.uint64) for r in others]
            starts = np.append(0, np.cumsum([len(x) for x in flat]))
            names, inverse = np.unique(np.concatenate(flat), return_inverse=True)
            comps, ids = np.array([r[2] for r in every], np.int64), np.array([r[3] for r in every], np.int64)
            sizes = np.diff(starts)
            marks = np.zeros(len(names), np.int32)
            u, v = [], []
            for r, x in zip(others, own, strict=True):
                at = np.minimum(np.searchsorted(names, x), len(names) - 1)
                at = at[names[at] == x]
                marks[at] = 1
                both = np.add.reduceat(marks[inverse], starts[:-1])
                marks[at] = 0
                near = np.flatnonzero((100 * both >= share * (sizes + len(x) - both)) & (comps != r[2]))
                if len(near):
                    _, first = np.unique(comps[near], return_index=True)
                    v += ids[near[first]].tolist()
                    u += [r[3]] * len(first)
            return pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())}) if u else None

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "i", "j", "other", "comp", "id", "hashes")]
            for part, i, j, other, comp, id_, hashes in zip(*columns, strict=True):
                if held and held[0][0] != (part, i, j):
                    if (out := links()) is not None:
                        yield out
                    held.clear()
                held.append(((part, i, j), other, comp, id_, hashes))
        if held and (out := links()) is not None:
            yield out

    return in_batches(rows.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j"), meet, "u long, v long")


def nearest(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    """For each v of pairs (u, v), the pair whose signatures differ least, if in fewer than twice as many places as there are
    chunks: those are the differences within which the chunks guarantee a shared key."""
    x = sig.select(F.col("id").alias("u"), F.col("sig").alias("x"))
    y = sig.select(F.col("id").alias("v"), F.col("sig").alias("y"))

    def close(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (_signatures(batch.column(c)) for c in ("x", "y"))
                far = (x != y).sum(axis=1).astype(np.int32)
                keep = pa.array(far < 2 * (x.shape[1] // PLACES))
                yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep), pa.array(far).filter(keep)], names=["u", "v", "far"])

    found = in_batches(pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y"), close, "u long, v long, far int")
    return found.groupBy("v").agg(F.min(F.struct("far", "u"))["u"].alias("u")).select("u", "v")


def near_duplicates(docs: DataFrame, share: int = 85, size: int = 5, block: int = BLOCK) -> DataFrame:
    """Of docs (doc_id, text): doc_id, n_shingles, component_id, kept, a row for each row.

    Texts without words link with nothing. Rows with a null id link with nothing, and are kept; rows that share an id are
    one document. Equal sets link whatever their size. An empty table gives none. A text of any length is taken whole; its
    shingles must fit a worker's memory.
    """
    spark = docs.sparkSession
    rows = stored(sketched(docs, chunks_for(share), size), "sketches")
    full = rows.where("n > 0 and doc_id is not null")
    classes = stored(full.groupBy("a", "b").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    keys = stored(keyed(classes), "keys")
    least = stored(keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select(F.col("key").alias("k")), "shared-keys")
    shared = stored(keys.join(least, F.col("key") == F.col("k")).select("key", "id"), "shared")
    discard(keys, least)

    sig = classes.select("id", "n", "sig")
    # Which documents are in candidate pairs, as a bitmap of a bounded size over hashed ids; a wrong hit costs one set more.
    bits = BITMAP_BYTES * 8
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    # The bitmap functions number bits from 1.
    parts = shared.select((spot("id") + 1).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m")).collect()
    bitmap = np.zeros(BITMAP_BYTES, np.uint8)
    for r in parts:
        at = (r["b"] - 1) * 4096
        bitmap[at : at + 4096] = np.frombuffer(bytes(r["m"]), np.uint8)[: BITMAP_BYTES - at]
    wanted = spark.sparkContext.broadcast(bitmap.tobytes())

    def sets(batches):
        known = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            h = batch.column("h").to_numpy()
            batch = batch.filter(pa.array((known[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1))
            for part in slices(batch, "text"):
                if part.num_rows:
                    hashes, bounds = shingle_sets(part.column("text"), size)
                    raw = np.ascontiguousarray(hashes).tobytes()
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((bounds * 8).astype("<i8")), pa.py_buffer(raw)]).cast(pa.binary())], names=["id", "hashes"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null").withColumn("h", spot("id"))
    # Of a class, the set of its least document alone; where rows share that id, each has a set, and all are compared.
    found = stored(in_batches(texts, sets, "id long, hashes binary"), "sets")

    links, part_of = None, None
    for turn in range(ROUNDS):
        with_comp = shared.withColumn("comp", F.col("id")) if part_of is None else _labelled(shared, part_of)
        ends = with_comp.groupBy("key").agg(F.min(F.struct("comp", "id")).alias("least"), F.max("comp").alias("most")).where("least.comp < most")
        ends = stored(ends.select(F.col("key").alias("k"), F.col("least.comp").alias("least_comp"), F.col("least.id").alias("u")), f"open-{turn}")
        tries = with_comp.join(ends, F.col("key") == F.col("k")).where("comp <> least_comp").select("u", F.col("id").alias("v")).distinct()
        near = stored(nearest(tries, sig), f"nearest-{turn}")
        more = stored(confirmed(near, found, share), f"links-{turn}")
        discard(near, ends, *([part_of] if part_of is not None else []))
        links = more if links is None else links.union(more)
        part_of = stored(components(links), f"components-{turn}")

    # Keys that still hold several components: what shares them, directly or by others, is a part.
    labelled = _labelled(shared, part_of)
    ends = labelled.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most")
    ends = stored(ends.select(F.col("key").alias("k"), "least"), "open")
    rest = stored(labelled.join(ends, F.col("key") == F.col("k")).select("id", "comp", "least").distinct(), "rest")
    parts = stored(components(rest.select(F.col("least").alias("u"), F.col("comp").alias("v"))), "parts-of")
    members = rest.select("id", "comp").distinct().join(parts, F.col("comp") == F.col("node"), "left").select(F.coalesce("component", "comp").alias("part"), "comp", "id")
    members = members.join(sig.select("id", "n"), "id").select("part", "comp", "id", "n")
    members = stored(members, "members")
    links = links.union(stored(linked_in_blocks(members, found, share, block), "block-links"))
    discard(shared, found, ends, rest, parts, members, part_of)
    part_of = stored(components(links), "components")

    named = classes.join(part_of, F.col("id") == F.col("node"), "left").select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.coalesce("component", "id").alias("class_component"))
    named = stored(named, "named")
    discard(classes, part_of)
    out = rows.join(named, (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    own = F.coalesce("class_component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def _labelled(shared: DataFrame, part_of: DataFrame) -> DataFrame:
    return shared.join(part_of, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("comp"))


def without_near_duplicates(docs: DataFrame, share: int = 80, size: int = 5) -> DataFrame:
    """docs, of each group of near-duplicates the document with the least id. All columns stay as they are."""
    gone = near_duplicates(docs, share, size).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
