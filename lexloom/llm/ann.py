"""2. Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are dealt into shards of a bounded size. A shard's graph is built in bulk: each vector draws a level, the members
of a level are linked to diverse near neighbours (a neighbour nearer to one already chosen than to the vector itself is
passed over), and links go both ways. Vectors and neighbours are kept as flat arrays, a stored row for each shard. Queries
come in blocks: all of a block descend a shard's levels together, from the top one's entry point, and spread over the
lowest level with a beam. A shard stays in its task, and blocks of queries pass through it. The best of each shard are
merged, with exact scores of the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import in_batches, stored, table

#: Vectors of a shard on average, links of a vector, beam of a search, queries of a block.
SHARD, LINKS, BEAM, QUERIES = 4096, 16, 96, 512
TOP = 5


def levels(n: int, seed: int, links: int = LINKS) -> np.ndarray:
    """A level for each of n vectors, each with probability 1 / links of that before."""
    draw = np.random.default_rng(seed).random(n)
    return np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(links)).astype(np.int32)


def _linked(unit: np.ndarray, members: np.ndarray, links: int) -> np.ndarray:
    """Neighbours (numbers within the shard, -1 for none) of each member among the members, 2 * links at most."""
    n = len(members)
    out = np.full((n, 2 * links), -1, np.int32)
    if n < 2:
        return out
    x = unit[members]
    near = min(n - 1, 3 * links)
    chosen: list[np.ndarray] = []
    for a in range(0, n, 512):
        score = x[a : a + 512] @ x.T
        score[np.arange(len(score)), np.arange(a, a + len(score))] = -2
        found = np.argpartition(-score, near - 1, axis=1)[:, :near]
        order = np.argsort(-np.take_along_axis(score, found, 1), axis=1, kind="stable")
        found = np.take_along_axis(found, order, 1)
        value = np.take_along_axis(score, found, 1)
        between = np.einsum("bid,bjd->bij", x[found], x[found], optimize=True)
        keep = np.zeros(found.shape, bool)
        for k in range(near):
            nearer = (between[:, k, :] > value[:, k, None]) & keep
            keep[:, k] = ~nearer.any(axis=1) & (keep.sum(axis=1) < links)
        # Room that diversity leaves goes to the nearest of the rest.
        spare = links - keep.sum(axis=1)
        rest = ~keep
        keep |= rest & (np.cumsum(rest, axis=1) <= spare[:, None])
        chosen += [f[k] for f, k in zip(found, keep, strict=True)]
    sources = np.repeat(np.arange(n), [len(c) for c in chosen])
    targets = np.concatenate(chosen)
    # Both ways; a vector keeps its own choice, and of those that chose it the nearest, as far as there is room.
    score = np.einsum("nd,nd->n", x[sources], x[targets])
    u = np.concatenate([sources, targets])
    v = np.concatenate([targets, sources])
    own = np.concatenate([np.zeros(len(sources)), np.ones(len(targets))])
    order = np.lexsort((-np.concatenate([score, score]), own, u))
    u, v = u[order], v[order]
    _, first = np.unique(u.astype(np.int64) * n + v, return_index=True)
    keep = np.zeros(len(u), bool)
    keep[first] = True
    u, v = u[keep], v[keep]
    starts = np.searchsorted(u, np.arange(n))
    place = np.arange(len(u)) - starts[u]
    room = place < 2 * links
    out[u[room], place[room]] = members[v[room]]
    return out


def graph(unit: np.ndarray, seed: int, links: int = LINKS) -> tuple[np.ndarray, np.ndarray]:
    """The flat graph: of the lowest level, neighbours of all vectors; of each upper one, from the top, a row of
    (level, vector, neighbours) for each of its members."""
    n = len(unit)
    level = levels(n, seed, links)
    upper = []
    for at in range(int(level.max(initial=0)), 0, -1):
        members = np.flatnonzero(level >= at)
        upper.append(np.column_stack([np.full(len(members), at, np.int32), members.astype(np.int32), _linked(unit, members, links)]))
    return _linked(unit, np.arange(n), links), np.concatenate(upper) if upper else np.zeros((0, 2 + 2 * links), np.int32)


def _spread(unit: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries together. start: (queries, any) first vectors. Returns the beams, nearest first."""
    q, n = len(queries), len(unit)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # stands for no neighbour
    rows = np.arange(q)[:, None]
    ids = np.full((q, beam), n, np.int64)
    score = np.full((q, beam), -np.inf)
    open_ = np.zeros((q, beam), bool)
    width = min(beam, start.shape[1])
    ids[:, :width] = start[:, :width]
    ids[ids < 0] = n
    real = ids < n
    score[real] = np.einsum("nd,nd->n", queries[np.nonzero(real)[0]], unit[ids[real]])
    open_[real] = True
    seen[np.nonzero(real)[0], ids[real]] = True
    active = np.arange(q)
    while len(active):
        best = np.argmax(np.where(open_[active], score[active], -np.inf), axis=1)
        going = open_[active, best]
        active, best = active[going], best[going]
        if not len(active):
            break
        open_[active, best] = False
        new = neighbours[ids[active, best]].astype(np.int64)
        new[new < 0] = n
        fresh = ~seen[active[:, None], new]
        seen[active[:, None], new] = True
        r, c = np.nonzero(fresh)
        value = np.full(new.shape, -np.inf)
        value[r, c] = np.einsum("nd,nd->n", queries[active[r]], unit[new[r, c]])
        all_ids = np.concatenate([ids[active], new], axis=1)
        all_score = np.concatenate([score[active], value], axis=1)
        all_open = np.concatenate([open_[active], fresh], axis=1)
        top = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
        ids[active] = np.take_along_axis(all_ids, top, 1)
        score[active] = np.take_along_axis(all_score, top, 1)
        open_[active] = np.take_along_axis(all_open, top, 1)
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)


def search(unit: np.ndarray, lowest: np.ndarray, upper: np.ndarray, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """The beam of each query on the lowest level: numbers of vectors, nearest first, len(unit) for none."""
    n = len(unit)
    beam = min(beam, n)
    start = np.zeros((len(queries), 1), np.int64)
    tops = np.unique(upper[:, 0])[::-1]
    for k, at in enumerate(tops):
        rows = upper[upper[:, 0] == at]
        neighbours = np.full((n + 1, upper.shape[1] - 2), -1, np.int32)
        neighbours[rows[:, 1]] = rows[:, 2:]
        if k == 0:
            start[:] = rows[0, 1]
        start = _spread(unit, neighbours, queries, start, min(beam, 8))[0]
        start[start == n] = -1
    return _spread(unit, lowest, queries, start, beam)[0]


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v array<double>, dim) of the rows that take part: ids and vectors without nulls, finite, not zero."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).withColumn("dim", F.size("v"))


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def index(rows: DataFrame, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """Of usable() rows: a stored row for each shard: dim, shard, vectors, ids, lowest, upper (flat arrays as binary).

    Equal vectors are one node, with the top + 1 least of their ids: no query needs more of them, as they tie. All
    vectors of a shard have one length.
    """
    # The least ids of large groups: ranked by parts of a group first, so that none is gathered in one task.
    part = Window.partitionBy("dim", "v", "salt").orderBy("vec_id")
    whole = Window.partitionBy("dim", "v").orderBy("vec_id")
    many = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    several = many.withColumn("k", F.row_number().over(part)).where(F.col("k") <= top + 1).withColumn("k", F.row_number().over(whole)).where(F.col("k") <= top + 1)
    nodes = stored(several.groupBy("dim", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "nodes")
    counts = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return nodes.sparkSession.createDataFrame([], _INDEX)
    number = F.coalesce(F.element_at(F.create_map(*[x for d, n in counts.items() for x in (F.lit(d), F.lit(-(-n // shard)))]), F.col("dim")), F.lit(1))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), number).cast("int"))

    def build(batches):
        held: list[tuple] = []

        def done():
            vectors = np.array([h[2] for h in held], np.float64)
            ids = np.full((len(held), top + 1), -1, np.int64)
            for i, h in enumerate(held):
                ids[i, : len(h[3])] = h[3]
            order = np.argsort(ids[:, 0], kind="stable")
            vectors, ids = vectors[order], ids[order]
            lowest, upper = graph(_unit(vectors).astype(np.float32), held[0][1], LINKS)
            return pa.RecordBatch.from_pydict({"dim": pa.array([held[0][0]], pa.int32()), "shard": pa.array([held[0][1]], pa.int32()), "vectors": [vectors.tobytes()], "ids": [ids.tobytes()], "lowest": [lowest.tobytes()], "upper": [upper.tobytes()]})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("dim", "shard", "v", "ids")), strict=True):
                if held and held[0][:2] != row[:2]:
                    yield done()
                    held.clear()
                held.append(row)
        if held:
            yield done()

    return stored(in_batches(dealt.repartition(sum(-(-n // shard) for n in counts.values()), "dim", "shard").sortWithinPartitions("dim", "shard"), build, _INDEX), "index")


_INDEX = "dim int, shard int, vectors binary, ids binary, lowest binary, upper binary"


def neighbours(shards: DataFrame, queries: DataFrame, top: int = TOP, beam: int = BEAM, block: int = QUERIES) -> DataFrame:
    """Of an index and usable() rows as queries: query_id, rank, vec_id, score, the top nearest of each query.

    A query meets vectors of its own length, but for its own id. Equal scores go by vec_id. Queries are stored in blocks in
    the shared folder; the task of a shard reads them from there, one block at a time, so no array of the index is shuffled.
    Each shard gives its best, which are ranked again. Repeated queries count once; without queries or vectors there are no
    rows.
    """
    from lexloom.llm.files import opened

    packed = queries.distinct().select("dim", "vec_id", "v").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-queries.count() // block)))).cast("int"))

    def bind(batches):
        held: list[tuple] = []

        def done():
            return pa.RecordBatch.from_pydict({"qdim": pa.array([held[0][0]], pa.int32()), "block": pa.array([held[0][1]], pa.int32()), "q": [np.array([h[3] for h in held], np.float64).tobytes()], "qids": [np.array([h[2] for h in held], np.int64).tobytes()]})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("dim", "block", "vec_id", "v")), strict=True):
                if held and (held[0][:2] != row[:2] or len(held) >= 2 * block):
                    yield done()
                    held.clear()
                held.append(row)
        if held:
            yield done()

    blocks = stored(in_batches(packed.repartition("dim", "block").sortWithinPartitions("dim", "block", "vec_id"), bind, "qdim int, block int, q binary, qids binary"), "queries")
    if blocks.isEmpty():
        return blocks.select(F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("double").alias("score"))
    folder = blocks._lexloom_path

    def meet(batches):
        import pyarrow.dataset as ds

        files, root = opened(folder)
        asked = ds.dataset(root, filesystem=files, format="parquet")
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                raw = {c: batch.column(c)[i].as_buffer() for c in ("vectors", "ids", "lowest", "upper")}
                x = np.frombuffer(raw["vectors"], np.float64).reshape(-1, dim)
                ids = np.frombuffer(raw["ids"], np.int64).reshape(len(x), -1)
                lowest, upper = (np.frombuffer(raw[c], np.int32) for c in ("lowest", "upper"))
                lowest, upper = lowest.reshape(len(x), -1), upper.reshape(-1, lowest.size // len(x) + 2)
                unit = _unit(x).astype(np.float32)
                for part in asked.to_batches(columns=["q", "qids"], filter=ds.field("qdim") == dim, batch_size=1, batch_readahead=1, fragment_readahead=1):
                    for j in range(part.num_rows):
                        q = np.frombuffer(part.column("q")[j].as_buffer(), np.float64).reshape(-1, dim)
                        yield from _met(q, np.frombuffer(part.column("qids")[j].as_buffer(), np.int64), x, ids, unit, lowest, upper, top, beam)

    found = in_batches(shards.select("dim", "vectors", "ids", "lowest", "upper"), meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _met(q, qids, x, ids, unit, lowest, upper, top: int, beam: int):
    """Batches (query_id, vec_id, score): a block's queries in one shard."""
    found = search(unit, lowest, upper, _unit(q).astype(np.float32), beam)[:, : 4 * top]
    real = found < len(x)
    near = np.where(real, found, 0)
    score = np.where(real, cosines(q[:, None, :], x[near]), -np.inf)
    # Candidates with all their ids, without the query's own.
    each = ids[near]
    value = np.where((each >= 0) & (each != qids[:, None, None]) & real[:, :, None], score[:, :, None], -np.inf).reshape(len(q), -1)
    each = each.reshape(len(q), -1)
    order = np.lexsort((each, -value), axis=1)[:, :top]
    value, each = np.take_along_axis(value, order, 1), np.take_along_axis(each, order, 1)
    r, c = np.nonzero(value > -np.inf)
    yield pa.RecordBatch.from_arrays([pa.array(qids[r]), pa.array(each[r, c]), pa.array(value[r, c])], names=["query_id", "vec_id", "score"])


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines along the last axis, in double precision."""
    return (x * y).sum(axis=-1) / (np.sqrt((x * x).sum(axis=-1)) * np.sqrt((y * y).sum(axis=-1)))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(usable(table(spark, sf_dir, "embeddings")), "vectors")
    return neighbours(index(rows), rows.where(F.col("vec_id") % 50 == 0))
