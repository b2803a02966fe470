"""1. Mixing sources to target weights.

Each row gets a hash-random key; within each source the rows are ordered by it in ranges, distributed prefix sums of the
sizes place every row, and the source is cut at its exact budget. A budget above the source's size repeats it in whole
epochs first. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import WORD, prefix_sums, stored, table, word_count

#: Rows that one range of a source holds on average.
ROWS_A_RANGE = 256


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Of rows (source, size): source, source_size, source_rows, target double, budget long.

    Sources by code point, null last, take the weights in turn. Targets share the sum of all sizes by weight; none is
    above max_epochs times its source's size, and the excess goes to the others by weight until that holds. Filling up
    in the order of (size / weight) gives just that fixed point. A source without words has the target 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("__rank", F.row_number().over(by_name) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.lit(max_epochs).cast("long") * F.col("source_size"))
    every = Window.partitionBy()
    filling = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "__rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__all", F.sum("source_size").over(every))
    per = per.withColumn("__left", F.col("__all") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    per = per.withColumn("__w", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # The first source, in this order, whose share of what is left lies below its cap sets the level of all that follow.
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products of sums need more than 64 bits
    per = per.withColumn("__open", wide("weight") * wide("__left") < wide("cap") * wide("__w"))
    per = per.withColumn("__at", F.min(F.when(F.col("__open"), F.struct(F.row_number().over(filling).alias("i"), F.col("__left").alias("left"), F.col("__w").alias("w")))).over(every))
    per = per.withColumn("__capped", F.col("__at").isNull() | (F.row_number().over(filling) < F.col("__at.i")))
    share = F.col("weight") * F.col("__at.left")
    return per.select(
        "source",
        "source_size",
        "source_rows",
        F.when(F.col("__capped"), F.col("cap").cast("double")).otherwise(share.cast("double") / F.col("__at.w").cast("double")).alias("target"),
        F.when(F.col("__capped"), F.col("cap")).otherwise(F.expr("weight * __at.left div __at.w")).alias("budget"),
    )


def mix(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix", rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """Of rows (doc_id, source, size): the same with source_size, target, taken, first_of (words the last, partial epoch takes).

    Null ids, sources and sizes are values like any other (a null size counts as 0); equal rows stay separate rows, and it
    doesn't matter which of them comes first. An empty table gives an empty table. Reads its input once, and stores
    (doc_id, source, size) in the shared folder. The table of sources passes through one task, sorted, a row each.
    """
    rows = sizes.select("doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"))
    rows = stored(rows.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))), "mix-sizes")
    per = stored(source_targets(rows, weights, max_epochs), "mix-sources")
    joined = rows.alias("r").join(per.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")), "inner").select("r.*", "p.source_size", "p.source_rows", "p.target", "p.budget")
    # The first 8 hex digits of the key, as a number, scaled to the source's own count of ranges.
    ranges = F.ceil(F.col("source_rows") / rows_a_range)
    joined = joined.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / F.lit(4294967296)).cast("long"))
    placed = prefix_sums(joined, ["source"], ["key", "doc_id", "size"], "size", "range", "before")
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)
    first_of = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("before")))
    return (
        placed.withColumn("epochs", epochs.cast("long"))
        .withColumn("first_of", first_of.cast("long"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("first_of"))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "epochs", "first_of")
    )


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with their columns: one row for each whole epoch, and one, cut after its last
    taken word, where the budget ends within the text. Rows of which nothing is taken go; a text without words takes no
    budget, and goes with the partial epoch.

    Ids need not be unique: rows are told apart by id, source and text. Equal rows take whole epochs alike; what the partial
    epoch takes of them is given to one of them, as many times as it takes one whole, and cut. Null ids, sources and texts
    are values like any other; an empty table gives none.
    """
    row = F.xxhash64(F.col("doc_id"), F.col("source"), F.col("text"))
    sized = docs.select(F.struct("doc_id", row.alias("row")).alias("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))
    sized = sized.withColumn("doc_id", F.concat_ws("/", F.coalesce(F.col("doc_id.doc_id").cast("string"), F.lit("-")), F.col("doc_id.row").cast("string")))
    taken = mix(sized).where("taken > 0").groupBy("doc_id").agg(
        F.max("epochs").cast("int").alias("__epochs"), F.count(F.lit(1)).alias("__rows"),
        F.count_if(F.col("first_of") == F.col("size")).cast("int").alias("__whole"),
        F.max(F.when((F.col("first_of") > 0) & (F.col("first_of") < F.col("size")), F.col("first_of"))).alias("__part"),
    )
    taken = stored(taken.withColumnRenamed("doc_id", "__id"), "taken")
    keyed = docs.withColumn("__id", F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), row.cast("string")))
    whole = lambda n: F.array_repeat(F.lit(-1).cast("long"), n)
    rest = F.concat(whole(F.col("__whole")), F.when(F.col("__part").isNotNull(), F.array("__part")).otherwise(F.array().cast("array<bigint>")))
    joined = keyed.join(taken, "__id").withColumn("__copies", F.when(F.col("__rows") == 1, F.concat(whole(F.col("__epochs")), rest)).otherwise(whole(F.col("__epochs"))))
    several = taken.where("__rows > 1 and (__whole > 0 or __part is not null)")
    shared = keyed.join(several, "__id").dropDuplicates(["__id"]).withColumn("__copies", rest)
    joined = joined.unionByName(shared)
    cut = joined.withColumn("__cut", F.explode("__copies"))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    text = F.when(F.col("__cut") < 0, F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(0), F.col("__cut")).cast("int")), ""))
    cut = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("__cut") < 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return cut.select(*docs.columns)


ORACLE = {
    "op1_mix": r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM p),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM r),
f AS (SELECT *, row_number() OVER (ORDER BY cap / weight, k) AS i,
        sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wrest FROM w),
o AS (SELECT i, rest, wrest FROM f WHERE weight * rest < cap * wrest ORDER BY i LIMIT 1),
t AS (SELECT f.source, source_size,
        CASE WHEN o.i IS NULL OR f.i < o.i THEN cap::DOUBLE ELSE (weight * o.rest)::DOUBLE / o.wrest::DOUBLE END AS target,
        CASE WHEN o.i IS NULL OR f.i < o.i THEN cap ELSE (weight * o.rest) // o.wrest END AS budget FROM f LEFT JOIN o ON true),
d AS (SELECT s.doc_id, s.size, t.source_size, t.target, t.budget,
        coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('mix:' || coalesce(s.doc_id::VARCHAR, '')), s.doc_id, s.size
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
    + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END::BIGINT AS taken
FROM d"""
}
