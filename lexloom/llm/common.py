"""Helpers that several operators share: stored intermediate tables, word patterns, spans, distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.text import located
from lexloom.sources.shared import discard, fresh_path, shared_root, stored  # noqa: F401

#: A word is a maximal run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words in the whole text; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def code_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start,end,match>>, in code points, end exclusive. The pattern must
    not match the empty string."""
    return located(text, pattern)


def prefix_sums(rows: DataFrame, group: list[str], order: list[str], value: str, bucket: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows before this one in its group, ordered by `bucket`, then `order`.

    Only the sums of buckets are ordered over a whole group; rows are sorted within a bucket, so a group of any size is
    dealt over as many tasks as it has buckets. `rows` must give the same rows each time it is read.
    """
    from pyspark.sql import Window

    keys = [*group, bucket]
    sums = rows.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(starts, same, "left")
        .withColumn(out, F.col("__start") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("__start", *[f"__{k}" for k in keys])
    )


LONG, STRING, DOUBLE, INT, BOOL, BINARY = T.LongType(), T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.BinaryType()

#: What code_spans() returns.
SPANS = "array<struct<start:int,end:int,match:string>>"
#: Spans of several kinds: by start, then kind in the order given, then end.
KINDED = "array<struct<start:int,rank:int,end:int,kind:string>>"


def spans_if(text: Column, guard: Column, pattern: str) -> Column:
    """code_spans() of the texts that pass the guard, which must hold for every text with a match; none of the others."""
    return F.when(guard, code_spans(text, pattern)).otherwise(F.array().cast(SPANS))


def kinded(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def told(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < end) & (start < s["end"]))


def row_keys(*columns: str) -> list[Column]:
    """r1 and r2, which tell rows apart by these columns; equal rows have equal keys."""
    return [F.xxhash64(*columns).alias("r1"), F.hash(*reversed(columns)).alias("r2")]


def replaced(text: Column, spans: Column, by) -> Column:
    """The text with each of the sorted spans replaced by by(span); a span that begins within the one before is left out."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a, s):
        out = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), by(s))
        return F.when(s["start"] < a["at"], a).otherwise(F.struct(out.alias("out"), s["end"].alias("at")))

    return F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))

#: Bytes of a batch that a task hands to Python at once; a single longer row makes a batch of its own.
BATCH_BYTES = 8 << 20


def in_batches(df: DataFrame, body, schema) -> DataFrame:
    """df.mapInArrow(body, schema) by batches of at most about BATCH_BYTES, whatever the rows' length.

    Workers are kept for later tasks, and give back to the system at the end of each what they no longer use.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def released(batches):
        try:
            yield from body(batches)
        finally:
            give_back()

    return df.mapInArrow(released, schema)


def give_back() -> None:
    """Returns freed memory to the system, where the platform knows how."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
