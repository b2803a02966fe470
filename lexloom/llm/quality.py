"""4. Quality rules: measures of each text, and the frequency of lines across the documents of a host.

Normalised lines are hashed, and the distinct documents of a host that hold each are counted, copies of a document under
other ids too. Lines above the limits are removed, and documents of which too little is left are rejected, like those that
fail the base rules. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import WORD, let, stored, table

#: A line is removed if more documents of its host than this, and more than this share of them, hold it.
LEAST_DOCS, LEAST_SHARE = 20, 0.05
#: A document is rejected if its removed lines hold more than this share of its words.
DEPLETED = 0.8


def line_words(text: Column) -> Column:
    """The words of each \\n-split line."""
    return F.transform(F.split(text, "\n", -1), lambda line: F.regexp_extract_all(line, F.lit(WORD), F.lit(0)))


def line_key(words: Column) -> Column:
    """Hash of a line, without regard to case and white space."""
    return F.xxhash64(F.lower(F.array_join(words, " ")))


def repeated_words(words: Column, size: int = 5) -> Column:
    """Words that lie in a window of `size` words found twice or more in the text."""
    windows = F.when(F.size(words) > size, F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(size))))).otherwise(F.array().cast("array<bigint>"))
    near = lambda t, e, i: F.coalesce(F.get(t, i)["x"] == e["x"], F.lit(False))

    def covered(sorted_: Column) -> Column:
        twice = F.filter(sorted_, lambda e, i: near(sorted_, e, i - 1) | near(sorted_, e, i + 1))
        places = F.sort_array(F.transform(twice, lambda e: e["i"]))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
        step = lambda a, p: F.struct((a["n"] + p + size - F.greatest(p.cast("long"), a["end"])).alias("n"), (p + size).cast("long").alias("end"))
        return F.aggregate(places, zero, step, lambda a: a["n"])

    pairs = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs(h), covered)))


def measured(docs: DataFrame) -> DataFrame:
    """Of docs (doc_id, text, source): doc_id, host, r1, r2 (which row it is), the base measures and verdict, and lines,
    array<struct<k,w>> of the different lines with words and their words, all of one key together."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def measures(lines: Column) -> Column:
        lined = F.filter(lines, lambda ws: F.size(ws) > 0)
        keyed = F.sort_array(F.transform(lined, lambda ws: F.struct(line_key(ws).alias("k"), F.size(ws).cast("long").alias("w"))))
        return let(
            F.flatten(lines),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeated_words(w).alias("n_repeat_words"),
                keyed.alias("lines"),
            ),
        )

    raw = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("host"),
        F.xxhash64("doc_id", "source", "text").alias("r1"),
        F.hash("text", "doc_id").alias("r2"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(raw, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        let(line_words(text), measures).alias("m"),
    )
    out = out.select("*", "m.*").drop("m")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def frequent_lines(rows: DataFrame, least_docs: int, least_share: float) -> DataFrame:
    """(host, k) of the lines above the limits. As each is in a share of the host's documents, a host has no more of them
    than 1 / least_share times the lines of a document. Equal rows are one document."""
    held = rows.select("host", "r1", "r2", F.explode(F.array_distinct(F.transform("lines", lambda x: x["k"]))).alias("k")).distinct()
    counts = held.groupBy("host", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least_docs)
    hosts = rows.select("host", "r1", "r2").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs")).withColumnRenamed("host", "h")
    above = counts.join(hosts, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > least_share * F.col("docs"))
    return above.select(F.col("host").alias("fh"), F.col("k").alias("fk"))


def judged(docs: DataFrame, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE, depleted: float = DEPLETED) -> DataFrame:
    """measured() with kept and gone, the keys of the removed lines (null: none).

    A null text is empty, and fails. Null hosts are one host. Equal rows get equal verdicts. An empty table gives none.
    """
    rows = stored(measured(docs), "measures")
    frequent = stored(frequent_lines(rows, least_docs, least_share), "frequent")
    hit = rows.select("host", "r1", "r2", F.explode("lines").alias("l")).select("host", "r1", "r2", F.col("l.k").alias("k"), F.col("l.w").alias("w"))
    hit = hit.join(frequent, F.col("host").eqNullSafe(F.col("fh")) & (F.col("k") == F.col("fk"))).groupBy("r1", "r2").agg(F.collect_set("k").alias("gone"))
    hit = hit.select(F.col("r1").alias("g1"), F.col("r2").alias("g2"), "gone")
    out = rows.join(hit, (F.col("r1") == F.col("g1")) & (F.col("r2") == F.col("g2")), "left").drop("g1", "g2")
    lost = F.aggregate(F.filter("lines", lambda x: F.array_contains("gone", x["k"])), F.lit(0).cast("long"), lambda a, x: a + x["w"])
    share = F.when(F.col("gone").isNotNull(), lost).otherwise(F.lit(0)) <= depleted * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & share)


def cleaned(docs: DataFrame, **limits) -> DataFrame:
    """The documents that are kept, with their columns, without the lines above the limits; n_chars, if there, follows.

    A null text is empty, and goes. Equal rows all stay or all go. An empty table gives none.
    """
    verdicts = judged(docs, **limits).where("not kept or gone is not null").select("r1", "r2", "kept", "gone").distinct()
    own = docs.withColumn("__1", F.xxhash64("doc_id", "source", "text")).withColumn("__2", F.hash("text", "doc_id"))
    verdicts = verdicts.select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2"), F.col("kept").alias("__kept"), F.col("gone").alias("__gone"))
    joined = own.join(verdicts, (F.col("__1") == F.col("__r1")) & (F.col("__2") == F.col("__r2")), "left").where("coalesce(__kept, true)")
    stay = F.filter(F.split("text", "\n", -1), lambda line: ~F.array_contains("__gone", line_key(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)))))
    changed = F.col("__gone").isNotNull()
    out = joined.withColumn("__text", F.when(changed, F.array_join(stay, "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("__text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col("__text")).select(*docs.columns)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = {
    "op4_quality": r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT *, CASE WHEN len(ws) < 5 THEN [] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END AS gs FROM w),
p AS (SELECT doc_id, source, text, generate_subscripts(gs, 1) AS i, unnest(gs) AS gram FROM g),
c AS (SELECT doc_id, source, text, i, count(*) OVER (PARTITION BY doc_id, source, text, gram) AS n FROM p),
s AS (SELECT doc_id, source, text, count(DISTINCT j) AS n_repeat_words FROM (
        SELECT doc_id, source, text, unnest(range(i, i + 5)) AS j FROM c WHERE n > 1) GROUP BY ALL),
b AS (SELECT g.doc_id, g.source, g.text, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(g.text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, ls
      FROM g LEFT JOIN s ON g.doc_id IS NOT DISTINCT FROM s.doc_id AND g.source IS NOT DISTINCT FROM s.source AND g.text = s.text),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
l AS (SELECT doc_id, source, text, lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')) AS k,
        len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw
      FROM (SELECT doc_id, source, text, unnest(ls) AS line FROM v)),
f AS (SELECT source, k, count(DISTINCT (doc_id, text)) AS n FROM l GROUP BY source, k),
h AS (SELECT source, count(DISTINCT (doc_id, text)) AS docs FROM t GROUP BY source),
a AS (SELECT f.source, f.k FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source WHERE n > 20 AND n > 0.05 * docs),
d AS (SELECT doc_id, l.source, text, sum(nw) AS lost FROM l JOIN a ON l.source IS NOT DISTINCT FROM a.source AND l.k = a.k GROUP BY ALL)
SELECT v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(lost, 0) <= 0.8 * n_words AS kept
FROM v LEFT JOIN d ON v.doc_id IS NOT DISTINCT FROM d.doc_id AND v.source IS NOT DISTINCT FROM d.source AND v.text = d.text"""
}
