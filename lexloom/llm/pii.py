"""5. Personal data: patterns, and information-theoretic sanitisation.

Emails, IP addresses, card and phone numbers are found by pattern. Each different value is a protected entity, and so is
the group that it belongs to: an email's domain, an address's network, a card's issuer, a phone number's area. How much a
term reveals of an entity is estimated from the corpus: PMI(entity; term) over whole texts, against the information
IC(entity) that there is to hide. A term that discloses nearly all of it is removed wherever it stands in a text of the
entity; one that discloses much of it is generalised to the kind of entity that it reveals. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import KINDED, code_spans, discard, kinded, let, overlaps, replaced, row_keys, spans_if, stored, table, told

#: The patterns of the contract, with possessive quantifiers and a look behind where nothing could come of a retry.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?)?(?:\.|$)){4}$"
KINDS = ("email", "ip", "card", "phone")
TERM = r"[\p{L}\p{M}]{4,}+"
#: Shares of IC from which a term is generalised, and removed.
GENERALISE, REMOVE = 0.9, 0.97
#: Texts without the entity that are added to a term's own, so that what is seen once or twice proves less.
PRIOR = 0.5


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def total(d: Column) -> Column:
        def step(a, i):
            one = F.substring(d, F.length(d) + 1 - i, F.lit(1)).cast("int")
            two = F.when(i % 2 == 0, F.when(one > 4, 2 * one - 9).otherwise(2 * one)).otherwise(one)
            return a + two

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step)

    return let(digits, lambda d: F.when(F.length(d).between(14, 19), total(d) % 10 == 0).otherwise(False))


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind, of texts without nulls."""
    return {
        "email": spans_if(text, F.contains(text, F.lit("@")), EMAIL),
        "ip": F.filter(spans_if(text, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), IP), lambda s: s["match"].rlike(OCTETS)),
        "card": F.filter(spans_if(text, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), CARD), lambda s: _luhn(_digits(s["match"]))),
        "phone": F.filter(spans_if(text, F.contains(text, F.lit("+")), PHONE), lambda s: F.length(_digits(s["match"])).between(10, 15)),
    }


def entities(kind: str, match: Column) -> Column:
    """The protected entities of a match: its value, and the group that it belongs to."""
    group = {
        "email": F.substring_index(match, "@", -1),
        "ip": F.substring_index(match, ".", 3),
        "card": F.substring(_digits(match), 1, 6),
        "phone": F.substring(_digits(match), 1, 4),
    }[kind]
    value = match if kind in ("email", "ip") else _digits(match)
    return F.array(F.concat(F.lit(f"{kind}:"), F.lower(value)), F.concat(F.lit(f"{kind} of "), F.lower(group)))


def found(docs: DataFrame) -> DataFrame:
    """Of docs (doc_id, text): doc_id, r1, r2, content, the spans of each kind, ents (entities, as struct<e,kind>), and
    the text where there are entities."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys("doc_id", "text"), F.xxhash64("text").alias("content"), text.alias("text"), F.struct(*[c.alias(k) for k, c in base_spans(text).items()]).alias("s"))

    def protected(kind: str, rank: int) -> Column:
        one = lambda s: F.transform(entities(kind, s["match"]), lambda e: F.struct(F.xxhash64(e).alias("e"), F.lit(rank).alias("kind")))
        return F.flatten(F.transform(F.col(f"s.{kind}"), one))

    each = [protected(k, i) for i, k in enumerate(KINDS)]
    base = base.withColumn("ents", F.array_distinct(F.concat(*each)))
    held = F.when(F.size("ents") > 0, F.col("text"))
    return base.select("doc_id", "r1", "r2", "content", "s.*", "ents", held.alias("text"))


def text_terms(text: Column) -> Column:
    """Hashes of the different terms of a text."""
    return F.transform(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))), lambda t: F.xxhash64(t))


def _places(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, s1, s2): of (content, by), in how many contents each stands, and a signature of the set of them."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("content")).alias("s1"), F.bit_xor(F.xxhash64("content", F.lit(1))).alias("s2"))


def disclosing(docs: DataFrame, rows: DataFrame, least: float = GENERALISE, prior: float = PRIOR) -> DataFrame:
    """Of docs and found() rows of them: (content, t, share, kind): the terms of each text that disclose at least that share of the information of one of its
    entities, the greatest share, and the first kind of such an entity.

    share = log(joint / (n_term + prior) * n / n_entity) / log(n / n_entity), counted over different texts, so that copies of
    one are no more evidence than itself. Entities that stand in the same texts are counted together, and so are terms: a
    page of thousands of names and addresses that stand nowhere else is one pair, not millions. A term is looked at only in
    texts with an entity of which it could disclose enough, as joint is n_entity at most.
    """
    n = float(rows.select("content").distinct().count())
    held = rows.where(F.size("ents") > 0).groupBy("content").agg(F.first("ents").alias("ents"), F.first("text").alias("text"))
    held = stored(held.select("content", "ents", text_terms(F.col("text")).alias("terms")), "held")
    every = stored(held.select("content", F.explode("ents").alias("x")).select("content", "x.e", "x.kind"), "entities")
    if every.isEmpty():
        return every.select("content", F.lit(None).cast("long").alias("t"), F.lit(None).cast("double").alias("share"), F.lit(None).cast("int").alias("kind"))
    each = _places(every.select("content", "e"), "e").where(F.col("n") < n).select("e", F.col("n").alias("n_entity"), F.xxhash64("n", "s1", "s2").alias("ec"))
    ents = stored(every.join(each, "e").groupBy("content", "ec").agg(F.first("n_entity").alias("n_entity"), F.min("kind").alias("kind")), "entity-classes")
    most = lambda c: (1 + 1e-9) * F.pow(c.cast("double"), F.lit(least)) * n ** (1 - least)
    bounds = ents.groupBy("content").agg(most(F.max("n_entity")).alias("most"))
    # Terms are made again rather than stored for all texts, which would be as much as the texts.
    texts = docs.select(F.xxhash64("text").alias("content"), text_terms(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("terms")).groupBy("content").agg(F.first("terms").alias("terms"))
    n_term = texts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n_term"))
    terms = held.select("content", F.explode("terms").alias("t"))
    own = _places(terms, "t").join(n_term, "t").where(F.col("n_term") + prior <= most(F.col("n")))
    terms = terms.join(own.select("t", "n_term", F.xxhash64("n_term", "s1", "s2").alias("tc")), "t").join(bounds, "content").where(F.col("n_term") + prior <= F.col("most"))
    terms = stored(terms.select("content", "t", "tc", "n_term"), "term-classes")
    met = stored(ents.join(terms.select("content", "tc", "n_term").distinct(), "content"), "met")
    pairs = met.groupBy("ec", "tc", "n_entity", "n_term").agg(F.count(F.lit(1)).alias("joint"))
    share = F.round(F.log(F.col("joint") / (F.col("n_term") + prior) * n / F.col("n_entity")) / F.log(n / F.col("n_entity")), 9)
    pairs = pairs.withColumn("share", share).where(F.col("share") >= least).select("ec", "tc", "share")
    best = met.select("content", "ec", "tc", "kind").join(pairs, ["ec", "tc"]).groupBy("content", "tc").agg(F.max("share").alias("share"), F.min("kind").alias("kind"))
    out = stored(terms.select("content", "t", "tc").join(best, ["content", "tc"]).select("content", "t", "share", "kind"), "disclosing")
    discard(held, every, ents, terms, met)
    return out


def detected(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, prior: float = PRIOR) -> DataFrame:
    """doc_id, r1, r2, n_<kind>, base and all (array of sorted spans; kinds as listed, then term and gone), and reveals, an
    array of the kind that each of its term spans reveals, by start.

    term spans are to be generalised, gone spans to be removed; neither overlaps a base span. A null text is empty, a null id
    stays null. Rows with equal ids are documents of their own; equal rows get equal results. An empty table gives none. Whole
    texts of any length are taken.
    """
    rows = stored(found(docs), "found")
    terms = disclosing(docs, rows, generalise, prior).select(F.col("content").alias("c"), F.col("t").alias("dt"), "share", F.col("kind").alias("reveals"))
    words = rows.where(F.col("text").isNotNull()).groupBy("content").agg(F.first("text").alias("text"))
    words = words.select("content", F.explode(code_spans(F.col("text"), TERM)).alias("w")).withColumn("wt", F.xxhash64(F.lower("w.match")))
    places = words.join(terms, (F.col("content") == F.col("c")) & (F.col("wt") == F.col("dt")))
    gone = F.col("share") >= remove
    names = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("reveals") + 1)
    span = F.struct(F.col("w.start").alias("start"), F.when(gone, 5).otherwise(4).alias("rank"), F.col("w.end").alias("end"), F.when(gone, "gone").otherwise("term").alias("kind"), names.alias("reveals"))
    # Stored, so that in the join both sides are plain shuffles, of which Spark can split those of a text with many copies.
    added = stored(places.groupBy("c").agg(F.sort_array(F.collect_list(span)).alias("terms")), "added")
    base = F.sort_array(F.concat(*[kinded(F.col(k), k, i) for i, k in enumerate(KINDS)]))
    out = rows.drop("text").withColumn("base", base).join(added, F.col("content") == F.col("c"), "left")
    free = F.filter("terms", lambda t: ~overlaps(F.col("base"), t["start"], t["end"]))
    out = out.withColumn("terms", F.when(F.col("terms").isNotNull(), free).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,reveals:string>>")))
    every = F.sort_array(F.concat("base", F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["rank"].alias("rank"), t["end"].alias("end"), t["kind"].alias("kind")))))
    return out.select("doc_id", "r1", "r2", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], "base", every.alias("all"), F.transform("terms", lambda t: t["reveals"]).alias("reveals"))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """docs with values and disclosing terms replaced in the text: a value by its kind, such as [EMAIL], a term by the kind
    that it reveals, such as [EMAIL TERM], or by nothing.

    Other columns, null texts and repeated rows stay as they are; of base spans that overlap, the first is replaced.
    """
    found = detected(docs, **options).where(F.size("all") > 0)
    # Spans of all kinds in order, each with what stands in its place.
    terms = F.filter("all", lambda s: s["rank"] >= 4)
    by = F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("by"))), F.zip_with(terms, "reveals", lambda s, r: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.when(s["kind"] == "gone", "").otherwise(F.concat(F.lit("["), F.upper(r), F.lit(" TERM]"))).alias("by"))))
    spans = found.select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2"), F.sort_array(by).alias("__spans")).distinct()
    keys = row_keys("doc_id", "text")
    joined = docs.withColumn("__1", keys[0]).withColumn("__2", keys[1]).join(spans, (F.col("__1") == F.col("__r1")) & (F.col("__2") == F.col("__r2")), "left")
    text = replaced(F.col("text"), F.col("__spans"), lambda s: s["by"])
    return joined.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(text)).select(*docs.columns)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detected(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("all")).alias("spans"))
