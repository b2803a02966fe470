"""9. Secrets: patterns, and a battery of randomness tests.

Long tokens are read in the encoding that their characters tell of (hex, base 32, base 36, base 64). A token of random
bits has symbols that are uniform (chi-squared, over cells wide enough for the token's length), change sides of the middle
as often as chance has it (runs), and don't depend on the one before (serial correlation). The three are combined into a
surprise: how unlikely random bits are to look like this token.

What is reported is what looks more random than ordinary tokens do. For each encoding and length, ordinary tokens are the
corpus's own long words and numbers, and made ones of words and numbers in turn. The share of them with as little surprise
is a token's p-value, and a Benjamini-Hochberg procedure keeps the share of ordinary tokens among those reported at the
rate or below; where tokens are too short to tell, none is. DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import KINDED, kinded, let, overlaps, replaced, row_keys, spans_if, stored, table, told

ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex")
#: From the length on that LEAST_BITS need in the widest alphabet.
TOKEN = r"[A-Za-z0-9+/_-]{14,}+={0,2}"
#: No digits, and no capital after a lone small letter: words, alone, joined by signs or by capitals.
WORDS = r"^[+/_-]*+(?:[A-Z]*+[a-z]{2,}+[+/_-]*+|[A-Z]++[+/_-]++)*+[A-Z]*+$"
#: Small words and numbers between signs.
SLUG = r"^[+/_-]*+(?:[a-z]{2,}+|[0-9]++)(?:[+/_-]++(?:[a-z]{2,}+|[0-9]++))*+[+/_-]*+$"
#: Symbols of each encoding, in their order; - and _ are other signs for + and /.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
SIZES = {"hex": 16, "base32": 32, "base36": 36, "base64": 64}
FITS = {"hex": "^(?:[0-9a-f]+|[0-9A-F]+)$", "base32": "^[A-Z2-7]+$", "base36": "^(?:[a-z0-9]+|[A-Z0-9]+)$", "base64": "^[A-Za-z0-9+/_-]+$"}
#: Of made ordinary tokens: the symbols that capital A, small a and the first digit are, and how many digits there are. In
#: hex, which has no words, they are numbers.
PLACES = {"hex": (None, None, 0, 10), "base32": (0, 0, 26, 6), "base36": (10, 10, 0, 10), "base64": (0, 26, 52, 10)}
#: Symbols of a word or number; of PARTS one is a number; letters from frequent to rare.
PART, PARTS, LETTERS = 6, 4, "etaoinshrdlcumwfgypbvkjxqz"
#: Bits that a secret has at least, the false-discovery rate, and steps of surprise (bits) by which tokens are counted.
LEAST_BITS, RATE, STEPS, MOST = 80, 0.05, 8, 800
#: Length classes, two for each doubling, of which the last holds all longer tokens; made ordinary tokens of each.
SHORTEST, LONGEST, DRAWS = 7, 18, 512


def ordinary(token: Column) -> Column:
    """Whether a token has the form of words and numbers."""
    return token.rlike(WORDS) | token.rlike(SLUG)


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z), by the rational approximation of Abramowitz and Stegun 26.2.17."""

    def tail(v: Column) -> Column:
        t, x = v["t"], v["x"]
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return let(F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly, lambda p: F.when(v["z"] >= 0, p).otherwise(1 - p))

    return let(z, lambda z: let(F.struct(z.alias("z"), F.abs(z).alias("x"), (1 / (1 + 0.2316419 * F.abs(z))).alias("t")), tail))


def battery(symbols: Column, size: Column) -> Column:
    """-log2 of the combined p-value of an array of two or more doubles, whole numbers below size.

    One pass gives what the runs and the serial correlation need, one more for each cell what chi-squared needs: there are
    as many cells as leave four symbols for each, two at least. Every value is bound once, so time goes with the length.
    """
    zero = F.lit(0.0)
    middle = (size - 1) / F.lit(2.0)

    def step(a: Column, x: Column) -> Column:
        up = x > middle
        return F.struct(
            (a["sum"] + x).alias("sum"), (a["squares"] + x * x).alias("squares"), (a["products"] + F.coalesce(a["last"], zero) * x).alias("products"),
            (a["above"] + F.when(up, 1.0).otherwise(0.0)).alias("above"), (a["runs"] + F.when(a["last"].isNull() | ((a["last"] > middle) != up), 1.0).otherwise(0.0)).alias("runs"), x.alias("last"),
        )

    names = ("sum", "squares", "products", "above", "runs")
    start = F.struct(*[zero.alias(k) for k in names], F.lit(None).cast("double").alias("last"))

    def chi(s: Column) -> Column:
        n = F.size(s)
        cells = F.greatest(F.lit(2), F.least(size, F.floor(n / 4).cast("int"))).cast("int")

        def over(k: Column) -> Column:
            placed = F.transform(s, lambda x: F.floor(x * k / size).cast("int"))
            width = lambda c: F.ceil((c + 1) * size / k) - F.ceil(c * size / k)
            seen = lambda p: F.transform(F.sequence(F.lit(0), k - 1), lambda c: let(F.size(F.filter(p, lambda x: x == c)).cast("double"), lambda o: o * o / width(c)))
            value = let(placed, lambda p: F.aggregate(seen(p), zero, lambda a, c: a + c)) * size / n - n
            spread = F.lit(2.0) / (9 * (k - 1))
            return let(F.greatest(value, zero), lambda v: (F.pow(v / (k - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))

        return let(cells, over)

    def logs(m: Column) -> Column:
        n, above = m["n"], m["s"]["above"]
        below, mean = n - above, m["s"]["sum"] / n
        expected = 2 * above * below / n + 1
        z_runs = let(expected, lambda e: (m["s"]["runs"] - e) / F.sqrt(F.greatest(F.lit(1e-9), (e - 1) * (e - 2) / (n - 1))))
        # All on one side: as unlikely as n draws from one half.
        p_runs = F.when((above == 0) | (below == 0), F.pow(F.lit(2.0), 1 - n)).otherwise(2 * _upper_tail(F.abs(z_runs)))
        power = m["s"]["squares"] - n * mean * mean
        serial = m["s"]["products"] - mean * (2 * m["s"]["sum"] - m["first"] - m["s"]["last"]) + (n - 1) * mean * mean
        p_serial = F.when(power <= 1e-9, F.lit(0.0)).otherwise(2 * _upper_tail(F.abs((serial / power + 1 / n) * F.sqrt(n))))
        log = lambda p: F.log(F.greatest(F.lit(1e-30), F.least(F.lit(1.0), p)))
        return -(log(_upper_tail(m["chi"])) + log(p_runs) + log(p_serial))

    # Fisher: minus twice the sum of the logarithms is chi-squared with 6 degrees, whose tail has a closed form.
    combined = lambda h: F.greatest(zero, (h - F.log(1 + h + h * h / 2)) / math.log(2))
    measures = lambda s: F.struct(F.size(s).cast("double").alias("n"), F.get(s, F.lit(0)).alias("first"), F.aggregate(s, start, step).alias("s"), chi(s).alias("chi"))
    return let(symbols, lambda s: let(measures(s), lambda m: let(logs(m), combined)))


def tested(token: Column) -> Column:
    """array<struct<encoding,length,surprise>> of a token without regard to padding.

    A token is tested in the smallest alphabet that holds all its characters; one of the form of words and numbers, which
    is no secret, in every alphabet that holds it, to tell what ordinary tokens look like. Empty below LEAST_BITS.
    """
    codes = F.array(*[F.struct(F.lit(k).alias("e"), F.lit(v).alias("symbols"), F.lit(SIZES[k]).alias("size"), F.lit(FITS[k]).alias("fits")) for k, v in ALPHABETS.items()])

    def measured(x: Column) -> Column:
        held = F.filter(codes, lambda c: F.regexp_like(x["t"], c["fits"]))
        held = F.when(x["plain"], held).otherwise(F.slice(held, 1, 1))

        def one(c: Column) -> Column:
            chars = F.when(c["e"].isin("hex", "base36"), F.lower(x["t"])).otherwise(x["t"])
            places = F.transform(F.filter(F.split(chars, ""), lambda y: y != ""), lambda y: F.instr(c["symbols"], y) - 1)
            symbols = F.transform(places, lambda s: F.when(s >= c["size"], s - 2).otherwise(s).cast("double"))
            return F.struct(c["e"].alias("encoding"), F.length(x["t"]).alias("length"), battery(symbols, c["size"]).alias("surprise"))

        return F.transform(F.filter(held, lambda c: F.length(x["t"]) * F.log2(c["size"].cast("double")) >= LEAST_BITS), one)

    return let(F.regexp_replace(token, "=+$", ""), lambda t: let(F.struct(t.alias("t"), ordinary(t).alias("plain")), measured))


def base_spans(text: Column) -> dict[str, Column]:
    named = text.rlike(r"(?i)passw(?:or)?d|secret|token|api_?key")
    group = lambda m: F.regexp_extract(m, ASSIGN, 2)
    return {
        "assign": F.filter(spans_if(text, named, ASSIGN), lambda s: F.length(group(s["match"])) >= 12),
        "access": spans_if(text, F.contains(text, F.lit("AKIA")), ACCESS),
        "hex": spans_if(text, text.rlike(HEX), HEX),
    }


def detected(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, r1, r2, n_<kind>, base and all (arrays of sorted spans; kinds as listed, then random).

    Random tokens that overlap a base span add nothing to it. A null text is empty, and a null id stays null. Rows with
    equal ids are documents of their own; equal rows get equal results, and count once, as equal tokens do, in what decides
    on random ones. An empty table gives none. A token of any length is tested whole, in time that goes with its length.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kinds = F.struct(*[c.alias(k) for k, c in base_spans(text).items()])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys("doc_id", "text"), kinds.alias("s"), spans_if(text, text.rlike(TOKEN), TOKEN).alias("tokens"))
    base = F.sort_array(F.concat(*[kinded(F.col(f"s.{k}"), k, i) for i, k in enumerate(KINDS)]))
    rows = rows.select("doc_id", "r1", "r2", base.alias("base"), *[F.size(f"s.{k}").cast("long").alias(f"n_{k}") for k in KINDS], "tokens")
    free = F.filter("tokens", lambda t: ~overlaps(F.col("base"), t["start"], t["end"]))
    tests = F.transform(free, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.xxhash64(t["match"]).alias("token"), ordinary(F.regexp_replace(t["match"], "=+$", "")).alias("plain"), tested(t["match"]).alias("tests")))
    rows = rows.withColumn("tested", F.filter(tests, lambda t: F.size(t["tests"]) > 0)).drop("tokens")
    rows = stored(rows, "tokens")
    limits = stored(_limits(rows, rate), "limits")
    seen = rows.select("r1", "r2", F.explode("tested").alias("x")).where("not x.plain").distinct().select("r1", "r2", "x.start", "x.end", *_stratum(F.col("x.tests")[0]))
    # At most a row for each encoding and length class.
    random = seen.join(F.broadcast(limits), ["encoding", "length"]).where(F.col("step") <= F.col("limit"))
    span = F.struct("start", F.lit(3).alias("rank"), "end", F.lit("random").alias("kind"))
    added = random.groupBy("r1", "r2").agg(F.collect_list(span).cast(KINDED).alias("random")).withColumnsRenamed({"r1": "t1", "r2": "t2"})
    out = rows.join(added, (F.col("r1") == F.col("t1")) & (F.col("r2") == F.col("t2")), "left")
    return out.select("doc_id", "r1", "r2", *[f"n_{k}" for k in KINDS], "base", F.sort_array(F.concat("base", F.coalesce("random", F.array().cast(KINDED)))).alias("all"))


def _step(surprise: Column) -> Column:
    return F.least(F.lit(MOST), F.floor(surprise * STEPS)).cast("int")


def _stratum(t: Column) -> list[Column]:
    """Encoding, length class, and step of the surprise."""
    return [t["encoding"].alias("encoding"), F.least(F.lit(LONGEST), F.floor(2 * F.log2(t["length"].cast("double")))).cast("int").alias("length"), _step(t["surprise"]).alias("step")]


def made_tokens(spark: SparkSession) -> DataFrame:
    """(encoding, length, step, n): made ordinary tokens of each encoding and length class, of the shortest length in it.

    Words of frequent letters, half of them with a capital, and numbers, drawn by hash. The number of tokens is fixed.
    """
    codes = F.array(*[F.struct(F.lit(k).alias("encoding"), F.lit(SIZES[k]).alias("size"), F.lit(c).cast("int").alias("capital"), F.lit(s).cast("int").alias("small"), F.lit(d).alias("digit"), F.lit(n).alias("digits")) for k, (c, s, d, n) in PLACES.items()])
    lengths = LONGEST - SHORTEST + 1
    draws = spark.range(len(PLACES) * lengths * DRAWS).select("id", F.get(codes, F.floor(F.col("id") / (lengths * DRAWS)).cast("int")).alias("c"), (SHORTEST + F.floor(F.col("id") / DRAWS) % lengths).cast("int").alias("length"))
    draw = lambda k, x, n: F.pmod(F.xxhash64("id", F.lit(k), x), n).cast("int")

    def symbol(i: Column) -> Column:
        part = F.floor(i / PART).cast("int")
        letter = F.get(F.array(*[F.lit(ord(x) - 97) for x in LETTERS]), F.least(draw(2, i, F.lit(26)), draw(3, i, F.lit(26))))
        number = F.col("c.digit") + draw(4, i, F.col("c.digits"))
        capital = (i % PART == 0) & (draw(1, part, F.lit(2)) == 0)
        return F.when(F.col("c.small").isNull() | (draw(0, part, F.lit(PARTS)) == 0), number).when(capital, F.col("c.capital") + letter).otherwise(F.col("c.small") + letter).cast("double")

    symbols = F.transform(F.sequence(F.lit(0), F.ceil(F.pow(F.lit(2.0), F.col("length") / 2)).cast("int") - 1), symbol)
    return draws.select("c.encoding", "length", _step(battery(symbols, F.col("c.size"))).alias("step")).groupBy("encoding", "length", "step").agg(F.count(F.lit(1)).alias("n"))


def _limits(rows: DataFrame, rate: float) -> DataFrame:
    """(encoding, length, limit): of each encoding and length class, the last step whose tokens are reported.

    A token's p-value is the share of ordinary tokens, itself added to them, with as little surprise or less. Benjamini-
    Hochberg over counted steps: the last step whose p-value is at most rate times the share of tokens up to it.
    """
    seen = rows.select(F.explode("tested").alias("x")).select("x.token", "x.plain", F.explode("x.tests").alias("t")).select("token", "plain", *_stratum(F.col("t"))).distinct()
    counts = seen.groupBy("encoding", "length", "step").agg(F.count_if("plain").alias("plain"), F.count_if(~F.col("plain")).alias("tokens"))
    made = made_tokens(rows.sparkSession).select("encoding", "length", "step", F.col("n").alias("plain"), F.lit(0).cast("long").alias("tokens"))
    both = counts.unionByName(made).groupBy("encoding", "length", "step").agg(F.sum("plain").alias("plain"), F.sum("tokens").alias("tokens"))
    group = Window.partitionBy("encoding", "length")
    upto = lambda c: F.sum(c).over(group.orderBy("step"))
    both = both.select("*", upto("plain").alias("less"), F.sum("plain").over(group).alias("every"), upto("tokens").alias("reported"), F.sum("tokens").over(group).alias("all"))
    fine = (1 + F.col("less")) / (1 + F.col("every")) <= rate * F.col("reported") / F.col("all")
    return both.where((F.col("tokens") > 0) & fine).groupBy("encoding", "length").agg(F.max("step").alias("limit"))


def redacted(docs: DataFrame, **options) -> DataFrame:
    """docs with each secret in the text replaced by [SECRET]. Other columns, null texts and repeated rows stay as they are;
    of spans that overlap, the first is replaced."""
    spans = detected(docs, **options).where(F.size("all") > 0).select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2"), F.col("all").alias("__spans")).distinct()
    keys = row_keys("doc_id", "text")
    joined = docs.withColumn("__1", keys[0]).withColumn("__2", keys[1]).join(spans, (F.col("__1") == F.col("__r1")) & (F.col("__2") == F.col("__r2")), "left")
    text = replaced(F.col("text"), F.col("__spans"), lambda s: F.lit("[SECRET]"))
    return joined.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(text)).select(*docs.columns)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detected(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("all")).alias("spans"))
