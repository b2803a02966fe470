"""Expressions over colours, scores, boxes and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.text import let

# --- fixed values: theme colours, canonical encoder names ---------------------------------------------------------------
THEME_COLOURS = {9: "FF00FF00", 10: "FFFF0000"}
ENCODER_ALIASES = {
    "minilm": "bge-base-en-v1.5",
    "all-minilm-l6-v2": "bge-base-en-v1.5",
    "bge": "bge-base-en-v1.5",
    "bge-base-en-v1.5": "bge-base-en-v1.5",
    "mpnet": "all-mpnet-base-v2",
    "all-mpnet-base-v2": "all-mpnet-base-v2",
}
# -------------------------------------------------------------------------------------------------------------------------


def hsv(rgb: Column) -> Column:
    """struct<h,s,v> of RRGGBB or AARRGGBB; degrees with one decimal, shares with three."""
    hexes = F.when(F.length(rgb) == 8, F.substring(rgb, 3, 6)).otherwise(rgb)
    part = lambda at: F.conv(F.substring(hexes, at, 2), 16, 10).cast("double") / 255
    return let(F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")), _hsv)


def _hsv(c: Column) -> Column:
    r, g, b = c["r"], c["g"], c["b"]
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    rc, gc, bc = ((high - x) / F.nullif(span, F.lit(0.0)) for x in (r, g, b))
    turn = F.when(r == high, bc - gc).when(g == high, 2.0 + rc - bc).otherwise(4.0 + gc - rc) / 6.0
    hue = F.when(span == 0, 0.0).otherwise(turn - F.floor(turn))
    return F.struct(F.round(hue * 360, 1).alias("h"), F.round(F.when(high == 0, 0.0).otherwise(span / F.nullif(high, F.lit(0.0))), 3).alias("s"), F.round(high, 3).alias("v"))


def signed_score(rgb: Column) -> Column:
    """Saturation times value; positive for green, negative for red, 0 for other colours or none."""

    def signed(c: Column) -> Column:
        size = c["s"] * c["v"]
        return F.when(c["h"].between(90, 150), size).when((c["h"] <= 15) | (c["h"] >= 345), 0.0 - size).otherwise(0.0)

    return F.when(rgb.isNull() | (rgb == ""), 0.0).otherwise(let(hsv(rgb), signed))


def likert(score: Column, levels: int = 5) -> Column:
    """-levels to levels, by half-even rounding; 0 for 0 alone."""

    def graded(s: Column) -> Column:
        level = F.greatest(F.lit(1), F.bround(F.least(F.abs(s), F.lit(1.0)) * levels).cast("int"))
        return F.when(s == 0, 0).when(s > 0, level).otherwise(-level)

    return let(score, graded)


def theme_colour(index: Column, more: dict[int, str] | None = None) -> Column:
    """B26"""
    out = F.lit(None).cast("string")
    for k, v in (THEME_COLOURS | (more or {})).items():
        out = F.when(index == k, v).otherwise(out)
    return out


def value_and_likert(cell: Column) -> Column:
    """struct<value,likert> of value|n."""
    text = F.nullif(F.trim(F.regexp_extract(cell, r"^(.*?)(?:\|(-?\d+))?$", 1)), F.lit(""))
    return F.struct(text.alias("value"), F.nullif(F.regexp_extract(cell, r"^(.*?)(?:\|(-?\d+))?$", 2), F.lit("")).cast("int").alias("likert"))


def score_colour(score: Column, positive: float = 0.15, negative: float = -0.20) -> Column:
    """Rgba text; green from positive up, red from negative down, grey between."""
    alpha = F.round(F.greatest(F.lit(0.3), F.least(F.lit(0.8), F.abs(score))), 2).cast("string")
    shade = lambda rgb: F.concat(F.lit(f"rgba({rgb},"), alpha, F.lit(")"))
    return F.when(score >= positive, shade("0,128,0")).when(score <= negative, shade("200,0,0")).otherwise(shade("128,128,128"))


def scaled(values: Column) -> Column:
    """An array between its least (0) and greatest (1); a constant one is 0."""
    low, span = F.array_min(values), F.array_max(values) - F.array_min(values)
    return F.transform(values, lambda x: F.round((x - low) / F.when(span == 0, 1.0).otherwise(span), 6))


def chain_hue(chain: Column) -> Column:
    """Degrees by the golden ratio, so that neighbours differ."""
    return F.round(F.pmod(chain * 0.618033988749895, F.lit(1.0)) * 360, 3)


def encoder_name(name: Column) -> Column:
    """The canonical name; unknown names stay."""
    key = F.lower(F.trim(name))
    out = name
    for alias, canonical in ENCODER_ALIASES.items():
        out = F.when(key == alias, canonical).otherwise(out)
    return out


def cells(count: Column) -> Column:
    """How many cells an index of so many vectors has: the root, from 1 to 4096."""
    return F.least(F.lit(4096), F.greatest(F.lit(1), F.bround(F.sqrt(count.cast("double"))).cast("int")))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of struct<l,t,r,b>, with t above b; 0 apart."""
    width = F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"])
    height = F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"])
    inner = width * height
    area = lambda x: (x["r"] - x["l"]) * (x["b"] - x["t"])
    return F.when((width <= 0) | (height <= 0), 0.0).otherwise(inner / (area(a) + area(b) - inner))


def consensus(label: Column, confidence: Column, other: Column, other_confidence: Column, agree: float = 0.1, disagree: float = 0.2, least: float = 0.5) -> Column:
    """Which of two labels counts; the first rule that applies decides."""
    apart = F.abs(confidence - other_confidence)
    first, second = confidence >= least, other_confidence >= least
    return (
        F.when((other.isNull() | (other < 0)) & first, "bert_only")
        .when(other.isNull() | (other < 0), "mistrust")
        .when(~first & ~second, "mistrust")
        .when((label == other) & first & second, "agreement")
        .when((apart >= disagree) & (confidence > other_confidence), "bert_only")
        .when(apart >= disagree, "similarity_only")
        .when((label != other) & (apart >= agree), "disagreement")
        .when(first, "bert_only")
        .when(second, "similarity_only")
        .otherwise("disagreement")
    )


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers, in doubles; null where one is zero."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda z: F.sqrt(F.aggregate(z, F.lit(0.0), lambda s, v: s + v * v))
    return dot / F.nullif(norm(x) * norm(y), F.lit(0.0))
