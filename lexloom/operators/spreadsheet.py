"""Spreadsheets: two header rows, colours as scores, flat rows with URLs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import scores as S
from lexloom.functions import text as T


def headers(first: list[str | None], second: list[str | None]) -> list[str]:
    """Names from two header rows, the first of which is filled from the left."""
    out, last = [], ""
    for a, b in zip(first, second, strict=True):
        last = a or last
        out.append("|".join(x for x in (last, b) if x))
    return out


def graded(cells: DataFrame, levels: int = 5) -> DataFrame:
    """Adds score and likert to cells with rgb, or a theme where that is null."""
    colour = F.coalesce("rgb", S.theme_colour(F.col("theme")))
    return cells.withColumn("score", S.signed_score(colour)).withColumn("likert", S.likert(F.col("score"), levels))


def fullest(rows: DataFrame, columns: list[str]) -> str:
    """Of columns that could stand for a field, the one with most cells that aren't blank; the first of equals."""
    counts = rows.agg(*[F.count_if(F.trim(F.col(c)) != "").alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return columns[max(range(len(columns)), key=lambda i: (counts[i], -i))]


def flattened(rows: DataFrame, order: str, goal: str, target: str, reference: str, group: list[str] | None = None, payload: list[str] | None = None) -> DataFrame:
    """Rows with blank cells as nulls, the goal filled from above, extracted_url and all_urls of the reference.

    Rows without a target go, or, if a payload is named, those without any of it. With `group` (a sheet), filling is within
    it; without, all rows are one sheet, which is read in its order.
    """
    blank = lambda c: F.nullif(F.regexp_replace(F.col(c).cast("string"), r"^\s+$", ""), F.lit(""))
    fields = [goal, target, reference, *(payload or [])]
    clean = rows.withColumns({c: blank(c) for c in dict.fromkeys(fields)})
    above = Window.partitionBy(*(group or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    clean = clean.withColumn(goal, F.last(goal, ignorenulls=True).over(above))
    clean = clean.where(F.col(target).isNotNull()) if not payload else clean.where(F.coalesce(*payload).isNotNull())
    found = F.coalesce(T.urls(F.col(reference)), F.array().cast("array<string>"))
    return clean.withColumn("all_urls", found).withColumn("extracted_url", F.get("all_urls", 0))


def enriched(rows: DataFrame, bibliography: DataFrame, key: str, url_column: str = "all_urls") -> DataFrame:
    """A10: (key, titles, other_urls): URLs whose DOI is in the bibliography (doi, title) give its title; others stay."""
    each = rows.select(key, F.posexplode_outer(url_column).alias("pos", "url")).withColumn("doi", F.lower(T.doi(F.col("url"))))
    found = each.join(bibliography.select(F.lower("doi").alias("b"), "title"), F.col("doi") == F.col("b"), "left")
    listed = lambda c, keep: F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("pos", c)))), lambda x: x[c])
    return found.groupBy(key).agg(listed("title", F.col("title").isNotNull()).alias("titles"), listed("url", F.col("title").isNull() & F.col("url").isNotNull()).alias("other_urls"))


def fetched(dois: DataFrame, load: Callable[[], Callable[[str], dict | None]]) -> DataFrame:
    """A10: (doi, title, abstract, pdf_url) of different DOIs, by a plug-in that asks a service.

    load() is called once by each worker, and gives a function of a DOI to what is known of it. What it fails on, by an
    OSError such as that of a connection, or doesn't know, is null, so that one DOI doesn't end a run.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = load()
        for pdf in batches:
            rows = []
            for doi in pdf["doi"]:
                try:
                    known = ask(doi) or {}
                except OSError:
                    known = {}
                rows.append((doi, known.get("title"), known.get("abstract"), known.get("pdf_url")))
            yield pd.DataFrame(rows, columns=["doi", "title", "abstract", "pdf_url"])

    asked = dois.select(F.lower("doi").alias("doi")).where("doi is not null").distinct()
    return asked.mapInPandas(each, "doi string, title string, abstract string, pdf_url string")


def cell_parts(cell: Column) -> Column:
    """B27"""
    return S.value_and_likert(cell)
