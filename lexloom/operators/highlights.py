"""Highlights of pages: boxes of sentences and mentions, merged and covered."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.scores import iou


def collected(rows: DataFrame, least: float = 0.7) -> DataFrame:
    """(doc_id, sentence_id, page, bbox) of rows with confidence of `least` or more: the sentence's own box, else that
    of its first span (spans: array<struct<bbox>>); rows without one go."""
    box = F.coalesce("bbox", F.get("spans", 0)["bbox"])
    return rows.where(F.col("confidence") >= least).withColumn("bbox", box).where("bbox is not null").select("doc_id", "sentence_id", "page", "bbox")


def uncovered(boxes: DataFrame, by: DataFrame, least: float = 0.85) -> DataFrame:
    """Boxes (doc_id, page, bbox) that no box of `by` on their page covers to that intersection over union."""
    b = by.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), F.col("bbox").alias("other"))
    return boxes.join(b, (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")) & (iou(F.col("bbox"), F.col("other")) >= least), "left_anti")


def merge_boxes(boxes: list[tuple[float, float, float, float]], least: float = 0.6) -> list[tuple[float, float, float, float]]:
    """In order, each box (l, t, r, b) widens the first one so far that it overlaps enough, or stands for itself."""

    def alike(x, y) -> float:
        w, h = min(x[2], y[2]) - max(x[0], y[0]), min(x[3], y[3]) - max(x[1], y[1])
        if w <= 0 or h <= 0:
            return 0.0
        return w * h / ((x[2] - x[0]) * (x[3] - x[1]) + (y[2] - y[0]) * (y[3] - y[1]) - w * h)

    out: list[tuple[float, float, float, float]] = []
    for box in boxes:
        at = next((i for i, o in enumerate(out) if alike(box, o) >= least), None)
        if at is None:
            out.append(box)
        else:
            o = out[at]
            out[at] = (min(o[0], box[0]), min(o[1], box[1]), max(o[2], box[2]), max(o[3], box[3]))
    return out


def merged(boxes: DataFrame, least: float = 0.6) -> DataFrame:
    """(doc_id, page, l, t, r, b) of boxes (doc_id, page, pos, l, t, r, b). The order within a page decides, so the
    boxes of a page are taken together."""
    kind = dict(boxes.dtypes)

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        out = merge_boxes(list(zip(pdf["l"], pdf["t"], pdf["r"], pdf["b"], strict=True)), least)
        return pd.DataFrame([(pdf["doc_id"].iloc[0], pdf["page"].iloc[0], *o) for o in out], columns=["doc_id", "page", "l", "t", "r", "b"])

    return boxes.groupBy("doc_id", "page").applyInPandas(each, f"doc_id {kind['doc_id']}, page {kind['page']}, l double, t double, r double, b double")


def flipped(boxes: DataFrame, height: str = "page_height") -> DataFrame:
    """Boxes with their origin at the top, of ones (l, t, r, b) with it at the bottom."""
    return boxes.withColumns({"t": F.col(height) - F.greatest("t", "b"), "b": F.col(height) - F.least("t", "b")})
