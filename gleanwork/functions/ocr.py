"""What OCR results tell: areas, confidences, and whether a picture is an infographic."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Short words match anywhere in a text, so this is configuration and not a fixed list.
KEYWORDS = ("announcement", "schedule", "registration", "timetable")


def poly_area(poly: Column) -> Column:
    """The area of a polygon, array<struct<x, y>>, by the shoelace formula."""
    shifted = F.concat(F.slice(poly, 2, F.size(poly)), F.slice(poly, 1, 1))
    cross = F.zip_with(poly, shifted, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(poly) > 0, F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2).otherwise(F.lit(0.0))


def mean_confidence(boxes: Column) -> Column:
    conf = F.filter(F.transform(boxes, lambda b: b["conf"]), lambda c: c.isNotNull())
    total = F.aggregate(conf, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(conf) > 0, total / F.nullif(F.size(conf), F.lit(0))).otherwise(F.lit(0.0))


def area_ratio(boxes: Column, height: Column, width: Column) -> Column:
    total = F.aggregate(F.transform(boxes, lambda b: poly_area(b["poly"])), F.lit(0.0), lambda s, x: s + x)
    return total / F.greatest(F.lit(1), height * width)


def joined_text(boxes: Column) -> Column:
    return F.array_join(F.filter(F.transform(boxes, lambda b: b["text"]), lambda t: t.isNotNull()), " ")


def is_infographic(height: Column, width: Column, boxes: Column, alt: Column, hint: Column, keywords: Iterable[str] = KEYWORDS, min_side: int = 320) -> Column:
    """Large enough, and: without text boxes, a keyword in alt or hint; else six boxes, much confident text, or a keyword in the text."""

    def has_keyword(text: Column) -> Column:
        out = F.lit(False)
        for k in keywords:
            out = out | F.contains(F.lower(text), F.lit(k.lower()))
        return out

    none = F.coalesce(F.size(boxes) <= 0, F.lit(True))
    outside = has_keyword(F.concat_ws(" ", F.coalesce(alt, F.lit("")), F.coalesce(hint, F.lit(""))))
    much = (area_ratio(boxes, height, width) >= 0.08) & (mean_confidence(boxes) >= 0.5)
    inside = (F.size(boxes) >= 6) | much | has_keyword(joined_text(boxes))
    return F.coalesce((F.least(height, width) >= min_side) & F.when(none, outside).otherwise(inside), F.lit(False))
