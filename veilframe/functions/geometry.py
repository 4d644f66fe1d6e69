"""Rectangles on pages, as structs of x0, y0, x1, y1 in points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x0, y0, x1, y1) -> Column:
    cols = (F.lit(v) if not isinstance(v, Column) else v for v in (x0, y0, x1, y1))
    return F.struct(*(c.cast("double").alias(n) for c, n in zip(cols, ("x0", "y0", "x1", "y1"))))


def area(r: Column) -> Column:
    return (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])


def touches(a: Column, b: Column) -> Column:
    """The rectangles share more than an edge."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def label_size(height: Column) -> Column:
    """Font size for a value written into a box: 0.72 of its height, between 6 and 11."""
    return F.greatest(F.lit(6.0), F.least(F.lit(11.0), height * 0.72))


def code_area(anchor: Column, width: Column) -> Column:
    """Around the footer phrase beside which a code is printed; null without it."""
    return F.when(anchor.isNotNull(), rect(0.0, anchor["y0"] - 100, width, anchor["y1"] + 50))


def place_area(label: Column, width: Column) -> Column:
    """The address block right of its label; null without it."""
    return F.when(label.isNotNull(), rect(label["x1"] + 20, label["y0"] - 2, width, label["y0"] + 58))


def signature_area(end_y: Column, signature_y: Column, width: Column) -> Column:
    """From above the signature, or 90 points above the end line without one, to the end line; null if that is empty."""
    upper = F.coalesce(signature_y - 5, end_y - 90)
    return F.when(end_y.isNotNull() & (upper < end_y), rect(0.0, upper, width, end_y))


def signature_shaped(r: Column) -> Column:
    """Under 70 points high and two to six times as wide as high."""
    height, width = r["y1"] - r["y0"], r["x1"] - r["x0"]
    return (height > 0) & (height < 70) & F.coalesce((width / F.nullif(height, F.lit(0.0))).between(2.0, 6.0), F.lit(False))
