"""Boxes in points, origin top left: struct<left, top, right, bottom>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(left, top, right, bottom) -> Column:
    names = ("left", "top", "right", "bottom")
    return F.struct(*((c if isinstance(c, Column) else F.col(c)).cast("double").alias(n) for c, n in zip((left, top, right, bottom), names)))


def width(b: Column) -> Column:
    return b["right"] - b["left"]


def height(b: Column) -> Column:
    return b["bottom"] - b["top"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def _apart(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    return F.greatest(F.lit(0.0), a_low - b_high, b_low - a_high)


def gap(a: Column, b: Column) -> Column:
    """Straight distance between two boxes, 0 where they touch."""
    return F.hypot(_apart(a["left"], a["right"], b["left"], b["right"]), _apart(a["top"], a["bottom"], b["top"], b["bottom"]))


def same_column(a: Column, b: Column) -> Column:
    return F.least(a["right"], b["right"]) > F.greatest(a["left"], b["left"])


def column_gap(a: Column, a_page: Column, b: Column, b_page: Column) -> Column:
    """Vertical distance of two boxes of one page and column, else null."""
    return F.when((a_page == b_page) & same_column(a, b), _apart(a["top"], a["bottom"], b["top"], b["bottom"]))


def near_score(distance: Column, most: float) -> Column:
    return 1 - distance / F.lit(float(most))


def from_bottom_left(left: Column, bottom: Column, right: Column, top: Column, page_width: Column, page_height: Column, slack: float = 1.0) -> Column:
    """A box with its origin at the bottom left as one with it at the top left. Edges outside the page by at most `slack` are
    clamped, by more they fail the query, as does a box that is not ordered."""

    def clamp(x: Column, most: Column) -> Column:
        ok = (x >= -slack) & (x <= most + slack)
        return F.when(ok, F.least(F.greatest(x, F.lit(0.0)), most)).otherwise(F.raise_error(F.lit("a box lies outside its page")).cast("double"))

    found = box(clamp(left, page_width), clamp(page_height - top, page_height), clamp(right, page_width), clamp(page_height - bottom, page_height))
    ordered = (right >= left) & (top >= bottom)
    return F.when(ordered, found).otherwise(F.raise_error(F.lit("a box is not ordered")).cast("struct<left:double,top:double,right:double,bottom:double>"))
