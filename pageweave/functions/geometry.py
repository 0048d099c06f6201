"""Box arithmetic as column expressions; coordinates are whole pixels, not negative."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def band(y: Column, height: int, share: float) -> Column:
    """Horizontal band of a centre line."""
    return F.floor(y / max(1, int(height * share)))


def centre(a: Column, b: Column) -> Column:
    return F.floor((a + b) / 2)


def position_tag(x1: Column, y1: Column, x2: Column, y2: Column, w: int, h: int) -> Column:
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
    v = F.when(cy < h / 3, "top").when(cy > 2 * h / 3, "bottom").otherwise("middle")
    s = F.when(cx > 2 * w / 3, "right").when(cx < w / 3, "left").otherwise("center")
    return F.concat_ws("-", v, s)


def clamp_box(x1: Column, y1: Column, x2: Column, y2: Column, w: int, h: int) -> Column:
    a, b = F.least(F.greatest(x1, F.lit(0)), F.lit(w - 1)), F.least(F.greatest(y1, F.lit(0)), F.lit(h - 1))
    return F.struct(a.alias("x1"), b.alias("y1"), F.greatest(a + 1, F.least(x2, F.lit(w))).alias("x2"), F.greatest(b + 1, F.least(y2, F.lit(h))).alias("y2"))


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(x2 - x1, F.lit(0)).cast("bigint") * F.greatest(y2 - y1, F.lit(0))


def overlap(a: Column, b: Column) -> Column:
    """Common area of two boxes (structs of x1, y1, x2, y2)."""
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0)).cast("bigint")
    return side("x1", "x2") * side("y1", "y2")


def inscribed_box(text: Column, rect: Column, share: float = 0.5, inset: float = 0.04) -> Column:
    """Where text is drawn in a rectangle inscribed in its balloon: ``rect`` shrunk on every side by a share of its own side; null where it
    covers less than ``share`` of the text's box, or where a coordinate is null."""
    text_area = F.greatest((text["x2"] - text["x1"]).cast("bigint") * (text["y2"] - text["y1"]), F.lit(1))
    dx, dy = F.floor((rect["x2"] - rect["x1"]) * F.lit(inset)), F.floor((rect["y2"] - rect["y1"]) * F.lit(inset))
    shrunk = F.struct((rect["x1"] + dx).alias("rx1"), (rect["y1"] + dy).alias("ry1"), (rect["x2"] - dx).alias("rx2"), (rect["y2"] - dy).alias("ry2"))
    known = sum((box[c] for box in (text, rect) for c in ("x1", "y1", "x2", "y2")), F.lit(0)).isNotNull()  # least and greatest pass nulls over
    return F.when(known & (overlap(text, rect) >= share * text_area), shrunk)


def tile(x1: Column, y1: Column, x2: Column, y2: Column, w: int, h: int, pad: float = 0.5, least: int = 256) -> Column:
    """A square-ish tile around a box: padded, grown to its longer side or the least side, kept on the page."""
    bw, bh = x2 - x1, y2 - y1
    margin = F.greatest(F.lit(32), F.floor(F.least(bw, bh) * 0.25))
    px, py = F.greatest(F.floor(bw * pad), margin), F.greatest(F.floor(bh * pad), margin)
    a, b = F.greatest(F.lit(0), x1 - px), F.greatest(F.lit(0), y1 - py)
    c, d = F.least(F.lit(w), x2 + px), F.least(F.lit(h), y2 + py)
    side = F.greatest(c - a, d - b, F.lit(least))

    def grow(lo: Column, hi: Column, most: int) -> tuple[Column, Column]:
        start = F.greatest(F.lit(0), lo - F.floor((side - (hi - lo)) / 2))
        end = F.least(F.lit(most), start + side)
        short = hi - lo < side
        return F.when(short, F.greatest(F.lit(0), end - side)).otherwise(lo), F.when(short, end).otherwise(hi)

    (ax, cx), (by, dy) = grow(a, c, w), grow(b, d, h)
    return F.struct(ax.cast("bigint").alias("tx1"), by.cast("bigint").alias("ty1"), cx.cast("bigint").alias("tx2"), dy.cast("bigint").alias("ty2"))


def feather(area_px: Column) -> Column:
    return F.when(area_px < 500, 7).when(area_px < 2000, 11).when(area_px < 8000, 15).otherwise(21)


#: Pixels around a region that recognition reads, and around a sample for the language.
CROP_PAD, SAMPLE_PAD = 2, 4


def padded_box(x1: Column, y1: Column, x2: Column, y2: Column, w: int, h: int, pad: int = CROP_PAD) -> Column:
    """The box with a margin, cut at the page; null where nothing of the page is in it."""
    cut = F.struct(F.greatest(F.lit(0), x1 - pad).alias("x1"), F.greatest(F.lit(0), y1 - pad).alias("y1"), F.least(F.lit(w), x2 + pad).alias("x2"), F.least(F.lit(h), y2 + pad).alias("y2"))
    return F.when((cut["x2"] > cut["x1"]) & (cut["y2"] > cut["y1"]), cut)
