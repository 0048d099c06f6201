"""How text and fill are fitted to regions: size caps, trusted interiors, labels, widths, nearest boxes, recursive splits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pageweave.operators.quantiles import exact_percentile

BOX = ("x1", "y1", "x2", "y2")


def font_cap(least: int, most: int, w: Column, h: Column, bubble_w: Column, bubble_h: Column, is_effect: Column) -> Column:
    """Largest font size for a text of w x h in a bubble: close to the stroke of the original, up to half more in a roomy bubble."""
    base = F.least(w, h)
    long = F.greatest(w, h) / base >= 1.5
    share = F.when(is_effect, 1.0).when(long, F.when(base < 60, 1.0).otherwise(1.1)).otherwise(F.when(base < 60, 0.95).otherwise(0.85))
    cap = F.greatest(F.floor(base * share), F.lit(24))
    room = bubble_w * bubble_h / (w * h)
    grown = F.when(~is_effect & (room > 5.0), F.floor(cap * F.least(F.sqrt(room / 5.0), F.lit(1.5)))).otherwise(cap)
    return F.when((w <= 0) | (h <= 0), most).otherwise(F.least(F.lit(most), F.greatest(F.lit(least + 4), grown))).cast("int")


def trusted(text: Column, bubble: Column, pixels: Column, page_w: int, page_h: int) -> Column:
    """Whether a bubble's interior covers the text, is centred on it and isn't too large (boxes as structs)."""
    covers = (bubble["x1"] <= text["x1"]) & (bubble["y1"] <= text["y1"]) & (bubble["x2"] >= text["x2"]) & (bubble["y2"] >= text["y2"])
    off = lambda a, b: F.abs((bubble[a] + bubble[b]) / 2 - (text[a] + text[b]) / 2) / F.greatest(F.lit(1), text[b] - text[a])
    return covers & (F.greatest(off("x1", "x2"), off("y1", "y2")) <= 1.5) & (pixels <= 0.12 * page_w * page_h)


def best_label(labels: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """Per region the label (page_id, block_idx, label, area, overlap, w, h) with most overlap, the first on a tie; too small or too large ones don't count."""
    fit = labels.where((F.col("area") >= 0.3 * F.col("w") * F.col("h")) & (F.col("area") <= 0.15 * page_w * page_h) & (F.col("overlap") > 0))
    return fit.groupBy("page_id", "block_idx").agg(F.max_by("label", F.struct("overlap", -F.col("label"))).alias("label"), F.max("overlap").alias("overlap"))


def row_widths(extents: DataFrame, share: float = 0.5) -> DataFrame:
    """Rows of a page at least ``share`` as wide as its widest, and their upper median width."""
    widest = F.max(F.col("xmax") - F.col("xmin")).over(W.partitionBy("page_id"))
    rows = extents.withColumn("w", F.col("xmax") - F.col("xmin")).withColumn("most", widest).where(F.col("w") >= share * F.col("most"))
    by = rows.groupBy("page_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    return by.select("page_id", F.size("w").cast("bigint").alias("n_rows"), F.get("w", F.floor(F.size("w") / 2).cast("int")).alias("median_w"))


def own_pixels(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels (page_id, block_idx, x, y) that no other box of the page is strictly nearer to than their own, by the larger of dx and dy."""
    beside = lambda at, lo, hi: F.greatest(F.lit(0), lo - at, at - hi)
    far = lambda b: F.greatest(beside(F.col("x"), b["x1"], b["x2"]), beside(F.col("y"), b["y1"], b["y2"]))
    of_page = boxes.groupBy("page_id").agg(F.collect_list(F.struct("block_idx", *BOX)).alias("boxes"))
    own = F.filter("boxes", lambda b: b["block_idx"] == F.col("block_idx"))
    joined = pixels.join(of_page, "page_id").withColumn("d", far(F.get(own, F.lit(0))))
    return joined.where(F.col("d").isNotNull() & ~F.exists("boxes", lambda b: far(b) < F.col("d"))).select(*pixels.columns)


def fill_kind(rim: DataFrame) -> DataFrame:
    """Per component (page_id) whether its rim (x, y, light) is one colour, a plane of light, or a texture, with its median light.

    The plane is fitted by least squares in closed form from second moments, so partial aggregation does all the work.
    """
    c = lambda a, b: F.covar_pop(a, b)
    m = rim.groupBy("page_id").agg(
        F.count("light").alias("n"), F.stddev_pop("light").alias("std"),
        c("x", "x").alias("xx"), c("y", "y").alias("yy"), c("x", "y").alias("xy"), c("x", "light").alias("xl"), c("y", "light").alias("yl"),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    both = (F.col("xl") * F.col("xl") * F.col("yy") - 2 * F.col("xl") * F.col("yl") * F.col("xy") + F.col("yl") * F.col("yl") * F.col("xx")) / det
    one = F.greatest(F.when(F.col("xx") > 0, F.col("xl") * F.col("xl") / F.col("xx")), F.when(F.col("yy") > 0, F.col("yl") * F.col("yl") / F.col("yy")), F.lit(0.0))
    left = F.sqrt(F.greatest(F.col("std") * F.col("std") - F.when(det > 1e-9, both).otherwise(one), F.lit(0.0)))
    kind = F.when(F.col("n") < 20, "TEXTURE").when(F.col("std") < 8, "SOLID").when(left < 6, "GRADIENT").otherwise("TEXTURE")
    return m.select("page_id", "n", kind.alias("kind")).join(exact_percentile(rim, ["page_id"], "light", 0.5, "median"), "page_id", "left").withColumn("median", F.when(F.col("kind") != "TEXTURE", F.col("median")))


def _parts(rows: pd.DataFrame, gap: int, low: str = "y1") -> Iterator[pd.DataFrame]:
    """Components parted at gaps along y, else along x, and each part again, until none has a gap."""
    for lo, hi in (("y1", "y2"), ("x1", "x2")):
        s = rows.sort_values([lo, "comp_id"])
        part = (s[lo] - s[hi].cummax().shift() > gap).cumsum()
        if part.iloc[-1]:
            for _, p in s.groupby(part):
                yield from _parts(p, gap)
            return
    yield rows


def split_regions(components: DataFrame, gap: int = 20, least: int = 40, pad: int = 4) -> DataFrame:
    """Boxes of the groups into which the components (page_id, block_idx, comp_id, box, area) of each region fall at gaps of more than ``gap``.

    The group task holds the components of one region. Components below ``least`` don't count; boxes are padded and cut at 0.
    """

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        of = [(p["comp_id"].min(), len(p), max(0, p["x1"].min() - pad), max(0, p["y1"].min() - pad), p["x2"].max() + pad, p["y2"].max() + pad) for p in _parts(rows, gap)]
        out = pd.DataFrame(of, columns=["first_comp", "n_comps", *BOX])
        return out.assign(page_id=rows["page_id"].iloc[0], block_idx=rows["block_idx"].iloc[0])[["page_id", "block_idx", *out.columns]]

    kept = components.where(F.col("area") >= least).select("page_id", "block_idx", "comp_id", *BOX)
    return kept.groupBy("page_id", "block_idx").applyInPandas(split, "page_id long, block_idx int, first_comp long, n_comps long, x1 long, y1 long, x2 long, y2 long")


def detections(raw: DataFrame, page_w: int, page_h: int, least_score: float = 0.4, least_side: int = 5) -> DataFrame:
    """Boxes of a letterboxed page brought back to it (scale, pad_x, pad_y), above the score and of some size, in raw order.

    The class is the first with the highest probability; the score is that times the objectness.
    """
    top = F.array_max("classes")
    back = lambda c, pad, most: F.least(F.greatest((F.col(c) - F.col(pad)) / F.col("scale"), F.lit(0.0)), F.lit(float(most))).cast("int").alias(c)
    out = raw.withColumn("score", F.col("objectness") * top).where(F.col("score") > least_score)
    out = out.select("page_id", "box_id", "score", (F.array_position("classes", top) - 1).cast("int").alias("cls"), back("x1", "pad_x", page_w), back("y1", "pad_y", page_h), back("x2", "pad_x", page_w), back("y2", "pad_y", page_h))
    out = out.where((F.col("x2") - F.col("x1") >= least_side) & (F.col("y2") - F.col("y1") >= least_side))
    return out.withColumn("raw_pos", F.row_number().over(W.partitionBy("page_id").orderBy("y1", F.desc("x1"), "box_id")))
