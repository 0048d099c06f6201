"""Operators over the positioned text regions of pages. Everything is local to a page, so ``page_id`` is the only exchange."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pageweave.functions import geometry as G
from pageweave.functions import text as T

BOX = ("x1", "y1", "x2", "y2")
#: How sure the role rule is of a short text in a bubble, dialogue that has a sub-type as effects have.
INTERJECTION = 0.60


def reading_order(blocks: DataFrame, page_h: int, share: float = 0.25) -> DataFrame:
    """Bands from top to bottom, right to left within a band, then by index."""
    cx, cy = G.centre(F.col("x1"), F.col("x2")), G.centre(F.col("y1"), F.col("y2"))
    w = W.partitionBy("page_id").orderBy(G.band(cy, page_h, share), -cx, "block_idx")
    return blocks.withColumn("reading_pos", F.row_number().over(w))


def speaker_turns(ordered: DataFrame, page_w: int, page_h: int, share: float = 0.18) -> DataFrame:
    """A new turn begins where the band differs from that of the block before in reading order."""
    w = W.partitionBy("page_id").orderBy("reading_pos")
    b = G.band(G.centre(F.col("y1"), F.col("y2")), page_h, share)
    side = F.when(G.centre(F.col("x1"), F.col("x2")) > page_w // 2, "right").otherwise("left")
    turned = ordered.withColumn("band", b).withColumn("new", F.coalesce((F.lag("band").over(w) != F.col("band")).cast("int"), F.lit(1)))
    return turned.withColumn("turn", F.concat(F.lit("turn"), F.sum("new").over(w).cast("string"), F.lit("-"), side)).drop("band", "new")


def _greedy(page: DataFrame, order: Column, drop: callable) -> DataFrame:
    """Page by page, boxes in order; a box stays unless ``drop(kept, box)`` holds for one kept before it."""
    sorted_ = F.sort_array(F.collect_list(order))
    grouped = page.groupBy("page_id").agg(sorted_.alias("b"))
    empty = F.slice("b", 1, 0)
    kept = F.aggregate("b", empty, lambda acc, x: F.when(F.exists(acc, lambda k: drop(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return grouped.select("page_id", F.explode(kept).alias("k")).select("page_id", "k.block_idx", *[f"k.{c}" for c in BOX])


def dedupe_blocks(blocks: DataFrame, iou: float = 0.35, contain: float = 0.65) -> DataFrame:
    """Larger boxes suppress smaller ones that they mostly contain or overlap; empty boxes go."""
    a = G.area(*[F.col(c) for c in BOX])
    order = F.struct((-a).alias("k"), "block_idx", *BOX)

    def drop(k: Column, x: Column) -> Column:
        inter, ax = G.overlap(k, x), -x["k"]
        return (inter > 0) & ((inter > contain * ax) | (inter > iou * (-k["k"] + ax - inter)))

    return _greedy(blocks.where(a > 0), order, drop)


def nms(blocks: DataFrame, score: str = "score", least: float = 0.4, iou: float = 0.45) -> DataFrame:
    order = F.struct((-F.col(score)).alias("k"), "block_idx", *BOX)

    def drop(k: Column, x: Column) -> Column:
        inter = G.overlap(k, x)
        union = G.area(*[k[c] for c in BOX]) + G.area(*[x[c] for c in BOX]) - inter
        return inter > iou * union

    return _greedy(blocks.where(F.col(score) > least), order, drop)


def overlap_pairs(blocks: DataFrame) -> DataFrame:
    """Pairs of a page's boxes with common area."""
    box = lambda s: F.struct(*[F.col(f"{s}.{c}") for c in BOX])
    pairs = blocks.alias("a").join(blocks.alias("b"), (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.block_idx") < F.col("b.block_idx")))
    return pairs.select("a.page_id", F.col("a.block_idx").alias("a_idx"), F.col("b.block_idx").alias("b_idx"), G.overlap(box("a"), box("b")).alias("inter")).where("inter > 0")


def inscribed_fits(blocks: DataFrame, rects: DataFrame) -> DataFrame:
    """Of a page's text boxes and inscribed rectangles (page_id, rect_idx, x1 to y2), the pairs that fit and the box drawn into."""
    box = lambda s: F.struct(*[F.col(f"{s}.{c}") for c in BOX])
    pairs = blocks.alias("a").join(rects.alias("b"), F.col("a.page_id") == F.col("b.page_id"))
    fits = pairs.select("a.page_id", "a.block_idx", "b.rect_idx", G.inscribed_box(box("a"), box("b")).alias("r"))
    return fits.where("r is not null").select("page_id", "block_idx", "rect_idx", "r.*")


def gap_groups(blocks: DataFrame, gap: int = 20) -> DataFrame:
    """Groups along y: a new one where a box starts more than ``gap`` below all that came before."""
    w = W.partitionBy("page_id").orderBy("y1", "block_idx")
    far = F.max("y2").over(w.rowsBetween(W.unboundedPreceding, -1))
    return blocks.withColumn("new", F.coalesce((F.col("y1") - far > gap).cast("int"), F.lit(0))).withColumn("gap_group", F.sum("new").over(w).cast("int")).drop("new")


def recover(components: DataFrame, existing: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """Components that look like missed text and are not mostly covered by an existing box, padded by 6."""
    c = components.where("area >= 200 and cw >= 8 and ch >= 8").where(F.col("cw") * F.col("ch") <= 0.1 * page_w * page_h)
    c = c.where(F.greatest("cw", "ch") <= 30 * F.least("cw", "ch")).where(F.col("raw_pixels") >= 0.05 * F.col("cw") * F.col("ch")).where("annulus_mean >= 185")
    box = F.struct(F.col("cx").alias("x1"), F.col("cy").alias("y1"), (F.col("cx") + F.col("cw")).alias("x2"), (F.col("cy") + F.col("ch")).alias("y2"))
    other = existing.select("page_id", F.struct(*BOX).alias("o"))
    covered = c.join(other, "page_id").where(G.overlap(box, F.col("o")) > 0.4 * F.col("cw") * F.col("ch")).select("page_id", "comp_id").distinct()
    low = lambda k: F.greatest(F.col(k) - 6, F.lit(0))
    high = lambda k, s, most: F.least(F.col(k) + F.col(s) + 6, F.lit(most))
    return c.join(covered, ["page_id", "comp_id"], "left_anti").select("page_id", "comp_id", low("cx").alias("x1"), low("cy").alias("y1"), high("cx", "cw", page_w).alias("x2"), high("cy", "ch", page_h).alias("y2"))


def with_recovered(blocks: DataFrame, components: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """The blocks (with score and cls) and after them the recovered ones, which have score 0.30 and class 1, in order of their components."""
    found = recover(components, blocks, page_w, page_h)
    most = blocks.groupBy("page_id").agg((F.max("block_idx") + 1).alias("next"))
    at = F.coalesce("next", F.lit(0)) + F.row_number().over(W.partitionBy("page_id").orderBy("comp_id")) - 1
    new = found.join(most, "page_id", "left").select("page_id", at.cast("int").alias("block_idx"), *[F.col(c).cast("int").alias(c) for c in BOX], F.lit(0.30).alias("score"), F.lit(1).alias("cls"))
    return blocks.select("page_id", "block_idx", *BOX, "score", "cls").unionByName(new)


def detect(raw: DataFrame, parts: DataFrame, components: DataFrame, page_w: int, page_h: int) -> tuple[DataFrame, DataFrame]:
    """The detector's chain: overlapping boxes go, regions are split, missed text is recovered. Returns the blocks, and per page the counts of
    raw, deduplicated, split and all blocks. ``parts`` are the pieces (page_id, block_idx, box) of regions that ``split_regions`` parts."""
    scored = raw.select("page_id", "block_idx", "score", "cls")
    kept = dedupe_blocks(raw).join(scored, ["page_id", "block_idx"])
    several = parts.groupBy("page_id", "block_idx").agg(F.count("*").alias("n_parts")).where("n_parts > 1").drop("n_parts")
    whole = kept.join(several, ["page_id", "block_idx"], "left_anti").withColumn("first_comp", F.lit(0).cast("bigint"))
    split = parts.join(several, ["page_id", "block_idx"], "left_semi").select("page_id", "block_idx", "first_comp", *[F.col(c).cast("int").alias(c) for c in BOX])
    split = split.join(kept.select("page_id", "block_idx", "score", "cls"), ["page_id", "block_idx"]).select(whole.columns)
    order = W.partitionBy("page_id").orderBy("block_idx", "first_comp")
    blocks = whole.unionByName(split).withColumn("block_idx", (F.row_number().over(order) - 1).cast("int")).drop("first_comp")
    found = with_recovered(blocks, components, page_w, page_h)
    n = lambda df, name: df.groupBy("page_id").agg(F.count("*").alias(name))
    counts = n(raw, "n_raw").join(n(kept, "n_after_dedupe"), "page_id", "left").join(n(blocks, "n_after_split"), "page_id", "left").join(n(found, "n_blocks"), "page_id", "full")
    return found, counts.na.fill(0)


def translate_candidates(roles: DataFrame, skip_preserved: bool = True) -> DataFrame:
    """Blocks that go to the translator; preserved ones too where they aren't skipped."""
    return translatable(roles if skip_preserved else roles.withColumn("preserve", F.lit(False)))


def layout(blocks: DataFrame, tall: float = 1.6, most: float = 0.4) -> DataFrame:
    """Blocks of a page, the share that is much taller than wide, and whether that makes it vertical."""
    side = lambda a, b: F.greatest(F.col(b) - F.col(a), F.lit(1))
    share = F.avg(F.when(side("y1", "y2") / side("x1", "x2") >= tall, 1.0).otherwise(0.0))
    return blocks.groupBy("page_id").agg(F.count("*").alias("n_blocks"), share.alias("tall_share"), (share >= most).alias("is_vertical"))


def largest(blocks: DataFrame, k: int = 4) -> DataFrame:
    """The k largest blocks of a page, the higher score first on a tie, then the smaller index."""
    rows = blocks.select("page_id", "block_idx", G.area(*[F.col(c) for c in BOX]).alias("area"), "score")
    return rows.withColumn("r", F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("area"), F.desc("score"), "block_idx"))).where(F.col("r") <= k).drop("r", "score")


def roles(blocks: DataFrame, ocr: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """Role, sub-type and preservation of every block; a block without recognised text has the empty text."""
    read = ocr.select("page_id", "block_idx", F.col("text").alias("t"), "ocr_conf", "ocr_failed")
    joined = blocks.select("page_id", "block_idx", *BOX, "cls").join(read, ["page_id", "block_idx"], "left").withColumn("t", F.coalesce("t", F.lit("")))
    share = G.area(*[F.col(c) for c in BOX]) / float(page_w * page_h)
    aspect = F.greatest(F.col("y2") - F.col("y1"), F.lit(1)) / F.greatest(F.col("x2") - F.col("x1"), F.lit(1))
    # inlined from an array of one, so that the rules run once a row whatever is read of their result
    out = joined.select("page_id", "block_idx", "t", F.coalesce("ocr_failed", F.lit(False)).alias("failed"), F.inline(F.array(T.sfx_role(F.col("t"), F.col("cls"), share, aspect, F.col("ocr_conf")))))
    return out.select(
        "page_id", "block_idx", "t", F.when(F.col("failed"), "unknown").otherwise(F.col("role")).alias("role"), F.when((F.col("role") == "sfx") | (F.col("role_conf") == INTERJECTION), T.sfx_subtype(F.col("t"))).otherwise("unknown").alias("sfx_subtype"),
        (~F.col("failed")).alias("should_translate"), (F.col("failed") | F.col("preserve")).alias("preserve"), F.col("preserve").alias("profile_preserve"),
    )


def preserved(roles: DataFrame, translations: DataFrame, enabled: bool = True) -> DataFrame:
    """Blocks kept out of cleaning: preserved effects, and CJK text without Latin letters that has no real translation. Switched off, all of them."""
    if not enabled:
        return roles.select("page_id", "block_idx")
    done = translations.where(T.is_real_translation(F.col("translated"))).select("page_id", "block_idx", F.lit(True).alias("done"))
    joined = roles.join(done, ["page_id", "block_idx"], "left")
    plain = T.has_cjk(F.col("t")) & ~T.has_latin_letters(F.col("t")) & F.col("done").isNull()
    return joined.where(F.col("profile_preserve") | plain).select("page_id", "block_idx")


def _longest(words: pa.Array) -> pa.Array:
    """Ends of the longest run of set bits in each list of words (at, bits) in order, the leftmost on a tie; null without any."""
    flat, n = words.flatten(), words.value_lengths().to_numpy()
    bits = np.nan_to_num(flat.field("bits").fill_null(0).to_numpy(zero_copy_only=False)).astype("<i8")
    word, bit = np.divmod(np.flatnonzero(np.unpackbits(bits.view("u1"), bitorder="little")), 64)
    x, row = flat.field("at").fill_null(0).to_numpy(zero_copy_only=False).astype("i8")[word] * 64 + bit, np.repeat(np.arange(len(n)), n)[word]
    new = np.flatnonzero((np.diff(x, prepend=-1) != 1) | (np.diff(row, prepend=-1) != 0))
    last = np.append(new[1:], len(x)) - 1 if len(x) else new
    a, b, row = x[new], x[last], row[new]
    best = np.lexsort((a, a - b, row))
    best = best[np.diff(row[best], prepend=-1) != 0]
    xmin, xmax, none = np.zeros(len(n), "i8"), np.zeros(len(n), "i8"), np.ones(len(n), bool)
    xmin[row[best]], xmax[row[best]], none[row[best]] = a[best], b[best], False
    return pa.StructArray.from_arrays([pa.array(xmin, mask=none), pa.array(xmax, mask=none)], ["xmin", "xmax"])


def longest_runs(pixels: DataFrame) -> DataFrame:
    """xmin and xmax of the longest run of set pixels in each row of a page, the leftmost on a tie.

    Pixels become bits of words before they move, so a task holds words, not pixels, and none are sorted but the words of a row.
    """
    word = pixels.groupBy("page_id", "y", F.shiftright(F.col("x").cast("bigint"), 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("bits"))
    rows = word.groupBy("page_id", "y").agg(F.sort_array(F.collect_list(F.struct("at", "bits"))).alias("words")).withColumn("run", F.arrow_udf(_longest, "struct<xmin: bigint, xmax: bigint>")("words"))
    kind = dict(pixels.dtypes)["x"]
    return rows.select("page_id", "y", F.col("run.xmin").cast(kind).alias("xmin"), F.col("run.xmax").cast(kind).alias("xmax"))


def translatable(roles: DataFrame) -> DataFrame:
    """Blocks with text that is to be translated and not kept as drawn."""
    return roles.where((T.strip(F.col("t")) != "") & F.coalesce("should_translate", F.lit(True)) & ~F.coalesce("preserve", F.lit(False)))


def _crossings(n: np.ndarray, anchor: np.ndarray, x: np.ndarray, y: np.ndarray, height: int) -> tuple[np.ndarray, ...]:
    """Polygon's place, row, xmin and xmax of some polygons of ``n`` corners each, by polygon and row."""
    start = np.cumsum(n) - n
    after = np.arange(1, len(x) + 1)
    after[start + n - 1] = start
    page = np.repeat(np.arange(len(n)), n)
    nx, ny = (np.where(np.isnan(v[after]), v[start][page], v[after]) for v in (x, y))
    edge = (n[page] >= 3) & (y != ny) & ~np.isnan(y) & ~np.isnan(ny)
    page, x, y, nx, ny = (v[edge] for v in (page, x, y, nx, ny))
    a, b, xa, xb = np.minimum(y, ny), np.maximum(y, ny), np.where(y < ny, x, nx), np.where(y < ny, nx, x)
    first = np.maximum(np.ceil(a - 0.5), 0).astype("i8")
    spans = np.maximum(np.minimum(np.ceil(b - 0.5) - 1, height - 1).astype("i8") - first + 1, 0)
    e = np.repeat(np.arange(len(a)), spans)
    row = first[e] + np.arange(len(e)) - np.repeat(np.cumsum(spans) - spans, spans)
    at = xa[e] + (row + 0.5 - a[e]) / (b[e] - a[e]) * (xb[e] - xa[e])
    cell = page[e] * height + row
    order = np.lexsort((np.where(np.isnan(at), -np.inf, at), cell))
    at, cell = at[order], cell[order]
    new = np.flatnonzero(np.diff(cell, prepend=-1))
    k = np.arange(len(cell)) - np.repeat(new, np.diff(new, append=len(cell)))
    one = np.flatnonzero((k[:-1] % 2 == 0) & (cell[1:] == cell[:-1]))
    x_in, x_out, cell, k = at[one], at[one + 1], cell[one], k[one]
    middle = anchor[cell // height]
    over, long = (x_in <= middle) & (middle <= x_out), x_out - x_in
    kept = np.flatnonzero(over | (long > 0))
    kept = kept[np.lexsort((k[kept], np.where(over, 0.0, -long)[kept], ~over[kept], cell[kept]))]
    best = kept[np.diff(cell[kept], prepend=-1) != 0]
    return cell[best] // height, cell[best] % height, np.rint(x_in[best]).astype("i8"), np.rint(x_out[best]).astype("i8")


def scanlines(corners: DataFrame, height: int, at_once: int = 1_000_000) -> DataFrame:
    """page_id and rows (y, xmin, xmax) of a polygon (page_id, ord, x, y): in each pixel row, of the pieces inside it, the one over its mean x, else the longest.

    Each edge meets only the rows it spans, half open, at their middle; level edges meet none. Corners move once; the rows of a polygon are made where its corners are,
    about ``at_once`` of its edges' rows at a time, and aren't sorted or moved with those of others.
    """
    pages = corners.groupBy("page_id").agg(F.avg("x").alias("anchor"), F.sort_array(F.collect_list(F.struct("ord", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("c"))
    pages = pages.select("page_id", "anchor", F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    kind = pa.list_(pa.struct([("y", pa.int64()), ("xmin", pa.int64()), ("xmax", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(2).value_lengths().to_numpy().astype("i8")
            part = np.cumsum(n) * height // at_once
            cuts = [0, *np.flatnonzero(np.diff(part)) + 1, len(n)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                some = b.slice(lo, hi - lo)
                flat = [some.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3)]
                page, *found = _crossings(n[lo:hi], some.column(1).to_numpy(zero_copy_only=False), *flat, height)
                of = np.flatnonzero(np.bincount(page, minlength=hi - lo))
                ends = np.append(0, np.cumsum(np.bincount(page, minlength=hi - lo)[of])).astype("i4")
                rows = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(v) for v in found], fields=list(kind.value_type)))
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(of)), rows], ["page_id", "rows"])

    return pages.mapInArrow(run, f"page_id {dict(corners.dtypes)['page_id']}, rows array<struct<y: bigint, xmin: bigint, xmax: bigint>>")


def scanline_extents(corners: DataFrame, height: int) -> DataFrame:
    """``scanlines`` with a row for each of a page's pixel rows."""
    return scanlines(corners, height).select("page_id", F.inline("rows"))
