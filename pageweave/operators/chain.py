"""The translation chain of a page: filter, order, number, ask, and put the replies back in their places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pageweave.functions import geometry as G
from pageweave.functions import text as T

BOX = ("x1", "y1", "x2", "y2")


def requests(ocr: DataFrame, page_w: int, page_h: int, skip_preserved: bool = True, sanitise: bool = True, share: float = 0.25) -> DataFrame:
    """page_id, pos (from 1, in reading order), block_idx, position_tag and text of what a page asks for.

    Rows (page_id, block_idx, box, text, and if present should_translate and preserve) that are blank, not to be translated or kept as drawn are left out, and those
    of which cleaning leaves nothing.
    """
    flag = lambda c, default: F.coalesce(c, F.lit(default)) if c in ocr.columns else F.lit(default)
    kept = ocr.where((T.strip(F.col("text")) != "") & flag("should_translate", True))
    kept = kept.where(~flag("preserve", False)) if skip_preserved else kept
    told = kept.withColumn("text", T.sanitize_punctuation(F.col("text")) if sanitise else F.col("text")).where("text <> ''")
    cx, cy = G.centre(F.col("x1"), F.col("x2")), G.centre(F.col("y1"), F.col("y2"))
    order = W.partitionBy("page_id").orderBy(G.band(cy, page_h, share), -cx, "block_idx")
    return told.select("page_id", F.row_number().over(order).alias("pos"), "block_idx", G.position_tag(*[F.col(c) for c in BOX], page_w, page_h).alias("position_tag"), "text")


def prompts(asked: DataFrame) -> DataFrame:
    """page_id, n and the numbered lines of a page's prompt, of requests."""
    line = F.concat(F.col("pos").cast("string"), F.lit(". ["), "position_tag", F.lit("] "), "text")
    rows = F.sort_array(F.collect_list(F.struct("pos", line.alias("line"))))
    return asked.groupBy("page_id").agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("prompt"))


def replies(asked: DataFrame, told: DataFrame) -> DataFrame:
    """page_id, block_idx, text, translated of requests, with ``told`` (page_id, reply): the n-th text of a reply belongs to the n-th request.

    A reply of another length is padded with blanks or cut; a page without reply has blanks.
    """
    n = asked.groupBy("page_id").agg(F.count("*").alias("n")).join(told.select("page_id", "reply"), "page_id", "left")
    texts = n.select("page_id", F.posexplode(T.parse_translations(F.coalesce("reply", F.lit("")), F.col("n").cast("int"))).alias("at", "translated"))
    return asked.join(texts.select("page_id", (F.col("at") + 1).alias("pos"), "translated"), ["page_id", "pos"]).select("page_id", "block_idx", "text", "translated")


def scattered(ocr: DataFrame, answered: DataFrame, honorifics: bool = True) -> DataFrame:
    """Every row of ``ocr`` in its place with ``translated``: blank where it wasn't asked for or nothing came back. Suffixes of names are put back if wanted."""
    fixed = T.keep_honorifics(F.col("text"), F.col("translated")) if honorifics else F.col("translated")
    back = answered.select("page_id", "block_idx", fixed.alias("translated"))
    return ocr.join(back, ["page_id", "block_idx"], "left").withColumn("translated", F.coalesce("translated", F.lit("")))


def paired(ocr: DataFrame, translations: DataFrame) -> DataFrame:
    """Rows of ``ocr`` (page_id, block_idx) beside ``translations`` (page_id, place from 0, text) by their places on the page, as two lists are zipped.

    Rows beyond the end of a page's list stay as they are; a blank text doesn't overwrite ``translated``.
    """
    place = W.partitionBy("page_id").orderBy("block_idx")
    rows = ocr.withColumn("place", F.row_number().over(place) - 1).join(translations.select("page_id", "place", F.col("text").alias("new")), ["page_id", "place"], "left")
    old = F.col("translated") if "translated" in ocr.columns else F.lit(None).cast("string")
    return rows.withColumn("translated", F.when(F.coalesce("new", F.lit("")) != "", F.col("new")).otherwise(old)).drop("place", "new")


#: Pages that are numbered in one portion.
SPAN = 1 << 16


def page_numbers(asked: DataFrame) -> DataFrame:
    """page_id and page_idx, from 1, of the pages of requests in order of page_id: pages that ask for nothing aren't counted.

    Pages are numbered within portions; the counts of portions, one row each, are added up.
    """
    pages = asked.select("page_id").distinct().withColumn("portion", F.floor(F.col("page_id") / SPAN))
    counts = pages.groupBy("portion").agg(F.count("*").alias("n"))
    before = counts.select("portion", F.coalesce(F.sum("n").over(W.orderBy("portion").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = pages.withColumn("own", F.row_number().over(W.partitionBy("portion").orderBy("page_id")))
    return own.join(before, "portion").select("page_id", (F.col("before") + F.col("own")).alias("page_idx"))


def delivered(originals: DataFrame, results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``originals`` (name, path) with the path of their result (name, path) in ``out``, and whether it is the original itself, for want of a result."""
    keys = keys or ["name"]
    found = results.groupBy(*keys).agg(F.min("path").alias("result"))
    return originals.join(found, keys, "left").select(*keys, F.coalesce("result", "path").alias("out"), F.col("result").isNull().alias("is_original"))
