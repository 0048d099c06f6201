"""Line breaking by measured widths: of a box, and of a shape whose room changes from line to line.

Glyphs are a table (font, size, char, width): nothing is drawn here. A text is as wide as its glyphs together. Both breakers are folds over
the words of a row, in generated or interpreted expressions of the engine, so a text of any length stays in its task and nothing shuffles but the
table of fonts where it is too large to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageweave.functions.text import SPACE, let

#: Fonts (of some hundred glyphs each, so at most some hundred MB) up to which their table is broadcast; characters below LOW are looked up by place.
BROADCAST_FONTS, LOW = 10_000, 0x250


def fonts(glyphs: DataFrame) -> DataFrame:
    """One row a font and size: widths of low characters by code, of others in a map. Of repeated glyphs the widest counts."""
    one = glyphs.where("width is not null and char <> ''").groupBy("font", "size", F.ascii("char").alias("code")).agg(F.max(F.col("width").cast("double")).alias("width"))
    by = one.groupBy("font", "size").agg(F.map_from_entries(F.collect_list(F.struct("code", "width"))).alias("m"))
    low = F.transform(F.sequence(F.lit(0), F.lit(LOW - 1)), lambda i: F.try_element_at("m", i))
    return by.select("font", "size", low.alias("low_glyphs"), F.map_filter("m", lambda k, _: k >= LOW).alias("high_glyphs"))


def _with_fonts(texts: DataFrame, glyphs: DataFrame) -> DataFrame:
    """``texts`` (with font and size) beside the widths of their font; a font without glyphs has none."""
    known = fonts(glyphs)
    few = glyphs.select("font", "size").distinct().limit(BROADCAST_FONTS + 1).count() <= BROADCAST_FONTS
    return texts.join(F.broadcast(known) if few else known, ["font", "size"], "left")


def _width(char: Column, missing: float) -> Column:
    code = F.ascii(char)
    return F.coalesce(F.get("low_glyphs", code), F.try_element_at("high_glyphs", code), F.lit(missing))


def _chars(text: Column, missing: float) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)(.)"), 1), lambda c: F.struct(c.alias("c"), _width(c, missing).alias("n")))


def text_width(text: Column, missing: float = 0.0) -> Column:
    """Width of a text beside its font's columns; a character without glyph has width ``missing``."""
    return F.aggregate(F.regexp_extract_all(text, F.lit(r"(?s)(.)"), 1), F.lit(0.0), lambda n, c: n + _width(c, missing))


def _words(text: Column, missing: float) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.struct(w.alias("w"), text_width(w, missing).alias("n")))


def _no_lines() -> Column:
    return F.array().cast("array<string>")


def _state(lines: Column, line: Column, n: Column) -> Column:
    return F.struct(lines.alias("lines"), line.alias("line"), n.alias("n"))


def _more(lines: Column, line: Column) -> Column:
    return F.when(line == "", lines).otherwise(F.concat(lines, F.array(line)))


def wrapped(texts: DataFrame, glyphs: DataFrame, missing: float = 0.0) -> DataFrame:
    """``texts`` (text, font, size, max_width) with ``lines``: as many words in a line as fit, the first anyway.

    Only a word that begins the text and is too wide is parted, by characters; one that follows others stands alone in a line, however wide.
    Null and blank texts have no lines.
    """
    most, blank = F.col("max_width").cast("double"), _width(F.lit(" "), missing)

    def parted(word: Column) -> Column:
        def put(a: Column, c: Column) -> Column:
            fits = a["n"] + c["n"] <= most
            return F.when(fits, _state(a["lines"], F.concat(a["line"], c["c"]), a["n"] + c["n"])).otherwise(_state(_more(a["lines"], a["line"]), c["c"], c["n"]))

        return F.aggregate(_chars(word, missing), _state(_no_lines(), F.lit(""), F.lit(0.0)), put)

    def put(a: Column, w: Column) -> Column:
        n = a["n"] + blank + w["n"]
        return F.when(n <= most, _state(a["lines"], F.concat(a["line"], F.lit(" "), w["w"]), n)).otherwise(_state(_more(a["lines"], a["line"]), w["w"], w["n"]))

    def broken(words: Column) -> Column:
        head = F.get(words, F.lit(0))
        start = F.when(head["n"] <= most, _state(_no_lines(), head["w"], head["n"])).otherwise(parted(head["w"]))
        fold = F.aggregate(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), start, put)
        return F.when(F.size(words) == 0, _no_lines()).otherwise(let(fold, lambda a: _more(a["lines"], a["line"])))

    told = _with_fonts(texts, glyphs)
    return told.withColumn("lines", let(_words(F.col("text"), missing), broken)).select(*texts.columns, "lines")


def wrapped_in_shape(texts: DataFrame, glyphs: DataFrame, most_lines: int = 30, missing: float = 0.0) -> DataFrame:
    """``texts`` (text, font, size, capacities) with ``lines``, each no wider than the capacity of its place; words stay whole.

    Null where the text doesn't fit: a word is wider than the line it would begin, a line has no room, or there are more than ``most_lines``.
    Null and blank texts have no lines.
    """
    blank = _width(F.lit(" "), missing)
    room = lambda i: F.when(i < most_lines, F.coalesce(F.get("capacities", i), F.lit(0)).cast("double")).otherwise(0.0)
    state = lambda lines, line, n, i, ok: F.struct(lines.alias("lines"), line.alias("line"), n.alias("n"), i.alias("i"), ok.alias("ok"))

    def put(a: Column, w: Column) -> Column:
        here, then = room(a["i"]), room(a["i"] + 1)
        n = F.when(a["line"] == "", w["n"]).otherwise(a["n"] + blank + w["n"])
        fits = (here > 0) & (n <= here)
        # else the line ends, if it has words, and the word begins the next one
        next_ = (here > 0) & (a["line"] != "") & (then > 0) & (w["n"] <= then)
        line = F.when(a["line"] == "", w["w"]).otherwise(F.concat(a["line"], F.lit(" "), w["w"]))
        return (
            F.when(~a["ok"], a).when(fits, state(a["lines"], line, n, a["i"], a["ok"]))
            .otherwise(state(_more(a["lines"], a["line"]), w["w"], w["n"], a["i"] + 1, next_))
        )

    start = state(_no_lines(), F.lit(""), F.lit(0.0), F.lit(0), F.lit(True))
    fold = F.aggregate(_words(F.col("text"), missing), start, put)
    told = _with_fonts(texts, glyphs)
    return told.withColumn("lines", let(fold, lambda a: F.when(a["ok"], _more(a["lines"], a["line"])))).select(*texts.columns, "lines")


def line_capacities(extents: DataFrame, layout: DataFrame, inset: int = 12, share: float = 0.5, most_lines: int = 30) -> DataFrame:
    """page_id and capacities: the room of each line, from row extents (page_id, y, xmin, xmax).

    ``layout`` (page_id, start, step, height, top, bottom) places the lines. A line's rows are those it touches between top and bottom that are at least
    ``share`` as wide as the page's widest, or else all of them; it has their upper median width without ``inset``, and none beyond the bottom.
    """
    pages = extents.groupBy("page_id").agg(F.collect_list(F.struct("y", "xmin", "xmax")).alias("rows"))
    return page_capacities(layout.join(pages, "page_id", "left"), inset, share, most_lines)


def page_capacities(pages: DataFrame, inset: int = 12, share: float = 0.5, most_lines: int = 30) -> DataFrame:
    """``line_capacities`` of pages that hold their rows (an array of y, xmin, xmax; null: none) beside the layout's columns. Nothing shuffles."""
    seen = F.filter("rows", lambda r: r["xmin"].isNotNull() & r["xmax"].isNotNull())
    rows = F.transform(seen, lambda r: F.struct(r["y"].alias("y"), (r["xmax"] - r["xmin"]).alias("w")))
    told = pages.withColumn("rows", rows).withColumn("least", share * F.array_max(F.col("rows.w")))
    pick = lambda own: F.get(own, F.floor(F.size(own) / 2).cast("int"))
    start, step, height, top, bottom = (F.col(c) for c in ("start", "step", "height", "top", "bottom"))

    def room(i: Column) -> Column:
        at = start + i * step
        y0, y1 = F.greatest(at.cast("int"), top), F.least((at + height).cast("int"), bottom)
        met = F.transform(F.filter("rows", lambda r: r["y"].between(y0, y1)), lambda r: r["w"])
        middle = let(met, lambda w: let(F.filter(w, lambda v: v >= F.col("least")), lambda wide: pick(F.sort_array(F.when(F.size(wide) > 0, wide).otherwise(w)))))
        return F.when(at + height <= bottom + 0.5, F.greatest(middle - inset, F.lit(0))).otherwise(0)

    return told.select("page_id", F.transform(F.sequence(F.lit(0), F.lit(most_lines - 1)), lambda i: F.coalesce(room(i), F.lit(0).cast("bigint"))).alias("capacities"))
