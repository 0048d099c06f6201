"""Line breaking: literal cases, and random texts against a loop over words."""

import random

import pytest
from pyspark.sql import functions as F

from pageweave.operators import wrapping

RND = random.Random(4)
WIDTHS = {" ": 2, "a": 3, "b": 5, "é": 4, "漢": 9, "🙂": 10}


@pytest.fixture(scope="module")
def glyphs(spark):
    return spark.createDataFrame([("f", 12, c, float(n)) for c, n in WIDTHS.items()] + [("f", 12, "a", 1.0), ("f", 12, "", 1.0), ("f", 12, "x", None)], "font string, size int, char string, width double")


def width(t):
    return sum(WIDTHS.get(c, 7) for c in t)


def boxed(text, most):
    words, lines, line = (text or "").split(), [], ""
    for w in words:
        both = f"{line} {w}" if line else w
        if width(both) <= most:
            line = both
        elif line:
            lines.append(line)
            line = w
        else:
            for c in w:
                if width(line + c) > most and line:
                    lines.append(line)
                    line = ""
                line += c
    return lines + [line] * bool(line)


def shaped(text, room, most):
    at = lambda i: room[i] if i < min(len(room), most) else 0
    lines, line = [], ""
    for w in (text or "").split():
        both = f"{line} {w}" if line else w
        if width(both) <= at(len(lines)) and at(len(lines)) > 0:
            line = both
            continue
        if not line or at(len(lines)) <= 0:
            return None
        lines.append(line)
        line = w
        if not 0 < width(w) <= at(len(lines)):
            return None
    return lines + [line] * bool(line)


TEXTS = [None, "", "  \n", "a", "b" * 40, "漢🙂" * 9, "a " + "b" * 30 + " a", "b" * 30 + " a a a", " a  é\t漢 a", "zzz a"]
TEXTS += [" ".join("".join(RND.choices("ab漢é🙂", k=RND.randrange(1, 7))) for _ in range(RND.randrange(40))) for _ in range(80)]


def test_boxes(spark, glyphs):
    rows = [(i, t, "f", 12, m) for i, t in enumerate(TEXTS) for m in (1, 9, 30, 77)]
    texts = spark.createDataFrame(rows, "id int, text string, font string, size int, max_width int")
    got = {(r.id, r.max_width): r.lines for r in wrapping.wrapped(texts, glyphs, missing=7.0).collect()}
    assert got == {(i, m): boxed(t, m) for i, t, _, _, m in rows}
    assert got[6, 30] == ["a", "b" * 30, "a"] and max(map(len, got[4, 30])) == 6
    assert wrapping.wrapped(texts.limit(0), glyphs).count() == 0
    assert wrapping.wrapped(texts.where("id = 3").withColumn("font", F.lit("none")), glyphs).first().lines == ["a"]


def test_shapes(spark, glyphs):
    shapes = [[20, 40, 30], [9, 0, 50], [60] * 40, [], [5, 15, 25, 35, 45]]
    rows = [(i, k, t, "f", 12, s) for i, t in enumerate(TEXTS) for k, s in enumerate(shapes)]
    texts = spark.createDataFrame(rows, "id int, k int, text string, font string, size int, capacities array<int>")
    for most in (3, 30):
        got = {(r.id, r.k): r.lines for r in wrapping.wrapped_in_shape(texts, glyphs, most, missing=7.0).collect()}
        want = {(i, k): shaped(t, s, most) for i, k, t, _, _, s in rows}
        assert got == want and None in want.values() and any(x and len(x) == 3 for x in want.values())


def test_capacities(spark):
    rows = [(1, y, 10, 10 + w) for y, w in enumerate([4, 40, 50, 60, 70, 60, 50, 40, 4])]
    extents = spark.createDataFrame(rows, "page_id long, y long, xmin long, xmax long")
    layout = spark.createDataFrame([(1, 0.0, 3.0, 2.0, 0, 8), (2, 0.0, 3.0, 2.0, 0, 8)], "page_id long, start double, step double, height double, top int, bottom int")
    got = {r.page_id: r.capacities for r in wrapping.line_capacities(extents, layout, inset=10, most_lines=4).collect()}
    # rows 0 to 2: 40 and 50 are wide enough, the upper median is 50; a page without rows has no room
    assert got == {1: [40, 50, 40, 0], 2: [0, 0, 0, 0]}
