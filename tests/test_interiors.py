"""Rectangles in small masks against brute force, votes with ties and fallbacks, spectra against a direct transform."""

import cmath
import math
import random

import numpy as np
import pytest

from pageweave.operators import interiors as I
from pageweave.plans.interiors import bubble_interiors
from tests.oracle import SF

RND = random.Random(6)


def brute_rect(mask, hint):
    h, w = mask.shape
    if not mask.any():
        return None
    off = np.argwhere(~mask)
    dist = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            dist[y, x] = math.sqrt(min(((off - (y, x)) ** 2).sum(axis=1))) if len(off) else 1e6
    c = None
    if hint is not None:
        x, y = max(0, min(w - 1, hint[0])), max(0, min(h - 1, hint[1]))
        c = (x, y) if mask[y, x] else None
    if c is None:
        bell = np.exp(-np.arange(-2, 3) ** 2 / (2 * 1.1**2))
        bell /= bell.sum()
        soft = np.zeros((h, w))
        mirrored = lambda i, n: max(0, min(n - 1, -i if i < 0 else 2 * n - 2 - i if i >= n else i))
        for y in range(h):
            for x in range(w):
                soft[y, x] = sum(bell[i + 2] * bell[j + 2] * dist[mirrored(y + i, h), mirrored(x + j, w)] for i in range(-2, 3) for j in range(-2, 3))
        y, x = np.unravel_index(np.argmax(soft.round(6)), soft.shape)
        c = (int(x), int(y))
    cx, cy = c
    reach = lambda dx, dy: next(k for k in range(h + w + 1) if not (0 <= cx + (k + 1) * dx < w and 0 <= cy + (k + 1) * dy < h and mask[cy + (k + 1) * dy, cx + (k + 1) * dx]))
    hw, hh = min(reach(-1, 0), reach(1, 0)), min(reach(0, -1), reach(0, 1))
    if hw <= 1 or hh <= 1:
        return None
    inside = lambda a, b: a > 0 and b > 0 and mask[max(0, cy - b) : cy + b + 1, max(0, cx - a) : cx + a + 1].all()
    if inside(hw, hh):
        return cx - hw, cy - hh, cx + hw, cy + hh
    lo, hi = 0.0, 1.0
    for _ in range(18):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if inside(int(hw * mid), int(hh * mid)) else (lo, mid)
    a, b = int(hw * lo), int(hh * lo)
    return (cx - a, cy - b, cx + a, cy + b) if lo > 0 else None


def random_mask():
    h, w = RND.randrange(1, 26), RND.randrange(1, 26)
    kind = RND.randrange(5)
    if kind == 0:
        return np.array([[RND.random() < 0.9 for _ in range(w)] for _ in range(h)])
    y, x = np.ogrid[:h, :w]
    if kind == 1:
        return ((x - w / 2) / (w / 2 + 0.1)) ** 2 + ((y - h / 2) / (h / 2 + 0.1)) ** 2 < 1
    mask = np.zeros((h, w), bool)
    for _ in range(kind):
        a, b = RND.randrange(w), RND.randrange(h)
        mask[b : b + RND.randrange(1, 20), a : a + RND.randrange(1, 20)] = True
    return mask


def test_rectangles(spark):
    masks = [random_mask() for _ in range(200)] + [np.ones((9, 12), bool), np.zeros((5, 5), bool)]
    hints = {i: (RND.randrange(-3, 28), RND.randrange(-3, 28)) for i in range(0, len(masks), 2)}
    pixels = spark.createDataFrame([(i, int(x), int(y)) for i, m in enumerate(masks) for y, x in np.argwhere(m)], "page_id long, x int, y int").repartition(5)
    sizes = spark.createDataFrame([(i, m.shape[1], m.shape[0]) for i, m in enumerate(masks)], "page_id long, w int, h int")
    asked = spark.createDataFrame([(i, x, y) for i, (x, y) in hints.items()], "page_id long, x int, y int")
    got = {r.page_id: (r.x1, r.y1, r.x2, r.y2) for r in I.largest_rects(pixels, sizes, asked).collect()}
    want = {i: r for i, m in enumerate(masks) if (r := brute_rect(m, hints.get(i)))}
    assert got == want and len(want) > 25
    assert I.largest_rects(pixels.limit(0), sizes).count() == 0


def test_votes_and_fallbacks(spark):
    boxes = spark.createDataFrame([(1, i, 20, 20, 40, 30) for i in range(5)] + [(1, 5, 20, 20, 20, 30)], "page_id long, block_idx int, x1 int, y1 int, x2 int, y2 int")
    regions = spark.createDataFrame([(1, i, t, 0, 0, 60, 50) for i in range(6) for t in range(3)], "page_id long, block_idx int, attempt int, rx1 int, ry1 int, rx2 int, ry2 int")
    runs = []

    def fill(block, attempt, label, x1, y1, x2, y2):
        runs.extend((1, block, attempt, y, x1, x2, label) for y in range(y1, y2))

    fill(0, 0, 7, 10, 10, 50, 40)  # spans the box
    fill(0, 0, 0, 0, 0, 60, 10)  # the ground has no vote
    fill(1, 0, 1, 19, 19, 30, 41)  # two halves with as many probes: the one that holds the centre's side first; neither spans the box
    fill(1, 0, 2, 30, 19, 41, 41)
    fill(1, 1, 3, 12, 12, 48, 38)  # the second attempt has one
    fill(2, 0, 4, 15, 15, 45, 26)  # spans the box but for the slack; first by its probes
    fill(2, 0, 5, 15, 26, 45, 40)
    fill(3, 2, 6, 22, 22, 38, 24)  # too small in each attempt: the page decides
    page = spark.createDataFrame([(1, y, 5, 55, 9) for y in range(5, 45)] + [(1, y, 5, 55, 0) for y in range(45, 60)], "page_id long, y int, x_from int, x_to int, label int")
    told = spark.createDataFrame(runs, "page_id long, block_idx int, attempt int, y int, x_from int, x_to int, label int")
    got = {r.block_idx: (r.attempt, r.label) for r in I.interior(boxes, regions, told, page, 200, 200, least=0.3).collect()}
    assert got == {0: (0, 7), 1: (1, 3), 2: (0, 4), 3: (None, 9), 4: (None, 9)}
    none = I.interior(boxes, regions, told.where("block_idx = 4"), page, 100, 100, most=0.1)
    assert none.count() == 0


def test_distances_of_wide_rows(spark):
    bits = [[x % 401 != 7 for x in range(w)] for w in (1200, 3, 1200)]
    rows = spark.createDataFrame([(1, 0, bits[0]), (2, 0, bits[1]), (3, 0, bits[2])], "page_id long, y int, bits array<boolean>").coalesce(1)
    told = I.distances(rows)
    assert "array_min" not in told._jdf.queryExecution().executedPlan().toString()
    got = {r.page_id: r.dist for r in told.collect()}
    assert got[1] == got[3] == [min(abs(x - z) for z in range(7, 1200, 401)) for x in range(1200)] and got[2] == [1e6] * 3


def test_nothing_that_grows_is_broadcast(spark):
    plan = bubble_interiors(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def peak(light, h, w):
    mean = sum(light) / len(light)
    band = []
    for fy in range(-(h // 2), h - h // 2):
        for fx in range(-(w // 2), w - w // 2):
            if min(h, w) * 0.1 < math.sqrt(fy * fy + fx * fx) < min(h, w) * 0.4:
                band.append(abs(sum((light[y * w + x] - mean) * cmath.exp(-2j * math.pi * (fy * y / h + fx * x / w)) for y in range(h) for x in range(w))))
    if not band or max(light) == min(light):
        return 0.0
    return max(band) / max(1e-3, float(np.median(band))) / 100


def test_spectra(spark):
    sizes = [(8, 8), (5, 7), (12, 6), (1, 1), (2, 9), (16, 16)]
    tiles = [(i, w, h, [float(RND.randrange(256)) for _ in range(w * h)]) for i, (h, w) in enumerate(sizes * 3)]
    tiles += [(90, 4, 4, [7.0] * 16), (91, 16, 16, [128 + 100 * math.sin(2 * math.pi * 3 * (k % 16) / 16) + (k * 7919 % 5) for k in range(256)])]
    odd = [(95, 0, 0, []), (96, 3, 3, [1.0]), (97, 2, 2, None), (98, 2, 2, [1.0, None, 2.0, 3.0]), (99, None, 2, [1.0])]
    got = {r.tile_id: r.peak for r in I.spectral_peaks(spark.createDataFrame(tiles + odd, "tile_id long, w int, h int, light array<double>").repartition(3)).collect()}
    for i, w, h, light in tiles:
        assert got[i] == pytest.approx(peak(light, h, w), rel=1e-9, abs=1e-9)
    assert got[91] > 0.1 and all(got[i] == 0 for i, *_ in odd)
    assert I.spectral_peaks(spark.createDataFrame([], "tile_id long, w int, h int, light array<double>")).count() == 0
