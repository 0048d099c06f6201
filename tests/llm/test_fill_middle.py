"""Cuts by the skip list against cuts of the plain list of units."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pageweave.llm import fill_middle, registry
from pageweave.llm.fill_middle import Rule, UnitList
from tests.oracle import same

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
RND = random.Random(5)
LONG = "".join(RND.choice(["a", "Zb", " ", "\n", "é", "🙂", "1", "abc" * 50, " "]) for _ in range(40_000))
TEXTS = [None, "", "a", " ", "ab", "é", "a1b", "word " * 3000, "x" * 100_000, "x" * 2048 + " ", "x" * 2047 + "  y", "<P>", "a<S", "a<S>b", "🙂" * 5000, "İ\u0000b", LONG]


@pytest.mark.parametrize("text", [t or "" for t in TEXTS])
def test_ranks(text):
    units, listed = UNIT.findall(text), UnitList(text)
    assert listed.units == len(units)
    ranks = range(len(units) + 2) if len(units) < 3000 else [0, 1, len(units) - 1, len(units), *(RND.randrange(len(units)) for _ in range(300))]
    at = [0]
    for u in units:
        at.append(at[-1] + len(u))
    assert all(listed.find(r) == at[min(r, len(units))] for r in ranks)


def test_lanes_sum_what_lies_below():
    listed = UnitList(LONG)
    assert len(listed.lanes) > 2
    for below, lane in zip(listed.lanes, listed.lanes[1:], strict=False):
        starts = [x[0] for x in lane] + [len(below)]
        for (i, units, chars), j in zip(lane, starts[1:], strict=True):
            assert (units, chars) == (sum(x[1] for x in below[i:j]), sum(x[2] for x in below[i:j]))
    assert max(map(len, (b for b in listed.lanes[1:]))) < len(listed.lanes[0]) / 2


def brute(doc_id, text, rule):
    units = UNIT.findall(text)
    a, b, form, order = fill_middle.draws(doc_id, rule.seed)
    if not text or form % 100 >= rule.cut_percent or any(m in text for m in rule.markers):
        return "plain", None, None, text
    i, j = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    if order % 100 < rule.spm_percent:
        return "spm", len(p), len(m), rule.suffix + s + rule.prefix + p + rule.middle + m
    return "psm", len(p), len(m), rule.prefix + p + rule.suffix + s + rule.middle + m


@pytest.mark.parametrize("rule", [Rule(), Rule("[p]", "[s]", "[m]", 100, 50, "7")])
def test_texts_and_back(spark, rule):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS * 6)] + [(None, "some words here", "x", 1), (3, " ", "x", 1), (3, " ", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int").repartition(3)
    out = fill_middle.transform(docs, rule).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), rule)).collect()
    key = lambda r: repr(tuple(r))
    got = sorted([(r.doc_id, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out], key=key)
    assert got == sorted([(i, *brute(i, t or "", rule), t or "") for i, t, _, _ in rows], key=key)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fill_middle.transform(docs.limit(0), rule).count() == 0


def test_against_sql(spark):
    same(spark, registry.queries()["op13_skip_list_middle"], registry.oracle_sql()["op13_skip_list_middle"])
