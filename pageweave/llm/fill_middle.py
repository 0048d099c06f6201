"""Fill-in-the-middle by an indexable skip list: two cut ranks, counted in units, become two code points.

A unit is a run of ASCII letters or any other single character. The text is seen as stretches of some thousand code points; each is a
node that carries its unit-width (units that begin in it) and its code-point-width. Express lanes skip over more and more nodes
and carry the sums of both widths; a node's height comes from a hash of its number, so a list of n nodes has about log(n) / log(8) lanes. The search for a
rank starts at the head of the top lane, adds the widths of a link while its units are all before the rank, else goes down a lane; from the bottom it
enters one stretch, the only one whose units are looked at singly. So a cut costs a few steps and one stretch whatever the length of the text, and beside the text itself
only some numbers a stretch are held.

The two cuts and the form come from a SHA-256 digest of ``seed`` and doc_id: reruns and every split of the work agree. ``transform`` gives the
texts, ``restored`` undoes them.

Defined results: a null text is empty, and an empty text is plain; a text that holds a marker is plain, so restoring is never ambiguous; a
null doc_id is digested as an empty string; texts of any length are cut whole; repeated rows are transformed each, rows that share a doc_id share its
draws; an empty table gives an empty result; only doc_id and text are read, so clashing columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Code points of a stretch; of eight nodes of a lane one is on the next, too.
STRETCH, EVERY = 2048, 8


@dataclass(frozen=True)
class Rule:
    """Markers of prefix, suffix and middle, per cent of texts that are cut and of those in the order suffix, prefix, middle, and the seed of all draws."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    cut_percent: int = 90
    spm_percent: int = 20
    seed: str = "1"

    @property
    def markers(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def _starts(text: str, at: int, to: int) -> np.ndarray:
    """Whether a unit begins at each code point from ``at`` to ``to``."""
    before = max(at - 1, 0)
    points = np.frombuffer(text[before:to].encode("utf-32-le", "surrogatepass"), "<u4")
    letter = ((points | 32) - np.uint32(97)) < 26
    begins = np.ones(len(points), bool)
    begins[1:] = ~(letter[1:] & letter[:-1])
    return begins[at - before :]


def _height(node: int) -> int:
    """Lanes above the bottom that a node is on: each with one chance in EVERY."""
    x = (node * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & (1 << 64) - 1
    x ^= x >> 31
    bits = int(math.log2(EVERY))
    return min(((x & -x).bit_length() - 1) // bits if x else 64 // bits, 64 // bits)


class UnitList:
    """The skip list over one text. A link of a lane: where it leads on the lane below, and the units and code points that it skips."""

    def __init__(self, text: str):
        self.text, self.units = text, 0
        self.lanes: list[list[tuple[int, int, int]]] = []  # the bottom lane first
        heads: list[tuple[int, int, int]] = []  # of the open link of each lane: where it began below, units and code points before it
        for node, at in enumerate(range(0, len(text), STRETCH)):
            units, chars = int(_starts(text, at, at + STRETCH).sum()), min(STRETCH, len(text) - at)
            for k in range(1, (_height(node) if node else 0) + 1):
                if len(self.lanes) <= k:
                    # a new lane starts at the head of the list
                    self.lanes += [[] for _ in range(k + 1 - len(self.lanes))]
                    heads += [(0, 0, 0)] * (k + 1 - len(heads))
                start, before, passed = heads[k]
                self.lanes[k].append((start, self.units - before, at - passed))
                heads[k] = (len(self.lanes[k - 1]), self.units, at)
            if not self.lanes:
                self.lanes, heads = [[]], [(0, 0, 0)]
            self.lanes[0].append((node, units, chars))
            self.units += units
        for k in range(1, len(self.lanes)):
            start, before, passed = heads[k]
            self.lanes[k].append((start, self.units - before, len(text) - passed))

    def find(self, rank: int) -> int:
        """Code points before the unit of this rank, from 0; the whole text's if it has no more units."""
        if rank >= self.units:
            return len(self.text)
        link, units, chars = 0, 0, 0
        for lane in reversed(self.lanes):
            while units + lane[link][1] <= rank:
                units, chars, link = units + lane[link][1], chars + lane[link][2], link + 1
            if lane is not self.lanes[0]:
                link = lane[link][0]
        begins = np.flatnonzero(_starts(self.text, chars, chars + STRETCH))
        return chars + int(begins[rank - units])


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four numbers of 32 bits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def cut(text: str, doc_id: int | None, rule: Rule) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and of middle, and the text as the form has it."""
    listed = UnitList(text)
    n = listed.units
    a, b, form, order = draws(doc_id, rule.seed)
    if not text or form % 100 >= rule.cut_percent or any(m in text for m in rule.markers):
        return n, "plain", None, None, text
    first, second = sorted((a % (n + 1), b % (n + 1)))
    i, j = listed.find(first), listed.find(second)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if order % 100 < rule.spm_percent:
        return n, "spm", i, j - i, "".join((rule.suffix, suffix, rule.prefix, prefix, rule.middle, middle))
    return n, "psm", i, j - i, "".join((rule.prefix, prefix, rule.suffix, suffix, rule.middle, middle))


_FIELDS = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]


def transform(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                ids = b.column(0).to_pylist()
                found = [(i, *cut(t or "", i, rule)) for i, t in zip(ids, b.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*found, strict=True), _FIELDS, strict=True)], [name for name, _ in _FIELDS])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, rule: Rule = Rule()) -> Column:
    """The text from output and form: no part of a cut text holds a marker, so the markers part it."""
    parts = F.split(output, "|".join(map(re.escape, rule.markers)))
    prefix = F.when(form == "psm", F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(2)))
    suffix = F.when(form == "psm", F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.get(parts, F.lit(3)), suffix))


#: The same rows in DuckDB, by cutting the list of units itself.
OP13_SQL = """with d as (select doc_id, coalesce(text, '') t, sha256('1:' || coalesce(doc_id::varchar, '')) h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') u from documents),
r as (select *, len(u) n, [('0x' || h[8 * k + 1 : 8 * k + 8])::bigint for k in range(4)] r from d),
c as (select *, least(r[1] % (n + 1), r[2] % (n + 1)) a, greatest(r[1] % (n + 1), r[2] % (n + 1)) b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r[3] % 100 >= 90 then 'plain' when r[4] % 100 < 20 then 'spm' else 'psm' end form from r),
p as (select *, coalesce(array_to_string(u[1 : a], ''), '') pre, coalesce(array_to_string(u[a + 1 : b], ''), '') mid, coalesce(array_to_string(u[b + 1 : n], ''), '') suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end prefix_chars, case when form <> 'plain' then length(mid) end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) output_sha256,
  sha256(t) restored_sha256 from p"""


def op13_skip_list_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule()
    out = transform(table(spark, sf_dir, "documents"), rule)
    back = restored(F.col("output"), F.col("form"), rule)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
