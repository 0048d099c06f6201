"""Substring deduplication by sliding sentence spans.

A text is tiled by sentences (up to full stops, exclamation or question marks or line ends, with the blanks after them). A run of consecutive
sentences counts if it has enough sentences and words (``Least``: two and twelve), the first and last not blank. From every sentence starts one span, the shortest run that counts, and
at every sentence ends one. That is enough for every run: where a longer one is repeated, the spans within it are repeated too, and they cover it; a sentence
too near its end to start a span lies in the one that ends there. Spans are hashed over their words; the first document that holds a span is the
one with the smallest id. Sentences covered by a span that the same text or an earlier document already had are removed.

Each text counts a span once, so the global step groups one narrow row a span with partial aggregation, whatever the number of
copies; repeated spans join back with one row a span on their side, so a skewed side can be split. Spans of few words
are no evidence of copying and never count.

The pipeline's stage (``deduplicated``) also finds passages that hold no two whole sentences: ``pieces`` parts sentences further, after the
word with the smallest hash of any eight in a row that hold no end of a sentence, so no piece has more than eight words, and seven words on either
side settle where one ends. From every piece starts one run, the shortest of pieces with at least twenty words, and one ends
with every sentence; repeated runs go as repeated spans do. Any fifty words in a row that an earlier document has hold such a run. The first place of a run in a
text stays whole, also where a later one overlaps it. Line ends part sentences, so a copy with other line ends is found only between them.

Defined results: null and blank texts have no spans and stay as they are; rows that share a doc_id are one document to each other
(neither is later); a null id comes after all others; a text without repeated span is returned unchanged; texts of any length are
handled whole, one at a time; an empty table gives an empty result; other columns, whatever their names, pass through ``without_repeats``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, shared_dir, table, temporary, written

@dataclass(frozen=True)
class Least:
    """Sentences (two or more) and words of a run that counts; shorter ones are no evidence of copying."""

    sentences: int = 2
    words: int = 12

    def __post_init__(self):
        if self.sentences < 2:
            raise ValueError("a run has two sentences or more")


LEAST = Least()
#: Words in a row of which one ends a piece, and words of a run of pieces.
WINDOW, RUN_WORDS = 8, 20
_BASE = 0x9E3779B97F4A7C15
_TOKENS = re.compile(r"\s*\S+\s*").findall
_SENTENCES = re.compile(r"[^.!?\n]*[.!?\n]+[ \t\r\f\v]*|[^.!?\n]+").findall


def sentences(text: str) -> list[str]:
    """Sentences with their ends and blanks; joined they are the text."""
    return _SENTENCES(text)


def spans(text: str, least: Least = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first sentences and ends (as numbers of sentences) of the spans, by first sentence."""
    split = [s.split() for s in sentences(text)]
    sizes = np.array([len(w) for w in split], "i8")
    n, ends = len(split), np.cumsum(sizes)
    if n < least.sentences:
        return np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "i8")
    begins, some = ends - sizes, np.flatnonzero(sizes)
    last = np.maximum(np.searchsorted(ends, begins[some] + least.words), some + least.sentences - 1)
    first = np.minimum(np.searchsorted(begins, ends[some] - least.words, "right") - 1, some - least.sentences + 1)
    # to the nearest sentence with words: places among those
    last, first = np.searchsorted(some, last), np.searchsorted(some, first, "right") - 1
    on, to = last < len(some), first >= 0
    starts, stops = np.concatenate([some[on], some[first[to]]]), np.concatenate([some[last[on]], some[to]]) + 1
    starts, stops = np.divmod(np.unique(starts * (n + 1) + stops), n + 1)
    h = np.array([xxhash.xxh3_64_intdigest(" ".join(w)) for w in split], "u8")
    return _product(h, starts, stops), starts, stops


def _product(h: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of the hashes from each start to its stop."""
    power, inverse = _powers(1 << len(h).bit_length())
    until = np.concatenate([np.zeros(1, "u8"), np.cumsum(h * power[: len(h)], dtype="u8")])
    return ((until[stops] - until[starts]) * inverse[starts]).view("i8")


def _over(least: np.ufunc, x: np.ndarray) -> np.ndarray:
    """``least`` over every window of x, by doubling."""
    n = 1
    while n < WINDOW:
        step = min(n, WINDOW - n)
        x, n = least(x[:-step], x[step:]), n + step
    return x


def pieces(ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where the pieces of a text begin and the last one ends, as numbers of words; ``ends`` are those of its sentences."""
    order = hashes | np.uint64(1)
    order[ends - 1] = 0
    if len(order) <= WINDOW:
        return np.concatenate([[0], ends])
    # a word ends a piece if it is the smallest of some window: not above the largest of the minima of its windows
    edge = np.zeros(WINDOW - 1, "u8")
    most = _over(np.maximum, np.concatenate([edge, _over(np.minimum, order), edge]))
    return np.concatenate([[0], np.flatnonzero(order <= most) + 1])


@lru_cache(None)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    up = lambda x: np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(n, x, "u8")]), dtype="u8")
    return up(_BASE), up(pow(_BASE, -1, 1 << 64))


def runs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first words and ends (as numbers of words) of the runs of pieces, by first word."""
    split = [s.split() for s in sentences(text)]
    words = list(chain.from_iterable(split))
    if len(words) < RUN_WORDS:
        return np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "i8")
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), "u8")
    ends = np.cumsum([len(w) for w in split if w])
    at = pieces(ends, h)
    on, to = at[at <= len(words) - RUN_WORDS], ends[ends >= RUN_WORDS]
    starts = np.concatenate([on, at[np.searchsorted(at, to - RUN_WORDS, "right") - 1]])
    stops = np.concatenate([at[np.searchsorted(at, on + RUN_WORDS)], to])
    starts, stops = np.divmod(np.unique(starts * (len(words) + 1) + stops), len(words) + 1)
    return _product(h, starts, stops), starts, stops


def _hashed(own: Callable[[str], list[int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b, ids, hashes = whole.slice(at, 1000), [], []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    found = own(text or "")
                    ids += [doc_id] * len(found)
                    hashes += found
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64())], ["doc_id", "span"])

    return of


def _of_spans(text: str, least: Least = LEAST) -> list[int]:
    return list(set(spans(text, least)[0].tolist()))


def _of_both(text: str, least: Least = LEAST) -> list[int]:
    return list({*runs(text)[0].tolist(), *_of_spans(text, least)})


def repeated(docs: DataFrame, own: Callable[[str, Least], list[int]] = _of_spans, least: Least = LEAST) -> DataFrame:
    """doc_id and later: the hashes of the spans (``own`` gives a text's, each once) that a document with a smaller id has too."""
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession, "later")
    with temporary(spark):
        # written once: the narrow spans are counted, and those that are repeated are looked up again; they go when that is written
        found = written(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_hashed(partial(own, least=least)), "doc_id long, span long"), "spans")
        counted = found.groupBy("span").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("span", "first")
        shared = written(counted, "shared-spans")
        later = found.join(shared, "span").where(~F.col("doc_id").eqNullSafe(F.col("first")))
        out = later.groupBy("doc_id").agg(F.collect_set("span").alias("later"))
        out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


FIELDS = [("kept", pa.string()), ("n_sentences", pa.int64()), ("n_removed", pa.int64())]


def remove(text: str, later: set[int], least: Least = LEAST) -> tuple[str, int, int]:
    """The text without covered sentences, the number of sentences, and of those removed."""
    gone, seen = np.zeros(len(own := sentences(text)) + 1, "i8"), set()
    for h, i, j in zip(*(x.tolist() for x in spans(text, least)), strict=True):
        if h in later or h in seen:
            gone[i] += 1
            gone[j] -= 1
        seen.add(h)
    gone = np.cumsum(gone)[:-1] > 0
    if not gone.any():
        return text, len(own), 0
    return "".join(s for s, g in zip(own, gone, strict=True) if not g), len(own), int(gone.sum())


def remove_both(text: str, later: set[int], least: Least = LEAST) -> tuple[str, int, int]:
    """The text without words in repeated spans and runs, the number of words, and of those removed."""
    ends = np.cumsum([0, *(len(s.split()) for s in sentences(text))])
    change, seen, first = np.zeros(ends[-1] + 1, "i8"), set(), {}
    for h, i, j in zip(*(x.tolist() for x in spans(text, least)), strict=True):
        if h in later or h in seen:
            change[ends[i]] += 1
            change[ends[j]] -= 1
        seen.add(h)
    for h, a, b in zip(*(x.tolist() for x in runs(text)), strict=True):
        a = a if h in later else max(a, first.get(h, b))
        first.setdefault(h, b)
        if a < b:
            change[a] += 1
            change[b] -= 1
    gone = (np.cumsum(change)[:-1] > 0).tolist()
    if not any(gone):
        return text, len(gone), 0
    left, i = [], 0
    for s in sentences(text):
        for t in _TOKENS(s) or [s]:
            blank = not t.strip()
            if blank or not gone[i]:
                left.append(t)
            i += not blank
    return "".join(left), len(gone), sum(gone)


def without_repeats(docs: DataFrame, own: Callable[[str, Least], list[int]] = _of_spans, remove: Callable[[str, set[int], Least], tuple[str, int, int]] = remove, least: Least = LEAST) -> DataFrame:
    """The rows with their columns, ``text`` without what repeated spans cover, and a last column, the struct of what was found."""
    doc_id, later, told = fresh(docs, "id"), fresh(docs, "later"), fresh(docs, "spans")
    found = repeated(docs, own, least).select(F.col("doc_id").alias(doc_id), F.col("later").alias(later))

    @F.pandas_udf("kept string, n_sentences long, n_removed long")
    def cut(texts, later):
        import pandas as pd

        rows = [(None, 0, 0) if t is None else remove(t, set() if x is None else set(x.tolist()), least) for t, x in zip(texts, later, strict=True)]
        return pd.DataFrame(rows, columns=["kept", "n_sentences", "n_removed"])

    joined = docs.join(found, docs["doc_id"].cast("bigint").eqNullSafe(found[doc_id]), "left")
    return joined.withColumn(told, cut(docs["text"].cast("string"), F.col(later))).select(*[F.col(f"{told}.kept").alias("text") if c == "text" else docs[c] for c in docs.columns], told)


def deduplicated(docs: DataFrame, least: Least = LEAST) -> DataFrame:
    """The documents with their columns, without repeated spans and runs; those of which nothing but blanks is left go."""
    out = without_repeats(docs, _of_both, remove_both, least)
    return out.where((F.col(out.columns[-1])["n_removed"] == 0) | F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))).select(*docs.columns)


_SP = r"[\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same rows in DuckDB.
OP2_SQL = rf"""with d as (select doc_id, text, regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]+[ \t\r\f\v]*|[^.!?\n]+') s from documents),
u as (select doc_id, unnest(s) sentence, unnest(range(len(s))) i from d),
w as (select *, list_filter(regexp_split_to_array(sentence, '{_SP}+'), lambda x: x <> '') words from u),
e as (select *, sum(len(words)) over (partition by doc_id order by i) until from w),
r as (select a.doc_id, a.i, b.i j from e a join e b on a.doc_id = b.doc_id and b.i > a.i and b.until >= a.until - len(a.words) + {LEAST.words} where len(a.words) > 0 and len(b.words) > 0),
j as (select doc_id, i, min(j) j from r group by 1, 2 union select doc_id, max(i), j from r group by doc_id, j),
p as (select j.doc_id, j.i, j.j, string_agg(array_to_string(e.words, ' '), chr(10) order by e.i) span from j join e on e.doc_id = j.doc_id and e.i between j.i and j.j group by 1, 2, 3),
f as (select *, min(doc_id) over (partition by span) first, row_number() over (partition by doc_id, span order by i) nth from p),
gone as (select distinct e.doc_id, e.i from e join f on f.doc_id = e.doc_id and e.i between f.i and f.j where f.doc_id <> f.first or f.nth > 1),
kept as (select e.doc_id, string_agg(sentence, '' order by e.i) filter (where gone.i is null) text, count(*) n_sentences, count(gone.i) n_removed from e left join gone on gone.doc_id = e.doc_id and gone.i = e.i group by 1)
select d.doc_id, case when d.text is null then null else coalesce(kept.text, '') end as text, coalesce(n_sentences, 0) n_sentences, coalesce(n_removed, 0) n_removed from d left join kept using (doc_id)"""


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "text", "spans.n_sentences", "spans.n_removed")
