"""Packing by lexical retrieval: windows filled with a document and what a BM25 index finds closest to it.

Texts are encoded once; their ids, two bytes each where the vocabulary allows, are written. A pass over them counts in how many documents each token occurs: with the
number of documents and their mean length all that BM25 needs of the corpus, as many numbers as the vocabulary has tokens. A document is sent to the shard
of its heaviest token (by BM25 weight), so documents about the same rare tokens meet. Spark's rebalancing shuffle keeps partitions even: it parts those of
hot tokens and joins small ones. Each task takes its rows sorted by their two heaviest tokens and cuts them into shards of about half a
million tokens; a shard has an inverted index of its own with the corpus-wide weights, which ranks all of its unused documents exactly.

A seed opens a window; its unused neighbours follow from the best down. The one that doesn't fit whole is cut there, and its rest opens the next window and
asks for its own neighbours. Without neighbours left the next unused document goes on as seed. A document longer than the window first
fills windows alone; only its rest is packed. So every sequence is full, but for the last tokens of a task: they go into sequences whose lengths are powers of two, and
nothing is padded.

Defined results: a null or empty text has the end id alone; texts of any length are encoded whole and cut into windows; rows that share a doc_id, or are repeated, or have a null
id, are packed each; ties are ordered by score, then by the order of the shard, in the end by the row's number in the written table; tokens in more than
half of all documents have no weight; an empty table gives an empty result; only doc_id and text are read. A shard holds its documents in memory, at
most one beyond the bound.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_stream import SHORT, Codec, Transducer, shared_codec
from .common import slices, table, written

WINDOW, END, SHARD_TOKENS = 2048, 1, 1 << 19
SLICE_CHARS, SLICE_ROWS = 4 << 20, 4_000
#: Words merged in one call, and characters of a text that is streamed.
TOGETHER, LONG = 10_000, 1 << 20
#: Characters, with no blanks but space and line end, that normalisation only lowers, one by one: Latin letters and marks.
_LATIN = r"\x00-\x08\n\x0e-\x{84}\x{86}-\x{9f}\x{a1}-\x{12f}\x{131}-\x{17f}\x{2010}-\x{2027}"
#: Of the vocabulary's words those that are no run of letters; a run of letters is what stands between them and blanks.
_NO_LETTERS = r"'(?:s|t|re|ve|m|ll|d)|\p{N}|[^ \p{L}\p{N}]+"
#: The saturation of term frequency and the weight of length in BM25.
K1, B = 1.2, 0.75
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _kind(n_tokens: int) -> np.dtype:
    return np.dtype("<u2" if n_tokens <= 1 << 16 else "<u4")


class Encoder:
    """Ids of many texts at once. Arrow lowers texts of Latin letters and parts them into words, and numbers the different words of a slice; these are
    merged together, many in each step. Other texts, and long ones, go through the streaming codec one by one."""

    def __init__(self, path: str):
        self.codec: Codec = shared_codec(path)
        self.kind = _kind(len(self.codec.tokens))
        marks = list(map(regex.escape, self.codec.special))
        self.odd = "|".join([*marks, f"[^{_LATIN}]"])

    def _merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in a row, and how many each has."""
        codec = self.codec
        at = np.frombuffer(words.buffers()[1], "<i4")[words.offset : words.offset + len(words) + 1]
        data, lengths = np.frombuffer(words.buffers()[2] or b"", "u1"), np.diff(at).astype("i8")
        sizes, short = np.zeros(len(words), "i8"), np.flatnonzero((lengths > 0) & (lengths <= SHORT))
        found: list[tuple[np.ndarray, np.ndarray]] = []  # words and their ids
        for i in range(0, len(short), TOGETHER):
            some = short[i : i + TOGETHER]
            n = lengths[some]
            ends = np.cumsum(n)
            own = data[np.repeat(at[some] - ends + n, n) + np.arange(ends[-1])]
            symbols = codec.symbol[own]
            symbols[ends - 1] = codec.last[own[ends - 1]]
            ids, sizes[some] = codec.merges.merge_many(symbols, n)
            found.append((some, ids))
        for i in np.flatnonzero(lengths > SHORT).tolist():
            t = Transducer(codec.merges)
            ids = np.array(t.feed(codec.symbols(words[i].as_py()).tolist()) + t.end(), "i8")
            sizes[i] = len(ids)
            found.append((np.array([i]), ids))
        ends = np.cumsum(sizes)
        out = np.empty(ends[-1] if len(ends) else 0, "i8")
        for some, ids in found:
            n = sizes[some]
            out[np.repeat(ends[some] - np.cumsum(n), n) + np.arange(len(ids))] = ids
        return out, sizes

    def lists(self, texts: pa.Array, tail: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, ``tail`` after each, and where each ends."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring_regex(texts, self.odd), pc.greater(pc.utf8_length(texts), LONG))
        lowered = pc.utf8_lower(pc.replace_substring(pc.if_else(odd, "", texts), "\n", " "))
        # letters are parted by blanks, all else by blanks put around it
        parts = pc.split_pattern(pc.replace_substring_regex(lowered, _NO_LETTERS, r" \0 "), " ")
        ends = np.cumsum(pc.list_value_length(parts).to_numpy(), dtype="i8")
        numbered = parts.flatten().dictionary_encode()
        ids, sizes = self._merged(numbered.dictionary)
        number, strange = numbered.indices.to_numpy(), np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        more = [np.frombuffer(b"".join(self.codec.encode([texts[int(i)].as_py()])[0]), "<u4") for i in strange]
        if more:  # their one piece is empty so far
            number = number.copy()
            number[ends[strange] - 1] = len(sizes) + np.arange(len(strange))
        ids, sizes = np.concatenate([ids, *more, [tail]]), np.concatenate([sizes, [len(x) for x in more], [1]]).astype("i8")
        tails = ends + np.arange(len(ends))
        order = np.full(len(number) + len(ends), len(sizes) - 1, "i4")
        inside = np.ones(len(order), bool)
        inside[tails] = False
        order[inside] = number
        of = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("i4")), pa.array(ids.astype(self.kind)))
        return of.take(pa.array(order)).flatten().to_numpy(), np.cumsum(sizes[order])[tails]


@cache
def shared_encoder(path: str) -> Encoder:
    """One a Python worker."""
    return Encoder(path)


def encoded(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """doc_id, ids (binary, the end id last) and row, a number of its own for each row; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer)
        for whole in batches:
            for b in slices(whole, 1, SLICE_CHARS, SLICE_ROWS):
                ids, ends = encoder.lists(b.column(1), end)
                at = np.concatenate([[0], ends * encoder.kind.itemsize]).astype("i4")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(ids))])], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return written(rows.mapInArrow(run, "doc_id long, ids binary").withColumn("row", F.monotonically_increasing_id()), "encoded")


def _lists(column: pa.Array, kind: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def _portions(lists: list[np.ndarray], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of lists with together about ``most`` ids."""
    at, n = 0, 0
    for i, x in enumerate(lists):
        if n and n + len(x) > most:
            yield at, i
            at, n = i, 0
        n += len(x)
    if at < len(lists):
        yield at, len(lists)


def frequencies(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, token and count of every different token of each list, by document and token."""
    if not lists:
        return (np.empty(0, "i8"),) * 3
    short = [x[: 1 << 21] for x in lists]
    doc = np.repeat(np.arange(len(lists), dtype="u8") << np.uint64(32), list(map(len, short)))
    keys = np.sort(doc | np.concatenate(short).astype("u8"))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    docs, tokens, counts = (keys[first] >> np.uint64(32)).astype("i8"), (keys[first] & np.uint64(0xFFFFFFFF)).astype("i8"), np.diff(np.append(first, len(keys)))
    long = [i for i, x in enumerate(lists) if len(x) > 1 << 21]
    if not long:
        return docs, tokens, counts
    out = [(docs, tokens, counts)]
    for i in long:  # the rest of a very long list, portion by portion; counts of the same token meet below
        for at in range(1 << 21, len(lists[i]), 1 << 21):
            t, c = np.unique(lists[i][at : at + (1 << 21)], return_counts=True)
            out.append((np.full(len(t), i), t.astype("i8"), c))
    docs, tokens, counts = map(np.concatenate, zip(*out, strict=True))
    keys, where = np.unique(docs << 32 | tokens, return_inverse=True)
    return keys >> 32, keys & 0xFFFFFFFF, np.bincount(where, counts).astype("i8")


@dataclass(frozen=True)
class Statistics:
    """What BM25 needs of the corpus: a weight for each token of the vocabulary and the mean length."""

    idf: np.ndarray
    mean: float

    def weights(self, tokens: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self.idf[tokens] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths / self.mean))


def statistics(rows: DataFrame, n_tokens: int, kind: np.dtype) -> Statistics:
    """Over all documents. Tasks send a row a token, so does the driver get: the vocabulary bounds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, n = np.zeros(n_tokens, "i8"), 0, 0
        for b in batches:
            lists = _lists(b.column(0), kind)
            for i, j in _portions(lists):
                held += np.bincount(frequencies(lists[i:j])[1], minlength=n_tokens)
            total, n = total + sum(map(len, lists)), n + len(lists)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2]), pa.int64()), pa.array(np.append(held[some], [n, total]), pa.int64())], ["token", "n"])

    found = {r.token: r.n for r in rows.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    n, total = found.pop(-1, 0), found.pop(-2, 0)
    held = np.zeros(n_tokens)
    held[list(found)] = list(found.values())
    return Statistics(np.maximum(np.log((n - held + 0.5) / (held + 0.5)), 0.0), total / max(n, 1))


def heaviest(lists: list[np.ndarray], known: Statistics) -> tuple[np.ndarray, np.ndarray]:
    """The two heaviest tokens of each list, the smaller on a tie; -1 where there is none of weight."""
    out = np.full((2, len(lists)), -1, "i8")
    for i, j in _portions(lists):
        docs, tokens, counts = frequencies(lists[i:j])
        weight = known.weights(tokens, counts, np.fromiter(map(len, lists[i:j]), "i8", j - i)[docs])
        starts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
        for found in out:
            best = np.maximum.reduceat(weight, starts)
            hits = np.flatnonzero((weight == np.repeat(best, np.diff(np.append(starts, len(docs))))) & (weight > 0))
            of, first = np.unique(docs[hits], return_index=True)
            found[i + of] = tokens[hits[first]]
            weight[hits[first]] = 0.0
    return out[0], out[1]


class Index:
    """The inverted index of one shard: for each token the documents that hold it, with their BM25 weights."""

    def __init__(self, lists: list[np.ndarray], known: Statistics):
        self.size = len(lists)
        docs, tokens, counts = frequencies(lists)
        weight = known.weights(tokens, counts, np.fromiter(map(len, lists), "i8", len(lists))[docs])
        docs, tokens, weight = (x[weight > 0] for x in (docs, tokens, weight))
        self.terms, self.of = tokens, np.searchsorted(docs, np.arange(len(lists) + 1))
        order = np.argsort(tokens.astype("u4"), kind="stable")
        self.docs, self.weight = docs[order], weight[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(tokens, minlength=len(known.idf)))])

    def scores(self, query: int) -> np.ndarray:
        """BM25 of every document for the different tokens of one of them."""
        terms = self.terms[self.of[query] : self.of[query + 1]]
        low, n = self.at[terms], self.at[terms + 1] - self.at[terms]
        ends = np.cumsum(n)
        where = np.repeat(low - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.docs[where], self.weight[where], self.size)


@dataclass
class Packer:
    """Packs shard after shard; the open window goes over from one to the next. ``done``: (document, start, length, sequence, offset)."""

    known: Statistics
    window: int = WINDOW
    sequence: int = 0
    fill: int = 0
    open: list[tuple[object, int, int, int]] = field(default_factory=list)
    done: list[tuple[object, int, int, int, int]] = field(default_factory=list)

    def _close(self) -> None:
        self.done += [(doc, start, length, self.sequence, at) for doc, start, length, at in self.open]
        self.sequence, self.fill, self.open = self.sequence + 1, 0, []

    def _put(self, doc: object, start: int, left: int) -> int:
        """Puts ids into the open window; returns how many didn't fit."""
        n = min(left, self.window - self.fill)
        self.open.append((doc, start, n, self.fill))
        self.fill += n
        if self.fill == self.window:
            self._close()
        return left - n

    def shard(self, docs: list[object], lists: list[np.ndarray]) -> None:
        """Packs all of ``docs``, whose ids are ``lists``."""
        if not docs:
            return
        sizes = list(map(len, lists))
        unused = np.zeros(len(docs), bool)
        for i, n in enumerate(sizes):
            whole = n - n % self.window
            for at in range(0, whole, self.window):
                self.done.append((docs[i], at, self.window, self.sequence, 0))
                self.sequence += 1
            unused[i] = whole < n
        index, seed, next_ = Index(lists, self.known), None, 0
        rest: tuple[int, int] | None = None  # a document that was cut, and how much of it is left
        while True:
            if rest is None:
                while next_ < len(docs) and not unused[next_]:
                    next_ += 1
                if next_ == len(docs):
                    return
                seed, left = next_, sizes[next_] % self.window
                unused[seed] = False
            else:
                seed, left = rest
            rest = None
            before = self.sequence
            if more := self._put(docs[seed], sizes[seed] - left, left):
                rest = (seed, more)
            if self.sequence > before:
                continue
            scores = index.scores(seed)
            near = np.flatnonzero(unused & (scores > 0))
            for j in near[np.argsort(-scores[near], kind="stable")].tolist():
                unused[j], left = False, sizes[j] % self.window
                if more := self._put(docs[j], sizes[j] - left, left):
                    rest = (j, more)
                if self.sequence > before:
                    break

    def end(self) -> None:
        """Parts what is open into sequences whose lengths are powers of two, the longest first."""
        held, total = self.open, self.fill
        self.open, self.fill, room = [], 0, 0
        lengths = iter([1 << k for k in reversed(range(total.bit_length())) if total >> k & 1])
        for doc, start, length, _ in held:
            while length:
                room = room or next(lengths)
                n = min(length, room)
                self.open.append((doc, start, n, self.fill))
                start, length, room, self.fill = start + n, length - n, room - n, self.fill + n
                if not room:
                    self._close()


def packed(rows: DataFrame, known: Statistics, kind: np.dtype, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, with_ids: bool = False) -> DataFrame:
    """The pieces of ``encoded`` rows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids; written."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, second = heaviest(_lists(b.column(1), kind), known)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first), pa.array(second)], ["doc_id", "ids", "row", "first", "second"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, docs, lists, n = Packer(known, window), [], [], 0
        names = [c.split()[0] for c in _PIECES.split(", ")]

        def pieces() -> pa.RecordBatch:
            done, packer.done = packer.done, []
            cut = [ids[s : s + k].astype("<u4") for (_, ids), s, k, _, _ in done]
            cols = [(i, s, k, zlib.crc32(own), len(ids), q, o) for ((i, ids), s, k, q, o), own in zip(done, cut, strict=True)]
            arrays = [pa.array(x, pa.int64()) for x in zip(*cols, strict=True)] if cols else [pa.array([], pa.int64())] * len(names)
            if with_ids:
                arrays.append(pa.array([x.view("<i4") for x in cut], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), _lists(b.column(1), kind), strict=True):
                docs.append((doc_id, ids))
                lists.append(ids)
                n += len(ids)
                if n >= shard_tokens:
                    packer.shard(docs, lists)
                    docs, lists, n = [], [], 0
                    yield pieces()
        packer.shard(docs, lists)
        packer.end()
        yield pieces()

    sent = rows.mapInArrow(keyed, "doc_id long, ids binary, row long, first long, second long").hint("rebalance", "first")
    told = sent.sortWithinPartitions("first", "second", "row").select("doc_id", "ids").mapInArrow(pack, _PIECES + ", ids array<int>" * with_ids)
    return written(told.withColumn("sequence_id", F.shiftleft(F.spark_partition_id().cast("bigint"), 40) + F.col("sequence_id")), "pieces")


def pack(docs: DataFrame, tokenizer: str, end: int = END, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents."""
    spec = json.loads(Path(tokenizer).read_text(encoding="utf-8"))
    n_tokens = 1 + max(end, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]))
    rows, kind = encoded(docs, tokenizer, end), _kind(n_tokens)
    return packed(rows, statistics(rows, n_tokens, kind), kind, window, with_ids=with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids and doc_ids (one a piece) of packed pieces with ids; a sequence has no more than a window of them."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def op12_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
