"""Token ids in Parquet: list columns with dictionary or delta encoding, controlled row groups and page indexes.

Documents are dealt to ranges of doc_id and sorted, so the files in order hold them in ascending doc_id. Texts are
encoded as they stream past and written by Spark's Parquet writer, format version 2: ids take the dictionary, or
delta packing where it doesn't pay; row groups and pages are small enough that page indexes let a reader take the
tokens of a few documents, or the metadata alone, without the rest. Each row knows its place within its file, the
files' sums (one row a file) turn that into its place in the whole corpus.

Arrow parts the texts of a slice into the vocabulary's pre-tokens and numbers the different ones, so Python sees each once a slice and the lists of
ids are put together by number. The tokenizers library's model encodes the pre-tokens that a worker hasn't kept; what is kept is bounded in bytes. That holds
for texts of Latin letters and marks with single blanks. Others, and long ones in parts of about a million characters, are split at single spaces between
non-blank characters, where every pre-token ends, and the whole library encodes their pieces, many in one call: each begins with a space, so its ids begin with
the only token that does; pieces that are a word of Latin letters, two of them at a line end, or such with marks after, go to its model as they are.

Defined results: a null text is empty and has the end id alone; texts of any length are one row, encoded whole; ties of doc_id are ordered
by text; a null doc_id comes first; rows of one id, and those without, are one range, which one task streams in constant memory; repeated rows are written each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bpe_stream import byte_letters
from .common import Kept, shared_dir, slices, table

END, PART, TOGETHER, KEPT_BYTES = 2, 1 << 20, 2_000, 24 << 20
SLICE_CHARS, SLICE_ROWS = 4 << 20, 4_000
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 256 << 10, 2_000
SCHEMA = "doc_id long, tokens array<int>, n_tokens long, local_start long"
_OTHER_SPACE = [c for c in map(chr, range(1, 0x3001)) if c != " " and re.match(r"\s", c)]
_SAFE = re.compile(r"(?<=\S)(?= \S)")
#: In Arrow's syntax: characters other than Latin letters and marks, the mark of cuts among them, and blanks but single spaces and line ends within a text.
_ODD = r"[^\n\x20-\x7e\x{a1}-\x{17f}\x{2010}-\x{2027}]| $|  |\n\n| \n|\n "
#: In other texts, where no blank follows another, the vocabulary's pre-tokens that aren't letters; those of letters lie between them, and begin with every other space.
_NO_LETTERS = r"'(?:s|t|re|ve|m|ll|d)| ?\p{N}+| ?[^ \n\p{L}\p{N}]+|\n"
#: Letters of Latin-1, and the marks of ASCII but the apostrophe: a run of either is a pre-token.
_LETTERS, _MARKS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_WORD = re.compile(rf"( ?)([{_LETTERS}]+)([{_MARKS}]*)(?:\n([{_LETTERS}]+)([{_MARKS}]*))?")
_MARKS_KEPT = 3


class Encoder:
    """Ids of texts, as little-endian 32-bit bytes, by the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocab = self.library.get_vocab()
        self.first = np.zeros(max(vocab.values()) + 1, bool)  # tokens that begin with a space
        self.first[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.model = self.library.model.tokenize
        self.letters = [c for _, c in sorted(byte_letters().items())]
        self.marks = {m: array("I", self.library.encode(m, add_special_tokens=False).ids).tobytes() for m in ("", "\n")}
        self.spelling = {b: c for b, c in byte_letters().items() if b}
        self.odd = "|".join([_ODD, *map(re.escape, self.special)])
        self.words = Kept(self._learn_words, KEPT_BYTES)
        self.kept = Kept(self._learn, KEPT_BYTES // 4)

    def _pieces(self, part: str, goes_on: bool) -> list[str]:
        """Pieces that follow a space and hold none, without it; others as they stand with a space before to tell them apart."""
        if "  " in part or " " in (part[1:2] if goes_on else part[:1], part[-1:]) or any(c in part and (c + " " in part or " " + c in part) for c in _OTHER_SPACE):
            pieces = [p[1:] if p[:1] == " " and " " not in p[1:] and len(p) > 1 else " " + p for p in _SAFE.split(part)]
            if not goes_on and part[:1] == " ":
                pieces[0] = " " + _SAFE.split(part, maxsplit=1)[0]
            return pieces
        pieces = part.split(" ")
        if goes_on:
            return pieces[1:]
        pieces[0] = " " + pieces[0]
        return pieces

    def _library(self, plain: list[str]) -> dict[str, bytes]:
        """Ids of pieces that follow a space and hold none: each has one token that begins with a space, its first."""
        found = {}
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            ids = np.array(self.library.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(self.first[ids])
            raw, starts = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
            found.update((p, raw[i:j]) for p, i, j in zip(some, starts[:-1], starts[1:], strict=True))
        return found

    def _word(self, word: str, spaced: bool = True) -> bytes:
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode("utf-8")))
        return array("I", [t.id for t in self.model("Ġ" + word if spaced else word)]).tobytes()

    def _run(self, marks: str) -> bytes:
        ids = self.marks.get(marks)
        if ids is None:
            ids = self._word(marks, False)
            if len(marks) <= _MARKS_KEPT:
                self.marks[marks] = ids
        return ids

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        found, rest, known, run, model = {}, [], self.kept.known, self._run, self.model
        for p in pieces:
            if p.isascii() and p.isalpha():
                if p not in found:
                    found[p] = array("I", [t.id for t in model("Ġ" + p)]).tobytes()
                continue
            fit = _WORD.fullmatch(p)
            if not fit:
                rest.append(p)
                continue
            stands, word, marks, after, last = fit.groups()
            if stands:
                ids = self._word(word, False)
            else:
                ids = found.get(word) or known(word)
                if ids is None:
                    found[word] = ids = self._word(word)
            if marks:
                ids += run(marks)
            if after:
                start = " " + after  # as at the start of a text
                known_start = found.get(start) or known(start)
                if known_start is None:
                    found[start] = known_start = self._word(after, False)
                ids += self.marks["\n"] + known_start + run(last)
            found[p] = ids
        if rest:
            text = "\n".join(rest)
            odd = {p for p in rest if " " in p or any(t in text and t in p for t in self.special)}
            found |= self._library([p for p in rest if p not in odd])
            told = self.library.encode_batch_fast([p[1:] if p[:1] == " " else " " + p for p in odd], add_special_tokens=False)
            found.update((p, array("I", e.ids).tobytes()) for p, e in zip(odd, told, strict=True))
        return found

    def _long(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            cut = _SAFE.search(text, at + PART) if len(text) - at > PART else None
            to = cut.start() if cut else len(text)
            out += self.kept.joined([self._pieces(text[at:to], at > 0)])
            at = to
        return b"".join(out)

    def _learn_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens by the library's model; all are spelled in its letters at once."""
        spelled = "\0".join(words).encode("utf-8").decode("latin-1").translate(self.spelling).split("\0")
        model = self.model
        return {w: array("I", [t.id for t in model(s)]).tobytes() for w, s in zip(words, spelled, strict=True)}

    def lists(self, texts: pa.Array, tail: bytes = b"") -> pa.ListArray:
        """The ids of each text, ``tail`` after them."""
        texts = pc.fill_null(texts, "")
        even = pc.and_(pc.invert(pc.match_substring_regex(texts, self.odd)), pc.less_equal(pc.utf8_length(texts), PART))
        # a mark wherever a pre-token begins; where two meet the piece between is empty
        parts = pc.split_pattern(pc.replace_substring(pc.replace_substring_regex(pc.if_else(even, texts, ""), _NO_LETTERS, "\0\\0\0"), " ", "\0 "), "\0")
        ends = np.cumsum(pc.list_value_length(parts).to_numpy(), dtype="i8")
        numbered = parts.flatten().dictionary_encode()
        # no piece holds the mark, and one string of all is cheaper to take from Arrow than each
        different = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(numbered.dictionary)], pa.int32()), numbered.dictionary), "\0")[0].as_py()
        number, strange = numbered.indices.to_numpy(), np.flatnonzero(~even.to_numpy(zero_copy_only=False))
        ids = self.words.each(different.split("\0")) if len(numbered.dictionary) else []
        if len(strange):  # their one piece is empty so far
            number = number.copy()
            number[ends[strange] - 1] = len(ids) + np.arange(len(strange))
        ids = [*ids, *(self._long(texts[int(i)].as_py()) for i in strange), tail]
        sizes = np.fromiter(map(len, ids), "i8", len(ids)) // 4
        # the number of each piece in order, and after those of a text the tail's
        tails = ends + np.arange(len(ends))
        order, inside = np.full(len(number) + len(ends), len(ids) - 1, "i4"), np.ones(len(number) + len(ends), bool)
        inside[tails] = False
        order[inside] = number
        of = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("i4")), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[order])[tails]]).astype("i4")), of.take(pa.array(order)).flatten())

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(ids.values, "<i4").tobytes() for ids in self.lists(pa.array(texts, pa.string()))]


@cache
def shared_encoder(path: str) -> Encoder:
    """One encoder a Python worker: its pieces serve the tasks that follow."""
    return Encoder(path)


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail, start = shared_encoder(path), np.array([end], "<u4").tobytes(), 0
        for whole in batches:
            for batch in slices(whole, 1, SLICE_CHARS, SLICE_ROWS):
                lists = encoder.lists(batch.column(1), tail)
                ends = lists.offsets.to_numpy().astype("i8")
                n = np.diff(ends)
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(n), pa.array(start + ends[:-1])], ["doc_id", "tokens", "n_tokens", "local_start"])
                start += int(ends[-1])

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(3)
        ids, offsets = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4"), lists.offsets.to_numpy()
        crc = [zlib.crc32(ids[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64()), pa.array(np.diff(offsets).astype("i8"))], ["doc_id", "part", "local_start", "ids_crc32", "n_tokens"])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = END) -> None:
    """Encodes ``docs`` (doc_id, text) and writes the files in ascending doc_id."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(_encode(tokenizer, end), SCHEMA).withColumn("part", F.spark_partition_id())
    (
        encoded.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", str(ROW_GROUP)).option("parquet.page.size", str(PAGE)).option("parquet.page.row.count.limit", str(PAGE_ROWS)).parquet(folder)
    )


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, part, start and n_tokens from the narrow columns alone; no token is read."""
    rows = spark.read.parquet(folder).select("doc_id", "part", "local_start", "n_tokens")
    return rows.join(F.broadcast(_bases(rows)), "part").select("doc_id", "part", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens")


def _bases(rows: DataFrame) -> DataFrame:
    """The ids before each file: one row a file, a bounded number for the size of the corpus."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_tokens(spark: SparkSession, folder: str, doc_ids: tuple[int, int] | None = None) -> DataFrame:
    """doc_id and tokens, of a range of doc_id if given: its filter reaches the page indexes."""
    rows = spark.read.parquet(folder).select("doc_id", "tokens")
    return rows.where(F.col("doc_id").between(*doc_ids)) if doc_ids else rows


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_dir(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    read = spark.read.parquet(folder)
    crc = read.select("doc_id", "part", "local_start", "tokens").mapInArrow(_digest, "doc_id long, part int, local_start long, ids_crc32 long, n_tokens long")
    bases = _bases(read.select("part", "n_tokens"))
    return crc.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
