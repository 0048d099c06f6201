"""Byte-pair encoding by a streaming transducer with bounded lookahead, and incremental decoding.

How far can symbols to the right change a token? A merge is undone only when a part of its right operand was taken
by a merge of earlier rank, and that one likewise; ranks fall along such a chain, so walking the merge list once in rank
order gives the longest reach, the sufficient lookahead. The transducer keeps a window of symbols, merges it, emits the
tokens that end at least the lookahead before the window's end, which no later symbol can change, and keeps the
rest. Its memory depends on the merge list alone, never on the length of a word or text.

Texts pass in parts of about 64K characters, cut at blanks, or where there are none before a character that never joins the
one before it; a word that runs over the cut stays open and its symbols go on into the same transducer. Short words are merged
many at a time, one column of steps for all of them; their ids stay in a store of the worker that is bounded in bytes.

Decoding is a state machine of its own: it takes ids in any portions, looks up their bytes and turns these into text, holding back an
unfinished character. ``decoded_sha256`` is the digest of what it makes of the encoded ids, in the library's form: the
vocabulary has no decoder, so tokens stand as they are named with a space between. ``decode`` gives readable text.

Defined results: a null text is empty and has no ids; texts and words of any length are encoded whole; repeated rows are
encoded each; an empty table gives an empty result; columns of clashing names don't matter: only doc_id and text are read.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, Kept, slices, table

#: Characters of a part of a text, symbols of a word that is merged with others, characters of a word at a cut from which on it stays open.
PART, SHORT, OPEN = 1 << 16, 64, 60
#: White space of Unicode, which the vocabulary's \\s means.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Western letters and marks: normalisation only lowers them, and Python's own patterns, which are faster, know them all.
_PLAIN = [*range(0x180), *range(0x2010, 0x2028)]
_plain = re.compile("[\x00-\u017f\u2010-\u2027]*").fullmatch
#: Characters that normalisation never joins with the one before them.
_STARTS = regex.compile(r"[\x00-˿Ѐ-҂一-鿿가-힣]")
_NONE = np.int64(1) << 62


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next free letter from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Merges:
    """Merge ranks of a merge list and its sufficient lookahead."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.pairs: dict[int, int] = {}  # of two ids, packed: the rank and the new id, packed
        spine: dict[int, list[int]] = {}  # a token and the last parts it was merged from
        size: dict[int, int] = {}
        reach: dict[int, int] = {}  # symbols that a merge starting with this token may look at
        for rank, (a, b) in enumerate(merges):
            left, right, new = vocab[a], vocab[b], vocab[a + b]
            if (key := left << 32 | right) in self.pairs:
                continue
            self.pairs[key] = rank << 32 | new
            tail = spine.get(right, [right])
            far = size.get(right, 1) + max(reach.get(x, 0) for x in tail)
            reach[left] = max(reach.get(left, 0), far)
            if new not in size:
                size[new] = size.get(left, 1) + size.get(right, 1)
                spine[new] = [new, *tail]
        self.sizes = size  # symbols of the tokens that have more than one
        self.lookahead = max(reach.values(), default=0)
        self.window = 2 * (self.lookahead + max(size.values(), default=1))
        self._hash()

    def _hash(self) -> None:
        """The pairs in a table of open addressing that arrays look up."""
        bits = max(4, (4 * len(self.pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.found = np.full(1 << bits, -1, "i8"), np.full(1 << bits, _NONE, "i8")
        keys = np.fromiter(self.pairs, "i8", len(self.pairs))
        values, at = np.fromiter(self.pairs.values(), "i8", len(keys)), self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of those that meet in a slot the last stays
            mine = self.keys[at] == keys
            self.found[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view("u8") * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view("i8")

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and new id, packed, of each pair; _NONE where no merge has it."""
        keys = a << 32 | b
        at = self._slot(keys)
        held, out = self.keys[at], self.found[at]
        left = np.flatnonzero(held != keys)
        out[left] = _NONE
        left = left[held[left] >= 0]
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            held = self.keys[at[left]]
            hit = held == keys[left]
            out[left[hit]] = self.found[at[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out

    def merge(self, ids: list[int]) -> list[int]:
        """The tokens of one window: a heap of candidate pairs over a linked list."""
        get, n = self.pairs.get, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(p, i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            new = best & 0xFFFFFFFF
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if p := get(new << 32 | ids[after[j]]):
                    heapq.heappush(heap, (p, i, new, ids[after[j]]))
            if (k := before[i]) >= 0 and (p := get(ids[k] << 32 | new)):
                heapq.heappush(heap, (p, k, ids[k], new))
        return [x for x in ids if x >= 0]

    def merge_many(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for many short windows at once (their symbols in a row): tokens and how many each window has.

        In every step each window that has a merge left takes its earliest, the leftmost on a tie.
        """
        n, ids = len(ids), np.append(ids, -1)
        starts, ends = np.cumsum(lengths) - lengths, np.cumsum(lengths)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        found = self.find(ids[:-1], np.maximum(ids[1:], 0))
        found[ends - 1] = _NONE
        place = np.arange(n)
        order = np.where(found < _NONE, found >> 32 << 32 | place, _NONE)  # rank, then place
        new, gone = found & 0xFFFFFFFF, np.zeros(n, bool)
        window = np.arange(len(lengths))

        def paired(left: np.ndarray, right: np.ndarray) -> None:
            p = self.find(ids[left], ids[right])
            new[left] = p & 0xFFFFFFFF
            order[left] = np.where(p < _NONE, p >> 32 << 32 | left, _NONE)

        while len(window):
            # windows that are done stay in the row and cost one look each
            low = np.minimum.reduceat(order, starts)[window]
            window = window[low < _NONE]
            at = low[low < _NONE] & 0xFFFFFFFF
            eaten = after[at]
            ids[at] = new[at]
            gone[eaten], order[eaten], order[at] = True, _NONE, _NONE
            then = after[eaten]
            after[at], before[then] = then, at
            inside = then < ends[window]
            paired(at[inside], then[inside])
            prior = before[at]
            inside = prior >= starts[window]
            paired(prior[inside], at[inside])
        return ids[:-1][~gone], np.add.reduceat(~gone, starts) if n else lengths


class Transducer:
    """Symbols of one word in, in any portions; stable tokens out."""

    def __init__(self, merges: Merges):
        self.m, self.held = merges, []

    def feed(self, symbols: Iterable[int]) -> list[int]:
        m, out = self.m, []
        self.held.extend(symbols)
        done = 0
        while len(self.held) - done >= m.window:
            left = m.window - m.lookahead
            for t in m.merge(self.held[done : done + m.window]):
                left -= m.sizes.get(t, 1)
                if left < 0:
                    break
                done += m.sizes.get(t, 1)
                out.append(t)
        del self.held[:done]
        return out

    def end(self) -> list[int]:
        out, self.held = self.m.merge(self.held), []
        return out


class ByteText:
    """The decoder: ids to bytes to text, at any cut. Holds back an unfinished character; broken bytes become U+FFFD."""

    def __init__(self, names: list[bytes], skip: int = 0):
        """``names``: the bytes of each id; ``skip``: bytes left out at the very start."""
        self.names, self.skip = names.__getitem__, skip
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        data = b"".join(map(self.names, ids))
        if self.skip and data:
            data, self.skip = data[self.skip :], 0
        return self.state.decode(data)

    def end(self) -> str:
        return self.state.decode(b"", True)


class Codec:
    """A vocabulary file of the tokenizers library: byte letters, word ends, words by pattern."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        bare = {**spec, "added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}
        self.normalise = Tokenizer.from_str(json.dumps(bare)).normalizer.normalize_str  # no second vocabulary in memory
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", f"[^{SPACE}"))
        of = lambda kind: "".join(re.escape(chr(c)) for c in _PLAIN if regex.match(kind, chr(c)))
        self.plain = re.compile(self.pattern.pattern.replace(r"\p{L}", of(r"\p{L}")).replace(r"\p{N}", of(r"\p{N}"))).findall
        #: What the characters of a word of any length can be: letters, or neither letters nor digits nor blanks.
        self.runs = (regex.compile(r"\p{L}*"), regex.compile(rf"[^{SPACE}\p{{L}}\p{{N}}]*"))
        end = model["end_of_word_suffix"] or ""
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        vocab, letters = model["vocab"], byte_letters()
        self.symbol = np.array([vocab[letters[b]] for b in range(256)], "i8")
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], "i8")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.mark = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.merges = Merges(vocab, merges)
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens) + 1)]
        #: As the library names tokens, each after a space; and as readable text, each word before one.
        self.named = [b" " + t.encode() for t in self.tokens]
        byte_of = {c: bytes([b]) for b, c in letters.items()}
        shown = lambda t: b"".join(byte_of[c] for c in t.removesuffix(end)) + (b" " if end and t.endswith(end) else b"")
        self.readable = [t.encode() if t in self.special else shown(t) for t in self.tokens]
        self.kept = Kept(self._learn)

    def words(self, part: str) -> list[str]:
        return self.plain(part.lower()) if _plain(part) else self.pattern.findall(self.normalise(part))

    def symbols(self, word: str) -> np.ndarray:
        data = np.frombuffer(word.encode("utf-8"), "u1")
        out = self.symbol[data]
        out[-1] = self.last[data[-1]]
        return out

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words: short ones together, others by the transducer."""
        coded = [w.encode("utf-8") for w in words]
        found: dict[str, bytes] = {}
        short = [(w, c) for w, c in zip(words, coded, strict=True) if len(c) <= SHORT]
        if short:
            data = np.frombuffer(b"".join(c for _, c in short), "u1")
            lengths = np.array([len(c) for _, c in short])
            ids, last = self.symbol[data], np.cumsum(lengths) - 1
            ids[last] = self.last[data[last]]
            ids, n = self.merges.merge_many(ids, lengths)
            raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
            found = {w: raw[i:j] for (w, _), i, j in zip(short, [0, *ends[:-1]], ends, strict=True)}
        for w, c in zip(words, coded, strict=True):
            if len(c) > SHORT:
                t = Transducer(self.merges)
                found[w] = array("I", t.feed(self.symbols(w).tolist()) + t.end()).tobytes()
        return found

    def texts(self, parts: list[str]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of parts of texts without special tokens that end with their last word."""
        return self.kept.joined(list(map(self.words, parts)))

    def _cuts(self, text: str, at: int, to: int) -> Iterator[tuple[str, bool]]:
        """The characters from ``at`` to ``to`` in parts, and whether a part ends with its last word."""
        while to - at > PART:
            far = text.rfind(" ", at + 1, at + PART)
            whole = far > 0
            if not whole:
                far = next((m.start() for m in _STARTS.finditer(text, at + PART, to)), to)
            yield text[at:far], whole or far == to
            at = far
        yield text[at:to], True

    def _open(self, parts: Iterable[str]) -> Iterator[bytes]:
        """Ids of normalised parts whose words run on from one into the next."""
        rest, run, word, last = "", None, None, b""

        def feed(chars: str, ends: bool) -> bytes:
            nonlocal last, word
            data = last + chars.encode("utf-8")
            last = b"" if ends else data[-1:]
            data = np.frombuffer(data if ends else data[:-1], "u1")
            out = self.symbol[data]
            if ends:
                out[-1:] = self.last[data[-1:]]
            ids = word.feed(out.tolist()) + (word.end() if ends else [])
            word = None if ends else word
            return array("I", ids).tobytes()

        for part in [*parts, None] if isinstance(parts, list) else _ended(parts):
            text, rest, at = rest + (part or ""), "", 0
            if word is not None:
                at = run.match(text).end()
                ends = part is None or at < len(text)
                yield feed(text[:at], ends)
                if not ends:
                    continue
            whole = []
            for m in self.pattern.finditer(text, at):
                if part is None or m.end() < len(text) - 2:
                    whole.append(m.group())
                    continue
                grows = next((r for r in self.runs if r.match(m.group()).end() == len(m.group())), None)
                if m.end() == len(text) and len(m.group()) > OPEN and grows:
                    run, word = grows, Transducer(self.merges)
                else:
                    rest = text[m.start() :]  # a longer word, such as an ending after an apostrophe, may begin here
                break
            found = self._learn(list(set(whole)))
            yield b"".join(map(found.__getitem__, whole))
            if word is not None:
                yield feed(m.group(), False)

    def stream(self, text: str) -> Iterator[bytes]:
        """Ids of a text, portion by portion; what is held at a time doesn't grow with it."""
        at = 0
        for m in [*self.mark.finditer(text), None] if len(text) <= PART else _ended(self.mark.finditer(text)):
            to = len(text) if m is None else m.start()
            parts = self._cuts(text, at, to)
            for part, whole in parts:
                if whole:
                    yield self.texts([part])[0]
                else:
                    yield from self._open(map(self.normalise, _until_whole(part, parts)))
            if m is not None:
                yield array("I", [self.special[m.group()]]).tobytes()
                at = m.end()

    def encode(self, texts: list[str]) -> list[Iterable[bytes]]:
        """For each text its ids in portions: those of ordinary texts are found together."""
        plain = [i for i, t in enumerate(texts) if len(t) <= PART and not self.mark.search(t)]
        known = dict(zip(plain, self.texts([texts[i] for i in plain]), strict=True)) if plain else {}
        return [(known[i],) if i in known else self.stream(t) for i, t in enumerate(texts)]

    def decoder(self) -> ByteText:
        """To the library's form."""
        return ByteText(self.named, skip=1)


def _ended(items: Iterable) -> Iterator:
    yield from items
    yield None


def _until_whole(first: str, parts: Iterator[tuple[str, bool]]) -> Iterator[str]:
    yield first
    for part, whole in parts:
        yield part
        if whole:
            return


@cache
def shared_codec(path: str) -> Codec:
    """One codec a Python worker: what it has kept serves the tasks that follow."""
    return Codec(path)


def _digest(codec: Codec, portions: Iterable[bytes], keep: bool) -> tuple[int, str, str, list[bytes]]:
    """Number of ids, their digest, the digest of what they decode to, and the ids if kept."""
    n, of_ids, of_text, state, kept = 0, hashlib.sha256(), hashlib.sha256(), codec.decoder(), []
    for ids in portions:
        n += len(ids) // 4
        of_ids.update(ids)
        of_text.update(state.feed(np.frombuffer(ids, "<u4").tolist()).encode())
        if keep:
            kept.append(ids)
    of_text.update(state.end().encode())
    return n, of_ids.hexdigest(), of_text.hexdigest(), kept


def _encode(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(path)
        for whole in batches:
            for b in slices(whole, 1):
                found = [_digest(codec, portions, with_ids) for portions in codec.encode([t or "" for t in b.column(1).to_pylist()])]
                n, ids_sha256, decoded_sha256, kept = zip(*found, strict=True)
                cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha256), pa.array(decoded_sha256)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ids = pa.array(np.frombuffer(b"".join(x for xs in kept for x in xs), "<i4"))
                    cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]).astype("i4")), ids))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode(docs: DataFrame, tokenizer: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids of every text."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(_encode(tokenizer, with_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and readable text of rows of doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(tokenizer)

        def text(ids: list[int] | None) -> str:
            state = ByteText(codec.readable)
            return state.feed(ids or []) + state.end()

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(at, SLICE_ROWS)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(text, b.column(1).to_pylist()), pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("bigint"), "ids").mapInArrow(run, "doc_id long, text string")


def op9_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
