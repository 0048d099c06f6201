"""Language identification by unigram pieces, summed over all segmentations.

Every language has probabilities of the pieces of a fixed public vocabulary. A text is lower-cased and cut into words of
letters (Unicode's class L, so neither digits nor other numerals nor marks), which pieces never cross, so its probability is the product of
its words' and a word's the sum over all its segmentations, by the forward algorithm. Probabilities are learnt by
expectation-maximisation from the word counts of about ``fit_docs`` documents a language (chosen by hash of the id), two rounds, smoothed
by the mean over languages. Learning and scoring take the same words, of any length. The model has one row a piece and one column a
language: it is what tasks are sent and, as counts, what comes to the driver, so it grows with the number of languages alone.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text when nothing can be learnt; equal
scores go to the language first in code-point order; texts and words of any length are scored whole; a null id is one more id; repeated rows
are scored each; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, written

FIT_DOCS, ROUNDS, MEMO, FAST, UNKNOWN = 4_000, 2, 250_000, 30, 1e-7
_WORDS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """The lower-cased words of letters of a text."""
    found = _WORDS(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]  # numerals that are no decimal digits


class Pieces:
    """The vocabulary's pieces of letters, with the mark of a word's start, in a tree of characters."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
        self.names = sorted({n for n in names if n == "▁" or (n.removeprefix("▁").isalpha() and n == n.lower())})
        self.tree: dict = {}
        for i, n in enumerate(self.names):
            node = self.tree
            for c in n:
                node = node.setdefault(c, {})
            node[""] = i
        self.unknown = len(self.names)  # a character that no piece covers
        self._table()

    def _table(self) -> None:
        """The tree in arrays: a number for each of its characters, and steps from node to node in a table of open addressing."""
        self.char, self.piece, steps, waiting = np.zeros(0x110000, "u2"), [-1], {}, [(0, self.tree)]
        for i, c in enumerate(sorted(set().union(*self.names)), 1):
            self.char[ord(c)] = i
        for at, node in waiting:  # grows as it is read
            for c, child in node.items():
                if c:
                    steps[at << 16 | int(self.char[ord(c)])] = len(self.piece)
                    waiting.append((len(self.piece), child))
                    self.piece.append(child.get("", -1))
        self.piece = np.array(self.piece, "i8")
        bits = max(4, (4 * len(steps)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.next = np.full(1 << bits, -1, "i8"), np.full(1 << bits, -1, "i8")
        keys, to = np.fromiter(steps, "i8", len(steps)), np.fromiter(steps.values(), "i8", len(steps))
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of those that meet in a slot the last stays
            mine = self.keys[at] == keys
            self.next[at[mine]] = to[mine]
            keys, to, at = keys[~mine], to[~mine], (at[~mine] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view("u8") * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view("i8")

    def _step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The nodes that follow; -1 where there is none."""
        keys = nodes << 16 | chars
        at = self._slot(keys)
        held, out = self.keys[at], self.next[at]
        left = np.flatnonzero(held != keys)
        out[left] = -1
        left = left[held[left] >= 0]
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            held = self.keys[at[left]]
            hit = held == keys[left]
            out[left[hit]] = self.next[at[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out

    def arcs_of(self, words: list[str]) -> np.ndarray:
        """The arcs of many words, packed: end, word, start, piece. All positions go down the tree together, a character a step."""
        if not words:
            return np.empty(0, "i8")
        chars = self.char[np.frombuffer(("▁" + "▁".join(words)).encode("utf-32-le"), "<u4")].astype("i8")
        lengths = np.fromiter(map(len, words), "i8", len(words)) + 1
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(len(words)), lengths)
        place, left = np.arange(len(chars)) - (ends - lengths)[word], ends[word] - np.arange(len(chars))
        at, node, depth, covered, out = np.arange(len(chars)), np.zeros(len(chars), "i8"), 0, np.zeros(len(chars), bool), []
        while len(at):
            node = self._step(node, chars[at + depth])
            on = node >= 0
            at, node, depth = at[on], node[on], depth + 1
            piece = self.piece[node]
            has = piece >= 0
            some = at[has]
            out.append(place[some] + depth << 48 | word[some] << 24 | place[some] << 16 | piece[has])
            if depth == 1:
                covered[some] = True
            on = left[at] > depth
            at, node = at[on], node[on]
        bare = np.flatnonzero(~covered)
        out.append(place[bare] + 1 << 48 | word[bare] << 24 | place[bare] << 16 | self.unknown)
        return np.concatenate(out)

    def arcs(self, word: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, piece) over the marked word; every character has an arc."""
        word, n = "▁" + word, len(word) + 1
        for i in range(n):
            node, one = self.tree, False
            for j in range(i, n):
                node = node.get(word[j])
                if node is None:
                    break
                if "" in node:
                    one = one or j == i
                    yield i, j + 1, node[""]
            if not one:
                yield i, i + 1, self.unknown


@cache
def shared_pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """The arcs of a batch of words of at most FAST letters, in order of their ends."""

    def __init__(self, pieces: Pieces, words: list[str]):
        a = np.sort(pieces.arcs_of(words))
        self.end, self.word, self.start, self.piece = a >> 48, a >> 24 & 0xFFFFFF, a >> 16 & 0xFF, a & 0xFFFF
        self.n, self.length = len(words), np.array([len(w) + 1 for w in words])
        self.steps = np.searchsorted(self.end, np.arange(1, FAST + 3))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """words x positions x languages: the probability of all ways to each position."""
        alpha = np.zeros((self.n, FAST + 2, p.shape[1]))
        alpha[:, 0] = 1
        for j in range(1, FAST + 2):
            a, b = self.steps[j - 1], self.steps[j]
            if a == b:
                continue
            w = self.word[a:b]
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            alpha[w[first], j] = np.add.reduceat(alpha[w, self.start[a:b]] * p[self.piece[a:b]], first)
        return alpha

    def score(self, p: np.ndarray) -> np.ndarray:
        """words x languages: log of the sum over all segmentations."""
        return np.log(self.forward(p)[np.arange(self.n), self.length])

    def expected(self, p: np.ndarray, lang: np.ndarray, count: np.ndarray) -> np.ndarray:
        """pieces x languages: expected uses of each piece, each word in its own language and as often as counted."""
        alpha = self.forward(p)[np.arange(self.n), :, lang]
        beta = np.zeros_like(alpha)
        beta[np.arange(self.n), self.length] = 1
        by_start = np.lexsort((self.word, -self.start))
        at = -self.start[by_start]
        for i in range(FAST, -1, -1):
            arcs = by_start[np.searchsorted(at, -i, "left") : np.searchsorted(at, -i, "right")]
            if len(arcs):
                w = self.word[arcs]
                first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                beta[w[first], i] = np.add.reduceat(beta[w, self.end[arcs]] * p[self.piece[arcs], lang[w]], first)
        w = self.word
        use = alpha[w, self.start] * p[self.piece, lang[w]] * beta[w, self.end] / alpha[np.arange(self.n), self.length][w] * count[w]
        out = np.zeros(p.shape)
        np.add.at(out, (self.piece, lang[w]), use)
        return out


def long_score(pieces: Pieces, word: str, p: np.ndarray) -> np.ndarray:
    """The same for a word of any length: positions one by one, scaled to stay in range, memory of the longest piece."""
    ways, log, done = {0: np.ones(p.shape[1])}, np.zeros(p.shape[1]), 0
    for s, e, piece in pieces.arcs(word):
        if s > done:
            for k in [k for k in ways if k < s]:
                del ways[k]
            done, scale = s, ways[s].max()
            if 0 < scale < 1e-100:
                log += np.log(scale)
                ways = {k: v / scale for k, v in ways.items()}
        ways[e] = ways.get(e, 0) + ways[s] * p[piece]
    return log + np.log(np.maximum(ways[len(word) + 1], 1e-300))


def long_expected(pieces: Pieces, word: str, p: np.ndarray) -> dict[int, float]:
    """Expected uses of each piece in a word of any length, by logarithms; p holds the probabilities of one language."""
    arcs, end = list(pieces.arcs(word)), len(word) + 1
    ahead, behind = np.full(end + 1, -np.inf), np.full(end + 1, -np.inf)
    ahead[0] = behind[end] = 0
    log = np.log(p)
    for s, e, k in arcs:  # by start, so all ways to s are in
        ahead[e] = np.logaddexp(ahead[e], ahead[s] + log[k])
    for s, e, k in reversed(arcs):
        behind[s] = np.logaddexp(behind[s], behind[e] + log[k])
    uses: dict[int, float] = {}
    for s, e, k in arcs:
        uses[k] = uses.get(k, 0.0) + float(np.exp(ahead[s] + log[k] + behind[e] - ahead[end]))
    return uses


def expected(pieces: Pieces, words: list[str], p: np.ndarray, lang: np.ndarray, count: np.ndarray) -> np.ndarray:
    """pieces x languages: expected uses of each piece, each word in its own language and as often as counted."""
    short = np.array([len(w) <= FAST for w in words], bool)
    out = np.zeros(p.shape)
    if short.any():
        out += Lattice(pieces, [w for w, s in zip(words, short, strict=True) if s]).expected(p, lang[short], count[short])
    for i in np.flatnonzero(~short):
        for k, n in long_expected(pieces, words[i], p[:, lang[i]]).items():
            out[k, lang[i]] += n * count[i]
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of texts with their language and number, each once a slice."""
    for whole in batches:
        for b in slices(whole, 1):
            counts: dict[int, Counter] = {}
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts.setdefault(k, Counter()).update(words_of(text))
            rows = [(w, k, float(n)) for k, c in counts.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.float64()))], ["w", "l", "n"])


def _maximise(counts: np.ndarray) -> np.ndarray:
    """Probabilities from expected counts, smoothed by the mean over languages; the last row is the unknown character."""
    counts = counts[:-1]
    own = counts / np.maximum(counts.sum(0), 1e-9)
    mean = own.mean(1, keepdims=True)
    total = np.maximum(counts.sum(0), 1)
    weight = total / (total + 1000)
    p = 0.999 * (weight * own + (1 - weight) * mean) + 0.001 * (0.5 * mean + 0.5 / len(counts))
    return np.vstack([p, np.full(p.shape[1], UNKNOWN)])


def fit(train: DataFrame, vocabulary: str, fit_docs: int = FIT_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities) of rows of doc_id, text, lang."""
    train = train.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    langs = sorted(sizes)
    pieces = shared_pieces(vocabulary)
    if not langs:
        return [], np.zeros((len(pieces.names) + 1, 0))
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, fit_docs / sizes[k])]), F.col("lang"))
    index = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(langs) for x in (k, i)]), F.col("lang"))
    picked = train.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < share * (1 << 30))
    found = picked.select(index.alias("l"), F.col("text").cast("string")).mapInArrow(_counted, "w string, l int, n double")
    counted = written(found.groupBy("w", "l").agg(F.sum("n").alias("n")), "word-counts")
    p = np.vstack([np.full((len(pieces.names), len(langs)), 1 / len(pieces.names)), np.full(len(langs), UNKNOWN)])
    for _ in range(ROUNDS):
        now = p

        def expect(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total, own = np.zeros(now.shape), shared_pieces(vocabulary)
            for whole in batches:
                for at in range(0, whole.num_rows, 5000):
                    b = whole.slice(at, 5000)
                    total += expected(own, b.column(0).to_pylist(), now, b.column(1).to_numpy(), b.column(2).to_numpy())
            rows, cols = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype("i4")), pa.array(cols.astype("i4")), pa.array(total[rows, cols])], ["piece", "l", "n"])

        counts = np.zeros(p.shape)
        # at most pieces x languages rows, whatever the corpus
        for r in counted.mapInArrow(expect, "piece int, l int, n double").groupBy("piece", "l").agg(F.sum("n").alias("n")).collect():
            counts[r["piece"], r["l"]] = r["n"]
        p = _maximise(counts)
    return langs, p


class Scorer:
    def __init__(self, pieces: Pieces, p: np.ndarray):
        self.pieces, self.p = pieces, p
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.logs, self.n = np.empty((1024, self.p.shape[1])), 0

    def _add(self, words: list[str]) -> None:
        while self.n + len(words) > len(self.logs):
            self.logs = np.concatenate([self.logs, np.empty_like(self.logs)])
        short = [w for w in words if len(w) <= FAST]
        for at in range(0, len(short), 5000):
            part = short[at : at + 5000]
            self.logs[self.n : self.n + len(part)] = Lattice(self.pieces, part).score(self.p)
            self.place.update(zip(part, range(self.n, self.n + len(part)), strict=True))
            self.n += len(part)
        for w in words:
            if len(w) > FAST:
                self.logs[self.n], self.place[w] = long_score(self.pieces, w, self.p), self.n
                self.n += 1

    def texts(self, texts: list[str]) -> list[np.ndarray | None]:
        """Log probabilities by language of each text; None where there is no letter."""
        if self.n > MEMO:
            self.clear()
        split = list(map(words_of, texts))
        self._add(list({w for ws in split for w in ws if w not in self.place}))
        get = self.place.__getitem__
        return [self.logs[list(map(get, ws))].sum(0) if ws else None for ws in split]


def classify(docs: DataFrame, langs: list[str], p: np.ndarray, vocabulary: str) -> DataFrame:
    """doc_id, held_out (passed through), lang_pred and score of rows of doc_id, held_out, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared_pieces(vocabulary), p)
        for whole in batches:
            for b in slices(whole, 2):
                pred, score = [], []
                for logs in scorer.texts([t or "" for t in b.column(2).to_pylist()]):
                    if logs is None or not langs:
                        pred.append("und")
                        score.append(0.0)
                        continue
                    k = int(logs.argmax())
                    pred.append(langs[k])
                    score.append(float(1 / np.exp(logs - logs[k]).sum()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "held_out", F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    held = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 4 == 2
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held)
    langs, p = fit(docs.where(~F.col("held_out")), vocabulary)
    return classify(docs, langs, p, vocabulary)
