"""Packing: every id in one piece, full sequences, BM25 against its formula, ids against the library."""

import math
import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest

from pageweave.llm import retrieval_packing
from pageweave.llm.retrieval_packing import B, K1, Encoder, Index, Packer, Statistics, frequencies, heaviest

PATH = public_tokenizers.path("word_bpe_49k.json")
RND = random.Random(2)
SCHEMA = "doc_id long, text string, ids string, row int"
ODD = [None, "", " ", "\n\n", "a", "it's  It'S <|endoftext|> x", "é ü ß\t🙂 ́x İ Σς ﬁ\xa0z", "x" * 5000, "y " * 40_000, "12 3.4,5\n\nNEXT  line ", "<|startoftext|>", "z" * 70_000, "ab, " * 270_000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return cache(lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1])


def texts(n=300):
    topics = [[f"{RND.choice('bcdfgh')}{RND.choice('aeiou')}{RND.choice('lmnr')}{RND.randrange(9)}" for _ in range(60)] for _ in range(12)]
    return [" ".join(RND.choices(RND.choice(topics), k=RND.choice([3, 50, 400, 900]))) for _ in range(n)]


def held(pieces, docs, library, window=2048):
    """Pieces part every document, sequences are gapless and full or of a power of two."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc_id, text in docs.items():
        ids = np.array(library(text), "<u4")
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert set(by_doc) == set(docs)
    sizes = []
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        sizes.append(at)
    assert all(n <= window and n & (n - 1) == 0 for n in sizes)
    return sizes


def test_pieces(spark, library):
    some = dict(enumerate([*ODD, *texts()]))
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in some.items()], SCHEMA).repartition(3)
    pieces = retrieval_packing.pack(docs, PATH)
    found = pieces.collect()
    sizes = held(found, some, library)
    assert sum(n == 2048 for n in sizes) > 20
    whole = {r.sequence_id: r for r in retrieval_packing.sequences(pieces).collect()}
    for p in found:
        assert p.ids == whole[p.sequence_id].ids[p.offset : p.offset + p.length] == library(some[p.doc_id])[p.start : p.start + p.length]
    twice = spark.createDataFrame([(None, "a b", "c", 1), (None, None, "c", 1), (5, "x", "c", 1), (5, "y z", "c", 1), (5, "y z", "c", 1)], SCHEMA)
    assert Counter(p.doc_id for p in retrieval_packing.pack(twice, PATH).where("start = 0").collect()) == {None: 2, 5: 3}
    assert retrieval_packing.pack(docs.limit(0), PATH).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = retrieval_packing.op12_retrieval_packing(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    held(out.collect(), docs, library)


def test_ids(library):
    import pyarrow as pa

    every = [chr(c) for c in [*range(0x180), *range(0x2010, 0x2028)]]
    chars = "ab Z\n\t'.,1é́ <|İΣ語🙂"
    some = [*ODD, *every, *(f"a{c}'s {c}{c}1" for c in every), *("".join(RND.choices(chars, k=RND.randrange(60))) for _ in range(3000)), *("".join(RND.choices(every, k=RND.randrange(80))) for _ in range(3000)), *("".join(RND.choices(["it's", " ", "\n", "don't", "x1", "'", "ll"], k=20)) for _ in range(300))]
    ids, ends = Encoder(PATH).lists(pa.array(some, pa.string()), 1)
    starts = [0, *ends[:-1].tolist()]
    for t, i, j in zip(some, starts, ends.tolist(), strict=True):
        assert ids[i:j].tolist() == library(t)


def bm25(lists, known, q):
    out = []
    for d in lists:
        tf = Counter(d.tolist())
        out.append(sum(known.idf[t] * tf[t] * (K1 + 1) / (tf[t] + K1 * (1 - B + B * len(d) / known.mean)) for t in set(lists[q].tolist()) if t in tf))
    return out


def corpus(n=120, vocab=400):
    lists = [np.array(RND.choices(range(k := RND.randrange(vocab - 60), k + 60), k=RND.choice([5, 40, 300, 900, 5000])), "<u2") for _ in range(n)]
    df = Counter(t for d in lists for t in set(d.tolist()))
    idf = np.array([max(0.0, math.log((n - df[t] + 0.5) / (df[t] + 0.5))) for t in range(vocab)])
    return lists, Statistics(idf, sum(map(len, lists)) / n)


def test_index_and_statistics(spark):
    lists, known = corpus()
    rows = spark.createDataFrame([(i, d.tobytes(), i) for i, d in enumerate(lists)], "doc_id long, ids binary, row long").repartition(4)
    got = retrieval_packing.statistics(rows, len(known.idf), np.dtype("<u2"))
    assert got.mean == known.mean and np.allclose(got.idf, known.idf)
    index = Index(lists, known)
    for q in range(0, len(lists), 7):
        assert np.allclose(index.scores(q), bm25(lists, known, q))
    first, second = heaviest(lists, known)
    for d, a, b in zip(lists, first.tolist(), second.tolist(), strict=True):
        tf = Counter(d.tolist())
        weigh = lambda t: known.idf[t] * tf[t] * (K1 + 1) / (tf[t] + K1 * (1 - B + B * len(d) / known.mean))  # noqa: B023, E731
        best = sorted(map(weigh, tf), reverse=True)
        assert (weigh(a), weigh(b)) == pytest.approx(tuple(best[:2]))


def test_counts_of_very_long_lists():
    lists = [np.array(RND.choices(range(50), k=n), "<u2") for n in (3, (1 << 21) + 7, 40)]
    docs, tokens, counts = frequencies(lists)
    assert list(zip(docs.tolist(), tokens.tolist(), counts.tolist(), strict=True)) == [(i, t, c) for i, d in enumerate(lists) for t, c in sorted(Counter(d.tolist()).items())]


def test_greedy_order():
    """The window of each seed has its best unused neighbours, replayed by the plain formula."""
    lists, known = corpus()
    packer = Packer(known)
    packer.shard(list(range(len(lists))), lists)
    packer.end()
    unused, want, fill, rest, carried, complete = {i for i, d in enumerate(lists) if len(d) % 2048}, [], 0, None, 0, 0
    while unused or rest is not None:
        seed = rest if rest is not None else min(unused)
        left = carried if rest is not None else len(lists[seed]) % 2048
        unused.discard(seed)
        rest, full = None, False
        scores = bm25(lists, known, seed)
        queue = [(seed, left), *((j, len(lists[j]) % 2048) for j in sorted(unused, key=lambda j: (-round(scores[j], 9), j)) if scores[j] > 0)]
        for j, n in queue:
            unused.discard(j)
            take = min(n, 2048 - fill)
            want.append((j, take))
            fill += take
            if n > take:
                rest, carried = j, n - take
            if fill == 2048:
                fill, full, complete = 0, True, len(want)
                break
        assert full or rest is None
    got = [(i, k) for i, _, k, q, _ in sorted((d for d in packer.done if not (d[2] == 2048 and d[1] % 2048 == 0 and len(lists[d[0]]) >= d[1] + 2048)), key=lambda d: (d[3], d[4]))]
    assert complete > 20 and got[:complete] == want[:complete]
    assert sum(k for _, k in got) == sum(k for _, k in want)  # the last window was parted
