"""Each operator against a brute-force version, on odd small tables and on sf0.001."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from pageweave.llm import bpe_stream, grouped_prefix, language_pieces, mixing, quality_rules, rare_features, registry, sentence_spans, shard_tree, token_files, warc_zst
from tests.oracle import same

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, n string, key string, label int"
RND = random.Random(7)
BASE = [RND.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(i % 41) for i in range(160)]


def near(edits):
    w = list(BASE)
    for i in RND.sample(range(len(w)), edits):
        w[i] = f"x{RND.random()}"
    return " ".join(w)


TEXTS = [None, "", "  \n\t ", "one", "One TWO three", "one two three", "a b c d", "é ü ß 🙂 <|endoftext|>", "#$% " * 30, "same line\nsame line\nother", "x" * 5000, " ".join(BASE) * 60,
         *[near(e) for e in (0, 0, 1, 1, 1, 2, 2, 3, 5, 8, 12)], *["copy of this text with enough words to count as one"] * 6]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 3}", None, 7, "n", None, 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_quality_measures(odd, none):
    for r in quality_rules.measure(odd).collect():
        t = TEXTS[r.doc_id] or ""
        w = words(t)
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = Counter(win)
        covered = {i + k for i, x in enumerate(win) if often[x] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
    assert quality_rules.measure(none).count() == 0


@pytest.mark.parametrize("n,k,p", [(1, 0, 0.01), (100, 0, 0.05), (600, 2, 0.01), (5000, 30, 0.01), (50000, 420, 0.01), (20, 19, 0.5)])
def test_binomial_tail(spark, n, k, p):
    got = spark.createDataFrame([(n, k)], "n long, k long").select(quality_rules.binomial_tail(F.col("n"), F.col("k"), p).alias("t")).first()["t"]
    if k < n * p:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in range(k + 1)]
        assert got == pytest.approx(math.fsum(map(math.exp, logs)), rel=1e-8)
    else:
        assert got == 1.0


def test_quality_keeps_good_and_rejects_bad(spark, odd, none):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(30)), "en") for i in range(3000)]
    bad = [(5000 + i, " ".join(f"w{i}#$x{j}" for j in range(30)), "en") for i in range(50)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good] + [(i, 0, 0) for i, _, _ in bad], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in quality_rules.keep(docs, labels).collect()} == {i for i, _, _ in good}
    kept = quality_rules.keep(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.where("text is null").count() == 0
    assert quality_rules.keep(none, labels).count() == 0


def test_sharding_law(spark, odd, none):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(1).alias("shard"))
    out = shard_tree.assign(rows, shard_tree.even_tree(8), shard_tree.even_tree(9)).collect()
    moved = [r for r in out if r.shard != r.grown_shard]
    assert moved and {r.grown_shard for r in moved} == {8} and len(moved) < 5000 / 6
    for s in range(8):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots))) and 450 < len(slots) < 800
    got = shard_tree.assign(odd, shard_tree.even_tree(8)).collect()
    assert len(got) == len(TEXTS) + 1
    assert all(r.text_crc32 == zlib.crc32((TEXTS[r.doc_id] or "").encode()) and r.size == len((TEXTS[r.doc_id] or "").encode()) + 1 for r in got)
    assert shard_tree.assign(none, shard_tree.even_tree(8)).count() == 0


def test_mixing_meets_targets(spark, odd, none):
    out = mixing.op10_mixing(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in out) == sorted(docs)
    total = sum(r.size for r in out)
    goals, taken, most = {}, Counter(), Counter()
    for r in out:
        s = docs[r.doc_id].source
        assert r.size == len(words(docs[r.doc_id].text)) and r.taken <= 2 * r.size
        goals[s], most[s] = r.target, max(most[s], r.size)
        taken[s] += r.taken
    assert sum(goals.values()) == pytest.approx(1.5 * total)
    assert all(abs(taken[s] - goals[s]) <= most[s] for s in goals)
    assert sorted(out) == sorted(mixing.op10_mixing(spark, SF).collect())
    assert mixing.mixed(odd).columns == odd.columns and mixing.copies(none).count() == 0


def test_target_levels(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, None: 500}
    rows = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, source_size long, n_docs long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    weight = {"a": 3, "b": 1, "c": 2, None: 3}
    full, want = set(), {}
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[k] for k in full)
        open_ = sum(weight[k] for k in sizes if k not in full)
        want = {k: 2 * sizes[k] if k in full else left * weight[k] / open_ for k in sizes}
        over = {k for k in sizes if k not in full and want[k] > 2 * sizes[k]}
        if not over:
            break
        full |= over
    assert got == pytest.approx(want)


def brute_classes(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y) and label[a] != label[b]:
            lo, hi = sorted((label[a], label[b]))
            label = {i: lo if v == hi else v for i, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_near_copies(spark, odd, none, k, percent):
    rule = grouped_prefix.Rule(k, percent)
    want = brute_classes(list(enumerate(TEXTS)), k, percent)
    got = grouped_prefix.classes(odd, rule).collect()
    assert len(got) == len(TEXTS) + 1 and all(want[r.doc_id] == (r.n_shingles, r.component_id) for r in got)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_classes([(r.doc_id, r.text) for r in docs.collect()], k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in grouped_prefix.classes(docs, rule).collect()} == want
    assert grouped_prefix.classes(none, rule).count() == 0
    assert grouped_prefix.one_of_each(odd, rule).columns == odd.columns


def every_run(docs, least=sentence_spans.LEAST):
    """The texts without sentences in any repeated run of enough sentences and words, whatever its length."""
    had, want = set(), {}
    for i, t in docs:
        own = sentence_spans.sentences(t)
        split = [s.split() for s in own]
        runs = [(a, b) for a in range(len(own)) for b in range(a + least.sentences, len(own) + 1) if split[a] and split[b - 1] and sum(map(len, split[a:b])) >= least.words]
        gone, new = set(), set()
        for a, b in runs:
            key = tuple(map(tuple, split[a:b]))
            if key in had or key in new:
                gone |= set(range(a, b))
            new.add(key)
        had |= new
        want[i] = "".join(s for k, s in enumerate(own) if k not in gone)
    return want


def test_repeated_sentences(spark, odd, none):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 6000").collect())
    want = every_run(docs)
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.text for r in sentence_spans.without_repeats(rows).collect()} == want
    assert any(want[i] != t for i, t in docs)
    out = sentence_spans.without_repeats(odd).collect()
    assert len(out) == len(TEXTS) + 1 and next(r for r in out if r.doc_id == 0).text is None
    assert sentence_spans.deduplicated(none).count() == 0 and sentence_spans.deduplicated(odd).columns == odd.columns
    assert all("".join(sentence_spans.sentences(t)) == t for t in TEXTS if t)


@pytest.mark.parametrize("least", [sentence_spans.LEAST, sentence_spans.Least(2, 1), sentence_spans.Least(3, 5)])
def test_every_run_of_sentences(spark, least):
    rnd = random.Random(least.words)
    stock = ["Gulls cry.", "No!", "The quiet harbour lay under a thin grey sky all day long.", "He left. ", "Boats come in with the tide and go out again before noon.\n", "One two three four five six.", "\n", " ? ", "Why not?"]
    some = [(i, "".join(rnd.choice(["", " "]) + rnd.choice(stock) for _ in range(rnd.randrange(9)))) for i in range(150)]
    some += [(900, f"A. {stock[2]} No! Gulls cry. B."), (901, f"C. {stock[2]} No! Gulls cry. D.")]  # the last sentence starts no span of enough words
    got = {r.doc_id: r.text for r in sentence_spans.without_repeats(spark.createDataFrame(some, "doc_id long, text string").repartition(3), least=least).collect()}
    assert got == every_run(some, least)
    assert got[901].split() == ["C.", "D."]


def test_folders_of_blocks(spark):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Event

    from pageweave.llm.common import temporary, written

    def names():
        import os

        root = spark.conf.get("spark.checkpoint.dir")
        return {n for n in os.listdir(root) if n.startswith("probe-")}

    made, gone = Event(), Event()

    def other():
        with temporary(spark):
            mine = written(spark.range(5), "probe")
            made.set()
            gone.wait(60)
            return mine.count()

    with ThreadPoolExecutor(1) as pool:
        waits = pool.submit(other)
        made.wait(60)
        before = names()
        with pytest.raises(ZeroDivisionError), temporary(spark):
            written(spark.range(3), "probe")
            with temporary(spark):
                written(spark.range(3), "probe")
            assert len(names()) == len(before) + 1
            1 / 0
        assert names() == before
        gone.set()
        assert waits.result() == 5
    kept = written(spark.range(4), "probe")
    assert len(names()) == 1 and kept.count() == 4


def test_near_copies_of_rows_with_shared_null_and_repeated_ids(spark):
    rnd = random.Random(11)
    text = lambda: [f"v{rnd.randrange(10**6)}" for _ in range(80)]
    a, b, c, d = text(), text(), text(), text()
    edit = lambda w: " ".join([*w[:40], "other", *w[41:]])
    a, a1, b, b1, c, c1, d = " ".join(a), edit(a), " ".join(b), edit(b), " ".join(c), edit(c), " ".join(d)
    # two texts share id 1; near copies of b have null ids alone; c and its copy have one each; d is twice the same row
    rows = [(1, a), (1, b), (2, a1), (None, b1), (None, c), (None, c1), (5, d), (5, d), (None, a), (7, None), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    rule = grouped_prefix.Rule()
    name = {i: v[1] for i, v in brute_classes([(i, t) for i, (_, t) in enumerate(rows)], rule.words, rule.percent).items()}
    of = {}
    for i, (doc_id, _) in enumerate(rows):
        of.setdefault(name[i], []).append(doc_id)
    want = [(doc_id, min((x for x in of[name[i]] if x is not None), default=None)) for i, (doc_id, _) in enumerate(rows)]
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, r.component_id) for r in grouped_prefix.classes(docs, rule).collect()), key=key) == sorted(want, key=key)
    left = sorted(((r.doc_id, r.text) for r in grouped_prefix.one_of_each(docs, rule).collect()), key=key)
    texts = [x for x in left if x not in {(None, c), (None, c1)}]
    assert len(left) == len(texts) + 1 and texts == sorted([(1, a), (1, b), (5, d), (7, None), (None, " ")], key=key)


def windows(t, k=50):
    w = t.split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_no_fifty_words_of_an_earlier_document_stay(spark):
    rnd = random.Random(3)
    some = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    rows = [" ".join(some(60)) + "."] * 2 + [" ".join(some(55))] * 2
    for dots in (0, 0.02, 0.2):
        passages = [[w + "." * (rnd.random() < dots) for w in some(50)] for _ in range(20)]
        rows += [" ".join(some(rnd.randrange(30)) + p + some(rnd.randrange(30))) + rnd.choice(["", ". " + " ".join(some(9)) + "."]) for _ in range(3) for p in passages]
    alone = ["One line of thirteen words that many texts share isn't evidence of copying. " + " ".join(some(40)) for _ in range(2)]
    docs = [(i, t) for i, t in enumerate(rows + alone)] + [(10**6 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text]
    out = {r.doc_id: r for r in sentence_spans.deduplicated(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert 1 not in out and 3 not in out  # whole copies of a text of one sentence
    had = set()
    for i, t in docs:
        left = out[i].text if i in out else ""
        assert not {w for w in windows(left) if len(set(w)) > 3} & had, i
        had |= windows(t)
    assert all(out[i].text == t for i, t in docs[len(rows) : len(rows) + 2])
    # the first place in a text stays whole, also where the next one overlaps it
    assert sentence_spans.remove_both("na " * 100, set()) == ("na " * 20, 100, 80)


def test_fingerprints(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(texts, reverse=True)
    out = {r.doc_id: r for r in rare_features.op1_rare_features(spark, SF).collect()}
    assert sorted(out) == sorted(texts)
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        t = texts[i]
        edited = t[: len(t) - len(t) // 2] + texts[j][: len(t) // 2]
        assert out[i].n_chars == len(t) and out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= out[i].near_next <= 1 and 0 <= out[i].near_edited <= 1
    alike = {}
    for i, r in out.items():
        assert alike.setdefault(texts[i], r.fingerprint) == r.fingerprint
    long = [i for i in texts if len(texts[i]) > 500]
    assert sum(out[i].near_edited > out[i].near_next for i in long) >= 0.95 * len(long)
    assert rare_features.fingerprints(odd).count() == len(TEXTS) + 1 and rare_features.fingerprints(none).count() == 0
    assert rare_features.with_next(odd).count() > len(TEXTS)


def test_levels_and_blocks():
    x = np.frombuffer(bytes(RND.randrange(97, 110) for _ in range(3000)), "u1")
    for p, got in list(enumerate(rare_features.levels(x)))[::97]:
        c = np.bincount(x[p : p + 64])
        c = c[c > 0] / 64
        assert abs(got - 1000 * -(c * np.log2(c)).sum() / 6) <= 1
    rank, big = rare_features.ranks(np.arange(1001)), bytes(RND.randrange(97, 120) for _ in range(700_000))
    whole = rare_features.digests([big], rank)[0]
    old, rare_features.BLOCK = rare_features.BLOCK, 900_000
    try:
        assert np.array_equal(whole, rare_features.digests([b"other text" * 20, big], rank)[1])
    finally:
        rare_features.BLOCK = old


def test_warc_round_trip(spark):
    html = [None, "", "short", "short", "long " * 40, "long " * 40, "long " * 40, "é" * 300, "x" * 200_000]
    pages = spark.createDataFrame([(10 - i, f"http://h/{i}" if i else None, h, 5) for i, h in enumerate(html)], "page_id long, url string, html string, payload_bytes int").repartition(2)
    got = {r.page_id: r for r in warc_zst.read_archives(warc_zst.write_archives(pages)).collect()}
    for i, h in enumerate(html):
        r, data = got[10 - i], (h or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        revisit = i in (4, 5)
        assert (r.record_type, r.refers_to) == (("revisit", 4) if revisit else ("response", None))
        assert r.payload == (None if revisit else data)
    assert warc_zst.read_archives(warc_zst.write_archives(pages.limit(0))).count() == 0


def test_warc_rejects_broken():
    good = warc_zst.record_bytes(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc_zst.parse_record(good)["payload"] == b"payload"
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"payload\r\n", b"payl0ad\r\n"), good.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(warc_zst.WarcError):
            warc_zst.parse_record(bad)


def test_token_files(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ref, start = Tokenizer.from_file(path), 0
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in token_files.op7_token_files(spark, SF).collect()}
    for i in sorted(docs):
        ids = [*ref.encode(docs[i], add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    token_files.write_tokens(odd, str(tmp_path / "a"), path)
    rows = token_files.read_tokens(spark, str(tmp_path / "a")).collect()
    assert all(r.tokens == [*ref.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 2] for r in rows) and len(rows) == len(TEXTS) + 1
    assert token_files.read_index(spark, str(tmp_path / "a")).count() == len(rows)
    token_files.write_tokens(none, str(tmp_path / "b"), path)
    assert token_files.read_tokens(spark, str(tmp_path / "b"), (1, 2)).count() == 0


def test_bpe(spark, odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    ref, codec = Tokenizer.from_file(path), bpe_stream.Codec(path)
    for r in bpe_stream.encode(odd, path).collect():
        ids = ref.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded_sha256 == hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for parts in (["the", "ing", "tion", "er"], list("abcdehinorst"), ["a"], ["in", "on"]):
        word = "".join(RND.choice(parts) for _ in range(4000))
        assert np.frombuffer(b"".join(codec.encode([word])[0]), "<u4").tolist() == ref.encode(word, add_special_tokens=False).ids
    back = bpe_stream.decode(bpe_stream.encode(odd, path).where("doc_id = 5"), path).first()["text"]
    assert back == "one two three "
    assert bpe_stream.encode(none, path).count() == 0
    state = bpe_stream.ByteText([bytes([b]) for b in range(256)])
    assert "".join(state.feed([b]) for b in "é🙂".encode()) + state.end() == "é🙂"


def test_language(spark, odd, none):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = [r for r in language_pieces.op8_language_pieces(spark, "/root/testdata/sf0.01").collect()]
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    langs, p = language_pieces.fit(odd, vocabulary)
    got = language_pieces.classify(odd.withColumn("held_out", F.lit(False)), langs, p, vocabulary).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if not any(c.isalpha() for c in TEXTS[r.doc_id] or ""))
    assert language_pieces.fit(none, vocabulary)[0] == []


def test_all_segmentations():
    pieces = language_pieces.shared_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    p = np.random.default_rng(1).random((len(pieces.names) + 1, 2)) / 100

    def total(word, i=0):
        if i == len(word) + 1:
            return np.ones(2)
        return sum((p[k] * total(word, e) for s, e, k in pieces.arcs(word) if s == i), np.zeros(2))

    for w in ("the", "nation", "éa", "straße"):
        assert np.allclose(np.exp(language_pieces.Lattice(pieces, [w]).score(p)[0]), total(w))
        assert np.allclose(np.exp(language_pieces.long_score(pieces, w, p)), total(w))


def test_token_pieces_equal_the_library():
    """Random texts of letters, marks, white space and special tokens, with stores that overflow."""
    import random

    import public_tokenizers

    from pageweave.llm import token_files

    encoder, rnd = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(5)
    letters = [*"ab Zé\n\n'tsremlvd019.,!-_#@$\t\r  ß漢字あ²½ªº×÷’\x85\x1c\x00€~`^ 　́İ", " ", "'", "😀", "<|endoftext|>", "Hello", " the"]
    whole = token_files.PART
    try:
        for most, token_files.PART in ((3000, whole), (1 << 20, 9), (3000, 30)):
            for store in (encoder.kept, encoder.words):
                store.most = most
                store.each([])  # what the round before left goes
            for text in ["", *("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(4000)), "ab.c" * 5000]:
                expected = encoder.library.encode(text, add_special_tokens=False).ids
                assert list(memoryview(encoder.encode([text])[0]).cast("I")) == expected, repr(text)
                assert max(encoder.kept.size, encoder.words.size) < most + 20_000
            texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(500)] + ["", "one two", "one two", "Wörter&&&\nµª!! <<|>> ##x", "it's 'sun' (we'll) 12's x1 _a\nb, 'ad 's", "'", " ' a", "a 's", "a\n's"]
            texts += ["".join(rnd.choice([*"ab1²,'-é\n ×ß", "'s", "'ll ", " the", ". "]) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
            got = encoder.lists(pa.array([None, *texts]), np.array([2], "<u4").tobytes()).to_pylist()
            assert got == [[*encoder.library.encode(t, add_special_tokens=False).ids, 2] for t in ["", *texts]]
    finally:
        token_files.PART = whole


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_duckdb(spark, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name], SF)


def test_decoding_reads_the_ids():
    codec = bpe_stream.Codec(public_tokenizers.path("word_bpe_49k.json"))
    ids = np.frombuffer(b"".join(codec.encode(["one two  one"])[0]), "<u4").tolist()
    state = codec.decoder()
    assert state.feed(ids) + state.end() == " ".join(codec.tokens[i] for i in ids)
    # portions of any size give the same text, also where they part a character of several bytes
    ids = np.frombuffer(b"".join(codec.encode(["naïve 🙂 über 漢字 " * 30])[0]), "<u4").tolist()
    for names in (codec.named, codec.readable):
        whole, parts = bpe_stream.ByteText(names), bpe_stream.ByteText(names)
        want = whole.feed(ids) + whole.end()
        assert "".join(parts.feed([i]) for i in ids) + parts.end() == want
    assert want == "naïve 🙂 über 漢字 " * 30
    codec.named[ids[0]] = b" changed"
    assert codec.decoder().feed(ids).startswith("changed ")


def test_words_and_texts_of_any_length_and_cut():
    """Random texts of marks, white space, joining characters and special tokens, with parts of a few characters."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    ref, codec, rnd = Tokenizer.from_file(path), bpe_stream.Codec(path), random.Random(9)
    letters = [*"ab Zé\n\n'tsremlvd019.,!-_#@$\t\r  ß漢字あ²½ªº×÷’\x85\x1c\x00€~`^ 　\u0301İΣ", "'s", "'ll", "😀", "<|endoftext|>", "hello", " the", "한국어", "ᄀ", "ᅡ", "が"]
    whole = bpe_stream.PART
    codec.kept.most = 4000
    try:
        for bpe_stream.PART in (4, 16, 60, whole):
            for _ in range(2000):
                text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 120)))
                assert np.frombuffer(b"".join(codec.encode([text])[0]), "<u4").tolist() == ref.encode(text, add_special_tokens=False).ids, repr(text)
    finally:
        bpe_stream.PART = whole
    for text in ("ab" * 100_000, "!" * 100_000 + "'ll", "nation" * 30_000 + " " + "é" * 70_000, "one two " * 1_300_000):
        assert np.frombuffer(b"".join(codec.encode([text])[0]), "<u4").tolist() == ref.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(30))
def test_lookahead_of_small_merge_lists(seed):
    """All strings of up to nine symbols through the shortest window against plain merging."""
    rnd = random.Random(seed)
    vocab = {"a": 0, "b": 1}
    merges = []
    while len(merges) < 6:
        a, b = rnd.choice(list(vocab)), rnd.choice(list(vocab))
        if (a, b) not in merges and len(a + b) <= 5:
            merges.append((a, b))
            vocab.setdefault(a + b, len(vocab))
    m = bpe_stream.Merges(vocab, merges)
    rank = {p: i for i, p in enumerate(merges)}

    def plain(tokens):
        while len(tokens) > 1:
            best = min(range(len(tokens) - 1), key=lambda i: (rank.get((tokens[i], tokens[i + 1]), 99), i))
            if (tokens[best], tokens[best + 1]) not in rank:
                break
            tokens[best : best + 2] = [tokens[best] + tokens[best + 1]]
        return [vocab[t] for t in tokens]

    m.window = m.lookahead + max(m.sizes.values(), default=1)
    words = [w for n in range(1, 10) for w in itertools.product("ab", repeat=n)] + [tuple(rnd.choice("ab") for _ in range(60)) for _ in range(30)]
    want = [plain(list(w)) for w in words]
    for w, x in zip(words, want, strict=True):
        t = bpe_stream.Transducer(m)
        out = []
        for c in w:
            out += t.feed([vocab[c]])
            assert len(t.held) <= m.window
        assert out + t.end() == x, (merges, w)
    ids, n = m.merge_many(np.array([vocab[c] for w in words for c in w]), np.array([len(w) for w in words]))
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]


def test_languages_of_numerals_marks_and_long_words(spark):
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    pieces = language_pieces.shared_pieces(vocabulary)
    assert language_pieces.words_of("Ab²c ½ Ⅷ x1y éa_b İz") == ["ab", "c", "x", "y", "e", "a", "b", "i", "z"]
    # expected uses: every segmentation weighed by its share
    p = np.random.default_rng(2).random((len(pieces.names) + 1, 2)) / 100

    def ways(word, i=0):
        if i == len(word) + 1:
            yield 1.0, Counter()
        for s, e, k in pieces.arcs(word):
            if s == i:
                for w, uses in ways(word, e):
                    yield w * p[k, 1], uses + Counter([k])

    found = ["the", "nation", "éa", "the"]
    want = Counter()
    for w in found:
        all_ways = list(ways(w))
        total = sum(x for x, _ in all_ways)
        for x, uses in all_ways:
            want.update({k: n * x / total * 3 for k, n in uses.items()})
    lang, count = np.ones(4, "i8"), np.full(4, 3.0)
    short = language_pieces.expected(pieces, found, p, lang, count)
    old, language_pieces.FAST = language_pieces.FAST, 0
    try:
        long = language_pieces.expected(pieces, found, p, lang, count)
    finally:
        language_pieces.FAST = old
    for out in (short, long):
        assert not out[:, 0].any() and {k: pytest.approx(x) for k, x in want.items()} == {k: out[k, 1] for k in np.flatnonzero(out[:, 1])}
    # words of any length are learnt: two languages that only long words tell apart
    rows = [(i, " ".join(("ab" if i % 2 else "cd") * 20 for _ in range(5)), "de" if i % 2 else "fr") for i in range(40)]
    rows += [(100, "½ ² ① ٣ Ⅷ", None), (101, "́ ̈", None), (102, "abab" * 300_000, None), (None, "cdcd " * 5, None), (103, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", F.lit(False))
    langs, model = language_pieces.fit(docs, vocabulary)
    got = {r.doc_id: r for r in language_pieces.classify(docs, langs, model, vocabulary).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if lang)
    assert [got[i].lang_pred for i in (100, 101, 103)] == ["und"] * 3 and got[102].lang_pred == "de" and got[None].lang_pred == "fr"


def test_near_copies_where_many_groups_share_shingles(spark, monkeypatch):
    """Families of near copies that all hold one passage, with few and with many groups a shingle, against brute force."""
    rnd = random.Random(21)
    word = lambda: f"u{rnd.randrange(10**7)}"
    common, rows = [word() for _ in range(5)], []
    for family in range(60):
        base = [*common, *(word() for _ in range(rnd.randrange(12, 40)))]
        other = [word() for _ in range(6)]
        for _ in range(rnd.randrange(2, 5)):
            w = list(base)
            for _ in range(rnd.randrange(3)):
                w[rnd.randrange(len(w))] = rnd.choice(other)
            rows.append(" ".join(w if rnd.random() < 0.7 else w[: -rnd.randrange(1, 4)]))
    # chains: each text is near the next alone
    for _ in range(6):
        w = [word() for _ in range(40)]
        for i in range(8):
            rows.append(" ".join(w))
            w[i * 4] = word() if i % 2 else rnd.choice(common)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    for rule, worth in ((grouped_prefix.Rule(2, 80), 0), (grouped_prefix.Rule(3, 60), 0.2), (grouped_prefix.Rule(1, 50), 8)):
        monkeypatch.setattr(grouped_prefix, "WORTH", worth)
        want = brute_classes(list(enumerate(rows)), rule.words, rule.percent)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in grouped_prefix.classes(docs, rule).collect()} == want, (rule, worth)


def test_a_shingle_that_thousands_of_unlike_texts_share(spark):
    """Pairs of texts that all hold one run of four words: only texts with a second run in common meet."""
    rnd = random.Random(4)
    rows = []
    for _ in range(1500):
        w = ["one", "run", "of", "four", *(f"t{rnd.randrange(10**9)}" for _ in range(30))]
        rows += [" ".join(w), " ".join([*w[:-1], "end"])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in grouped_prefix.classes(docs, grouped_prefix.Rule(4, 85)).collect()}
    assert got == {i: i - i % 2 for i in range(len(rows))}
