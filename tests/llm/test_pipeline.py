"""The five stages against a plain composition, and brute force for fingerprints, descents and the guarantee of cutoffs."""

import hashlib
import importlib
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pageweave.llm import mixing, quality_rules, rare_features, sentence_spans, shard_tree
from tests.llm.test_operators import SCHEMA, TEXTS, brute_classes, words
from tests.oracle import same

SF = "/root/testdata/sf0.01"


def tail(n, k, p):
    if k >= n * p:
        return 1.0
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))


def first_step(t):
    """(fails the base rule, first step of the ladder that rejects)."""
    w = words(t)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(win)
    covered = len({i + k for i, x in enumerate(win) if often[x] > 1 for k in range(5)})
    lines = [x for x in t.split("\n") if words(x)]
    share = lambda a, b: a / b if b else 0.0
    ratios = share(sum(c in "#*$%&|<>" for c in t), sum(map(len, w))), share(covered, len(w)), share(len(lines) - len(set(lines)), len(lines))
    step = next((i for i, cuts in enumerate(quality_rules.LADDER) if any(r > c for r, c in zip(ratios, cuts, strict=True))), len(quality_rules.LADDER))
    return len(w) < 10 or 100 * covered > 20 * len(w), step


def kept_by_rules(docs, good, rules=quality_rules.Rules()):
    told = {i: first_step(t or "") for i, t, _, _ in docs}
    trials = {}
    for i, t, lang, _ in docs:
        if i in good and not told[i][0]:
            trials.setdefault(lang, {})[t] = told[i][1]
    step = {}
    for lang, of in trials.items():
        for s in range(len(rules.ladder)):
            if tail(len(of), sum(x <= s for x in of.values()), rules.risk) > rules.error / len(trials):
                break
            step[lang] = s
    return [d for d in docs if not told[d[0]][0] and told[d[0]][1] > step.get(d[2], -1)], step


def test_stages_equal_a_plain_composition(spark):
    from tokenizers import Tokenizer

    pipeline = importlib.import_module("corpus_pipeline")
    docs = sorted((r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    votes = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        votes.setdefault(r.doc_id, []).append(r.quality)
    kept, step = kept_by_rules(docs, {i for i, v in votes.items() if None not in v and min(v) == 1})
    assert step and 0 < len(kept) < len(docs)  # a stratum has a cutoff, and the rules reject
    names = brute_classes([(i, t) for i, t, *_ in kept], 5, 80)
    one = [d for d in kept if names[d[0]][1] == d[0]]
    assert len(one) < len(kept)
    had, left = set(), []
    for i, t, lang, source in one:
        own = set(sentence_spans._of_both(t))
        text = sentence_spans.remove_both(t, own & had)[0]
        had |= own
        if text == t or words(text):
            left.append((i, text, lang, source, None))
    assert [x[1] for x in left] != [d[1] for d in one]
    rest = spark.createDataFrame(left, "doc_id long, text string, lang string, source string, n_chars long")
    library, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    text_of = {i: t for i, t, *_ in left}
    for r in mixing.copies(rest).where("copies > 0").collect():
        ids = library.encode(text_of[r.doc_id], add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()] += r.copies
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, SF).collect())
    assert got == want


def test_stages_on_odd_tables(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    extra = SCHEMA.replace("label int", "label int, later string, m int, cut int, id int, spans int, times int, row int, nth int, stratum int")
    rows = [(None if i % 7 == 0 else i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 3}", None, 7, "n", None, 1, "x", 1, 2, 3, 4, 5, 6, 7, 8) for i, t in enumerate([*TEXTS, "word " * 300_000])]
    docs = spark.createDataFrame([*rows, rows[3], rows[-1]], extra).repartition(3)
    spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for some in (docs, docs.limit(0)):
        now = some
        for name, stage in pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns, name
            assert now.count() <= 2 * docs.count()
            if name == "quality_rules":
                assert now.where("text is null").count() == 0
                now = some  # all rows go on
        assert pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() == now.count()


def test_query_with_cutoffs_in_several_strata(spark, tmp_path):
    rows, labels = [], []
    for lang, n in (("en", 400), ("de", 300), (None, 250), ("fr", 20)):
        for i in range(n):
            k = len(rows)
            odd = "# " * (i % 50 == 0) * 2 + ("same line\n" * 2 if i % 97 == 0 else "")
            rows.append((k, odd + " ".join(f"w{k}x{j}" for j in range(25)), lang, "s"))
            labels.append((k, 1, 0))
    rows += [(len(rows) + i, "#### $$ " * 6 + " ".join(f"v{i}x{j}" for j in range(25)), lang, "s") for i, lang in enumerate(["en", "de", None, "fr"] * 5)]
    rows += [(9000 + i, rows[0][1], "en", "s") for i in range(500)]  # copies are no trials of their own
    labels += [(9000 + i, 1, 0) for i in range(500)] + [(1, 0, 0), (2, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "d"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "l"))
    (next((tmp_path / "d").glob("*.parquet"))).rename(tmp_path / "documents.parquet")
    (next((tmp_path / "l").glob("*.parquet"))).rename(tmp_path / "labels.parquet")
    for t in "region nation customer supplier part orders lineitem events embeddings pages benchmark conversations".split():
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    out = quality_rules.op3_quality_rules(spark, str(tmp_path))
    assert {r.cut_symbols is None for r in out.where("lang is null" if "lang" in out.columns else "true").collect()} == {True, False}
    assert out.where("not kept and not base_failed").count() > 0
    same(spark, quality_rules.op3_quality_rules, quality_rules.OP3_SQL, str(tmp_path))


def test_cutoffs_keep_their_promise(spark):
    """Sixty strata in which the first step rejects nothing and every other more than the risk: none goes beyond the first."""
    rnd = np.random.default_rng(5)
    rows = [(s * 1000 + i, f"s{s}", s * 1000 + i, 100, 1000, int(1000 * rnd.random() / 2) if rnd.random() < 0.2 else 0, 0, 0, 10) for s in range(60) for i in range(500)]
    measured = spark.createDataFrame(rows, "doc_id long, stratum string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    labels = measured.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert {r.step for r in quality_rules.cutoffs(measured, labels).collect()} == {0}
    # one text, however often, proves nothing
    assert {r.step for r in quality_rules.cutoffs(measured.withColumn("text_hash", F.lit(1)), labels).collect()} == {None}


@pytest.mark.parametrize("leaves", [shard_tree.even_tree(8), [shard_tree.Leaf(0, 0, 0, 5.0), shard_tree.Leaf(0, 1, 1, 0.5), shard_tree.Leaf(3, 0, 2, 2.0), shard_tree.Leaf(3, 0, 7, 0.0)]])
def test_descent_and_growth(spark, leaves):
    def draw(key, prefix, children):
        u = lambda c: (int(hashlib.md5(f"{key}|{prefix}{c}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return min((-math.log(u(c)) / w, c) for c, w in children.items())[1]

    def walk(key, leaves):
        total = lambda of, by: {k: sum(x.weight for x in of if by(x) == k) for k in {by(x) for x in of if x.weight > 0}}
        region = draw(key, "r", total(leaves, lambda x: x.region))
        inside = [x for x in leaves if x.region == region]
        rack = draw(key, f"k{region}/", total(inside, lambda x: x.rack))
        return region, rack, draw(key, "s", total([x for x in inside if x.rack == rack], lambda x: x.shard))

    rows = spark.range(600).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    for tree in (leaves, shard_tree.grown(leaves), shard_tree.grown(shard_tree.grown(leaves))):
        got = {r.k: tuple(r.p) for r in rows.select("k", shard_tree.place(F.col("k"), tree).alias("p")).collect()}
        assert got == {k: walk("null" if k is None else k, tree) for k in got}
        more = shard_tree.grown(tree)
        moved = {r.b for r in rows.select(shard_tree.place(F.col("k"), tree)["shard"].alias("a"), shard_tree.place(F.col("k"), more)["shard"].alias("b")).where("a <> b").collect()}
        assert moved == {more[-1].shard}


def test_fingerprints_by_brute_force():
    rnd = np.random.default_rng(8)
    rank = rare_features.ranks(rnd.integers(0, 50, 1001))
    texts = [b"", b"short", bytes(rnd.integers(97, 110, 64, "u1")), bytes(rnd.integers(97, 123, 900, "u1")), b"ab" * 300, "né wörd ".encode() * 40 + bytes(rnd.integers(97, 103, 700, "u1"))]

    def plain(t):
        if not t:
            return b""
        t = t + bytes(64 - len(t)) if len(t) < 64 else t
        rows = [t[i : i + 64] for i in range(len(t) - 63)]
        full = 6 * 64 * (1 << 20)
        level = lambda w: min(1000, max(0, (full - sum(round(c * math.log2(c) * (1 << 20)) for c in Counter(w).values())) * 1000 // full))
        key = [(rank[level(w)], i) for i, w in enumerate(rows)]
        wins = Counter(min(key[max(0, a) : a + 64])[1] for a in range(-63, len(rows)))
        seen, filters = [], []
        for i in sorted(i for i, n in wins.items() if n >= 16):
            h, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
            for k in range(8):
                h = (h ^ int.from_bytes(rows[i][8 * k : 8 * k + 8], "little")) * 0xD6E8FEB86659FD93 & mask
                h ^= h >> 32
            h = h * 0xD6E8FEB86659FD93 & mask
            h ^= h >> 29
            if h not in seen:
                seen.append(h)
        for at in range(0, len(seen), 160):
            bits = np.zeros(2048, bool)
            for h in seen[at : at + 160]:
                bits[[h >> 11 * k & 2047 for k in range(5)]] = True
            filters.append(np.packbits(bits).tobytes())
        return b"".join(filters)

    assert [d.tobytes() for d in rare_features.digests(texts, rank)] == [plain(t) for t in texts]
