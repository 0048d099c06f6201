"""Broken and rolled archives, footers of token files, null ids, and pivotal rounding against a fold of its own."""

import hashlib
import io
import math
import struct
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from pageweave.llm import language_pieces, mixing, rare_features, shard_tree, token_files, warc_zst

# ---- archives


def archive(n=3):
    data = warc_zst.dictionary([b"<html>some sample of a page</html>" * 5])
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data), write_checksum=True)
    frames = [packer.compress(warc_zst.record_bytes(i, f"u{i}", p := f"page {i} ".encode() * 40, hashlib.sha256(p).hexdigest(), None)) for i in range(n)]
    return warc_zst.archive_head(data), frames


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_archive_is_read_frame_by_frame(chunk):
    head, frames = archive()
    got = list(warc_zst.read_archive(io.BytesIO(head + b"".join(frames)), chunk))
    assert [r["page_id"] for r in got] == [0, 1, 2] and got[2]["payload"] == b"page 2 " * 40
    assert list(warc_zst.read_archive(io.BytesIO(head))) == []
    plain = b"<html>some sample of a page</html>" * 5
    bare = struct.pack("<II", warc_zst.SKIPPABLE, len(plain)) + plain  # a dictionary that isn't compressed
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(plain)).compress(warc_zst.record_bytes(5, None, b"x", hashlib.sha256(b"x").hexdigest(), None))
    assert [r["page_id"] for r in warc_zst.read_archive(io.BytesIO(bare + frame), chunk)] == [5]


def broken():
    head, frames = archive()
    body = b"".join(frames)
    flipped = bytearray(frames[1])
    flipped[len(flipped) // 2] ^= 0xFF
    n = struct.unpack("<I", head[4:8])[0]
    good = warc_zst.record_bytes(1, "u", b"p", hashlib.sha256(b"p").hexdigest(), None)
    packed = zstandard.ZstdCompressor().compress
    return {
        "nothing": b"", "cut head": head[:5], "wrong magic": struct.pack("<II", 0x184D2A50, n) + head[8:] + body, "no dictionary": body, "cut dictionary": head[: 8 + n // 2], "bad dictionary": head[:8] + head[8:12] + b"\xff" * (n - 4) + body,
        "cut last frame": head + body[:-3], "bad frame": head + frames[0] + bytes(flipped) + frames[2], "garbage after": head + body + b"garbage", "zeros after": head + body + b"\0" * 40, "two records a frame": head + packed(good + good),
        "half a record": head + packed(good[: len(good) // 2]), "no text": head + packed(b"\xff" + good), "id no number": head + packed(good.replace(b"Page-ID: 1", b"Page-ID: x")), "length no number": head + packed(good.replace(b"\r\nContent-Length: 1\r\n", b"\r\nContent-Length: -\r\n")),
    }


@pytest.mark.parametrize("kind", broken())
def test_broken_archives(kind):
    with pytest.raises(warc_zst.WarcError):
        list(warc_zst.read_archive(io.BytesIO(broken()[kind])))


def test_rolled_archives_and_null_ids(spark, tmp_path):
    same = "the same text in three pages " * 8
    rows = [(i, f"u{i}", "".join(hashlib.sha512(f"{i} {k}".encode()).hexdigest() for k in range(30))) for i in range(60)] + [(None, None, same), (None, "n", same), (70, "a", same), (65, "b", same), (None, "alone", None), (65, "b", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    manifest = warc_zst.write_archives(pages, folder=f"file:{tmp_path}/w", roll_bytes=20_000)
    assert manifest.count() > 4 and sum(r.records for r in manifest.collect()) == len(rows)
    got = warc_zst.read_archives(manifest).collect()
    told = Counter((r.page_id, r.record_type, r.refers_to, r.target_uri) for r in got if r.page_id is None or r.page_id >= 60)
    assert told == Counter([(None, "revisit", 65, None), (None, "revisit", 65, "n"), (70, "revisit", 65, "a"), (65, "response", None, "b"), (65, "response", None, "b"), (None, "response", None, "alone")])
    assert {r.page_id: r.payload.decode() for r in got if r.page_id is not None and r.page_id < 60} == {i: h for i, _, h in rows[:60]}
    # on disk: the dictionary's frame, then a frame a record
    path, n = manifest.first().path.removeprefix("file:"), manifest.first().records
    whole = open(path, "rb").read()
    assert struct.unpack("<I", whole[:4])[0] == warc_zst.SKIPPABLE and whole.count(warc_zst.ZSTD_MAGIC) >= n
    assert len(list(warc_zst.read_archive(io.BytesIO(whole)))) == n and len(whole) == manifest.first().bytes
    # a file that lost its end doesn't pass
    open(path, "wb").write(whole[:-5])
    with pytest.raises(Exception, match="cut short"):
        warc_zst.read_archives(manifest).count()


# ---- token files


def test_footers_and_skipped_pages(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), "id", F.lit(" of many")).alias("text")).coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        token_files.write_tokens(docs, str(tmp_path / "t"), path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    file = next((tmp_path / "t").glob("*.parquet"))
    meta = pq.ParquetFile(file).metadata
    assert meta.num_rows == 9000
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    tokens = next(c for name, c in columns.items() if name.startswith("tokens"))
    assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(tokens.encodings) and tokens.compression == "ZSTD"
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings or "RLE_DICTIONARY" in columns["doc_id"].encodings
    assert all(c.has_column_index and c.has_offset_index for name, c in columns.items() if not name.startswith("tokens")) and tokens.has_offset_index
    found = token_files.read_tokens(spark, str(tmp_path / "t"), (4100, 4110))
    assert found.count() == 11
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,4100), LessThanOrEqual(doc_id,4110)]" in found._jdf.queryExecution().executedPlan().toString()
    plan = found._jdf.queryExecution().executedPlan()
    found._jdf.collect()
    leaf = plan.collectLeaves().head()
    scanned = leaf.metrics().apply("numOutputRows").value()
    assert 11 <= scanned <= 2 * token_files.PAGE_ROWS < 9000  # the pages about the range alone
    assert token_files.read_index(spark, str(tmp_path / "t"))._jdf.queryExecution().executedPlan().toString().count("tokens:array") == 0


# ---- null ids


def test_null_ids(spark, tmp_path):
    rows = [(None, "words of a text that has no id, of some length", "en", "s"), (None, None, None, None), (None, "words of a text that has no id, of some length", "en", "s"), (3, "a text with an id", "en", "s"), (3, "another text with this id", "fr", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    ids = Counter(r[0] for r in rows)
    told = rare_features.fingerprints(docs).collect()
    assert Counter(r.doc_id for r in told) == ids
    assert len({r.fingerprint for r in told}) == 4
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_tokens(docs, str(tmp_path / "n"), path)
    read = token_files.read_tokens(spark, str(tmp_path / "n")).collect()
    assert [r.doc_id for r in sorted(read, key=lambda r: (r.doc_id is not None, r.doc_id or 0))] == [None, None, None, 3, 3]
    starts = sorted((r.start, r.n_tokens) for r in token_files.read_index(spark, str(tmp_path / "n")).collect())
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(5)]
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    langs, p = language_pieces.fit(docs, vocabulary)
    told = language_pieces.classify(docs.withColumn("held_out", F.lit(False)), langs, p, vocabulary).collect()
    assert Counter(r.doc_id for r in told) == ids and [r.lang_pred for r in told if r.score == 0] == ["und"]
    assert Counter(r.doc_id for r in shard_tree.assign(docs, shard_tree.even_tree(8)).collect()) == ids


# ---- pivotal rounding


def spark_hash(*parts):
    """Spark's xxhash64 of longs, ints (as (value,)) and strings; null parts don't count."""
    h = 42
    for p in parts:
        if p is not None:
            data = p.encode() if isinstance(p, str) else struct.pack("<i", p[0]) if isinstance(p, tuple) else struct.pack("<q", p)
            h = xxhash.xxh64_intdigest(data, seed=h)
    return h


def unit(*parts):
    return (spark_hash(*parts) % (1 << 52) + 0.5) / (1 << 52)


def fold(units, seed):
    """key -> whether its fraction became 1: the reduction tree, level by level, with draws of the same hashes."""
    up, level, now = {}, 0, [(*u[:4], math.ceil(u[4] / mixing.FOLD)) for u in units]
    while True:
        salt = (seed * 1000 + level,)
        groups = defaultdict(list)
        for key, source, w, p, n in now:
            h = spark_hash(*key, salt)
            h -= (h >> 63) << 64
            groups[source, h % max(n, 1)].append((unit(*key, salt, "order"), key, w, p, n))
        rest = []
        for (source, _), rows in groups.items():
            rows.sort(key=lambda r: (r[0], r[1][0], (r[1][1] is not None, r[1][1] or 0)))
            _, ka, wa, pa, _ = rows[0]
            for _, kb, wb, pb, _ in rows[1:]:
                gain, lose = min((1 - pa) * wa, pb * wb), min(pa * wa, (1 - pb) * wb)
                first = unit(*ka, *kb, salt) * (gain + lose) < lose
                done = (1 - pa) * wa <= pb * wb if first else pa * wa <= (1 - pb) * wb
                moved = gain if first else -lose
                pa, pb = min(1, max(0, pa + moved / wa)), min(1, max(0, pb - moved / wb))
                if done:
                    up[ka] = first
                    ka, wa, pa = kb, wb, pb
                else:
                    up[kb] = not first
            rest.append((ka, source, wa, pa, max(r[4] for r in rows)))
        if all(r[4] <= 1 for r in rest):
            return up | {key: unit(*key, salt, "last") < p for key, _, _, p, _ in rest}
        now, level = [(k, s, w, p, math.ceil(n / mixing.FOLD) if n > 1 else 1) for k, s, w, p, n in rest], level + 1


@pytest.mark.parametrize("seed", [0, 3])
def test_rounding_equals_a_fold_of_its_own(spark, seed):
    rnd = np.random.default_rng(seed)
    sizes = {"hot": 2500, "b": 40, "one": 1, None: 33}
    units = [((int(rnd.integers(-(1 << 62), 1 << 62)), None if i == 7 else i), s, float(rnd.integers(1, 400)), float(rnd.uniform(0.01, 0.99)), n) for s, n in sizes.items() for i in range(n)]
    schema = "key struct<hash:bigint,id:bigint>, source string, w double, p double, n_docs long"
    got = {(r.key.hash, r.key.id): r.up for r in mixing.pivot(spark.createDataFrame(units, schema).repartition(6), seed).collect()}
    assert got == fold(units, seed)
    for s in sizes:  # a source's words change by less than one document
        own = [u for u in units if u[1] == s]
        assert abs(sum(u[2] * got[u[0]] for u in own) - sum(u[2] * u[3] for u in own)) <= max(u[2] for u in own)


def test_copies_of_a_mix_follow_from_the_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = mixing.copies(docs).collect()
    open_, due = [], {}
    n = Counter(r.source for r in rows)
    for r in rows:
        share = r.target / r.source_size
        due[r.key] = share
        if r["size"] > 0 and share % 1 > 0:
            open_.append(((r.key.hash, r.key.id), r.source, float(r["size"] * r.m), share - math.floor(share), n[r.source]))
    up = fold(open_, 0)
    assert {r.key: r.copies for r in rows} == {r.key: (math.floor(due[r.key]) + up.get((r.key.hash, r.key.id), False)) if r["size"] > 0 else 0 for r in rows}


def test_arcs_of_many_words_are_those_of_each():
    pieces = language_pieces.shared_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rnd = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyzéüßñçжш漢あ𐐨ªǆ")
    words = ["".join(rnd.choice(letters, int(rnd.integers(1, 30)))) for _ in range(2000)] + ["a", "tion", "informationen", "x" * 40, "ß"] + [n.removeprefix("▁") for n in pieces.names[:3000] if n != "▁"]
    want = sorted(e << 48 | w << 24 | s << 16 | p for w, word in enumerate(words) for s, e, p in pieces.arcs(word))
    assert np.sort(pieces.arcs_of(words)).tolist() == want
    assert pieces.arcs_of([]).tolist() == []
