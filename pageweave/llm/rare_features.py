"""Document fingerprints of improbable features.

Every window of 64 bytes has an entropy level (0 to 1000). A first pass counts the levels of all windows of the
corpus; the rarer a level, the better its rank. A window is selected when it has the best rank (the leftmost on a
tie) in at least 16 of the 64 runs of 64 neighbouring windows that hold it. Selected windows, each distinct content once and
in order, go into a chain of Bloom filters of 2048 bits, five bits each and 160 windows a filter. Likeness compares every
filter of the digest with fewer filters with its best match in the other: shared bits above those expected by chance, as a share of
the most there could be, weighted by bits.

Texts are processed in blocks, so memory is bounded by a block and the digest, and equal texts have equal
fingerprints under one table of ranks, which can be kept and passed to later runs.

Neighbours by descending doc_id are found with one shuffle: ids alone give range boundaries, every range also gets the first
document of the range after it, and tasks stream their sorted ranges.

Defined results: a null text is empty, and an empty text has the empty fingerprint (likeness 1 to itself, 0 to others); a text
of under 64 bytes is one window, padded with zero bytes; rows of equal doc_id are ordered by text, null ids come last;
rows of one id, and those without, are one range, which one task streams in constant memory; the only document of a table is its own neighbour; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WIDTH, POPULAR, BITS, PER_FILTER, LEVELS = 64, 16, 2048, 160, 1001
BLOCK = 1 << 18
_UNIT = 1 << 20
_F = np.array([round(c * np.log2(c) * _UNIT) if c else 0 for c in range(WIDTH + 1)], "i8")
_FULL = 6 * WIDTH * _UNIT
_FAR = np.int64(1) << 40


def levels(x: np.ndarray) -> np.ndarray:
    """Entropy level of the window at each of the first len(x) - 63 bytes."""
    n = len(x)
    before, after = np.zeros(n, "u1"), np.zeros(n, "u1")  # equal bytes among the 63 before and after
    for d in range(1, WIDTH):
        same = (x[d:] == x[:-d]).view("u1")
        before[d:] += same
        after[:-d] += same
    first = _F[np.bincount(x[:WIDTH], minlength=256)].sum()
    gain, loss = _F[1:] - _F[:-1], _F[1:] - _F[:-1]
    sums = np.empty(n - WIDTH + 1, "i8")
    sums[0] = first
    np.cumsum(gain[before[WIDTH:]] - loss[after[: n - WIDTH]], out=sums[1:])
    sums[1:] += first
    return ((_FULL - sums) * (LEVELS - 1) // _FULL).clip(0, LEVELS - 1)


def _blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, text of each window or -1, whether the block answers for it), short texts together, long ones cut with margins."""
    held, size = [], 0
    for i, t in enumerate(texts):
        if 0 < len(t) <= BLOCK:
            held.append((i, t if len(t) >= WIDTH else t + bytes(WIDTH - len(t))))
            size += len(t)
        elif t:
            for a in range(0, len(t) - WIDTH + 1, BLOCK):
                lo, hi = max(0, a - WIDTH + 1), min(len(t), a + BLOCK + 2 * WIDTH)
                x = np.frombuffer(t, "u1")[lo:hi]
                at = np.arange(lo, lo + len(x) - WIDTH + 1)
                yield x, np.full(len(at), i), (at >= a) & (at < a + BLOCK)
        if held and (size > BLOCK or i == len(texts) - 1):
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(t for _, t in held), "u1")
    owner = np.repeat([i for i, _ in held], [len(t) for _, t in held])
    at = np.arange(len(x) - WIDTH + 1)
    owner = np.where(owner[at] == owner[at + WIDTH - 1], owner[at], -1)  # windows across texts belong to none
    return x, owner, owner >= 0


def count_levels(texts: list[bytes]) -> np.ndarray:
    out = np.zeros(LEVELS, "i8")
    for x, _, own in _blocks(texts):
        out += np.bincount(levels(x)[own], minlength=LEVELS)
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each level, the rarest first."""
    out = np.empty(LEVELS, "i8")
    out[np.lexsort((np.arange(LEVELS), counts))] = np.arange(LEVELS)
    return out


def _mix(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each window of 64 bytes."""
    h = np.full(len(rows), 0x9E3779B97F4A7C15, "u8")
    for k in range(WIDTH // 8):
        h = (h ^ rows[:, k]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def digests(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The filters of each text: arrays of n x 256 bytes."""
    owners, hashes = [], []
    for x, owner, own in _blocks(texts):
        n = len(owner)
        key = np.where(owner >= 0, rank[levels(x)], _FAR >> 21 << 1) << 20 | np.arange(n)
        pad = np.full(WIDTH - 1, np.iinfo("i8").max)
        low = np.concatenate([pad, key, pad])
        for d in (1, 2, 4, 8, 16, 32):
            low = np.minimum(low[:-d], low[d:])
        best = low & ((1 << 20) - 1)
        popular = np.bincount(best[low < np.iinfo("i8").max], minlength=n)[:n]
        at = np.flatnonzero((popular >= POPULAR) & own & (owner >= 0))
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, WIDTH)[at]).view("<u8")
        owners.append(owner[at])
        hashes.append(_mix(rows))
    if not owners:
        return [np.zeros((0, BITS // 8), "u1") for _ in texts]
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((np.arange(len(h)), h, owner))
    first = np.ones(len(h), bool)
    first[1:] = (owner[order][1:] != owner[order][:-1]) | (h[order][1:] != h[order][:-1])
    keep = np.sort(order[first])
    keep = keep[np.argsort(owner[keep], kind="stable")]
    owner, h = owner[keep], h[keep]
    n = np.bincount(owner, minlength=len(texts))
    starts = np.cumsum(n) - n
    filters = -(-n // PER_FILTER)
    base = np.cumsum(filters) - filters
    row = base[owner] + (np.arange(len(h)) - starts[owner]) // PER_FILTER
    bits = np.zeros((int(filters.sum()), BITS), bool)
    for k in range(5):
        bits[row, (h >> np.uint64(11 * k)).astype("i8") & (BITS - 1)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[b : b + f] for b, f in zip(base, filters, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 (no more shared bits than by chance) to 1 (the same)."""
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if (len(b), b.tobytes()) < (len(a), a.tobytes()):
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(1, dtype="i8"), np.bitwise_count(b).sum(1, dtype="i8")
    total = 0.0
    for row, n in zip(a, na, strict=True):
        shared = np.bitwise_count(b & row).sum(1, dtype="i8")
        chance, most = n * nb / BITS, np.minimum(n, nb)
        total += n * float(((shared - chance) / np.maximum(most - chance, 1e-9)).max().clip(0, 1))
    return total / float(na.sum())


def corpus_ranks(docs: DataFrame) -> np.ndarray:
    """Ranks of the levels over every window of every text; at most 1001 counts come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(LEVELS, "i8")
        for b in batches:
            for at in range(0, b.num_rows, 200):
                out += count_levels([(t or "").encode() for t in b.column(0).slice(at, 200).to_pylist()])
        found = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype("i4")), pa.array(out[found])], ["level", "n"])

    counts = np.zeros(LEVELS, "i8")
    for r in docs.select(F.col("text").cast("string")).mapInArrow(count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[r["level"]] = r["n"]
    return ranks(counts)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id and text in streams: bucket, guest, doc_id, text, sorted so that a row is followed by its neighbour.

    A bucket is a range of descending ids and ends with a guest, the first row of the bucket after it.
    The driver holds the bounds and first ids of the buckets, four a shuffle partition.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("c")).first()["c"] or []
    bounds = np.unique(np.array(cuts, "i8"))

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        at = len(bounds) - np.searchsorted(bounds, ids.fillna(0).to_numpy("i8"), "left")
        return pd.Series(np.where(known, at, len(bounds)).astype("i4"))

    dealt = rows.withColumn("bucket", bucket("doc_id"))
    heads = {r["bucket"]: r["head"] for r in dealt.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads)
    follow = spark.createDataFrame([(heads[b], order[i - 1]) for i, b in enumerate(order)], "head long, bucket int")
    guests = rows.join(F.broadcast(follow), rows["doc_id"].eqNullSafe(follow["head"])).select("bucket", F.lit(1).alias("guest"), "doc_id", "text")
    both = dealt.select("bucket", F.lit(0).alias("guest"), "doc_id", "text").unionByName(guests)
    return both.repartition(n // 4, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    last = None
    for b in batches:
        for at in range(0, b.num_rows, 500):
            for bucket, guest, doc_id, text in zip(*[b.column(i).slice(at, 500).to_pylist() for i in range(4)], strict=True):
                text = text or ""
                if last is not None and last[0] == bucket:
                    yield last[1], last[2], text
                last = None if guest else (bucket, doc_id, text)


FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _compare(rank: np.ndarray):
    def emit(held: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        edited = [(t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode() for _, t, u in held]
        own, after = [t.encode() for _, t, _ in held], [u.encode() for _, _, u in held]
        place = {t: i for i, t in enumerate(dict.fromkeys([*own, *edited, *after]))}
        made = digests(list(place), rank)
        show = lambda d: base64.b64encode(d.tobytes()).decode()
        out = []
        for (doc_id, t, _), o, e, a in zip(held, own, edited, after, strict=True):
            x, y, z = made[place[o]], made[place[e]], made[place[a]]
            out.append((doc_id, len(t), hashlib.sha256(e).hexdigest(), show(x), show(y), likeness(x, y), likeness(x, z)))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True), FIELDS, strict=True)], schema=pa.schema(FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for p in _pairs(batches):
            held.append(p)
            size += len(p[1])
            if size > BLOCK or len(held) >= 200:
                yield emit(held)
                held, size = [], 0
        if held:
            yield emit(held)

    return run


def fingerprints(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """doc_id and fingerprint (base64 of the chained filters) of every text."""
    rank = corpus_ranks(docs) if rank is None else rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                made = digests([(t or "").encode() for t in part.column(1).to_pylist()], rank)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([base64.b64encode(d.tobytes()).decode() for d in made], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def op1_rare_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(_compare(corpus_ranks(docs)), schema)
