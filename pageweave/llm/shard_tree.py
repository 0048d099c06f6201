"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each level every child draws ``-ln(u) / weight`` with ``u`` hashed from
the key and the child's name; the smallest draw wins. A child's draw depends on nothing but the key, its name and
its own weight (the sum of the shards below it), so a changed weight moves keys only into or out of that child,
and movement stays within the subtrees whose weights change. A shard added below a region or rack that has others makes
these heavier, so some rows also move to its neighbours there; ``grown`` adds it as a region of its own, which takes rows only into
itself, whatever the tree. All of it is column expressions; nothing is collected.

Defined results: a null key hashes as the word ``null``; equal keys share a shard, rows of equal keys have slots by checksum and size;
null and empty texts have size 1 and checksum 0; texts of any length are measured where they lie; children of weight 0 or less take nothing;
an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table, written

SHARDS, SLOT_BUCKETS = 8, 1024


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 2, racks: int = 2) -> list[Leaf]:
    """Shards in order, filling racks and regions; a full tree's next shard opens a new region."""
    per_region = per_rack * racks
    return [Leaf(s // per_region, s % per_region // per_rack, s) for s in range(shards)]


def grown(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region of its own: rows move only into it."""
    return [*leaves, Leaf(max((x.region for x in leaves), default=-1) + 1, 0, max((x.shard for x in leaves), default=-1) + 1, weight)]


def _unit(key: Column, name: Column) -> Column:
    """A number in (0, 1) from 52 bits of the hash."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), name)), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def _draw(key: Column, prefix: Column, children: Column) -> Column:
    """The id of the child with the smallest weighted draw, the smaller id on a tie."""
    drawn = F.transform(children, lambda c: F.struct((-F.log(_unit(key, F.concat(prefix, c["id"].cast("string")))) / c["weight"]).alias("d"), c["id"].alias("id")))
    return F.array_min(drawn)["id"]


def _children(pairs: list[tuple[int, float]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(float(w)).alias("weight")) for i, w in sorted(pairs)])


def place(key: Column, leaves: list[Leaf]) -> Column:
    """Struct of region, rack and shard of a key. A shard's draw uses its own id, ids of racks are those within a region."""
    sums: dict[str, dict] = {k: defaultdict(float) for k in ("region", "rack", "shard")}
    for x in leaves:
        if x.weight > 0:
            sums["region"][x.region] += x.weight
            sums["rack"][x.region, x.rack] += x.weight
            sums["shard"][x.region, x.rack, x.shard] += x.weight
    racks, shards = defaultdict(list), defaultdict(list)
    for (r, k), w in sums["rack"].items():
        racks[r].append((k, w))
    for (r, k, s), w in sums["shard"].items():
        shards[f"{r}/{k}"].append((s, w))
    rack_map = F.create_map(*[c for r, p in racks.items() for c in (F.lit(r), _children(p))])
    shard_map = F.create_map(*[c for n, p in shards.items() for c in (F.lit(n), _children(p))])
    key = F.coalesce(key.cast("string"), F.lit("null"))
    slash = lambda *c: F.concat_ws("/", *c)

    def below(region: Column) -> Column:
        rack = _draw(key, F.concat(F.lit("k"), region.cast("string"), F.lit("/")), F.element_at(rack_map, region))
        leaf = lambda k: F.struct(region.alias("region"), k.alias("rack"), _draw(key, F.lit("s"), F.element_at(shard_map, slash(region.cast("string"), k.cast("string")))).alias("shard"))
        return F.element_at(F.transform(F.array(rack), leaf), 1)

    return F.element_at(F.transform(F.array(_draw(key, F.lit("r"), _children(list(sums["region"].items())))), below), 1)


def assign(docs: DataFrame, leaves: list[Leaf], after: list[Leaf] | None = None, key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard (that of the tree ``after``, else null).

    Slots number a shard's rows from 0 without gaps: rows are ranked in 1024 hash buckets of each shard, whose
    counts (at most 1024 a shard, so of bounded size) give each bucket its first slot. Buckets go by key, checksum and size, so rows of one key, or without any,
    are dealt to many; only rows that are equal in all three meet.
    """
    k, data = F.col(key), F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    placed = docs.select(
        k.alias("doc_id"), (F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("bigint") + 1).alias("size"), F.crc32(data).alias("text_crc32"),
        place(k, leaves)["shard"].alias("shard"), (place(k, after)["shard"] if after else F.lit(None).cast("int")).alias("grown_shard"),
    )
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(SLOT_BUCKETS)))
    placed = written(placed, "placed")  # narrow, and read twice: a key descends once
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    ranked = placed.withColumn("rank", F.row_number().over(within))
    return ranked.join(F.broadcast(first), ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - 1).alias("slot"), "grown_shard")


def op5_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"), even_tree(SHARDS), grown(even_tree(SHARDS)))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
