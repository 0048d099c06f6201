"""Mixing sources to target weights by pivotal dependent rounding.

Sources in code-point order, null last, weigh 3, 1, 2, repeating, and share 150 % of all words; a source stops at twice
its size and the excess goes to the others by weight. Within a source every document is due ``target / source
size`` copies: the whole part is certain, the fraction is rounded by pivoting. Two documents meet and words move from
one to the other, each way with the probability that keeps both expectations, until one fraction becomes 0 or
1; the other goes on. Expected copies stay what they were and the source's words don't change at any meeting, so a source
misses its target by less than one document. Meetings run as a reduction tree: groups of about 32
documents fold in a row, their residuals, one a group, form the next level's groups. Group keys are hashes, so a hot
source has as many groups as its documents need, and draws are hashes too, so reruns agree.

Only DataFrame functions are used; rows are narrow (no texts) and no group exceeds a small multiple of 32.

Defined results: null and blank texts have size 0 and take 0; a null source is a source; rows that repeat the same document
(same id, source and text) share one draw; texts of any length are counted where they lie; an empty table gives an empty result;
other columns, whatever their names, pass through ``mixed``. Documents are told apart by their id and a 64-bit hash of id, source and text.
The sources' sizes, one row each, pass through one task: meant for up to some millions of sources.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fresh, let, table, words, written

WEIGHTS, SHARE, LIMIT, FOLD = (3, 1, 2), 1.5, 2, 32


def _unit(*parts: Column) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, n_docs, weight, target from one row a source (source, source_size, n_docs).

    The level ``x`` of ``min(2 size, weight x)`` is found in closed form: ordered by ``2 size / weight``, sources are
    full up to the first whose cap the level of the rest doesn't reach. One row a source goes through the window.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    weigh = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    caps = sizes.withColumn("weight", weigh).withColumn("cap", F.lit(float(LIMIT)) * F.col("source_size"))
    everything, by = W.partitionBy(F.lit(1)), W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    total = F.lit(SHARE) * F.sum("source_size").over(everything)
    upto = by.rowsBetween(W.unboundedPreceding, -1)
    left = total - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0))
    full = caps.withColumn("level", left / weights_left).withColumn("open", F.col("level") <= F.col("cap") / F.col("weight"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    return full.withColumn("x", level).select("source", "source_size", "n_docs", "weight", F.least("cap", F.coalesce(F.col("weight") * F.col("x"), F.col("cap"))).alias("target"))


def _fold(rows: Column, seed: Column) -> Column:
    """Struct of ``done`` (key and up of the settled rows) and ``rest`` (the residual) of a group."""

    def meet(a: Column, b: Column) -> Column:
        gain = F.least((1 - a["p"]) * a["w"], b["p"] * b["w"])  # words from b to a until a is whole or b is empty
        lose = F.least(a["p"] * a["w"], (1 - b["p"]) * b["w"])
        first = _unit(a["key"], b["key"], seed) * (gain + lose) < lose

        def settle(t: Column) -> Column:
            a_done = F.when(t["first"], (1 - a["p"]) * a["w"] <= b["p"] * b["w"]).otherwise(a["p"] * a["w"] <= (1 - b["p"]) * b["w"])
            a_p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), a["p"] + F.when(t["first"], t["gain"]).otherwise(-t["lose"]) / a["w"]))
            b_p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), b["p"] - F.when(t["first"], t["gain"]).otherwise(-t["lose"]) / b["w"]))
            up = F.when(a_done, t["first"]).otherwise(~t["first"])
            pick = lambda yes, no, p: F.struct(F.when(a_done, yes["key"]).otherwise(no["key"]).alias("key"), F.when(a_done, yes["w"]).otherwise(no["w"]).alias("w"), p.alias("p"))
            return F.struct(F.struct(pick(a, b, F.lit(0.0))["key"].alias("key"), up.alias("up")).alias("out"), pick(b, a, F.when(a_done, b_p).otherwise(a_p)).alias("rest"))

        return let(F.struct(gain.alias("gain"), lose.alias("lose"), first.alias("first")), settle)

    start = F.struct(F.get(rows, F.lit(0)).alias("rest"), F.array().cast("array<struct<key:struct<hash:bigint,id:bigint>,up:boolean>>").alias("done"))
    step = lambda acc, x: let(meet(acc["rest"], x), lambda m: F.struct(m["rest"].alias("rest"), F.concat(acc["done"], F.array(m["out"])).alias("done")))
    return F.aggregate(F.slice(rows, 2, F.size(rows)), start, step)


def pivot(units: DataFrame, seed: int = 0) -> DataFrame:
    """key and up (the fraction became 1) of units (key of hash and id, source, w > 0, 0 < p < 1, n_docs of the source).

    Each level writes what it settles and hands on one residual a group, so level k moves 1/32^k of the rows.
    The last residual of a source is rounded by its fraction.
    """
    spark, settled, level = units.sparkSession, [], 0
    now = units.select("key", "source", "w", "p", F.ceil(F.col("n_docs") / FOLD).alias("groups"))
    while True:
        salt = F.lit(seed * 1000 + level)
        keyed = now.withColumn("g", F.pmod(F.xxhash64("key", salt), F.greatest(F.col("groups"), F.lit(1))))
        rows = F.sort_array(F.collect_list(F.struct(_unit(F.col("key"), salt, F.lit("order")).alias("o"), "key", "w", "p")))
        bare = F.transform(F.col("rows"), lambda x: F.struct(x["key"].alias("key"), x["w"].alias("w"), x["p"].alias("p")))
        folded = keyed.groupBy("source", "g").agg(rows.alias("rows"), F.max("groups").alias("groups")).select("source", "groups", bare.alias("rows"))
        folded = written(folded.select("source", "groups", _fold(F.col("rows"), salt).alias("f")), "pivot")
        settled.append(folded.select(F.explode("f.done").alias("d")).select("d.key", "d.up"))
        rest = folded.select("source", "groups", "f.rest.*")
        if not rest.where("groups > 1").limit(1).count():
            settled.append(rest.select("key", (_unit(F.col("key"), salt, F.lit("last")) < F.col("p")).alias("up")))
            return reduce(DataFrame.unionByName, settled)
        now, level = rest.select("key", "source", "w", "p", F.when(F.col("groups") > 1, F.ceil(F.col("groups") / FOLD)).otherwise(1).alias("groups")), level + 1


def _key(docs: DataFrame) -> Column:
    doc_id = docs["doc_id"].cast("bigint")
    return F.struct(F.xxhash64(doc_id, F.lit("s"), docs["source"].cast("string"), F.lit("t"), docs["text"].cast("string")).alias("hash"), doc_id.alias("id"))


def copies(docs: DataFrame, seed: int = 0) -> DataFrame:
    """One row a document: doc_id, key, size, source, source_size, target, copies."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.size(words(F.col("text"))).cast("bigint").alias("size"), _key(docs).alias("key"))
    # same id, source and text: one unit of all their words, settled once
    units = written(rows.groupBy("key", "doc_id", "source", "size").agg(F.count("*").alias("m")), "units")
    by_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n_docs"))
    goal = written(targets(by_source), "targets").withColumnRenamed("source", "__s")
    due = units.join(goal, units["source"].eqNullSafe(goal["__s"])).drop("__s").withColumn("due", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))
    due = due.withColumn("whole", F.floor("due")).withColumn("p", F.col("due") - F.floor("due"))
    open_ = due.where("size > 0 and p > 0").select("key", "source", (F.col("size") * F.col("m")).cast("double").alias("w"), "p", "n_docs")
    up = pivot(open_, seed).where("up").select("key", F.lit(1).alias("extra"))
    taken = F.when(F.col("size") > 0, F.col("whole") + F.coalesce(F.col("extra"), F.lit(0))).otherwise(0).cast("bigint")
    return due.join(up, "key", "left").select("doc_id", "key", "size", "m", "source", "source_size", "target", taken.alias("copies"))


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The documents with the columns they came with, each as often as the mix takes it."""
    key, times = fresh(docs, "key"), fresh(docs, "times")
    taken = copies(docs, seed).where("copies > 0").select(F.col("key").alias(key), F.sequence(F.lit(1), F.col("copies").cast("int")).alias(times))
    out = docs.withColumn(key, _key(docs)).join(taken, key)
    return out.withColumn(times, F.explode(times)).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = copies(table(spark, sf_dir, "documents"))
    out = out.withColumn("m", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
