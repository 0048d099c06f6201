"""The trie of conversation prefixes by composable monoid fingerprints.

Conversations are rebuilt: the head of a base conversation, then one's own turns after as many. No rebuilt text is ever made. A run of turns has a
fingerprint in a monoid, the pair (value, power) modulo a prime, with ``(a, p) (b, q) = (a q + b, p q)``; turns multiply to runs, in
whatever portions. The turns are stored once, in order, dealt to ranges so that a conversation of any length may lie in many; each
range multiplies its own, the products of ranges before it are put in front, and a base's head in front of an own suffix
is one more product: ``own + (head - cut) * power`` for every prefix at once.

Prefixes with equal depth and fingerprint are one node. This is verified, not trusted: all members of a node must have one parent and one last
turn by hash, and where their last turns are different stored turns (by reference to conversation and place), the stored roles and
texts behind a hash must be equal. By induction from the root, equal fingerprints are then equal sequences. If a check
fails, everything is done again with other hashes.

A node belongs to its smallest member, so nodes of one owner are the end of that conversation's path, and paths hang on paths. Sums over
subtrees: totals of whole paths climb the tree of paths by pointer doubling, then each path is summed from its end in portions of
bounded length. Rows are some numbers; texts move once, for the store.

Defined results: turns are ordered by turn (null first), ties by role and text; null roles and texts are empty; repeated rows are turns each;
rows without conv_id are of no conversation and take no part; a conversation may be left with no turn and then ends in the root; texts and
conversations of any length are whole; an empty table gives an empty result; only the four columns are read. The digest of the members
that end in one node is a single sequential hash, by its definition: their ids, put together in portions of at most 4,096,
stream through one task in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import few, fresh, table, words, written

PRIME = (1 << 61) - 1
#: Nodes of a path that are summed in one portion; ids of a portion as a power of two.
SPAN, IDS = 1024, 12


@dataclass(frozen=True)
class Rebuild:
    """The base of conversation c is ``c - c % stride``; of its turns the first ``crc32(c) % heads`` are taken."""

    stride: int = 20
    heads: int = 4

    @property
    def base(self) -> Column:
        return F.col("conv_id") - F.col("conv_id") % self.stride

    @property
    def head(self) -> Column:
        return F.crc32(F.col("conv_id").cast("string").cast("binary")) % self.heads


@dataclass(frozen=True)
class Monoid:
    """Fingerprints modulo a prime, with a base drawn from a seed."""

    seed: int = 0
    prime: int = PRIME

    @property
    def base(self) -> int:
        return 2 + (0x9E3779B97F4A7C15 * (2 * self.seed + 1)) % (self.prime - 3)

    def turn(self) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), "role", "text"), F.lit(self.prime))

    def times(self, a: Column, b: Column) -> Column:
        wide = "decimal(19,0)"
        return (a.cast(wide) * b.cast(wide) % F.lit(self.prime).cast(wide)).cast("bigint")

    def plus(self, a: Column, b: Column) -> Column:
        return (a + b) % self.prime

    def over(self, power: int) -> Column:
        """The base to the power of minus ``power``."""
        return F.lit(pow(self.base, -power, self.prime))


def store(conversations: DataFrame, monoid: Monoid) -> DataFrame:
    """All turns in order, with their range ``part``, place ``at`` within the conversation's run there, and the run's product before and after.

    A counter is the last key of the order, so that even rows that are equal in all columns can be dealt to more than one range.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", blank("role").alias("role"), blank("text").alias("text"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "role", "text", "row"]
    told = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text", monoid.turn().alias("own"), F.size(words(F.col("text"))).cast("bigint").alias("words"))
    base, prime = monoid.base, monoid.prime

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, value, power = None, 0, 0, 1
        for b in batches:
            found = []
            for conv, own in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if conv != last:
                    last, at, value, power = conv, 0, 0, 1
                before, at, value, power = value, at + 1, (value * base + own) % prime, power * base % prime
                found.append((at, before, value, power))
            more = zip(*found, strict=True) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in more)], [*b.schema.names, "at", "before", "value", "power"])

    schema = "conv_id long, role string, text string, own long, words long, at long, before long, value long, power long"
    return written(told.mapInArrow(run, schema).withColumn("part", F.spark_partition_id()), "turns")


def _ahead(turns: DataFrame, monoid: Monoid) -> DataFrame:
    """What lies before a conversation's run in ranges after its first: conv_id, part, turns, value, power. At most two rows a range."""
    runs = written(turns.groupBy("part", "conv_id").agg(F.max("at").alias("n"), F.max_by("value", "at").alias("value"), F.max_by("power", "at").alias("power")), "runs")
    edges = runs.groupBy("part").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi")).select("part", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("conv_id"))
    parted = edges.groupBy("conv_id").agg(F.count("*").alias("k")).where("k > 1").select("conv_id")
    prime = monoid.prime

    def product(rows):
        rows = rows.sort_values("part")
        n, value, power, out = 0, 0, 1, []
        for m, v, p in zip(rows["n"].tolist(), rows["value"].tolist(), rows["power"].tolist(), strict=True):
            out.append((n, value, power))
            n, value, power = n + m, (value * p + v) % prime, power * p % prime
        rows["turns_ahead"], rows["value_ahead"], rows["power_ahead"] = zip(*out, strict=True)
        return rows[["conv_id", "part", "turns_ahead", "value_ahead", "power_ahead"]]

    # as many rows as there are ranges at most, one group a conversation that lies in several
    return runs.join(F.broadcast(parted), "conv_id").groupBy("conv_id").applyInPandas(product, "conv_id long, part int, turns_ahead long, value_ahead long, power_ahead long")


def prefixes(turns: DataFrame, monoid: Monoid, rule: Rebuild) -> DataFrame:
    """One row for each rebuilt conversation and depth: conv_id, depth, mark (fingerprint), parent (its), own (last turn's hash), words, the stored turn
    (ref_conv, ref_place) and whether the conversation ends here."""
    inside = turns.select("part", "conv_id", "own", "words", "at", "before", "value", "power").join(F.broadcast(_ahead(turns, monoid)), ["part", "conv_id"], "left")
    moved = lambda value, power: F.when(F.col("turns_ahead").isNull(), value).otherwise(monoid.plus(monoid.times(F.col("value_ahead"), power), value))
    whole = inside.select(
        "conv_id", "own", "words", (F.col("at") + F.coalesce("turns_ahead", F.lit(0))).alias("place"), moved(F.col("before"), monoid.times(F.col("power"), monoid.over(1))).alias("before"),
        moved(F.col("value"), F.col("power")).alias("value"), F.when(F.col("turns_ahead").isNull(), F.col("power")).otherwise(monoid.times(F.col("power_ahead"), F.col("power"))).alias("power"),
    )
    first = range(1, rule.heads)
    named = [(f"{c}{j}", c, j) for c in ("value", "own", "words") for j in first]
    convs = written(whole.groupBy("conv_id").agg(F.max("place").alias("n"), *[F.max(F.when(F.col("place") == j, F.col(c))).alias(x) for x, c, j in named]), "conversations")
    pick = lambda prefix, at: F.coalesce(F.get(F.array(F.lit(0), *[F.col(f"{prefix}value{j}") for j in first]), at.cast("int")), F.lit(0))
    bases = convs.select(*[F.col(c).alias(f"b_{c}") for c in convs.columns])
    heads = convs.withColumn("base", rule.base).withColumn("head", rule.head).join(bases, F.col("base") == F.col("b_conv_id"), "left")
    heads = heads.withColumn("taken", F.least("head", F.coalesce("b_n", F.lit(0))))
    gap = F.pmod(pick("b_", F.col("taken")) - pick("", F.least("head", "n")), F.lit(monoid.prime))
    heads = written(heads.withColumn("gap", gap), "heads")
    root = heads.select("conv_id", F.lit(0).cast("bigint").alias("depth"), *[F.lit(0).cast("bigint").alias(c) for c in ("mark", "parent", "own", "words", "ref_conv", "ref_place")], ((F.col("taken") == 0) & (F.col("n") <= F.col("head"))).alias("ends"))
    steps = [
        F.struct(F.lit(j).cast("bigint").alias("depth"), F.col(f"b_value{j}").alias("mark"), (F.col(f"b_value{j - 1}") if j > 1 else F.lit(0).cast("bigint")).alias("parent"), F.col(f"b_own{j}").alias("own"), F.col(f"b_words{j}").alias("words"),
                 F.col("base").alias("ref_conv"), F.lit(j).cast("bigint").alias("ref_place"), ((F.col("taken") == j) & (F.col("n") <= F.col("head"))).alias("ends"))
        for j in first
    ]
    above = heads.select("conv_id", "taken", F.explode(F.array(*steps)).alias("s")).where("s.depth <= taken").select("conv_id", "s.*")
    own = whole.join(heads.select("conv_id", "n", "head", "taken", "gap"), "conv_id").where("place > head")
    # the own suffix starts after the head: its power is that of the prefix over that of the head
    suffix = monoid.times(F.col("power"), F.get(F.array(*[monoid.over(j) for j in range(rule.heads)]), F.col("head").cast("int")))
    own = own.withColumn("suffix", suffix).withColumn("depth", F.col("taken") + F.col("place") - F.col("head"))
    put = lambda value, power: monoid.plus(F.col(value), monoid.times(F.col("gap"), power))
    below = own.select(
        "conv_id", "depth", put("value", F.col("suffix")).alias("mark"), put("before", monoid.times(F.col("suffix"), monoid.over(1))).alias("parent"), "own", "words",
        F.col("conv_id").alias("ref_conv"), F.col("place").alias("ref_place"), (F.col("place") == F.col("n")).alias("ends"),
    )
    return written(root.unionByName(above).unionByName(below), "prefixes")


def _grouped(found: DataFrame) -> DataFrame:
    both = [f(c).alias(f"{name}_{c}") for c in ("parent", "own", "ref_conv", "ref_place") for name, f in (("lo", F.min), ("hi", F.max))]
    return written(found.groupBy("depth", "mark").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), *both), "nodes")


def verified(turns: DataFrame, nodes: DataFrame) -> bool:
    """Whether every node is one sequence: one parent and one last turn, and equal texts behind each hash of different stored turns."""
    if nodes.where("lo_parent <> hi_parent or lo_own <> hi_own").limit(1).count():
        return False
    apart = written(nodes.where("lo_ref_conv <> hi_ref_conv or lo_ref_place <> hi_ref_place").select(F.col("lo_own").alias("own")).distinct(), "shared-turns")
    texts = turns.select("own", "role", "text").join(few(apart), "own").groupBy("own").agg(*[f(c).alias(f"{n}_{c}") for c in ("role", "text") for n, f in (("lo", F.min), ("hi", F.max))])
    return not texts.where("lo_role <> hi_role or lo_text <> hi_text").limit(1).count()


def climbed(paths: DataFrame, sums: list[str]) -> DataFrame:
    """id and the ``sums`` of each row with those of all below it, in a table of id, up (id above, or null) and sums; by pointer doubling."""
    now = written(paths.select("id", "up", *sums), "paths")
    while now.where("up is not null").limit(1).count():
        add = now.where("up is not null").groupBy("up").agg(*[F.sum(c).alias(f"more_{c}") for c in sums]).withColumnRenamed("up", "to")
        far = now.where("up is not null").select(F.col("id").alias("at"), F.col("up").alias("beyond"))
        more = now.join(add, now["id"] == add["to"], "left").join(far, now["up"] == far["at"], "left")
        now = written(more.select("id", F.col("beyond").alias("up"), *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums]), "paths")
    return now.drop("up")


def from_the_end(rows: DataFrame, sums: list[str]) -> DataFrame:
    """``rows`` (conv_id, depth and others) with ``sums`` added up from the deepest row of each conversation; portions are of SPAN rows."""
    part = F.floor(F.col("depth") / SPAN)
    within = W.partitionBy("conv_id", "portion").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("portion", part)
    total = rows.groupBy("conv_id", "portion").agg(*[F.sum(c).alias(c) for c in sums])
    deeper = W.partitionBy("conv_id").orderBy(F.col("portion").desc()).rowsBetween(W.unboundedPreceding, -1)
    rest = total.select("conv_id", "portion", *[F.sum(c).over(deeper).alias(f"deeper_{c}") for c in sums]).where(f"deeper_{sums[0]} is not null")
    rest = few(written(rest, "portions"))
    out = rows.select("*", *[F.sum(c).over(within).alias(f"own_{c}") for c in sums]).drop(*sums).join(rest, ["conv_id", "portion"], "left")
    return out.select(*[c for c in out.columns if c not in ("portion", *(f"{k}_{c}" for k in ("own", "deeper") for c in sums))], *[(F.col(f"own_{c}") + F.coalesce(f"deeper_{c}", F.lit(0))).alias(c) for c in sums])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (depth, mark, ids in text), sorted, to one digest a node."""
    at, digest = None, None

    def ended() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([digest.hexdigest()])], ["depth", "mark", "ends_sha256"])

    for b in batches:
        for depth, mark, ids in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if at != (depth, mark):
                if at is not None:
                    yield ended()
                at, digest = (depth, mark), hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
    if at is not None:
        yield ended()


def ends(found: DataFrame) -> DataFrame:
    """depth, mark and ends_sha256 of the nodes in which a conversation ends."""
    portion = F.shiftright("conv_id", IDS)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    some = found.where("ends").groupBy("depth", "mark", portion.alias("portion")).agg(ids.alias("ids"))
    ordered = some.repartition("depth", "mark").sortWithinPartitions("depth", "mark", "portion")
    return ordered.select("depth", "mark", "ids").mapInArrow(_digests, "depth long, mark long, ends_sha256 string")


def trie(conversations: DataFrame, rule: Rebuild = Rebuild(), monoids: Iterable[Monoid] | None = None) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    for monoid in monoids or map(Monoid, count()):
        turns = store(conversations, monoid)
        found = prefixes(turns, monoid, rule)
        nodes = _grouped(found)
        if verified(turns, nodes):
            return _measured(found, nodes)
    raise ValueError("no fingerprint tells all prefixes apart")


def _measured(found: DataFrame, nodes: DataFrame) -> DataFrame:
    nodes = nodes.select("depth", "mark", "conv_id", "n_convs", "words", F.col("lo_parent").alias("parent"))
    paths = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("last"), F.min_by("parent", "depth").alias("hangs_on"))
    above = nodes.select((F.col("depth") + 1).alias("top"), F.col("mark").alias("hangs_on"), F.col("conv_id").alias("up"))
    paths = written(paths.where("top > 0").join(above, ["top", "hangs_on"]).select("conv_id", "top", "last", "up").unionByName(paths.where("top = 0").select("conv_id", "top", "last", F.lit(None).cast("bigint").alias("up"))), "tops")
    hung = paths.where("up is not null").groupBy(F.col("up").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(F.count("*").alias("hung"))
    told = nodes.join(paths, "conv_id").join(hung, ["conv_id", "depth"], "left")
    told = told.withColumn("n_children", F.coalesce("hung", F.lit(0)) + (F.col("depth") < F.col("last")).cast("bigint"))
    told = told.withColumn("n_leaves", (F.col("n_children") == 0).cast("bigint")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words"))
    parent = F.when(F.col("depth") == F.col("top"), F.col("up")).otherwise(F.col("conv_id"))
    told = written(told.select("conv_id", "depth", "mark", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens"), "told")
    sums = ["n_leaves", "saved_tokens"]
    alone = told.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in sums]).join(paths, "conv_id")
    total = climbed(alone.select(F.col("conv_id").alias("id"), "up", *sums), sums)
    below = total.join(paths.where("up is not null"), total["id"] == paths["conv_id"]).groupBy(F.col("up").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(*[F.sum(c).alias(f"hung_{c}") for c in sums])
    with_hung = told.join(below, ["conv_id", "depth"], "left").select(*[c for c in told.columns if c not in sums], *[(F.col(c) + F.coalesce(f"hung_{c}", F.lit(0))).alias(c) for c in sums])
    out = from_the_end(with_hung, sums).join(ends(found), ["depth", "mark"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


#: The same rows in DuckDB, from the rebuilt sequences themselves; the first line is CRC-32 bit by bit.
OP11_SQL = r"""with h as (select conv_id c, xor(list_reduce(list_prepend(4294967295::bigint, [ascii(x)::bigint for x in string_split(conv_id::varchar, '')]), lambda a, b:
    list_reduce(list_prepend(xor(a, b), [0::bigint for k in range(8)]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 4 h from (select distinct conv_id from conversations where conv_id is not null)),
o as (select conv_id c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) s from conversations where conv_id is not null group by 1),
r as (select h.c, coalesce(b.s[1 : h], []) || coalesce(o.s[h + 1 :], []) s from h join o using (c) left join o b on b.c = h.c - h.c % 20),
p as (select c, s[1 : d] k, d, len(s) n from (select c, s, unnest(range(len(s) + 1)) d from r)),
g as (select k, d, min(c) conv_id, count(*) n_convs, coalesce(string_agg(c::varchar, ',' order by c) filter (where n = d), '') ids from p group by 1, 2),
v as (select *, case when d = 0 then 0 else (n_convs - 1) * len(regexp_extract_all(k[d].text, '[^\x20\x09-\x0D]+')) end saved from g),
w as (select v.*, u.conv_id parent_conv_id from v left join v u on u.d = v.d - 1 and u.k = v.k[1 : v.d - 1]),
n as (select conv_id, d, (select count(*) from w x where x.parent_conv_id = w.conv_id and x.d = w.d + 1) n_children from w),
m as (select w.*, n.n_children from w join n using (conv_id, d)),
up as (select m.conv_id, m.d, a.conv_id a_conv, a.d a_d, (m.n_children = 0)::bigint leaf, m.saved from m join (select c, k, d from p) q on q.c = m.conv_id and q.d <= m.d join g a on a.d = q.d and a.k = q.k),
t as (select a_conv conv_id, a_d d, sum(leaf)::bigint n_leaves, sum(saved)::bigint saved_tokens from up group by 1, 2)
select m.conv_id, m.d depth, m.parent_conv_id, m.n_convs, m.n_children, t.n_leaves, t.saved_tokens, sha256(m.ids) ends_sha256 from m join t using (conv_id, d)"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))
