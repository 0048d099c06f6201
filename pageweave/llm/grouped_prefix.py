"""Grouped prefix join: all documents whose shingle sets have a Jaccard similarity of a given percentage, as components.

1. Documents with the same set are one. Sets are told apart by 64-bit hashes of 64-bit shingle hashes, rows by 64-bit
   hashes of id and text, so ids matter only for the names of components, the smallest doc_id in each.
2. A shingle that one set alone holds can't be shared. Over the quarter of the shingles with the smallest hashes, each is
   either shared or counts against its set; a set with more of its own than the similarity leaves room for is
   linked with nothing, and most are settled here.
3. The rest are ordered by frequency, own shingles first. Linked sets have a shingle in common within their prefixes, and a second
   one no later than right after them. Sets of equal size, equal number of own shingles and equal prefix (with the shingle after it) form
   one group.
4. Groups meet at the shingles of their prefixes, if sizes and positions still allow the overlap. First the group with the fewest own
   shingles meets each of the others, its leader (the smallest member) their members, and every leader the members of its own group. Then
   leaders of groups with parts that aren't connected yet, at a shingle that very many such groups have only where they also have a second
   shingle in common; then, of parts that still aren't, the members. The distance of sets (1 - similarity) obeys the triangle inequality and every member's
   distance from its leader is known, so members that their leaders' distance rules out aren't paired. Every pair is verified on its shared
   shingles. No link that a component depends on is lost, and no pairs are made inside what is already connected.

Defined results: null and blank texts have the empty set and are linked with nothing; a text of fewer words than a
shingle is one shingle; a text of any length is one row with all its shingles; equal texts are linked whatever their number; rows that share a
doc_id are each returned, with the component of their own text; rows with a null id link as others do, and a component that only they are in
has a null name; ``one_of_each`` keeps one row of a component, also of rows with the same id and text, and a null id after all others; an
empty table gives an empty result; ``classes`` ignores other columns, ``one_of_each`` passes them through, whatever their names.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few, fresh, let, table, words, written
from .components import components

#: Groups that aren't connected meet at pairs of shingles where a shingle alone would make this many times as many pairs of groups as there are such pairs of shingles.
WORTH = 8
LOW = -(1 << 63) + (1 << 62)  # hashes below: a quarter


@dataclass(frozen=True)
class Rule:
    words: int = 5
    percent: int = 80

    def least(self, n: Column) -> Column:
        """Shingles that a set of n shares with any set it is linked with."""
        return F.floor((self.percent * n + 99) / 100).cast("bigint")

    def overlap(self, n: Column, m: Column) -> Column:
        """Shingles that linked sets of n and m share at least."""
        return F.floor((self.percent * (n + m) + 99 + self.percent) / (100 + self.percent)).cast("bigint")


def shingles(text: Column, k: int) -> Column:
    """Hashes of the distinct runs of k words, A to Z in lower case."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    runs = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])))
    return let(words(lowered), lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < k, F.array(F.xxhash64(w))).otherwise(runs(w)))


def _alone(rows: DataFrame, key: str) -> DataFrame:
    """For each set, how many of its tokens no other set has: rows of (token, key)."""
    ends = rows.groupBy("token").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    return ends.where("lo = hi").groupBy(F.col("lo").alias(key)).agg(F.count("*").alias("own"))


def _row(docs: DataFrame) -> Column:
    """What tells rows apart: a hash of id and text."""
    return F.xxhash64(docs["doc_id"].cast("bigint"), docs["text"].cast("string"))


def _candidates(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, row, n, sid) of all documents, (sid, n, row, first, copies) of all sets, (row, rep) of those that may have links."""
    made = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _row(docs).alias("row"), shingles(F.col("text"), rule.words).alias("t"))
    kept = F.filter(F.col("t"), lambda x: x < LOW)
    sets = written(made.select("doc_id", "row", F.size("t").cast("bigint").alias("n"), F.xxhash64(F.sort_array("t")).alias("sid"), kept.alias("low")), "sets")
    reps = written(sets.where("n > 0").groupBy("sid", "n").agg(F.min("row").alias("row"), F.min("doc_id").alias("first"), F.count("*").alias("copies")), "reps")
    own = _alone(sets.where("n > 0").select("sid", F.explode("low").alias("token")), "sid")
    open_ = reps.join(own, "sid", "left").where(F.col("n") - F.coalesce(F.col("own"), F.lit(0)) >= rule.least(F.col("n")))
    return sets.select("doc_id", "row", "n", "sid"), reps, written(open_.select("row", F.col("sid").alias("rep")), "open-sets")


def _shared(docs: DataFrame, open_: DataFrame, rule: Rule) -> DataFrame:
    """rep, n, own and the shared tokens, rarest first, of the sets that may be linked."""
    texts = docs.select(_row(docs).alias("row"), "text").join(few(open_), "row")
    made = texts.groupBy("rep").agg(F.first("text").alias("text")).select("rep", shingles(F.col("text"), rule.words).alias("t"))
    tokens = written(made.select("rep", F.size("t").cast("bigint").alias("n"), F.explode("t").alias("token")), "open-tokens")
    often = tokens.groupBy("token").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    lists = tokens.join(often, "token").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("s"))
    out = lists.select("rep", "n", (F.col("n") - F.size("s")).alias("own"), F.transform("s", lambda x: x["token"]).alias("shared"))
    return written(out.where(F.size("shared") >= rule.least(F.col("n"))), "shared")


def _fits(a: str, b: str, rule: Rule) -> Column:
    """Whether sizes and positions of a first common token leave room for the overlap of linked sets."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = rule.overlap(n, m)
    return (F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos")) >= need) & (F.least(n, m) >= need)


def _stars(posts: DataFrame, rule: Rule) -> DataFrame:
    """(g, h): the group with the fewest own shingles among those with a prefix token, and each of the others."""
    lead = posts.groupBy("token").agg(F.min(F.struct("own", "g", "n", "pos")).alias("l"), F.count("*").alias("c")).where("c > 1").select("token", "l.*")
    a, b = lead.alias("a"), posts.alias("b")
    return a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.g") != F.col("b.g")) & _fits("a", "b", rule)).select(F.col("a.g").alias("g"), F.col("b.g").alias("h")).distinct()


def _crossing(groups: DataFrame, posts: DataFrame, parts: DataFrame, rule: Rule) -> DataFrame:
    """(g, lg, h, lh): parts of groups with unlike labels that meet at a prefix token. Of a token's largest label only the
    other labels' rows look for partners, so what is connected isn't paired. Where that still makes very many pairs, groups meet at the
    token and each of the shingles after it instead: of the first two that linked sets have in common, the first is in both prefixes."""
    by = posts.join(parts, "g")
    c = by.groupBy("token", "lg").agg(F.count("*").alias("c"), F.sum("after").alias("after"))
    total = F.sum("c")
    labels = c.groupBy("token").agg(
        F.max_by("lg", F.struct("c", "lg")).alias("most"), F.count("*").alias("labels"), ((total - F.max("c")) * total > 2 * WORTH * F.sum("after")).alias("many")
    )
    labels = written(labels.where("labels > 1").drop("labels"), "crossing-labels")
    one = by.join(labels.where("not many"), "token").select("token", "g", "lg", "n", "pos", (F.col("lg") == F.col("most")).alias("most"))
    many = labels.where("many").select("token", "most")
    if many.limit(1).count():
        at = groups.select("g", "n", "own", "prefix", F.posexplode("prefix").alias("i", "token")).where("i < size(prefix) - 1").join(few(many), "token").join(parts, "g")
        then = F.explode(F.slice("prefix", F.col("i") + 2, F.size("prefix"))).alias("then")
        two = at.select("token", "g", "lg", "n", (F.col("own") + F.col("i")).alias("pos"), (F.col("lg") == F.col("most")).alias("most"), then)
        two = two.select(F.xxhash64("token", "then").alias("token"), "g", "lg", "n", "pos", "most")
        asked = written(two.where("not most"), "crossing-asked")
        found = two.where("most").join(few(asked.select("token").distinct()), "token", "left_semi")
        one = one.unionByName(asked).unionByName(found)
    by = written(one, "crossing")
    a, b = by.where("not most").alias("a"), by.alias("b")
    once = F.col("b.most") | (F.struct("a.g", "a.lg") < F.struct("b.g", "b.lg"))
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.lg") != F.col("b.lg")) & once & _fits("a", "b", rule))
    return met.select(F.col("a.g").alias("g"), F.col("a.lg").alias("lg"), F.col("b.g").alias("h"), F.col("b.lg").alias("lh")).distinct()


def _posts(groups: DataFrame) -> DataFrame:
    """token, g, n, own, pos, after: where groups may meet, and how many shingles of the prefix come after."""
    each = groups.select("g", "n", "own", F.size("prefix").alias("long"), F.posexplode("prefix").alias("i", "token")).where("i < long - 1")
    return each.select("token", "g", "n", "own", (F.col("own") + F.col("i")).alias("pos"), (F.col("long") - F.col("i") - 1).alias("after"))


def _overlaps(pairs: DataFrame, shared: DataFrame, rule: Rule, label: str) -> DataFrame:
    """a, b, their distance d and whether they are linked."""
    left = shared.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    right = shared.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b").withColumn("o", F.size(F.array_intersect("sa", "sb")))
    union = F.col("na") + F.col("nb") - F.col("o")
    return written(joined.select("a", "b", (1 - F.col("o") / union).alias("d"), (100 * F.col("o") >= rule.percent * union).alias("linked")), label)


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def links(docs: DataFrame, open_: DataFrame, rule: Rule) -> DataFrame:
    """Verified links (a, b) of sets, enough to connect all that are connected."""
    shared = _shared(docs, open_, rule)
    length = (F.col("n") - rule.least(F.col("n")) + 2 - F.col("own")).cast("int")
    keyed = shared.select("rep", "n", "own", F.slice("shared", F.lit(1), length).alias("prefix"))
    # where the shingles end with the prefix, nothing stands for the one after it
    keyed = keyed.withColumn("prefix", F.when(F.size("prefix") < length, F.concat("prefix", F.array(F.lit(0).cast("bigint")))).otherwise(F.col("prefix")))
    keyed = written(keyed.withColumn("key", F.xxhash64("n", "own", "prefix")), "prefixes")
    groups = written(keyed.groupBy("key", "n", "own").agg(F.min("rep").alias("g"), F.first("prefix").alias("prefix"), F.count("*").alias("size")), "groups")
    members = written(keyed.select("rep", "key").join(groups.select("key", "g"), "key").select("rep", "g"), "members")
    posts = written(_posts(groups), "posts")
    own = groups.where("size > 1").select("g", F.col("g").alias("h"))
    across = _stars(posts, rule).unionByName(own).join(members.withColumnRenamed("g", "h"), "h")
    first = written(across.select(*_ordered("g", "rep")).where("a <> b").distinct(), "first-pairs")
    told = _overlaps(first, shared, rule, "first-overlaps")
    found = told.where("linked").select("a", "b")
    label = components(found).withColumnRenamed("label", "l")
    # a leader is its group's smallest member, so it is the first of its pairs with the others
    far = told.select(F.col("a").alias("g"), F.col("b").alias("rep"), "d")
    placed = members.join(far, ["g", "rep"], "left").join(label, members["rep"] == label["node"], "left")
    placed = written(placed.select(members["rep"], members["g"], F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("l", members["rep"]).alias("lg")), "placed")
    parts = written(placed.groupBy("g", "lg").agg(F.max("d").alias("r")), "parts")
    inside = parts.select("g", "lg").join(parts.select("g", F.col("lg").alias("lh")), "g").where("lg < lh").select("g", "lg", F.col("g").alias("h"), "lh")
    apart = written(_crossing(groups, posts, parts.select("g", "lg"), rule).unionByName(inside), "apart")
    leaders = _overlaps(apart.where("g <> h").select(*_ordered("g", "h")).distinct(), shared, rule, "leader-overlaps")
    more = leaders.where("linked").select("a", "b")
    if more.limit(1).count():
        found = written(found.unionByName(more), "found")
        new = components(found)
        at = lambda x: new.select(F.col("node").alias(x), F.col("label").alias(f"now_{x}"))
        apart = apart.join(at("lg"), "lg", "left").join(at("lh"), "lh", "left").where(F.coalesce("now_lg", "lg") != F.coalesce("now_lh", "lh")).select("g", "lg", "h", "lh")
    return found.unionByName(_overlaps(_members_apart(apart, parts, placed, leaders, rule).join(first, ["a", "b"], "left_anti"), shared, rule, "last-overlaps").where("linked").select("a", "b"))


def _members_apart(apart: DataFrame, parts: DataFrame, placed: DataFrame, leaders: DataFrame, rule: Rule) -> DataFrame:
    """(a, b) of members of parts that aren't connected, where the triangle inequality leaves room for a link."""
    most = 1 - rule.percent / 100 + 1e-9
    between = leaders.select("a", "b", F.col("d").alias("between"))
    pairs = apart.select("*", *_ordered("g", "h")).join(between, ["a", "b"], "left").drop("a", "b").withColumn("between", F.coalesce("between", F.lit(0.0)))
    radius = lambda g, l, r: parts.select(F.col("g").alias(g), F.col("lg").alias(l), F.col("r").alias(r))
    near = pairs.join(radius("g", "lg", "rg"), ["g", "lg"]).join(radius("h", "lh", "rh"), ["h", "lh"]).where(F.col("between") - F.col("rg") - F.col("rh") <= most)
    member = lambda g, l, x, d: placed.select(F.col("g").alias(g), F.col("lg").alias(l), F.col("rep").alias(x), F.col("d").alias(d))
    both = near.join(member("g", "lg", "x", "dx"), ["g", "lg"]).join(member("h", "lh", "y", "dy"), ["h", "lh"])
    longest = F.greatest("between", "dx", "dy")  # no side of a way is longer than the others together
    return both.where(2 * longest - F.col("between") - F.col("dx") - F.col("dy") <= most).select(*_ordered("x", "y")).distinct()


def _named(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, n, sid) of all documents; (sid, n, c, first) of the sets of components with more than one row."""
    sets, reps, open_ = _candidates(docs, rule)
    label = components(links(docs, open_, rule))
    named = reps.join(label, reps["sid"] == label["node"], "left").where("copies > 1 or label is not null").select("sid", "n", "first", F.coalesce("label", "sid").alias("c"))
    named = written(named, "linked")
    names = named.groupBy("c").agg(F.min("first").alias("first"))
    return sets, written(named.drop("first").join(names, "c").select("sid", "n", "c", "first"), "named")


def classes(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text)."""
    sets, named = _named(docs, rule)
    return sets.join(named, ["sid", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("component_id"))


def one_of_each(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The documents with their columns, of each component one row with the smallest doc_id."""
    sets, named = _named(docs, rule)
    mine, nth = fresh(docs, "row"), fresh(docs, "nth")
    rows = written(sets.join(named, ["sid", "n"]).select("c", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row").alias("r")), "linked-rows")
    best = rows.groupBy("c").agg(F.min("r").alias("best"))
    told = written(rows.join(best, "c").groupBy(F.col("r.row").alias(mine)).agg(F.first(F.expr("r = best")).alias("stays"), F.count("*").alias("copies")), "near-copies")
    gone, twice = told.where("not stays").select(mine), told.where("stays and copies > 1").select(mine)
    marked = docs.withColumn(mine, _row(docs))
    left = marked.join(few(gone), mine, "left_anti")
    if twice.limit(1).count():
        w = Window.partitionBy(mine).orderBy(F.to_json(F.struct(*docs.columns)))
        again = left.join(few(twice), mine, "left_semi").withColumn(nth, F.row_number().over(w)).where(F.col(nth) == 1).drop(nth)
        left = left.join(few(twice), mine, "left_anti").unionByName(again)
    return left.select(*docs.columns)


#: The same rows in DuckDB: all pairs that share a shingle, then what links reach.
OP6_SQL = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) end s from w),
t as (select doc_id, len(s) n, unnest(s) token from s),
links as (select a.doc_id a, b.doc_id b from t a join t b on a.token = b.token and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
least_ as (select a, min(b) m from reach group by a)
select doc_id, len(s)::bigint n_shingles, least(doc_id, coalesce(m, doc_id)) component_id from s left join least_ on a = doc_id"""


def op6_grouped_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), Rule(words=4, percent=85))
