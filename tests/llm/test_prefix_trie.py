"""The trie by fingerprints against a trie of the rebuilt turns themselves."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from pageweave.llm import prefix_trie, registry
from pageweave.llm.prefix_trie import Monoid
from tests.oracle import same

SCHEMA = "conv_id long, turn long, role string, text string, depth int, own string"
RND = random.Random(3)


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = abs(c) - abs(c) % 20
        rebuilt[c] = tuple(own.get(base if c >= 0 else -base, [])[:h] + t[h:])
    members = defaultdict(list)
    for c, t in sorted(rebuilt.items()):
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children, total = defaultdict(list), {}
    for k in members:
        if k:
            children[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        below = [total[x] for x in children[k]]
        saved = (len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        total[k] = (sum(x[0] for x in below) or 1, saved + sum(x[1] for x in below))
    ends = lambda k: ",".join(str(c) for c in members[k] if len(rebuilt[c]) == len(k))
    return sorted((members[k][0], len(k), members[k[:-1]][0] if k else -1, len(members[k]), len(children[k]), *total[k], hashlib.sha256(ends(k).encode()).hexdigest()) for k in members)


def got(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def talk(c, texts, start=0):
    return [(c, start + i, "user" if i % 2 == 0 else "assistant", t, 1, "x") for i, t in enumerate(texts)]


def conversations():
    rows, few = [], ["yes", "no", "a b c", "", "yes no"]
    for c in range(170):
        rows += talk(c, [RND.choice(few) for _ in range(RND.randrange(7))])
    for c in range(200, 230):  # copies, and each a turn longer than the one before
        rows += talk(c, ["first"] * 3 + [f"t{i}" for i in range(c - 199)])
    rows += talk(300, [f"long {i % 3}" for i in range(2500)]) + talk(301, [f"long {i % 3}" for i in range(2500)])
    rows += [(400, None, None, None, 1, "x"), (400, None, None, "b", 1, "x"), (400, 1, "user", None, 1, "x"), (400, 1, "user", None, 1, "x"), (None, 1, "user", "lost", 1, "x")]
    rows += talk(-7, ["below", "zero"]) + talk(-40, ["below", "zero", "x"]) + talk(10**12 + 3, ["far"])
    return rows


@pytest.fixture(scope="module")
def rows():
    return conversations()


def test_trie(spark, rows):
    want = brute(rows)
    assert got(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == want
    assert max(x[1] for x in want) > 2 * prefix_trie.SPAN and any(x[3] > 20 for x in want if x[1] > 2)
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "x", 1, "x")], SCHEMA)).count() == 0  # nothing is left of it


def test_collisions_are_found(spark, rows):
    some = [r for r in rows if r[0] is not None and 200 <= r[0] < 230 or r[0] in (400, 3, 5)]
    docs = spark.createDataFrame(some, SCHEMA)
    # modulo 5 and 101 different prefixes meet; the last monoid tells them apart
    assert got(prefix_trie.trie(docs, monoids=[Monoid(0, 5), Monoid(0, 101), Monoid(9)])) == brute(some)
    with pytest.raises(ValueError):
        prefix_trie.trie(docs.where("conv_id < 205"), monoids=[Monoid(0, 5)])


def test_equal_hashes_of_unlike_turns_are_found(spark):
    same_hash = [(1, 0, "user", "a"), (2, 0, "user", "b")]
    turns = spark.createDataFrame([(1, *x[2:], "x") for x in same_hash], "own long, role string, text string, more string")
    node = (1, 1, 1, 2, 0, 0, 1, 1, 1, 2, 1, 1)
    names = "depth long, mark long, conv_id long, n_convs long, lo_parent long, hi_parent long, lo_own long, hi_own long, lo_ref_conv long, hi_ref_conv long, lo_ref_place long, hi_ref_place long"
    nodes = spark.createDataFrame([node], names)
    assert not prefix_trie.verified(turns, nodes)
    assert prefix_trie.verified(turns.where("text = 'a'"), nodes)


def test_products_of_ranges(spark, rows):
    """One conversation in many ranges has the fingerprints that it has in one."""
    long = spark.createDataFrame([r for r in rows if r[0] in (300, 301)], SCHEMA).repartition(7)
    marks = {}
    for n in (1, 13):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            turns = prefix_trie.store(long, Monoid())
            marks[n] = {(r.conv_id, r.depth): r.mark for r in prefix_trie.prefixes(turns, Monoid(), prefix_trie.Rebuild()).collect()}
            assert (turns.select("part").distinct().count() > 4) == (n > 1)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert marks[1] == marks[13] and len(marks[1]) == 5002


def test_against_sql(spark):
    same(spark, registry.queries()["op11_prefix_trie"], registry.oracle_sql()["op11_prefix_trie"])
