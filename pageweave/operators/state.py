"""Caches, checkpoints and glossaries as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pageweave.functions import text as T

# Words that begin with a capital in sentences and are no names.
COMMON_WORDS = """
    Nothing Beats Drinking Alcohol With Cute Girls Yes No And But The You What Who Why How When Where This That These Those Hey Oh Ah Eh Huh Wow Well
    Nevermind Okay Really Truly Still Also Suppose Mean Just Very Much More Some Any All Each Both Either Neither One Two Three First Last Next Then
    Now Here There Today Tomorrow Yesterday Phew See Look Come Let Have Has Had Make Made Try Tried Take Took Give Gave Get Got Want Need Believe Know
    Knew Think Thought Feel Felt Say Said Tell Told Ask Asked Talk Talked Show Showed Shown Find Found Use Used Work Worked Live Lived Love Loved Like
    Liked Hate Hated Help Helped Listen Listened Hear Heard Watch Watched Read Write Wrote Eat Ate Drink Drank Sleep Slept Wake Woke Stand Stood Sit
    Sat Walk Walked Run Ran Stop Stopped Start Started End Ended Open Opened Close Closed Turn Turned Move Moved Bring Brought Send Sent Sell Sold Buy
    Bought Pay Paid Spend Spent Win Won Lose Lost Play Played Sing Sang Sung Dance Danced Cook Cooked Wait Waited Stay Stayed Leave Left Enter Entered
    Sound Sounds Good Bad Great Big Small Long Short Tall High Low Old New Young Beautiful Ugly Easy Hard Fast Slow Hot Cold Warm Cool Tender Super
    Impressive Talent Create Song Sticks Lot Right Wrong Same Different Important Together Alone Maybe Perhaps Probably Definitely Absolutely Forward
    Backward Around Through Across Above Below Under Over Between During Before After While Since Until Because Although Though Unless Whether Either
    Otherwise However Therefore Indeed Anyway Forever Never Always Sometimes Often Usually Rarely Seldom Almost Quite Rather Pretty Fairly Hardly
    Barely Nearly Approximately Exactly Completely Totally Entirely
""".split()


def evict_oldest(cache: DataFrame, most: int, share: float = 0.95) -> DataFrame:
    """If a cache has over ``most`` entries, the newest ``share`` of ``most`` stay.

    Counts by time find the time at which the cut falls, through a hundred ranges of equal size first; only the entries of that one time are ranked.
    Entries without a time go first.
    """
    if cache.limit(most + 1).count() <= most:
        return cache
    stay, cache = int(most * share), cache.where("ts is not null")
    if stay == 0 or cache.limit(stay + 1).count() <= stay:
        return cache.limit(stay)
    bounds = sorted(set(cache.agg(F.percentile_approx("ts", [i / 100 for i in range(101)], 1000)).first()[0]))
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b > F.col("ts")))  # 0: the newest

    def cut(counts: list[tuple], left: int) -> tuple:
        for at, n in counts:
            if n >= left:
                return at, left
            left -= n

    part, left = cut([tuple(r) for r in cache.groupBy(place.alias("p")).agg(F.count("*")).orderBy("p").collect()], stay)  # at most 102 rows
    inside = cache.where(place == part)
    older = W.orderBy(F.desc("ts")).rowsBetween(W.unboundedPreceding, -1)
    times = inside.groupBy("ts").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(older), F.lit(0)))  # one range's times
    at, before = times.where(F.col("before") < left).agg(F.max(F.struct("before", "ts")).alias("m")).select("m.ts", "m.before").first()
    newest = F.row_number().over(W.orderBy(F.desc("key")))
    return cache.where(F.col("ts") > at).unionByName(cache.where(F.col("ts") == at).withColumn("r", newest).where(F.col("r") <= left - before).drop("r"))


def lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with the cached translation and whether it was found."""
    return requests.join(cache.select("key", "translation"), "key", "left").withColumn("hit", F.col("translation").isNotNull())


#: What a checkpoint holds of a page, with what a new task has.
TASK = {
    "page_id": None, "input_path": None, "output_path": None, "state": "'PENDING'", "current_stage": "cast(null as string)", "completed_stages": "cast(array() as array<string>)", "retries": "0", "stage_retries": "cast(map() as map<string,int>)",
    "oom_retries": "0", "fallback_flags": "cast(array() as array<string>)", "last_error": "cast(null as string)", "started_ts": "cast(null as string)", "completed_ts": "cast(null as string)",
}


def new_tasks(pages: DataFrame) -> DataFrame:
    """Tasks of pages (page_id, input_path, output_path) that nothing is known of."""
    return pages.select(*[F.expr(new).alias(c) if new else F.col(c) for c, new in TASK.items()])


def to_run(tasks: DataFrame, previous: DataFrame, outputs: DataFrame) -> DataFrame:
    """Tasks but those whose page is done and whose output, by its former path or else the task's, is among ``outputs`` (path)."""
    done = previous.where("state = 'DONE'").select("page_id", F.nullif("output_path", F.lit("")).alias("former"))
    path = F.coalesce("former", F.nullif(F.col("output_path"), F.lit("")))
    there = tasks.select("page_id", "output_path").join(done, "page_id").select("page_id", path.alias("path")).join(outputs.select("path").distinct(), "path").select("page_id")
    return tasks.join(there, "page_id", "left_anti")


def restore(tasks: DataFrame, previous: DataFrame, reset_partial: bool = True) -> DataFrame:
    """Tasks with what a checkpoint knows of their pages.

    Done pages stay done, with their stages, time and retries; others start again but keep retries and the last error, or are left as they are
    without ``reset_partial``.
    """
    p = previous.select("page_id", *[F.col(c).alias(f"p_{c}") for c in ("state", "completed_stages", "completed_ts", "retries", "last_error")])
    done, back = F.col("p_state") == "DONE", F.col("p_state").isNotNull() & reset_partial
    new = {
        "state": F.when(done, "DONE").when(back, "PENDING"), "completed_stages": F.when(done, F.coalesce("p_completed_stages", F.array().cast("array<string>"))).when(back, F.array().cast("array<string>")),
        "completed_ts": F.when(done, F.col("p_completed_ts")), "retries": F.when(done | back, F.coalesce("p_retries", F.lit(0))),
    }
    out = tasks.join(p, "page_id", "left")
    kept = {c: F.coalesce(new[c], F.col(c)) if c in new else F.col(c) for c in TASK}
    kept["current_stage"] = F.when(~F.coalesce(back & ~done, F.lit(False)), F.col("current_stage"))
    kept["last_error"] = F.when(F.coalesce(back & ~done, F.lit(False)), F.col("p_last_error")).otherwise(F.col("last_error"))
    return out.select(*[x.alias(c) for c, x in kept.items()])


def upsert(previous: DataFrame, tasks: DataFrame) -> DataFrame:
    """A checkpoint's pages after ``tasks``: theirs replaced or added, all others as they were."""
    return previous.select(*TASK).join(tasks.select("page_id"), "page_id", "left_anti").select(*TASK).unionByName(tasks.select(*TASK))


def glossary_entries(pairs: DataFrame, common: list[str] = COMMON_WORDS) -> DataFrame:
    """Names of source texts with what their translation has for them, the name or its capitalised form; common words, in whatever case, are none. Columns but src and tgt stay."""
    rest = [c for c in pairs.columns if c not in ("src", "tgt")]
    found = pairs.where("src <> '' and tgt <> ''").select(*rest, "tgt", F.explode(F.array_distinct(T.names(F.col("src")))).alias("term"))
    found = found.where(~F.lower("term").isin([w.lower() for w in common]))
    cap = F.concat(F.upper(F.substring("term", 1, 1)), F.lower(F.expr("substring(term, 2)")))
    hit = F.when(F.contains("tgt", F.col("term")), F.col("term")).when(F.contains("tgt", cap), cap)
    return found.withColumn("dst", hit).where("dst is not null").drop("tgt")


def glossary(pairs: DataFrame) -> DataFrame:
    """term and dst of pairs (ord, src, tgt); the last pair wins."""
    return glossary_entries(pairs).groupBy("term").agg(F.max_by("dst", "ord").alias("dst"))


def glossary_block(glossary: DataFrame) -> DataFrame:
    """The lines of each page's prompt for its glossary (page_id, term, dst), sorted by term; terms without dst have none."""
    rows = F.sort_array(F.collect_list(F.struct("term", "dst")))
    lines = F.transform(rows, lambda r: F.concat(F.lit("  - "), r["term"], F.lit(" → "), r["dst"]))
    return glossary.where("dst is not null").groupBy("page_id").agg(F.array_join(lines, "\n").alias("block"))


#: Pages of a term that are looked through in one portion.
SPAN = 1024


def glossary_intervals(entries: DataFrame) -> DataFrame:
    """term, dst, after_page, until_page: the pages n with after_page < n <= until_page see dst; until_page is null while nothing else was written.

    ``entries``: page_id, term, dst, one a page and term. Pages that write what is known already don't part an interval.
    """
    w = W.partitionBy("term").orderBy("page_id")
    changed = entries.withColumn("new", ~F.lag("dst").over(w).eqNullSafe(F.col("dst"))).where("new")
    return changed.select("term", "dst", F.col("page_id").alias("after_page"), F.lead("page_id").over(w).alias("until_page"))


def glossary_as_of(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (page_id, term) with the dst that pages before had written last (``entries``: page_id, term, dst), else null.

    Both sides pass one window in order of pages, so each row is met once however often its term is written. A term's pages are parted into portions;
    what earlier portions wrote last, one row a portion, is carried over, so a term of a third of all rows has as many tasks as portions.
    """
    both = wanted.select("page_id", "term", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("dst")).unionByName(entries.select("page_id", "term", F.lit(1).alias("kind"), "dst"))
    both = both.withColumn("portion", F.floor(F.col("page_id") / SPAN))
    carried = W.partitionBy("term").orderBy("portion").rowsBetween(W.unboundedPreceding, -1)
    last = both.groupBy("term", "portion").agg(F.max_by("dst", F.when(F.col("kind") == 1, F.col("page_id"))).alias("last")).withColumn("before", F.last("last", ignorenulls=True).over(carried))
    # a page's own entries come after what it asks for
    within = W.partitionBy("term", "portion").orderBy("page_id", "kind").rowsBetween(W.unboundedPreceding, -1)
    own = both.withColumn("own", F.last("dst", ignorenulls=True).over(within)).where("kind = 0")
    return own.join(last.where("before is not null").select("term", "portion", "before"), ["term", "portion"], "left").select("page_id", "term", F.coalesce("own", "before").alias("dst"))


def page_entries(pairs: DataFrame) -> DataFrame:
    """page_id, term, dst of pairs (page_id, ord, src, tgt); the last pair of a page wins."""
    return glossary_entries(pairs.select("page_id", "ord", "src", "tgt")).groupBy("page_id", "term").agg(F.max_by("dst", "ord").alias("dst"))


def mentions(pairs: DataFrame) -> DataFrame:
    """name, page_id, name_target, side of pairs (page_id, ord, position_tag, src, tgt); the side is that of the page's first tag, or null."""
    first_tag = pairs.groupBy("page_id").agg(F.min_by("position_tag", "ord").alias("tag"))
    side = F.when(F.contains("tag", F.lit("left")), "left").when(F.contains("tag", F.lit("right")), "right")
    return page_entries(pairs).join(first_tag, "page_id").select(F.col("term").alias("name"), "page_id", F.col("dst").alias("name_target"), side.alias("side"))


def character_memory(pairs: DataFrame) -> DataFrame:
    """name, name_target, first_seen_page, occurrences, side_hint of pairs (page_id, ord, position_tag, src, tgt).

    A page counts a name once, with its last translation there; the target is that of the name's first page. The side is that of the page's
    first tag, from the first page that tells one.
    """
    return mentions(pairs).groupBy("name").agg(
        F.min_by("name_target", "page_id").alias("name_target"), F.min("page_id").alias("first_seen_page"), F.count("*").alias("occurrences"),
        F.coalesce(F.min_by("side", F.when(F.col("side").isNotNull(), F.col("page_id"))), F.lit("unknown")).alias("side_hint"),
    )


def best_attempt(attempts: DataFrame, key: str, accept: float = 0.55, ties: tuple[str, ...] = ()) -> DataFrame:
    """The first attempt that has text and is good enough, else the most confident, the first on a tie; ``ties`` order equal attempts."""
    good = (F.col("confidence") >= accept) & (F.coalesce("text", F.lit("")) != "")
    w = W.partitionBy(key).orderBy(F.desc(good), F.when(good, F.lit(0.0)).otherwise(-F.col("confidence")), "attempt", *ties)
    return attempts.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def memory_as_of(mentions: DataFrame) -> DataFrame:
    """What was known of a name after each page that holds it (name, page_id, name_target, side): the first page and its target, pages so far, and the first side told."""
    w = W.partitionBy("name").orderBy("page_id")
    pages = mentions.groupBy("name", "page_id").agg(F.min("name_target").alias("target"), F.min("side").alias("side"))
    return pages.select(
        "name", "page_id", F.first("page_id").over(w).alias("first_seen_page"), F.row_number().over(w).alias("occurrences"), F.first("target").over(w).alias("name_target"),
        F.coalesce(F.first("side", ignorenulls=True).over(w), F.lit("unknown")).alias("side_hint"),
    )


def current(previous: DataFrame, digest: str, forced: bool = False) -> DataFrame:
    """What a checkpoint knows, if its configuration is the present one or it is forced; else nothing."""
    return previous if forced else previous.where(F.col("config_digest") == digest)


def cache_stats(looked_up: DataFrame) -> DataFrame:
    """Hits and misses of looked-up requests, and distinct keys that a run then puts."""
    missed = F.when(~F.col("hit"), F.col("key"))
    return looked_up.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count_distinct(missed).alias("puts"))
