"""Metrics over the event log, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pageweave.functions import text as T
from pageweave.operators.quantiles import exact_percentile

# Stages in order with their timeouts in seconds, and the timeout of any other; attempts after the first; memory retries of a page.
STAGE_TIMEOUTS = {"load": 120, "detect": 120, "lang_detect": 60, "ocr": 300, "sfx": 120, "translate": 180, "preserve_clean": 60, "inpaint": 180, "render": 60, "save_json": 60, "save_png": 60}
STAGES = list(STAGE_TIMEOUTS)
OTHER_TIMEOUT, STAGE_RETRIES, MEMORY_RETRIES = 120, 2, 3


def stage_metrics(events: DataFrame) -> DataFrame:
    """Per stage: outcomes and latency of ended attempts."""
    counted = events.groupBy("stage").agg(F.count_if(F.col("event") == "stage_end").alias("n_ok"), F.count_if(F.col("event") == "stage_error").alias("n_err"))
    late = exact_percentile(events.where("event = 'stage_end'"), ["stage"], "latency_ms", 0.99, "p99_ms")
    return counted.join(late, "stage", "left")


def page_outcomes(events: DataFrame) -> DataFrame:
    """Last final event of each page."""
    final = events.where("event in ('page_done', 'page_failed')")
    return final.groupBy("page_id").agg(F.max_by("event", F.struct("ts", "event_id")).alias("outcome"), F.count("*").alias("n_final"))


def last_events(events: DataFrame, n: int = 30) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def timeout_s(stage: Column) -> Column:
    """Seconds that a stage (its place in the order) may take."""
    return F.coalesce(F.get(F.array(*map(F.lit, STAGE_TIMEOUTS.values())), stage), F.lit(OTHER_TIMEOUT))


def freezes(events: DataFrame) -> DataFrame:
    """Stage starts that no other event of the page follows within the stage's timeout."""
    w = W.partitionBy("page_id").orderBy("ts", "event_id")
    nxt = events.withColumn("next_ts", F.lead("ts").over(w))
    silent = F.unix_micros("next_ts") - F.unix_micros("ts") >= timeout_s(F.col("stage")) * 1_000_000
    return nxt.where((F.col("event") == "stage_start") & F.coalesce(silent, F.lit(True))).select("event_id", "page_id", "stage")


def heartbeats(events: DataFrame) -> DataFrame:
    """Each page's last start of a stage, and the stage."""
    last = F.max(F.struct("ts", "event_id", "stage"))
    return events.where("event = 'stage_start'").groupBy("page_id").agg(last.alias("l")).select("page_id", F.col("l.ts").alias("ts"), "l.stage")


def attempts(events: DataFrame) -> DataFrame:
    """Stage events in order with two budgets: ``attempt`` of an error within its stage's present execution, and ``spent``, whether the page's memory retries were used up.

    A page's run ends with its last event, done or failed; an execution ends when the stage ends, fails for good or another follows. An error is ``fatal`` at the
    last attempt, of whatever kind the errors were, and a memory error of the inpainting stage also when the page has had all memory retries of its run.
    Windows of a page's events do what a walk over them would.
    """
    page = W.partitionBy("page_id").orderBy("ts", "event_id")
    run = F.coalesce(F.sum(F.col("event").isin("page_done", "page_failed").cast("int")).over(page.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = events.withColumn("run", run).where(F.col("event").isin("stage_start", "stage_end", "stage_error"))
    error = F.col("event") == "stage_error"
    memory = error & (F.col("stage") == STAGES.index("inpaint")) & T.is_out_of_memory(F.col("error_type"), F.col("error_msg"))
    within = W.partitionBy("page_id", "run").orderBy("ts", "event_id")
    rows = rows.withColumn("memory", memory)
    rows = rows.withColumn("spent", F.col("memory") & (F.coalesce(F.sum(F.col("memory").cast("int")).over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) >= MEMORY_RETRIES))
    new = (F.lag("stage").over(within) != F.col("stage")) | (F.lag("event").over(within) == "stage_end") | F.lag("spent").over(within)
    rows = rows.withColumn("execution", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(within))
    n = F.sum(error.cast("int")).over(W.partitionBy("page_id", "run", "execution").orderBy("ts", "event_id"))
    rows = rows.withColumn("attempt", F.when(error, (n - 1) % (STAGE_RETRIES + 1) + 1))
    return rows.withColumn("fatal", error & (F.col("spent") | (F.col("attempt") == STAGE_RETRIES + 1)))


def stage_outcomes(events: DataFrame) -> DataFrame:
    """Per page and stage: attempts, errors, executions that failed for good, how it stands after its last event (ok, failed, open), its last error and the last that was
    fatal, retries on its own account and memory retries, and whether it went on on the CPU."""
    error, at = F.col("event") == "stage_error", F.struct("ts", "event_id")
    stands = F.when(F.col("event") == "stage_end", "ok").when(F.col("fatal"), "failed").otherwise("open")
    told = attempts(events).groupBy("page_id", "stage").agg(
        F.count_if(F.col("event") == "stage_start").alias("n_attempts"), F.count_if(error).alias("n_errors"), F.count_if("fatal").alias("n_failed"), F.max_by(stands, at).alias("outcome"),
        F.max_by(failure(F.col("error_type"), F.col("error_msg")), F.when(error, at)).alias("last_error"), F.max_by(failure(F.col("error_type"), F.col("error_msg"), 200), F.when(F.col("fatal"), at)).alias("fatal_error"),
        F.count_if(error & ~F.col("memory") & ~F.col("fatal")).alias("stage_retries"), F.count_if(F.col("memory") & ~F.col("spent")).alias("memory_retries"),
    )
    return told.withColumn("on_cpu", F.col("memory_retries") > 0)


def failure(kind: Column, message: Column, most: int = 300) -> Column:
    """A last error as it is kept: the type and up to ``most`` characters of the message."""
    return F.concat(F.coalesce(kind, F.lit("")), F.lit(": "), F.substring(F.coalesce(message, F.lit("")), 1, most))


def failed_pages(events: DataFrame) -> DataFrame:
    """Pages whose last final event is a failure, with its error and the stages that ended before it."""
    final = events.where("event in ('page_done', 'page_failed')").groupBy("page_id").agg(F.max(F.struct("ts", "event_id", "event", "error_type", "error_msg")).alias("f")).where("f.event = 'page_failed'")
    ended = events.where("event = 'stage_end'").select("page_id", "ts", "event_id", "stage")
    before = F.struct("ts", "event_id") < F.struct("f.ts", "f.event_id")
    stages = F.array_sort(F.collect_set(F.when(before, F.col("stage"))))
    return final.join(ended, "page_id", "left").groupBy("page_id", failure(F.col("f.error_type"), F.col("f.error_msg")).alias("last_error")).agg(stages.alias("completed"))


def counters(events: DataFrame) -> DataFrame:
    """name and n: outcomes of stages, memory errors, freezes, and pages done, failed and skipped."""
    stage = F.get(F.array(*map(F.lit, STAGES)), F.col("stage"))
    memory = (F.col("event") == "stage_error") & T.is_out_of_memory(F.col("error_type"), F.col("error_msg"))
    names = F.array(
        F.when(F.col("event") == "stage_end", F.concat(F.lit("stage_"), stage, F.lit("_ok"))), F.when(F.col("event") == "stage_error", F.concat(F.lit("stage_"), stage, F.lit("_err"))),
        F.when(memory, F.lit("oom_events")), F.when(F.col("event") == "page_done", F.lit("pages_done")), F.when(F.col("event") == "page_failed", F.lit("pages_failed")),
        F.when(F.col("event") == "page_skip_resume", F.lit("pages_skipped")), F.when(F.col("event") == "stage_freeze", F.lit("watchdog_freezes")),
    )
    return events.select(F.explode(names).alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("n"))


def batch_summary(outcomes: DataFrame) -> DataFrame:
    """Pages of a batch, how many went well, and whether all did."""
    ok = F.count_if(F.col("outcome") == "page_done")
    return outcomes.agg(ok.alias("n_ok"), F.count("*").alias("n_pages"), (ok == F.count("*")).alias("all_ok"))


def request_stats(attempts: DataFrame, looked_up: DataFrame) -> DataFrame:
    """Statistics of a translator: requests after the cache, rejections for their rate, retries and lost requests of attempts (request,
    attempt from 0, error or null), hits and misses of texts looked up."""
    lost = F.max_by(F.col("error").isNotNull(), "attempt")
    by = attempts.groupBy("request").agg(F.count("*").alias("n"), F.count_if(T.is_rate_limit(F.col("error"))).alias("limited"), lost.alias("lost"))
    calls = by.agg(F.count("*").alias("calls"), F.sum("limited").alias("rate_limit_hits"), F.sum(F.col("n") - 1).alias("retries"), F.count_if("lost").alias("failures"))
    cache = looked_up.agg(F.count_if("hit").alias("cache_hits"), F.count_if(~F.col("hit")).alias("cache_misses"))
    return calls.crossJoin(cache)  # a row each


def stamp(ts: Column) -> Column:
    """A time as logs and checkpoints write it, in UTC where the session is."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def latency_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two times, cut off."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000)


def health(events: DataFrame, width: str = "30 seconds") -> DataFrame:
    """Events by kind in tumbling windows; the same expression serves batch and streams."""
    return events.groupBy(F.window("ts", width).alias("w"), "event").agg(F.count("*").alias("n"))


def backoff(attempt: Column, first: float = 2.0, most: float = 60.0) -> Column:
    return F.least(F.lit(most), first * F.pow(F.lit(2.0), attempt))


def slower(rpm: Column) -> Column:
    return F.greatest(F.lit(5), F.floor(rpm / 2))


def faster(rpm: Column, quiet_s: Column, original: Column) -> Column:
    """Rate after a time without rejections: one more a minute beyond the first, up to the original."""
    more = F.floor((quiet_s - 60) / 60).cast("bigint") + 1
    return F.when((quiet_s >= 60) & (rpm < original), F.least(original, rpm + more)).otherwise(rpm)


def health_line(events: DataFrame, uptime_s: int = 0, n: int = 8) -> DataFrame:
    """One line of the first n counters and the first n gauges by name; a part without any is left out."""

    def first(rows: DataFrame, value: Column, name: str) -> DataFrame:
        some = rows.select("name", value.alias("v")).orderBy("name").limit(n)
        pairs = F.transform(F.sort_array(F.collect_list(F.struct("name", "v"))), lambda p: F.concat(p["name"], F.lit("="), p["v"]))
        return some.agg(F.when(F.count("*") > 0, F.concat(F.lit(f" {name}="), F.array_join(pairs, ","))).alias(name))

    stage = F.get(F.array(*map(F.lit, STAGES)), F.col("stage"))
    named = gauges(events).select(F.concat(F.lit("latency_"), stage).alias("name"), F.format_string("%.2f", F.round("value", 2)).alias("value")).where("name is not null and value is not null")
    both = first(counters(events), F.col("n").cast("string"), "counters").crossJoin(first(named, F.col("value"), "gauges"))  # a row each
    return both.select(F.concat(F.lit(f"[health uptime={uptime_s}s]"), F.coalesce("counters", F.lit("")), F.coalesce("gauges", F.lit(""))).alias("line"))


def gauges(events: DataFrame) -> DataFrame:
    """Last value of each stage's gauge."""
    return events.groupBy("stage").agg(F.max_by("latency_ms", F.struct("ts", "event_id")).alias("value"))


def lines(events: DataFrame) -> DataFrame:
    """Events as JSON lines; null fields are left out."""
    return events.select("event_id", F.to_json(F.struct("event_id", "page_id", "event", F.when(F.col("event").startswith("stage"), F.col("stage")).alias("stage"))).alias("line"))


def bucket_waits(requests: DataFrame, key: str, rpm: int = 20, capacity: int = 20) -> DataFrame:
    """Microseconds each request (key, ts, event_id) waits for a token, first come first served, from a full bucket.

    The time at which the bucket is full again is a running maximum, so a window does what a loop over requests would.
    """
    step = 60_000_000 // rpm
    w = W.partitionBy(key).orderBy("ts", "event_id")
    at, n = F.unix_micros("ts"), F.row_number().over(w)
    rows = requests.withColumn("at", at).withColumn("n", n).withColumn("full", F.max(F.col("at") - (F.col("n") - 1) * step).over(w.rowsBetween(W.unboundedPreceding, 0)) + F.col("n") * step)
    wait = F.lag("full").over(w) - (capacity - 1) * step - F.col("at")
    return rows.withColumn("wait_us", F.greatest(F.coalesce(wait, F.lit(0)), F.lit(0))).drop("at", "n", "full")
