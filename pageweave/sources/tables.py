"""Tables of the page model: from the files of a folder, and derived from the general tables with whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PAGE_W, PAGE_H = 900, 1300
IMAGE_FILES = r"(?i)\.(jpg|jpeg|png|webp|bmp)$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_images(spark: SparkSession, folder: str | list[str], pattern: str | None = None, by_name: bool = False) -> DataFrame:
    """path and length of the image files below a folder, or some folders or globs, in order of path or of the file's name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (found.option("pathGlobFilter", pattern) if pattern else found).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return found.where(F.regexp_like("path", F.lit(IMAGE_FILES))).select("path", "length").distinct().orderBy(*([name] if by_name else []), "path")


def _entries(spark: SparkSession, path: str, field: str, value: str) -> DataFrame:
    """key and the value's fields of a map in JSON files; files that are broken or lack it have no rows."""
    rows = spark.read.schema(f"{field} map<string, {value}>").option("multiLine", "true").json(path)
    return rows.select(F.explode(field).alias("key", "e"))


def _write_map(rows: DataFrame, path: str, key: str, value: Column, around: dict[str, Column] | None = None, files: int = 1, order: Column | None = None) -> None:
    """JSON objects of all rows by key. One file holds one object: one document by default, more where a task can't hold them all; readers take a folder.

    Of rows with the same key the last by ``order`` stays, or without one that with the greatest text.
    """
    told = rows.select(F.col(key).cast("string").alias("k"), value.alias("v"), (F.to_json(F.struct(value.alias("v"))) if order is None else order).alias("o")).where("k is not null")
    one = told.groupBy("k").agg(F.max_by("v", F.coalesce(F.col("o").cast("string"), F.lit(""))).alias("v") if order is None else F.max_by("v", F.struct("o", F.to_json(F.struct("v")))).alias("v"))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))) if "map<" not in dict(one.dtypes)["v"] else F.map_from_entries(F.collect_list(F.struct("k", "v")))
    parts = one.groupBy(F.pmod(F.xxhash64("k"), F.lit(files)).alias("file"))
    if rows.isEmpty():  # still one document, of nothing
        parts = one.groupBy()
    if around is None:
        out, kind = parts.agg(F.to_json(entries).alias("value")), "text"
    else:
        out, kind = parts.agg(*[c.alias(n) for n, c in around.items() if n != "of"], entries.alias(around["of"])), "json"
    if "file" in out.columns and files > 1:
        out.repartition("file").write.partitionBy("file").format(kind).save(path)
    else:
        out.drop("file").coalesce(1).write.format(kind).save(path)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """term and dst of JSON objects."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, string>").alias("m"))
    return whole.select(F.explode("m").alias("term", "dst"))


def write_glossary(glossary: DataFrame, path: str, files: int = 1) -> None:
    _write_map(glossary, path, "term", F.col("dst"), files=files)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Character memory of JSON objects by name; absent fields take the name, page 0, one occurrence and an unknown side."""
    fields = "struct<name_src:string, name_target:string, first_seen_page:bigint, occurrences:bigint, side_hint:string>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string, {fields}>")).alias("key", "e")).where("e is not null")
    default = lambda f, x: F.coalesce(f"e.{f}", x).alias(f)
    return whole.select(default("name_src", F.col("key")), default("name_target", F.col("key")), default("first_seen_page", F.lit(0)), default("occurrences", F.lit(1)), default("side_hint", F.lit("unknown")))


def write_names(memory: DataFrame, path: str, files: int = 1) -> None:
    _write_map(memory, path, "name_src", F.struct("name_src", "name_target", "first_seen_page", "occurrences", "side_hint"), files=files, order=F.col("occurrences"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Translation cache files; entries without a translation are left out."""
    return _entries(spark, path, "entries", "struct<translation:string, model:string, target_lang:string, text_preview:string, ts:double>").where("e.translation is not null").select("key", "e.*")


def write_cache(cache: DataFrame, path: str, ts: Column, files: int = 1) -> None:
    value = F.struct("translation", "model", "target_lang", F.substring("text_preview", 1, 80).alias("text_preview"), "ts")
    _write_map(cache, path, "key", value, {"version": F.lit(1), "ts": ts, "of": "entries"}, files, F.col("ts"))


def read_ocr_cache(spark: SparkSession, path: str) -> DataFrame:
    """Recognition cache files; entries without a result are left out. The result stays JSON text."""
    return _entries(spark, path, "entries", "struct<result:string, ts:double>").where("e.result is not null").select("key", "e.*")


def write_ocr_cache(cache: DataFrame, path: str, ts: Column, files: int = 1) -> None:
    _write_map(cache, path, "key", F.struct("result", "ts"), {"version": F.lit(1), "ts": ts, "of": "entries"}, files, F.col("ts"))


def write_checkpoint(tasks: DataFrame, path: str, config_digest: str, ts: Column, files: int = 1) -> None:
    """A checkpoint of version 1 of tasks with all their fields; flags in order."""
    value = F.struct(*[F.sort_array(c).alias(c) if c == "fallback_flags" else F.col(c) for c in TASK_FIELDS])
    _write_map(tasks, path, "page_id", value, {"version": F.lit(1), "config_digest": F.lit(config_digest), "ts": ts, "of": "pages"}, files, F.coalesce("completed_ts", "started_ts", F.lit("")))


TASK_FIELDS = {
    "page_id": "string", "input_path": "string", "output_path": "string", "state": "string", "current_stage": "string", "completed_stages": "array<string>", "retries": "int", "stage_retries": "map<string,int>", "oom_retries": "int",
    "fallback_flags": "array<string>", "last_error": "string", "started_ts": "string", "completed_ts": "string",
}


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """config_digest and all task fields of checkpoint files of version 1; absent ones are empty. Other files and broken entries are left out."""
    fields = ",".join(f"{c}:{t}" for c, t in TASK_FIELDS.items())
    rows = spark.read.schema(f"version int, config_digest string, pages map<string, struct<{fields}>>").option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    told = rows.where("version = 1").select("config_digest", F.explode("pages").alias("key", "t")).where("t.state is not null").select("config_digest", "t.*")
    empty = {"array<string>": "cast(array() as array<string>)", "map<string,int>": "cast(map() as map<string,int>)", "int": "0"}
    return told.select("config_digest", *[F.coalesce(c, F.expr(empty[t])).alias(c) if t in empty else F.col(c) for c, t in TASK_FIELDS.items()])


def write_records(records: DataFrame, path: str) -> None:
    """One JSON array of records a page; null fields are left out."""
    fields = F.struct(*[c for c in records.columns if c != "page_id"])
    records.groupBy("page_id").agg(F.to_json(F.sort_array(F.collect_list(fields))).alias("records")).write.json(path)


def append_events(events: DataFrame, path: str) -> None:
    """JSON lines by day; null fields are left out."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id div 8 as page_id", "cast(doc_id % 8 as int) block_idx", "cast((doc_id*37)%700 as int) x1", "cast((doc_id*53)%1000 as int) y1",
        "cast((doc_id*37)%700 + 40 + (doc_id*17)%160 as int) x2", "cast((doc_id*53)%1000 + 30 + (doc_id*29)%270 as int) y2", "cast(if(doc_id % 5 = 0, 1, 0) as int) cls", "text", "doc_id",
    )


def dense_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "(doc_id*37)%240 x", "(doc_id*53)%360 y")
    return rows.selectExpr("doc_id div 20 as page_id", "cast(doc_id % 20 as int) block_idx", "cast(x as int) x1", "cast(y as int) y1", "cast(x + 40 + (doc_id*17)%160 as int) x2", "cast(y + 30 + (doc_id*29)%270 as int) y2")


def ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).selectExpr("page_id", "block_idx", "x1", "y1", "x2", "y2", "cls", "(doc_id % 100) / 100.0D as ocr_conf", "text", "coalesce(length(text), 0) = 0 as ocr_failed", "doc_id")


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr(spark, sf_dir).selectExpr("page_id", "block_idx", "case doc_id % 7 when 0 then '' when 1 then '...' when 2 then '…' when 3 then '???' else upper(text) end as translated")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "cast(ts as timestamp) ts", "user_id as page_id", "case event_type when 'view' then 'stage_start' when 'click' then 'stage_end' when 'error' then 'stage_error' when 'purchase' then if(event_id % 9 = 0, 'page_skip_resume', 'page_done') else if(event_id % 7 = 0, 'stage_freeze', 'page_failed') end as event",
        "cast(event_id % 11 as int) stage", "value as latency_ms", "case when event_type in ('error', 'signup') then if(event_id % 3 = 0, 'OutOfMemoryError', 'ValueError') end as error_type",
        "case when event_type in ('error', 'signup') then concat('step ', event_id, if(event_id % 5 = 0, ': out of memory', '')) end as error_msg",
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognition attempts: lines of an order as the attempts of a block, best first by no rule."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as block_id", "cast(l_linenumber as int) attempt", "l_quantity / 50.0D as confidence", "if(l_partkey % 4 = 0, '', concat('part ', l_partkey)) as text", "l_partkey", "l_suppkey", "l_extendedprice")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask pixels of a page: lines of orders as points, some of them twice."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as page_id", "cast(l_orderkey % 64 as int) y", "cast(l_partkey % 24 as int) x")


def readings(spark: SparkSession, sf_dir: str, codes: list[str]) -> DataFrame:
    """Every turn of a conversation as a crop that each candidate language has read."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.posexplode(F.array(*map(F.lit, codes))).alias("ord", "code"))
    return rows.selectExpr("conv_id as page_id", "turn as crop_no", "code", "(conv_id * 7 + turn * 13 + ord * 29) % 100 / 100.0D as conf", "text")


def corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polygon a page: the lines of an order as its corners."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("ord", F.row_number().over(order))
    return rows.selectExpr("l_orderkey as page_id", "ord", "cast(l_partkey % 200 as double) x", "cast(l_suppkey * 7 % 100 as double) y")
