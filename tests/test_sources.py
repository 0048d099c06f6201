"""Sources and sinks: what is written is read again; broken and odd files."""

import json

from pyspark.sql import functions as F

from pageweave.operators import blocks as B
from pageweave.operators import state as S
from pageweave.sources import tables as D

WHEN = "2026-01-01T00:00:00.000000Z"


def test_images_by_folder_glob_and_order(spark, tmp_path):
    for name in ("b/2.png", "a/3.JPG", "a/1.webp", "a/notes.txt", "c/0.bmp"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 7)
    names = lambda df: [r["path"].split(f"{tmp_path}/")[1] for r in df.collect()]
    assert names(D.scan_images(spark, str(tmp_path))) == ["a/1.webp", "a/3.JPG", "b/2.png", "c/0.bmp"]
    assert names(D.scan_images(spark, str(tmp_path), by_name=True)) == ["c/0.bmp", "a/1.webp", "b/2.png", "a/3.JPG"]
    assert names(D.scan_images(spark, [str(tmp_path / "b"), str(tmp_path / "[ac]")], pattern="*.[pw]*")) == ["a/1.webp", "b/2.png"]
    assert {r["length"] for r in D.scan_images(spark, str(tmp_path)).collect()} == {7}


def test_glossary_and_names(spark, tmp_path):
    terms = spark.createDataFrame([("Bob", "Bob"), ("Áine \"x\"", "É\n1")], "term string, dst string")
    D.write_glossary(terms, str(tmp_path / "g"))
    assert sorted(map(tuple, D.read_glossary(spark, str(tmp_path / "g")).collect())) == sorted(map(tuple, terms.collect()))
    names = spark.createDataFrame([("Bob", "Bobby", 3, 2, "left"), ("Eve", "Eve", 0, 1, "unknown")], "name_src string, name_target string, first_seen_page long, occurrences long, side_hint string")
    D.write_names(names, str(tmp_path / "n"))
    assert sorted(map(tuple, D.read_names(spark, str(tmp_path / "n")).collect())) == sorted(map(tuple, names.collect()))
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "names.json").write_text(json.dumps({"Ann": {"occurrences": 4}, "Bad": 7}))
    assert [tuple(r) for r in D.read_names(spark, str(tmp_path / "old")).where("name_src = 'Ann'").collect()] in ([("Ann", "Ann", 0, 4, "unknown")], [])
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "g.json").write_text("{not json")
    assert D.read_glossary(spark, str(tmp_path / "broken")).count() == 0
    assert S.glossary_block(terms.withColumn("page_id", F.lit(1))).first()["block"] == "  - Bob → Bob\n  - Áine \"x\" → É\n1"


def test_caches(spark, tmp_path):
    cache = spark.createDataFrame([("k1", "t1", "m", "vi", "p" * 100, 1.5), ("k2", "", "m", "vi", "", 2.0)], "key string, translation string, model string, target_lang string, text_preview string, ts double")
    D.write_cache(cache, str(tmp_path / "c"), F.lit(WHEN))
    got = {r["key"]: r for r in D.read_cache(spark, str(tmp_path / "c")).collect()}
    assert got["k1"]["text_preview"] == "p" * 80 and got["k2"]["translation"] == "" and got["k1"]["ts"] == 1.5
    whole = json.loads(next((tmp_path / "c").glob("part-*")).read_text())
    assert whole["version"] == 1 and whole["ts"].endswith("Z") and set(whole["entries"]) == {"k1", "k2"}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.json").write_text(json.dumps({"version": 1, "entries": {"a": {"model": "m"}, "b": {"translation": "t"}}}))
    assert [r["key"] for r in D.read_cache(spark, str(tmp_path / "d")).collect()] == ["b"]
    read = spark.createDataFrame([("h", '["text",0.5]', 3.0)], "key string, result string, ts double")
    D.write_ocr_cache(read, str(tmp_path / "o"), F.lit(WHEN))
    assert [tuple(r) for r in D.read_ocr_cache(spark, str(tmp_path / "o")).collect()] == [("h", '["text",0.5]', 3.0)]


def test_checkpoint(spark, tmp_path):
    schema = ", ".join(f"{c} {t}" for c, t in D.TASK_FIELDS.items())
    rows = [
        ("p1", "a.png", "b.png", "DONE", None, ["load", "ocr"], 1, {"ocr": 2}, 0, [], None, WHEN, WHEN), ("p2", "c.png", "", "FAILED", "ocr", [], 0, {}, 3, ["z", "cpu_inpaint"], "ValueError: x", WHEN, None), ("p3", "d.png", "e.png", "PENDING", None, [], 0, {}, 0, [], None, None, None),
    ]
    tasks = spark.createDataFrame(rows, schema)
    for files in (1, 3):
        path = str(tmp_path / f"c{files}")
        D.write_checkpoint(tasks.unionByName(tasks.where("page_id = 'p1'").withColumn("completed_ts", F.lit("2020"))), path, "abc", F.lit(WHEN), files)
        got = D.read_checkpoint(spark, path)
        assert {r.config_digest for r in got.collect()} == {"abc"}
        assert sorted(map(tuple, got.drop("config_digest").collect())) == [tuple(sorted(x) if x == ["z", "cpu_inpaint"] else x for x in r) for r in rows]
    D.write_checkpoint(tasks.limit(0), str(tmp_path / "none"), "abc", F.lit(WHEN))
    assert D.read_checkpoint(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "c.json").write_text(json.dumps({"version": 1, "pages": {"x": {"page_id": "x", "state": "DONE"}, "y": {"page_id": "y"}}}))
    old = D.read_checkpoint(spark, str(tmp_path / "old")).collect()
    assert [(r.page_id, r.completed_stages, r.stage_retries, r.oom_retries, r.last_error) for r in old] == [("x", [], {}, 0, None)]


def test_restore(spark):
    schema = ", ".join(f"{c} {t}" for c, t in D.TASK_FIELDS.items())
    previous = spark.createDataFrame([
        ("done", "a", "former", "DONE", None, ["load"], 2, {"ocr": 1}, 1, ["cpu_inpaint"], "old", WHEN, WHEN), ("gone", "a", "lost", "DONE", None, ["load"], 0, {}, 0, [], None, WHEN, WHEN), ("nopath", "a", None, "DONE", None, None, None, {}, 0, [], None, None, None),
        ("half", "a", "b", "RUNNING", "ocr", ["load"], 1, {"ocr": 1}, 2, ["cpu_inpaint"], "E: x", WHEN, None), ("other", "a", "b", "FAILED", None, [], 1, {}, 0, [], "E: y", None, None),
    ], schema)
    pages = spark.createDataFrame([(p, "in", f"out-{p}") for p in ("done", "gone", "nopath", "half", "new")], "page_id string, input_path string, output_path string")
    tasks = S.new_tasks(pages)
    there = spark.createDataFrame([("former",), ("out-nopath",), ("out-gone",), ("former",)], "path string")
    assert sorted(r.page_id for r in S.to_run(tasks, previous, there).collect()) == ["gone", "half", "new"]
    of = lambda df: {r.page_id: (r.state, r.current_stage, r.completed_stages, r.retries, r.stage_retries, r.oom_retries, r.last_error, r.completed_ts) for r in df.collect()}
    fresh = ("PENDING", None, [], 0, {}, 0, None, None)
    got = of(S.restore(tasks, previous))
    assert got == {"done": ("DONE", None, ["load"], 2, {}, 0, None, WHEN), "gone": ("DONE", None, ["load"], 0, {}, 0, None, WHEN), "nopath": ("DONE", None, [], 0, {}, 0, None, None), "half": ("PENDING", None, [], 1, {}, 0, "E: x", None), "new": fresh}
    kept = of(S.restore(tasks, previous, reset_partial=False))
    assert kept["half"] == fresh and kept["done"] == got["done"]
    merged = of(S.upsert(previous, S.restore(tasks, previous)))
    assert merged == got | {"other": ("FAILED", None, [], 1, {}, 0, "E: y", None)}


def test_repeated_keys_and_several_files(spark, tmp_path):
    terms = spark.createDataFrame([("Bob", "Bob"), ("Bob", "Rob"), ("Eve", "Eve"), (None, "x")], "term string, dst string")
    D.write_glossary(terms, str(tmp_path / "g"), files=5)
    assert sorted(map(tuple, D.read_glossary(spark, str(tmp_path / "g")).select("term", "dst").collect())) == [("Bob", "Rob"), ("Eve", "Eve")]
    cache = spark.createDataFrame([("k", "new", "m", "vi", "p", 2.0), ("k", "old", "m", "vi", "p", 1.0)], "key string, translation string, model string, target_lang string, text_preview string, ts double")
    D.write_cache(cache, str(tmp_path / "c"), F.lit(WHEN), files=2)
    assert [r["translation"] for r in D.read_cache(spark, str(tmp_path / "c")).collect()] == ["new"]


def test_records_and_events(spark, tmp_path):
    records = spark.createDataFrame([(1, 1, "b", None), (1, 0, "a", 0.5), (2, 0, None, None)], "page_id long, block_idx int, text string, ocr_conf double")
    D.write_records(records, str(tmp_path / "r"))
    pages = {r["page_id"]: json.loads(r["records"]) for r in spark.read.json(str(tmp_path / "r")).collect()}
    assert pages == {1: [{"block_idx": 0, "text": "a", "ocr_conf": 0.5}, {"block_idx": 1, "text": "b"}], 2: [{"block_idx": 0}]}
    events = spark.sql("select 1L event_id, timestamp'2026-01-01 10:00:00' ts, 'stage_start' event union all select 2L, timestamp'2026-01-02 10:00:00', null")
    D.append_events(events, str(tmp_path / "e"))
    D.append_events(events, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 4 and len(list((tmp_path / "e").glob("day=*"))) == 2


def test_detector_chain(spark):
    box = "page_id long, block_idx int, x1 int, y1 int, x2 int, y2 int, score double, cls int"
    # of page 1: block 1 lies in block 0, block 2 falls into two parts; page 2 has nothing but a missed component; page 3 nothing to change
    raw = spark.createDataFrame([(1, 0, 0, 0, 100, 100, 0.9, 0), (1, 1, 10, 10, 50, 50, 0.8, 1), (1, 2, 300, 0, 400, 200, 0.7, 0), (3, 0, 0, 0, 50, 50, 0.5, 1)], box)
    parts = spark.createDataFrame([(1, 2, 5, 300, 0, 400, 80), (1, 2, 9, 300, 120, 400, 200), (1, 0, 1, 0, 0, 100, 100)], "page_id long, block_idx int, first_comp long, x1 int, y1 int, x2 int, y2 int")
    comps = spark.createDataFrame([(2, 7, 100, 100, 40, 30, 900, 800, 220)], "page_id long, comp_id long, cx int, cy int, cw int, ch int, area int, raw_pixels int, annulus_mean int")
    blocks, counts = B.detect(raw, parts, comps, 900, 1300)
    assert {r["page_id"]: (r["n_raw"], r["n_after_dedupe"], r["n_after_split"], r["n_blocks"]) for r in counts.collect()} == {1: (3, 2, 3, 3), 2: (0, 0, 0, 1), 3: (1, 1, 1, 1)}
    got = sorted(tuple(r) for r in blocks.collect())
    assert got == [(1, 0, 0, 0, 100, 100, 0.9, 0), (1, 1, 300, 0, 400, 80, 0.7, 0), (1, 2, 300, 120, 400, 200, 0.7, 0), (2, 0, 94, 94, 146, 136, 0.3, 1), (3, 0, 0, 0, 50, 50, 0.5, 1)]


def test_preservation_switched_off(spark):
    roles = spark.createDataFrame([(1, 0, "dialogue", "Hi", False), (1, 1, "sfx", "漢字", True)], "page_id long, block_idx int, role string, t string, profile_preserve boolean")
    none = spark.createDataFrame([], "page_id long, block_idx int, translated string")
    assert B.preserved(roles, none).count() == 1 and B.preserved(roles, none, enabled=False).count() == 2


def test_eviction_with_ties(spark):
    for spread in (1, 3, 50, 1000):
        rows = [(f"k{i:04}", i % spread) for i in range(1000)]
        cache = spark.createDataFrame(rows, "key string, ts long").repartition(5)
        for most in (1, 20, 700, 999):
            want = sorted(rows, key=lambda r: (r[1], r[0]))[-int(most * 0.95) :] if int(most * 0.95) else []
            got = sorted(map(tuple, S.evict_oldest(cache, most).collect()), key=lambda r: (r[1], r[0]))
            assert got == want, (spread, most)
    assert S.evict_oldest(cache, 1000).count() == 1000
