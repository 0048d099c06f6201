"""The glossary as of a page: against a loop over pages, and as a stream."""

import random

from pyspark.sql import functions as F

from pageweave.operators import state as S

RND = random.Random(8)


def loop(entries, wanted):
    out, known = [], {}
    for page in sorted({r[0] for r in entries + wanted}):
        out += [(p, t, known.get(t)) for p, t in wanted if p == page]
        known |= {t: d for p, t, d in entries if p == page}
    return sorted(out, key=repr)


def data(pages):
    entries = list({(p, t): (p, t, RND.choice("abc") + str(p % 3)) for p in pages for t in ("Ann", "Bob", "Eve") if RND.random() < 0.4}.values())
    wanted = [(p, t) for p in pages for t in ("Ann", "Bob", "Eve", "Zoe") if RND.random() < 0.6]
    return entries, wanted


def test_as_of_over_portions(spark, monkeypatch):
    monkeypatch.setattr(S, "SPAN", 7)
    entries, wanted = data(range(0, 200, 3))
    e, w = spark.createDataFrame(entries, "page_id long, term string, dst string"), spark.createDataFrame(wanted, "page_id long, term string")
    assert sorted(map(tuple, S.glossary_as_of(e, w).collect()), key=repr) == loop(entries, wanted)
    assert S.glossary_as_of(e.limit(0), w).where("dst is not null").count() == 0 and S.glossary_as_of(e, w.limit(0)).count() == 0
    # intervals say the same
    i = S.glossary_intervals(e)
    met = w.join(i, "term").where("page_id > after_page and (until_page is null or page_id <= until_page)").select("page_id", "term", "dst")
    assert sorted(map(tuple, met.collect()), key=repr) == [r for r in loop(entries, wanted) if r[2] is not None]


def test_memory_as_of(spark):
    rows = [("Ann", 1, "An", None), ("Ann", 4, "Anna", "right"), ("Ann", 9, "Anne", "left"), ("Bob", 4, "Bob", None)]
    got = S.memory_as_of(spark.createDataFrame(rows, "name string, page_id long, name_target string, side string")).collect()
    assert sorted(map(tuple, got)) == [("Ann", 1, 1, 1, "An", "unknown"), ("Ann", 4, 1, 2, "An", "right"), ("Ann", 9, 1, 3, "An", "right"), ("Bob", 4, 4, 1, "Bob", "unknown")]


def test_stream_equals_batch(spark, tmp_path):
    from pageweave.streaming import glossary as SG

    entries, wanted = data(range(30))
    at = lambda p: f"2026-01-01T00:{p:02d}:00Z"
    rows = [(at(p), p, t, d) for p, t, d in entries] + [(at(p), p, t, None) for p, t in wanted]
    # three deliveries; some rows of a page come with the next one, within the lateness allowed
    parts = [[r for r in rows if min((r[1] + (hash_of(r) % 4 == 0) * 5) // 12, 2) == k] for k in range(3)]
    parts += [[("2026-01-02T00:00:00Z", 999, "Zed", None)], [("2026-01-03T00:00:00Z", 999, "Zed", None)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SG.SCHEMA.replace("ts timestamp", "ts string")).coalesce(1).write.json(str(tmp_path / "in" / str(k)))
        stream = spark.readStream.schema(SG.SCHEMA).json(str(tmp_path / "in" / "*"))
        SG.as_of(stream, "20 minutes").writeStream.outputMode("append").format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("page_id long, term string, dst string").json(str(tmp_path / "out")).where(F.col("page_id") < 999)
    assert sorted(map(tuple, got.collect()), key=repr) == loop(entries, wanted)


def hash_of(row):
    return sum(map(ord, f"{row[1]}{row[2]}{row[3]}"))
