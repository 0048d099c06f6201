"""Literal cases of the text rules, and streams against the batch form."""

import pytest
from pyspark.sql import functions as F

from pageweave.functions import geometry as G
from pageweave.functions import text as T
from pageweave.plans.registry import gibberish, longest_run, scanline_extents
from pageweave.plans.runtime import script_flags
from pageweave.plans.typesetting import line_capacities, wrap_text_shape
from tests.oracle import SF


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,primary,letters,punct,digits", [
    (None, "unknown", 0, 0, 0), ("", "unknown", 0, 0, 0), ("こんにちは", "ja", 5, 0, 0), ("漢字", "zh", 2, 0, 0), ("안녕", "ko", 2, 0, 0), ("Việt", "vi", 4, 0, 0), ("đăơư", "en", 4, 0, 0), ("Привет", "en", 6, 0, 0), ("！？", "unknown", 0, 0, 0),
    ("・", "ja", 1, 0, 0), ("ー", "ja", 1, 0, 0), ("Hi漢", "mixed", 3, 0, 0), ("한漢", "mixed", 2, 0, 0), ("かHi", "ja", 3, 0, 0), ("123", "unknown", 0, 0, 3), ("１２", "unknown", 0, 0, 2), ("A²", "en", 1, 0, 1), ("ab!", "en", 2, 1, 0), ("ドン!", "ja", 2, 1, 0), ("…", "unknown", 0, 1, 0),
])
def test_script_profile(spark, text, primary, letters, punct, digits):
    r = one(spark, T.script_profile, text)
    assert (r["primary"], r["letters"], r["punct"], r["digits"]) == (primary, letters, punct, digits)


@pytest.mark.parametrize("text,clean", [("No!!!! ?????", "No?!??"), ("wait .....  ok　!", "wait...  ok!"), ("!!!", "!!!"), (None, "")])
def test_sanitize(spark, text, clean):
    assert one(spark, T.sanitize_punctuation, text) == clean


@pytest.mark.parametrize("text,clean", [("  hello Hello world__ ", "hello world."), ("a a a", "a a a"), ("ドン__", "ドン__"), ("end;:", "end."), (None, "")])
def test_clean_ocr(spark, text, clean):
    assert one(spark, T.clean_ocr, text) == clean


@pytest.mark.parametrize("text,kind", [("BOOM!", "action"), ("booom", "unknown"), ("owl", "emotion"), ("tap-tap", "ambient"), ("ドドド", "action"), ("", "unknown")])
def test_sfx_subtype(spark, text, kind):
    assert one(spark, T.sfx_subtype, text) == kind


@pytest.mark.parametrize("reply,parts", [('["a"]', ["a", ""]), ('```json\n{"output": ["x","y","z"]}\n```', ["x", "y"]), ('so: ["q"] ok', ["q", ""]), (None, ["", ""])])
def test_parse_translations(spark, reply, parts):
    assert one(spark, lambda c: T.parse_translations(c, F.lit(2)), reply) == parts


def test_health_stream_equals_batch(spark, tmp_path):
    from pageweave.operators import events as E
    from pageweave.sources import tables as D
    from pageweave.streaming import events as SE

    log = D.event_log(spark, "/root/testdata/sf0.001")
    log.write.json(str(tmp_path / "in"))
    q = SE.health(SE.read(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("health").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = E.health(log).select(F.col("w.start").alias("w_start"), "event", "n")
    assert sorted(map(tuple, spark.table("health").collect())) == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize("src,tgt,fixed", [
    ("Yuki-san and Ken-kun", "Yuki meets Ken, Yuki waves", "Yuki-san meets Ken-kun, Yuki waves"), ("Yuki-san", "Yuki-san and Yuki", "Yuki-san and Yuki"), ("Yuki-san Yuki-san", "Yuki", "Yuki-san"),
    ("yuki-san", "yuki", "yuki"), ("Yuki-santa", "Yuki", "Yuki"), ("Yuki-san", "", ""), (None, "Yuki", "Yuki"), ("Yuki-san", None, ""), ("", None, ""),
])
def test_keep_honorifics(spark, src, tgt, fixed):
    df = spark.createDataFrame([(src, tgt)], "s string, t string")
    assert df.select(T.keep_honorifics(F.col("s"), F.col("t"))).first()[0] == fixed


@pytest.mark.parametrize("rpm,capacity", [(20, 3), (60, 1), (7, 5)])
def test_bucket_waits_equal_a_loop(spark, rpm, capacity):
    import random
    from datetime import UTC, datetime, timedelta

    from pageweave.operators import events as E

    rnd, start = random.Random(rpm), datetime(2026, 1, 1, tzinfo=UTC)
    rows = [(i, i % 3, start + timedelta(seconds=rnd.randint(0, 400))) for i in range(300)]
    got = {r["event_id"]: r["wait_us"] for r in E.bucket_waits(spark.createDataFrame(rows, "event_id long, key int, ts timestamp"), "key", rpm, capacity).collect()}
    step = 60_000_000 // rpm
    for key in range(3):
        level, last = capacity * step, 0  # in microseconds of refill
        for i, _, ts in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
            at = int((ts - start).total_seconds()) * 1_000_000
            now = max(at, last)
            level, last = min(capacity * step, level + now - last), now
            short = max(0, step - level)
            level, last = level + short - step, now + short
            assert got[i] == last - at


def test_longest_runs(spark):
    from pageweave.operators import blocks as B

    points = [(1, 0, x) for x in (1, 2, 2, 4, 5, 9)] + [(1, 1, 7)] + [(2, 0, x) for x in (0, 3, 4, 5)]
    got = B.longest_runs(spark.createDataFrame(points, "page_id long, y int, x int")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, 2), (1, 1, 7, 7), (2, 0, 3, 5)]
    assert B.longest_runs(spark.createDataFrame([], "page_id long, y int, x int")).count() == 0


def test_language_of_a_page(spark):
    from pageweave.operators import language as L

    crops = [(1, 0, "ja", 0.5, "こんにちは。"), (1, 0, "zh_sim", 0.9, "漢こ。"), (1, 0, "ko", None, "안녕"), (2, 0, "en", 0.1, "a"), (3, 0, "ko", 0.4, "안"), (3, 1, "ko", 0.6, "안"), (3, 0, "vi", 0.5, "ế"), (4, 0, "en", 0.3, None)]
    scores = L.candidate_scores(spark.createDataFrame(crops, "page_id long, crop_no int, code string, conf double, text string"), spark.createDataFrame([(1, True)], "page_id long, is_vertical boolean"))
    got = {(r["page_id"], r["code"]): r["score"] for r in scores.collect()}
    en = ["en"]
    assert got == {(1, "ja"): round(0.5 * 1.25 * 1.15 * 1.1, 9), (1, "zh_sim"): round(0.9 * 1.25 * 1.1 * 0.6, 9), (2, "en"): 0.125, (3, "ko"): 0.625, (3, "vi"): 0.625, (4, "en"): 0.3}
    assert sorted(map(tuple, L.detect(scores).collect())) == [
        (1, "ja", "Japanese", ["ja", *en], 0.790625, True, "hiragana+kanji"), (2, "en", "English", en, 0.0, False, "latin"), (3, "ko", "Korean", ["ko", *en], 0.625, True, "hangul"), (4, "en", "English", en, 0.3, False, "latin"),
    ]
    kana = spark.createDataFrame([(1, 0, "ja", 0.5, "カナ"), (1, 0, "vi", 0.4, "か")], "page_id long, crop_no int, code string, conf double, text string")
    told = L.detect(L.candidate_scores(kana, spark.createDataFrame([], "page_id long, is_vertical boolean"))).first()
    assert (told.lang, told.primary_script) == ("ja", "katakana+kanji")


def test_blocks_without_recognised_text(spark):
    from pageweave.operators import blocks as B

    blocks = spark.createDataFrame([(1, i, 0, 0, 50, 20, 0) for i in range(4)], "page_id long, block_idx int, x1 int, y1 int, x2 int, y2 int, cls int")
    ocr = spark.createDataFrame([(1, 0, "Hello there", 0.9, False), (1, 1, "", 0.0, True), (1, 2, " \n", 0.5, False)], "page_id long, block_idx int, text string, ocr_conf double, ocr_failed boolean")
    roles = B.roles(blocks, ocr, 900, 1300)
    assert {r["block_idx"]: (r["role"], r["should_translate"], r["preserve"]) for r in roles.collect()} == {0: ("dialogue", True, False), 1: ("unknown", False, True), 2: ("dialogue", True, False), 3: ("dialogue", True, False)}
    assert [r["block_idx"] for r in B.translatable(roles).collect()] == [0]


def test_watchdog_tells_each_freeze_once(spark, tmp_path):
    from pageweave.streaming import events as SE

    def put(name, rows):
        spark.createDataFrame(rows, SE.SCHEMA.replace("ts timestamp", "ts string")).coalesce(1).write.json(str(tmp_path / "in" / name))

    def run():
        stream = SE.read(spark, str(tmp_path / "in" / "*"))
        SE.watchdog(stream).writeStream.outputMode("append").format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    put("a", [(1, "2026-01-01T00:00:00Z", 1, "stage_start", 3, None), (2, "2026-01-01T00:00:10Z", 2, "stage_start", 4, None), (3, "2026-01-01T00:00:20Z", 2, "stage_end", 4, 5.0)])
    run()
    put("b", [(4, "2026-01-01T00:10:00Z", 9, "page_done", 1, None)])
    run()
    put("c", [(5, "2026-01-01T00:20:00Z", 9, "page_done", 1, None)])
    run()
    told = spark.read.schema("page_id long, stage int, since_ms long").json(str(tmp_path / "out")).collect()
    assert [(r["page_id"], r["stage"], r["since_ms"]) for r in told] == [(1, 3, 1767225600000)]


def test_capacities_move_no_rows(spark):
    plan = planned(line_capacities(spark, SF))
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_shapes_move_no_rows(spark):
    plan = planned(wrap_text_shape(spark, SF))
    assert plan.count("Window [") == 1 and "Generate" not in plan[: plan.index("MapInArrow")]


def test_texts_are_read_once(spark):
    assert "regexp_count" not in planned(script_flags(spark, SF)) and "regexp_replace" not in planned(script_flags(spark, SF))


def test_gibberish_words_without_patterns(spark):
    assert "?<!" not in planned(gibberish(spark, SF))
    texts = ["a \u3000b" * 3000, None, "", " ", "!!", "é", "ab a! !!a a!!!", "日 本語", "x" * 5000]
    got = [r.n for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).orderBy("i").select(T.gibberish_words(F.col("t")).alias("n")).collect()]
    assert got == [2, 0, 0, 0, 1, 1, 2, 1, 0]


def test_runs_of_many_words(spark):
    from pageweave.operators import blocks as B

    points = [(1, 0, x) for x in range(-70, 140)] * 2 + [(1, 1, x) for x in [*range(60, 70), *range(200, 210), 63]] + [(2, 5, None)]
    got = {(r.page_id, r.y): (r.xmin, r.xmax) for r in B.longest_runs(spark.createDataFrame(points, "page_id long, y int, x int")).collect()}
    assert got == {(1, 0): (-70, 139), (1, 1): (60, 69), (2, 5): (None, None)}
    assert "Window" not in planned(longest_run(spark, SF))


def test_scanlines_stay_with_their_polygon(spark):
    from pageweave.operators import blocks as B

    plan = planned(scanline_extents(spark, SF))
    assert plan.index("Generate") < min(plan.index("Sort"), plan.index("Exchange"))  # rows are made last and never sorted
    corners = [(p, i, float((p * 31 + i * 17) % 40), float((p * 7 + i * 23) % 50)) for p in range(60) for i in range(p % 9)]
    told = spark.createDataFrame(corners + [(99, 0, None, 1.0), (99, 1, 5.0, None), (99, 2, 5.0, 9.0), (99, 3, 8.0, 0.0)], "page_id long, ord int, x double, y double").coalesce(1)
    whole = {r.page_id: r.rows for r in B.scanlines(told, 50).collect()}
    assert whole == {r.page_id: r.rows for r in B.scanlines(told, 50, at_once=120).collect()} and len(whole) > 30


def test_scanline_extents(spark):
    from pageweave.operators import blocks as B

    square = [(1, i, x, y) for i, (x, y) in enumerate([(2.0, 1.0), (6.0, 1.0), (6.0, 3.0), (2.0, 3.0)])]
    fork = [(2, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (4.0, 2.0), (4.0, 0.0), (9.0, 0.0), (9.0, 3.0), (0.0, 3.0)])]  # mean x 3.75: in the notch
    line = [(3, 0, 0.0, 0.0), (3, 1, 5.0, 5.0)]
    got = B.scanline_extents(spark.createDataFrame(square + fork + line, "page_id long, ord int, x double, y double"), 3).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2, 6), (1, 2, 2, 6), (2, 0, 4, 9), (2, 1, 4, 9), (2, 2, 0, 9)]


@pytest.mark.parametrize("message,header,wait", [
    ('{"retryDelay": "7.9s"}', "3", 9), ("Please TRY again in 12s", None, 14), ("busy", "2.5", 3), ("busy", "soon", 30), (None, None, 30),
])
def test_retry_seconds(spark, message, header, wait):
    row = spark.createDataFrame([(message, header)], "m string, h string").select(T.retry_seconds(F.col("m"), F.col("h")).alias("r")).first()
    assert row["r"] == wait


def test_split_regions(spark):
    from pageweave.operators import fitting as P

    # two rows with a gap, the upper one of two columns; a speck that doesn't count; a region of its own
    boxes = [(1, 0, 1, 0, 0, 10, 10, 90), (1, 0, 2, 40, 0, 50, 10, 90), (1, 0, 3, 0, 40, 50, 50, 90), (1, 0, 4, 20, 20, 22, 22, 4), (1, 1, 5, 0, 0, 9, 9, 81)]
    schema = "page_id long, block_idx int, comp_id long, x1 int, y1 int, x2 int, y2 int, area int"
    got = P.split_regions(spark.createDataFrame(boxes, schema)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, 1, 0, 0, 14, 14), (1, 0, 2, 1, 36, 0, 54, 14), (1, 0, 3, 1, 0, 36, 54, 54), (1, 1, 5, 1, 0, 0, 13, 13)]
    assert P.split_regions(spark.createDataFrame([], schema)).count() == 0


def test_font_cap(spark):
    from pageweave.operators import fitting as P

    c = F.col
    rows = [(50, 50, 50, 50, False), (100, 40, 100, 40, False), (100, 100, 1000, 1000, False), (100, 100, 1000, 1000, True), (0, 5, 9, 9, False), (10, 10, 10, 10, False)]
    got = spark.createDataFrame(rows, "w int, h int, bw int, bh int, e boolean").select(P.font_cap(8, 120, c("w"), c("h"), c("bw"), c("bh"), c("e")).alias("s")).collect()
    assert [r["s"] for r in got] == [47, 40, 120, 100, 120, 24]


def test_glossary_leaves_common_words_out_whatever_their_number(spark, tmp_path):
    from pageweave.plans import registry

    turns = ["The Alice met BOB-san With Nevermind and Carol", "The Alice saw Bob-san With Nevermind and Bob"]
    rows = [(c, t, "user", turns[t]) for c in range(300) for t in range(2)] + [(900, t, "user", x) for t, x in enumerate(["NOW Élan", "NOW Alice here", "", "Alice Dora", "no Dora"])]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.queries()["glossary_terms"](spark, str(tmp_path)).collect()
    assert {r.term: r.dst for r in got} == {"Alice": "Alice", "BOB-san": "Bob-san", "Dora": "Dora"}


def test_inscribed_box(spark):
    """Half of the text's area is enough, less isn't; every side gives up 4 % of its length, in whole pixels."""
    rows = [(0, [0, 0, 100, 100]), (1, [50, 0, 150, 100]), (2, [51, 0, 151, 100]), (3, [0, 0, 124, 126]), (4, [200, 200, 300, 300]), (5, None)]
    box = lambda c: F.struct(*[F.col(c)[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])
    df = spark.createDataFrame(rows, "i int, r array<int>").withColumn("t", F.array(*map(F.lit, (0, 0, 100, 100))))
    got = {r.i: r.b and tuple(r.b) for r in df.select("i", G.inscribed_box(box("t"), box("r")).alias("b")).collect()}
    assert got == {0: (4, 4, 96, 96), 1: (54, 4, 146, 96), 2: None, 3: (4, 5, 120, 121), 4: None, 5: None}


def _log(spark, *pages):
    """Events of pages, each a list of (event, stage or None, memory error?), in order."""
    rows, n = [], 0
    for page, told in enumerate(pages):
        for event, stage, memory in told:
            n += 1
            rows.append((n, f"2026-01-01 00:00:{n:02d}", page, event, stage, "MemoryError" if memory else "ValueError", f"no {n} " + "x" * 400))
    return spark.createDataFrame(rows, "event_id long, ts string, page_id long, event string, stage int, error_type string, error_msg string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_attempts_in_order(spark):
    from pageweave.operators import events as E

    err = lambda stage, memory=False: ("stage_error", stage, memory)
    end = lambda stage: ("stage_end", stage, False)
    got = {}
    log = _log(
        spark,
        [err(7, True)] * 3,  # three memory errors use up the attempts
        [err(7, True), err(7), err(7, True)],  # mixed errors do, too
        [err(7, True), end(7), err(7, True), end(7), err(7, True), end(7), err(7, True)],  # the page's memory retries are spent
        [err(3, True), err(3, True), err(7, True), err(7, True), end(7)],  # memory errors of another stage are plain errors
        [err(2), err(2), ("page_failed", None, False), err(2), err(2), err(2)],  # a new run has new budgets
        [err(7, True), err(7, True), ("page_done", None, False), err(7, True), err(7, True)],
        [err(1), end(1), err(1), err(1)],
    )
    for r in E.stage_outcomes(log).collect():
        got[r.page_id, r.stage] = (r.outcome, r.n_failed, r.stage_retries, r.memory_retries, r.on_cpu)
        assert (r.fatal_error is None) == (r.n_failed == 0)
        assert len(r.last_error) in (len("MemoryError: ") + 300, len("ValueError: ") + 300)
        assert r.fatal_error is None or len(r.fatal_error) in (len("MemoryError: ") + 200, len("ValueError: ") + 200)
    assert got == {
        (0, 7): ("failed", 1, 0, 3, True), (1, 7): ("failed", 1, 1, 2, True), (2, 7): ("failed", 1, 0, 3, True), (3, 3): ("open", 0, 2, 0, False), (3, 7): ("ok", 0, 0, 2, True),
        (4, 2): ("failed", 1, 4, 0, False), (5, 7): ("open", 0, 0, 4, True), (6, 1): ("open", 0, 3, 0, False),
    }
    assert E.stage_outcomes(log.limit(0)).count() == 0


@pytest.mark.parametrize("text,cls,role,kind", [("あ!", 0, "dialogue", "ambient"), ("あ!", 1, "sfx", "ambient"), ("漢!", 0, "dialogue", "action"), ("OK now", 0, "dialogue", "unknown"), ("!", 0, "dialogue", "unknown"), ("", 1, "sfx", "unknown")])
def test_subtype_of_interjections(spark, text, cls, role, kind):
    from pageweave.operators import blocks as B

    block = spark.createDataFrame([(1, 0, 0, 0, 10, 10, cls)], "page_id long, block_idx int, x1 int, y1 int, x2 int, y2 int, cls int")
    read = spark.createDataFrame([(1, 0, text, 0.9, False)], "page_id long, block_idx int, text string, ocr_conf double, ocr_failed boolean")
    r = B.roles(block, read, 900, 1300).first()
    assert (r.role, r.sfx_subtype) == (role, kind)


def test_exact_percentiles(spark):
    import random

    import numpy as np

    from pageweave.operators.quantiles import exact_percentile

    rnd = random.Random(1)
    groups = {"one": [5.0], "two": [1.0, 2.0], "same": [3.0] * 40, "far": [1e308, -1e308, 0.0], "tail": [0.0] * 500 + [1e9, 2e9], "ties": [float(rnd.randrange(4)) for _ in range(333)], "many": [rnd.gauss(0, 1) for _ in range(5000)]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("one", None), ("none", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    for share in (0.0, 0.5, 0.99, 1.0):
        got = {r.g: r.q for r in exact_percentile(df, ["g"], "x", share, "q").collect()}
        assert set(got) - {None} == set(groups)
        for g, xs in groups.items():
            s = sorted(xs)
            at = (len(s) - 1) * share
            a, b = s[int(at)], s[min(int(at) + 1, len(s) - 1)]
            assert got[g] == pytest.approx(a if a == b else (1 - at % 1) * a + at % 1 * b)
    assert np.isclose(got["many"], max(groups["many"]))


def test_gibberish_words(spark):
    import random
    import re

    rnd = random.Random(3)
    texts = [None, "", " ", "a", "ab", "!!", "a!", "1a2", "12a4", "1ab4", "1a2 !b", "　あ1  x\n!?a", "ab cd 123 4 é1 é11 é111 é1111"] + ["".join(rnd.choices("ab1!é あ漢\n\t🙂", k=rnd.randrange(25))) for _ in range(300)]
    letter = lambda c: c.isalpha() or "぀" <= c <= "ヿ"

    def bad(w):
        n, k = len(w), sum(map(letter, w))
        return n < 2 or k == 0 or n <= 4 and k < 0.4 * n

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", T.gibberish_words(F.col("t")).alias("n"), T.is_gibberish(F.col("t")).alias("all")).collect():
        words = [w for w in re.split(r"\s+", r.t or "") if w]
        assert r.n == sum(map(bad, words)), r.t
        stripped = (r.t or "").strip()
        seen = re.sub(r"\s", "", stripped)
        k = sum(map(letter, seen))
        assert r["all"] == (len(stripped) < 2 or k == 0 or len(seen) <= 4 and k < 0.4 * len(seen)), r.t


def subtype(text):
    """The rule on the whole text, without the short cut for long ones."""
    import re

    t = text.strip().lower().strip("?!.,'\"")
    compact = re.sub(r"(?s)(.)\1+", r"\1", t)
    if not t:
        return "unknown"
    if t in T.EMOTION or compact in T.EMOTION or t.startswith(tuple(T.EMOTION)):
        return "emotion"
    for kind, words in (("action", T.ACTION), ("ambient", T.AMBIENT)):
        if t in words or compact in words:
            return kind
    has = lambda lo, hi: any(lo <= c <= hi for c in text)
    if has("一", "鿿") and any(c in "!?.,'" for c in text):
        return "action"
    if has("゠", "ヿ") and not has("぀", "ゟ"):
        return "action"
    return "ambient" if has("぀", "ゟ") else "unknown"


def test_subtype_of_long_texts(spark):
    long = "word " * 90
    texts = ["ha" * 300, "  ?!HAHA " + long, long + "boom", "b" * 300 + "o" * 300 + "m", "BOOOOOOOOM" + "!?" * 200, "?!" * 200 + "Ssssnaaaap", "ti" + "c" * 400 + "k.", long + "漢!", long + "漢", long + "カ", long + "カな", "Aa" * 400 + "h", "aAaA" * 100 + "h?", "?!" * 200, "ab" * 200]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.k for r in df.select("t", T.sfx_subtype(F.col("t")).alias("k")).collect()}
    assert got == {t: subtype(t) for t in texts} and set(got.values()) == {"emotion", "action", "ambient", "unknown"}
