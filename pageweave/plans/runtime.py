"""Queries of outcomes, counters, detection and whole script profiles; importing the module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageweave.functions import text as T
from pageweave.operators import blocks as B
from pageweave.operators import events as E
from pageweave.operators import state as S
from pageweave.plans import registry as R
from pageweave.plans.registry import BLOCKS, CACHE, EVENTS, ROLES, STRIP, H, W, query
from pageweave.sources import tables as D

OOM = f"lower(coalesce(error_type,'')) = 'memoryerror' or regexp_matches(lower(coalesce(error_type,'')), 'outofmemory|oom') or regexp_matches(lower(coalesce(error_msg,'')), '{T.OUT_OF_MEMORY}')"
NAMES = "['" + "','".join(E.STAGES) + "']"
FAILURE = "coalesce(error_type,'') || ': ' || substr(coalesce(error_msg,''), 1, 300)"


# A walk over each page's events: stage under way, errors of its execution, memory retries of the page. Stage 7 is inpainting, 3 attempts, 3 memory retries.
WALK = f"""e as (select *, row_number() over (partition by page_id order by ts, event_id) k, stage=7 and ({OOM}) mem from ev),
walk as (select page_id, 0::bigint k, null::int cur, 0 att, 0 oom, null::varchar event, null::int stage, false fatal, false granted, false retried, null::timestamp ts, null::bigint event_id, null::varchar error_type, null::varchar error_msg from (select distinct page_id from ev)
  union all select page_id, k, case when event in ('page_done','page_failed') or event='stage_end' or fatal then null when event in ('stage_start','stage_error') then stage else cur end,
    case when event in ('page_done','page_failed') or event='stage_end' or fatal then 0 when event='stage_error' then had+1 when event='stage_start' then had else att end,
    case when event in ('page_done','page_failed') then 0 when granted then oom+1 else oom end, event, stage, fatal, granted, event='stage_error' and not mem and not fatal, ts, event_id, error_type, error_msg
  from (select *, event='stage_error' and ((mem and oom >= 3) or had+1 >= 3) fatal, event='stage_error' and mem and oom < 3 granted
    from (select w.page_id, e.k, w.cur, w.att, w.oom, e.event, e.stage, e.mem, e.ts, e.event_id, e.error_type, e.error_msg, case when w.cur = e.stage then w.att else 0 end had from walk w join e on e.page_id=w.page_id and e.k=w.k+1)))"""


@query(f"""with recursive {EVENTS}, {WALK}, s as (select * from walk where event in ('stage_start','stage_end','stage_error'))
select page_id, stage, count(*) filter (where event='stage_start') n_attempts, count(*) filter (where event='stage_error') n_errors, count(*) filter (where fatal) n_failed,
  arg_max(case when event='stage_end' then 'ok' when fatal then 'failed' else 'open' end, k) outcome, arg_max({FAILURE}, k) filter (where event='stage_error') last_error, arg_max({FAILURE.replace("300", "200")}, k) filter (where fatal) fatal_error,
  count(*) filter (where retried) stage_retries, count(*) filter (where granted) memory_retries, count(*) filter (where granted) > 0 on_cpu from s group by all""")
def stage_outcomes(s, d):
    return E.stage_outcomes(D.event_log(s, d))


@query(f"""with {EVENTS}, f as (select * from ev where event in ('page_done','page_failed') qualify row_number() over (partition by page_id order by ts desc, event_id desc) = 1)
select f.page_id, {FAILURE.replace("error_", "f.error_")} last_error, coalesce(list_sort(list_distinct(list(e.stage) filter (where e.stage is not null))), []) completed
from f left join ev e on e.page_id=f.page_id and e.event='stage_end' and (e.ts < f.ts or (e.ts = f.ts and e.event_id < f.event_id)) where f.event='page_failed' group by all""")
def failed_pages(s, d):
    return E.failed_pages(D.event_log(s, d))


@query(f"""with {EVENTS}, u as (select unnest([case when event='stage_end' then 'stage_' || {NAMES}[stage+1] || '_ok' end, case when event='stage_error' then 'stage_' || {NAMES}[stage+1] || '_err' end,
  case when event='stage_error' and ({OOM}) then 'oom_events' end, case event when 'page_done' then 'pages_done' when 'page_failed' then 'pages_failed' when 'page_skip_resume' then 'pages_skipped' when 'stage_freeze' then 'watchdog_freezes' end]) as name from ev)
select name, count(*) n from u where name is not null group by 1""")
def counters(s, d):
    return E.counters(D.event_log(s, d))


@query(f"""with ct as ({R.ORACLES["counters"]}), {EVENTS}, ga as (select 'latency_' || {NAMES}[stage+1] name, arg_max(latency_ms, (ts, event_id)) v from ev group by stage),
c8 as (select string_agg(name || '=' || n, ',' order by name) l from (select * from ct order by name limit 8)), g8 as (select string_agg(name || '=' || printf('%.2f', round(v, 2)), ',' order by name) l from (select * from ga where v is not null order by name limit 8))
select '[health uptime=90s]' || coalesce(' counters=' || c8.l, '') || coalesce(' gauges=' || g8.l, '') line from c8, g8""")
def health_line(s, d):
    return E.health_line(D.event_log(s, d), 90)


@query(f"with {EVENTS}, o as (select page_id, arg_max(event, (ts, event_id)) outcome from ev where event in ('page_done','page_failed') group by 1) select count(*) filter (where outcome='page_done') n_ok, count(*) n_pages, count(*) filter (where outcome='page_done') = count(*) all_ok from o")
def batch_summary(s, d):
    return E.batch_summary(E.page_outcomes(D.event_log(s, d)))


@query(f"with {EVENTS} select page_id, ts, stage from ev where event='stage_start' qualify row_number() over (partition by page_id order by ts desc, event_id desc) = 1")
def heartbeats(s, d):
    out = E.heartbeats(D.event_log(s, d))
    return out.select("page_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "stage")


@query(f"with {EVENTS} select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') stamp, (epoch_us(lead(ts) over (partition by page_id order by ts, event_id)) - epoch_us(ts)) // 1000 next_ms from ev")
def event_times(s, d):
    """When each event was, and the whole milliseconds to the page's next."""
    from pyspark.sql import Window

    nxt = F.lead("ts").over(Window.partitionBy("page_id").orderBy("ts", "event_id"))
    return D.event_log(s, d).select("event_id", E.stamp(F.col("ts")).alias("stamp"), E.latency_ms(F.col("ts"), nxt).alias("next_ms"))


@query(f"""with {CACHE}, r as (select cache.key is not null hit from documents d left join cache on cache.key = sha256('m1' || chr(0) || 'vi' || chr(0) || d.text)),
a as (select event_id//4 request, event_id%4 attempt, case event_type when 'error' then 'HTTP 429' when 'signup' then 'timeout' end error from events),
b as (select request, count(*) n, count(*) filter (where error='HTTP 429') limited, arg_max(error is not null, attempt) lost from a group by 1)
select count(*) calls, sum(limited)::bigint rate_limit_hits, sum(n-1)::bigint retries, count(*) filter (where lost) failures, (select count(*) filter (where hit) from r) cache_hits, (select count(*) filter (where not hit) from r) cache_misses from b""")
def request_stats(s, d):
    attempts = D.table(s, d, "events").selectExpr("event_id div 4 as request", "event_id % 4 as attempt", "case event_type when 'error' then 'HTTP 429' when 'signup' then 'timeout' end as error")
    requests = D.table(s, d, "documents").select(T.cache_key(F.lit("m1"), F.lit("vi"), F.col("text")).alias("key"))
    return E.request_stats(attempts, S.lookup(requests, R._cache(s, d)))


COMPS = f"c as (select event_id//80 page_id, event_id comp_id, (event_id*31)%880 cx, (event_id*47)%1270 cy, 4+(event_id*13)%120 cw, 4+(event_id*17)%90 ch, (event_id*7)%4000 area, (event_id*11)%3000 raw_pixels, 150+(event_id%100) annulus_mean from events), k as (select * from c where area>=200 and cw>=8 and ch>=8 and cw*ch<=0.1*{W}*{H} and greatest(cw,ch)<=30*least(cw,ch) and raw_pixels>=0.05*cw*ch and annulus_mean>=185)"


def _components(s, d):
    return D.table(s, d, "events").selectExpr("event_id div 80 as page_id", "event_id as comp_id", "(event_id*31)%880 cx", "(event_id*47)%1270 cy", "4+(event_id*13)%120 cw", "4+(event_id*17)%90 ch", "(event_id*7)%4000 area", "(event_id*11)%3000 raw_pixels", "150+(event_id%100) annulus_mean")


@query(f"""with {BLOCKS}, {COMPS}, b as (select page_id, block_idx, x1, y1, x2, y2, ((x1*7+y1*3)%100)/100.0::double score, cls from blocks),
g as (select page_id, comp_id, greatest(cx-6,0) x1, greatest(cy-6,0) y1, least(cx+cw+6,{W}) x2, least(cy+ch+6,{H}) y2 from k where not exists (select 1 from b where b.page_id=k.page_id and greatest(least(cx+cw,b.x2)-greatest(cx,b.x1),0)*greatest(least(cy+ch,b.y2)-greatest(cy,b.y1),0) > 0.4*cw*ch))
select * from b union all select page_id, (coalesce((select max(block_idx)+1 from b where b.page_id=g.page_id), 0) + row_number() over (partition by page_id order by comp_id) - 1)::int, x1::int, y1::int, x2::int, y2::int, 0.30::double, 1 from g""")
def with_recovered(s, d):
    return B.with_recovered(D.blocks(s, d).withColumn("score", F.expr("((x1*7+y1*3)%100)/100.0D")), _components(s, d), W, H)


def _translate_sql(keep: str) -> str:
    return f"with {ROLES} select page_id, block_idx from roles where {STRIP('t')} <> '' and should_translate {keep}"


@query(_translate_sql(""))
def translate_candidates(s, d):
    """With preserved effects, as when they aren't skipped."""
    return B.translate_candidates(B.roles(D.blocks(s, d), D.ocr(s, d), W, H), skip_preserved=False).select("page_id", "block_idx")


SNIPPETS = ["", "漢字!", "かな", "カナ字", "한글", "Việt ①", "Привет２"]
_K = {"hiragana": r"[\x{3040}-\x{309f}]", "katakana": r"[\x{30a0}-\x{30ff}\x{31f0}-\x{31ff}]", "kanji": r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]", "hangul": r"[\x{ac00}-\x{d7a3}\x{1100}-\x{11ff}\x{3130}-\x{318f}]", "viet": r"[\x{1e00}-\x{1eff}]"}
_N = lambda k: f"len(regexp_extract_all(x, '{_K[k]}'))"


@query(f"""with d as (select doc_id, [{", ".join(f"'{x}'" for x in SNIPPETS)}][doc_id%7+1] || case when doc_id%2=0 then '' else ' ' || text end x from documents),
n as (select doc_id, {_N("hiragana")} hiragana, {_N("katakana")} katakana, {_N("kanji")} kanji, {_N("hangul")} hangul, {_N("viet")} viet, len(regexp_extract_all(x, '\\p{{L}}')) l, len(regexp_extract_all(x, '[\\p{{Nd}}①]')) digits from d),
m as (select *, l - hiragana - katakana - kanji - hangul - viet latin, hiragana + katakana > 0 kana from n),
f as (select *, case when kana then 'ja' when hangul > 0 then 'ko' when kanji > 0 then 'zh' when viet > 0 then 'vi' when latin > 0 then 'en' else 'unknown' end one, (kana or kanji > 0)::int + (hangul > 0)::int + (latin > 0)::int families from m)
select doc_id, case when families >= 2 and one <> 'ja' then 'mixed' else one end primary_script, hiragana > 0 has_hiragana, katakana > 0 has_katakana, kanji > 0 has_kanji, hangul > 0 has_hangul, kanji > 0 and not kana has_hanzi_only,
  latin > 0 has_latin, viet > 0 has_vietnamese_diacritic, digits > 0 has_digit, hiragana::int hiragana, katakana::int katakana, kanji::int kanji, hangul::int hangul, latin::int latin, viet::int vietnamese_diacritic, digits::int digits from f""")
def script_flags(s, d):
    """Flags and counts by script of texts in several scripts: a snippet by id, and at odd ids the document after it."""
    x = F.concat(F.get(F.array(*map(F.lit, SNIPPETS)), (F.col("doc_id") % 7).cast("int")), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit(" "), "text")))
    p = D.table(s, d, "documents").select("doc_id", F.inline(F.array(T.script_profile(x))))
    flags = [c for c in p.columns if c.startswith("has_") and c != "has_punct"]
    return p.select("doc_id", F.col("primary").alias("primary_script"), *flags, "counts.*", "digits")


@query(rf"""with recursive c as (select conv_id, turn, role, text, coalesce(lead(text) over (partition by conv_id order by turn, role, text), '') tgt, row_number() over () id from conversations),
n as (select id, tgt, regexp_extract_all(regexp_replace(text, '[^\x00-\x7f\P{{L}}]', '_', 'g'), '\b[A-Z][A-Za-z]{{2,15}}(?:-[A-Za-z]+)?\b') names from c),
f as (select id, 1 i, tgt, list_filter(names, lambda x: not contains(x, '-')) names from n
  union all select id, i + 1, case when contains(tgt, names[i]) and not contains(tgt, names[i] || '-san') then substr(tgt, 1, strpos(tgt, names[i]) + length(names[i]) - 1) || '-san' || substr(tgt, strpos(tgt, names[i]) + length(names[i])) else tgt end, names from f where i <= len(names)),
l as (select id, arg_max(tgt, i) fixed from f group by 1) select conv_id, turn, role, fixed from c join l using (id)""")
def honorific_fix(s, d):
    """Every name of a turn (of up to sixteen letters, without a hyphen) with a suffix, and the next turn as its translation."""
    rows = R._pairs(s, d)
    return rows.select("conv_id", "turn", "role", T.keep_honorifics(F.regexp_replace("src", r"\b[A-Z][A-Za-z]{2,15}\b(?!-)(?<!-)", "$0-san"), F.col("tgt")).alias("fixed"))


SHOUTS = ["あ!", "ドン", "漢字!", "カナ字", "한글", "ん", "え?!", "OK", "あいうえおか", "", "BANG!", "Hm"]
_SHORT = f"""p as (select p_partkey id, [{", ".join(f"'{x}'" for x in SHOUTS)}][p_partkey%12+1] || case when p_partkey//12%3=0 then ' ' || p_name else '' end t, p_partkey%2 cls, 20+(p_partkey*17)%200 w, 20+(p_partkey*29)%230 h, p_size=7 lost, p_partkey from part)"""


@query(rf"""with {_SHORT}, q as (select *, case when lost then '' else t end x, not lost and t = '' failed from p),
n as (select *, {_N("hiragana")} hira, {_N("katakana")} kata, {_N("kanji")} kanji, {_N("hangul")} hangul, len(regexp_extract_all(x, '\p{{L}}')) l, len(regexp_extract_all(x, '[!-/:-@\[-`{{-~]')) punct from q),
m as (select *, hira+kata > 0 kana, l-hira-kata-kanji-hangul latin, length(x) len from n),
c as (select *, case when kana then 'ja' when hangul > 0 and latin+kanji = 0 then 'ko' when kanji > 0 and latin+hangul = 0 then 'zh' when hangul+kanji > 0 then 'mixed' when latin > 0 then 'en' else 'unknown' end script,
  w::double*h/{float(W * H)} share, h::double/w aspect from m),
k as (select *, case when cls=0 and len>0 and l>=2 then 1 when cls=1 and aspect<=0.6 and len>=12 then 2 when cls=1 and ((script in ('ja','zh') and latin=0) or share>=0.025 or (share>=0.025*0.6 and l<4)) then 3
  when cls=1 and (l<=3 or (punct>0 and l<=3)) then 4 when cls=0 and l<=3 and len>0 and l>=1 then 5 when cls=1 then 6 else 7 end k from c)
select id//8 page_id, (id%8)::int block_idx, case when failed then 'unknown' when k in (3,4) then 'sfx' when k in (2,6) then 'narration' else 'dialogue' end as role,
  case when k in (3,4,5) then {R._subtype("x")} else 'unknown' end sfx_subtype, not failed should_translate, failed or k in (3,4) preserve from k""")
def short_text_roles(s, d):
    """Roles of short texts in several scripts; blocks of one size of part have no recognised row, blank ones failed."""
    shout = F.get(F.array(*map(F.lit, SHOUTS)), (F.col("p_partkey") % 12).cast("int"))
    t = F.concat(shout, F.when(F.col("p_partkey") / 12 % 3 < 1, F.concat(F.lit(" "), "p_name")).otherwise(""))
    rows = D.table(s, d, "part").select(
        (F.floor(F.col("p_partkey") / 8)).alias("page_id"), (F.col("p_partkey") % 8).cast("int").alias("block_idx"), F.lit(0).alias("x1"), F.lit(0).alias("y1"), (20 + (F.col("p_partkey") * 17) % 200).cast("int").alias("x2"),
        (20 + (F.col("p_partkey") * 29) % 230).cast("int").alias("y2"), (F.col("p_partkey") % 2).cast("int").alias("cls"), t.alias("text"), "p_size",
    )
    read = rows.where("p_size <> 7").select("page_id", "block_idx", "text", F.lit(0.5).alias("ocr_conf"), (F.col("text") == "").alias("ocr_failed"))
    return B.roles(rows, read, W, H).select("page_id", "block_idx", "role", "sfx_subtype", "should_translate", "preserve")
