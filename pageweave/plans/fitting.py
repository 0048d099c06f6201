"""Queries of fitting, pixels, prompts, rates and checkpoints; importing the module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageweave.functions import text as T
from pageweave.operators import blocks as B
from pageweave.operators import events as E
from pageweave.operators import fitting as P
from pageweave.operators import language as L
from pageweave.operators import state as S
from pageweave.plans import registry as R
from pageweave.plans.registry import BLOCKS, CACHE, EVENTS, ORACLES, ROLES, SP, STRIP, H, W, query
from pageweave.sources import tables as D

# ---- texts


@query(rf"""with c as (select conv_id, turn, role, {STRIP("text || case turn % 3 when 0 then '__' when 1 then ';:' else '' end")} t from conversations),
w as (select *, string_split(regexp_replace(regexp_replace(regexp_replace(t, '_+$', '.'), '[;:]+$', '.'), '{SP}+', ' ', 'g'), ' ') w from c)
select conv_id, turn, role, case when regexp_matches(t, '[\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{9fff}}\x{{ac00}}-\x{{d7af}}]') then t
  else array_to_string(list_transform(list_filter(list_zip(w, list_prepend(null, w)), lambda p: not (len(p[1]) > 3 and lower(p[1]) = lower(coalesce(p[2], '')))), lambda p: p[1]), ' ') end clean from w""")
def clean_ocr(s, d):
    end = F.element_at(F.array(F.lit("__"), F.lit(";:"), F.lit("")), (F.col("turn") % 3 + 1).cast("int"))
    return D.table(s, d, "conversations").select("conv_id", "turn", "role", T.clean_ocr(F.concat("text", end)).alias("clean"))


@query(f"with w as (select unnest(regexp_split_to_array({STRIP('text')}, '{SP}+')) w from conversations), n as (select w, count(*) c from w group by 1) select {R._subtype('w')} sfx_subtype, count(*) n_words, sum(c)::bigint n_uses from n group by 1")
def sfx_subtype(s, d):
    """Sub-types of the words of all conversations; each distinct word is judged once."""
    found = D.table(s, d, "conversations").select(F.explode(F.split(T.strip(F.col("text")), f"[{T.SPACE}]+")).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    return found.groupBy(T.sfx_subtype(F.col("w")).alias("sfx_subtype")).agg(F.count("*").alias("n_words"), F.sum("c").alias("n_uses"))


@query(f"with {ROLES}, turns as ({ORACLES['speaker_turns'].replace(f'with {BLOCKS}, ', 'with ')}) select page_id, block_idx, '[' || case role when 'narration' then 'NAR' when 'sfx' then 'SFX' else 'DLG' end || '|' || turn || '] ' || t prompt from roles join turns using (page_id, block_idx)")
def prompt_tags(s, d):
    roles = B.roles(D.blocks(s, d), D.ocr(s, d), W, H).select("page_id", "block_idx", "role", "t")
    turns = B.speaker_turns(B.reading_order(D.blocks(s, d), H), W, H).select("page_id", "block_idx", "turn")
    return roles.join(turns, ["page_id", "block_idx"]).select("page_id", "block_idx", T.prompt_tag(F.col("role"), F.col("turn"), F.col("t")).alias("prompt"))


# ---- fitting

CAP = "case when cls=1 then 1.0 when greatest(w,h)::double/least(w,h) >= 1.5 then case when least(w,h) < 60 then 1.0 else 1.1 end when least(w,h) < 60 then 0.95 else 0.85 end"


@query(f"with {BLOCKS}, b as (select *, x2-x1 w, y2-y1 h, (x2-x1)*(1+doc_id%4) bw, (y2-y1)*(1+doc_id%3) bh from blocks), c as (select *, greatest(floor(least(w,h)*({CAP})::double), 24) cap, (bw*bh)::double/(w*h) room from b) select page_id, block_idx, least(90, greatest(12, case when cls<>1 and room > 5 then floor(cap*least(sqrt(room/5), 1.5)) else cap end))::int size from c")
def font_cap(s, d):
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    cap = P.font_cap(8, 90, w, h, w * (1 + F.col("doc_id") % 4), h * (1 + F.col("doc_id") % 3), F.col("cls") == 1)
    return D.blocks(s, d).select("page_id", "block_idx", cap.alias("size"))


BUBBLE = "struct(x1 - doc_id % 40 + 3 as x1, y1 - doc_id % 60 + 3 as y1, x2 + doc_id % 300 - 3 as x2, y2 + doc_id % 50 as y2)"


@query(f"""with {BLOCKS}, b as (select *, x1-doc_id%40+3 bx1, y1-doc_id%60+3 by1, x2+doc_id%300-3 bx2, y2+doc_id%50 by2 from blocks)
select page_id, block_idx, bx1<=x1 and by1<=y1 and bx2>=x2 and by2>=y2 and greatest(abs((bx1+bx2)/2.0-(x1+x2)/2.0)/greatest(1,x2-x1), abs((by1+by2)/2.0-(y1+y2)/2.0)/greatest(1,y2-y1)) <= 1.5 and (bx2-bx1)*(by2-by1) <= 0.12*{W}*{H} trusted from b""")
def trusted_interior(s, d):
    b = D.blocks(s, d).withColumn("bubble", F.expr(BUBBLE)).withColumn("box", F.struct(*B.BOX))
    bubble = F.col("bubble")
    pixels = (bubble["x2"] - bubble["x1"]) * (bubble["y2"] - bubble["y1"])
    return b.select("page_id", "block_idx", P.trusted(F.col("box"), bubble, pixels, W, H).alias("trusted"))


@query(f"with l as (select l_orderkey page_id, (l_linenumber%2)::int block_idx, l_linenumber::bigint as label, l_partkey*60 area, l_suppkey%5 overlap, 200 w, 100 h, l_extendedprice p from lineitem) select page_id, block_idx, arg_max(label, (overlap, -label)) as label, max(overlap) overlap from l where area >= 6000 and area <= 0.15*{W}*{H} and overlap > 0 group by 1, 2")
def best_label(s, d):
    labels = D.table(s, d, "lineitem").selectExpr("l_orderkey page_id", "cast(l_linenumber % 2 as int) block_idx", "cast(l_linenumber as bigint) label", "l_partkey * 60 area", "l_suppkey % 5 overlap", "200 w", "100 h")
    return P.best_label(labels, W, H)


@query(f"with e as ({ORACLES['longest_run']}), k as (select page_id, xmax-xmin w from e qualify xmax-xmin >= 0.5 * max(xmax-xmin) over (partition by page_id)), g as (select page_id, list_sort(list(w)) w from k group by 1) select page_id, len(w) n_rows, w[len(w)//2+1] median_w from g")
def row_widths(s, d):
    return P.row_widths(B.longest_runs(D.pixels(s, d)))


@query(f"""with {BLOCKS}, p as (select event_id, event_id//80 page_id, (event_id%8)::int block_idx, (event_id*31)%{W} x, (event_id*47)%{H} y from events),
d as (select p.*, b.block_idx other, greatest(greatest(0, b.x1-x, x-b.x2), greatest(0, b.y1-y, y-b.y2)) far from p join blocks b using (page_id))
select event_id, page_id, block_idx, x, y from (select *, max(far) filter (where other = block_idx) over (partition by event_id) own, min(far) over (partition by event_id) nearest from d) where other = block_idx and own <= nearest""".replace("b using (page_id)", "b on b.page_id = p.page_id").replace("d as (select p.*", "d as (select p.event_id, p.page_id, p.block_idx, p.x, p.y"))
def own_pixels(s, d):
    pixels = D.table(s, d, "events").selectExpr("event_id", "event_id div 80 page_id", "cast(event_id % 8 as int) block_idx", f"(event_id*31)%{W} x", f"(event_id*47)%{H} y")
    return P.own_pixels(pixels, D.blocks(s, d))


LIGHT = "case l_suppkey % 4 when 0 then 100 + l_partkey % 5 when 1 then 3 * (l_partkey % 24) + 2 * (l_orderkey % 64) + l_linenumber % 3 else l_partkey * 7 % 255 end"


@query(f"""with r as (select l_suppkey page_id, (l_partkey%24)::double x, (l_orderkey%64)::double y, ({LIGHT})::double light from lineitem),
m as (select page_id, count(light) n, stddev_pop(light) std, quantile_cont(light, 0.5) median, covar_pop(x,x) xx, covar_pop(y,y) yy, covar_pop(x,y) xy, covar_pop(x,light) xl, covar_pop(y,light) yl from r group by 1),
k as (select *, case when n < 20 then 'TEXTURE' when std < 8 then 'SOLID' when sqrt(greatest(std*std - case when xx*yy-xy*xy > 1e-9 then (xl*xl*yy - 2*xl*yl*xy + yl*yl*xx)/(xx*yy-xy*xy) else greatest(coalesce(xl*xl/nullif(xx,0),0), coalesce(yl*yl/nullif(yy,0),0)) end, 0)) < 6 then 'GRADIENT' else 'TEXTURE' end kind from m)
select page_id, n, kind, case when kind <> 'TEXTURE' then median end median from k""")
def fill_kind(s, d):
    return P.fill_kind(D.table(s, d, "lineitem").selectExpr("l_suppkey page_id", "cast(l_partkey % 24 as double) x", "cast(l_orderkey % 64 as double) y", f"cast({LIGHT} as double) light"))


def _split_sql(rounds: int) -> str:
    """Gaps along y and x in turn; a page's eight components can part seven times at most, with a round along the other axis before each."""
    steps, last = [], "p0"
    for i in range(2 * rounds):
        lo, hi = ("y1", "y2") if i % 2 == 0 else ("x1", "x2")
        steps.append(f"q{i} as (select *, case when {lo} - max({hi}) over (partition by page_id, part order by {lo}, comp_id rows between unbounded preceding and 1 preceding) > 20 then 1 else 0 end nw from {last})")
        steps.append(f"p{i + 1} as (select * exclude (nw, part), part || '.' || (sum(nw) over (partition by page_id, part order by {lo}, comp_id))::bigint part from q{i})")
        last = f"p{i + 1}"
    return f"""with {BLOCKS}, p0 as (select page_id, doc_id comp_id, x1//2 x1, y1//2 y1, x2//2 - 20 x2, y2//2 - 10 y2, '' part from blocks), {", ".join(steps)}
    select page_id, 0::int block_idx, min(comp_id) first_comp, count(*) n_comps, greatest(0, min(x1) - 4)::bigint x1, greatest(0, min(y1) - 4)::bigint y1, (max(x2) + 4)::bigint x2, (max(y2) + 4)::bigint y2 from {last} group by page_id, part"""


@query(_split_sql(7))
def split_regions(s, d):
    c = D.blocks(s, d).selectExpr("page_id", "0 as block_idx", "doc_id as comp_id", "cast(x1 div 2 as int) x1", "cast(y1 div 2 as int) y1", "cast(x2 div 2 - 20 as int) x2", "cast(y2 div 2 - 10 as int) y2", "40 + doc_id area")
    return P.split_regions(c)


@query(f"""with r as (select doc_id//8 page_id, doc_id box_id, (doc_id%100)/100.0::double objectness, ((doc_id*7)%10)/10.0::double c0, ((doc_id*3)%10)/10.0::double c1, (doc_id*37)%700 x1, (doc_id*53)%1000 y1, (doc_id*37)%700 + (doc_id*17)%160 x2, (doc_id*53)%1000 + (doc_id*29)%270 y2 from documents),
b as (select page_id, box_id, objectness*greatest(c0,c1) score, (case when c0>=c1 then 0 else 1 end)::int cls, trunc(least(greatest((x1-10)/0.75::double,0),{W}))::int x1, trunc(least(greatest((y1-20)/0.75::double,0),{H}))::int y1, trunc(least(greatest((x2-10)/0.75::double,0),{W}))::int x2, trunc(least(greatest((y2-20)/0.75::double,0),{H}))::int y2 from r)
select *, row_number() over (partition by page_id order by y1, x1 desc, box_id)::int raw_pos from b where score > 0.4 and x2-x1 >= 5 and y2-y1 >= 5""")
def detections(s, d):
    raw = D.table(s, d, "documents").selectExpr(
        "doc_id div 8 page_id", "doc_id box_id", "(doc_id % 100) / 100.0D objectness", "array(((doc_id*7)%10)/10.0D, ((doc_id*3)%10)/10.0D) classes", "(doc_id*37)%700 x1", "(doc_id*53)%1000 y1",
        "(doc_id*37)%700 + (doc_id*17)%160 x2", "(doc_id*53)%1000 + (doc_id*29)%270 y2", "0.75D scale", "10 pad_x", "20 pad_y",
    )
    return P.detections(raw, W, H)


# ---- languages, rates, counters, checkpoints


@query(f"with d as ({ORACLES['language_detect']}) select page_id, (select arg_min(lang, page_id) from d) lang from d")
def language_first_page(s, d):
    return L.first_page(L.detect(R._scores(s, d)))


@query("select event_id, greatest(5, (event_id%40)//2)::bigint slower, (case when event_id%200 >= 60 and event_id%20 < 15 then least(15, event_id%20 + (event_id%200-60)//60 + 1) else event_id%20 end)::bigint faster from events")
def aimd_rpm(s, d):
    rpm = F.col("event_id") % 20
    return D.table(s, d, "events").select("event_id", E.slower(F.col("event_id") % 40).cast("bigint").alias("slower"), E.faster(rpm, F.col("event_id") % 200, F.lit(15)).cast("bigint").alias("faster"))


@query("select event_id, (case event_id%4 when 0 then event_id%50 + 2 when 1 then event_id%9 + 2 when 2 then event_id%30 + 1 else 30 end)::int wait_s from events")
def retry_delay(s, d):
    """The waits that messages and headers of events name."""
    of = F.expr("""case event_id % 4 when 0 then concat('{"retryDelay": "', event_id % 50, '.7s"}') when 1 then concat('Try again in ', event_id % 9, 's') else 'busy' end""")
    header = F.expr("if(event_id % 4 = 2, concat(event_id % 30, '.5'), null)")
    return D.table(s, d, "events").select("event_id", T.retry_seconds(of, header).alias("wait_s"))


@query(f"with {EVENTS} select stage, arg_max(latency_ms, (ts, event_id)) as value from ev group by 1")
def gauges(s, d):
    return E.gauges(D.event_log(s, d))


@query(f"""with {EVENTS} select event_id, '{{"event_id":' || event_id || ',"page_id":' || page_id || ',"event":"' || event || '"' || case when event like 'stage%' then ',"stage":' || stage else '' end || '}}' line from ev""")
def event_lines(s, d):
    return E.lines(D.event_log(s, d))


@query(f"with {R.TASKS} select page_id from tasks where page_id not in ({R.SKIPPED} and p.last_error = '1-URGENT')")
def resume_digest(s, d):
    """Pages to run where only what the same configuration left behind counts."""
    return S.to_run(R._tasks(s, d), S.current(R._previous(s, d).withColumn("config_digest", F.col("last_error")), "1-URGENT"), R._outputs(s, d)).select("page_id")


@query(f"with {CACHE}, r as (select sha256('m1' || chr(0) || 'vi' || chr(0) || text) key from documents), h as (select r.key, cache.key is not null hit from r left join cache using (key)) select count(*) filter (where hit) hits, count(*) filter (where not hit) misses, count(distinct key) filter (where not hit) puts from h")
def cache_stats(s, d):
    requests = D.table(s, d, "documents").select(T.cache_key(F.lit("m1"), F.lit("vi"), F.col("text")).alias("key"))
    return S.cache_stats(S.lookup(requests, R._cache(s, d)))
