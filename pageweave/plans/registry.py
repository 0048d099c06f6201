"""All registered queries over the driver's tables, and the DuckDB text of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageweave.functions import geometry as G
from pageweave.functions import text as T
from pageweave.operators import blocks as B
from pageweave.operators import events as E
from pageweave.operators import language as L
from pageweave.operators import state as S
from pageweave.sources import tables as D

W, H = D.PAGE_W, D.PAGE_H
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The derived tables again, for DuckDB.
BLOCKS = "blocks as (select doc_id//8 page_id, (doc_id%8)::int block_idx, ((doc_id*37)%700)::int x1, ((doc_id*53)%1000)::int y1, ((doc_id*37)%700+40+(doc_id*17)%160)::int x2, ((doc_id*53)%1000+30+(doc_id*29)%270)::int y2, (case when doc_id%5=0 then 1 else 0 end)::int cls, text, doc_id from documents)"
DENSE = "dense as (select doc_id//20 page_id, (doc_id%20)::int block_idx, x::int x1, y::int y1, (x+40+(doc_id*17)%160)::int x2, (y+30+(doc_id*29)%270)::int y2 from (select doc_id, (doc_id*37)%240 x, (doc_id*53)%360 y from documents))"
OCR = BLOCKS + ", ocr as (select page_id, block_idx, x1, y1, x2, y2, cls, (doc_id%100)/100.0::double ocr_conf, text, coalesce(length(text),0)=0 ocr_failed, doc_id from blocks)"
TR = OCR + ", tr as (select page_id, block_idx, case doc_id%7 when 0 then '' when 1 then '...' when 2 then '…' when 3 then '???' else upper(text) end translated from ocr)"
EVENTS = "ev as (select event_id, ts, user_id page_id, case event_type when 'view' then 'stage_start' when 'click' then 'stage_end' when 'error' then 'stage_error' when 'purchase' then case when event_id%9=0 then 'page_skip_resume' else 'page_done' end else case when event_id%7=0 then 'stage_freeze' else 'page_failed' end end as event, (event_id%11)::int stage, value latency_ms, case when event_type in ('error','signup') then case when event_id%3=0 then 'OutOfMemoryError' else 'ValueError' end end error_type, case when event_type in ('error','signup') then 'step ' || event_id || case when event_id%5=0 then ': out of memory' else '' end end error_msg from events)"
# Pages are customers: a checkpoint of the last order of each, new tasks for all, and the outputs that orders have left.
STAGE_LIST = "['" + "','".join(E.STAGES) + "']"
TASKS = f"""prev as (select o_custkey page_id, 'in/' || o_custkey || '.png' input_path, case when o_orderkey%5=0 then '' else 'out/' || o_custkey || '_' || o_orderkey%2 || '.png' end output_path, case o_orderstatus when 'F' then 'DONE' when 'O' then 'RUNNING' else 'FAILED' end state,
  case when o_orderstatus='O' then {STAGE_LIST}[o_orderkey%11+1] end current_stage, {STAGE_LIST}[1:o_orderkey%12] completed_stages, (o_orderkey%3)::int retries, case when o_orderkey%4>1 then {STAGE_LIST}[o_orderkey%11+1] || '=' || o_orderkey%4 else '' end stage_retries, (o_orderkey%4)::int oom_retries,
  case when o_orderkey%4>0 then ['cpu_inpaint'] else []::varchar[] end fallback_flags, o_orderpriority last_error, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000000Z') started_ts, case when o_orderstatus<>'O' then strftime(o_orderdate + interval 90 second, '%Y-%m-%dT%H:%M:%S.000000Z') end completed_ts
  from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc)=1),
tasks as (select c_custkey page_id, 'in/' || c_custkey || '.png' input_path, 'out/' || c_custkey || '_0.png' output_path from customer),
outputs as (select distinct 'out/' || o_custkey || '_' || o_orderkey%2 || '.png' path from orders where o_orderkey%4<>0)"""
AREA = "((x2-x1)*(y2-y1))::bigint"


def query(sql: str | None = None):
    """Registers a query under its name, with the DuckDB text that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _previous(s: SparkSession, d: str) -> DataFrame:
    last = D.table(s, d, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate"), "o_orderkey").alias("o")).select("o_custkey", "o.*")
    stages = "array('" + "','".join(E.STAGES) + "')"
    at = lambda ts: f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
    return last.selectExpr(
        "o_custkey as page_id", "concat('in/', o_custkey, '.png') input_path", "if(o_orderkey % 5 = 0, '', concat('out/', o_custkey, '_', o_orderkey % 2, '.png')) output_path",
        "case o_orderstatus when 'F' then 'DONE' when 'O' then 'RUNNING' else 'FAILED' end as state", f"if(o_orderstatus = 'O', {stages}[cast(o_orderkey % 11 as int)], null) current_stage", f"slice({stages}, 1, cast(o_orderkey % 12 as int)) completed_stages",
        "cast(o_orderkey % 3 as int) retries", f"if(o_orderkey % 4 > 1, map({stages}[cast(o_orderkey % 11 as int)], cast(o_orderkey % 4 as int)), cast(map() as map<string,int>)) stage_retries", "cast(o_orderkey % 4 as int) oom_retries",
        "if(o_orderkey % 4 > 0, array('cpu_inpaint'), cast(array() as array<string>)) fallback_flags", "o_orderpriority as last_error", f"{at('o_orderdate')} started_ts", f"if(o_orderstatus <> 'O', {at('o_orderdate + interval 90 second')}, null) completed_ts",
    )


def _tasks(s: SparkSession, d: str) -> DataFrame:
    return S.new_tasks(D.table(s, d, "customer").selectExpr("c_custkey as page_id", "concat('in/', c_custkey, '.png') input_path", "concat('out/', c_custkey, '_0.png') output_path"))


def _outputs(s: SparkSession, d: str) -> DataFrame:
    return D.table(s, d, "orders").where("o_orderkey % 4 <> 0").selectExpr("concat('out/', o_custkey, '_', o_orderkey % 2, '.png') path")


def _flat(tasks: DataFrame) -> DataFrame:
    """Retries of stages as text, so that rows compare."""
    return tasks.withColumn("stage_retries", F.array_join(F.transform(F.map_entries("stage_retries"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


# ---- regions of a page

ORDER = f"ord as (select *, row_number() over (partition by page_id order by ((y1+y2)//2)//325, -((x1+x2)//2), block_idx) reading_pos from blocks)"


@query(f"with {BLOCKS}, {ORDER} select page_id, block_idx, reading_pos from ord")
def reading_order(s, d):
    return B.reading_order(D.blocks(s, d), H).select("page_id", "block_idx", "reading_pos")


@query(f"with {BLOCKS}, {ORDER}, n as (select *, case when ((y1+y2)//2)//234 <> lag(((y1+y2)//2)//234) over w then 1 when lag(1) over w is null then 1 else 0 end nw from ord window w as (partition by page_id order by reading_pos)) select page_id, block_idx, reading_pos, 'turn' || (sum(nw) over (partition by page_id order by reading_pos))::bigint || '-' || case when (x1+x2)//2 > 450 then 'right' else 'left' end turn from n")
def speaker_turns(s, d):
    return B.speaker_turns(B.reading_order(D.blocks(s, d), H), W, H).select("page_id", "block_idx", "reading_pos", "turn")


@query(f"with {BLOCKS} select page_id, block_idx, (case when (y1+y2)/2.0 < {H}/3.0 then 'top' when (y1+y2)/2.0 > 2*{H}/3.0 then 'bottom' else 'middle' end) || '-' || (case when (x1+x2)/2.0 > 2*{W}/3.0 then 'right' when (x1+x2)/2.0 < {W}/3.0 then 'left' else 'center' end) position_tag from blocks")
def position_tag(s, d):
    return D.blocks(s, d).select("page_id", "block_idx", G.position_tag(*[F.col(c) for c in B.BOX], W, H).alias("position_tag"))


@query(f"with {BLOCKS} select page_id, block_idx, least(greatest(x1-500,0),{W - 1})::int x1, least(greatest(y1-2,0),{H - 1})::int y1, greatest(least(greatest(x1-500,0),{W - 1})+1, least(x2+700,{W}))::int x2, greatest(least(greatest(y1-2,0),{H - 1})+1, least(y2+2,{H}))::int y2 from blocks")
def clamp_box(s, d):
    c = F.col
    return D.blocks(s, d).select("page_id", "block_idx", G.clamp_box(c("x1") - 500, c("y1") - 2, c("x2") + 700, c("y2") + 2, W, H).alias("b")).select("page_id", "block_idx", "b.*")


@query(f"with {DENSE} select a.page_id, a.block_idx a_idx, b.block_idx b_idx, (greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)::bigint*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0))::bigint inter from dense a join dense b on a.page_id=b.page_id and a.block_idx<b.block_idx where least(a.x2,b.x2)>greatest(a.x1,b.x1) and least(a.y2,b.y2)>greatest(a.y1,b.y1)")
def overlap_pairs(s, d):
    return B.overlap_pairs(D.dense_blocks(s, d))


def _greedy_sql(source: str, order: str, hit: str) -> str:
    inter = "(greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)::bigint*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0))"
    return f"""with recursive {source}, r as (select *, {AREA} ar, row_number() over (partition by page_id order by {order}) rk from src),
    s as (select b.page_id, b.rk, coalesce(list(a.rk) filter (where {hit.replace("INTER", inter)}), []) sup from r b left join r a on a.page_id=b.page_id and a.rk<b.rk group by 1,2),
    f as (select page_id, 1::bigint rk, [1::bigint] kept from r where rk=1
      union all select f.page_id, s.rk, case when list_has_any(f.kept, s.sup) then f.kept else list_append(f.kept, s.rk) end from f join s on s.page_id=f.page_id and s.rk=f.rk+1),
    l as (select page_id, arg_max(kept, rk) kept from f group by 1)
    select r.page_id, r.block_idx, r.x1, r.y1, r.x2, r.y2 from r join l on l.page_id=r.page_id and list_contains(l.kept, r.rk)"""


@query(_greedy_sql(f"{DENSE}, src as (select * from dense where x2>x1 and y2>y1)", f"{AREA} desc, block_idx", "INTER>0 and (INTER > 0.65*b.ar or INTER > 0.35*(a.ar+b.ar-INTER))"))
def dedupe_blocks(s, d):
    return B.dedupe_blocks(D.dense_blocks(s, d))


@query(_greedy_sql(f"{DENSE}, src as (select * from (select *, ((x1*7+y1*3)%100)/100.0::double score from dense) where score > 0.4)", "score desc, block_idx", "INTER > 0.45*(a.ar+b.ar-INTER)"))
def nms(s, d):
    return B.nms(D.dense_blocks(s, d).withColumn("score", F.expr("((x1*7+y1*3)%100)/100.0D")))


@query(f"with {BLOCKS}, n as (select *, max(y2) over (partition by page_id order by y1, block_idx rows between unbounded preceding and 1 preceding) far from blocks) select page_id, block_idx, (sum(case when y1-far > 20 then 1 else 0 end) over (partition by page_id order by y1, block_idx))::int gap_group from n")
def gap_groups(s, d):
    return B.gap_groups(D.blocks(s, d)).select("page_id", "block_idx", "gap_group")


@query(f"with {BLOCKS}, c as (select event_id//80 page_id, event_id comp_id, (event_id*31)%880 cx, (event_id*47)%1270 cy, 4+(event_id*13)%120 cw, 4+(event_id*17)%90 ch, (event_id*7)%4000 area, (event_id*11)%3000 raw_pixels, 150+(event_id%100) annulus_mean from events), k as (select * from c where area>=200 and cw>=8 and ch>=8 and cw*ch<=0.1*{W}*{H} and greatest(cw,ch)<=30*least(cw,ch) and raw_pixels>=0.05*cw*ch and annulus_mean>=185) select page_id, comp_id, greatest(cx-6,0) x1, greatest(cy-6,0) y1, least(cx+cw+6,{W}) x2, least(cy+ch+6,{H}) y2 from k where not exists (select 1 from blocks b where b.page_id=k.page_id and greatest(least(cx+cw,b.x2)-greatest(cx,b.x1),0)*greatest(least(cy+ch,b.y2)-greatest(cy,b.y1),0) > 0.4*cw*ch)")
def recover_blocks(s, d):
    c = D.table(s, d, "events").selectExpr("event_id div 80 as page_id", "event_id as comp_id", "(event_id*31)%880 cx", "(event_id*47)%1270 cy", "4+(event_id*13)%120 cw", "4+(event_id*17)%90 ch", "(event_id*7)%4000 area", "(event_id*11)%3000 raw_pixels", "150+(event_id%100) annulus_mean")
    return B.recover(c, D.blocks(s, d), W, H)


@query(f"""with {BLOCKS}, p as (select *, x2-x1 bw, y2-y1 bh, greatest(32, floor(least(x2-x1,y2-y1)*0.25)) m from blocks),
q as (select *, greatest(0,x1-greatest(floor(bw*0.5),m)) a, greatest(0,y1-greatest(floor(bh*0.5),m)) b, least({W},x2+greatest(floor(bw*0.5),m)) c, least({H},y2+greatest(floor(bh*0.5),m)) e from p),
r as (select *, greatest(c-a,e-b,256) side from q),
t as (select *, least({W}, greatest(0,a-floor((side-(c-a))/2))+side) ex, least({H}, greatest(0,b-floor((side-(e-b))/2))+side) ey from r)
select page_id, block_idx, (case when c-a<side then greatest(0,ex-side) else a end)::bigint tx1, (case when e-b<side then greatest(0,ey-side) else b end)::bigint ty1, (case when c-a<side then ex else c end)::bigint tx2, (case when e-b<side then ey else e end)::bigint ty2 from t""")
def tile_bounds(s, d):
    return D.blocks(s, d).select("page_id", "block_idx", G.tile(*[F.col(c) for c in B.BOX], W, H).alias("t")).select("page_id", "block_idx", "t.*")


INSET = "floor((b.x2-b.x1)*0.04::double)::bigint dx, floor((b.y2-b.y1)*0.04::double)::bigint dy"


@query(f"""with {DENSE}, p as (select a.page_id, a.block_idx, b.block_idx rect_idx, b.x1, b.y1, b.x2, b.y2, {INSET},
    greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)::bigint*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0) >= 0.5*greatest((a.x2-a.x1)*(a.y2-a.y1),1) fits
    from dense a join dense b on a.page_id=b.page_id and a.block_idx<>b.block_idx)
    select page_id, block_idx, rect_idx, x1+dx rx1, y1+dy ry1, x2-dx rx2, y2-dy ry2 from p where fits""")
def inscribed_fit(s, d):
    return B.inscribed_fits(D.dense_blocks(s, d), D.dense_blocks(s, d).withColumnRenamed("block_idx", "rect_idx")).where("block_idx <> rect_idx")


@query(f"with {BLOCKS} select page_id, count(*) n_blocks, avg(case when greatest(y2-y1,1)::double/greatest(x2-x1,1) >= 1.6 then 1.0 else 0.0 end) tall_share, avg(case when greatest(y2-y1,1)::double/greatest(x2-x1,1) >= 1.6 then 1.0 else 0.0 end) >= 0.4 is_vertical from blocks group by 1")
def layout_hint(s, d):
    return B.layout(D.blocks(s, d))


@query(f"with {BLOCKS} select page_id, block_idx, {AREA} area from blocks qualify row_number() over (partition by page_id order by {AREA} desc, ((x1*7+y1*3)%100)/100.0 desc, block_idx) <= 4")
def top4_sample(s, d):
    return B.largest(D.blocks(s, d).withColumn("score", F.expr("((x1*7+y1*3)%100)/100.0D")))


# ---- texts

SP = r"[\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STRIP = lambda x: f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


@query(rf"""with t as (select doc_id, regexp_replace(text, '{SP}|\d', '', 'g') b, len(regexp_extract_all(text, '\d')) digits from documents),
u as (select doc_id, digits, len(regexp_extract_all(b, '[^\p{{L}}]')) - len(regexp_extract_all(b, '[\x{{3000}}-\x{{10ffff}}]')) punct, len(regexp_extract_all(b, '\p{{L}}')) letters from t)
select doc_id, case when letters > 0 then 'en' else 'unknown' end primary_script, letters::int letters, punct::int punct, digits::int digits, letters between 1 and 3 and punct >= 1 is_short_sfx from u""")
def script_profile(s, d):
    p = D.table(s, d, "documents").select("doc_id", T.script_profile(F.col("text")).alias("p"))
    return p.select("doc_id", F.col("p.primary").alias("primary_script"), "p.letters", "p.punct", "p.digits", "p.is_short_sfx")


@query(r"select doc_id, regexp_matches(text, '[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}]') has_cjk, len(regexp_extract_all(text, '[A-Za-z]')) >= 2 has_latin from documents")
def has_cjk_latin(s, d):
    return D.table(s, d, "documents").select("doc_id", T.has_cjk(F.col("text")).alias("has_cjk"), T.has_latin_letters(F.col("text")).alias("has_latin"))


@query("select doc_id, " + STRIP(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, 'e', '?'), '\.{{4,}}', '...', 'g'), '\?{{3,}}', '??', 'g'), '[?!]{{4,}}', '?!', 'g'), '{SP}+([!?,.])', '\1', 'g')") + " as clean from documents")
def sanitize_punct(s, d):
    return D.table(s, d, "documents").select("doc_id", T.sanitize_punctuation(F.replace("text", F.lit("e"), F.lit("?"))).alias("clean"))


@query(f"with t as (select conv_id, turn, role, string_split(regexp_replace({STRIP('text')}, '{SP}+', ' ', 'g'), ' ') w from conversations) select conv_id, turn, role, array_to_string(list_transform(list_filter(list_zip(w, list_prepend(null, w)), lambda p: not (len(p[1]) > 3 and lower(p[1]) = lower(coalesce(p[2], '')))), lambda p: p[1]), ' ') clean from t")
def dedup_words(s, d):
    return D.table(s, d, "conversations").select("conv_id", "turn", "role", T.dedupe_words(F.col("text")).alias("clean"))


GIBBERISH = r"(length(x) < 2 or len(regexp_extract_all(x, '\p{L}')) = 0 or (length(x) <= 4 and len(regexp_extract_all(x, '\p{L}')) < 0.4*length(x)))"


@query(
    f"""with t as (select doc_id, {STRIP("text")} t from documents), u as (select doc_id, t, regexp_replace(t, '{SP}', '', 'g') b from t)
select doc_id, length(t) < 2 or len(regexp_extract_all(b, '\\p{{L}}')) = 0 or (length(b) <= 4 and len(regexp_extract_all(b, '\\p{{L}}')) < 0.4*length(b)) gibberish,
  len(list_filter(regexp_split_to_array(t, '{SP}+'), lambda x: x <> '' and {GIBBERISH}))::int n_gibberish_words from u"""
)
def gibberish(s, d):
    """Of the whole text, and of each of its words."""
    return D.table(s, d, "documents").select("doc_id", T.is_gibberish(F.col("text")).alias("gibberish"), T.gibberish_words(F.col("text")).alias("n_gibberish_words"))


@query("select encode_key.doc_id, key from (select doc_id, sha256('m1' || chr(0) || 'vi' || chr(0) || text) key from documents) encode_key")
def cache_key(s, d):
    return D.table(s, d, "documents").select("doc_id", T.cache_key(F.lit("m1"), F.lit("vi"), F.col("text")).alias("key"))


def _words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _subtype(t: str) -> str:
    """Sub-type of an effect for DuckDB; t names a text column."""
    bare = rf"regexp_replace(lower({STRIP(t)}), '^[?!.,''\"]+|[?!.,''\"]+$', '', 'g')"
    chars = f"string_split({bare}, '')"
    compact = f"array_to_string(list_transform(list_filter(list_zip({chars}, list_prepend(null, {chars})), lambda p: p[1] is distinct from p[2]), lambda p: p[1]), '')"
    return rf"""case when {bare} = '' then 'unknown' when {bare} in ({_words(T.EMOTION)}) or {compact} in ({_words(T.EMOTION)}) or regexp_matches({bare}, '^({"|".join(T.EMOTION)})') then 'emotion'
      when {bare} in ({_words(T.ACTION)}) or {compact} in ({_words(T.ACTION)}) then 'action' when {bare} in ({_words(T.AMBIENT)}) or {compact} in ({_words(T.AMBIENT)}) then 'ambient'
      when regexp_matches({t}, '[\x{{4e00}}-\x{{9fff}}\x{{3400}}-\x{{4dbf}}]') and regexp_matches({t}, '[!-/:-@\[-`{{-~…]') then 'action'
      when regexp_matches({t}, '[\x{{30a0}}-\x{{30ff}}\x{{31f0}}-\x{{31ff}}]') and not regexp_matches({t}, '[\x{{3040}}-\x{{309f}}]') then 'action' when regexp_matches({t}, '[\x{{3040}}-\x{{309f}}]') then 'ambient' else 'unknown' end"""


ROLES = OCR + f""", profile as ({ORACLES["script_profile"].replace("with t as", "with pt as").replace("from t)", "from pt)")}),
rr as (select b.page_id, b.block_idx, coalesce(o.text, '') t, coalesce(o.ocr_failed, false) failed, coalesce(p.letters, 0) letters, coalesce(p.punct, 0) punct, b.cls, len(regexp_extract_all(coalesce(o.text, ''), '\\p{{L}}')) n,
  (b.x2-b.x1)::bigint*(b.y2-b.y1)/{float(W * H)}::double share, greatest(b.y2-b.y1,1)::double/greatest(b.x2-b.x1,1) aspect
  from blocks b left join ocr o on o.page_id=b.page_id and o.block_idx=b.block_idx left join profile p on p.doc_id=b.doc_id),
rule as (select *, case when cls=0 and length(t)>0 and letters>=2 then 1 when cls=1 and aspect<=0.6::double and length(t)>=12 then 2
  when cls=1 and (share>=0.025::double or (share>=0.025::double*0.6::double and n<4)) then 3 when cls=1 and (n<=3 or (punct>0 and letters<=3)) then 4
  when cls=0 and n<=3 and length(t)>0 and letters>=1 then 5 when cls=1 then 6 else 7 end k from rr),
roles as (select page_id, block_idx, t, case when failed then 'unknown' when k in (3,4) then 'sfx' when k in (2,6) then 'narration' else 'dialogue' end as role,
  case when k in (3,4,5) then {_subtype("t")} else 'unknown' end sfx_subtype, not failed should_translate, failed or k in (3,4) preserve, k in (3,4) profile_preserve from rule)"""


@query(f"with {ROLES} select * from roles")
def sfx_role(s, d):
    return B.roles(D.blocks(s, d), D.ocr(s, d), W, H)


@query(f"with {TR} select page_id, block_idx, trim(translated) <> '' and translated not in ('...','…','???') as is_real from tr")
def real_translation(s, d):
    return D.translations(s, d).select("page_id", "block_idx", T.is_real_translation(F.col("translated")).alias("is_real"))


@query(f"with {ROLES}, {TR.split(', ocr as')[1].split(', tr as', 1)[1].join(['tr as', ''])} select r.page_id, r.block_idx from roles r left join tr t on t.page_id=r.page_id and t.block_idx=r.block_idx where r.profile_preserve or (regexp_matches(r.t, '[\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}\\x{{ac00}}-\\x{{d7a3}}]') and len(regexp_extract_all(r.t, '[A-Za-z]')) < 2 and coalesce(trim(t.translated) in ('', '...', '…', '???'), true))")
def preserve_blocks(s, d):
    return B.preserved(B.roles(D.blocks(s, d), D.ocr(s, d), W, H), D.translations(s, d))


@query(f"with {TR} select b.page_id, count(*) n_blocks, count(o.block_idx) n_ocr, count(*) filter (where length(t.translated) > 0) n_translated, count(*) filter (where b.cls=0) n_filled from blocks b left join ocr o on o.page_id=b.page_id and o.block_idx=b.block_idx left join tr t on t.page_id=b.page_id and t.block_idx=b.block_idx group by 1")
def page_summary(s, d):
    o = D.ocr(s, d).select("page_id", "block_idx", F.lit(1).alias("read"))
    joined = D.blocks(s, d).select("page_id", "block_idx", "cls").join(o, ["page_id", "block_idx"], "left").join(D.translations(s, d), ["page_id", "block_idx"], "left")
    return joined.groupBy("page_id").agg(F.count("*").alias("n_blocks"), F.count("read").alias("n_ocr"), F.count_if(F.length("translated") > 0).alias("n_translated"), F.count_if(F.col("cls") == 0).alias("n_filled"))


_COMMON = ", ".join(f"'{w.lower()}'" for w in S.COMMON_WORDS)


PAIRS = rf"""c as (select *, lead(text) over (partition by conv_id order by turn, role, text) tgt, row_number() over (partition by conv_id order by turn, role, text) ord from conversations),
n as (select *, unnest(list_distinct(regexp_extract_all(regexp_replace(text, '[^\x00-\x7f\P{{L}}]', '_', 'g'), '\b[A-Z][A-Za-z]{{2,}}(?:-[A-Za-z]+)?\b'))) as term from c where text <> '' and tgt <> ''),
h as (select *, upper(substr(term, 1, 1)) || lower(substr(term, 2)) cap, case when contains(tgt, term) then term when contains(tgt, cap) then cap end dst from n where lower(term) not in ({_COMMON})),
found as (select * from h where dst is not null)"""


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """Every turn of a conversation (a page) and the next one as its translation, with a tag by page and turn."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    tag = F.get(F.array(F.lit("top-left"), F.lit("middle-center"), F.lit("bottom-right")), ((F.col("conv_id") + F.col("ord")) % 3).cast("int"))
    rows = D.table(s, d, "conversations").withColumn("ord", F.row_number().over(w)).withColumn("tgt", F.lead("text").over(w))
    return rows.select("conv_id", "turn", "role", "text", F.col("conv_id").alias("page_id"), "ord", tag.alias("position_tag"), F.col("text").alias("src"), "tgt")


@query(f"with {PAIRS} select term, dst from found qualify row_number() over (partition by term order by conv_id desc, turn desc, role desc, text desc) = 1")
def glossary_terms(s, d):
    return S.glossary(_pairs(s, d).select(F.struct("conv_id", "turn", "role", "text").alias("ord"), "src", "tgt"))


@query(f"""with {PAIRS}, tags as (select conv_id, ['top-left','middle-center','bottom-right'][(conv_id+1)%3+1] tag from (select distinct conv_id from conversations)),
p as (select conv_id, term, arg_max(dst, ord) dst from found group by all), k as (select *, case when contains(tag, 'left') then 'left' when contains(tag, 'right') then 'right' end side from p join tags using (conv_id))
select term as name, arg_min(dst, conv_id) name_target, min(conv_id) first_seen_page, count(*) occurrences, coalesce(arg_min(side, conv_id) filter (where side is not null), 'unknown') side_hint from k group by 1""")
def character_memory(s, d):
    return S.character_memory(_pairs(s, d).select("page_id", "ord", "position_tag", "src", "tgt"))


@query("select conv_id, string_agg(turn || '. [' || upper(substr(role,1,3)) || '] ' || text, chr(10) order by turn, role, text) prompt from conversations group by 1")
def prompt_lines(s, d):
    line = F.concat(F.col("turn").cast("string"), F.lit(". ["), F.upper(F.substring("role", 1, 3)), F.lit("] "), "text")
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text", line.alias("line"))))
    return D.table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("prompt"))


@query("select conv_id, turn, role, list_resize(list_value(text), 2, '') parts from conversations")
def parse_translations(s, d):
    reply = F.concat(F.lit("```json\n"), F.to_json(F.array("text")), F.lit("\n```"))
    return D.table(s, d, "conversations").select("conv_id", "turn", "role", T.parse_translations(reply, F.lit(2)).alias("parts"))


# ---- attempts, caches, checkpoints


@query("with a as (select l_orderkey block_id, l_linenumber::int attempt, l_quantity/50.0 confidence, case when l_partkey%4=0 then '' else 'part ' || l_partkey end as text, l_partkey, l_suppkey, l_extendedprice from lineitem), g as (select *, confidence >= 0.55 and text <> '' good from a) select * exclude (good) from g qualify row_number() over (partition by block_id order by good desc, case when good then 0.0 else -confidence end, attempt, l_partkey, l_suppkey, l_extendedprice) = 1")
def ocr_best_attempt(s, d):
    return S.best_attempt(D.attempts(s, d), "block_id", ties=("l_partkey", "l_suppkey", "l_extendedprice"))


@query(f"with {OCR} select page_id, string_agg(trim(text), ' ' order by (y1+y2)/2.0, (x1+x2)/2.0, block_idx) filter (where trim(text) <> '') line, avg(ocr_conf) conf from ocr group by 1")
def ocr_fan_in(s, d):
    mid = lambda a, b: ((F.col(a) + F.col(b)) / 2)
    rows = F.sort_array(F.collect_list(F.when(F.trim("text") != "", F.struct(mid("y1", "y2").alias("y"), mid("x1", "x2").alias("x"), "block_idx", F.trim("text").alias("t")))))
    out = D.ocr(s, d).groupBy("page_id").agg(F.array_join(F.transform(rows, lambda r: r["t"]), " ").alias("line"), F.avg("ocr_conf").alias("conf"))
    return out.select("page_id", F.nullif("line", F.lit("")).alias("line"), "conf")


CACHE = "cache as (select sha256('m1' || chr(0) || 'vi' || chr(0) || text) key, min(doc_id) ts, upper(min(text)) translation from documents where doc_id in (select doc_id from labels) group by 1)"


def _cache(s, d):
    key = T.cache_key(F.lit("m1"), F.lit("vi"), F.col("text"))
    return D.table(s, d, "documents").join(D.table(s, d, "labels").select("doc_id"), "doc_id", "left_semi").groupBy(key.alias("key")).agg(F.min("doc_id").alias("ts"), F.upper(F.min("text")).alias("translation"))


@query(f"with {CACHE}, r as (select doc_id, sha256('m1' || chr(0) || 'vi' || chr(0) || text) key from documents) select r.doc_id, cache.key is not null hit from r left join cache using (key)")
def cache_lookup(s, d):
    requests = D.table(s, d, "documents").select("doc_id", T.cache_key(F.lit("m1"), F.lit("vi"), F.col("text")).alias("key"))
    return S.lookup(requests, _cache(s, d)).select("doc_id", "hit")


@query(f"with {CACHE} select key, ts from cache qualify row_number() over (order by ts desc, key desc) <= 190 or (select count(*) from cache) <= 200")
def cache_evict(s, d):
    return S.evict_oldest(_cache(s, d).select("key", "ts"), 200)


SKIPPED = "select t.page_id from tasks t join prev p using (page_id) where p.state='DONE' and case when p.output_path <> '' then p.output_path else t.output_path end in (select path from outputs)"


@query(f"with {TASKS} select page_id from tasks where page_id not in ({SKIPPED})")
def resume_skip(s, d):
    return S.to_run(_tasks(s, d), _previous(s, d), _outputs(s, d)).select("page_id")


RESTORED = """restored as (select t.page_id, t.input_path, t.output_path, case when p.state='DONE' then 'DONE' else 'PENDING' end state, null::varchar current_stage, case when p.state='DONE' then p.completed_stages else []::varchar[] end completed_stages, coalesce(p.retries, 0)::int retries, '' stage_retries,
  0 oom_retries, []::varchar[] fallback_flags, case when p.state<>'DONE' then p.last_error end last_error, null::varchar started_ts, case when p.state='DONE' then p.completed_ts end completed_ts from tasks t left join prev p using (page_id))"""


@query(f"with {TASKS}, {RESTORED} select * from restored")
def restore_tasks(s, d):
    return _flat(S.restore(_tasks(s, d), _previous(s, d)))


@query(f"with {TASKS}, {RESTORED}, k as (select * from restored where page_id%3=0) select * from k union all select * from prev where page_id not in (select page_id from k)")
def checkpoint_upsert(s, d):
    """A checkpoint after the tasks of a third of the pages were put into it."""
    third = _tasks(s, d).where("page_id % 3 = 0")
    return _flat(S.upsert(_previous(s, d), S.restore(third, _previous(s, d))))


# ---- events


@query(f"with {EVENTS} select stage, count(*) filter (where event='stage_end') n_ok, count(*) filter (where event='stage_error') n_err, quantile_cont(latency_ms, 0.99) filter (where event='stage_end') p99_ms from ev group by 1")
def stage_metrics(s, d):
    return E.stage_metrics(D.event_log(s, d))


@query(f"with {EVENTS} select page_id, arg_max(event, (ts, event_id)) outcome, count(*) n_final from ev where event in ('page_done','page_failed') group by 1")
def page_outcomes(s, d):
    return E.page_outcomes(D.event_log(s, d))


@query(f"with {EVENTS} select event_id, page_id, event from ev order by ts desc, event_id desc limit 30")
def last_30_events(s, d):
    return E.last_events(D.event_log(s, d)).select("event_id", "page_id", "event")


@query(f"with {EVENTS}, n as (select *, lead(ts) over (partition by page_id order by ts, event_id) nx from ev) select event_id, page_id, stage from n where event='stage_start' and (nx is null or epoch_us(nx)-epoch_us(ts) >= 1000000 * [120,120,60,300,120,180,60,180,60,60,60][stage+1])")
def stage_freezes(s, d):
    return E.freezes(D.event_log(s, d))


@query(f"with {EVENTS} select epoch_us(ts)//30000000 bucket, event, count(*) n from ev group by 1,2")
def health_windows(s, d):
    out = E.health(D.event_log(s, d))
    return out.select(F.expr("unix_micros(w.start) div 30000000").alias("bucket"), "event", "n")


@query("select event_id, least(60.0, 2.0*pow(2.0, event_id%8)) wait_s, greatest(5, floor((event_id%40)/2.0))::bigint rpm from events")
def retry_backoff(s, d):
    return D.table(s, d, "events").select("event_id", E.backoff(F.col("event_id") % 8).alias("wait_s"), E.slower(F.col("event_id") % 40).cast("bigint").alias("rpm"))


@query("select event_id, event_id%5=0 or event_id%7=0 rate_limited, event_id%6=0 oom from events")
def error_classes(s, d):
    msg = F.expr("concat(case when event_id%5=0 then 'HTTP 429 ' else '' end, case when event_id%7=0 then 'Too Many Requests ' else '' end, case when event_id%6=0 then 'CUDA out of memory' else 'x' end)")
    return D.table(s, d, "events").select("event_id", T.is_rate_limit(msg).alias("rate_limited"), T.is_out_of_memory(F.lit("RuntimeError"), msg).alias("oom"))


# ---- languages, pixel rows, rate limits


@query("""with p as (select distinct l_suppkey page_id, (l_orderkey%64)::int y, (l_partkey%24)::int x from lineitem), r as (select *, x - row_number() over (partition by page_id, y order by x) run from p),
g as (select page_id, y, min(x) xmin, max(x) xmax from r group by page_id, y, run) select page_id, y, xmin, xmax from g qualify row_number() over (partition by page_id, y order by xmax-xmin desc, xmin) = 1""")
def longest_run(s, d):
    return B.longest_runs(D.pixels(s, d))


@query("""with c as (select l_orderkey page_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) ord, (l_partkey%200)::double x, (l_suppkey*7%100)::double y from lineitem),
n as (select page_id, avg(x) anchor, count(*) n from c group by 1),
e as (select c.page_id, n.anchor, c.x x1, c.y y1, d.x x2, d.y y2 from c join n using (page_id) join c d on d.page_id=c.page_id and d.ord = c.ord % n.n + 1 where n.n >= 3),
f as (select page_id, anchor, least(y1,y2) a, greatest(y1,y2) b, case when y1<y2 then x1 else x2 end xa, case when y1<y2 then x2 else x1 end xb from e where y1<>y2),
m as (select page_id, anchor, r, xa + (r + 0.5::double - a) / (b - a) * (xb - xa) x_in from f join range(100) t(r) on r + 0.5 >= a and r + 0.5 < b),
p as (select *, lead(x_in) over w x_out, row_number() over w k from m window w as (partition by page_id, r order by x_in)),
s as (select * from p where k%2=1 and x_out is not null and (anchor between x_in and x_out or x_out > x_in)
  qualify row_number() over (partition by page_id, r order by case when anchor between x_in and x_out then 0 else 1 end, case when anchor between x_in and x_out then 0 else x_in-x_out end, k) = 1)
select page_id, r y, round_even(x_in, 0)::bigint xmin, round_even(x_out, 0)::bigint xmax from s""")
def scanline_extents(s, d):
    return B.scanline_extents(D.corners(s, d), 100)


CODES = "(values (0,'ja'),(1,'ko'),(2,'zh_sim'),(3,'zh_tra'),(4,'en'),(5,'vi')) v(ord, code)"
SCORES = rf"""c as (select conv_id page_id, turn crop_no, code, ord, (conv_id*7+turn*13+ord*29)%100/100.0::double conf, text from conversations, {CODES}),
pc as (select page_id, crop_no, code, ord, avg(conf) conf, bool_or(regexp_matches(text, '[ -~\x{{C0}}-\x{{24F}}]')) latin, bool_or(regexp_matches(text, '[\x{{1E00}}-\x{{1EFF}}]')) viet, bool_or(regexp_matches(text, '[・…—。、！？]')) punct from c group by all),
sc as (select page_id, code, ord, round(avg(conf) * case when code='en' and bool_or(latin) or code='vi' and (bool_or(latin) or bool_or(viet)) then 1.25 else 1.0 end
  * case when code in ('ja','zh_sim','zh_tra') and bool_or(punct) then 1.1 else 1.0 end, 9) score from pc group by page_id, code, ord)"""


def _scores(s, d):
    layout = D.table(s, d, "conversations").select(F.col("conv_id").alias("page_id"), (F.col("conv_id") % 2 == 0).alias("is_vertical")).distinct()
    return L.candidate_scores(D.readings(s, d, list(L.CANDIDATES)), layout)


@query(f"with {SCORES} select page_id, code, score from sc")
def language_score(s, d):
    return _scores(s, d).select("page_id", "code", "score")


_CODE = "case when score < 0.2 then 'en' else code end"
_BY_CODE = f"""map {{'ja': 'Japanese', 'ko': 'Korean', 'zh_sim': 'Chinese Simplified', 'zh_tra': 'Chinese Traditional', 'en': 'English', 'vi': 'Vietnamese'}}[{_CODE}] as name,
map {{'ja': ['ja', 'en'], 'ko': ['ko', 'en'], 'zh_sim': ['ch_sim', 'en'], 'zh_tra': ['ch_tra', 'en'], 'en': ['en'], 'vi': ['vi', 'en']}}[{_CODE}] langs,
map {{'ja': 'hiragana+kanji', 'ko': 'hangul', 'zh_sim': 'hanzi', 'zh_tra': 'hanzi', 'en': 'latin', 'vi': 'latin+diacritic'}}[{_CODE}] primary_script,"""


@query(f"with {SCORES}, b as (select *, count(*) filter (where score >= 0.2) over (partition by page_id) n from sc qualify row_number() over (partition by page_id order by score desc, ord) = 1) select page_id, case when score < 0.2 then 'en' else code end lang, {_BY_CODE} case when score < 0.2 then 0 else score end::double score, n >= 2 mixed from b")
def language_detect(s, d):
    return L.detect(_scores(s, d))


@query("with r as (select event_id, user_id, epoch_us(ts) a, row_number() over w n from events window w as (partition by user_id order by ts, event_id)), f as (select *, max(a - (n-1)*3000000) over (partition by user_id order by n) + n*3000000 fl from r) select event_id, user_id page_id, greatest(0, coalesce(lag(fl) over (partition by user_id order by n) - 57000000 - a, 0))::bigint wait_us from f")
def token_bucket(s, d):
    return E.bucket_waits(D.event_log(s, d), "page_id").select("event_id", "page_id", "wait_us")


@query(ORACLES["script_profile"].replace("select doc_id, case when letters", "select primary_script, count(*) n from (select case when letters").replace(" is_short_sfx from u", " is_short_sfx from u) group by 1"))
def primary_script_counts(s, d):
    p = D.table(s, d, "documents").select(T.script_profile(F.col("text"))["primary"].alias("primary_script"))
    return p.groupBy("primary_script").agg(F.count("*").alias("n"))


@query(f"with {ROLES} select * from roles where {STRIP('t')} <> '' and should_translate and not preserve")
def translatable(s, d):
    return B.translatable(B.roles(D.blocks(s, d), D.ocr(s, d), W, H))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
