"""Queries of interiors, rectangles and spectra; importing the module registers them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from pageweave.operators import interiors as I
from pageweave.plans.registry import DENSE, query
from pageweave.sources import tables as D

# Masks: where an odd number of a page's boxes, on a scale of 1 to 12, lie upon each other.
MW, MH = 38, 58
_SIGMA = 0.3 * ((5 - 1) * 0.5 - 1) + 0.8
_BELL = [math.exp(-(i * i) / (2 * _SIGMA * _SIGMA)) for i in range(-2, 3)]
_BELL = [b / sum(_BELL) for b in _BELL]
_MIRROR = lambda i, n: f"(case when {i} < 0 then -({i}) when {i} >= {n} then {2 * n - 2} - ({i}) else {i} end)"


def _masks(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    boxes = D.dense_blocks(s, d).selectExpr("page_id", "x1 div 12 a", "y1 div 12 b", "x2 div 12 c", "y2 div 12 e").where("c > a and e > b")
    filled = boxes.select("page_id", "b", "e", F.explode(F.sequence(F.col("a"), F.col("c") - 1)).alias("x")).select("page_id", F.col("x").cast("int").alias("x"), F.explode(F.sequence(F.col("b").cast("int"), F.col("e").cast("int") - 1)).alias("y"))
    pixels = filled.where((F.col("x") < MW) & (F.col("y") < MH)).groupBy("page_id", "x", "y").agg(F.count("*").alias("n")).where("n % 2 = 1").drop("n")
    sizes = boxes.select("page_id").distinct().select("page_id", F.lit(MW).alias("w"), F.lit(MH).alias("h"))
    return pixels, sizes, sizes.where("page_id % 2 = 0").selectExpr("page_id", "(page_id * 7) % 45 - 3 as x", "(page_id * 11) % 70 - 5 as y")


@query(f"""with recursive {DENSE}, b as (select page_id, x1//12 a, y1//12 b, x2//12 c, y2//12 e from dense), pg as (select distinct page_id from b where c > a and e > b),
m as (select pg.page_id, x, y, count(b.page_id) % 2 = 1 s from pg cross join range({MW}) t(x) cross join range({MH}) u(y) left join b on b.page_id=pg.page_id and x>=a and x<c and y>=b and y<e group by all),
d as (select m.page_id, m.x, m.y, sqrt(least(1e12::double, coalesce(min((m.x-z.x)*(m.x-z.x)+(m.y-z.y)*(m.y-z.y)), 1e12))::double) d from m left join m z on z.page_id=m.page_id and not z.s group by all),
k as (select unnest([-2,-1,0,1,2]) o, unnest({_BELL}) w),
r1 as (select g.page_id, g.x, g.y, sum(d.d * k.w) d from (select page_id, x, y from m) g cross join k join d on d.page_id=g.page_id and d.y=g.y and d.x={_MIRROR("g.x+k.o", MW)} group by all),
r2 as (select g.page_id, g.x, g.y, round(sum(r1.d * k.w), 6) v from (select page_id, x, y from m) g cross join k join r1 on r1.page_id=g.page_id and r1.x=g.x and r1.y={_MIRROR("g.y+k.o", MH)} group by all),
top as (select page_id, x, y from r2 qualify row_number() over (partition by page_id order by v desc, y, x) = 1),
hint as (select page_id, greatest(0, least({MW - 1}, (page_id*7)%45-3)) x, greatest(0, least({MH - 1}, (page_id*11)%70-5)) y from pg where page_id%2=0),
ok as (select hint.* from hint join m using (page_id, x, y) where m.s),
c as (select page_id, x cx, y cy from ok union all select page_id, x, y from top where page_id not in (select page_id from ok)),
hs as (select c.page_id, cx, cy, m.y, case when not bool_or(m.s and m.x=cx) then -1 else least(cx - coalesce(max(m.x) filter (where not m.s and m.x<cx), -1) - 1, coalesce(min(m.x) filter (where not m.s and m.x>cx), {MW}) - cx - 1) end half from c join m using (page_id) group by c.page_id, cx, cy, m.y),
pgs as (select page_id, cx, cy, list(half order by y) hl, max(half) filter (where y=cy) hw, least(cy - coalesce(max(y) filter (where half<0 and y<=cy), -1) - 1, coalesce(min(y) filter (where half<0 and y>=cy), {MH}) - cy - 1) hh from hs group by 1, 2, 3),
f as (select *, list_min(hl[cy-hh+1 : cy+hh+1]) >= hw whole from pgs where hw > 1 and hh > 1),
bis as (select page_id, cx, cy, hl, hw, hh, 0 i, 0::double lo, 1::double hi from f where not whole
  union all select page_id, cx, cy, hl, hw, hh, i+1, case when fits then mid else lo end, case when fits then hi else mid end from (select *, trunc(hw*mid)::int > 0 and trunc(hh*mid)::int > 0 and list_min(hl[cy-trunc(hh*mid)::int+1 : cy+trunc(hh*mid)::int+1]) >= trunc(hw*mid)::int fits from (select *, (lo+hi)/2 mid from bis where i < 18))),
fin as (select page_id, cx, cy, hw, hh, 1::double share from f where whole union all select page_id, cx, cy, hw, hh, lo from bis where i=18 and lo > 0)
select page_id, (cx-trunc(hw*share))::int x1, (cy-trunc(hh*share))::int y1, (cx+trunc(hw*share))::int x2, (cy+trunc(hh*share))::int y2 from fin""")
def largest_rects(s: SparkSession, d: str) -> DataFrame:
    """Largest rectangles in masks, around hints on every other page."""
    return I.largest_rects(*_masks(s, d))


# Regions around the text boxes of customers, three attempts each; their components are the orders of the customer, on their page those of its neighbours.
RW, RH = 120, 100
_TEXT = f"""bx as (select c_custkey//8 page_id, (c_custkey%8)::int block_idx, 40+(c_custkey*37)%30 x1, 35+(c_custkey*53)%25 y1, 40+(c_custkey*37)%30+6+(c_custkey*17)%20 x2, 35+(c_custkey*53)%25+4+(c_custkey*29)%14 y2, c_custkey k from customer),
rg as (select page_id, block_idx, t attempt, x1, y1, x2, y2, greatest(0, x1-15-5*t) rx1, greatest(0, y1-15-5*t) ry1, least({RW}, x2+15+5*t) rx2, least({RH}, y2+15+5*t) ry2 from bx cross join range(3) r(t)),
od as (select o_custkey k, o_orderkey%3 t, row_number() over (partition by o_custkey order by o_orderkey) label, o_orderkey o from orders),
rn as (select k//8 page_id, (k%8)::int block_idx, t attempt, (o*11)%20 + unnest(range(10+(o*17)%31)) y, (o*7)%25 x_from, (o*7)%25+20+(o*13)%61 x_to, label from od),
pr as (select page_id, y, x_from, x_to, max(label) label from (select k//8 page_id, 30 + (o*11)%30 + unnest(range(10+(o*17)%31)) y, 30 + (o*7)%45 x_from, 30 + (o*7)%45+20+(o*13)%41 x_to, 1 + k%8 label from od where o%5=0) group by 1, 2, 3, 4)"""


def _regions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    k = D.table(s, d, "customer").selectExpr("c_custkey div 8 as page_id", "cast(c_custkey % 8 as int) block_idx", "40+(c_custkey*37)%30 x1", "35+(c_custkey*53)%25 y1", "40+(c_custkey*37)%30+6+(c_custkey*17)%20 x2", "35+(c_custkey*53)%25+4+(c_custkey*29)%14 y2")
    regions = k.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(2)))).selectExpr("page_id", "block_idx", "attempt", "greatest(0, x1-15-5*attempt) rx1", "greatest(0, y1-15-5*attempt) ry1", f"least({RW}, x2+15+5*attempt) rx2", f"least({RH}, y2+15+5*attempt) ry2")
    label = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = D.table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), label.alias("label"))
    row = F.explode(F.sequence(F.lit(0), (F.lit(9) + (F.col("o") * 17) % 31).cast("int"))).alias("dy")
    runs = o.select("*", row).selectExpr("k div 8 as page_id", "cast(k % 8 as int) block_idx", "cast(o % 3 as int) attempt", "(o*11)%20 + dy y", "(o*7)%25 x_from", "(o*7)%25+20+(o*13)%61 x_to", "label")
    page = o.where("o % 5 = 0").select("*", row).selectExpr("k div 8 as page_id", "30 + (o*11)%30 + dy y", "30 + (o*7)%45 x_from", "30 + (o*7)%45+20+(o*13)%41 x_to", "1 + k % 8 label")
    return k, regions, runs, page.groupBy("page_id", "y", "x_from", "x_to").agg(F.max("label").alias("label"))


_GRID = ", ".join(f"{{'x': trunc(tx1 + (tx2-tx1)*{fx}::double)::bigint, 'y': trunc(ty1 + (ty2-ty1)*{fy}::double)::bigint}}" for fy in I.GRID for fx in I.GRID)
_OUT = ", ".join(f"{{'x': (tx1+tx2)//2, 'y': greatest(0, ty1-{o})}}, {{'x': (tx1+tx2)//2, 'y': least(h-1, ty2+{o})}}, {{'x': greatest(0, tx1-{o}), 'y': (ty1+ty2)//2}}, {{'x': least(w-1, tx2+{o}), 'y': (ty1+ty2)//2}}" for o in I.OUTSIDE)


@query(f"""with {_TEXT}, tx as (select page_id, block_idx, attempt, x1-rx1 tx1, y1-ry1 ty1, x2-rx1 tx2, y2-ry1 ty2, rx2-rx1 w, ry2-ry1 h from rg),
pt as (select *, unnest([{{'x': (tx1+tx2)//2, 'y': (ty1+ty2)//2}}, {_GRID}, {_OUT}]) p, unnest(range(38)) pn from tx),
vt as (select pt.page_id, pt.block_idx, pt.attempt, label, count(*) votes, min(pn) first from pt join rn on rn.page_id=pt.page_id and rn.block_idx=pt.block_idx and rn.attempt=pt.attempt and p.y=rn.y and p.x>=x_from and p.x<x_to where pn=0 or pn>25 or (p.x>=0 and p.x<w and p.y>=0 and p.y<h) group by all),
st as (select page_id, block_idx, attempt, label, sum(x_to-x_from) area, min(x_from) l, min(y) t, max(x_to) r, max(y)+1 b from rn group by all),
lc as (select * from vt join st using (page_id, block_idx, attempt, label) join tx using (page_id, block_idx, attempt) where l<=tx1+5 and t<=ty1+5 and r>=tx2-5 and b>=ty2-5 and area<=0.15*{RW * RH} and area>=0.3*(tx2-tx1)*(ty2-ty1)
  and (area<=greatest(12*(tx2-tx1)*(ty2-ty1), 900) or l<=0 or t<=0 or r>=w or b>=h) qualify row_number() over (partition by page_id, block_idx, attempt order by votes desc, first, label) = 1),
near as (select page_id, block_idx, attempt, label from lc qualify row_number() over (partition by page_id, block_idx order by attempt) = 1),
rest as (select * from bx where (page_id, block_idx) not in (select (page_id, block_idx) from near)),
pp as (select *, (x1+x2)//2 cx, (y1+y2)//2 cy from rest), q as (select *, unnest([{{'x': cx, 'y': cy}}, {{'x': cx, 'y': greatest(0, y1-4)}}, {{'x': cx, 'y': least({RH - 1}, y2+4)}}, {{'x': greatest(0, x1-4), 'y': cy}}, {{'x': least({RW - 1}, x2+4), 'y': cy}}]) p, unnest(range(5)) pn from pp),
ps as (select page_id, label, sum(x_to-x_from) area, min(x_from) l, min(y) t, max(x_to) r, max(y)+1 b from pr group by all),
far as (select q.page_id, q.block_idx, pr.label from q join pr on pr.page_id=q.page_id and p.y=pr.y and p.x>=x_from and p.x<x_to join ps on ps.page_id=q.page_id and ps.label=pr.label where l<=x1 and t<=y1 and r>=x2 and b>=y2 and area<=0.15*{RW * RH} qualify row_number() over (partition by q.page_id, q.block_idx order by pn, pr.label) = 1)
select page_id, block_idx, attempt::int attempt, label::bigint as label from near union all select page_id, block_idx, null, label from far""")
def bubble_interiors(s: SparkSession, d: str) -> DataFrame:
    boxes, regions, runs, page = _regions(s, d)
    return I.interior(boxes, regions, runs, page, RW, RH, roomy=900).withColumn("label", F.col("label").cast("bigint"))


@query("""with p as (select vec_id, unnest(embedding)::double v, unnest(range(64)) i from embeddings), m as (select *, v - avg(v) over (partition by vec_id) c, max(v) over (partition by vec_id) = min(v) over (partition by vec_id) flat from p),
f as (select (k//8) - 4 fy, (k%8) - 4 fx from range(64) t(k)), band as (select * from f where sqrt(fy*fy+fx*fx) > 0.8 and sqrt(fy*fy+fx*fx) < 3.2),
s as (select vec_id, fy, fx, any_value(flat) flat, sqrt(pow(sum(c * cos(2*pi()*(fy*(i//8)+fx*(i%8))/8)), 2) + pow(sum(c * sin(2*pi()*(fy*(i//8)+fx*(i%8))/8)), 2)) a from m cross join band group by 1, 2, 3)
select vec_id tile_id, round(case when any_value(flat) then 0 else max(a) / greatest(1e-3, median(a)) / 100 end, 7) peak from s group by 1""")
def spectral_peaks(s: SparkSession, d: str) -> DataFrame:
    """Vectors as tiles of 8 x 8."""
    tiles = D.table(s, d, "embeddings").select(F.col("vec_id").alias("tile_id"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.col("embedding").alias("light"))
    return I.spectral_peaks(tiles).withColumn("peak", F.round("peak", 7))
