"""Queries of the translation chain, checkpoints and glossaries as of a page; importing the module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from pageweave.functions import geometry as G
from pageweave.functions import text as T
from pageweave.operators import blocks as B
from pageweave.operators import chain as C
from pageweave.operators import state as S
from pageweave.plans import registry as R
from pageweave.plans.registry import PAIRS, SP, STRIP, H, W, query
from pageweave.sources import tables as D

# The recognised rows of a page are the turns of a conversation; some are blank, some kept as drawn or not to be translated.
TALK = f"""talk as (select conv_id page_id, (row_number() over (partition by conv_id order by turn, role, text) - 1)::int block_idx, role, case when turn%4=3 and conv_id%3=0 then ' ' else text end as text, role<>'system' should_translate, (conv_id+turn)%6=0 preserve,
  ((conv_id*37+turn*211)%700)::int x1, ((conv_id*53+turn*397)%1000)::int y1, ((conv_id*37+turn*211)%700+120)::int x2, ((conv_id*53+turn*397)%1000+90)::int y2 from conversations)"""
_CLEAN = STRIP(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\.{{4,}}', '...', 'g'), '\?{{3,}}', '??', 'g'), '[?!]{{4,}}', '?!', 'g'), '{SP}+([!?,.])', '\1', 'g')")
ASKED = rf"""asked as (select page_id, row_number() over (partition by page_id order by ((y1+y2)//2)//{int(H * 0.25)}, -((x1+x2)//2), block_idx) pos, block_idx,
  (case when (y1+y2)/2.0 < {H}/3.0 then 'top' when (y1+y2)/2.0 > 2*{H}/3.0 then 'bottom' else 'middle' end) || '-' || (case when (x1+x2)/2.0 > 2*{W}/3.0 then 'right' when (x1+x2)/2.0 < {W}/3.0 then 'left' else 'center' end) position_tag, clean as text
  from (select *, {_CLEAN} clean from talk where {STRIP("text")} <> '' and should_translate and not preserve) where clean <> '')"""


def _talk(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return D.table(s, d, "conversations").withColumn("n", F.row_number().over(w)).selectExpr(
        "conv_id as page_id", "cast(n - 1 as int) block_idx", "if(turn % 4 = 3 and conv_id % 3 = 0, ' ', text) as text", "role <> 'system' should_translate", "(conv_id + turn) % 6 = 0 preserve",
        "cast((conv_id*37+turn*211)%700 as int) x1", "cast((conv_id*53+turn*397)%1000 as int) y1", "cast((conv_id*37+turn*211)%700+120 as int) x2", "cast((conv_id*53+turn*397)%1000+90 as int) y2",
    )


def _replies(asked: DataFrame) -> DataFrame:
    """A reply a page: whole, too short, too long or an object with a known key, and none for every fifth page."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda r: F.concat(F.lit("t"), r["pos"].cast("string"), F.lit(" "), r["text"]))
    by = asked.groupBy("page_id").agg(texts.alias("t")).where("page_id % 5 <> 4")
    told = F.when(F.col("page_id") % 3 == 1, F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0)))).when(F.col("page_id") % 3 == 2, F.concat("t", F.array(F.lit("more"), F.lit("and more")))).otherwise(F.col("t"))
    plain, keyed = F.to_json(told), F.concat(F.lit('{"translations": '), F.to_json(told), F.lit("}"))
    return by.select("page_id", F.when(F.col("page_id") % 2 == 0, plain).otherwise(keyed).alias("reply"))


@query(f"with {TALK}, {ASKED} select page_id, pos::int pos, block_idx, position_tag, text from asked")
def translation_requests(s, d):
    return C.requests(_talk(s, d), W, H)


@query(f"with {TALK}, {ASKED} select page_id, count(*) n, string_agg(pos || '. [' || position_tag || '] ' || text, chr(10) order by pos) prompt from asked group by 1")
def request_prompts(s, d):
    return C.prompts(C.requests(_talk(s, d), W, H))


_BACK = """n as (select *, count(*) over (partition by page_id) n from asked),
back as (select page_id, block_idx, case when page_id%5=4 or (page_id%3=1 and pos=n) then '' else 't' || pos || ' ' || text end as tr from n)"""


@query(f"with {TALK}, {ASKED}, {_BACK} select talk.page_id, talk.block_idx, coalesce(tr, '') translated from talk left join back using (page_id, block_idx)")
def translation_scatter(s, d):
    """Replies put back in the places of their requests: some are too short, some too long, some missing."""
    rows = _talk(s, d)
    asked = C.requests(rows, W, H)
    return C.scattered(rows, C.replies(asked, _replies(asked))).select("page_id", "block_idx", "translated")


@query(f"""with {TALK}, r as (select *, row_number() over (partition by page_id order by block_idx) - 1 place from (select * from talk where trim(text) <> '')),
t as (select conv_id page_id, row_number() over (partition by conv_id order by turn desc, role desc, text desc) - 1 place, case when turn%3=1 then '' else text end nw from conversations where conv_id%4 <> 3 or turn < 2)
select r.page_id, r.block_idx, case when coalesce(nw, '') <> '' then nw else r.role end translated from r left join t using (page_id, place)""")
def positional_pairs(s, d):
    """Rows and texts of a page zipped by place; where a list is short, or a text blank, a row keeps what it had."""
    rows = _talk(s, d).where("trim(text) <> ''")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    had = D.table(s, d, "conversations").withColumn("block_idx", (F.row_number().over(w) - 1).cast("int")).select(F.col("conv_id").alias("page_id"), "block_idx", F.col("role").alias("translated"))
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    texts = D.table(s, d, "conversations").where("conv_id % 4 <> 3 or turn < 2").withColumn("place", F.row_number().over(back) - 1)
    texts = texts.select(F.col("conv_id").alias("page_id"), "place", F.when(F.col("turn") % 3 == 1, "").otherwise(F.col("text")).alias("text"))
    return C.paired(rows.join(had, ["page_id", "block_idx"]), texts).select("page_id", "block_idx", "translated")


_ENTRIES = f"""{PAIRS}, en as (select conv_id page_id, term, arg_max(dst, ord) dst from found group by all),
wt as (select distinct conv_id page_id, unnest(list_distinct(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7f\\P{{L}}]', '_', 'g'), '\\b[A-Z][A-Za-z]{{2,}}(?:-[A-Za-z]+)?\\b'))) term from conversations),
seen as (select wt.page_id, wt.term, (select arg_max(dst, en.page_id) from en where en.term = wt.term and en.page_id < wt.page_id) dst from wt)"""


def _names(s: SparkSession, d: str) -> DataFrame:
    return D.table(s, d, "conversations").select(F.col("conv_id").alias("page_id"), F.explode(F.array_distinct(T.names(F.col("text")))).alias("term")).distinct()


@query(f"with {_ENTRIES} select * from seen")
def glossary_as_of(s, d):
    """What the names of a page mean to it: what pages before it wrote."""
    return S.glossary_as_of(S.page_entries(R._pairs(s, d)), _names(s, d))


@query(f"with {_ENTRIES} select page_id, string_agg('  - ' || term || ' → ' || dst, chr(10) order by term) block from seen where dst is not null group by 1")
def glossary_block(s, d):
    """The glossary that each page's prompt shows."""
    return S.glossary_block(S.glossary_as_of(S.page_entries(R._pairs(s, d)), _names(s, d)))


@query(f"with {_ENTRIES}, ch as (select *, lag(dst) over (partition by term order by page_id) is distinct from dst nw from en) select term, dst, page_id after_page, lead(page_id) over (partition by term order by page_id) until_page from ch where nw")
def glossary_intervals(s, d):
    return S.glossary_intervals(S.page_entries(R._pairs(s, d)))


@query(f"""with {_ENTRIES}, tags as (select conv_id page_id, ['top-left','middle-center','bottom-right'][(conv_id+1)%3+1] tag from (select distinct conv_id from conversations)),
m as (select term as name, page_id, dst, case when contains(tag, 'left') then 'left' when contains(tag, 'right') then 'right' end side from en join tags using (page_id))
select name, page_id, min(page_id) over w first_seen_page, (row_number() over w)::int occurrences, first_value(dst) over w name_target,
  coalesce(arg_min(side, page_id) filter (where side is not null) over (partition by name order by page_id rows between unbounded preceding and current row), 'unknown') side_hint from m window w as (partition by name order by page_id)""")
def memory_as_of(s, d):
    """What was known of a name after each page."""
    return S.memory_as_of(S.mentions(R._pairs(s, d)))


@query(f"with {TALK}, {ASKED} select page_id, row_number() over (order by page_id) page_idx from (select distinct page_id from asked)")
def page_numbers(s, d):
    return C.page_numbers(C.requests(_talk(s, d), W, H))


@query(f"with {R.TASKS} select t.page_id, coalesce(r.path, t.input_path) as out, r.path is null is_original from tasks t left join outputs r on r.path = t.output_path")
def delivered_pages(s, d):
    """Pages of an archive as they are given back: their result, or the original where there is none."""
    tasks = R._tasks(s, d).select("page_id", F.col("output_path").alias("name"), F.col("input_path").alias("path"))
    pages = C.delivered(tasks.select("name", "path"), R._outputs(s, d).select(F.col("path").alias("name"), "path"))
    return tasks.select("page_id", "name").join(pages, "name").select("page_id", "out", "is_original")


@query(f"""with {R.BLOCKS}, k as (select *, (x2-x1)::bigint*(y2-y1) area, (doc_id%7)/7.0::double score from blocks), r as (select * from k qualify row_number() over (partition by page_id order by area desc, score desc, block_idx) <= 4)
select page_id, block_idx, greatest(0, x1-4)::int x1, greatest(0, y1-4)::int y1, least({W}, x2+4)::int x2, least({H}, y2+4)::int y2 from r""")
def language_samples(s, d):
    """The regions of a page that its language is told from, with their margin."""
    rows = D.blocks(s, d).withColumn("score", F.expr("(doc_id % 7) / 7.0D"))
    best = B.largest(rows).select("page_id", "block_idx")
    box = G.padded_box(*[F.col(c) for c in B.BOX], W, H, G.SAMPLE_PAD)
    return rows.join(best, ["page_id", "block_idx"]).select("page_id", "block_idx", box.alias("b")).where("b is not null").select("page_id", "block_idx", "b.*")
