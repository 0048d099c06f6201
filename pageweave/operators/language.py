"""Language of a page from recognition candidates: each candidate language has read the same crops with its own confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageweave.functions import text as T

# Candidates in order with the scripts that speak for them, full-width punctuation, bonuses.
CANDIDATES = {"ja": ("hiragana", "katakana", "kanji"), "ko": ("hangul",), "zh_sim": ("hanzi",), "zh_tra": ("hanzi",), "en": ("latin",), "vi": ("latin", "vietnamese_diacritic")}
# Names of the candidates and the languages that recognition loads for each.
NAMES = {"ja": "Japanese", "ko": "Korean", "zh_sim": "Chinese Simplified", "zh_tra": "Chinese Traditional", "en": "English", "vi": "Vietnamese"}
LOADED = {"ja": ("ja", "en"), "ko": ("ko", "en"), "zh_sim": ("ch_sim", "en"), "zh_tra": ("ch_tra", "en"), "en": ("en",), "vi": ("vi", "en")}
RANGES = T.SCRIPTS | {"hanzi": "一-鿿"}
CJK_PUNCT = "。、！？「」『』〝〞・…—《》〈〉【】（）"
MARKER, VERTICAL, PUNCT, KANA, FLOOR = 1.25, 1.15, 1.10, 0.6, 0.20


def candidate_scores(crops: DataFrame, layout: DataFrame) -> DataFrame:
    """page_id, code, score, and the candidate's hiragana and katakana, of crops (page_id, crop_no, code, conf, text); layout tells is_vertical of a page.

    A crop's confidence is the mean of its readings, a candidate's the mean of its crops; those without any are left out. Candidates that read the same text
    share its counts.
    """
    texts = crops.groupBy("page_id", "crop_no", "text").agg(F.collect_list(F.struct("code", "conf")).alias("read"))  # a reading or two a candidate
    ranges = RANGES | {"cjk_punct": CJK_PUNCT}
    counted = texts.select("page_id", "crop_no", "read", *[T.count(F.col("text"), r).alias(k) for k, r in ranges.items()])
    each = counted.select("page_id", "crop_no", F.inline("read"), *ranges)
    glyphs = [F.sum(k).alias(k) for k in ranges]
    per_crop = each.groupBy("page_id", "crop_no", "code").agg(F.avg("conf").alias("conf"), *glyphs)
    s = per_crop.groupBy("page_id", "code").agg(F.avg("conf").alias("base"), *glyphs).where("base is not null").join(layout.select("page_id", "is_vertical"), "page_id", "left")
    code, kana = F.col("code"), F.col("hiragana") + F.col("katakana") > 0
    marked = F.lit(False)
    for c, scripts in CANDIDATES.items():
        marked = marked | ((code == c) & (sum((F.col(k) for k in scripts), F.lit(0)) > 0))
    factor = lambda when, x: F.when(when, x).otherwise(1.0)
    vertical = (code == "ja") & F.coalesce("is_vertical", F.lit(False)) & kana
    score = F.col("base") * factor(marked, MARKER) * factor(vertical, VERTICAL)
    score = score * factor(code.isin("ja", "zh_sim", "zh_tra") & (F.col("cjk_punct") > 0), PUNCT) * factor(code.isin("zh_sim", "zh_tra") & kana, KANA)
    return s.select("page_id", "code", F.round(score, 9).alias("score"), "hiragana", "katakana")


def _place(code: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CANDIDATES)), code)


def primary_script(code: Column, hiragana: Column, katakana: Column) -> Column:
    """The script that a page in this language is mostly written in."""
    return F.when(code == "ja", F.when(hiragana >= katakana, "hiragana+kanji").otherwise("katakana+kanji")).when(code == "ko", "hangul").when(code.isin("zh_sim", "zh_tra"), "hanzi").when(code == "vi", "latin+diacritic").otherwise("latin")


def _named(code: Column, names: dict) -> Column:
    return F.element_at(F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v))]), code)


def detect(scores: DataFrame) -> DataFrame:
    """Per page the best candidate, the first on a tie, with its name, languages, score and primary script, from the kana of all candidates; mixed if two reach the floor.

    Below the floor it is English, with score 0.
    """
    best, top = F.max_by("code", F.struct("score", -_place(F.col("code")))), F.max("score")
    by = scores.groupBy("page_id").agg(best.alias("code"), top.alias("top"), (F.count_if(F.col("score") >= FLOOR) >= 2).alias("mixed"), F.sum("hiragana").alias("hiragana"), F.sum("katakana").alias("katakana"))
    low = F.col("top") < FLOOR
    by = by.withColumn("lang", F.when(low, "en").otherwise(F.col("code")))
    return by.select("page_id", "lang", _named(F.col("lang"), NAMES).alias("name"), _named(F.col("lang"), LOADED).alias("langs"), F.when(low, 0.0).otherwise(F.col("top")).alias("score"), "mixed", primary_script(F.col("lang"), F.col("hiragana"), F.col("katakana")).alias("primary_script"))


def first_page(detected: DataFrame) -> DataFrame:
    """The language found on the first page, for all pages. One value is looked up, not joined."""
    first = detected.agg(F.min_by("lang", "page_id")).scalar()
    return detected.select("page_id", first.alias("lang"))
