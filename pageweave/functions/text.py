"""Text rules as column expressions: scripts, clean-up, names, prompts, error classes. Null behaves as the empty text."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, digits beyond the decimal class, script ranges, punctuation, lexicons, patterns of errors and names.
SPACE = r"\t-\r\u001c-\u001f \u0085   -     　"
DIGIT = r"\p{Nd}²³¹፩-፱᧚⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒"
SCRIPTS = {
    "hiragana": r"぀-ゟ",
    "katakana": r"゠-ヿㇰ-ㇿ",
    "kanji": r"一-鿿㐀-䶿",
    "hangul": r"가-힣ᄀ-ᇿ㄰-㆏",
    "latin": r" -~À-ɏ",
    "vietnamese_diacritic": r"Ḁ-ỿ",
}
LOW = r"\u0000-⿿&&[^\p{L}]"  # punctuation: no letter, below the CJK blocks
CJK = r"぀-ヿ一-鿿가-힣"
ACTION = "bang boom crash smash thud thump whack pow crack snap kaboom blam wham thwack dom don swoosh whoosh zoom vroom dash dart slash stab slice chop rip tear".split()
EMOTION = "haha hehe hihi haa hah lol sigh phew huh hmm hmph wow yay argh ugh arghh yikes ah oh eh oi ow ouch wah uwah".split()
AMBIENT = "drip tick tock buzz hum chirp rustle creak click clack tap tap-tap whisper shhh hush rumble patter splash plop ring ding ringring ringg".split()
RATE_LIMIT = r"(?i)HTTP 429|rate.?limit|too many requests|quota|retryDelay"
OUT_OF_MEMORY = "out of memory|cudaerrormemoryallocation|alloc_failed|outofmemory|cuda_error_out_of_memory"
NAME = r"\b[A-Z][A-Za-z]{2,}(?:-[A-Za-z]+)?\b"
HONORIFIC = r"\b[A-Z][a-zA-Z]{1,15}-(?:san|chan|kun|sama|senpai|sensei|dono|tan|nee|nii)\b"
EMPTY_TRANSLATIONS = ("...", "…", "???")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count(text: Column, chars: str) -> Column:
    return F.regexp_count(_text(text), F.lit(f"[{chars}]"))


def strip(text: Column) -> Column:
    return F.regexp_replace(_text(text), f"^[{SPACE}]+|[{SPACE}]+$", "")


@functools.cache
def _classes() -> dict[str, np.ndarray]:
    """For each kind of character, whether each code point is one."""
    points = np.arange(0x110000)
    category = np.array([unicodedata.category(chr(c)) for c in points])

    def within(chars: str) -> np.ndarray:
        found = np.zeros(len(points), bool)
        found[[ord(c) for c in re.findall(f"[{chars}]", "".join(map(chr, points)))]] = True
        return found

    letter, space, digit = np.char.startswith(category, "L"), within(SPACE), within(DIGIT.replace(r"\p{Nd}", "")) | (category == "Nd")
    low = (points <= 0x2FFF) & ~letter
    told = ~(low | space | digit)
    scripts = {k: within(v) for k, v in SCRIPTS.items()}
    foreign = letter & np.any([v for k, v in scripts.items() if k != "latin"], axis=0)
    return {
        "space": space, "letter": letter | within("぀-ヿ"), "digits": digit, "punct": low & ~space & ~digit, "letters": told, "all": told & letter, "foreign": told & foreign,
        "other": (letter | (points >= 0x3000)) & ~scripts["latin"] & ~space & ~digit, **{k: told & v for k, v in scripts.items()},
    }


@functools.cache
def _kinds(names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each code point by what it is of ``names``, and what each kind is."""
    bits = sum(_classes()[k].astype("u4") << i for i, k in enumerate(names))
    found, kind = np.unique(bits, return_inverse=True)
    return kind.astype("u1"), (found[:, None] >> np.arange(len(names))) & 1


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts one after the other, and how many each has; null has none."""
    whole = "".join(texts.fill_null("").to_pylist()).encode("utf-32-le")
    return np.frombuffer(whole, "<u4"), pc.utf8_length(texts.fill_null("")).to_numpy(zero_copy_only=False).astype("i8")


COUNTED = ("space", "digits", "punct", "letters", "all", "foreign", "other", *SCRIPTS)


def _counted(texts: pa.Array) -> pa.Array:
    """How many characters of each kind a text has, in one pass."""
    kind, of = _kinds(COUNTED)
    at, n = _points(texts)
    cells = np.repeat(np.arange(len(n)) * len(of), n)
    cells += kind[at]
    each = np.bincount(cells, minlength=len(n) * len(of)).reshape(len(n), len(of)) @ of
    return pa.StructArray.from_arrays([pa.array(each[:, i].astype("i4")) for i in range(len(COUNTED))], list(COUNTED))


def script_profile(text: Column) -> Column:
    """Struct of the primary script, letters, punct, digits, is_short_sfx, counts by script and nine flags: white space, digits, punctuation, then the first script range.

    Every text is read once: its characters are looked up in a table of their kinds and counted.
    """
    return let(F.arrow_udf(_counted, f"struct<{', '.join(f'{k}: int' for k in COUNTED)}>")(_text(text)), _profile)


def _profile(found: Column) -> Column:
    digits, punct = found["digits"], found["punct"]
    # every letter that no range has counts as Latin; texts of Latin letters alone need no other count
    latin = F.greatest(found["latin"], found["all"] - found["foreign"])
    others = [k for k in SCRIPTS if k != "latin"]
    mixed = F.struct(*[found[k].alias(k) for k in others], latin.alias("latin"))
    plain = F.struct(*[F.lit(0).alias(k) for k in others], found["letters"].alias("latin"))
    counts = F.when(found["other"] > 0, mixed).otherwise(plain)

    def verdict(n: Column) -> Column:
        kana = n["hiragana"] + n["katakana"]
        families = ((kana + n["kanji"]) > 0).cast("int") + (n["hangul"] > 0).cast("int") + (n["latin"] > 0).cast("int")
        one = (
            F.when(kana > 0, "ja").when(n["hangul"] > 0, "ko").when(n["kanji"] > 0, "zh").when(n["vietnamese_diacritic"] > 0, "vi").when(n["latin"] > 0, "en").otherwise("unknown")
        )
        primary = F.when((families >= 2) & ~one.isin("ja"), "mixed").otherwise(one)
        total = kana + n["kanji"] + n["hangul"] + n["vietnamese_diacritic"] + n["latin"]
        return F.struct(
            primary.alias("primary"), total.alias("letters"), punct.alias("punct"), digits.alias("digits"),
            *[(n[k] > 0).alias(f"has_{k}") for k in SCRIPTS], ((n["kanji"] > 0) & (kana == 0)).alias("has_hanzi_only"), (digits > 0).alias("has_digit"),
            (punct > 0).alias("has_punct"), F.struct(*[n[k].alias(k) for k in SCRIPTS]).alias("counts"), ((total >= 1) & (total <= 3) & (punct >= 1)).alias("is_short_sfx"),
        )

    return let(counts, verdict)


def has_cjk(text: Column) -> Column:
    return F.regexp_like(_text(text), F.lit(f"[{CJK}]"))


def has_latin_letters(text: Column) -> Column:
    return count(text, "A-Za-z") >= 2


_LETTER = r"\p{L}぀-ヿ"


def is_gibberish(text: Column) -> Column:
    """Fewer than two visible characters, no letter, or up to four characters of which under two fifths are letters."""
    t, seen = _text(text), f"[^{SPACE}]"
    visible = F.length(F.regexp_replace(t, f"[{SPACE}]", ""))
    few = F.when(~F.regexp_like(t, F.lit(f"(?:{seen}[{SPACE}]*+){{5}}")), count(t, _LETTER) < 0.4 * visible).otherwise(False)
    return ~F.regexp_like(t, F.lit(f"{seen}[{SPACE}]*+{seen}")) | ~F.regexp_like(t, F.lit(f"[{_LETTER}]")) | few


def _gibberish_words(texts: pa.Array) -> pa.Array:
    kind, of = _kinds(("space", "letter"))
    at, n = _points(texts)
    row = np.repeat(np.arange(len(n)), n)
    is_ = of.astype(bool)[kind[at]] if len(at) else np.zeros((0, 2), bool)
    seen = np.flatnonzero(~is_[:, 0])
    if not len(seen):
        return pa.array(np.zeros(len(n), "i4"))
    # a word begins after white space or with its text
    new = np.flatnonzero((np.diff(seen, prepend=-2) != 1) | (np.diff(row[seen], prepend=-1) != 0))
    size, letters = np.diff(new, append=len(seen)), np.add.reduceat(is_[seen, 1].astype("i4"), new)
    odd = (size == 1) | (letters == 0) | ((size >= 3) & (size <= 4) & (letters == 1))
    return pa.array(np.bincount(row[seen[new[odd]]], minlength=len(n)).astype("i4"))


def gibberish_words(text: Column) -> Column:
    """How many of a text's words are gibberish: of one character, without letters, or of three or four with a single letter. All words of a batch are looked at together."""
    return F.arrow_udf(_gibberish_words, "int")(_text(text))


def is_real_translation(text: Column) -> Column:
    t = strip(text)
    return (t != "") & ~t.isin(*EMPTY_TRANSLATIONS)


def sanitize_punctuation(text: Column) -> Column:
    t = F.regexp_replace(_text(text), r"\.{4,}", "...")
    t = F.regexp_replace(t, r"\?{3,}", "??")
    t = F.regexp_replace(t, r"[?!]{4,}", "?!")
    return strip(F.regexp_replace(t, f"[{SPACE}]+([!?,.])", "$1"))


def dedupe_words(text: Column) -> Column:
    """Drops a word of over three letters equal, but for case, to the word kept before it."""
    words = F.split(F.regexp_replace(strip(text), f"[{SPACE}]+", " "), " ")
    same = lambda kept, w: (F.length(w) > 3) & (F.lower(F.element_at(kept, -1)) == F.lower(w))
    fold = F.aggregate(words, F.array().cast("array<string>"), lambda kept, w: F.when((F.size(kept) > 0) & same(kept, w), kept).otherwise(F.concat(kept, F.array(w))))
    return F.array_join(fold, " ")


def clean_ocr(text: Column) -> Column:
    t = strip(text)
    cut = F.regexp_replace(F.regexp_replace(t, "_+$", "."), "[;:]+$", ".")
    return F.when(F.regexp_like(t, F.lit(r"[぀-ヿ㐀-鿿가-힯]")), t).otherwise(dedupe_words(cut))


def names(text: Column) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(f"({NAME})"), 1)


def sfx_subtype(text: Column) -> Column:
    """Sub-type of an effect: by lexicons of its text without marks about it, also with repeated letters as one, else by its script.

    A text of over a dozen runs of letters is no word of a lexicon, whatever its length: only its beginning is looked up.
    """
    marks = "?!.,'\""
    runs = rf"(?s)^[{SPACE}]*+[{marks}]*+(?:(.)\1*+){{13,}}?[^{marks}{SPACE}]"
    long = (F.length(_text(text)) > 100) & F.regexp_like(F.lower(_text(text)), F.lit(runs))
    head = F.regexp_extract(F.lower(_text(text)), f"(?s)^[{SPACE}]*+[{marks}]*+(.{{0,12}})", 1)
    emotion = F.lit("^(" + "|".join(EMOTION) + ")")
    bare = F.regexp_replace(F.lower(strip(text)), rf"^[{marks}]+|[{marks}]+$", "")
    short = let(bare, lambda t: let(F.regexp_replace(t, r"(.)\1+", "$1"), lambda compact: (
        F.when(t == "", "unknown").when(t.isin(EMOTION) | compact.isin(EMOTION) | F.regexp_like(t, emotion), "emotion")
        .when(t.isin(ACTION) | compact.isin(ACTION), "action").when(t.isin(AMBIENT) | compact.isin(AMBIENT), "ambient")
    )))
    told = F.when(long, F.when(F.regexp_like(head, emotion), "emotion")).otherwise(short)
    has = lambda k: F.regexp_like(_text(text), F.lit(f"[{SCRIPTS[k]}]"))
    by_script = (
        F.when(has("kanji") & (script_profile(text)["punct"] > 0), "action").when(has("katakana") & ~has("hiragana"), "action").when(has("hiragana"), "ambient").otherwise("unknown")
    )
    return F.coalesce(told, by_script)


def sfx_role(text: Column, cls: Column, area_share: Column, aspect: Column, conf: Column) -> Column:
    """Struct of role, confidence and preserve; the first rule that holds decides.

    A text with four letters, one of them Latin, needs no profile: it is neither short nor purely Chinese or Japanese.
    """
    t = _text(text)
    counted, free, huge, large = F.length(t) > 0, cls == 1, area_share >= 0.025, area_share >= 0.025 * 0.6
    is_ = lambda role, conf, keep: F.struct(F.lit(role).alias("role"), F.lit(conf).alias("role_conf"), F.lit(keep).alias("preserve"))

    def decided(letters: Column, n: Column, pure: Column, punct: Column) -> Column:
        sfx = free & (pure | huge | (large & (n < 4)))
        short = free & ((n <= 3) | (punct & (letters <= 3)))
        return (
            F.when(~free & counted & (letters >= 2), is_("dialogue", 0.85, False)).when(free & (aspect <= 0.6) & (F.length(t) >= 12), is_("narration", 0.70, False))
            .when(sfx, is_("sfx", 0.75, True)).when(short, is_("sfx", 0.65, True)).when(~free & (n <= 3) & counted & (letters >= 1), is_("dialogue", 0.60, False))
            .when(free, is_("narration", 0.55, False)).otherwise(is_("dialogue", 0.50, False))
        )

    def profiled(p: Column, n: Column) -> Column:
        return decided(p["letters"], n, p["primary"].isin("ja", "zh") & ~p["has_latin"], p["punct"] > 0)

    many = F.regexp_like(t, F.lit(f"(?:[{_LETTER}][^{_LETTER}]*+){{4}}")) & F.regexp_like(t, F.lit("[A-Za-zÀ-ÖØ-öø-ɏ]"))
    whole = let(script_profile(text), lambda p: let(count(strip(text), _LETTER), lambda n: profiled(p, n)))
    return F.when(many, decided(F.lit(4), F.lit(4), F.lit(False), F.lit(False))).otherwise(whole)


def is_rate_limit(message: Column) -> Column:
    return F.regexp_like(_text(message), F.lit(RATE_LIMIT))


def is_out_of_memory(kind: Column, message: Column) -> Column:
    k = F.lower(_text(kind))
    return (k == "memoryerror") | F.regexp_like(k, F.lit("outofmemory|oom")) | F.regexp_like(F.lower(_text(message)), F.lit(OUT_OF_MEMORY))


def retry_seconds(message: Column, header: Column) -> Column:
    """Seconds to wait that an error names, with its margin, else the header's, else 30."""
    number = lambda c: F.floor(F.nullif(c, F.lit("")).try_cast("double")).cast("int")
    named = lambda pattern: number(F.regexp_extract(_text(message), pattern, 1)) + 2
    return F.coalesce(named(r'"retryDelay"\s*:\s*"(\d+(?:\.\d+)?)s"'), named(r"(?i)try again in (\d+(?:\.\d+)?)s"), number(header) + 1, F.lit(30))


def prompt_tag(role: Column, turn: Column, text: Column) -> Column:
    """A text with its role and turn before it, as a prompt shows it."""
    tag = F.when(role == "narration", "NAR").when(role == "sfx", "SFX").otherwise("DLG")
    return F.concat(F.lit("["), tag, F.lit("|"), turn, F.lit("] "), _text(text))


def parse_translations(reply: Column, n: Column) -> Column:
    """n texts of a reply: a JSON array, alone, under a known key or inside other text, padded or cut to n."""
    t = F.regexp_replace(strip(reply), r"^```[a-zA-Z]*\s*|\s*```$", "")
    keyed = [F.from_json(F.get_json_object(t, f"$.{k}"), "array<string>") for k in ("translations", "result", "output", "items")]
    inside = F.from_json(F.nullif(F.regexp_extract(t, r"(?s)(\[.*\])", 1), F.lit("")), "array<string>")
    whole = F.when(t.startswith("["), F.from_json(t, "array<string>"))
    found = F.transform(F.coalesce(whole, *keyed, inside, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")))
    return F.slice(F.concat(found, F.array_repeat(F.lit(""), n)), F.lit(1), n)


def cache_key(model: Column, target: Column, text: Column) -> Column:
    zero = F.lit(bytearray(1))
    return F.sha2(F.concat(F.encode(model, "UTF-8"), zero, F.encode(target, "UTF-8"), zero, F.encode(_text(text), "UTF-8")), 256)


def keep_honorifics(src: Column, tgt: Column) -> Column:
    """The translation with the suffix of each name of the source put back where the name first stands bare."""

    def put(t: Column, full: Column) -> Column:
        name = F.regexp_extract(full, "^[A-Za-z]+", 0)
        end = F.instr(t, name) + F.length(name)
        fixed = F.concat(F.substr(t, F.lit(1), end - 1), F.substr(full, F.length(name) + 1), F.substr(t, end))
        return F.when((F.instr(t, name) > 0) & ~F.contains(t, full), fixed).otherwise(t)

    return F.aggregate(F.regexp_extract_all(_text(src), F.lit(HONORIFIC), 0), _text(tgt), put)
