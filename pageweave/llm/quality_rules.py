"""Risk-controlled quality rules.

Three measures of a text (symbols a word character, share of words in repeated windows, share of duplicate
lines) are compared with cutoffs. The cutoffs stand on one ladder of steps from lenient to strict, the same for all strata;
a step rejects a document that is above any of its three cutoffs. A stratum takes the strictest step that its labelled good documents
prove harmless: with ``n`` of them of which the step rejects ``k``, the exact binomial tail ``P(Bin(n, risk) <= k)`` must stay
within the test level, which is the same as an exact upper bound of the false-rejection rate below ``risk``. The ladder is walked from its
lenient end and left at the first step that fails (fixed-sequence testing), so one level covers all of it; ``error`` is divided by the number
of strata (Bonferroni). So with probability ``1 - error`` no stratum loses more than ``risk`` of its good documents.

The bound needs trials that don't hang together: a text counts once a stratum, whatever its number of copies (near copies do count
each), and labels must be a fair draw of the stratum's documents. It is about good documents that pass the base rule; those that
fail it are rejected by that rule, outside the guarantee. Without a rejected good document, ``log(error / strata) / log(1 - risk)``
labelled texts prove a step: 144 with four strata. Strata with fewer get no cutoff: only the base rule rejects there.

Only DataFrame functions are used. Measures are narrow rows; no text is shuffled, but for labelled documents where labels are too
many to broadcast.

Defined results: null and blank texts have no words, all measures 0 and fail the base rule (fewer than 10 words); a text of any
length is measured whole, its words and their hashes in one row; a null stratum is a stratum of its own; labels that are null, or that contradict
each other for a document, don't count as good; repeated rows are measured each and are one trial; an empty table gives an
empty result; without labels only the base rule rejects. Other columns of the input, whatever their names, are neither read nor
needed by ``measure``; ``keep`` passes them through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, few, fresh, let, table, words, written

WINDOW = 5


#: The ladder's steps: largest share of symbols, of words in repeated windows, of duplicate lines.
LADDER = (
    (0.50, 0.19, 0.95), (0.40, 0.18, 0.90), (0.30, 0.17, 0.80), (0.25, 0.16, 0.70), (0.20, 0.15, 0.60), (0.15, 0.14, 0.50), (0.12, 0.13, 0.45),
    (0.10, 0.12, 0.40), (0.08, 0.10, 0.35), (0.06, 0.09, 0.30), (0.05, 0.08, 0.25), (0.04, 0.06, 0.20), (0.03, 0.05, 0.15), (0.02, 0.04, 0.10), (0.01, 0.03, 0.05),
)


@dataclass(frozen=True)
class Rules:
    """The ladder runs from lenient to strict in each of its three columns."""

    risk: float = 0.03
    error: float = 0.05
    ladder: tuple[tuple[float, float, float], ...] = LADDER
    min_words: int = 10
    max_repeat_percent: int = 20

    def grids(self) -> dict[str, tuple[float, ...]]:
        return dict(zip(("symbols", "repeats", "lines"), zip(*self.ladder, strict=True), strict=True))


def _repeat_words(w: Column) -> Column:
    """Words inside windows of five that the text holds twice or more, the first included."""

    def covered(win: Column) -> Column:
        pairs = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            again = lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | (F.get(s, j + 1)["h"] == x["h"])
            return F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(again(x, j), F.lit(False))), lambda x: x["i"]))

        def union(p: Column) -> Column:
            steps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("bigint")).otherwise(let(let(pairs, starts), union))

    def windows(h: Column) -> Column:
        at = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), at)

    hashes = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) <= WINDOW, F.lit(0).cast("bigint")).otherwise(let(let(hashes, windows), covered))


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of a text."""
    text = F.coalesce(text, F.lit(""))
    long = lambda c: c.cast("bigint")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]")))
    dup = let(lines, lambda x: F.struct(long(F.size(x)).alias("all"), long(F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    return let(
        words(text),
        lambda w: let(
            dup,
            lambda d: F.struct(
                long(F.size(w)).alias("n_words"),
                long(F.length(text) - F.regexp_count(text, F.lit(WHITE))).alias("word_chars"),
                long(F.regexp_count(text, F.lit("[#*$%&|<>]"))).alias("n_symbols"),
                d["dup"].alias("n_dup_lines"),
                _repeat_words(w).alias("n_repeat_words"),
                d["all"].alias("n_lines"),
            ),
        ),
    )


def _ratios(m: str = "") -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(m + a), F.col(m + b)), F.lit(0.0))
    return {"symbols": share("n_symbols", "word_chars"), "repeats": share("n_repeat_words", "n_words"), "lines": share("n_dup_lines", "n_lines")}


def base_failed(rules: Rules, m: str = "") -> Column:
    return (F.col(m + "n_words") < rules.min_words) | (100 * F.col(m + "n_repeat_words") > rules.max_repeat_percent * F.col(m + "n_words"))


def step_of(rules: Rules, m: str = "") -> Column:
    """The first step of the ladder that rejects the measured text; the number of steps if none does."""
    passed = lambda ratio, cuts: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c >= ratio))
    return F.least(*map(passed, _ratios(m).values(), rules.grids().values()))


def measure(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, text_hash and the measures of every text."""
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash")
    return docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), text, measures(F.col("text")).alias("m")).select("doc_id", "stratum", "text_hash", "m.*")


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, brought back by the product: full double precision for x >= 1."""
    z = x + 8.0
    back = F.log(x)
    for i in range(1, 8):
        back = back + F.log(x + float(i))
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - back


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k below the mean n * p, else 1: the exact test needs no more."""
    nd, kd = n.cast("double"), k.cast("double")
    log_top = _log_gamma(nd + 1) - _log_gamma(kd + 1) - _log_gamma(nd - kd + 1) + kd * F.log(F.lit(p)) + (nd - kd) * F.log(F.lit(1 - p))
    # terms fall at least as a normal density does: beyond nine deviations they are below a double's last digit
    steps = F.least(k, F.ceil(9 * F.sqrt(nd * p)) + 60).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))

    def add(a: Column, j: Column) -> Column:
        ratio = (kd - j) * (1 - p) / ((nd - kd + j + 1) * p)
        return F.struct((a["term"] * ratio).alias("term"), (a["sum"] + a["term"]).alias("sum"))

    total = F.aggregate(F.sequence(F.lit(0), steps), start, add, lambda a: a["sum"])
    return F.when(kd < nd * p, F.least(F.lit(1.0), F.exp(log_top) * total)).otherwise(F.lit(1.0))


def good_ids(labels: DataFrame) -> DataFrame:
    return labels.groupBy("doc_id").agg(F.min("quality").alias("lo")).where("doc_id is not null and lo = 1").select("doc_id")


def cutoffs(measured: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row a stratum that has good labels: stratum, n_good, step, cut_symbols, cut_repeats, cut_lines (null: none proven)."""
    held = measured.join(good_ids(labels), "doc_id", "left_semi").where(~base_failed(rules))
    trials = held.groupBy("stratum", "text_hash").agg(F.min(step_of(rules)).alias("at"))
    n = range(len(rules.ladder))
    counts = trials.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(F.col("at") <= i).alias(f"k_{i}") for i in n])
    tests = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"k_{i}").alias("k")) for i in n])
    n_strata = counts.agg(F.count("*").alias("n_strata"))
    fails = binomial_tail(F.col("n"), F.col("t.k"), rules.risk) > rules.error / F.col("n_strata")
    tried = counts.select("stratum", "n", F.explode(tests).alias("t")).crossJoin(F.broadcast(n_strata)).select("stratum", "n", F.when(fails, F.col("t.i")).alias("failed"))
    proven = tried.groupBy("stratum").agg(F.max("n").alias("n_good"), (F.coalesce(F.min("failed"), F.lit(len(n))) - 1).alias("step"))
    at = lambda cuts: F.get(F.array(*map(F.lit, cuts)), F.col("step"))
    return proven.select("stratum", "n_good", F.when(F.col("step") >= 0, F.col("step")).alias("step"), *[at(cuts).alias(f"cut_{r}") for r, cuts in rules.grids().items()])


def judged(measured: DataFrame, cuts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The measures with base_failed, kept and the stratum's cutoffs."""
    cuts = few(cuts.withColumnRenamed("stratum", "of"))
    out = measured.join(cuts, measured["stratum"].eqNullSafe(F.col("of")), "left").withColumn("base_failed", base_failed(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(step_of(rules) > F.col("step"), F.lit(True))).drop("of", "step")


def keep(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """The documents that the rules keep, with the columns they came with. Labelled documents are measured for the cutoffs, then all where they lie."""
    labelled = docs.join(few(good_ids(labels).withColumnRenamed("doc_id", "good")), docs["doc_id"] == F.col("good"), "left_semi")
    # written first: a filter on measures would otherwise repeat them
    cuts = written(cutoffs(written(measure(labelled, stratum), "measures"), labels, rules), "cutoffs").where("step is not null")
    m, cut = fresh(docs, "m"), fresh(docs, "cut")
    # exploded from an array of one, so that a text is measured once whatever is read of its measures
    measured = docs.withColumn(m, F.explode(F.array(measures(F.col("text")))))
    told = measured.join(few(cuts.select(F.struct("stratum", "step").alias(cut))), measured[stratum].cast("string").eqNullSafe(F.col(f"{cut}.stratum")) & F.col(cut).isNotNull(), "left")
    return told.where(~base_failed(rules, f"{m}.") & F.coalesce(step_of(rules, f"{m}.") > F.col(f"{cut}.step"), F.lit(True))).select(*[docs[c] for c in docs.columns])


def _sql(rules: Rules = Rules()) -> str:
    """The rows of the query in DuckDB, the binomial tail summed term by term."""
    grids, p = rules.grids(), rules.risk
    at = "least(" + ", ".join(f"len(list_filter([{', '.join(f'{c}::double' for c in cuts)}], lambda x: x >= {r}))" for r, cuts in grids.items()) + ")"
    tail = f"case when k < n * {p}::double then (select sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}::double) + (n - j) * ln({1 - p}::double))) from range(k + 1) x(j)) else 1.0 end"
    cuts = ", ".join(f"[{', '.join(f'{c}::double' for c in g)}][step + 1] cut_{r}" for r, g in grids.items())
    return rf"""with d as (select doc_id, lang stratum, coalesce(text, '') text, row_number() over () id from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
win as (select id, i, array_to_string(words[i:i+{WINDOW - 1}], ' ') win from (select id, words, unnest(range(1, len(words) - {WINDOW - 2})) i from w)),
often as (select id, i from (select *, count(*) over (partition by id, win) c from win) where c > 1),
covered as (select id, count(distinct i + k) n_repeat_words from often, range({WINDOW}) r(k) group by 1),
m as (select doc_id, stratum, text, len(words) n_words, length(array_to_string(words, ''))::bigint word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words, len(lines) n_lines from w left join covered using (id)),
b as (select *, n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words base_failed, coalesce(n_symbols / nullif(word_chars, 0)::double, 0) symbols,
  coalesce(n_repeat_words / nullif(n_words, 0)::double, 0) repeats, coalesce(n_dup_lines / nullif(n_lines, 0)::double, 0) as lines from m),
a as (select *, {at} step_at from b),
trials as (select distinct stratum, text, step_at from a where not base_failed and doc_id in (select doc_id from labels group by 1 having min(quality) = 1)),
tests as (select stratum, i, count(*) n, count(*) filter (where step_at <= i) k from trials, range({len(rules.ladder)}) r(i) group by 1, 2),
tried as (select *, {tail} <= {rules.error}::double / (select count(*) from (select distinct stratum from trials)) ok from tests),
steps as (select stratum, coalesce(min(i) filter (where not ok), {len(rules.ladder)}) - 1 step from tried group by 1),
cuts as (select stratum, step, {cuts} from steps where step >= 0)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(step_at > step, true) kept, cut_symbols, cut_repeats, cut_lines
from a left join cuts on cuts.stratum is not distinct from a.stratum"""


OP3_SQL = _sql()


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = written(measure(table(spark, sf_dir, "documents")), "measures")
    cuts = written(cutoffs(measured, table(spark, sf_dir, "labels")), "cutoffs")
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cut_symbols", "cut_repeats", "cut_lines"]
    return judged(measured, cuts).select(*cols)
