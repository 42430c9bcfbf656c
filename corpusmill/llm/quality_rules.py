"""Quality rules whose cutoffs are risk-controlled: exact binomial bounds on labelled documents, per stratum.

Base figures are counted on whole texts with SQL functions alone. A ladder of cutoff vectors, fixed in advance and each
stricter than the one before, rejects a document if any figure passes its cutoff. On the labelled documents of a stratum
(a language by default) each rung is tested in order: with k of n good documents rejected, the rung is safe if
P(X <= k | n, MAX_FALSE_REJECTION) is at most ALPHA / number of strata, the exact (Clopper-Pearson) bound with Bonferroni's
correction over strata; testing stops at the first rung that isn't safe (a fixed sequence needs no correction over rungs).
The strictest safe rung is used. With probability 1 - ALPHA, no stratum loses more than MAX_FALSE_REJECTION of those of its
good documents that pass the base rule to the cutoffs; the base rule itself is given, not fitted, and no bound is claimed for
what it rejects. A stratum with too few labels (fewer than about 86 good ones, with four strata) gets no cutoffs and loses none.

A null or empty text has no words, so it fails the base rule. Texts of any length are counted whole. A null stratum is a stratum
of its own. Rows that share an id or a text are judged one by one. Only the columns named are read, so others of any name are
harmless. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm._scratch import cut

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_FALSE_REJECTION = 0.05
ALPHA = 0.05
#: Rungs: highest symbols per 100 word characters, repeated lines per 100 words, repeated-window words per 100 words,
#: word characters per word. Each rung is at least as strict as the one before it in every figure.
LADDER = (
    (40.0, 20.0, 45.0, 40.0),
    (30.0, 15.0, 40.0, 30.0),
    (25.0, 12.0, 35.0, 25.0),
    (20.0, 10.0, 30.0, 20.0),
    (15.0, 8.0, 25.0, 16.0),
    (10.0, 6.0, 20.0, 14.0),
    (7.0, 5.0, 16.0, 13.0),
    (5.0, 4.0, 12.0, 12.0),
    (3.0, 3.0, 9.0, 11.0),
    (2.0, 2.0, 6.0, 10.0),
    (1.0, 1.0, 4.0, 9.0),
)
_SPACES = " \t\n\x0b\x0c\r"


def space_words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]++"), "")


def _repeated_window_words(df: DataFrame) -> DataFrame:
    """df with _words (an array) replaced by n_words and n_repeat_words: words that stand in a run of three words which
    occurs twice or more.

    Runs are hashed; a text whose hashes are all different has none repeated. For the others, (hash, place) pairs are sorted
    and a run is repeated if a neighbour in that order has its hash. The places of repeated runs, in rising order, each cover
    three words less what the next one covers again. Each step is a column of its own, so that none is computed twice.
    """
    keep = [c for c in df.columns if c != "_words"]
    n = F.col("n_words").cast("int")
    run = lambda i: F.xxhash64(F.element_at("_words", i), F.element_at("_words", i + 1), F.element_at("_words", i + 2))
    keep.append("n_words")
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.select(*keep, F.when(n >= 4, F.transform(F.sequence(F.lit(1), n - 2), run)).alias("_runs"))
    pairs = F.sort_array(F.arrays_zip(F.col("_runs").alias("h"), F.sequence(F.lit(1), F.size("_runs")).alias("i")))
    df = df.select(*keep, F.when(F.size(F.array_distinct("_runs")) < F.size("_runs"), pairs).alias("_sorted"))
    df = df.select(*keep, F.filter(F.arrays_zip(F.col("_sorted").alias("a"), F.slice("_sorted", 2, n).alias("b")), lambda x: x["a"]["h"] == x["b"]["h"]).alias("_same"))
    df = df.select(*keep, F.sort_array(F.array_union(F.col("_same.a.i"), F.col("_same.b.i"))).alias("_places"))
    gaps = F.zip_with("_places", F.slice("_places", 2, n), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return df.select(*keep, F.coalesce(F.aggregate(gaps, F.lit(0), lambda total, g: total + g), F.lit(0)).cast("long").alias("n_repeat_words"))


def figures(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in keep and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select(
        *keep,
        space_words(text).alias("_words"),
        F.length(F.translate(text, _SPACES, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    out = out.select(
        *keep, "word_chars", "n_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), "_words"
    )
    out = _repeated_window_words(out)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def rates() -> list[Column]:
    """The figures that the ladder's columns bound."""
    chars, words = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    return [100.0 * F.col("n_symbols") / chars, 100.0 * F.col("n_dup_lines") / words, 100.0 * F.col("n_repeat_words") / words, 1.0 * F.col("word_chars") / words]


def first_rung() -> Column:
    """The lowest rung that rejects the row, the number of rungs if none does."""
    out = F.lit(len(LADDER))
    for k in reversed(range(len(LADDER))):
        hit = F.lit(False)
        for rate, most in zip(rates(), LADDER[k], strict=True):
            hit = hit | (rate > most)
        out = F.when(hit, F.lit(k)).otherwise(out)
    return out


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """log P(X <= k), X binomial (n, p), summed term by term relative to the first, in logarithms."""
    odds = F.lit(p / (1 - p))
    start = F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("total"))  # both are logarithms, less n * log(1 - p)

    def step(acc, i):
        term = acc["term"] + F.log((n - i + 1).cast("double") / i * odds)
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    terms = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(terms, start, step)["total"] + n * F.log(F.lit(1 - p))


def choose_cutoffs(judged: DataFrame, stratum: str, good: str, risk: float = MAX_FALSE_REJECTION, alpha: float = ALPHA) -> DataFrame:
    """One row per stratum of labelled rows: n_good, and rung, the strictest safe one (-1 if none is).

    judged: labelled rows that passed the base rule, with stratum, good (is it labelled good) and first (see first_rung).
    """
    rungs = F.array(*[F.lit(k) for k in range(len(LADDER))])
    held = judged.where(good).groupBy(stratum).agg(
        F.count(F.lit(1)).alias("n_good"),
        F.array(*[F.count(F.when(F.col("first") <= k, 1)) for k in range(len(LADDER))]).alias("_k"),
    )
    m = F.count(F.lit(1)).over(Window.partitionBy())  # strata
    held = held.withColumn("_limit", F.log(F.lit(alpha) / m))
    # Above n * risk the bound can't hold, so the sum is not needed there.
    tested = held.select(stratum, "n_good", "_limit", F.posexplode(F.arrays_zip(rungs.alias("rung"), F.col("_k").alias("k"))).alias("_at", "_t"))
    n, k = F.col("n_good"), F.col("_t")["k"]
    safe = F.when(k > n * risk, F.lit(False)).otherwise(log_binomial_cdf(k, n, risk) <= F.col("_limit"))
    tested = tested.withColumn("_safe", safe)
    unsafe = F.coalesce(F.min(F.when(~F.col("_safe"), F.col("_at"))), F.lit(len(LADDER)))
    return tested.groupBy(stratum).agg(F.first("n_good").alias("n_good"), (unsafe - 1).alias("rung"))


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum_col: str = "lang", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the
    stratum, its rung and the first rung that rejects the row."""
    counted = cut(figures(docs.select(id_col, stratum_col, text_col), [id_col, stratum_col], text_col).withColumn("first", first_rung()), "figures")
    marks = labels.select(F.col(id_col), (F.col(label_col) == 1).alias("_good")).where("_good is not null").distinct()
    judged = counted.where("not base_failed").join(marks, id_col)
    cutoffs = choose_cutoffs(judged, stratum_col, "_good").select(F.col(stratum_col).alias("_stratum"), "rung")
    out = counted.join(F.broadcast(cutoffs) if cutoffs.count() <= 100_000 else cutoffs, F.col(stratum_col).eqNullSafe(F.col("_stratum")), "left")
    rung = F.coalesce(F.col("rung"), F.lit(-1))
    return out.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("first") > rung)).alias("kept"),
        F.col(stratum_col).alias("stratum"), rung.alias("rung"), F.col("first").alias("first_rung"),
    )
