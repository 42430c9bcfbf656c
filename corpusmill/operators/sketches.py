"""Sketches that are stored for each part of a corpus and merged over parts and runs: distinct counts, quantiles, frequent items.

A sketch has a bounded size whatever it has seen, so a new part is counted by itself and merged with what is stored; texts are not
read again. The bounds are those of the sketches at the sizes below: 3 standard errors for distinct counts and ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as X

#: log2 of the distinct sketch's buckets, the quantile sketch's size, how many items the frequent sketch tells and holds.
LG_BUCKETS, RANKS, TOP, HELD = 14, 400, 10, 10_000
DISTINCT_BOUND, RANK_BOUND = 3 * 1.04 / 2 ** (LG_BUCKETS / 2), 0.02


def part_sketches(docs: DataFrame, part: list[str], text: str = "text") -> DataFrame:
    """One row a part: sketches of its words and of its texts' lengths in words. Words are counted before they are sketched."""
    rows = docs.select(*part, X.words(F.col(text)).alias("_w"))
    lengths = rows.groupBy(*part).agg(F.kll_sketch_agg_bigint(F.size("_w").cast("long"), RANKS).alias("lengths"))
    words = rows.select(*part, F.explode("_w").alias("_w"))
    told = words.groupBy(*part).agg(F.hll_sketch_agg("_w", F.lit(LG_BUCKETS)).alias("words"), F.expr(f"approx_top_k_accumulate(_w, {HELD})").alias("top"))
    return lengths.join(told, part, "left")


def merged(sketches: DataFrame, group: list[str]) -> DataFrame:
    """Sketches of groups of parts, from those of the parts alone."""
    return sketches.groupBy(*group).agg(
        F.hll_union_agg("words").alias("words"), F.expr(f"approx_top_k_combine(top, {HELD})").alias("top"), F.expr("kll_merge_agg_bigint(lengths)").alias("lengths")
    )


def estimates(sketches: DataFrame) -> DataFrame:
    """What sketches tell: distinct words, the median length, and the TOP most frequent words with their counts."""
    return sketches.withColumn("about", F.hll_sketch_estimate("words")).withColumn("median", F.expr("kll_sketch_get_quantile_bigint(lengths, 0.5d)")).withColumn("frequent", F.expr(f"approx_top_k_estimate(top, {TOP})")).drop("words", "lengths", "top")


def held_against_exact(docs: DataFrame, part: str, group: str) -> DataFrame:
    """For each group, sketches of its parts merged, against exact counts: words and about with error, the share of lengths below the
    sketched median with its distance from a half, and the greatest error of the TOP frequent counts; each with whether it is inside
    its bound."""
    told = estimates(merged(part_sketches(docs, [part, group]), [group]))
    rows = docs.select(group, X.words(F.col("text")).alias("_w"))
    counts = rows.select(group, F.explode("_w").alias("_w")).groupBy(group, "_w").agg(F.count(F.lit(1)).alias("_n"))
    exact = counts.groupBy(group).agg(F.count(F.lit(1)).alias("words"))
    sized = rows.select(group, F.size("_w").alias("_s")).join(told.select(group, "median"), group)
    ranks = sized.groupBy(group).agg(F.avg((F.col("_s") < F.col("median")).cast("double")).alias("below"), F.avg((F.col("_s") <= F.col("median")).cast("double")).alias("up_to"))
    items = told.select(group, F.explode("frequent").alias("_f")).select(group, F.col("_f.item").alias("_w"), F.col("_f.count").alias("_about"))
    errors = items.join(counts, [group, "_w"], "left").groupBy(group).agg(F.max(F.abs(F.col("_about") - F.coalesce("_n", F.lit(0))) / F.greatest(F.coalesce("_n", F.lit(1)), F.lit(1))).alias("top_error"))
    off = F.greatest(F.col("below") - 0.5, 0.5 - F.col("up_to"), F.lit(0.0))
    return (
        told.join(exact, group).join(ranks, group).join(errors, group)
        .select(
            group, "words", F.col("about").cast("long").alias("about"), (F.abs(F.col("about") - F.col("words")) / F.col("words")).alias("words_error"), off.alias("median_error"), "top_error",
            (F.abs(F.col("about") - F.col("words")) <= DISTINCT_BOUND * F.col("words") + 1).alias("words_inside"), (off <= RANK_BOUND).alias("median_inside"), (F.col("top_error") <= 0.05).alias("top_inside"),
        )
    )
