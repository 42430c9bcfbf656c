"""Robust two-level ranking, trend labels, run-over-run verdicts and percentiles by definition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.scratch import written


def robust(df: DataFrame, group: list[str], score: str, penalty: float = 0.5) -> DataFrame:
    """n, mean, std (population), low (minimum) and robust = mean - penalty * std of each group."""
    return df.groupBy(*group).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("low")).withColumn("robust", F.col("mean") - penalty * F.col("std"))


def ranked_settings(df: DataFrame, setting: str, score: str) -> DataFrame:
    """Settings with their robust score; only those with the most clips can win (eligible)."""
    table = robust(df, [setting], score)
    return table.withColumn("eligible", F.col("n") == F.max("n").over(Window.partitionBy()))


def two_level(df: DataFrame, outer: str, inner: str, score: str) -> DataFrame:
    """Robust score over inner cells' means, per outer setting: a setting must hold up in each cell."""
    cells = df.groupBy(outer, inner).agg(F.avg(score).alias("_cell"))
    return robust(cells, [outer], "_cell")


def blended(score: Column, clap: Column, low: Column, high: Column) -> Column:
    """score * (0.5 + 0.5 * clap scaled to the run's range)."""
    return score * (0.5 + 0.5 * (clap - low) / F.greatest(high - low, F.lit(1e-9)))


def fixed_blend(collapse: Column, clap: Column) -> Column:
    return collapse * (0.5 + 0.5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(clap, F.lit(0.0)) / 0.5)))


def rhythm_score(silent: Column, beat: Column, rms: Column) -> Column:
    """A gate that closes at 30 % silence, times 0.6 * beat + 0.4 * level; the level's term is 1 at 0.10, falls to 0 at 0 and
    0.20, and is 0 outside 0.02 to 0.35."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    level = F.when((rms < 0.02) | (rms > 0.35), F.lit(0.0)).otherwise(unit(1 - F.abs(rms - 0.10) / 0.10))
    return unit(1 - silent / 0.30) * (0.60 * F.least(beat, F.lit(1.0)) + 0.40 * level)


def composite(clap: Column, flat: Column, silent: Column, onset: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return zero(clap) - 0.5 * zero(flat) - 0.8 * zero(silent) + 0.2 * zero(onset)


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def most_frequent(df: DataFrame, group: str, value: str, k: int, hashed: Column | None = None) -> DataFrame:
    """(group, value, n): the k most frequent values of each group, of equal ones the least value; for values that are long and mostly
    rare.

    Hashes (64 bits, or what hashed says) are counted first, so that only they are shuffled. The values of the k most frequent hashes
    of each group, with ties, are then counted themselves in a second pass over df. Where two of them share a hash, hashes say too
    little, and all values are counted.
    """
    marked = df.select(group, value, (F.xxhash64(value) if hashed is None else hashed).alias("_h"))
    counts = marked.groupBy(group, "_h").agg(F.count(F.lit(1)).alias("_c"))
    near = written(counts.withColumn("_r", F.rank().over(Window.partitionBy(group).orderBy(F.col("_c").desc()))).where(F.col("_r") <= k).select(F.col(group).alias("_g"), F.col("_h").alias("_k"), "_c"), "frequent")
    held = marked.join(near, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_h") == F.col("_k")))
    exact = written(held.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.first("_c").alias("_c")), "counted")
    if not exact.where(F.col("n") != F.col("_c")).isEmpty():
        exact = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(exact.select(group, value, "n"), group, [F.col("n").desc(), F.col(value)], k).drop("rank")


def trend(n: Column, slope: Column, band: float = 0.01) -> Column:
    """falling, rising or flat by a regression's slope; "" for fewer than three points."""
    return F.when(n < 3, "").when(slope < -band, "falling").when(slope > band, "rising").otherwise("flat")


def gap_verdict(train: Column, val: Column) -> Column:
    gap = val - train
    return F.when(gap > 0.15, "overfit").when(gap < 0.05, "healthy").otherwise("watch")


def floor_verdict(count: Column, percent: Column, min_percent: float = 4.0, min_count: int = 8000) -> Column:
    return F.when((percent >= min_percent) & (count >= min_count), "CLOSED").otherwise("OPEN")


def nearest_rank(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The floor(n * p)-th value from 0 of each group in rising order, for each named share.

    Equal values are counted, and the counts summed along ranges of (group, value): a group of any size is spread over tasks.
    """
    from corpusmill.operators.windows import running_sum

    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = running_sum(counts, [*group, value], "_c", "_earlier")
    whole = placed.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(F.min("_earlier").alias("_base"), F.sum("_c").alias("_n"))
    match = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    rows = placed.join(whole, match).withColumn("_at", F.col("_earlier") - F.col("_base"))
    wanted = lambda p: F.least(F.floor(F.col("_n") * p), F.col("_n") - 1)
    pick = lambda p: F.max(F.when((wanted(p) >= F.col("_at")) & (wanted(p) < F.col("_at") + F.col("_c")), F.col(value)))
    return rows.groupBy(*group).agg(*[pick(p).alias(name) for name, p in shares.items()])


def upper_median(df: DataFrame, group: list[str], value: str) -> DataFrame:
    return nearest_rank(df, group, value, {"median": 0.5})


def percentile_vector(value: str) -> list[Column]:
    """min, p10, p25, p50, p75, p90, p99, max and mean, percentiles interpolated linearly and exact."""
    named = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
    return [F.min(value).alias("min"), *[F.percentile(value, F.lit(p)).alias(k) for k, p in named.items()], F.max(value).alias("max"), F.avg(value).alias("mean")]


def entropy_stats(df: DataFrame, group: list[str], token: str, vocab: int) -> DataFrame:
    """Normalised entropy and largest share of a token column per group."""
    counts = df.groupBy(*group, token).agg(F.count(F.lit(1)).alias("_c"))
    total = F.sum("_c").over(Window.partitionBy(*group))
    shares = counts.withColumn("_p", F.col("_c") / total)
    return shares.groupBy(*group).agg((-F.sum(F.col("_p") * F.ln("_p")) / F.ln(F.lit(float(vocab)))).alias("entropy"), F.max("_p").alias("top_share"))


def survival(df: DataFrame, seconds: str, candidates: list[float]) -> DataFrame:
    """For each clip length: rows at least that long, their share and hours. One pass over df."""
    counted = df.agg(F.count(F.lit(1)).alias("_all"), *[F.struct(F.count(F.when(F.col(seconds) >= c, 1)).alias("n"), F.coalesce(F.sum(F.when(F.col(seconds) >= c, F.col(seconds))), F.lit(0)).alias("s")).alias(f"_c{k}") for k, c in enumerate(candidates)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("seconds"), F.col(f"_c{k}.n").alias("survivors"), F.col(f"_c{k}.s").cast("double").alias("_s")) for k, c in enumerate(candidates)]))
    return counted.select("_all", rows.alias("_r")).select("_r.seconds", "_r.survivors", (F.col("_r.survivors") / F.greatest("_all", F.lit(1))).alias("kept"), (F.col("_r._s") / 3600).alias("hours"))


def effective_epochs(steps: int, batch: int, seconds: float, audio: Column) -> Column:
    """How often a run of steps x batch crops of some seconds sweeps the audio there is."""
    return F.lit(steps * batch * seconds) / F.greatest(audio, F.lit(1.0))


def epoch_verdict(epochs: Column) -> Column:
    return F.when(epochs < 2, "under").when(epochs <= 15, "healthy").otherwise("over")


def decoder_parameters(width: Column, layers: Column, inner: Column, text: Column, codebooks: int, vocab: int) -> Column:
    """Parameters of a decoder: embeddings and heads of each codebook, and attention, perceptron and norms of each layer."""
    tables = 2 * codebooks * vocab * width
    attention = F.when(text, 8).otherwise(4) * width * width
    norms = F.when(text, 3).otherwise(2) * width
    return tables + layers * (attention + 2 * width * inner + norms) + width
