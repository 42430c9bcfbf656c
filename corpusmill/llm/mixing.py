"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis).

Each source gets a token target. Whole passes over a source come first; what is left of the target, less than one pass, is
filled by rows in the order of exponential keys -ln(u) / weight, u being a hash of the row and the seed and weight the row's
quality: heavier rows come earlier. Sizes are prefix-summed in that order up to the budget. The row on which the budget ends
is taken for the words that still fit ("cut") or as a whole where that comes nearer ("nearest").

A source is sorted bucket by bucket (buckets are ranges of the key), so that a source of any size is spread over many tasks.
Only ids, sources, sizes and keys are shuffled. Sources are totalled in Spark; that table (one row per source) is broadcast
up to MAX_BROADCAST_SOURCES rows and joined on salted keys beyond.

u is drawn from id and text, so that rows that share an id, or have none, are spread as well.

Null and empty texts have size 0, are part of whole passes and take nothing. Texts of any length are counted whole. A null
source is a source of its own, last in order. Rows that agree in id, source and text are interchangeable and share a key. Only
the three named columns are read (and those of weight), so other columns of any name are harmless. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm._order import grouped_before
from corpusmill.llm._scratch import cut, fresh

MAX_BROADCAST_SOURCES = 100_000
#: Key ranges into which a source is dealt for its running sums.
KEY_BUCKETS = 4096
SALTS = 64
_SPACES = " \t\n\x0b\x0c\r"


def space_word_count(text: Column) -> Column:
    """Words separated by ASCII white space; null has none. Counted as the spaces after words, without an array of them."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """A weight in [0.05, 1]: the share of a text's characters that are not mark-up or list symbols, squared."""
    size = F.length(text)
    marks = F.regexp_count(text, F.lit(r"[#*$%&|<>!{}]"))
    return F.when(size > 0, F.greatest(F.lit(0.05), F.pow(1 - F.least(F.lit(1.0), 5.0 * marks / size), 2.0))).otherwise(F.lit(0.05))


def source_targets(sizes: DataFrame, source: str, size: str, weights: tuple[float, ...], share: float, ceiling: float) -> DataFrame:
    """One row per source: total size, and the target that shares share x all sizes by weight, none above ceiling x its size.

    Sources by code point, null last, weigh as in weights, repeating. What a source can't take is shared again by weight
    until none is above: with sources ordered by (most it can take) / weight, those up to some place are at their ceiling.
    """
    totals = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    spark = sizes.sparkSession
    by_name = Window.orderBy(F.col(source).asc_nulls_last())  # one row per source
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("_w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_most", ceiling * F.col("source_size"))
    all_rows = Window.partitionBy()
    order = Window.orderBy((F.col("_most") / F.col("_w")).asc(), F.col(source).asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("_all", share * F.sum("source_size").over(all_rows))
        .withColumn("_full", F.coalesce(F.sum("_most").over(upto), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(upto), F.lit(0.0)))
    )
    level = (F.col("_all") - F.col("_full")) / F.col("_left")  # words per unit of weight if all earlier ones are at their ceiling
    ranked = ranked.withColumn("_level", F.when(level * F.col("_w") <= F.col("_most"), level))
    # The first source that stays below its ceiling sets the level for itself and for all later ones.
    first = F.first("_level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return cut(
        ranked.withColumn("_found", first)
        .withColumn("target", F.least(F.col("_most"), F.coalesce(F.col("_found") * F.col("_w"), F.col("_most"))))
        .select(source, "source_size", "target"),
        "targets",
    )


def _with_targets(rows: DataFrame, targets: DataFrame, source: str) -> DataFrame:
    small = targets.withColumnRenamed(source, "_source")
    if targets.count() <= MAX_BROADCAST_SOURCES:
        return rows.join(F.broadcast(small), F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_s", F.pmod(F.col("_tie"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, F.col(source).eqNullSafe(F.col("_source")) & (F.col("_s") == F.col("_salt"))).drop("_source", "_s", "_salt")


def _tie(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(text_col), F.col(id_col))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: int = 17,
    boundary: str = "cut",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Column | None = None,
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, passes (whole passes), part (words of the fractional
    pass), taken (words in all), copies (whole copies: passes, and one more if all of the row is in the fractional pass) and
    tie (a hash of id and text)."""
    if boundary not in ("cut", "nearest"):
        raise ValueError("boundary is 'cut' or 'nearest'")
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be above 0")
    text = F.col(text_col)
    w = quality_weight(text) if weight is None else weight
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary")), 1, 12)
    u = (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 48)  # md5, so that any engine can say the same
    rows = cut(
        docs.select(
            F.col(id_col), F.col(source_col), space_word_count(text).alias("size"),
            (-F.log(u) / w).alias("_key"), _tie(id_col, text_col).alias("_tie"),
        ),
        "mix-rows",
    )
    rows = _with_targets(rows, source_targets(rows, source_col, "size", weights, share, ceiling), source_col)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("passes", passes).withColumn("_budget", F.floor(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    bucket = F.floor(KEY_BUCKETS * F.col("_key") / (F.col("_key") + 1)).cast("int")  # spreads keys of light and heavy rows alike
    rows = grouped_before(rows, [source_col], bucket, [F.col("_key"), F.col("_tie"), F.col("size")], "size", "_before")
    room = F.col("_budget") - F.col("_before")
    if boundary == "cut":
        part = F.greatest(F.lit(0), F.least(F.col("size"), room))
    else:
        part = F.when(2 * room > F.col("size"), F.col("size")).otherwise(F.lit(0))
    rows = rows.withColumn("part", part.cast("long"))
    return rows.select(
        id_col, source_col, "size", "source_size", "target", "passes", "part",
        (F.col("passes") * F.col("size") + F.col("part")).alias("taken"),
        (F.col("passes") + F.when((F.col("size") > 0) & (F.col("part") == F.col("size")), 1).otherwise(0)).alias("copies"),
        F.col("_tie").alias("tie"),
    )


def repeated(docs: DataFrame, picked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every column of docs, each row as often as picked (a mix of docs or of rows with their ids and texts) has copies of it.

    Rows are matched by id and a hash of the text, nulls included. Rows that agree in both share their copies evenly; what does
    not divide goes to one of them, so that the mix has as many copies as it should. docs is joined to its own small table.
    """
    key, tie, times, rows, copy = (fresh(docs.columns, c) for c in ("_id", "_tie", "_copies", "_rows", "_copy"))
    picked = cut(picked.groupBy(F.col(id_col).alias(key), F.col("tie").alias(tie)).agg(F.sum("copies").alias(times), F.count(F.lit(1)).alias(rows)).where(F.col(times) > 0), "copies")
    joined = docs.join(picked, F.col(id_col).eqNullSafe(F.col(key)) & (_tie(id_col, text_col) == F.col(tie)))
    again = lambda df, n: df.where(n > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), n.cast("int")))).select(*docs.columns)
    out = again(joined, F.floor(F.col(times) / F.col(rows)))
    if picked.where(F.col(times) % F.col(rows) > 0).isEmpty():
        return out
    rest = joined.where(F.col(times) % F.col(rows) > 0).dropDuplicates([key, tie])
    return out.union(again(rest, F.col(times) % F.col(rows)))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every column of docs, each row as often as the mix takes it whole (boundary rows go to the nearer side)."""
    return repeated(docs, mix(docs, boundary="nearest", **how), how.get("id_col", "doc_id"), how.get("text_col", "text"))
