"""Fill-in-middle: each text is cut after two drawn numbers of tokens and written as prefix, suffix, middle or suffix, prefix, middle.

Tokens are matched left to right over code points: a run of ASCII letters, or any other code point by itself. What is needed of
them are the places of two cuts, so tokens are rows, but not all at once: texts are matched in units of BLOCK tokens, the units
are exploded with their ordinals, a window sums their lengths, and the cut requests of a document are joined to the units by
ordinal; only the units that hold a cut are exploded into tokens, summed and matched in the same way. The cuts' offsets are
aggregated per document and the text is taken apart with substring.

Texts are shuffled once: rows are grouped by a 128-bit hash of id and text and by the input partition, equal rows of a partition
being counted before the shuffle, and both the units and the last join read that one exchange. Documents that stay plain are not
shuffled. A hot id or text only makes more groups: no group holds more than the equal rows of one input partition.

A null text is an empty one, so plain; a null id is drawn for as an empty string. Texts of any length are worked on whole. Rows
that repeat an id get equal draws, rows that repeat id and text equal results, each its own row. Only id_col and text_col are read,
whatever other columns are called. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TOKEN = "[A-Za-z]+|[^A-Za-z]"
#: Tokens of a unit.
BLOCK = 64
_UNIT = f"(?:[A-Za-z]++|[^A-Za-z]){{1,{BLOCK}}}+"
PLAIN_SHARE, SPM_SHARE = 10, 20
SEED = "1"


def _draw(digest: Column, k: int) -> Column:
    """The k-th (from 0) group of 8 hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long")


def _drawn(docs: DataFrame, id_col: str, text_col: str, seed: str, plain_share: int, spm_share: int) -> DataFrame:
    """id, text (null: empty), n, form and the two cuts in tokens, the smaller one first."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # A run of letters counts as one code point, any other code point as itself.
    rows = rows.select("id", "text", F.char_length(F.regexp_replace("text", "[A-Za-z]+", "a")).cast("long").alias("n"), digest.alias("_d"))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (_draw(F.col("_d"), 2) % 100 >= 100 - plain_share)
    a, b = (_draw(F.col("_d"), k) % (F.col("n") + 1) for k in (0, 1))
    form = F.when(plain, "plain").when(_draw(F.col("_d"), 3) % 100 < spm_share, "spm").otherwise("psm")
    return rows.select("id", "text", "n", form.alias("form"), F.least(a, b).alias("cut1"), F.greatest(a, b).alias("cut2"))


def _running(order: str, value: str) -> Column:
    return F.sum(value).over(Window.partitionBy("k1", "k2", "part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def _grouped(drawn: DataFrame) -> DataFrame:
    """Rows to cut, equal rows of an input partition as one with their number: the exchange that everything else reads.

    What is known of a row travels as one struct and its number is always asked for, so plans that read this share the exchange."""
    keys = F.xxhash64("id", "text").alias("k1"), F.xxhash64("text", F.lit(11), "id").alias("k2"), F.spark_partition_id().alias("part")
    found = drawn.where("form <> 'plain'").groupBy(*keys).agg(F.first(F.struct(*drawn.columns)).alias("row"), F.count(F.lit(1)).alias("copies"))
    return found.where("copies > 0").select("k1", "k2", "part", "row.*", "copies")


def cut_offsets(grouped: DataFrame) -> DataFrame:
    """For each group, the code points before its first and before its second cut (null: nothing stands before it)."""
    keys = ["k1", "k2", "part"]
    units = grouped.select(*keys, "cut1", "cut2", F.posexplode(F.regexp_extract_all("text", F.lit(_UNIT), F.lit(0))).alias("ordinal", "unit"))
    units = units.withColumn("chars", F.char_length("unit")).withColumn("end", _running("ordinal", "chars"))
    # A cut after c tokens lies behind the token with ordinal c - 1.
    wanted = lambda c: F.col(c) - 1
    holds = lambda c: F.expr(f"{c} > 0 and ({c} - 1) div {BLOCK} = ordinal")
    held = units.where(holds("cut1") | holds("cut2"))
    tokens = held.select(*keys, "cut1", "cut2", "ordinal", (F.col("end") - F.col("chars")).alias("before"), F.posexplode(F.regexp_extract_all("unit", F.lit(TOKEN), F.lit(0))).alias("place", "token"))
    tokens = tokens.withColumn("at", F.col("ordinal") * BLOCK + F.col("place")).withColumn("chars", F.char_length("token"))
    within = Window.partitionBy(*keys, "ordinal").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    tokens = tokens.withColumn("end", F.col("before") + F.sum("chars").over(within))
    found = lambda c: F.max(F.when(F.col("at") == wanted(c), F.col("end")))
    return tokens.groupBy(*keys).agg(found("cut1").alias("end1"), found("cut2").alias("end2"))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, plain_share: int = PLAIN_SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """One row per input row: id, n (tokens), form (plain, psm or spm), prefix_chars and middle_chars (code points, null if plain)
    and output. plain_share and spm_share are percentages, the latter of the rest. restored() undoes output."""
    drawn = _drawn(docs, id_col, text_col, seed, plain_share, spm_share)
    grouped = _grouped(drawn)
    ends = cut_offsets(grouped)
    cut = grouped.join(ends.hint("merge"), ["k1", "k2", "part"], "left")  # both sides lie as the exchange left them
    end1, end2 = F.coalesce("end1", F.lit(0)), F.coalesce("end2", F.lit(0))
    cut = cut.select("id", "n", "form", "text", "copies", end1.cast("long").alias("prefix_chars"), (end2 - end1).cast("long").alias("middle_chars"))
    text, rest = F.col("text"), F.col("prefix_chars") + F.col("middle_chars")
    part = lambda a, n: F.substring(text, (a + 1).cast("int"), n.cast("int"))
    prefix, middle, suffix = part(F.lit(0), F.col("prefix_chars")), part(F.col("prefix_chars"), F.col("middle_chars")), part(rest, F.char_length(text))
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    out = F.when(F.col("form") == "spm", spm).otherwise(psm)
    done = cut.select("id", "n", "form", "prefix_chars", "middle_chars", out.alias("output"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")
    none = F.lit(None).cast("long")
    plain = drawn.where("form = 'plain'").select("id", "n", "form", none.alias("prefix_chars"), none.alias("middle_chars"), F.col("text").alias("output"))
    return done.unionByName(plain).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that output was made from. In it each mark stands once: a text that holds one stays plain, and no mark can arise
    where a text meets one, for marks begin with < and end with >, and have neither inside."""
    body = F.substring(output, F.lit(1 + len(PREFIX)), F.char_length(output))
    before = lambda mark: F.substring_index(body, mark, 1)
    between = lambda mark: F.substring_index(F.substring_index(body, MIDDLE, 1), mark, -1)
    middle = F.substring_index(body, MIDDLE, -1)
    psm, spm = F.concat(before(SUFFIX), middle, between(SUFFIX)), F.concat(between(PREFIX), middle, before(PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
