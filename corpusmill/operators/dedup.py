"""Exact and near-duplicate groups, verdicts and keepers; connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.hashing import band_keys, hamming, with_splitmix64
from corpusmill.sources.scratch import drop, drop_since, mark, written

MAX_ROUNDS = 60
#: Signatures or rows of a bucket that are compared with as many others at once.
BLOCK = 2000


def exact_duplicates(df: DataFrame, digest: Column, name: str, status: Column | None = None) -> DataFrame:
    """df with keeper (the first name among equal digests) and status ok or duplicate; null digests are never duplicates.

    Digests are computed once and written with df, which should be narrow for that.

    The keepers are a partial aggregate per digest; joining them back lets Spark split a digest that many rows share.
    """
    marked = written(df.withColumn("_digest", digest), "digests")
    kept = marked.where("_digest is not null").groupBy("_digest").agg(F.min(name).alias("keeper"))
    out = marked.join(kept, "_digest", "left").withColumn("keeper", F.coalesce("keeper", F.col(name)))
    verdict = F.when(F.col(name) == F.col("keeper"), F.lit("ok")).otherwise(F.lit("duplicate"))
    return out.withColumn("status", verdict if status is None else F.when(status == "ok", verdict).otherwise(status)).drop("_digest")


def simhash(features: DataFrame, key: str, feature: str, hashed: bool = False) -> DataFrame:
    """(key, sig): 64-bit SimHash of each key's features (SplitMix64 of a long unless hashed). A bit is 1 if more features have
    it than not; a tie is 0."""
    bits = features.select(key, F.col(feature).alias("_h")) if hashed else with_splitmix64(features.select(key, feature), feature, "_h")
    votes = [F.sum(F.when(F.getbit("_h", F.lit(b)) == 1, 1).otherwise(-1)).alias(f"_v{b}") for b in range(64)]
    summed = bits.groupBy(key).agg(*votes)
    one = lambda b: F.when(F.col(f"_v{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    sig = one(0)
    for b in range(1, 64):
        sig = sig.bitwiseOR(one(b))
    return summed.select(key, sig.alias("sig"))


def banded(signatures: DataFrame, name: str, sig: str, bands: int = 4) -> DataFrame:
    return signatures.where(F.col(sig).isNotNull()).select(name, sig, F.explode(band_keys(F.col(sig), bands)).alias("_b")).select(name, sig, "_b.band", "_b.value")


def oversized_buckets(signatures: DataFrame, name: str, sig: str, bands: int = 4, cap: int = 2000) -> DataFrame:
    """Buckets with more than cap members."""
    return banded(signatures, name, sig, bands).groupBy("band", "value").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > cap)


def _rest(sig: Column, band: int, bands: int) -> Column:
    """The bits of sig that are not the band's, as one number."""
    width = 64 // bands
    low = sig.bitwiseAND(F.lit((1 << band * width) - 1)) if band else F.lit(0).cast("long")
    high = F.shiftrightunsigned(sig, (band + 1) * width) if (band + 1) * width < 64 else F.lit(0).cast("long")
    return F.shiftleft(high, band * width).bitwiseOR(low)


def _close_signatures(distinct: DataFrame, bands: int, most: int, block: int) -> DataFrame:
    """(sa, sb), sa < sb: distinct signatures (_s) within `most` bits that share a band's value, each pair once.

    A bucket of more than block signatures is dealt into sub-buckets: its other bits are cut into most + 1 parts, and two
    signatures within `most` bits agree in one of them. What is still larger is compared block by block.
    """
    width, left_over = 64 // bands, 64 - 64 // bands
    keys = ["_band", "_value", "_part", "_bits"]
    value = lambda k: F.shiftrightunsigned("_s", k * width).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
    placed = distinct.select("_s", F.explode(F.array(*[F.struct(F.lit(k).alias("_band"), value(k).alias("_value"), _rest(F.col("_s"), k, bands).alias("_rest")) for k in range(bands)])).alias("_b")).select("_s", "_b.*")
    sizes = placed.groupBy("_band", "_value").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    placed = placed.join(sizes, ["_band", "_value"])
    alone = F.array(F.struct(F.lit(-1).alias("_part"), F.lit(0).cast("long").alias("_bits")))
    parts = most + 1
    if parts <= left_over:
        wide = -(-left_over // parts)
        cut = F.array(*[F.struct(F.lit(p).alias("_part"), F.shiftrightunsigned("_rest", p * wide).bitwiseAND(F.lit((1 << wide) - 1)).alias("_bits")) for p in range(parts) if p * wide < left_over])
        alone = F.when(F.col("_n") > block, cut).otherwise(alone)
    placed = placed.select("_s", "_band", "_value", F.explode(alone).alias("_p")).select("_s", "_band", "_value", "_p.*")
    counted = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / block).cast("int")
    placed = placed.join(counted, keys).withColumn("_own", F.pmod(F.xxhash64("_s"), blocks).cast("int"))
    left = placed.select(*keys, F.col("_s").alias("sa"), F.col("_own").alias("_lo"), F.explode(F.sequence(F.col("_own"), blocks - 1)).alias("_hi"))
    right = placed.select(*keys, F.col("_s").alias("sb"), F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_lo"), F.col("_own").alias("_hi"))
    met = left.join(right, [*keys, "_lo", "_hi"]).where((F.col("sa") != F.col("sb")) & (hamming(F.col("sa"), F.col("sb")) <= most))
    return met.select(F.least("sa", "sb").alias("sa"), F.greatest("sa", "sb").alias("sb")).distinct()


def _by_signature(signatures: DataFrame, name: str, sig: str) -> tuple[DataFrame, DataFrame]:
    """(_name, _s) of the rows that have a signature, and (_s, _first, _n): each signature with its least name."""
    rows = written(signatures.where(F.col(sig).isNotNull() & F.col(name).isNotNull()).select(F.col(name).alias("_name"), F.col(sig).alias("_s")).distinct())
    return rows, rows.groupBy("_s").agg(F.min("_name").alias("_first"), F.count(F.lit(1)).alias("_n"))


def near_pairs(signatures: DataFrame, name: str, sig: str, bands: int = 4, most: int = 3, cap: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: pairs within `most` bits that share a band's value.

    Distinct signatures are compared; the rows of close or equal ones are then paired, block by block of rows. With a cap, the
    reference's way: a bucket of more than cap members is skipped, so more copies than that have no pair at all.
    """
    if cap is not None:
        return _capped_pairs(signatures, name, sig, bands, most, cap)
    rows, distinct = _by_signature(signatures, name, sig)
    distinct = written(distinct)
    blocks = F.ceil(F.col("_n") / block).cast("int")
    size = distinct.select("_s", blocks.alias("_blocks"))
    same = distinct.where("_n > 1").select(F.col("_s").alias("sa"), F.col("_s").alias("sb"))
    units = _close_signatures(distinct.select("_s"), bands, most, block).union(same)
    units = units.join(size.withColumnRenamed("_s", "sa").withColumnRenamed("_blocks", "_na"), "sa").join(size.withColumnRenamed("_s", "sb").withColumnRenamed("_blocks", "_nb"), "sb")
    units = units.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_na") - 1)))
    units = units.withColumn("_j", F.explode(F.sequence(F.when(F.col("sa") == F.col("sb"), F.col("_i")).otherwise(0), F.col("_nb") - 1)))
    dealt = rows.join(size, "_s").select("_name", "_s", F.pmod(F.xxhash64("_name"), F.col("_blocks")).cast("int").alias("_k"))
    left = dealt.select(F.col("_s").alias("sa"), F.col("_k").alias("_i"), F.col("_name").alias("_x"))
    right = dealt.select(F.col("_s").alias("sb"), F.col("_k").alias("_j"), F.col("_name").alias("_y"))
    met = units.select("sa", "_i", "sb", "_j").join(left, ["sa", "_i"]).join(right, ["sb", "_j"])
    inside = (F.col("sa") == F.col("sb")) & (F.col("_i") == F.col("_j"))
    met = met.where((F.col("_x") != F.col("_y")) & (~inside | (F.col("_x") < F.col("_y"))))
    return met.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).distinct()


def near_links(signatures: DataFrame, name: str, sig: str, bands: int = 4, most: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b, bits): links with the connected components of near_pairs, without a pair for each two copies.

    A signature's representative is its least name. The other rows of a signature are its members: b is a member of a, bits 0.
    Representatives of close signatures are pairs, with the bits in which they differ.
    """
    rows, distinct = _by_signature(signatures, name, sig)
    distinct = written(distinct)
    first = distinct.select("_s", "_first")
    copies = rows.join(first, "_s").where(F.col("_name") != F.col("_first")).select(F.col("_first").alias("a"), F.col("_name").alias("b"), F.lit(0).alias("bits"))
    close = _close_signatures(distinct.select("_s"), bands, most, block)
    named = close.join(first.select(F.col("_s").alias("sa"), F.col("_first").alias("a")), "sa").join(first.select(F.col("_s").alias("sb"), F.col("_first").alias("b")), "sb")
    pairs = named.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), hamming(F.col("sa"), F.col("sb")).cast("int").alias("bits"))
    return copies.union(pairs)


def text_links(signatures: DataFrame, name: str, digest: str, sig: str, bands: int = 4, most: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b, bits, copy): near_pairs of different texts, each once, and which rows are copies of a text.

    Rows of an equal digest are one class, whose representative is its least name. copy true: b is a further row of a's class, bits
    0. copy false: a and b represent two texts that share a band's value, with the bits (0 too) in which they differ.
    """
    rows = written(signatures.select(F.col(name).alias("_name"), F.col(digest).alias("_text"), F.col(sig).alias("_sig")), "signatures")
    firsts = rows.groupBy("_text").agg(F.min("_name").alias("_first"), F.first("_sig").alias("_sig"))
    copies = rows.join(firsts.select("_text", "_first"), "_text").where(F.col("_name") != F.col("_first")).select(F.col("_first").alias("a"), F.col("_name").alias("b"), F.lit(0).alias("bits"), F.lit(True).alias("copy"))
    texts = written(firsts.select("_first", "_sig"), "texts")
    pairs = near_pairs(texts, "_first", "_sig", bands, most, block=block)
    named = pairs.join(texts.select(F.col("_first").alias("a"), F.col("_sig").alias("_sa")), "a").join(texts.select(F.col("_first").alias("b"), F.col("_sig").alias("_sb")), "b")
    return copies.union(named.select("a", "b", hamming(F.col("_sa"), F.col("_sb")).cast("int").alias("bits"), F.lit(False).alias("copy")))


def _capped_pairs(signatures: DataFrame, name: str, sig: str, bands: int, most: int, cap: int) -> DataFrame:
    members = banded(signatures, name, sig, bands)
    fit = members.groupBy("band", "value").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n").between(2, cap)).drop("_n")
    members = members.join(fit, ["band", "value"])
    left = members.select("band", "value", F.col(name).alias("a"), F.col(sig).alias("_sa"))
    right = members.select("band", "value", F.col(name).alias("b"), F.col(sig).alias("_sb"))
    return left.join(right, ["band", "value"]).where((F.col("a") < F.col("b")) & (hamming(F.col("_sa"), F.col("_sb")) <= most)).select("a", "b").distinct()


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component): connected components named by their least vertex.

    Labels fall to the least label among neighbours and then to that label's own label, so chains halve each round.
    """
    before = mark()
    edges = written(pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).union(pairs.select(b, a)).distinct())
    labels = written(edges.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("label")).select(F.col("x").alias("vertex"), "label"))
    for _ in range(MAX_ROUNDS):
        near = edges.join(labels, F.col("y") == F.col("vertex")).groupBy("x").agg(F.min("label").alias("_near"))
        lower = labels.join(near, F.col("vertex") == F.col("x"), "left").select("vertex", F.least("label", F.coalesce("_near", "label")).alias("label"))
        lower = written(lower)
        jump = lower.select(F.col("vertex").alias("_v"), F.col("label").alias("_l"))
        new = written(lower.join(jump, F.col("label") == F.col("_v"), "left").select("vertex", F.col("label").alias("_before"), F.least("label", F.coalesce("_l", "label")).alias("label")))
        changed = new.join(labels.withColumnRenamed("label", "_old"), "vertex").where(F.col("label") != F.col("_old")).limit(1).count()
        drop(labels, lower)
        labels = new
        if not changed:
            drop_since(edges.sparkSession, before, new)
            return new.select("vertex", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")


def near_duplicate_verdict(items: DataFrame, groups: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """(name, keeper, drop) of grouped items: the first of each component in `order` is kept."""
    rows = items.join(groups.withColumnRenamed("vertex", name), name)
    first = F.first(name).over(Window.partitionBy("component").orderBy(*order))
    return rows.withColumn("keeper", first).withColumn("drop", F.col("keeper") != F.col(name))


def collapse(df: DataFrame, key: Column, worst: int = 3) -> tuple[DataFrame, DataFrame]:
    """Totals (rows, distinct keys, rows in groups of two or more) and the largest groups."""
    groups = df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    totals = groups.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_in_groups"))
    return totals, groups.where("n > 1").orderBy(F.col("n").desc(), F.col("key").desc()).limit(worst)
