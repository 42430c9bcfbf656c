"""Stable hashes, splits and samples as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK16, MASK32 = (1 << 16) - 1, (1 << 32) - 1
#: Fixed values of SplitMix64: the increment and the two multipliers.
SPLITMIX_STEP, SPLITMIX_A, SPLITMIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def sha1_bucket(key: Column, buckets: int, salt: str = "") -> Column:
    """The first 32 bits of sha1(salt + key), modulo buckets: the same on every engine and run."""
    text = F.concat(F.lit(salt), key.cast("string")) if salt else key.cast("string")
    return F.pmod(F.conv(F.substring(F.sha1(text.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def shard_of(key: Column, shards: int = 256) -> Column:
    return sha1_bucket(key, shards)


def sampled(key: Column, percent: float, salt: str = "sample:") -> Column:
    """Whether a key is in the sample; a larger percent only adds keys. Two salts give independent samples."""
    if percent <= 0:
        return F.lit(False)
    return F.lit(True) if percent >= 100 else sha1_bucket(key, 100, salt) < percent


def in_train(key: Column, ratio: float, seed: int = 42) -> Column:
    """Train side of a split by key, stable as rows come and go."""
    return sha1_bucket(key, 10_000, f"{seed}:") < int(ratio * 10_000)


def unsigned_text(bits: Column) -> Column:
    """A 64-bit pattern as 16 hexadecimal digits."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _staged(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select("*", *[c.alias(f"_m_{k}") for k, c in columns.items()])


def _multiplied(df: DataFrame, x: str, factor: int, out: str) -> DataFrame:
    """df with out = x * factor modulo 2**64, from partial products of at most 49 bits (a plain product would raise)."""
    low, high = factor & MASK32, factor >> 32
    keep = df.columns
    c, m = F.col, lambda name: F.col(f"_m_{name}")
    df = _staged(df, a0=c(x).bitwiseAND(F.lit(MASK16)), a1=F.shiftrightunsigned(x, 16).bitwiseAND(F.lit(MASK16)), b0=F.shiftrightunsigned(x, 32).bitwiseAND(F.lit(MASK16)), b1=F.shiftrightunsigned(x, 48))
    df = _staged(
        df, p=m("a0") * F.lit(low), q=m("a1") * F.lit(low),
        r=m("b0") * F.lit(low) + F.shiftleft((m("b1") * F.lit(low)).bitwiseAND(F.lit(MASK16)), 16) + m("a0") * F.lit(high) + F.shiftleft((m("a1") * F.lit(high)).bitwiseAND(F.lit(MASK16)), 16),
    )
    df = _staged(df, s=F.shiftleft(F.shiftright(m("p"), 16) + m("q"), 16).bitwiseOR(m("p").bitwiseAND(F.lit(MASK16))))
    top = (F.shiftrightunsigned(m("s"), 32) + m("r")).bitwiseAND(F.lit(MASK32))
    return df.select(*keep, F.shiftleft(top, 32).bitwiseOR(m("s").bitwiseAND(F.lit(MASK32))).alias(out))


def with_splitmix64(df: DataFrame, x: str, out: str) -> DataFrame:
    """df with out = SplitMix64 of the long column x, as a bit pattern in a long.

    Each step is a column of its own: as one expression, every use of a step would repeat all steps before it.
    """
    keep = df.columns
    low = F.col(x).cast("long").bitwiseAND(F.lit(MASK32)) + F.lit(SPLITMIX_STEP & MASK32)
    df = df.select("*", low.alias("_z_low"), F.shiftrightunsigned(F.col(x).cast("long"), 32).alias("_z_high"))
    high = F.col("_z_high") + F.lit(SPLITMIX_STEP >> 32) + F.shiftright("_z_low", 32)
    df = df.select(*keep, F.shiftleft(high.bitwiseAND(F.lit(MASK32)), 32).bitwiseOR(F.col("_z_low").bitwiseAND(F.lit(MASK32))).alias("_z0"))
    for k, (shift, factor) in enumerate(((30, SPLITMIX_A), (27, SPLITMIX_B))):
        df = df.select(*keep, F.col(f"_z{k}").bitwiseXOR(F.shiftrightunsigned(f"_z{k}", shift)).alias("_zx"))
        df = _multiplied(df, "_zx", factor, f"_z{k + 1}").drop("_zx")
    return df.select(*keep, F.col("_z2").bitwiseXOR(F.shiftrightunsigned("_z2", 31)).alias(out))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band_keys(sig: Column, bands: int) -> Column:
    """(band, value) of the 64 div bands bits of each band; left-over high bits are not used."""
    width = 64 // bands
    mask = F.lit(_signed((1 << width) - 1))
    return F.array(*[F.struct(F.lit(k).alias("band"), F.shiftrightunsigned(sig, k * width).bitwiseAND(mask).alias("value")) for k in range(bands)])


def content_key(values: Column) -> Column:
    """First 16 hexadecimal digits of the sha256 of the sorted distinct strings, joined by NUL."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(values)), "\0").cast("binary"), 256), 1, 16)
