"""Musical keys by template matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import arrays as A
from corpusmill.functions import text as X

# How much each semitone above the tonic belongs to a major and a minor key.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)


def profiles() -> list[tuple[str, list[float]]]:
    """Label and normalised profile of each of 24 keys, majors first, in order of the tonic."""
    out = []
    for mode, shape in (("major", MAJOR), ("minor", MINOR)):
        mean = sum(shape) / 12
        deviation = (sum((x - mean) ** 2 for x in shape) / 12) ** 0.5
        z = [(x - mean) / deviation for x in shape]
        out += [(f"{pitch}_{mode}", [z[(k - tonic) % 12] for k in range(12)]) for tonic, pitch in enumerate(X.PITCHES)]
    return out


def with_key(df: DataFrame, chroma: Column, out: str) -> DataFrame:
    """df with the key whose profile correlates best with mean chroma (the first of equals); null for anything but 12 finite
    values that differ and are not all zero."""
    xs = F.when((F.size(chroma) == 12) & F.forall(chroma, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), chroma)
    z = F.when(F.aggregate(xs, F.lit(0.0), lambda t, x: t + x) > 1e-6, A.normalised_z(xs))
    fits = F.array(*[F.struct(A.dot(F.col("_z"), F.array(*[F.lit(v) for v in shape])).alias("fit"), F.lit(-k).alias("order"), F.lit(name).alias("name")) for k, (name, shape) in enumerate(profiles())])
    return df.withColumn("_z", z).withColumn(out, F.when(F.col("_z").isNotNull(), F.array_max(fits)["name"])).drop("_z")


def folded_chroma(semitones: Column, classes: int = 12) -> Column:
    """Energy of pitch classes: the absolute values of all semitones of a class, in whatever octave, summed."""
    every = F.transform(semitones, lambda x, i: F.struct(F.abs(x.cast("double")).alias("x"), (i % classes).alias("k")))
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.aggregate(F.filter(every, lambda e: e["k"] == k), F.lit(0.0), lambda a, e: a + e["x"]))
