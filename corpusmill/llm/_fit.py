"""Bounded, repeatable samples of labelled documents for fitting classifiers on the driver."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm._scratch import cut, drop


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def sample(docs: DataFrame, per_class: int, max_bytes: int, marks: DataFrame | None = None) -> list[tuple[str, object]]:
    """(text, label) of up to per_class documents of each label, those with the least hash of their id and text, in its order.

    docs: (_key, _text, _label) of the rows that may be used, or (_key, _text) where marks has (_id, _label), the labels by _key;
    texts are not shuffled for it. Rows that agree in all three count once. Labels are counted,
    and rows whose hash is above about four times the share that is wanted of their label are left out at once, so what the
    driver gathers is bounded however many rows there are, and no label, however frequent, is ranked in one task. Texts are
    fetched for the ranked rows alone. max_bytes: of text, over all labels; a text that would pass it is left out, and the next
    ones are tried.
    """
    texts = docs.where(F.length("_text") > 0).withColumn("_place", F.pmod(F.xxhash64("_key", "_text", F.lit(99)), F.lit(1 << 40)))
    rows = texts.select("_key", "_place", F.octet_length("_text").alias("_bytes"), *(["_label"] if marks is None else []))
    if marks is not None:
        rows = rows.join(marks.distinct(), F.col("_key") == F.col("_id")).drop("_id")
    rows = cut(rows.distinct(), "labelled")
    counts = rows.groupBy(F.col("_label").alias("_l")).agg(F.count(F.lit(1)).alias("_n"))  # one row for each label
    share = F.col("_place").cast("double") * F.col("_n") < F.lit(float((4 * per_class + 100) * (1 << 40)))
    near = rows.join(counts, F.col("_label") == F.col("_l")).where(share).select("_key", "_place", "_bytes", "_label")
    taken, ranked, total, order, picked = Counter(), Counter(), 0, [], []
    for r in sorted(near.collect(), key=lambda r: (r["_place"], str(r["_key"]))):
        order.append((ranked[r["_label"]], str(r["_label"]), r))
        ranked[r["_label"]] += 1
    for _, _, r in sorted(order, key=lambda x: x[:2]):  # the labels take turns
        if taken[r["_label"]] < per_class and total + r["_bytes"] <= max_bytes:
            taken[r["_label"]] += 1
            total += r["_bytes"]
            picked.append((r["_key"], r["_place"], r["_label"]))
    if not picked:
        return []
    kind = docs.schema["_key"].dataType
    wanted = docs.sparkSession.createDataFrame([(k, p) for k, p, _ in picked], T.StructType().add("_k", kind).add("_p", "long")).distinct()
    found = texts.join(F.broadcast(wanted), (F.col("_key") == F.col("_k")) & (F.col("_place") == F.col("_p"))).select("_key", "_place", "_text").dropDuplicates(["_key", "_place"]).collect()
    by_row = {(r["_key"], r["_place"]): r["_text"] for r in found}
    drop(rows)
    return [(by_row[k, p], label) for k, p, label in picked]
