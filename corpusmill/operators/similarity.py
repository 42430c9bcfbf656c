"""Nearest centres by cosine: blocks of vectors times tiles of centres, for any number of centres."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators.windows import global_row_number
from corpusmill.sources.scratch import written

#: Centres in a tile, tiles that are sent and gone through in one pass, and cosines that are laid out at once.
TILE, TILES, CELLS = 16_384, 4, 1 << 20


def _matrix(column: pa.ListArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows [n, dims] of vectors, zero for a null one, and which are there."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dims))
    values = column.drop_null().flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    out[there] = np.nan_to_num(values.reshape(-1, dims))
    return out, there


def nearest(vectors: DataFrame, key: str, vector: str, centers: DataFrame, center: str, center_vector: str, k: int = 2, tile: int = TILE, floor: float = 1e-9) -> DataFrame:
    """(key, nearest): the k centres of greatest cosine of each vector, as structs (sim, id), the first one nearest; of equal ones
    that with the least id. A null vector has none; all vectors and centres have as many values.

    Centres are dealt into tiles, a few of which are broadcast at once: each pass is one kernel that multiplies blocks of vectors by
    its tiles and carries the best k along, so vectors are neither shuffled nor paired with centres. A block has as many vectors as
    give CELLS cosines with a tile, and what a pass has found is written before the next one, so a task has one worker at a time.
    """
    spark = vectors.sparkSession
    placed = written(global_row_number(centers.select(F.col(center).alias("id"), F.col(center_vector).cast("array<double>").alias("v")), ["id"], "_rn"), "centres")
    n = placed.count()
    kind = placed.schema["id"].dataType
    best = T.ArrayType(T.StructType().add("sim", T.DoubleType()).add("id", kind))
    schema = T.StructType([vectors.schema[key], T.StructField("_v", T.ArrayType(T.DoubleType())), T.StructField("nearest", best)])
    held = vectors.select(key, F.col(vector).cast("array<double>").alias("_v"), F.array().cast(best).alias("nearest"))
    in_pass = TILES * tile
    for start in range(0, n, in_pass):
        rows = placed.where(f"_rn > {start} and _rn <= {start + in_pass}").orderBy("_rn").collect()  # at most TILES tiles
        ids, matrix = [r["id"] for r in rows], np.array([r["v"] for r in rows], np.float64)
        sent = spark.sparkContext.broadcast((ids, matrix, np.sqrt((matrix**2).sum(1))))

        def kernel(batches, sent=sent):
            names, centres, norms = sent.value
            step = max(1, CELLS // min(tile, len(names)))
            for batch in batches:
                for first in range(0, batch.num_rows, step):
                    part = batch.slice(first, step)
                    own, there = _matrix(part.column(1), centres.shape[1])
                    lengths, found = np.sqrt((own**2).sum(1))[:, None], part.column(2).to_pylist()
                    for a in range(0, len(names), tile):
                        sims = (own @ centres[a : a + tile].T) / np.maximum(lengths * norms[None, a : a + tile], floor)
                        top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                        for i in np.flatnonzero(there):
                            new = [{"sim": float(sims[i, j]), "id": names[a + j]} for j in top[i]]
                            found[i] = sorted(found[i] + new, key=lambda s: -s["sim"])[:k]  # stable: earlier ids first
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, part.schema.field("nearest").type)], [key, "_v", "nearest"])

        held = held.mapInArrow(kernel, schema)
        if start + in_pass < n:
            held = written(held, "nearest")
    return held.select(key, "nearest")
