"""Re-alignment of delayed codebooks and overlapping chunk decoding, on tables and on streams with the same results.

Steps come as (stream, step, codes): codebook k of frame f is in step f + k. A frame is complete once its last codebook has
come. On a stream the last codebooks - 1 steps are kept as state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAMES = T.StructType().add("stream", T.StringType()).add("frame", T.LongType()).add("codes", T.ArrayType(T.IntegerType()))
_STATE = T.StructType().add("steps", T.ArrayType(T.LongType())).add("codes", T.ArrayType(T.ArrayType(T.IntegerType())))


def aligned(steps: DataFrame, codebooks: int) -> DataFrame:
    """(stream, frame, codes) of all complete frames of a table of steps."""
    order = Window.partitionBy("stream").orderBy("step")
    cells = [F.lead("codes", k).over(order)[k] for k in range(codebooks)]
    reach = F.lead("step", codebooks - 1).over(order) if codebooks > 1 else F.col("step")
    rows = steps.select("stream", F.col("step").cast("long").alias("frame"), F.array(*cells).cast("array<int>").alias("codes"), reach.alias("_last"))
    return rows.where(F.col("_last") == F.col("frame") + codebooks - 1).drop("_last")


def aligned_stream(steps: DataFrame, codebooks: int) -> DataFrame:
    """aligned on a stream: frames are emitted as soon as their last codebook has come. Steps of a stream come in order over
    batches; within a batch they are sorted."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        for batch in batches:
            held.update((int(s), [int(x) for x in c]) for s, c in zip(batch["step"], batch["codes"], strict=True))
        ready, last = [], max(held)
        for f in sorted(held):
            if all(f + k in held for k in range(codebooks)):
                ready.append((key[0], f, [held[f + k][k] for k in range(codebooks)]))
        keep = [s for s in sorted(held) if s > last - codebooks + 1]
        state.update((keep, [held[s] for s in keep]))
        yield pd.DataFrame(ready, columns=["stream", "frame", "codes"])

    return steps.groupBy("stream").applyInPandasWithState(advance, FRAMES, _STATE, "append", "NoTimeout")


def emission_chunks(n_frames: int, first: int, every: int) -> list[tuple[int, int]]:
    """Frame ranges as they are emitted: the first chunk, equal ones after it, and the tail."""
    out, at = [], 0
    while at < n_frames:
        size = first if at == 0 else every
        out.append((at, min(n_frames, at + size)))
        at += size
    return out


def with_left_context(chunks: DataFrame, context: int = 16) -> DataFrame:
    """chunks (stream, chunk, frames) with the last `context` frames of those before put in front, and warm_up, their number."""
    before = Window.partitionBy("stream").orderBy("chunk").rowsBetween(-context, -1)
    history = F.flatten(F.collect_list("frames").over(before))
    tail = F.slice(history, F.greatest(F.size(history) - context + 1, F.lit(1)), F.lit(context))
    return chunks.select("stream", "chunk", F.concat(tail, "frames").alias("frames"), F.size(tail).alias("warm_up"))
