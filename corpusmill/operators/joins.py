"""Work lists, enrichment, interval, as-of and allocation joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending(inventory: DataFrame, done: DataFrame, key: str, redo: Column | None = None) -> DataFrame:
    """Inventory rows that are not done; redo (on done's columns) says which done rows count as not done."""
    finished = done if redo is None else done.where(~F.coalesce(redo, F.lit(False)))
    return inventory.join(finished.select(key), key, "left_anti")


def gated(inventory: DataFrame, gate: DataFrame, key: str) -> DataFrame:
    """Inventory rows that are in gate; all of them while gate is empty."""
    empty = gate.agg((F.count(F.lit(1)) == 0).alias("_open"))
    passed = gate.select(key, F.lit(True).alias("_in")).distinct()
    out = inventory.join(passed, key, "left").crossJoin(F.broadcast(empty))  # one row
    return out.where(F.col("_open") | F.col("_in")).drop("_open", "_in")


def overlay(layers: list[DataFrame], key: str, value: str) -> DataFrame:
    """(key, value): each key's value in the first of the layers that has it."""
    ranked = [d.select(F.col(key), F.col(value), F.lit(k).alias("_layer")) for k, d in enumerate(layers)]
    every = ranked[0]
    for d in ranked[1:]:
        every = every.unionByName(d)
    return every.groupBy(key).agg(F.min_by(F.struct(value), "_layer")[value].alias(value))


def enrich(base: DataFrame, sides: list[tuple[DataFrame, str]]) -> DataFrame:
    """Left joins of sparse side tables (table, key); rows of base are never lost."""
    for side, key in sides:
        base = base.join(side, key, "left")
    return base


def overlapping(spans: DataFrame, windows: DataFrame, key: list[str], start: str, end: str, w_start: str, w_end: str, step: int) -> DataFrame:
    """Pairs of a span and a window of the same key with end > w_start and start < w_end, both strict.

    Spans and windows are dealt into cells of `step` along the axis and joined on key and cell; a pair is kept in the first
    cell that both touch, so that the join is on equal keys and a pair comes once. Times are whole numbers.
    """
    cell = lambda c: F.floor(F.col(c) / step)
    a = spans.withColumn("_cell", F.explode(F.sequence(cell(start), F.greatest(cell(start), cell(end)))))
    b = windows.withColumn("_wcell", F.explode(F.sequence(cell(w_start), F.greatest(cell(w_start), cell(w_end)))))
    on = [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in key] + [F.col("_cell") == F.col("_wcell"), F.col(end) > F.col(w_start), F.col(start) < F.col(w_end), F.col("_cell") == F.greatest(cell(start), cell(w_start))]
    for k in key:
        b = b.withColumnRenamed(k, f"_w_{k}")
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return a.join(b, condition).drop("_cell", "_wcell", *[f"_w_{k}" for k in key])


def as_of(points: DataFrame, events: DataFrame, key: list[str], at: str, event_at: str, values: list[str], forward: bool = False, inclusive: bool = True) -> DataFrame:
    """points with the values of the last event at or before (forward: the first at or after) each point of its key.

    The union of both sides is dealt into ranges of key and time, however many rows a key has, and each range is gone through
    once in the direction in which events are handed on; no pairs. The last event of a range is handed to the ranges after it
    that begin with the same key (a row for each range). inclusive False leaves out events at the very time of the point.
    """
    from corpusmill.operators.windows import handed_on

    payload = F.struct(*[F.col(v) for v in [event_at, *values]])
    extra = [c for c in points.columns if c not in (*key, at)]
    p = points.select(*key, F.col(at).alias("_at"), F.struct(*extra).alias("_point") if extra else F.lit(True).alias("_point"), F.lit(1).alias("_side"))
    e = events.select(*key, F.col(event_at).alias("_at"), payload.alias("_event"), F.lit(0).alias("_side"))
    both = p.unionByName(e, allowMissingColumns=True).withColumn("_first", F.col("_side") if inclusive else -F.col("_side"))
    order = [F.col("_at").desc() if forward else F.col("_at").asc(), F.col("_first").asc()]
    out = handed_on(both, key, order, "_event", "_found").where("_side = 1")
    return out.select(*key, F.col("_at").alias(at), *([F.col(f"_point.{c}").alias(c) for c in extra]), *[F.col(f"_found.{v}").alias(v if v not in (at, *extra) else f"event_{v}") for v in [event_at, *values]])


def active_segment(points: DataFrame, segments: DataFrame, key: list[str], at: str, start: str, end: str, label: str, default: str) -> DataFrame:
    """points with the label of the segment that holds them (start <= at < end), default without one; segments of a key do not overlap."""
    found = as_of(points, segments, key, at, start, [end, label])
    held = F.col(at) < F.col(end)
    return found.withColumn(label, F.when(held, F.col(label)).otherwise(F.lit(default))).drop(start, end)


def sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both tables and where each is: both, left or right."""
    a, b = left.select(key, F.lit(True).alias("_l")).distinct(), right.select(key, F.lit(True).alias("_r")).distinct()
    where = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left").otherwise("right")
    return a.join(b, key, "full_outer").select(key, where.alias("side"))


def stale(derived: DataFrame, source: DataFrame, key: str, n_derived: str, n_source: str) -> DataFrame:
    """source with status: missing (no derived row), stale (other count) or covered."""
    d = derived.select(key, F.col(n_derived).alias("_n"))
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") != F.col(n_source), "stale").otherwise("covered")
    return source.join(d, key, "left").withColumn("status", status).drop("_n")


def folder_number(folder: Column) -> Column:
    """The number that a folder's name ends in, as wave_2 and wave_10 do; without one, or with one beyond 64 bits, it is null."""
    return F.nullif(F.regexp_extract(folder, r"([0-9]+)\z", 1), F.lit("")).try_cast("long")


def allocate_spill(sizes: DataFrame, group: str, n: str, target: int) -> tuple[DataFrame, DataFrame]:
    """Ranges of spilled rows and of free places: (group, lo, hi) counted over all groups in order of their numbers (folder_number;
    those without one come last), then of their names, a null one last.

    The i-th spilled row (from 0) goes to the group whose free range holds i.
    """
    from corpusmill.operators.windows import running_sum

    over, under = F.greatest(F.col(n) - target, F.lit(0)), F.greatest(target - F.col(n), F.lit(0))

    def ranges(count: Column) -> DataFrame:
        rows = sizes.select(group, folder_number(F.col(group)).alias("_w"), count.alias("_c")).where("_c > 0")
        return running_sum(rows, [F.col("_w").asc_nulls_last(), F.col(group).asc_nulls_last()], "_c", "lo").select(group, "lo", (F.col("lo") + F.col("_c")).alias("hi"))

    return ranges(over), ranges(under)


def range_overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Where ranges [lo, hi) of a meet ranges of b; those of one side do not overlap. a's and b's columns, with a and b put before
    their names, and n, how much they share.

    Each meeting begins at the lo of one of the two, so every lo looks up the last range of either side that begins there or
    earlier: no pairs are compared.
    """
    side = lambda d, name: d.select(F.struct(*d.columns).alias(f"_{name}"), F.col("lo").alias(f"_{name}_lo"))
    starts = a.select(F.col("lo").alias("at")).union(b.select(F.col("lo").alias("at"))).distinct()
    held = as_of(as_of(starts, side(a, "a"), [], "at", "_a_lo", ["_a"]), side(b, "b"), [], "at", "_b_lo", ["_b"])
    met = held.withColumn("n", F.least("_a.hi", "_b.hi") - F.col("at")).where("n > 0")
    return met.select(*[F.col(f"_a.{c}").alias(f"a_{c}") for c in a.columns], *[F.col(f"_b.{c}").alias(f"b_{c}") for c in b.columns], "n")


def differences(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ, or that only one side has."""
    a, b = expected.select(key, F.col(value).alias("expected")), actual.select(key, F.col(value).alias("actual"))
    return a.join(b, key, "full_outer").where(~F.col("expected").eqNullSafe(F.col("actual")))


def encode_distinct(df: DataFrame, value: str, out: str) -> tuple[DataFrame, DataFrame]:
    """A dictionary (value, id) of distinct values and df with ids in place of them, to do costly work once a value."""
    from corpusmill.operators.windows import global_row_number

    words = global_row_number(df.select(value).where(F.col(value).isNotNull()).distinct(), [value], out)
    return words, df.join(words, value, "left").drop(value)


def with_defaults(items: DataFrame, batch: DataFrame, fields: list[str]) -> DataFrame:
    """items whose null fields are those of their batch, a table of one row."""
    shared = batch.select(*[F.col(f).alias(f"_d_{f}") for f in fields])
    kept = [F.coalesce(F.col(f), F.col(f"_d_{f}")).alias(f) if f in fields else F.col(f) for f in items.columns]
    return items.crossJoin(F.broadcast(shared)).select(*kept)


def embedded(base: DataFrame, parts: DataFrame, key: str, value: str, vector: Column, size: int) -> DataFrame:
    """base with n_chunks and vector, the mean of its parts' vectors, zero for a row without parts.

    vector (on value's column) is worked out once for each distinct value, which 128 bits of hash tell apart.
    """
    marked = parts.select(key, F.md5(F.col(value).cast("binary")).alias("_h"), value)
    known = marked.groupBy("_h").agg(F.first(value).alias(value)).select("_h", vector.alias("_v"))
    sums = [F.sum(F.col("_v")[k]).alias(f"_s{k}") for k in range(size)]
    totals = marked.select(key, "_h").join(known, "_h").groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"), *sums)
    mean = F.array(*[F.coalesce(F.col(f"_s{k}") / F.col("n_chunks"), F.lit(0.0)) for k in range(size)])
    return base.join(totals, key, "left").withColumn("vector", mean).withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0))).drop(*[f"_s{k}" for k in range(size)])
