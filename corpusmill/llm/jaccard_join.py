"""n-gram Jaccard join with Bayesian candidate pruning (after BayesLSH), as near-duplicate classes with link counts.

1. Each text becomes its set of word n-grams (words as in _words; a text of fewer words is one n-gram), each known by 128 bits
   of hash, and a MinHash signature. Texts with equal sets are copies: one of them stands for all, with their number.
2. Signatures are cut into bands; texts that agree in a band meet in a bucket. With 32 bands of 4, a pair at the threshold
   of 0.8 misses every bucket with a probability of 5e-8, a closer pair with less. Buckets with the same members count once
   (told by their number and two sums of 64-bit hashes of their members).
3. Pairs of a bucket compare their MinHash values 16 at a time and are dropped as soon as the posterior probability (uniform
   prior) that their similarity reaches the threshold is below TOLERANCE. Survivors are joined into candidate clusters.
   A large bucket is dealt into blocks and each pair of blocks is a unit of work of its own.
4. The n-gram sets of a cluster's texts are read again and all pairs of the cluster are verified by counting common n-grams.
   A large cluster is dealt into blocks: one block of each pair of blocks is held, the other one streams past it in tiles.
   Each text is sent once for each block; there are SPREAD blocks at most until the held one would pass SET_BLOCK n-grams or
   TEXT_BLOCK texts. Links are counted there; what leaves a task is one row per text: its number of links and one link towards
   the rest of its class, so no list of pairs exists anywhere.
5. Classes are the connected components of the verified links.

The number of links of a class of m different texts is exact, so it takes m * m / 2 comparisons; copies take none.

Null texts and texts without a word have nothing to compare: each is a class of its own with no links. Texts are read whole,
whatever their length. Rows are told apart by id; rows that repeat an id and text are copies of each other. Only id_col and
text_col are read, so other columns of any name are harmless; keep_one returns them as they are. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm._scratch import cut, drop, fresh
from corpusmill.llm._words import each_words
from corpusmill.llm.components import connected_components

NGRAM = 5
THRESHOLD = 0.8
BANDS = 32
BAND_ROWS = 4
STEP = 16
TOLERANCE = 1e-9
#: Blocks into which a large bucket or cluster is dealt for the sake of parallel work.
SPREAD = 32
#: Texts of a bucket, and n-grams (16 bytes each) and texts of a cluster, that a task holds at most.
BUCKET_BLOCK = 16_384
SET_BLOCK = 2_000_000
TEXT_BLOCK = 8192
#: Texts and n-grams that are compared with as many others at once.
TILE_TEXTS = 1500
TILE_GRAMS = 400_000
#: Ids of removed rows, with 16 bytes each besides, that keep_one broadcasts at most.
MAX_BROADCAST_BYTES = 64 << 20

_HASHES = BANDS * BAND_ROWS
_rng = np.random.default_rng(20240607)
_FACTOR = _rng.integers(0, 1 << 63, _HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 1 << 63, _HASHES, dtype=np.uint64)


def signature(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """MinHash values (rows x hashes, 32 bits) of the n-gram hashes between each two edges; no row may be empty."""
    out = np.empty((len(edges) - 1, _HASHES), np.uint32)
    work = np.empty_like(hashes)
    for k in range(_HASHES):
        np.bitwise_xor(hashes, _FLIP[k], out=work)
        np.multiply(work, _FACTOR[k], out=work)
        out[:, k] = np.minimum.reduceat(work, edges[:-1]) >> np.uint64(32)
    return out


def distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of two lists of hashes, sorted."""
    order = np.argsort(one, kind="stable")
    a, b = one[order], two[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep], b[keep]


def ngram_sets(column: pa.Array, n: int) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray] | None]]]:
    """Sorted distinct n-grams (two hashes each) of each text, None where it has no word, in runs of rows with the first row's
    number."""
    for row, words in each_words(column, wide=True):
        at, hashes = words.windows(n)
        _, second = words.windows(n, second=True)
        cuts = np.searchsorted(at, words.first)
        sets: list[tuple[np.ndarray, np.ndarray] | None] = []
        for r, count in enumerate(np.diff(words.first)):
            if count >= n:
                sets.append(distinct(hashes[cuts[r] : cuts[r + 1]], second[cuts[r] : cuts[r + 1]]))
            else:
                sets.append((np.array([words.whole(r)], np.uint64), np.array([words.whole(r, True)], np.uint64)) if count else None)
        yield row, sets


def set_key(values: tuple[np.ndarray, np.ndarray]) -> bytes:
    return hashlib.md5(values[0].tobytes() + values[1].tobytes(), usedforsecurity=False).digest()


def _signed(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    def kernel(batches):
        for batch in batches:
            keys, sizes, signs = [], [], []
            for _, sets in ngram_sets(batch.column(1), n):
                full = [s for s in sets if s is not None]
                rows = iter(signature(np.concatenate([s[0] for s in full]), np.concatenate([[0], np.cumsum([len(s[0]) for s in full])])) if full else ())
                for s in sets:
                    keys.append(None if s is None else set_key(s))
                    sizes.append(0 if s is None else len(s[0]))
                    signs.append(None if s is None else next(rows).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signs, pa.binary())], ["id", "key", "n", "sign"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(kernel, f"id {kind}, key binary, n int, sign binary")


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each multiple of STEP compared hashes, the fewest matches at which a pair is kept.

    With a uniform prior, P(similarity >= t | m of n match) = P(X <= m) for X binomial (n + 1, t).
    """
    out = []
    for n in range(STEP, _HASHES + 1, STEP):
        total, m = 0.0, 0
        while (total := total + math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < tolerance:
            m += 1
        out.append(m)
    return out


def survivors(left: np.ndarray, right: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs of the two lists of signatures outlive the incremental comparison, as a table of booleans."""
    i, j = (x.ravel() for x in np.indices((len(left), len(right))))
    matches = np.zeros(len(i), np.int16)
    for k, most in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        matches += (left[i, part] == right[j, part]).sum(1, dtype=np.int16)
        alive = matches >= most
        i, j, matches = i[alive], j[alive], matches[alive]
        if not len(i):
            break
    out = np.zeros((len(left), len(right)), bool)
    out[i, j] = True
    return out


def sweep(n: int, linked, width: int = 256) -> np.ndarray:
    """Component of each of n items; linked(a, b) tells which pairs of two lists of items are linked.

    Items reached so far are compared with those not reached yet, so a dense group costs a pass, not all its pairs.
    """
    root = np.full(n, -1)
    for first in range(n):
        if root[first] >= 0:
            continue
        root[first], front = first, np.array([first])
        while len(front):
            reached = []
            for k in range(0, len(front), width):
                open_ = np.flatnonzero(root < 0)
                if not len(open_):
                    break
                new = open_[np.concatenate([linked(front[k : k + width], open_[z : z + 1024]).any(0) for z in range(0, len(open_), 1024)])]
                root[new] = first
                reached.append(new)
            front = np.concatenate(reached) if reached else np.zeros(0, int)
    return root


def runs(batches, width: int) -> Iterator[tuple[tuple, list[list]]]:
    """Rows of sorted batches by their first width columns: the key and, per other column, the values."""
    key, rows = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[:width] != key:
                if rows:
                    yield key, list(zip(*rows, strict=True))
                key, rows = row[:width], []
            rows.append(row[width:])
    if rows:
        yield key, list(zip(*rows, strict=True))


def _blocks(held: Column, work: Column) -> Column:
    """Number of blocks: held by what a task can hold, and for the sake of parallel work SPREAD at most."""
    return F.greatest(F.lit(1), F.ceil(held), F.least(F.lit(SPREAD), F.ceil(work))).cast("int")


def _block_pairs(df: DataFrame, blocks, key) -> DataFrame:
    """Deals rows with a column of the number of blocks into all pairs lo <= hi of blocks that hold them; side: 0 lo, 1 hi."""
    df = df.withColumn("_own", F.pmod(F.xxhash64(key), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    return df.withColumn("lo", F.least("_own", "_other")).withColumn("hi", F.greatest("_own", "_other")).withColumn("side", (F.col("_own") > F.col("_other")).cast("int")).drop("_own", "_other")


def _candidate_edges(reps: DataFrame) -> DataFrame:
    width = BAND_ROWS * 4
    bands = F.array(*[F.xxhash64(F.substring("sign", 1 + k * width, width), F.lit(k)) for k in range(BANDS)])
    placed = reps.select("key", F.explode(bands).alias("bucket"))
    held = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), *[F.sum(F.xxhash64(F.lit(salt), "key").cast("decimal(20,0)")).alias(f"print{salt}") for salt in (1, 2)])
    held = held.where("members > 1").groupBy("members", "print1", "print2").agg(F.min("bucket").alias("bucket"))
    members = placed.join(held.select("bucket", "members"), "bucket").join(reps.select("key", "sign"), "key")
    blocks = _blocks(F.col("members") / BUCKET_BLOCK, F.col("members") / 4096)
    dealt = _block_pairs(members, blocks, "key").select("bucket", "lo", "hi", "side", "key", "sign")
    least = least_matches()

    def kernel(batches):
        for _, (_, keys, signs) in runs(batches, 3):
            if len(keys) < 2:
                continue
            signs = np.frombuffer(b"".join(signs), np.uint32).reshape(len(keys), _HASHES)
            root = sweep(len(keys), lambda a, b, s=signs: survivors(s[a], s[b], least))
            pairs = [(keys[i], keys[int(root[i])]) for i in range(len(keys)) if root[i] != i]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*pairs, strict=True)], ["a", "b"])

    ordered = dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return ordered.mapInArrow(kernel, "a binary, b binary")


def common_counts(sets: list[tuple[np.ndarray, np.ndarray]], split: int) -> np.ndarray:
    """Number of common n-grams of the first `split` sets with each of the others. N-grams that one set alone has are left out,
    and those that all have are counted once for all."""
    one, two = np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets])
    owner = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
    order = np.argsort(one, kind="stable")
    if ((one[order][1:] == one[order][:-1]) & (two[order][1:] != two[order][:-1])).any():
        order = np.lexsort((two, one))
    one, two, owner = one[order], two[order], owner[order]
    fresh_ = np.ones(len(one), bool)
    fresh_[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    value = np.cumsum(fresh_) - 1
    times = np.bincount(value)
    out = np.full((split, len(sets) - split), np.float32((times == len(sets)).sum()))
    use = (times > 1) & (times < len(sets))
    number = np.cumsum(use) - 1
    taken = use[value]
    value, owner = number[value[taken]], owner[taken]
    for first in range(0, int(use.sum()), 2048):
        a, b = np.searchsorted(value, [first, first + 2048])
        table = np.zeros((len(sets), 2048), np.float32)
        table[owner[a:b], value[a:b] - first] = 1
        out += table[:split] @ table[split:].T
    return out


def tiles(sizes: list[int]) -> Iterator[slice]:
    """Ranges of up to TILE_TEXTS sets and TILE_GRAMS n-grams, one set at least."""
    first, total = 0, 0
    for k, size in enumerate(sizes):
        if k > first and (k - first >= TILE_TEXTS or total + size > TILE_GRAMS):
            yield slice(first, k)
            first, total = k, 0
        total += size
    if first < len(sizes):
        yield slice(first, len(sizes))


def united(labels: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of rows (each the number of some row) made equal where rows share a column of a table of booleans, and each
    column's label, or the number of rows if it has no row."""
    none, parts = len(labels), [slice(k, k + 512) for k in range(0, len(labels), 512)]
    while True:
        column = np.full(table.shape[1], none)
        for p in parts:
            np.minimum(column, np.where(table[p], labels[p, None], none).min(0, initial=none), out=column)
        best = np.concatenate([np.minimum(labels[p], np.where(table[p], column[None, :], none).min(1, initial=none)) for p in parts])
        if np.array_equal(best, labels):
            return labels, column
        parent = np.arange(none)
        np.minimum.at(parent, labels, best)
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]
        labels = parent[labels]


class Held:
    """The block of texts that a task holds: links with the tiles that stream past it are counted for both sides."""

    def __init__(self, keys: list[bytes], copies: list[int], sets: list, threshold: float):
        self.keys, self.copies, self.sets, self.threshold = keys, np.array(copies, np.int64), sets, threshold
        self.size = np.array([len(s[0]) for s in sets], np.float64)
        self.labels = np.arange(len(keys))
        self.texts, self.rows = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)

    def links(self, sets: list) -> np.ndarray:
        """Which of the held texts reach the threshold with which of the others."""
        other = np.array([len(s[0]) for s in sets], np.float64)
        parts = [common_counts(self.sets[p] + sets, p.stop - p.start) for p in tiles([len(s[0]) for s in self.sets])]
        common = np.concatenate(parts)
        return common >= self.threshold * (self.size[:, None] + other[None, :] - common)

    def among(self) -> None:
        """Compares the held texts with each other."""
        for p in tiles([len(s[0]) for s in self.sets]):
            table, own = self.links(self.sets[p]), np.arange(p.start, p.stop)
            table[own, own - p.start] = True  # for the labels: what is linked to a text shares its column with it
            self.labels, _ = united(self.labels, table)
            self.texts[p] += table.sum(0) - 1
            self.rows[p] += self.copies @ table - self.copies[p]

    def against(self, keys: list[bytes], copies: list[int], sets: list) -> tuple:
        """Compares a tile of other texts with the held ones: keys, a linked key (or the same) and links of the tile's texts."""
        table = self.links(sets)
        self.labels, column = united(self.labels, table)
        self.texts += table.sum(1)
        self.rows += table @ np.array(copies, np.int64)
        return keys, [self.keys[c] if c < len(self.keys) else k for k, c in zip(keys, column, strict=True)], table.sum(0), self.copies @ table

    def result(self) -> tuple:
        return self.keys, [self.keys[x] for x in self.labels], self.texts, self.rows


def _verified(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, n: int, threshold: float) -> DataFrame:
    """members (key, cluster, holder, copies, blocks) verified: key, root, texts and rows linked, one row per text and block."""
    wanted = members.select(F.col("holder").alias("_holder")).distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(wanted, F.col("_id").eqNullSafe(F.col("_holder")), "left_semi")

    def read(batches):
        for batch in batches:
            for _, found in ngram_sets(batch.column(0), n):
                keep = [s for s in found if s is not None]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in keep], pa.binary()), pa.array([s[0].tobytes() + s[1].tobytes() for s in keep], pa.binary())], ["key", "grams"])

    sets = texts.select("_text").mapInArrow(read, "key binary, grams binary").dropDuplicates(["key"])
    full = sets.join(members.select("key", "cluster", "copies", "blocks"), "key")
    dealt = _block_pairs(full, F.col("blocks"), "key").select("cluster", "lo", "hi", "side", "key", "copies", "grams")

    def kernel(batches):
        def told(rows: tuple) -> pa.RecordBatch:
            keys, roots, linked, counts = rows
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(roots, pa.binary()), pa.array(linked, pa.int64()), pa.array(counts, pa.int64())], ["key", "root", "texts", "rows"])

        unit, held, keys, copies, sets_, grams = None, None, [], [], [], 0

        def settle(last: bool):
            """Makes the rows gathered so far the held block, or compares them with it."""
            nonlocal held, keys, copies, sets_, grams
            if held is None:
                held = Held(keys, copies, sets_, threshold)
                if unit[1] == unit[2]:
                    held.among()
            elif keys:
                yield told(held.against(keys, copies, sets_))
            keys, copies, sets_, grams = [], [], [], 0
            if last:
                yield told(held.result())
                held = None

        for batch in batches:
            for cluster, lo, hi, side, key, times, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                here = (cluster, lo, hi)
                if unit is not None and here != unit:
                    yield from settle(True)
                unit = here
                full_tile = held is not None and (len(keys) >= TILE_TEXTS or grams >= TILE_GRAMS)
                if keys and (full_tile or held is None and side == 1):
                    yield from settle(False)
                if held is None and side == 1:
                    held = Held([], [], [], threshold)
                both = np.frombuffer(raw, np.uint64)
                sets_.append((both[: len(both) // 2], both[len(both) // 2 :]))
                keys.append(key)
                copies.append(times)
                grams += len(both) // 2
        if unit is not None:
            yield from settle(True)

    return dealt.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "side").mapInArrow(kernel, "key binary, root binary, texts long, rows long")


def near_duplicates(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, class_id (least id of its class), n_links (other rows at or above the threshold, copies
    included), n_text_links (different texts among them), class_size (rows of the class), n_grams."""
    if threshold < THRESHOLD:
        raise ValueError(f"bands are laid out for a threshold of {THRESHOLD} or more")
    rows = cut(_signed(docs, id_col, text_col, n), "signatures")
    found = rows.where("key is not null")
    reps = cut(found.groupBy("key").agg(F.min("id").alias("holder"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sign").alias("sign")), "texts")
    clusters = cut(connected_components(_candidate_edges(reps)).select(F.col("vertex").alias("key"), F.col("component").alias("cluster")), "clusters")
    joined = clusters.join(reps.select("key", "holder", "copies", "n"), "key")
    sizes = joined.groupBy("cluster").agg(F.sum("n").alias("grams"), F.count(F.lit(1)).alias("m"))
    held = F.greatest(F.col("grams") / SET_BLOCK, F.col("m") / TEXT_BLOCK)
    blocks = _blocks(held, F.greatest(F.col("grams") / TILE_GRAMS, F.col("m") / TILE_TEXTS))
    members = cut(joined.join(sizes.select("cluster", blocks.alias("blocks")), "cluster"), "members")
    drop(clusters)
    checked = cut(_verified(docs, members, id_col, text_col, n, threshold), "links")
    links = checked.groupBy("key").agg(F.sum("texts").alias("texts"), F.sum("rows").alias("linked"))
    classes = connected_components(checked.select(F.col("key").alias("a"), F.col("root").alias("b")))
    known = (
        reps.select("key", "holder", "copies").join(links, "key", "left")
        .join(classes.select(F.col("vertex").alias("key"), "component"), "key", "left")
        .withColumn("component", F.coalesce("component", "key"))
    )
    known = cut(known, "known")
    drop(reps, members, checked)
    least = known.groupBy("component").agg(F.min("holder").alias("class_id"), F.sum("copies").alias("class_size"))
    named = known.join(least, "component").select(
        "key", "class_id", "class_size", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links")
    )
    columns = [F.col("id").alias(id_col), "class_id", "n_links", "n_text_links", "class_size", F.col("n").cast("long").alias("n_grams")]
    alone = rows.where("key is null").select("id", "n", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_text_links"), F.lit(1).cast("long").alias("class_size"))
    return found.select("id", "key", "n").join(named, "key").select(*columns).union(alone.select(*columns))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each class: the one with the least id. Rows that repeat an id keep one of them.

    The ids that go are fewer than those that stay. Up to MAX_BROADCAST_BYTES of them are broadcast, so that texts stay where
    they are; beyond that, docs and ids meet in a shuffle.
    """
    id_col = how.get("id_col", "doc_id")
    classes = near_duplicates(docs, **how).select(F.col(id_col).alias("_id"), "class_id")
    stays = F.col("_id").eqNullSafe(F.col("class_id"))
    verdict = cut(classes.groupBy("_id").agg(F.count(F.when(stays, 1)).alias("_times")), "verdict")
    key = fresh(docs.columns, "_id")
    gone = verdict.where("_times = 0").select(F.col("_id").alias(key))
    state = verdict.agg(
        F.sum(F.when(F.col("_times") == 0, F.lit(16) + F.coalesce(F.octet_length(F.col("_id").cast("string")), F.lit(0)))).alias("bytes"),
        F.count(F.when((F.col("_times") > 1) & F.col("_id").isNotNull(), 1)).alias("repeated"),
    ).first()
    small = (state["bytes"] or 0) <= MAX_BROADCAST_BYTES
    out = docs.join(F.broadcast(gone) if small else gone, F.col(id_col).eqNullSafe(F.col(key)), "left_anti")
    if not state["repeated"]:
        return out
    single = out.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
    return single.union(out.where(F.col(id_col).isNull()))
