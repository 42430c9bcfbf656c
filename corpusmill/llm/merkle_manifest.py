"""A Merkle manifest of a table: a tree of digests for each group of rows, a tree over the groups' roots, and a proof for each row.

A leaf is the digest of a row's columns. Leaves of a group ascend by id; while more than one node remains, every ARITY
consecutive ones (the last run may be shorter) become the digest of their digests. What remains is the group's subroot; subroots,
ordered by group, make the root in the same way.

Leaves (ids, groups and digests, no texts) are written once and dealt into ranges of group, id and digest. How many rows of its
first and last group each range holds is gathered (a row for each range), which tells every range where in its groups it begins.
A range builds all subtrees that are complete in it. What is left over at its edges, a few nodes for each level, is shuffled by
the coordinate of the block of nodes that it belongs to; each round of blocks makes one node out of about SPREAD ranges, until the
subroots and then the root are there. The way back hands each block's path to the root down to its nodes and at last to the
range that a node came from, which ends its rows' proofs with it. A group may hold any share of the rows, and there may be any
number of groups: no task holds more than one range of leaves or the edges of about SPREAD ranges.

Null columns are digested as `-`; a null group is a group of its own and comes first, as does a null id. Rows with equal ids of
one group are ordered by their leaves; equal rows are neighbours, each with a leaf of its own, and are spread over ranges by the
input partition they come from. Texts of any length are digested whole. Other columns of docs, of any name, are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.rdd import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm._scratch import cut

ARITY = 3
#: Ranges, about, whose edges meet in one block of a round.
SPREAD = 27
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = T.ArrayType(T.StructType().add("place", T.IntegerType()).add("siblings", T.StringType()))
#: The tree over the groups' roots; the others are numbered by group.
GROUPS = -1


# Columns ------------------------------------------------------------------------------------------------------------------


def leaf_digest(*columns: Column) -> Column:
    """sha256 of the columns' values, each as its number of UTF-8 bytes, a colon and itself, or `-` where it is null."""
    fields = []
    for c in columns:
        value = c.cast("string")
        fields.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that leaf and proof lead to."""
    step = lambda at, x: F.sha2(F.concat(F.substring(x["siblings"], F.lit(1), x["place"] * 64), at, F.substring(x["siblings"], x["place"] * 64 + 1, F.lit(64 * ARITY))).cast("binary"), 256)
    return F.aggregate(proof, leaf, step)


def proof_digest(proof: Column) -> Column:
    """sha256 of all siblings, level by level."""
    return F.sha2(F.array_join(F.transform(proof, lambda x: x["siblings"]), "").cast("binary"), 256)


# Trees --------------------------------------------------------------------------------------------------------------------


def _digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def climb(low: int, nodes: list[str], n: int) -> list[tuple[int, list[str], int]]:
    """For each level from the leaves up: the first of the nodes that nodes make complete, those nodes, and how many the tree has
    there. nodes are the tree's leaves from low on, n the number of all of them."""
    out = [(low, nodes, n)]
    while n > 1 and nodes:
        high, up = low + len(nodes), -(-n // ARITY)
        first, stop = -(-low // ARITY), up if high == n else high // ARITY
        nodes = [_digest(nodes[ARITY * j - low : ARITY * (j + 1) - low]) for j in range(first, stop)]
        low, n = first, up
        out.append((low, nodes, n))
    return out


def _step(low: int, nodes: list[str], n: int, i: int) -> tuple[int, str]:
    """Place of node i in its run, and the other nodes of the run."""
    a, b = i - i % ARITY, min(i - i % ARITY + ARITY, n)
    return i - a, "".join(nodes[a - low : i - low] + nodes[i + 1 - low : b - low])


def _held(levels: list, level: int, i: int) -> bool:
    """Whether the parent of node i of a level is complete here too."""
    if level + 1 >= len(levels):
        return False
    low, nodes, _ = levels[level + 1]
    return low <= i // ARITY < low + len(nodes)


def edges(levels: list) -> Iterator[tuple[int, int, int, str]]:
    """(level, index, nodes of the tree on this level, digest) of the complete nodes whose parents are not, the tree's top included."""
    for level, (low, nodes, n) in enumerate(levels):
        inner_low, inner, _ = levels[level + 1] if level + 1 < len(levels) else (0, [], 0)
        a, b = (ARITY * inner_low, ARITY * (inner_low + len(inner))) if inner else (low + len(nodes), low + len(nodes))
        for i in [*range(low, min(a, low + len(nodes))), *range(max(b, low), low + len(nodes))]:
            yield level, i, n, nodes[i - low]


def path(levels: list, level: int, i: int) -> tuple[list[tuple[int, str]], tuple[int, int]]:
    """Steps from a node up to the last complete node above it, and that node's level and index."""
    steps = []
    while _held(levels, level, i):
        steps.append(_step(*levels[level], i))
        level, i = level + 1, i // ARITY
    return steps, (level, i)


class Range:
    """The trees of one range of leaves. groups: (key, leaves) of each group in it; at: what gathered says of the range."""

    def __init__(self, runs: list[tuple[object, list[str]]], at: tuple[int, int, int, int], n_groups: int):
        first, offset, first_total, last_total = at
        self.first, self.trees, whole = first, {}, []
        for k, (_, leaves) in enumerate(runs):
            total = first_total if k == 0 else last_total if k == len(runs) - 1 else len(leaves)
            levels = climb(offset if k == 0 else 0, leaves, total)
            self.trees[first + k] = levels
            if levels[-1][2] == 1 and levels[-1][1]:
                whole.append(first + k)
        self.trees[GROUPS] = climb(whole[0] if whole else 0, [self.trees[g][-1][1][0] for g in whole], n_groups)
        self.whole = set(whole)

    def edges(self) -> Iterator[tuple[int, int, int, int, str]]:
        for tree, levels in self.trees.items():
            if tree not in self.whole:
                for level, i, n, digest in edges(levels):
                    yield tree, level, i, n, digest

    def proof(self, tree: int, i: int, above: dict) -> tuple[list, str, str]:
        """Steps from a leaf to the root, its subroot and the root."""
        steps, at = path(self.trees[tree], 0, i)
        if tree in self.whole:
            subroot = self.trees[tree][-1][1][0]
            more, at = path(self.trees[GROUPS], 0, tree)
            rest, _, root = above[GROUPS, *at]
            return [*steps, *more, *rest], subroot, root
        rest, subroot, root = above[tree, *at]
        return [*steps, *rest], subroot, root


def block(nodes: list[tuple[int, int, int, int, str, tuple]], until: int) -> tuple[tuple, list]:
    """Builds a block of nodes (tree, level, index, nodes on the level, digest, origin) up to one node, on level until or the tree's
    top. Returns that node and, for each given node, its origin, coordinate and steps to it."""
    tree = nodes[0][0]
    levels: dict[int, dict[int, str]] = defaultdict(dict)
    width = {}
    for _, level, i, n, digest, _ in nodes:
        levels[level][i] = digest
        width[level] = n
    level = min(levels)
    n = width[level]
    while level < until and n > 1:
        runs = defaultdict(list)
        for i in sorted(levels[level]):
            runs[i // ARITY].append(levels[level][i])
        for j, run in runs.items():
            levels[level + 1][j] = _digest(run)
        level, n = level + 1, -(-n // ARITY)
    (top,) = levels[level]
    downs = []
    for _, at, i, _, _, origin in nodes:
        steps, k = [], i
        for x in range(at, level):
            a = k - k % ARITY
            steps.append((k - a, "".join(levels[x][j] for j in range(a, a + ARITY) if j != k and j in levels[x])))
            k //= ARITY
        downs.append((origin, (tree, at, i), steps))
    return (tree, level, top, n, levels[level][top]), downs


# Rounds -------------------------------------------------------------------------------------------------------------------


def _place(key: tuple) -> int:
    return zlib.crc32(repr(key).encode())


def _schedule(rows_in_range: int, total: int) -> list[int]:
    """Levels at which rounds stop: the first gathers about SPREAD ranges in a block, each later one about SPREAD blocks."""
    up = lambda n: next(k for k in range(200) if ARITY**k >= n)
    first, top = max(1, up(SPREAD * max(rows_in_range, 1))), up(max(total, 1))
    return [*range(first, top, up(SPREAD)), top] if top > first else [top]


def _round(nodes: RDD, k: int, until: int, parts: int) -> RDD:
    """(round, block) -> (node made, nodes it is made of) of the nodes up to a level."""
    keyed = nodes.map(lambda x: ((k, x[0], x[2] // ARITY ** (until - x[1])), x))

    def build(pairs):
        blocks = defaultdict(list)
        for key, x in pairs:
            blocks[key].append(x)
        for key, own in blocks.items():
            yield key, block(own, until)

    return keyed.partitionBy(parts, _place).mapPartitions(build, preservesPartitioning=True)


def _upper(ragged: RDD, rows_in_range: int, largest: int, n_groups: int, parts: int) -> RDD:
    """(origin, coordinate, steps to the root, subroot (null for nodes of the groups' tree), root) for each ragged node."""
    rounds = []
    open_, waiting = ragged.filter(lambda x: x[0] != GROUPS), ragged.filter(lambda x: x[0] == GROUPS)
    for phase, total in (("group", largest), ("groups", n_groups)):
        if phase == "groups":
            open_ = waiting
        for until in _schedule(rows_in_range, total) if total else []:
            k = len(rounds)
            blocks = _round(open_.filter(lambda x, u=until: x[1] <= u), k, until, parts)
            rounds.append(blocks)
            made = blocks.map(lambda kv: (*kv[1][0], kv[0]))
            if phase == "group":
                done = made.filter(lambda x: x[3] == 1).map(lambda x: (GROUPS, 0, x[0], n_groups, x[4], x[5]))
                waiting = waiting.union(done)
                made = made.filter(lambda x: x[3] > 1)
            open_ = open_.filter(lambda x, u=until: x[1] > u).union(made)
    # The last round has made the root. Paths now go down: to the blocks of each earlier round, and to the ranges.
    above = open_.map(lambda x: (x[5], ([], None, x[4])))
    to_ranges = None
    for k in range(len(rounds) - 1, -1, -1):
        here = above.filter(lambda kv, k=k: kv[0][0] == k)

        def hand_down(pairs):
            blocks, ups = {}, {}
            for key, (kind, value) in pairs:
                (blocks if kind == "block" else ups)[key] = value
            for key, (top, downs) in blocks.items():
                rest, subroot, root = ups[key]
                subroot = top[4] if top[0] != GROUPS and top[3] == 1 else subroot
                for origin, at, steps in downs:
                    yield origin, at, ([*steps, *rest], subroot, root)

        pairs = rounds[k].mapValues(lambda v: ("block", v)).union(here.mapValues(lambda v: ("up", v)))
        down = pairs.partitionBy(parts, _place).mapPartitions(hand_down)
        found = down.filter(lambda x: x[0][0] == "range")
        to_ranges = found if to_ranges is None else to_ranges.union(found)
        above = above.filter(lambda kv, k=k: kv[0][0] != k).union(down.filter(lambda x: x[0][0] != "range").map(lambda x: (x[0], x[2])))
    return to_ranges


# The operator -------------------------------------------------------------------------------------------------------------


def _pack(batches):
    """Record batches as bytes, one row for each."""
    for batch in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["packed"])


def _columns(packed: list[bytes]) -> list[list]:
    """The columns of a range's rows."""
    tables = [pa.ipc.open_stream(x).read_all() for x in packed]
    return [c.to_pylist() for c in pa.concat_tables(tables).columns] if tables else []


def _runs(groups: list, leaves: list) -> list[tuple[object, list[str]]]:
    edges_ = [k for k in range(len(groups)) if k == 0 or groups[k] != groups[k - 1] or (groups[k] is None) != (groups[k - 1] is None)] + [len(groups)]
    return [(groups[a], leaves[a:b]) for a, b in zip(edges_[:-1], edges_[1:], strict=True)]


def _ranges(counts: list[tuple]) -> tuple[dict[int, tuple[int, int, int, int]], int, int]:
    """From (range, groups in it, first group, its rows, last group, its rows), one for each range that has rows: for each range
    the number of its first group, how many of that group's rows come earlier, and the rows of its first and of its last group; the
    rows of the largest group that spans ranges; the number of groups."""
    at, totals, group, before, last_key = {}, {}, -1, 0, object()
    for part, n, key, rows, end_key, end_rows in sorted(counts, key=lambda x: x[0]):
        goes_on = group >= 0 and key == last_key and (key is None) == (last_key is None)
        if not goes_on:
            group, before = group + 1, 0
        at[part] = (group, before, group + n - 1)
        totals[group] = before + rows
        if n > 1:
            group += n - 1
            totals[group] = end_rows
        before, last_key = totals[group], end_key
    spans = [totals[first] for first, earlier, _ in at.values() if earlier]
    return {p: (first, earlier, totals[first], totals[last]) for p, (first, earlier, last) in at.items()}, max(spans, default=0), group + 1


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "source", carry: dict[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """One row per input row: id, group, leaf, subroot, root and proof, an array from the leaf's level to the root's of the row's
    place in its run and the run's other digests joined. carry: further small columns to compute beside the leaves and return.
    ranges: as many as shuffle partitions by default; a range's leaves are held in memory."""
    spark, carry = docs.sparkSession, carry or {}
    rows = docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), leaf_digest(*[F.col(c) for c in columns]).alias("leaf"), F.spark_partition_id().alias("salt"), *[c.alias(f"carry_{k}") for k, c in enumerate(carry.values())])
    leaves = cut(rows, "leaves")
    order = [F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("salt")]
    ranged = leaves.repartitionByRange(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    # One RDD that all that follows reads: its shuffle is done once, and its ranges stay as they are.
    packed = ranged.mapInArrow(_pack, "packed binary").rdd.map(lambda r: bytes(r[0]))
    parts = packed.getNumPartitions()

    def counted(part, it):
        first, last, n, rows = None, None, 0, 0
        for x in it:
            groups = pa.ipc.open_stream(x).read_all().column(1).to_pylist()
            for key, own in _runs(groups, groups):
                rows += len(own)
                if last is not None and last[0] == key and (last[0] is None) == (key is None):
                    last[1] += len(own)
                else:
                    last, n = [key, len(own)], n + 1
                    first = first or last
        if n:
            yield part, n, first[0], first[1], last[0], last[1], rows

    gathered = packed.mapPartitionsWithIndex(counted).collect()  # a row for each range
    at, largest, n_groups = _ranges([x[:6] for x in gathered])
    kinds = [leaves.schema["id"].dataType, leaves.schema["group"].dataType]
    schema = T.StructType().add(id_col, kinds[0]).add(group_col, kinds[1]).add("leaf", T.StringType())
    for k, name in enumerate(carry):
        schema.add(name, leaves.schema[f"carry_{k}"].dataType)
    schema.add("subroot", T.StringType()).add("root", T.StringType()).add("proof", PROOF)
    if not gathered:
        return spark.createDataFrame([], schema)
    known = spark.sparkContext.broadcast(at)

    def ragged(part, it):
        columns_ = _columns(list(it))
        if columns_:
            for node in Range(_runs(columns_[1], columns_[2]), known.value[part], n_groups).edges():
                yield *node, ("range", part)

    upper = _upper(packed.mapPartitionsWithIndex(ragged), max(x[6] for x in gathered), largest, n_groups, parts)
    handed = upper.map(lambda x: (x[0][1], (x[1], x[2]))).partitionBy(parts, lambda part: part).mapPartitionsWithIndex(lambda part, it: [(part, dict(v for _, v in it))])

    # Both sides of zip need as many partitions; partitionBy may have made more of them than there are ranges.
    more = handed.getNumPartitions() - parts
    padded = packed.union(spark.sparkContext.parallelize([], more)) if more else packed

    def finish(pair):
        batches, (part, above) = pair
        columns_ = _columns(batches)
        if not columns_:
            return
        runs = _runs(columns_[1], columns_[2])
        trees, row = Range(runs, known.value[part], n_groups), 0
        for k, (_, own) in enumerate(runs):
            offset = known.value[part][1] if k == 0 else 0
            for j in range(len(own)):
                steps, subroot, root = trees.proof(trees.first + k, offset + j, above)
                yield (columns_[0][row], columns_[1][row], columns_[2][row], *[c[row] for c in columns_[4:]], subroot, root, steps)
                row += 1

    return spark.createDataFrame(padded.glom().zip(handed).flatMap(finish), schema, verifySchema=False)
