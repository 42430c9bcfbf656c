"""Chat formatting by quotation linking: quotes are traced to the messages they repeat and taken out.

1. Each message is parsed by lines: leading `>` marks give a line's quote level. Runs of lines of one level, ended by a blank
   line or another level, are passages; level 0 is the message's own text. A line such as "On ... wrote:" before a quote goes
   with it. Passages are normalised (white space, case and marks other than letters and digits dropped) and hashed.
2. A quoted passage is joined to the latest earlier message of the same conversation that has it as a passage of its own, or
   as its whole own text. The join looks back along (conversation, hash) in order of turns, in bounded turn ranges whose last
   message is handed on to the next, so that no pair of messages is built and a hash of any frequency is spread over tasks.
3. A message replies to the message found for its lowest quote level (the latest, if it quotes several there); without one,
   to the turn before it. A message that replies to another than the turn before opens a branch.
4. Conversations are numbered in turn order (position) and in reply order (reply_position), both gapless from 0. Reply order
   walks the tree of replies: a message is followed by its replies, each with all that follows from it, before the next reply
   of the same message; the turn right after it comes first. Since branches are runs of turns, their tree is walked instead: the
   places of branches are found by ranking the list of a walk around it with doubling pointers, spread over tasks whatever a
   conversation's size. branch is the turn that opened the branch.

A null or empty text has no passages and stays in place as "". Texts of any length are parsed whole. A null conversation id is a
conversation of its own; null turns sort first and are never quoted. Messages that repeat a conversation and turn each get a
row, in order of role and text; those of TURN_RANGE turns of a conversation, and those without a turn, are sorted in one task. Only the four columns named are read, so others of any name are harmless. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm._order import following, grouped_before
from corpusmill.llm._scratch import cut, drop

#: Turns of a conversation that are sorted together.
TURN_RANGE = 512

_MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
_ATTRIBUTION = re.compile(r"^.*\b(?:wrote|writes|schrieb|escribió|a écrit)\s*:\s*$", re.I)
_NOT_WORD = re.compile(r"[\W_]+")


def normalise(text: str) -> str:
    return _NOT_WORD.sub(" ", text.lower()).strip()


def passage_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(normalise(text).encode(), digest_size=8).digest(), "little", signed=True)


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """Own text without quotes, and quoted passages as (level, text)."""
    if not text or ">" not in text:
        return (text or "").strip(), []
    own: list[str] = []
    quotes: list[tuple[int, str]] = []
    part, level = [], 0

    def end() -> None:
        nonlocal part
        if level and (passage := "\n".join(part).strip()) and normalise(passage):
            quotes.append((level, passage))
        part = []

    for line in text.split("\n"):
        m = _MARKS.match(line)
        depth = m[1].count(">") if m else 0
        body = line[m.end() :] if m else line
        if depth != level or (depth and not body.strip()):
            end()
            level = depth
        if depth:
            if own and depth and _ATTRIBUTION.match(own[-1].strip()):
                own.pop()
            part.append(body)
        else:
            own.append(line)
    end()
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip(), quotes


def own_passages(own: str) -> list[int]:
    """Hashes of the own text as a whole and of each paragraph of it."""
    parts = [own, *re.split(r"\n[ \t]*\n", own)]
    return sorted({passage_hash(p) for p in parts if normalise(p)})


def _parsed(messages: DataFrame) -> DataFrame:
    def kernel(batches):
        for batch in batches:
            own, hashes, quotes = [], [], []
            for text in batch.column(4).to_pylist():
                mine, quoted = parse(text)
                own.append(mine)
                hashes.append(own_passages(mine))
                quotes.append([{"level": level, "hash": passage_hash(p)} for level, p in quoted])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(own, pa.string()), pa.array(hashes, pa.list_(pa.int64())), pa.array(quotes, pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64())])))],
                [*batch.schema.names[:4], "text", "hashes", "quotes"],
            )

    quote = T.ArrayType(T.StructType().add("level", T.IntegerType()).add("hash", T.LongType()))
    schema = T.StructType([*messages.schema.fields[:4], T.StructField("text", T.StringType()), T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("quotes", quote)])
    return messages.mapInArrow(kernel, schema)


def _latest_before(events: DataFrame) -> DataFrame:
    """events: conv, hash, turn, source (the turn, of an original) or level (of a quote). Quotes with the last source before."""
    key, ranged = ["conv", "hash"], events.withColumn("_range", F.floor(F.col("turn") / TURN_RANGE))
    last = ranged.groupBy(*key, "_range").agg(F.max("source").alias("_last"))
    handed = last.withColumn("_before", F.max("_last").over(Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    joined = ranged.where("level is not null or source is not null").join(
        handed.select(F.col("conv").alias("_c"), F.col("hash").alias("_h"), F.col("_range").alias("_r"), "_before"),
        F.col("conv").eqNullSafe(F.col("_c")) & (F.col("hash") == F.col("_h")) & (F.col("_range") == F.col("_r")),
    )
    near = Window.partitionBy(*key, "_range").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("found", F.coalesce(F.max("source").over(near), F.col("_before"))).where("level is not null").select("conv", "turn", "level", "found")


def thread(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conversation, turn, role, text (without quotes), position, reply_position, reply_to (a turn, null for
    the first message), branch (a turn), n_quotes and n_linked (quoted passages, and those traced to a message)."""
    rows = messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"),
        F.xxhash64(F.col(conv_col), F.col(turn_col), F.col(role_col), F.col(text_col)).alias("tie"), F.col(text_col).alias("text"),
    )
    rows = cut(_parsed(rows), "messages")
    quoted = rows.where((F.size("quotes") > 0) & F.col("turn").isNotNull()).select("conv", "turn", F.explode("quotes").alias("q")).select("conv", F.col("q.hash").alias("hash"), "turn", F.lit(None).cast("long").alias("source"), F.col("q.level").alias("level"))
    # Only passages that someone quotes can be found; the others need not be sorted.
    wanted = quoted.select(F.col("conv").alias("_c"), F.col("hash").alias("_h")).distinct()
    said = rows.where("turn is not null").select("conv", F.explode("hashes").alias("hash"), "turn")
    said = said.join(wanted, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("hash") == F.col("_h")), "left_semi")
    found = _latest_before(quoted.union(said.select("conv", "hash", "turn", F.col("turn").alias("source"), F.lit(None).cast("int").alias("level"))))
    hits = F.struct((-F.col("level")).alias("l"), F.col("found").alias("t"))
    links = found.groupBy(F.col("conv").alias("_conv"), F.col("turn").alias("_turn")).agg(F.max(F.when(F.col("found").isNotNull(), hits))["t"].alias("_link"), F.count("found").alias("_linked"))

    numbered = rows.select("conv", "turn", "role", "text", "tie", F.size("quotes").cast("long").alias("n_quotes"))
    numbered = numbered.join(links, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left").drop("_conv", "_turn")
    span = F.coalesce(F.floor(F.col("turn") / TURN_RANGE), F.lit(-(1 << 62)))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("tie")]
    numbered = grouped_before(numbered.withColumn("_one", F.lit(1)), ["conv"], span, order, "_one", "position").drop("_one")
    # The turn before: the last one in the same range, or the last of any range before it.
    ranged = numbered.withColumn("_range", span)
    ends = ranged.groupBy(F.col("conv").alias("_c"), F.col("_range").alias("_r")).agg(F.max("turn").alias("_end"))
    back = Window.partitionBy("_c").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_earlier", F.max("_end").over(back)).drop("_end")
    ranged = ranged.join(ends, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("_range") == F.col("_r"))).drop("_c", "_r")
    here = Window.partitionBy("conv", "_range").orderBy(*order)
    before = F.coalesce(F.lag("turn").over(here), F.col("_earlier"))
    ranged = ranged.withColumn("_prior", before).withColumn("reply_to", F.coalesce("_link", "_prior"))
    ranged = cut(ranged.withColumn("_opens", F.when(F.col("_prior").isNull() | ~F.col("reply_to").eqNullSafe(F.col("_prior")), F.col("turn"))), "placed")
    opened = ranged.groupBy(F.col("conv").alias("_c"), F.col("_range").alias("_r")).agg(F.max("_opens").alias("_o"))
    opened = opened.withColumn("_open", F.max("_o").over(back)).drop("_o")
    ranged = ranged.join(opened, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("_range") == F.col("_r"))).drop("_c", "_r")
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("branch", F.coalesce(F.max("_opens").over(upto), F.col("_open"))).withColumn("position", F.col("position").cast("long"))
    placed = cut(placed.select("conv", "turn", "role", "text", "position", "reply_to", "branch", "n_quotes", F.coalesce("_linked", F.lit(0)).cast("long").alias("n_linked")), "threads")
    starts = _branch_places(placed)
    if starts is None:
        walked = placed.withColumn("reply_position", F.col("position"))
    else:
        match = F.col("conv").eqNullSafe(F.col("_c")) & F.col("branch").eqNullSafe(F.col("_b"))
        walked = placed.join(starts, match, "left").withColumn("reply_position", F.coalesce(F.col("position") - F.col("_first") + F.col("_place"), F.col("position")))
    return walked.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col), "position", "reply_position", "reply_to", "branch", "n_quotes", "n_linked"
    )


def _branch_places(placed: DataFrame) -> DataFrame | None:
    """_c, _b (conversation and branch), _first (its least position) and _place (that of its first message in reply order), of
    conversations that have several branches; None if none has."""
    opener = F.min_by("reply_to", "position")
    branches = placed.groupBy("conv", "branch").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"), opener.alias("parent_turn"))
    several = branches.groupBy(F.col("conv").alias("_c")).agg(F.count(F.lit(1)).alias("_k"), F.sum("n").alias("total")).where("_k > 1")
    branches = cut(branches.join(several, F.col("conv").eqNullSafe(F.col("_c"))).drop("_c", "_k"), "branches")
    if branches.isEmpty():
        return None
    # The branch and position of the message that opens each branch; branches that answer none come last, below the first one.
    # Positions are never negative, so -1 is free to mean "none".
    asked = branches.where("parent_turn is not null").select(F.col("conv").alias("_c"), F.col("parent_turn").alias("_t")).distinct()
    held = placed.join(asked, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("turn") == F.col("_t"))).groupBy("_c", "_t").agg(F.max(F.struct("position", "branch")).alias("_m"))
    parents = branches.select(F.col("conv").alias("_pc"), F.col("branch").alias("_pb"), F.col("first").alias("_pf"))
    known = branches.join(held, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("parent_turn") == F.col("_t")), "left").drop("_c", "_t")
    known = known.join(parents, F.col("conv").eqNullSafe(F.col("_pc")) & F.col("_m.branch").eqNullSafe(F.col("_pb")) & F.col("_m").isNotNull(), "left").drop("_pc", "_pb")
    known = known.withColumn("up", F.when(F.col("first") > 0, F.coalesce("_pf", F.lit(0)))).withColumn("at", -F.coalesce(F.col("_m.position"), F.lit(-1)))
    known = cut(known.select("conv", "branch", "n", "first", "total", "up", "at"), "tree")
    # Around the tree: 2 * first enters a branch, 2 * first + 1 leaves it.
    order = F.struct("at", "first")
    children = known.where("up is not null")
    eldest = children.groupBy(F.col("conv").alias("_c"), F.col("up").alias("_u")).agg(F.min_by("first", order).alias("_child"))
    after = following(children.select("conv", "up", "at", "first"), ["conv", "up"], ["at", "first"], "first", "sibling")
    after = after.select(F.col("conv").alias("_sc"), F.col("first").alias("_sf"), "sibling")
    enter = known.join(eldest, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("first") == F.col("_u")), "left").select("conv", (2 * F.col("first")).alias("e"), F.col("n").alias("sum"), F.coalesce(2 * F.col("_child"), 2 * F.col("first") + 1).alias("next"))
    leave = known.join(after, F.col("conv").eqNullSafe(F.col("_sc")) & (F.col("first") == F.col("_sf")), "left").select("conv", (2 * F.col("first") + 1).alias("e"), F.lit(0).cast("long").alias("sum"), F.coalesce(2 * F.col("sibling"), 2 * F.col("up") + 1).alias("next"))
    walk = cut(enter.union(leave), "walk")
    while not walk.where("next is not null").isEmpty():  # rounds grow with the logarithm of the longest walk
        ahead = walk.select(F.col("conv").alias("_c"), F.col("e").alias("_e"), F.col("sum").alias("_s"), F.col("next").alias("_n"))
        joined = walk.join(ahead, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("next") == F.col("_e")), "left")
        before, walk = walk, cut(joined.select("conv", "e", (F.col("sum") + F.coalesce("_s", F.lit(0))).alias("sum"), F.col("_n").alias("next")), "walk")
        drop(before)
    ends = walk.where("e % 2 = 0").select(F.col("conv").alias("_c"), (F.col("e") / 2).cast("long").alias("_e"), "sum")
    ranked = known.join(ends, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("first") == F.col("_e")))
    return ranked.select(F.col("conv").alias("_c"), F.col("branch").alias("_b"), F.col("first").alias("_first"), (F.col("total") - F.col("sum")).alias("_place"))
