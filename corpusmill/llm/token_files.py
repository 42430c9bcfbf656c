"""Token-id output: ORC files of byte-pair token ids in ascending id order, and reading them back.

Documents are dealt into ranges of their ids and sorted, so file k holds ids below those of file k + 1. Each row has the
document id, a hash of the text (tells rows with the same id apart) and the token ids with the end id last. Integer columns
are run-length encoded by ORC, each stripe has row indexes, and document ids have Bloom filters, so a read of some ids skips
whole stripes and row groups, and stripes are read in parallel.

Texts are cut before single spaces that stand between two other characters. The byte-level pre-tokenizer cuts there as well
(the space belongs to the word after it), so pieces can be encoded apart and each distinct piece once; texts in which white
space follows a space go to the tokenizer whole. Special tokens' strings in a text are ordinary text unless added_tokens is set:
then they become their ids, as in the tokenizer's plain call, and texts that hold such a string go to the tokenizer whole.

A null text is an empty one and has the end id alone; texts of any length are one row. A null id sorts first. Rows that share an
id are told apart by their texts, and rows equal in both are interchangeable. Only id_col and text_col are read. An empty table
gives no rows.
"""

from __future__ import annotations

import re
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm._order import global_prefix
from corpusmill.llm._scratch import cut
from corpusmill.llm._words import buffers, chunks, mix64, power_tables

END_ID = 0
#: Slots of a worker's table of known pieces (16 bytes each, filled to 60 %), and bytes of text encoded at once.
SLOTS = 1 << 21
GROUP_BYTES = 1 << 19
STRIPE_BYTES = 64 << 20
ROW_INDEX_STRIDE = 1000
_MAY_BE_SPACE = np.zeros(256, bool)  # first bytes of white space: ASCII controls and spaces, and lead bytes of wider ones
_MAY_BE_SPACE[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of a number's first bytes
_SPACE_THEN_SPACE = re.compile(r" (?:\s|\Z)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts with a byte-level tokenizer, remembering the ids of pieces.

    Pieces are found, hashed and looked up for a whole run of texts at once. The memory is an open-addressing table of 64-bit
    hashes, with each piece's bytes and the place and number of its ids in a pool. A piece found by its hash counts only if its
    bytes are the same: the first 16 are compared as two numbers, longer ones as a whole. Pieces that are not in the table are
    encoded, all in one call. Once it is full, what it holds stays (frequent pieces come early) and other pieces are encoded
    again in each run.
    """

    def __init__(self, definition: str, end_id: int = END_ID, slots: int = SLOTS, added_tokens: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = not added_tokens
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if added_tokens else []
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.opens = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.opens[[i for token, i in vocab.items() if token.startswith("Ġ")]] = True  # tokens that begin with a space
        self.marks: dict[str, np.ndarray] = {}
        self.key, self.at, self.n = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.head, self.next, self.size = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.long: dict[int, bytes] = {}  # pieces of more than 16 bytes, by slot
        self.held = 0
        self.pool, self.used = np.zeros(1 << 20, np.int32), 1
        self.pool[0] = end_id

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _learn(self, pieces: list[str]) -> dict[str, np.ndarray]:
        """Ids of " " + piece, all in one call; the tokens that begin with a space tell where each one's ids begin."""
        ids = self._whole(" " + " ".join(pieces))
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(pieces):
            return {p: self._whole(" " + p) for p in pieces}
        edges = [*starts.tolist(), len(ids)]
        return {p: ids[edges[k] : edges[k + 1]] for k, p in enumerate(pieces)}

    def _encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of " " + piece. Letters with marks after them are two tokens to the pre-tokenizer, so each part is encoded once."""
        stems = [stem if (stem := p.rstrip(string.punctuation)).isalpha() else p for p in pieces]
        plain = list(dict.fromkeys(stems))
        found: dict[str, np.ndarray] = {}
        for k in range(0, len(plain), 4000):
            found |= self._learn(plain[k : k + 4000])
        out = []
        for p, stem in zip(pieces, stems, strict=True):
            ids = found[stem]
            if len(stem) < len(p):
                tail = p[len(stem) :]
                if tail not in self.marks:
                    self.marks[tail] = self._whole(tail)
                ids = np.concatenate([ids, self.marks[tail]])
            out.append(ids)
        return out

    def _with_added(self, raw: np.ndarray, edges: np.ndarray) -> set[int]:
        """Rows that hold an added token's string."""
        data, out = raw.tobytes(), set()
        for token in self.added:
            at = data.find(token)
            while at >= 0:
                row = int(np.searchsorted(edges, at, "right")) - 1
                if at + len(token) <= edges[row + 1]:
                    out.add(row)
                at = data.find(token, at + 1)
        return out

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where it is not in the table."""
        mask = len(self.key) - 1
        slot = (hashes & np.uint64(mask)).astype(np.int64)
        seen = self.key[slot]
        out = np.where(seen == hashes, slot, -1)
        todo = np.flatnonzero((seen != hashes) & (seen != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            seen = self.key[slot[todo]]
            hit = seen == hashes[todo]
            out[todo[hit]] = slot[todo[hit]]
            todo = todo[~hit & (seen != 0)]
        return out

    def _insert(self, hashes: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Puts distinct hashes that are not in the table into free slots; returns the slots."""
        mask = len(self.key) - 1
        todo, slot = np.arange(len(hashes)), (hashes & np.uint64(mask)).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.key[slot[todo]] == 0)
            _, first = np.unique(slot[todo[free]], return_index=True)
            won = todo[free[first]]
            self.key[slot[won]], self.at[slot[won]], self.n[slot[won]] = hashes[won], at[won], n[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & mask
        self.held += len(hashes)
        return slot

    def _store(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Appends ids to the pool: place and number of each part."""
        n = np.fromiter((len(x) for x in parts), np.int64, len(parts))
        at = self.used + np.cumsum(n) - n
        end = self.used + int(n.sum())
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), end - len(self.pool)), np.int32)])
        if parts:
            self.pool[self.used : end] = np.concatenate(parts)
        self.used = end
        return at, n

    def encode(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts whose bytes lie between each two edges, each text's end id last, and the number of ids of each."""
        raw, edges = data[edges[0] : edges[-1]], edges - edges[0]
        rows = len(edges) - 1
        # A piece begins at each row's start and after each space.
        spaces = np.flatnonzero(raw == 32)
        begin = np.concatenate([edges[:-1], spaces + 1])
        order = np.argsort(begin, kind="stable")  # a row that ends in a space: the empty piece after it, then the next row
        space_row = np.searchsorted(edges, spaces, "right") - 1
        row = np.concatenate([np.arange(rows), space_row])
        order = order[np.argsort(row[order], kind="stable")]
        begin, row, lead = begin[order], row[order], order >= rows
        first = np.searchsorted(row, np.arange(rows))
        finish = np.empty(len(begin), np.int64)
        finish[:-1] = begin[1:] - 1
        finish[np.append(first[1:], len(begin)) - 1] = edges[1:]
        finish = np.maximum(finish, begin)
        up, down = power_tables(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        size = (finish - begin).astype(np.uint64)
        hashes = mix64(mix64((sums[finish] - sums[begin]) * down[begin]) + size * np.uint64(2) + lead)
        hashes[hashes == 0] = 1
        # White space after a space belongs together with it: such texts are encoded whole.
        head = raw[np.minimum(begin, max(len(raw) - 1, 0))] if len(raw) else np.zeros(len(begin), np.uint8)
        doubtful = np.unique(row[lead & ((size == 0) | _MAY_BE_SPACE[head])])
        text = lambda a, b: raw[a:b].tobytes().decode()
        whole = sorted({int(r) for r in doubtful if _SPACE_THEN_SPACE.search(text(edges[r], edges[r + 1]))} | self._with_added(raw, edges))
        skip = np.isin(row, whole) if whole else np.zeros(len(row), bool)

        # The pieces' own bytes: the first 16 as two numbers, and their number with the mark of a space before them.
        eights = np.ndarray((len(raw) + 9,), "<u8", np.concatenate([raw, np.zeros(16, np.uint8)]), 0, (1,))
        head, next_ = eights[begin] & _FIRST_BYTES[np.minimum(size, 8).astype(np.int64)], np.zeros(len(begin), np.uint64)
        wide = np.flatnonzero(size > 8)
        next_[wide] = eights[begin[wide] + 8] & _FIRST_BYTES[np.minimum(size[wide] - np.uint64(8), 8).astype(np.int64)]
        marked = (size * np.uint64(2) + lead).astype(np.int32)
        piece = lambda k: raw[begin[k] : finish[k]].tobytes()

        slot = self._find(hashes)
        same = (slot >= 0) & (self.head[slot] == head) & (self.next[slot] == next_) & (self.size[slot] == marked)
        for k in np.flatnonzero(same & (size > 16)):
            same[k] = self.long[int(slot[k])] == piece(k)
        at, n = np.where(same, self.at[slot], 0), np.where(same, self.n[slot], 0)
        other = (slot >= 0) & ~same & ~skip  # the hash of another piece
        missing = np.flatnonzero((slot < 0) & ~skip)
        mark = self.used
        if len(missing):
            new, sample, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            sample = missing[sample]
            first_of = sample[back]
            alike = (head[missing] == head[first_of]) & (next_[missing] == next_[first_of]) & (marked[missing] == marked[first_of])
            for k in np.flatnonzero(alike & (size[missing] > 16)):
                alike[k] = missing[k] == first_of[k] or piece(missing[k]) == piece(first_of[k])
            other[missing[~alike]] = True
            texts = [text(begin[k], finish[k]) for k in sample]
            leading = lead[sample]
            ids: list = [None] * len(texts)
            for k, x in zip(np.flatnonzero(leading), self._encode_pieces([texts[k] for k in np.flatnonzero(leading)]), strict=True):
                ids[k] = x
            for k in np.flatnonzero(~leading):
                ids[k] = self._whole(texts[k])
            keep = (len(self.key) * 6 // 10) - self.held >= len(new)
            new_at, new_n = self._store(ids)
            at[missing], n[missing] = new_at[back], new_n[back]
            if keep:
                put = self._insert(new, new_at, new_n)
                self.head[put], self.next[put], self.size[put] = head[sample], next_[sample], marked[sample]
                for k in np.flatnonzero(size[sample] > 16):
                    self.long[int(put[k])] = piece(sample[k])
                mark = self.used
        if other.any():
            alone = np.flatnonzero(other)
            at[alone], n[alone] = self._store([self._whole(" " * int(lead[k]) + text(begin[k], finish[k])) for k in alone])
        if whole:
            whole_at, whole_n = self._store([self._whole(text(edges[r], edges[r + 1])) for r in whole])
            n[skip] = 0
            at[first[whole]], n[first[whole]] = whole_at, whole_n
        at = np.insert(at, np.append(first[1:], len(at)), 0)  # the end id is the pool's first
        n = np.insert(n, np.append(first[1:], len(n)), 1)
        total = np.cumsum(n)
        ids = self.pool[np.repeat(at - (total - n), n) + np.arange(total[-1] if len(total) else 0)]
        ends = total[np.append(first[1:], len(row)) + np.arange(rows)] if rows else np.zeros(0, np.int64)
        self.used = mark
        return ids, np.diff(ends, prepend=0)


_encoders: dict[tuple[str, int, bool], Encoder] = {}


def worker_encoder(definition: str, end_id: int, added_tokens: bool = False) -> Encoder:
    """The worker's encoder for a tokenizer: what it has learned serves all tasks of the worker."""
    if (definition, end_id, added_tokens) not in _encoders:
        _encoders.clear()
        _encoders[definition, end_id, added_tokens] = Encoder(definition, end_id, added_tokens=added_tokens)
    return _encoders[definition, end_id, added_tokens]


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, added_tokens: bool = False) -> None:
    """Writes ORC files of (doc_id, text_hash, ids) in ascending id order under path. tokenizer: a tokenizers file.

    added_tokens: strings of the tokenizer's added tokens become their ids, as encode does by default.
    """
    spark = docs.sparkSession
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())

    def kernel(batches):
        encoder = worker_encoder(definition.value, end_id, added_tokens)
        for batch in batches:
            data, edges = buffers(batch.column(2))
            for a, b in chunks(edges, GROUP_BYTES):
                ids, counts = encoder.encode(data, edges[a : b + 1])
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.ListArray.from_arrays(offsets, pa.array(ids))], ["doc_id", "text_hash", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    encoded = ranged.mapInArrow(kernel, f"doc_id {kind}, text_hash long, ids array<int>")
    (
        encoded.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true").option("orc.row.index.stride", str(ROW_INDEX_STRIDE)).option("orc.stripe.size", str(STRIPE_BYTES)).orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """(doc_id, text_hash, ids) as written; of the given ids alone, if any are given, which prunes files, stripes and row groups."""
    out = spark.read.orc(path)
    return out if doc_ids is None else out.where(F.col("doc_id").isin(list(doc_ids)))


def describe_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens (with the end id) and
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def kernel(batches):
        for batch in batches:
            ids = batch.column(2)
            at, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at), pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "text_hash", "n_tokens", "ids_crc32"])

    rows = spark.read.orc(path)
    kind = rows.schema["doc_id"].dataType.simpleString()
    small = cut(rows.mapInArrow(kernel, f"doc_id {kind}, text_hash long, n_tokens long, ids_crc32 long"), "token-rows")
    placed, _, _ = global_prefix(small, ["doc_id", "text_hash", "n_tokens"], "n_tokens")
    return placed.select("doc_id", F.col("before").alias("start"), "n_tokens", "ids_crc32")
