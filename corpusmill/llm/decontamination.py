"""Benchmark decontamination: a broadcast hash set of benchmark n-grams, scanned over every window of the training text.

Words are runs of ASCII letters and digits, lower-cased, or of code points from U+0080 on. A benchmark item gives all its
runs of n words, or one shorter window of all its words. Windows of a document whose 64-bit hash is in the set are compared
byte by byte before they count. The scan is one pass over the documents with no shuffle.

A benchmark of more than BLOCK_BYTES of text is dealt by hash into blocks of about that size (some 8 times that in a worker's
memory), one of which is gathered, broadcast and scanned for at a time. Each scan writes what it found, of documents with hits
alone and by the md5 of their text, and its broadcast is destroyed before the next block; at the end documents meet their hits
by that md5. A single item must fit in a block.

A null or empty text has no words and no hits; texts of any length are scanned whole. Null items and items without a word have
no windows. Equal items each count. Item ids compare as strings; a null item id is the string "". Rows are judged one by one,
so repeated ids and texts are harmless. Columns of docs keep their names whatever they are called; report returns no others
than its own. An empty table gives an empty result, an empty benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm._scratch import cut, fresh
from corpusmill.llm._words import Words, each_words

NGRAM = 10
BLOCK_BYTES = 16 << 20
#: Bytes of md5 keys of documents with hits that are broadcast at most when there are several blocks.
MAX_BROADCAST_BYTES = 64 << 20
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_FOUND_TYPE = pa.struct([("n_words", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string()))])
_RANGES = T.ArrayType(T.StructType().add("first", T.IntegerType()).add("last", T.IntegerType()))
_FOUND = T.StructType().add("n_words", T.LongType()).add("spans", _RANGES).add("items", T.ArrayType(T.StringType()))


class Windows:
    """The windows of a block of items: for each length a packed filter, the sorted hashes and, beside them, where the words of
    each window stand in the block's text and which item it is from."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.ids = [i for i, _ in items]
        texts, starts, ends, total, base = [], [], [], 0, 0
        parts: dict[int, list[tuple]] = {}
        for row, words in each_words(pa.array([text for _, text in items], pa.string())):
            size = words.end - words.start
            place = np.cumsum(size + 1) - size - 1
            inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            text = np.full(int(size.sum()) + len(size), 32, np.uint8)  # words, each with a space after it
            text[np.repeat(place, size) + inner] = words.data[np.repeat(words.start, size) + inner]
            texts.append(text)
            starts.append(place + total)
            ends.append(place + size + total)
            counts = np.diff(words.first)
            for length in {min(n, int(c)) for c in counts if c}:
                at, hashes = words.windows(length)
                if length < n:
                    use = counts[words.row[at]] == length
                    at, hashes = at[use], hashes[use]
                parts.setdefault(length, []).append((hashes, at + base, words.row[at] + row))
            total, base = total + len(text), base + len(size)
        join = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.zeros(0, kind)
        self.text, self.start, self.end = join(texts, np.uint8).tobytes(), join(starts, np.int32), join(ends, np.int32)
        self.by_length = {}
        for length, found in sorted(parts.items()):
            keys, at, item = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            bits = np.zeros(1 << max(10, len(keys).bit_length() + 1), np.uint8)  # 16 bits or more for each key
            slot = keys & np.uint64(8 * len(bits) - 1)
            np.bitwise_or.at(bits, (slot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
            self.by_length[length] = (bits, keys, at[order].astype(np.int32), item[order].astype(np.int32))
        self.known: dict[tuple[int, bytes], frozenset[str]] = {}

    def _items(self, length: int, hash_: np.uint64, text: bytes) -> frozenset[str]:
        """Ids of the items that have this window, whose hash is in the set."""
        if (found := self.known.get((length, text))) is None:
            _, keys, at, item = self.by_length[length]
            a, b = np.searchsorted(keys, hash_, "left"), np.searchsorted(keys, hash_, "right")
            found = frozenset(self.ids[item[k]] for k in range(a, b) if self.text[self.start[at[k]] : self.end[at[k] + length - 1]] == text)
            if len(self.known) >= 100_000:
                self.known.clear()
            self.known[length, text] = found
        return found

    def find(self, words: Words) -> Iterator[tuple[int, int, frozenset[str]]]:
        """Place, length and items of each occurrence."""
        for length, (bits, keys, _, _) in self.by_length.items():
            at, hashes = words.windows(length)
            slot = hashes & np.uint64(8 * len(bits) - 1)
            near = np.flatnonzero(bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
            place = np.minimum(np.searchsorted(keys, hashes[near]), len(keys) - 1)
            for k in near[keys[place] == hashes[near]]:
                if ids := self._items(length, hashes[k], words.text(int(at[k]), length)):
                    yield int(at[k]), length, ids


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Distinct items (id, text), and the number of blocks."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")).where("length(text) > 0").distinct()
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("id"))).first()[0] or 0
    return items, max(1, -(-size // BLOCK_BYTES))


def _covered(spans: list[tuple[int, int]]) -> list[dict]:
    """Merged word ranges from (place, length)."""
    out: list[dict] = []
    for at, n in sorted(spans):
        if out and at <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], at + n - 1)
        else:
            out.append({"first": at, "last": at + n - 1})
    return out


def _scan(docs: DataFrame, text_col: str, held, out: str) -> DataFrame:
    """docs and, last, out: number of words, word ranges that are hit and item ids, for the windows in a broadcast."""
    place = docs.columns.index(text_col)

    def kernel(batches):
        index = held.value
        for batch in batches:
            found = []
            for _, words in each_words(batch.column(place)):
                spans: dict[int, list] = {}
                items: dict[int, set] = {}
                for at, n, ids in index.find(words):
                    r = int(words.row[at])
                    spans.setdefault(r, []).append((at - int(words.first[r]), n))
                    items.setdefault(r, set()).update(ids)
                counts = np.diff(words.first).tolist()
                found += [{"n_words": c, "spans": _covered(spans[r]) if r in spans else [], "items": sorted(items.get(r, ()))} for r, c in enumerate(counts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _FOUND_TYPE)], [*batch.schema.names, out])

    return docs.mapInArrow(kernel, T.StructType([*docs.schema.fields, T.StructField(out, _FOUND)]))


def _key(text_col: str) -> Column:
    return F.md5(F.col(text_col).cast("binary"))


def _hits_by_text(docs: DataFrame, items: DataFrame, n_blocks: int, n: int, text_col: str) -> DataFrame:
    """_key (md5 of a text), _ranges (of all blocks, may overlap) and _ids of the texts with hits, found block by block."""
    sc, parts = docs.sparkSession.sparkContext, []
    texts = docs.select(F.col(text_col).alias("_text"))
    for k in range(n_blocks):
        block = [(r["id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == k).collect()]  # about BLOCK_BYTES
        held = sc.broadcast(Windows(block, n))
        hit = _scan(texts, "_text", held, "_found").where(F.size("_found.spans") > 0)
        parts.append(cut(hit.select(_key("_text").alias("_key"), F.col("_found.spans").alias("_ranges"), F.col("_found.items").alias("_ids")).dropDuplicates(["_key"]), "hits"))
        held.destroy()
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    # One row for each block at most has the same key.
    return cut(every.groupBy("_key").agg(F.flatten(F.collect_list("_ranges")).alias("_ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_ids")))).alias("_ids")), "hits")


def with_hits(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "_hits") -> DataFrame:
    """docs and, last, out: number of words, word ranges that are hit and sorted item ids."""
    items, n_blocks = _blocks(benchmark, item_id, item_text)
    sc = docs.sparkSession.sparkContext
    if n_blocks == 1:
        return _scan(docs, text_col, sc.broadcast(Windows([(r["id"], r["text"]) for r in items.collect()], n)), out)
    found = _hits_by_text(docs, items, n_blocks, n, text_col)
    key, ranges, ids = (fresh([*docs.columns, out], c) for c in ("_key", "_ranges", "_ids"))
    hits = found.select(F.col("_key").alias(key), F.col("_ranges").alias(ranges), F.col("_ids").alias(ids))
    size = found.agg(F.sum(64 + 16 * F.size("_ranges") + F.expr("aggregate(_ids, 0, (a, x) -> a + octet_length(x) + 16)"))).first()[0] or 0
    joined = docs.join(F.broadcast(hits) if size <= MAX_BROADCAST_BYTES else hits, _key(text_col) == F.col(key), "left")
    counted = _scan(joined, text_col, sc.broadcast(Windows([], n)), out)  # for the number of words
    ordered = F.array_sort(F.coalesce(F.col(ranges), F.array().cast("array<struct<first:int,last:int>>")))
    none = F.array().cast("array<struct<first:int,last:int>>")

    def merge(done, x):
        last = F.try_element_at(done, F.lit(-1))
        joins = last.isNotNull() & (x["first"] <= last["last"] + 1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    made = F.struct(F.col(f"{out}.n_words").alias("n_words"), F.aggregate(ordered, none, merge).alias("spans"), F.coalesce(F.col(ids), F.array().cast("array<string>")).alias("items"))
    return counted.select(*docs.columns, made.alias(out))


def report(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids and spans (word ranges)."""
    out = fresh([id_col, text_col], "_hits")
    marked = with_hits(docs.select(id_col, text_col), benchmark, n, text_col, out=out)
    spans, items = F.col(f"{out}.spans"), F.col(f"{out}.items")
    return marked.select(
        F.col(id_col), F.col(f"{out}.n_words").alias("n_words"), F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["last"] - s["first"] + 1).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.size(spans) > 0).alias("contaminated"),
        items.alias("item_ids"), spans.alias("spans"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, text_col: str = "text") -> DataFrame:
    """docs without those that hold a benchmark window."""
    hits = fresh(docs.columns, "_hits")
    return with_hits(docs, benchmark, n, text_col, out=hits).where(F.size(f"{hits}.spans") == 0).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, text_col: str = "text") -> DataFrame:
    """docs whose texts have lost the words of every hit, each run of them with what stands between."""
    marked, place = with_hits(docs, benchmark, n, text_col, out=fresh(docs.columns, "_hits")), docs.columns.index(text_col)

    def strip(batches):
        for batch in batches:
            texts, hits = batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for row, words in each_words(batch.column(place)):
                edges = None
                for r in range(words.n_rows):
                    if not hits[row + r]["spans"]:
                        continue
                    if edges is None:
                        sizes = [len((t or "").encode()) for t in texts[row : row + words.n_rows]]
                        edges = np.concatenate([[0], np.cumsum(sizes)])
                    raw, first = texts[row + r].encode(), words.first[r]
                    for s in reversed(hits[row + r]["spans"]):
                        raw = raw[: words.start[first + s["first"]] - edges[r]] + raw[words.end[first + s["last"]] - edges[r] :]
                    texts[row + r] = raw.decode()
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return marked.mapInArrow(strip, docs.schema)
