"""Language-model scores: a causal self-attention model over subword ids, beside add-one word counts of the whole corpus.

Texts are lower-cased (A-Z) and cut into words at ASCII white space; a text's tokens are its words and one end.

Counts. Every word of every text is counted by batch, in a map-side sum and in a shuffle by word. For a text's base score its
frequent words (at least 1 / HEAD_SHARE of all tokens, so at most HEAD_SHARE words of at most 65 bytes) are looked up in a
broadcast table, all others are joined to the counts by word; none of these is frequent, so no task of that join is hot. Words of
more than 64 bytes are known by their sha256.

Model. Each word, with a space before it, becomes ids of a public byte-level tokenizer. An id's embedding gives its query, key,
value and own vector; a position attends to itself and to what stands before it in its window, with a learned bias for the
distance; the own vector, with the attended values added to its first VALUE_WIDTH places, goes through a rectifier into a softmax over CLASSES classes and one over the
MEMBERS ids of a class. Ids beyond CLASSES * MEMBERS share one more class, within which they have add-one probabilities. Which
ids are kept, the class they are in and the output biases come from the ids' counts over all training texts. The rest is trained on
every window of every training text, in up to ROUNDS rounds: each takes the texts of one hash, each task goes through its own of them
with Adam from the same tables, and the tables of all tasks, weighted by their targets, are averaged for the next round. Few texts are
gone through again until a task has made STEPS steps. The result depends on how the input is dealt over partitions.

Scoring cuts a text's ids into windows of WINDOW inputs that overlap, so that each id is scored once, with the last
WINDOW - STRIDE to WINDOW - 1 ids before it in sight. Windows of many texts go through masked attention as one batch.

A null or empty text has the end alone. Texts of any length are scored whole; a batch holds one text at least. A null id is not
held out. Repeated rows get results that are equal but for the rounding of 32-bit sums, each its own row. Without a training document no token is known (every base probability is
1), and the model is a uniform one. Columns but id_col and text_col are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm._fit import fold
from corpusmill.llm._scratch import cut
from corpusmill.llm._words import buffers, chunks

FOLDS, HELD_OUT_FOLD = 7, 2
HEAD_SHARE = 1_000_000
LONG_WORD = 64
#: Bytes of text whose words are counted, and that are scored, at once.
CHUNK, SCORE_CHUNK = 4 << 20, 4 << 20
CLASSES, MEMBERS = 32, 32
WINDOW, STRIDE = 24, 16
WIDTH, KEY_WIDTH, VALUE_WIDTH = 48, 16, 32
STEPS, BATCH, RATE, DECAY = 1500, 192, 0.02, 0.1
#: Rounds of training at most, symbols at least that a task learns from in one where there are enough, places of averaged tables.
ROUNDS, TASK_SYMBOLS, FIXED = 8, 800_000, float(1 << 20)
CLIP = 30.0
#: Windows scored as one batch, and words whose ids a worker remembers.
GROUP, REMEMBERED = 1024, 300_000
FEW = 8  # rows of a place that are summed beside those of other places
END = ""  # the end of a text among words


# Words --------------------------------------------------------------------------------------------------------------------


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts, one text after the other, and how many each has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null("")))
    words, at = lists.flatten(), lists.offsets.to_numpy()
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # white space at either end gives empty ones
    before = np.concatenate([[0], np.cumsum(real)])
    return words.filter(pa.array(real)), np.diff(before[at - at[0]])


def keys(words: pa.Array) -> pa.Array:
    """Words as they are counted: those of more than LONG_WORD bytes by their sha256, behind a space, which no word has."""
    wide = np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False) > LONG_WORD)
    if not len(wide):
        return words
    out = words.to_pylist()
    for k in wide:
        out[k] = " " + hashlib.sha256(out[k].encode()).hexdigest()
    return pa.array(out, pa.string())


def _parts(batch: pa.RecordBatch, text: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Whole rows, about limit bytes of text at a time."""
    _, at = buffers(batch.column(text))
    for a, b in chunks(at, limit):
        yield batch.slice(a, b - a)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n_train, n_all) from (held_out, text), the end of a text being the word ''."""

    def kernel(batches):
        for batch in batches:
            for part in _parts(batch, 1, CHUNK):
                words, n = split(part.column(1))
                trains = ~part.column(0).to_numpy(zero_copy_only=False).astype(bool)
                coded = words.dictionary_encode()
                index, distinct = coded.indices.to_numpy(), len(coded.dictionary)
                n_all = np.bincount(index, minlength=distinct)
                n_train = np.bincount(index[np.repeat(trains, n)], minlength=distinct)
                out = pa.concat_arrays([keys(coded.dictionary), pa.array([END], pa.string())])
                yield pa.RecordBatch.from_arrays([out, pa.array(np.append(n_train, trains.sum())), pa.array(np.append(n_all, len(n)))], ["word", "n_train", "n_all"])

    return docs.mapInArrow(kernel, "word string, n_train long, n_all long").groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


class Subwords:
    """Ids of words, each with a space before it, by the ranks and the pattern of a byte-level tokenizer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.size = max(ranks.values()) + 1
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(self.size, bool)
        self.opens[[i for token, i in ranks.items() if token.startswith(b" ")]] = True  # ids that begin with a space

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has. Words are encoded together, told apart by the ids that begin with a space; one with
        white space inside (other than ASCII) by itself."""
        ids, sizes = [], []
        for k in range(0, len(words), 4000):
            part = words[k : k + 4000]
            if all(map(_plain, part)):
                found = np.array(self.encoding.encode_ordinary(" " + " ".join(part)), np.int32)
                starts = np.flatnonzero(self.opens[found])
                if len(starts) == len(part):
                    ids.append(found)
                    sizes.append(np.diff(starts, append=len(found)))
                    continue
            each = [self.encoding.encode_ordinary(f" {w}") for w in part]
            ids.append(np.array([i for x in each for i in x], np.int32))
            sizes.append(np.array([len(x) for x in each], np.int64))
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def _plain(word: str) -> bool:
    return word.isalnum() or word.split() == [word]


_subwords: dict[str, Subwords] = {}


def worker_subwords(definition: tuple[dict[bytes, int], str, str]) -> Subwords:
    """The worker's own, for all its tasks: of ranks, pattern and a name for both."""
    ranks, pattern, name = definition
    if name not in _subwords:
        _subwords.clear()
        _subwords[name] = Subwords(ranks, pattern)
    return _subwords[name]


def read_ranks(path: str | None = None, pattern: str | None = None) -> tuple[dict[bytes, int], str, str]:
    """Ranks of a tokenizer's file, its pattern and a name for both; a public one by default."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return ranks, pattern or public_tokenizers.PATTERN, path


def subword_counts(counts: DataFrame, definition) -> list[tuple[int, int]]:
    """(id, how often it occurs in training texts), a row at most for each id of the tokenizer. Words of more than LONG_WORD bytes
    are not counted here."""

    def kernel(batches):
        for batch in batches:
            ids, sizes = worker_subwords(definition.value).encode(batch.column(0).to_pylist())
            if len(ids):
                total = np.bincount(ids, np.repeat(batch.column(1).to_numpy(), sizes))
                found = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found].astype(np.int64))], ["id", "n"])

    words = counts.where("n_train > 0 and word <> '' and not startswith(word, ' ')").select("word", "n_train")
    return [(r["id"], r["n"]) for r in words.mapInArrow(kernel, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()]


# Model --------------------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    symbol: np.ndarray  # of each id of the tokenizer, the end's after them: its place among those that are kept, or CLASSES * MEMBERS
    rest: np.ndarray  # log-probability of each id within the class of those that are not kept
    tables: list[np.ndarray]  # own, query, key, value [symbols + 2, width]; bias by distance; class weights, bias; member weights, bias
    name: str = ""  # of its symbols, for what a worker remembers

    @property
    def end(self) -> int:
        return len(self.symbol) - 1


OTHER, START = CLASSES * MEMBERS, CLASSES * MEMBERS + 1
_AHEAD = np.where(np.arange(WINDOW)[None, :] > np.arange(STRIDE)[:, None] + WINDOW - STRIDE, -1e9, 0.0).astype(np.float32)  # what a position must not see


def _soft(logits: np.ndarray) -> np.ndarray:
    """Puts exp of logits, CLIP at most, in their place; returns the sums."""
    np.minimum(logits, CLIP, out=logits)
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[-1], logits.dtype)


def attend(tables: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Attended values [n, STRIDE, VALUE_WIDTH] of the last STRIDE positions of windows of symbols [n, WINDOW], and what led to them."""
    query, key, value, distance = tables[1:5]
    q, k, v = query.take(x[:, WINDOW - STRIDE :], 0), key.take(x, 0), value.take(x, 0)
    scores = q @ k.transpose(0, 2, 1)
    np.minimum(scores, CLIP, out=scores)
    scores += distance + _AHEAD
    scores *= (1 / _soft(scores))[:, :, None]
    return scores @ v, q, k, v, scores


def _output(tables: list[np.ndarray], x: np.ndarray, y: np.ndarray, attended: np.ndarray) -> tuple[np.ndarray, ...]:
    """With targets y sorted by class: their order, classes and members, where each class begins, hidden vectors with a 1 behind them,
    each class's weights beside those of its members (biases below, none for the last class) and logits, CLIP at most."""
    weights, bias, member_weights, member_bias = tables[5:]
    target = y.ravel()
    order = np.argsort((target // MEMBERS).astype(np.int8), kind="stable")
    kind, member = np.divmod(target.take(order), MEMBERS)
    bounds = np.searchsorted(kind, np.arange(CLASSES + 2)).tolist()
    hidden = np.append(tables[0], np.ones((len(tables[0]), 1), weights.dtype), 1).take(x[:, WINDOW - STRIDE :].ravel().take(order), 0)
    hidden[:, :VALUE_WIDTH] += attended.reshape(-1, VALUE_WIDTH).take(order, 0)
    np.maximum(hidden, 0, out=hidden)
    both = np.zeros((CLASSES + 1, WIDTH + 1, CLASSES + 1 + MEMBERS), weights.dtype)
    both[:, :WIDTH, : CLASSES + 1], both[:, WIDTH, : CLASSES + 1] = weights, bias
    both[:CLASSES, :WIDTH, CLASSES + 1 :], both[:CLASSES, WIDTH, CLASSES + 1 :] = member_weights, member_bias
    logits = np.empty((len(target), both.shape[2]), weights.dtype)
    for c in range(CLASSES + 1):
        a, b = bounds[c], bounds[c + 1]
        if a < b:
            np.matmul(hidden[a:b], both[c], out=logits[a:b])
    np.minimum(logits, CLIP, out=logits)
    return order, kind, member, bounds, hidden, both, logits


#: Which of a position's logits are of classes, which of members.
_PARTS = np.repeat(np.eye(2, dtype=np.float32), [CLASSES + 1, MEMBERS], 0)


def log_probabilities(tables: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log-probability of symbols y [n, STRIDE] in windows x [n, WINDOW]."""
    order, kind, member, bounds, _, _, logits = _output(tables, x, y, attend(tables, x)[0])
    row, rest = np.arange(len(kind)), bounds[CLASSES]
    found = logits[row, kind]
    found[:rest] += logits[row[:rest], CLASSES + 1 + member[:rest]]
    np.exp(logits, out=logits)
    total = logits @ _PARTS.astype(logits.dtype)
    total[rest:, 1] = 1
    found -= np.log(total).sum(1)
    out = np.empty_like(found)
    out[order] = found
    return out.reshape(y.shape)


def windows(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts' symbols, one text after the other: inputs [n, WINDOW], targets [n, STRIDE], which targets are real, and
    each window's text. Inputs are the symbols before a target, START where there are none."""
    count = -(-sizes // STRIDE)
    row = np.repeat(np.arange(len(sizes)), count)
    first = np.repeat(np.cumsum(sizes) - sizes, count)
    place = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    index = place[:, None] + np.arange(STRIDE)[None, :]
    real = index < np.repeat(sizes, count)[:, None]
    y = np.where(real, ids[np.minimum(first[:, None] + index, len(ids) - 1)], 0)
    back = place[:, None] + np.arange(STRIDE - WINDOW, STRIDE)[None, :] - 1
    # What lies behind the text's end is seen by no real target.
    x = np.where(back < 0, START, ids[np.clip(first[:, None] + back, 0, len(ids) - 1)])
    return x, y, real, row


def untrained(counts: list[tuple[int, int]], n_docs: int, vocabulary: int, seed: int = 5) -> Model:
    """A model whose symbols and biases are there. counts: how often each id of the tokenizer occurs in all training texts; n_docs: how
    many these are."""
    total = np.ones(vocabulary + 1)
    for i, n in counts:
        total[i] += n
    total[vocabulary] += n_docs
    order = np.argsort(-total, kind="stable")
    kept = order[: OTHER if vocabulary >= OTHER else len(order)]
    if vocabulary not in kept:
        kept[-1] = vocabulary
    symbol = np.full(vocabulary + 1, OTHER, np.int32)
    symbol[kept] = np.arange(len(kept))
    others = total * (symbol == OTHER)
    rest = np.where(others > 0, np.log(np.maximum(others, 1) / max(others.sum(), 1)), 0.0)
    share = np.zeros(OTHER) + 1e-3
    share[: len(kept)] = total[kept]
    share = share.reshape(CLASSES, MEMBERS)
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale=0.1: rng.normal(0, scale, shape).astype(np.float32)
    tables = [
        draw(OTHER + 2, WIDTH, scale=0.3), draw(OTHER + 2, KEY_WIDTH, scale=0.3), draw(OTHER + 2, KEY_WIDTH, scale=0.3), draw(OTHER + 2, VALUE_WIDTH, scale=0.3), np.zeros((STRIDE, WINDOW), np.float32),
        draw(WIDTH, CLASSES + 1), np.log(np.append(share.sum(1), max(others.sum(), 1)) / (total.sum() + 1)).astype(np.float32),
        draw(CLASSES, WIDTH, MEMBERS), np.log(share / share.sum(1, keepdims=True)).astype(np.float32),
    ]
    return Model(symbol, rest, tables, uuid.uuid4().hex)


def fit(texts: list[str], counts: list[tuple[int, int]], n_docs: int, subwords: Subwords, seed: int = 5) -> Model:
    """A model of texts that are all at hand."""
    model = untrained(counts, n_docs, subwords.size, seed)
    if texts:
        symbols, sizes = Lexicon(model, subwords).symbols(*split(pa.array(texts, pa.string())))[:2]
        learn(model.tables, blocks([(symbols, sizes)]), _passes(len(symbols), 1), 0, 1, seed)
    return model


def _passes(symbols: int, tasks: int) -> int:
    """How often texts of so many symbols, dealt over tasks, are gone through for STEPS steps of each task."""
    return max(1, -(-STEPS * STRIDE * BATCH * tasks // max(symbols, STRIDE * BATCH * tasks)))


def blocks(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts' symbols and how many each has, put together or cut into whole texts of about GROUP * 64 windows."""
    held, count = [], 0
    for symbols, sizes in parts:
        ends, edges, a = np.cumsum(sizes), np.concatenate([[0], np.cumsum(-(-sizes // STRIDE))]), 0
        while a < len(sizes):
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + GROUP * 64 - count, "right")) - 1)
            held.append((symbols[ends[a] - sizes[a] : ends[b - 1]], sizes[a:b]))
            count, a = count + edges[b] - edges[a], b
            if count >= GROUP * 60:
                yield np.concatenate([x for x, _ in held]), np.concatenate([n for _, n in held])
                held, count = [], 0
    if held:
        yield np.concatenate([x for x, _ in held]), np.concatenate([n for _, n in held])


def learn(tables: list[np.ndarray], texts: Iterator[tuple[np.ndarray, np.ndarray]], passes: int, done: float, share: float, seed: int) -> int:
    """Trains tables in place on every window of blocks of texts; how many targets these have. done and share: how much of all training
    lies before this, and is this. Blocks are kept if they are gone through again."""
    rng, flat, ends = np.random.default_rng(seed), np.concatenate([w.ravel() for w in tables]), np.cumsum([w.size for w in tables])
    own = [part.reshape(w.shape) for w, part in zip(tables, np.split(flat, ends[:-1]), strict=True)]
    shrinks = (flat[: ends[3]], flat[ends[4] : ends[5]])  # vectors of ids and class weights
    mean, square, grad, spare = (np.zeros_like(flat) for _ in range(4))
    kept, step, targets = [], 0, 0
    for n in range(passes):
        rate = RATE * (1 - 0.95 * (done + share * (n + 0.5) / passes))
        for block in kept if n else texts:
            if n == 0:
                targets += len(block[0])
                if passes > 1:
                    kept.append(block)
            x, y, real = windows(*block)[:3]
            for pick in np.array_split(rng.permutation(len(x)), -(-len(x) // BATCH)):
                step += 1
                np.concatenate([g.ravel() for g in gradients(own, x[pick], y[pick], real[pick])], out=grad)
                for w in shrinks:
                    w *= 1 - rate * DECAY
                _descend(flat, mean, square, grad, spare, rate, step)
    for w, part in zip(tables, own, strict=True):
        w[...] = part
    return targets


def _descend(flat: np.ndarray, mean: np.ndarray, square: np.ndarray, grad: np.ndarray, spare: np.ndarray, rate: float, step: int) -> None:
    """A step of Adam; spare is written over."""
    np.subtract(grad, mean, out=spare)
    spare *= 0.1
    mean += spare
    np.multiply(grad, grad, out=spare)
    spare -= square
    spare *= 0.01
    square += spare
    np.multiply(square, 1 / (1 - 0.99**step), out=spare)
    np.sqrt(spare, out=spare)
    spare += 1e-7
    np.divide(mean, spare, out=spare)
    spare *= rate / (1 - 0.9**step)
    flat -= spare


def _sums(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows that go to the same place: the first FEW of every place, a row of each at a time, then what more some places have."""
    at = at.ravel()
    order, count = np.argsort(at.astype(np.int16), kind="stable"), np.bincount(at, minlength=size)
    rows = rows.reshape(at.size, -1).take(order, 0)
    places = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]  # those with most rows come first
    count, first = count[places], (np.cumsum(count) - count)[places]
    more = np.searchsorted(-count, -np.arange(FEW + 1)).tolist()  # how many places have more than 0, 1, 2 .. rows
    found = rows.take(first, 0)
    for k in range(1, FEW):
        found[: more[k]] += rows.take(first[: more[k]] + k, 0)
    ones = np.ones(count[0], rows.dtype)
    for k, (a, n) in enumerate(zip(first[: more[FEW]].tolist(), count[: more[FEW]].tolist(), strict=True)):
        found[k] += ones[FEW:n] @ rows[a + FEW : a + n]
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    out[places] = found
    return out


def gradients(tables: list[np.ndarray], x: np.ndarray, y: np.ndarray, real: np.ndarray) -> list[np.ndarray]:
    """Of the mean negative log-probability of the real targets, by each table."""
    values, q, k, v, e = attend(tables, x)
    order, kind, member, bounds, hidden, both, p = _output(tables, x, y, values)
    row, rest = np.arange(len(kind)), bounds[CLASSES]
    used = real.ravel().take(order).astype(np.float32) / max(real.sum(), 1)
    np.exp(p, out=p)
    scale = used[:, None] / (p @ _PARTS.astype(p.dtype))
    scale[rest:, 1] = 0
    p[:, : CLASSES + 1] *= scale[:, :1]
    p[:, CLASSES + 1 :] *= scale[:, 1:]
    p[row, kind] -= used
    p[row[:rest], CLASSES + 1 + member[:rest]] -= used[:rest]
    back, by_class = np.empty_like(hidden), np.zeros_like(both)
    for c in range(CLASSES + 1):
        a, b = bounds[c], bounds[c + 1]
        if a < b:
            np.matmul(p[a:b], both[c].T, out=back[a:b])
            np.matmul(hidden[a:b].T, p[a:b], out=by_class[c])
    back *= hidden > 0
    last = np.empty((*y.shape, WIDTH + KEY_WIDTH), back.dtype)
    last.reshape(-1, WIDTH + KEY_WIDTH)[order, :WIDTH] = back[:, :WIDTH]
    attended = np.ascontiguousarray(last[:, :, :VALUE_WIDTH])
    d_scores = attended @ v.transpose(0, 2, 1)
    d_scores -= np.einsum("nsv,nsv->ns", attended, values)[:, :, None]
    d_scores *= e
    np.matmul(d_scores, k, out=last[:, :, WIDTH:])
    every = np.empty((*x.shape, KEY_WIDTH + VALUE_WIDTH), back.dtype)
    np.matmul(d_scores.transpose(0, 2, 1), q, out=every[:, :, :KEY_WIDTH])
    np.matmul(e.transpose(0, 2, 1), attended, out=every[:, :, KEY_WIDTH:])
    last, every = _sums(x[:, WINDOW - STRIDE :], last, len(tables[0])), _sums(x, every, len(tables[0]))
    classes, members = by_class[:, :, : CLASSES + 1].sum(0), by_class[:CLASSES, :, CLASSES + 1 :]
    return [last[:, :WIDTH], last[:, WIDTH:], every[:, :KEY_WIDTH], every[:, KEY_WIDTH:], d_scores.sum(0), classes[:WIDTH], classes[WIDTH], members[:, :WIDTH], members[:, WIDTH]]


class Lexicon:
    """Words as a model's symbols; remembers the first REMEMBERED words it meets."""

    def __init__(self, model: Model, subwords: Subwords):
        self.model, self.subwords = model, subwords
        self.slot: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 20, np.int32), 0
        self.at, self.n, self.rest = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A pool of symbols; where in it each word's begin, how many there are, and the log-probability that those in the last class
        add to the class's."""
        get, count = self.slot.get, len(self.slot)
        slots = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(slots < 0)
        at, n, rest = self.at[slots], self.n[slots], self.rest[slots]
        if not len(missing):
            return self.pool, at, n, rest
        new = [words[k] for k in missing]
        ids, sizes = self.subwords.encode(new)
        ends = np.cumsum(sizes)
        starts, end = self.used + ends - sizes, self.used + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), end - len(self.pool)), np.int32)])
        self.pool[self.used : end] = self.model.symbol[ids]
        at[missing], n[missing], rest[missing] = starts, sizes, np.add.reduceat(self.model.rest[ids], ends - sizes)
        if count + len(new) <= REMEMBERED:  # else the place after used is free again
            if count + len(new) > len(self.at):
                grow = max(len(self.at), len(new))
                self.at, self.n, self.rest = (np.concatenate([x, np.zeros(grow, x.dtype)]) for x in (self.at, self.n, self.rest))
            here = slice(count, count + len(new))
            self.at[here], self.n[here], self.rest[here] = starts, sizes, rest[missing]
            self.slot.update(zip(new, range(count, count + len(new)), strict=True))
            self.used = end
        return self.pool, at, n, rest

    def symbols(self, words: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray]:
        """Symbols of texts, given by their words and how many each has, each with its end; how many symbols each has; what its words
        add for symbols in the last class; the words as they were encoded."""
        coded = words.dictionary_encode()
        index = coded.indices.to_numpy()
        pool, at, size, rest = self.of(coded.dictionary.to_pylist())
        ends = np.cumsum(n)
        # One more place behind each text's last word, for its end.
        at, per = np.insert(at[index], ends, 0), np.insert(size[index], ends, 1)
        total = np.cumsum(per)
        source = np.repeat(at - (total - per), per)
        source += np.arange(len(source))
        last = total[ends + np.arange(len(n))] - 1 if len(n) else np.zeros(0, np.int64)  # places of the ends
        source[last] = 0
        out = pool[source]
        out[last] = self.model.symbol[self.model.end]
        row = np.repeat(np.arange(len(n)), n)
        return out, np.diff(last, prepend=-1), np.bincount(row, rest[index], len(n)) + self.model.rest[self.model.end], coded


_lexicons: dict[str, Lexicon] = {}


def worker_lexicon(name: str, model: Model, definition) -> Lexicon:
    """The worker's own, for all its tasks: of a model by its name."""
    if name not in _lexicons:
        _lexicons.clear()
        _lexicons[name] = Lexicon(model, worker_subwords(definition))
    return _lexicons[name]


def score_texts(model: Model, symbols: np.ndarray, sizes: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """log10-probability of each text from its symbols, some texts at a time, and what rest adds."""
    out, ends = rest.copy(), np.cumsum(sizes)
    edges = np.concatenate([[0], np.cumsum(-(-sizes // STRIDE))])
    a = 0
    while a < len(sizes):  # about GROUP * 64 windows of whole texts are laid out at once
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + GROUP * 64, "right")) - 1)
        x, y, real, row = windows(symbols[ends[a] - sizes[a] : ends[b - 1]], sizes[a:b])
        for i in range(0, len(x), GROUP):
            found = log_probabilities(model.tables, x[i : i + GROUP], y[i : i + GROUP]).astype(np.float64) * real[i : i + GROUP]
            np.add.at(out, a + row[i : i + GROUP], found.sum(1))
        a = b
    return out / np.log(10)


# The operator -------------------------------------------------------------------------------------------------------------


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    held_out = F.coalesce(fold("id", FOLDS) == HELD_OUT_FOLD, F.lit(False))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", held_out.alias("held_out"), "text")


def train(texts: DataFrame, model: Model, definition, symbols: int) -> int:
    """Trains model's tables on all rows of texts (id, text), which have about so many symbols; returns how many they have."""
    rounds = min(ROUNDS, max(1, symbols // TASK_SYMBOLS))
    tasks = max(1, symbols // (rounds * TASK_SYMBOLS))
    passes = _passes(symbols // rounds, tasks) if rounds == 1 else _passes(symbols, tasks)
    spark, learnt = texts.sparkSession, 0
    for k in range(rounds):
        known = spark.sparkContext.broadcast(model)

        def kernel(batches, k=k, known=known):
            net = known.value
            tables = [w.copy() for w in net.tables]

            def parts():
                lexicon = worker_lexicon(net.name, net, definition.value)
                for batch in batches:
                    for part in _parts(batch, 0, CHUNK):
                        yield lexicon.symbols(*split(part.column(0)))[:2]

            targets = learn(tables, blocks(parts()), passes, k / rounds, 1 / rounds, k)
            # Whole numbers, whose sum doesn't depend on the order of tasks.
            flat = np.rint(np.concatenate([w.ravel() for w in tables]).astype(np.float64) * FIXED).astype(np.int64) * targets
            yield pa.RecordBatch.from_arrays([pa.array([targets]), pa.array([flat.tobytes()], pa.binary())], ["targets", "tables"])

        own = texts.where(F.pmod(F.xxhash64("id", "text"), F.lit(rounds)) == k).select("text").coalesce(tasks)
        found = own.mapInArrow(kernel, "targets long, tables binary").where("targets > 0").rdd.map(lambda r: (r[0], np.frombuffer(r[1], np.int64)))
        add = lambda a, b: (a[0] + b[0], a[1] + b[1])
        targets, flat = found.treeAggregate((0, 0), add, add)
        if targets:
            learnt += targets
            ends = np.cumsum([w.size for w in model.tables])[:-1]
            mean = (flat / (targets * FIXED)).astype(np.float32)
            model.tables = [part.reshape(w.shape) for w, part in zip(model.tables, np.split(mean, ends), strict=True)]
        known.unpersist()
    return learnt


def fit_from(marked: DataFrame, counts: DataFrame, n_docs: int, tokenizer: str | None = None, pattern: str | None = None) -> tuple[Model, object]:
    """The model of all documents that are not held out, and the tokenizer's definition as a broadcast variable."""
    definition = marked.sparkSession.sparkContext.broadcast(read_ranks(tokenizer, pattern))
    ids = subword_counts(counts, definition)
    model = untrained(ids, n_docs, max(definition.value[0].values()) + 1)
    if n_docs:
        train(marked.where("not held_out").select("id", "text"), model, definition, sum(n for _, n in ids) + n_docs)
    return model, definition


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10-probabilities). tokenizer and
    pattern: a file of ranks and the pattern that goes with it."""
    spark, marked = docs.sparkSession, _marked(docs, id_col, text_col)
    counts = cut(word_counts(marked.select("held_out", "text")), "word-counts")
    sums = counts.agg(F.sum("n_train"), F.sum("n_all"), F.count(F.when(F.col("n_train") > 0, 1)), F.sum(F.when(F.col("word") == END, F.col("n_train")))).first()
    tokens, all_tokens, distinct, n_docs = (x or 0 for x in sums)
    model, definition = fit_from(marked, counts, n_docs, tokenizer, pattern)
    head = counts.where(F.col("n_all") * HEAD_SHARE >= all_tokens).toArrow()  # at most HEAD_SHARE words
    known = spark.sparkContext.broadcast((model, head.column("word").combine_chunks(), head.column("n_train").to_numpy()))

    def kernel(batches):
        net, frequent, n_frequent = known.value
        logs = np.append(np.log10(n_frequent + 1.0), 0.0)  # the last one is for words that are not frequent
        seen = np.append(n_frequent > 0, False)
        ends = pc.index_in(pa.array([END], pa.string()), value_set=frequent).fill_null(len(frequent)).to_numpy()[0]
        for batch in batches:
            for part in _parts(batch, 2, SCORE_CHUNK):
                words, n = split(part.column(2))
                symbols, sizes, rest, coded = worker_lexicon(net.name, net, definition.value).symbols(words, n)
                scores = score_texts(net, symbols, sizes, rest)
                place = pc.index_in(keys(coded.dictionary), value_set=frequent).fill_null(len(frequent)).to_numpy()
                index = coded.indices.to_numpy()
                at, row = place[index], np.repeat(np.arange(len(n)), n)
                base = np.bincount(row, logs[at], len(n)) + logs[ends]
                n_known = np.bincount(row, seen[at], len(n)).astype(np.int64) + int(seen[ends])
                # What is not frequent: each text's distinct words with their numbers, and the end where it is none itself.
                rare = np.flatnonzero(at == len(frequent))
                pairs, often = np.unique(row[rare] * len(coded.dictionary) + index[rare], return_counts=True)
                own_row, word = np.divmod(pairs, max(len(coded.dictionary), 1))
                rare_words = keys(coded.dictionary.take(pa.array(word)))
                edges = np.searchsorted(own_row, np.arange(len(n) + 1)).astype(np.int32)
                if ends == len(frequent):
                    rare_words = pa.array([w for k in range(len(n)) for w in [*rare_words[edges[k] : edges[k + 1]].to_pylist(), END]], pa.string())
                    often = np.insert(often, edges[1:], 1)
                    edges = (edges + np.arange(len(n) + 1)).astype(np.int32)
                columns = [part.column(0), part.column(1), part.column(3), pa.array(n + 1, pa.int64()), pa.array(n_known), pa.array(base), pa.array(scores),
                           pa.ListArray.from_arrays(pa.array(edges), rare_words), pa.ListArray.from_arrays(pa.array(edges), pa.array(often.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "held_out", "row", "n_tokens", "n_known", "base", "score", "words", "often"]
    kind = docs.schema[id_col].dataType.simpleString()
    numbered = marked.withColumn("row", F.monotonically_increasing_id())
    scored = cut(numbered.mapInArrow(kernel, f"id {kind}, held_out boolean, row long, n_tokens long, n_known long, base double, score double, words array<string>, often array<int>"), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "often")).alias("_w")).select("row", F.col("_w.words").alias("word"), F.col("_w.often").alias("often"))
    found = rare.join(counts.select("word", "n_train"), "word").groupBy("row").agg(
        F.sum(F.col("often") * F.log10(F.col("n_train") + 1)).alias("_base"), F.sum(F.when(F.col("n_train") > 0, F.col("often")).otherwise(0)).alias("_known"))
    whole = scored.drop("words", "often").join(found, "row", "left")
    base = F.col("base") + F.coalesce("_base", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(tokens + distinct + 1)))
    n_known = F.col("n_known") + F.coalesce("_known", F.lit(0))
    return whole.select(F.col("id").alias(id_col), "held_out", "n_tokens", n_known.alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
