"""The attention model against its definition, one position at a time; base scores against plain counts; held-out texts."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusmill.llm import language_model as m
from corpusmill.llm.token_files import default_tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, held_out string, row string, score string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), m.END]


def held(key):
    return key is not None and zlib.crc32(str(key).encode()) % 7 == 2


def plain_scores(rows):
    counts = Counter(t for key, text in rows if not held(key) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    return [(key, held(key), len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), total, sum(np.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens(x))) for key, x in rows]


@pytest.fixture(scope="module")
def subwords():
    return m.Subwords(*m.read_ranks()[:2])


@pytest.fixture(scope="module")
def model(subwords):
    texts = ["the cat sat on the mat", "a dog and a cat", "the end of the day " * 9]
    ids = Counter(subwords.encode(" ".join(texts).split())[0].tolist())
    steps, m.STEPS = m.STEPS, 60
    made = m.fit(texts, list(ids.items()), len(texts), subwords)
    m.STEPS = steps
    return made


def slow_log_probability(tables, symbols, i, target):
    """Of symbol target at place i of a text, by the definition: all in float64, one position."""
    own, query, key, value, distance, weights, bias, member_weights, member_bias = (t.astype(np.float64) for t in tables)
    inputs = [m.START, *symbols]
    s = i % m.STRIDE  # place in its window
    seen = [inputs[k] if k >= 0 else m.START for k in range(i - s - (m.WINDOW - m.STRIDE), i + 1)]
    e = np.exp([query[inputs[i]] @ key[x] + distance[s, j] for j, x in enumerate(seen)])
    hidden = np.maximum(own[inputs[i]] + np.pad((e / e.sum()) @ value[seen], (0, m.WIDTH - m.VALUE_WIDTH)), 0)
    logits = hidden @ weights + bias
    kind, member = divmod(target, m.MEMBERS)
    out = logits[kind] - np.log(np.exp(logits).sum())
    if kind < m.CLASSES:
        logits = hidden @ member_weights[kind] + member_bias[kind]
        out += logits[member] - np.log(np.exp(logits).sum())
    return out


def test_windows_score_each_id_once_as_the_definition_says(model, subwords):
    texts = ["", "the cat", None, "the dog sat on a mat and the day \u00e9nd zxq " * 6, "cat"]
    symbols, sizes, rest, _ = m.Lexicon(model, subwords).symbols(*m.split(pa.array(texts, pa.string())))
    found, at = m.score_texts(model, symbols, sizes, rest), 0
    for k, size in enumerate(sizes):
        own = symbols[at : at + size]
        slow = sum(slow_log_probability(model.tables, own, i, own[i]) for i in range(size)) + rest[k]
        assert found[k] == pytest.approx(slow / np.log(10), rel=1e-4)
        at += size
    assert sizes[0] == sizes[2] == 1 and found[0] == pytest.approx(found[2], rel=1e-5)


def test_ids_are_those_of_the_public_tokenizer(subwords):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_tokenizer())
    plain.encode_special_tokens = True
    words = ["the", "and,", "zxq", "d'accord", "'s", "\u00c9nd", "a\u2003b", "\u00a0x", "12.5", "<|endoftext|>", "\u65e5\u672c", "x" * 300] * 3
    ids, sizes = subwords.encode(words)
    want = [plain.encode(f" {w}", add_special_tokens=False).ids for w in words]
    assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]


def test_words_beyond_memory_are_encoded_again(model, subwords, monkeypatch):
    texts = pa.array(["one two three four five", "five four three two one", "one six"], pa.string())
    want = m.Lexicon(model, subwords).symbols(*m.split(texts))
    monkeypatch.setattr(m, "REMEMBERED", 2)
    small = m.Lexicon(model, subwords)
    for k in range(3):
        got = small.symbols(*m.split(texts[k : k + 1]))
        first = int(want[1][:k].sum())
        assert got[0].tolist() == want[0][first : first + want[1][k]].tolist() and got[2][0] == pytest.approx(want[2][k])
    assert len(small.slot) <= 2


def test_probabilities_of_what_can_follow_add_up(model):
    symbols = [3, 5, m.OTHER, 7]
    total = sum(np.exp(slow_log_probability(model.tables, symbols, 4, t)) for t in range(m.OTHER + 1))
    assert total == pytest.approx(1, abs=1e-6)
    others = model.symbol == m.OTHER
    assert np.exp(model.rest[others]).sum() == pytest.approx(1, abs=1e-6) and not model.rest[~others].any()


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    shapes = [(m.OTHER + 2, m.WIDTH), (m.OTHER + 2, m.KEY_WIDTH), (m.OTHER + 2, m.KEY_WIDTH), (m.OTHER + 2, m.VALUE_WIDTH), (m.STRIDE, m.WINDOW), (m.WIDTH, m.CLASSES + 1), (m.CLASSES + 1,),
              (m.CLASSES, m.WIDTH, m.MEMBERS), (m.CLASSES, m.MEMBERS)]
    tables = [rng.normal(0, 0.3, s) for s in shapes]
    x, y = rng.integers(0, 6, (3, m.WINDOW)), rng.integers(0, 6, (3, m.STRIDE))
    real = rng.random(y.shape) < 0.8
    loss = lambda: -(m.log_probabilities(tables, x, y) * real).sum() / real.sum()
    grads = m.gradients(tables, x, y, real)
    for table, g in zip(tables, grads, strict=True):
        for at in np.argsort(-np.abs(g).ravel())[:4]:
            old, step = table.flat[at], 1e-4
            table.flat[at] = old + step
            up = loss()
            table.flat[at] = old - step
            assert (up - loss()) / (2 * step) == pytest.approx(g.flat[at], rel=2e-3, abs=1e-6)
            table.flat[at] = old


def test_all_classes_go_through_one_exponential(model, monkeypatch):
    rng, calls, exp = np.random.default_rng(1), [], np.exp
    x, y = rng.integers(0, m.OTHER + 2, (40, m.WINDOW)), rng.integers(0, m.OTHER + 1, (40, m.STRIDE))
    monkeypatch.setattr(np, "exp", lambda *a, **b: calls.append(1) or exp(*a, **b))
    m.log_probabilities(model.tables, x, y)
    assert len(calls) <= 2  # of attention and of the logits
    m.gradients(model.tables, x, y, np.ones(y.shape, bool))
    assert len(calls) <= 4


def test_sums_of_rows_of_few_and_of_many():
    rng = np.random.default_rng(2)
    at = rng.permutation(np.repeat([0, 3, 4, 5, 8, 9], [500, m.FEW, m.FEW + 1, m.FEW - 1, 1, 40]))
    rows, want = rng.normal(size=(len(at), 5)), np.zeros((10, 5))
    np.add.at(want, at, rows)
    assert np.allclose(m._sums(at, rows, 10), want, rtol=1e-12) and not want[[1, 2, 6, 7]].any()
    assert np.allclose(m._sums(at[:1], rows[:1], 10)[at[0]], rows[0])


@pytest.mark.parametrize("share", [m.HEAD_SHARE, 20, 1])
def test_base_scores_equal_plain_counts(spark, monkeypatch, share):
    monkeypatch.setattr(m, "HEAD_SHARE", share)
    monkeypatch.setattr(m, "STEPS", 5)
    texts = [None, "", " \n ", "a", "A a B", "the \u00c9nd \u2003 of\tit\x0b.", "x" * 300, "X" * 300 + " y", "word " * 3000, "one two three", "one two three", " lead and trail "]
    rows = [(k, f"{t} w{k % 9}" if t and k % 3 else t) for k, t in enumerate(texts * 8)] + [(5, "repeated id"), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame([(*r, "en", "s", 1, 2, "h", "r", "z") for r in rows], DOCS).repartition(3)
    found = m.score(docs).collect()
    want = plain_scores(rows)
    assert Counter(tuple(r)[:5] for r in found) == Counter(r[:5] for r in want)
    order = lambda r: (r[0] is None, r[0] or 0, round(r[5], 6))
    for a, b in zip(sorted(map(tuple, found), key=order), sorted(want, key=order), strict=True):
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] < 0
    again = m.score(docs).collect()
    assert Counter(tuple(r)[:5] for r in again) == Counter(tuple(r)[:5] for r in found)
    assert sum(r["score"] for r in again) == pytest.approx(sum(r["score"] for r in found), rel=1e-6)


def test_scores_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(m, "STEPS", 5)
    assert m.score(spark.createDataFrame([], DOCS)).count() == 0


def test_held_out_texts_are_likelier_than_by_words_alone(spark, sf_dir):
    rows = [r for r in m.score(spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")).collect() if r["held_out"]]
    assert len(rows) > 100
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    # Half of them at this size, give or take what rounding makes of training; four in five on ten times as many documents.
    assert np.mean([r["score"] > r["base_score"] for r in rows]) > 0.4


@pytest.mark.parametrize("share", [1, 7])
def test_the_model_learns_from_every_training_text(spark, monkeypatch, share):
    rows = [(k, f"text {k} of many" if k % 5 else None) for k in range(6000)] + [(None, "word " * 70_000)] * 2
    docs = m._marked(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "doc_id", "text")
    seen, train = [], m.train
    monkeypatch.setattr(m, "STEPS", 1)
    monkeypatch.setattr(m, "TASK_SYMBOLS", 160_000 // share)
    monkeypatch.setattr(m, "train", lambda *a: seen.append((train(*a), a[3])))
    counts = m.word_counts(docs.select("held_out", "text"))
    n_docs = sum(not held(key) for key, _ in rows)
    model, definition = m.fit_from(docs, counts, n_docs)
    words = Counter(t for key, text in rows if not held(key) for t in tokens(text) if t)
    pieces = m.Subwords(*definition.value[:2]).encode(list(words))[1]
    every = int((pieces * np.array(list(words.values()))).sum()) + n_docs
    assert seen == [(every, every)]
    assert all(np.isfinite(w).all() for w in model.tables) and model.tables[4].any()
