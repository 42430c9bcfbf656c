"""Mixing, decontamination, sharding, joins, rules and token files against plain versions and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import decontamination, jaccard_join, language_id, mixing, quality_classifier, quality_rules, queries, sharding, token_files
from corpusmill.llm._scratch import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, _hits string, _id string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACE_WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


LONG = " ".join(f"w{k % 977}" for k in range(60_000))
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
TEXTS = [
    None, "", "   \n ", "!!!", "a", "A b C d", "A b C d", PASSAGE, PASSAGE.upper() + "!", f"x {PASSAGE} y", LONG, LONG + " end", "Ünïcödé ß 日本語 tëxt", "line\nline\nline\nother", "a b c a b c a b c",
    "  two  spaces ", "tab\tand \n newline", "don't <|endoftext|> stop",
]
LANGS = ["en", None, "fr"]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(k, t, LANGS[k % 3], [None, "s1", "s2", "s1"][k % 4], 7, 9, 0.5, "h", "i") for k, t in enumerate(TEXTS)]
    rows += [(5, TEXTS[5], "en", "s1", 7, 9, 0.5, "h", "i"), (None, "a null id with some words in it", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_mix_reaches_targets(spark, awkward, empty):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert sum(r["taken"] for r in own) == int(own[0]["target"])
        assert own[0]["target"] <= 2 * own[0]["source_size"] == 2 * sum(r["size"] for r in own)
    total = sum(r["size"] for r in rows)
    assert abs(sum({r["source"]: r["target"] for r in rows}.values()) - 1.5 * total) < 1e-6 * total
    assert sorted(map(str, mixing.mix(awkward).collect())) == sorted(map(str, rows))
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(awkward).columns == awkward.columns


def test_mix_prefers_heavy_rows(spark):
    from pyspark.sql import functions as F

    docs = spark.range(4000).selectExpr("id as doc_id", "'w w w w' as text", "concat('s', id % 2) as source", "if(id % 4 < 2, 0.1d, 1.0d) as q")
    taken = mixing.mix(docs, weights=(1.0,), share=0.3, weight=F.col("q")).join(docs.select("doc_id", "q"), "doc_id").groupBy("q").sum("taken").collect()
    light, heavy = (next(r[1] for r in taken if r[0] == q) for q in (0.1, 1.0))
    assert heavy > 4 * light


def test_source_targets_share_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes, "source", "size", (3.0, 1.0, 2.0), 1.5, 2.0).collect()}
    assert got["a"] == 20 and got[None] == 0
    assert abs(got["b"] - 2995 / 3) < 1e-6 and abs(got["c"] - 2 * 2995 / 3) < 1e-6


BENCH = [(1, PASSAGE), (2, "A b C"), (3, None), (4, ""), (5, "Ünïcödé ß"), (6, PASSAGE), (7, "?!")]


def plain_report(texts, bench):
    windows = {}
    for item, text in bench:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for t in texts:
        w, hit, items = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    items |= found
                    hit |= set(range(i, i + n))
        out.append((len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [1 << 26, 20])
def test_contamination_report(spark, awkward, empty, block, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    rows = decontamination.report(awkward, bench).collect()
    got = Counter((r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows)
    assert got == Counter(plain_report([*TEXTS, TEXTS[5], "a null id with some words in it"], BENCH))
    kept = decontamination.remove_documents(awkward, bench)
    assert kept.columns == awkward.columns
    assert kept.count() == sum(not r["contaminated"] for r in rows)
    assert decontamination.report(empty, bench).count() == 0
    assert decontamination.report(awkward, bench.limit(0)).where("contaminated").count() == 0
    cut = {r["doc_id"]: r["text"] for r in decontamination.remove_spans(awkward, bench).collect()}
    assert cut[9] == "x  y" and cut[0] is None and cut[11] == TEXTS[11] and cut[7] == ""


def test_shards(spark, awkward, empty):
    rows = sharding.assign_shards(awkward, 4).collect()
    assert len(rows) == len(TEXTS) + 2
    texts = Counter(zlib.crc32((t or "").encode()) for t in [*TEXTS, TEXTS[5], "a null id with some words in it"])
    assert Counter(r["text_crc32"] for r in rows) == texts
    order = sorted(rows, key=lambda r: r["rank"])
    assert [r["rank"] for r in order] == list(range(len(rows)))
    assert [r["shard"] for r in order] == sorted(r["shard"] for r in rows)
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in order]
    assert ids == sorted(ids)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sharding.assign_shards(empty, 4).count() == 0


def test_shard_sizes_are_near_equal(spark, sf_dir):
    rows = queries.op7_shard(spark, sf_dir).collect()
    per = Counter()
    for r in rows:
        per[r["shard"]] += r["size"]
    assert len(per) == 8 and max(per.values()) - min(per.values()) <= 2 * max(r["size"] for r in rows)


def test_written_shards(spark, awkward, tmp_path):
    docs = awkward.where("doc_id is not null").dropDuplicates(["doc_id"])
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and set(docs.columns) <= set(back.columns)
    sharding.write_shards(awkward, str(tmp_path / "all"), 4)  # null and repeated ids
    back = spark.read.parquet(str(tmp_path / "all"))
    assert sorted(map(str, back.select(*awkward.columns).collect())) == sorted(map(str, awkward.collect()))


def plain_classes(texts):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ()) for w in map(words, texts)]
    parent, links = list(range(len(texts))), [0] * len(texts)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and b and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(find(i), links[i]) for i in range(len(texts))]


def test_near_duplicates(spark, awkward, empty, monkeypatch):
    rng = np.random.default_rng(1)
    base = [f"t{k}" for k in rng.integers(0, 5000, 300)]
    texts = list(TEXTS)
    for _ in range(40):  # near copies, all different
        own = list(base)
        for p in rng.integers(0, 300, rng.integers(0, 8)):
            own[p] = f"n{rng.integers(0, 10**6)}"
        texts.append(" ".join(own))
    texts += [texts[-1]] * 3 + [" ".join(f"u{k}" for k in rng.integers(0, 10**6, 50)) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = plain_classes(texts)
    for bucket, block in ((4096, 1500), (8, 7)):  # whole buckets, and buckets and clusters dealt into blocks
        monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", bucket)
        monkeypatch.setattr(jaccard_join, "TEXT_BLOCK", block)
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(docs).collect()}
        assert [got[k] for k in range(len(texts))] == want
    kept = jaccard_join.keep_one(docs)
    assert {r["doc_id"] for r in kept.collect()} == {c for c, _ in want}
    assert jaccard_join.near_duplicates(empty).count() == 0
    once = jaccard_join.keep_one(awkward)
    assert once.columns == awkward.columns and once.where("doc_id = 5").count() == 1 and once.where("doc_id = 6").count() == 0


def test_posterior_keeps_likely_pairs():
    least = jaccard_join.least_matches()
    assert len(least) == 8 and all(a <= b for a, b in zip(least, least[1:], strict=False))
    assert 64 < least[-1] < 0.8 * 128


def plain_figures(text):
    text = text or ""
    w = SPACE_WORD.findall(text)
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {p for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_quality_rules(spark, awkward, empty):
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rows = quality_rules.apply_rules(awkward, labels).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = Counter(tuple(r[c] for c in names) for r in rows)
    assert got == Counter(plain_figures(t) for t in [*TEXTS, TEXTS[5], "a null id with some words in it"])
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.apply_rules(empty, labels).count() == 0


def test_binomial_bound(spark):
    from math import comb, log

    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0, 10), (3, 85), (20, 400)], "k long, n long").select("k", "n", quality_rules.log_binomial_cdf(F.col("k"), F.col("n"), 0.05).alias("p")).collect()
    for r in rows:
        assert abs(r["p"] - log(sum(comb(r["n"], i) * 0.05**i * 0.95 ** (r["n"] - i) for i in range(r["k"] + 1)))) < 1e-9


def test_cutoffs_are_safe(spark):
    rows = [("a", True, 9)] * 900 + [("a", True, 4)] * 10 + [("a", True, 2)] * 5 + [("b", True, 0)] * 30 + [("a", False, 0)] * 50
    got = {r["s"]: r["rung"] for r in quality_rules.choose_cutoffs(spark.createDataFrame(rows, "s string, good boolean, first int"), "s", "good").collect()}
    assert got == {"a": 8, "b": -1}


def test_token_files(spark, awkward, empty, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    tokenizer.encode_special_tokens = True
    path = str(tmp_path / "orc")
    token_files.write_tokens(awkward, path)
    want = Counter()
    for t in [*TEXTS, TEXTS[5], "a null id with some words in it"]:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want[len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    rows = sorted(token_files.describe_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert Counter((r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:k]) for k in range(len(rows))]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert ids == sorted(ids)
    one = token_files.read_tokens(spark, path, [7]).collect()
    assert len(one) == 1 and one[0]["ids"] == [*tokenizer.encode(PASSAGE).ids, 0]
    token_files.write_tokens(empty, str(tmp_path / "none"))
    assert token_files.describe_tokens(spark, str(tmp_path / "none")).count() == 0


def test_buckets_with_equal_small_sums_are_told_apart(spark):
    from pyspark.sql import functions as F

    keys = [hashlib.md5(str(k).encode()).digest() for k in range(5000)]
    small = spark.createDataFrame([(k,) for k in keys], "key binary").select("key", F.pmod(F.xxhash64("key"), F.lit(1 << 40)).alias("h")).collect()
    h, names = np.array([r["h"] for r in small]), [bytes(r["key"]) for r in small]
    i, j = np.triu_indices(len(h), 1)
    sums = h[i] + h[j]
    order = np.argsort(sums)
    at = next(k for k in np.flatnonzero(np.diff(sums[order]) == 0) if len({i[order[k]], j[order[k]], i[order[k + 1]], j[order[k + 1]]}) == 4)
    pairs = [(names[i[order[k]]], names[j[order[k]]]) for k in (at, at + 1)]
    reps = spark.createDataFrame([(x, bytes([n + 1]) * 512) for n, p in enumerate(pairs) for x in p], "key binary, sign binary")
    got = {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in jaccard_join._candidate_edges(reps).collect()}
    assert got == {frozenset(p) for p in pairs}


def test_token_query_equals_the_plain_call(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    end = "<|endoftext|>"
    texts = ["before it", f"don't {end} stop", end, f"a{end}b{end}", f"{end} two  spaces", "<|endoftext|", ">half", f"{end[:5]} {end[5:]}", *TEXTS]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op10_token_files(spark, str(tmp_path)).collect()
    start = 0
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = [*tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), r
        start += len(ids)
    assert len(rows) == len(texts)


def test_small_piece_table_encodes_alike():
    import pyarrow as pa

    from corpusmill.llm._words import buffers

    definition = open(token_files.default_tokenizer(), encoding="utf-8").read()
    data, edges = buffers(pa.array([t or "" for t in TEXTS]))
    big, small = token_files.Encoder(definition), token_files.Encoder(definition, slots=16)
    for _ in range(2):
        a, b = big.encode(data, edges), small.encode(data, edges)
        assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


def test_language_id(spark, sf_dir, awkward, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language_id.identify(docs).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(lang[r["doc_id"]] == r["lang_pred"] for r in held) > 0.97 * len(held)
    odd = language_id.identify(awkward).collect()
    assert len(odd) == len(TEXTS) + 2
    assert {r["lang_pred"] for r in odd if r["doc_id"] in (0, 1, 2, 3)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in odd)
    assert language_id.identify(empty).count() == 0


def test_quality_classifier(spark, awkward, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality_classifier.classify(docs, labels).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in quality]
    assert sum(quality[r["doc_id"]] == r["predicted"] for r in held) > 0.95 * len(held)
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    odd = quality_classifier.classify(awkward, labels.limit(0)).collect()
    assert {r["score"] for r in odd} == {0.5}
    assert quality_classifier.classify(empty, labels).count() == 0
    assert quality_classifier.keep_good(awkward, labels).columns == awkward.columns


def test_language_scores_equal_a_direct_convolution():
    rng = np.random.default_rng(2)
    words_of = {"x": ["abra", "kadi", "bram"], "y": ["zopf", "quex", "zuq"]}
    model = language_id.fit([(" ".join(rng.choice(words_of[lang], 80)), lang) for lang in ("x", "y") for _ in range(8)])
    windows = np.stack([np.frombuffer((" ".join(rng.choice(words_of[lang], 80)).encode() + bytes(256))[:256], np.uint8) for lang in ("x", "y", "x")])
    got = language_id.log_probabilities(model, model.tables(), windows)
    for window, logs in zip(windows, got, strict=True):
        pooled = []
        for width, filters in model.filters.items():
            responses = [sum(filters[j, window[i + j]] for j in range(width)) for i in range(256 - width + 1)]
            pooled.append(np.max(responses, 0))
        hidden = np.maximum(np.concatenate(pooled) + model.bias, 0)
        logits = hidden @ model.dense + model.shift
        assert np.allclose(logs, logits - np.log(np.exp(logits).sum()), atol=1e-4)
    assert [model.languages[k] for k in got.argmax(1)] == ["x", "y", "x"]


def test_language_windows_cover_whole_texts():
    import pyarrow as pa

    from corpusmill.llm._words import buffers

    data, at = buffers(pa.array(["A" * 600, "", "b" * 256]))
    windows, row, used = language_id.cut_windows(data, at, 0, 3)
    assert row.tolist() == [0, 0, 0, 2] and used.tolist() == [256, 256, 88, 256]
    assert windows[0].tobytes() == b"a" * 256 and windows[2].tobytes() == b"a" * 88 + bytes(168)


def test_dual_descent_finds_the_hinge_minimum():
    """Against subgradient descent on the primal over a small table of indicators."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 12, 5)) for _ in range(60)]
    y = np.array([1.0 if 3 in r or rng.random() < 0.2 else -1.0 for r in rows])
    ratio = np.zeros(quality_classifier.WIDTH)
    ratio[:12] = rng.normal(0, 1, 12)
    x = np.zeros((60, 13))
    for i, r in enumerate(rows):
        x[i, r], x[i, 12] = ratio[r] / np.sqrt(len(r)), 1
    cost = lambda w: 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w)).sum()
    w = quality_classifier.dual_descent(rows, ratio, y, 1.0, 400)
    found = np.append(w[:12], w[-1])
    plain = best = np.zeros(13)
    for step in range(1, 20_000):
        active = y * (x @ plain) < 1
        plain = plain - (plain - (x[active] * y[active, None]).sum(0)) / (10 + step)
        best = min(best, plain, key=cost)
    assert cost(found) <= cost(best) + 1e-3


def test_quality_features_equal_a_plain_reading():
    """Word n-grams of a text are found wherever it stands, and a score is the bias and the mean weight of its indicators."""
    import pyarrow as pa

    texts = [None, "", "one two three", "zero one two three", LONG, "one two three"]
    found = [set(ids.tolist()) for ids in quality_classifier.feature_rows(pa.array(texts))]
    assert found[0] == found[1] == set() and found[2] == found[5] and len(found[2] - found[3]) < len(found[2]) / 2
    weight = np.random.default_rng(1).normal(0, 1, quality_classifier.WIDTH)
    model = quality_classifier.Model(weight, 0.25, 1.5, -0.5)
    want = [1 / (1 + np.exp(-(1.5 * (0.25 + weight[sorted(f)].sum() / np.sqrt(max(1, len(f)))) - 0.5))) for f in found]
    assert np.allclose(model.scores(pa.array(texts)), want)


def test_fitted_scores_of_awkward_rows(spark, awkward):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.fit_from(docs, labels)
    rows = quality_classifier.add_scores(awkward, model).collect()
    assert len(rows) == len(TEXTS) + 2 and all(0 <= r["score"] <= 1 for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())


def test_samples_pass_over_long_and_repeated_rows(spark):
    from corpusmill.llm._fit import sample

    rows = [(7, "same text", "a")] * 3000 + [(k, "x" * 5000 if k % 7 == 0 else f"text {k}", "a") for k in range(300)] + [(k, f"other {k}", "b") for k in range(300, 340)]
    got = sample(spark.createDataFrame(rows, "_key long, _text string, _label string"), 50, 2000)
    labels = Counter(label for _, label in got)
    assert labels["a"] == 50 and labels["b"] == 40 and all(len(t) < 2000 for t, _ in got) and len(got) == len(set(got))


def test_tiled_links_equal_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    sets = []
    for _ in range(70):
        own = base.copy() if rng.random() < 0.7 else rng.integers(0, 1 << 62, 60, dtype=np.uint64)
        own[rng.integers(0, 60, rng.integers(0, 8))] = rng.integers(0, 1 << 62, dtype=np.uint64)
        own = np.unique(own)
        sets.append((own, own ^ np.uint64(77)))
    sets.append((sets[0][0], sets[0][1] ^ np.uint64(1)))  # equal in the first hash alone
    names, copies = [f"{k:03}".encode() for k in range(71)], list(range(1, 72))
    whole = [set(zip(a.tolist(), b.tolist(), strict=True)) for a, b in sets]
    link = np.array([[i != j and len(x & y) >= 0.8 * len(x | y) for j, y in enumerate(whole)] for i, x in enumerate(whole)])
    texts, rows, parent = Counter(), Counter(), list(range(71))
    for tile in (3, 1500):
        jaccard_join.TILE_TEXTS, kept = tile, jaccard_join.TILE_TEXTS
        try:
            one, two = jaccard_join.Held(names[:40], copies[:40], sets[:40], 0.8), jaccard_join.Held(names[40:], copies[40:], sets[40:], 0.8)
            one.among()
            two.among()
            told = [one.result(), two.result()]
            one = jaccard_join.Held(names[:40], copies[:40], sets[:40], 0.8)
            for k in range(40, 71, 9):
                told.append(one.against(names[k : k + 9][: 71 - k], copies[k : k + 9], sets[k : k + 9]))
            told.append(one.result())
        finally:
            jaccard_join.TILE_TEXTS = kept
        texts.clear()
        rows.clear()
        parent = {k: k for k in names}

        def top(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for keys, roots, n, m in told:
            for k, r, a, b in zip(keys, roots, n, m, strict=True):
                texts[k] += int(a)
                rows[k] += int(b)
                a, b = top(k), top(r)
                parent[max(a, b)] = min(a, b)
        assert [texts[k] for k in names] == link.sum(1).tolist()
        assert [rows[k] for k in names] == (link @ np.array(copies)).tolist()
        reach = link | np.eye(71, dtype=bool)
        for _ in range(7):
            reach = reach @ reach
        assert all((top(names[i]) == top(names[j])) == reach[i, j] for i in range(71) for j in range(71))


def test_pieces_with_equal_hashes_are_told_apart(monkeypatch):
    import pyarrow as pa

    from corpusmill.llm._words import buffers

    definition = open(token_files.default_tokenizer(), encoding="utf-8").read()
    texts = ["alpha beta gamma", "beta alpha, beta", "a-rather-long-piece-of-text-here a-rather-long-piece-of-text-hers x", *[t or "" for t in TEXTS if t != LONG]]
    data, edges = buffers(pa.array(texts))
    right = token_files.Encoder(definition)
    want = right.encode(data, edges)
    monkeypatch.setattr(token_files, "mix64", lambda x: x * np.uint64(0) + np.uint64(5))  # every piece has the same hash
    for _ in range(2):
        poor = token_files.Encoder(definition)
        for _ in range(2):
            got = poor.encode(data, edges)
            assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_token_files_are_indexed(spark, tmp_path):
    """Stripes, row index and Bloom filters are in the files, and a read of one id skips row groups."""
    path = str(tmp_path / "orc")
    docs = spark.range(20_000).selectExpr("id * 2 as doc_id", "concat('some words of text ', id, ' ', id % 97) as text")
    token_files.write_tokens(docs, path, files=1)
    file = next(str(p) for p in (tmp_path / "orc").glob("*.orc"))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == token_files.ROW_INDEX_STRIDE and reader.getNumberOfRows() == 20_000
    records = reader.rows()
    kinds = {(s.getColumn(), str(s.getKind())) for s in records.readStripeFooter(reader.getStripes()[0]).getStreamsList()}
    names = list(reader.getSchema().getFieldNames())
    column = 1 + names.index("doc_id")
    assert {(column, "ROW_INDEX"), (column, "BLOOM_FILTER_UTF8")} <= kinds
    records.close()
    found = token_files.read_tokens(spark, path, [7776])
    assert [r["doc_id"] for r in found.collect()] == [7776] and token_files.read_tokens(spark, path, [7777]).count() == 0
    plan = found._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() <= token_files.ROW_INDEX_STRIDE


def test_repeated_and_long_rows_get_equal_languages(spark, awkward):
    model = language_id.fit([("the and of to in that is was he for it with as " * 4, "en"), ("und der die das nicht ein ich ist mit sich auf " * 4, "de")])
    by_text = {}
    for r in language_id.add_language(awkward, model).collect():
        by_text.setdefault(r["text"], set()).add((r["lang_pred"], r["score"]))
    assert all(len(found) == 1 for found in by_text.values()) and by_text[None] == {("und", 0.0)} and len(by_text) == len(set(TEXTS)) + 1
