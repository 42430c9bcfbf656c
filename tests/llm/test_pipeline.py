"""The pipeline's stages against brute force on a small table, and on awkward rows."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from test_documents import DOCS, PASSAGE, SPACE_WORD, TEXTS, plain_classes, plain_report

import corpus_pipeline
from corpusmill.llm import mixing, quality_classifier

SF = "/root/testdata/sf0.001"


def plain_mix(rows, weight):
    """Copies of (doc_id, text, source) rows by the mix, from its definition."""
    sizes, own = Counter(), []
    for doc_id, text, source in rows:
        n = len(SPACE_WORD.findall(text or ""))
        sizes[source] += n
        u = (int(hashlib.md5(f"17:{'' if doc_id is None else doc_id}:{text or ''}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
        own.append((-math.log(u) / weight(text), doc_id, source, n))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights, left, target = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()), {}
    while open_ := [s for s in names if s not in target]:
        level = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if level * weights[s] > 2 * sizes[s]]
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else level * weights[s]
        left -= sum(target[s] for s in full)
    copies = Counter()
    for s in names:
        passes = int(target[s] // sizes[s]) if sizes[s] else 0
        room = math.floor(target[s] - passes * sizes[s])
        for _, doc_id, _, n in sorted(x for x in own if x[2] == s):
            copies[doc_id] += passes + (n > 0 and 2 * room > n)
            room -= n
    return Counter({k: c for k, c in copies.items() if c})


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = quality_classifier.fit_from(docs, labels)
    import pyarrow as pa

    score = lambda text: float(model.scores(pa.array([text], pa.string()))[0])
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = sorted(k for k, r in rows.items() if score(r["text"]) >= 0.7)
    kept = [good[c] for c in sorted({c for c, _ in plain_classes([rows[k]["text"] for k in good])})]
    clean = [k for k, r in zip(kept, plain_report([rows[k]["text"] for k in kept], bench), strict=True) if not r[-1]]
    assert len(good) < len(rows) and len(kept) < len(good) and len(clean) < len(kept)
    copies = plain_mix([(k, rows[k]["text"], rows[k]["source"]) for k in clean], lambda t: max(0.01, score(t)))
    order = sorted((k, len(rows[k]["text"].encode()) + 1, zlib.crc32(rows[k]["text"].encode())) for k, c in copies.items() for _ in range(c))
    total, before, want, slots = sum(s for _, s, _ in order), 0, [], Counter()
    for k, s, crc in order:
        shard = min(7, (2 * before + s) * 8 // (2 * total))
        want.append((k, s, crc, "bytes", shard, slots[shard]))
        slots[shard] += 1
        before += s
    got = corpus_pipeline.run(spark, SF)
    assert sorted(tuple(r[c] for c in ("doc_id", "size", "text_crc32", "law", "shard", "slot")) for r in got.collect()) == sorted(want)


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    near = " ".join(f"n{k}" for k in range(200))
    rows = [(k, t, "en", ["a", None, "b"][k % 3], 1, 1, 0.5, "h", "i") for k, t in enumerate([*TEXTS, near, near + " more", PASSAGE + " and more words that are its own"])]
    rows += [rows[5], rows[7], (None, near, None, None, None, None, None, None, None), (None, "alone with no id", None, "a", None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k != 8)) for k in range(21)] + [(None, None)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_on_awkward_rows(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd_dir)
        assert out.columns == docs.columns, name
        out.collect()
    ids = lambda df: Counter(r["doc_id"] for r in df.collect())
    once = ids(corpus_pipeline.near_duplicates(spark, docs, odd_dir))
    assert once[5] == 1 and 6 not in once and once[18] + once[19] + once[None] >= 2 and 19 not in once and once[0] == 1
    clean = ids(corpus_pipeline.decontaminate(spark, docs, odd_dir))
    assert not {7, 8, 9, 20} & set(clean) and clean[None] == 3 and clean[5] == 2
    shards = corpus_pipeline.shard(spark, docs, odd_dir)
    assert shards.count() == docs.count()
    corpus_pipeline.run(spark, odd_dir).collect()


def test_pipeline_on_empty_documents(spark, odd_dir, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{odd_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_share_their_copies(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 5 + [(None, "x y", "s")] * 3 + [(2, "c d", "s"), (2, "e f g", "s")], "doc_id long, text string, source string")
    picked = mixing.mix(docs, boundary="nearest")
    got = Counter((r["doc_id"], r["text"]) for r in mixing.mixed_documents(docs).collect())
    rows = picked.collect()
    assert sum(got.values()) == sum(r["copies"] for r in rows)
    assert got[1, "a b c"] == sum(r["copies"] for r in rows if r["doc_id"] == 1)
    assert got[None, "x y"] == sum(r["copies"] for r in rows if r["doc_id"] is None)
