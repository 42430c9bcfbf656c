"""The Merkle manifest against trees built in one piece, for groups and ranges of many sizes."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import merkle_manifest as m

DOCS = "doc_id long, source string, lang string, n_chars long, text string, root string, leaf string, `group` string, id string, salt long"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row)


def tree(nodes):
    """The root, and for each leaf its steps."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            a = i - i % 3
            steps[k].append((i - a, "".join(nodes[a:i] + nodes[i + 1 : a + 3])))
            at[k] = i // 3
        nodes = [digest(nodes[a : a + 3]) for a in range(0, len(nodes), 3)]
    return nodes[0], steps


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0], leaf_of(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = []
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        own.append(tree([h for _, h in groups[g]]))
    root, above = tree([x[0] for x in own])
    out = []
    for g, (subroot, steps), more in zip(order, own, above, strict=True):
        for (key, leaf), own_steps in zip(groups[g], steps, strict=True):
            out.append((key, g, leaf, subroot, root, tuple(own_steps + more)))
    return out


def made(df):
    return [(r["doc_id"], r["source"], r["leaf"], r["subroot"], r["root"], tuple(map(tuple, r["proof"]))) for r in df.collect()]


CASES = {
    "one row": [(1, "a")],
    "one group": [(k, "a") for k in range(200)],
    "a hot group and small ones": [(k, ["a", "hot", None, "b\u00e9", "", "z"][0 if k < 3 else 1 if k < 700 else 2 + k % 4]) for k in range(760)],
    "many groups": [(k, f"g{k:03d}") for k in range(300)],
    "groups of two": [(k, f"g{k // 2:03d}") for k in range(150)],
    "ids null or repeated": [(None if k % 5 == 0 else k % 7, "a" if k < 90 else None) for k in range(120)],
}


@pytest.mark.parametrize(("name", "ranges"), [*[(n, 25) for n in CASES], ("a hot group and small ones", 1), ("a hot group and small ones", 4), ("groups of two", 3), ("many groups", 6), ("ids null or repeated", 2)])
def test_manifest_equals_trees_in_one_piece(spark, name, ranges):
    rows = [(key, g, None if k % 3 else "en", k % 11, None if k % 9 == 4 else f"text {k % 13}\n") for k, (key, g) in enumerate(CASES[name])]
    docs = spark.createDataFrame([(*r, "x", "y", "z", "i", 1) for r in rows], DOCS).repartition(3)
    found = made(m.manifest(docs, ranges=ranges))
    assert Counter(found) == Counter(plain_manifest(rows))


def test_small_spread_takes_more_rounds(spark, monkeypatch):
    monkeypatch.setattr(m, "SPREAD", 3)
    rows = [(k, "a" if k % 10 else "b", "en", 1, str(k)) for k in range(300)]
    docs = spark.createDataFrame([(*r, "x", "y", "z", "i", 1) for r in rows], DOCS)
    assert Counter(made(m.manifest(docs, ranges=20))) == Counter(plain_manifest(rows))


def test_proofs_tell_changed_rows(spark):
    rows = [(k, f"s{k % 4}", "en", 1, f"a\n{k}" if k % 2 else f"b{k}") for k in range(50)]
    docs = spark.createDataFrame([(*r, "x", "y", "z", "i", 1) for r in rows], DOCS)
    changed = m.leaf_digest(*[F.col(c) for c in m.COLUMNS[:-1]], F.translate("text", "\n", ""))
    out = m.manifest(docs, carry={"changed": changed}).select("doc_id", (m.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("whole"), (m.folded(F.col("changed"), F.col("proof")) == F.col("root")).alias("same"))
    for r in out.collect():
        assert r["whole"] and r["same"] == (r["doc_id"] % 2 == 0)


def test_manifest_of_nothing(spark):
    out = m.manifest(spark.createDataFrame([], DOCS))
    assert out.count() == 0 and out.columns[:3] == ["doc_id", "source", "leaf"]


def test_equal_rows_and_long_texts(spark):
    rows = [(7, "a", "en", 1, "same")] * 60 + [(8, "a", "en", 1, "long " * 200_000)]
    docs = spark.createDataFrame([(*r, "x", "y", "z", "i", 1) for r in rows], DOCS).repartition(4)
    assert Counter(made(m.manifest(docs, ranges=5))) == Counter(plain_manifest(rows))
