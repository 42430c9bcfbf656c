"""Fill-in-middle against plain Python, and on awkward rows."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import fill_in_middle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, form string, row string, id string, _d string"
REST = ("en", "s", 7, 9, "f", "r", "i", "d")
UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
LONG = "".join(f"w{k % 977} \U0001f600,," for k in range(40_000))
TEXTS = [None, "", "a", "  ", "one two", "x" * 5000, "é" * 700, "\U0001f600 a\U0001f600b", "has <P> in it", "ends with <", "P> S> M> <<P", "<M", "line\nline\r\n\ttab", "." * 64, "." * 65, "a." * 64, LONG]


def plain_version(doc_id, text):
    text = text or ""
    units, digits = UNIT.findall(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.fixture(scope="module")
def rows():
    out = [(k, t) for k, t in enumerate(TEXTS * 9)]
    return out + [(4, "one two"), (4, "one two"), (4, "other"), (None, "no id here"), (None, "no id here"), (None, None)]


def test_fill_in_middle_equals_plain_version(spark, rows):
    docs = spark.createDataFrame([(*r, *REST) for r in rows], DOCS).repartition(3)
    made = fill_in_middle.fill_in_middle(docs)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = made.withColumn("again", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r)[:6] for r in found) == Counter(plain_version(*r) for r in rows)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    texts = Counter((i, t or "") for i, t in rows)
    assert Counter((r["doc_id"], r["again"]) for r in found) == texts


def test_fill_in_middle_of_nothing(spark):
    assert fill_in_middle.fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0


def test_fill_in_middle_shuffles_texts_once(spark, sf_dir):
    made = fill_in_middle.fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert len(re.findall(r"ShuffleQueryStage (?=\d+)", final)) - final.count("ReusedExchange") <= 1


def test_shares_of_forms_are_parameters(spark):
    docs = spark.createDataFrame([(k, "some words here") for k in range(300)], "doc_id long, text string")
    assert {r[0] for r in fill_in_middle.fill_in_middle(docs, plain_share=0, spm_share=100).select("form").collect()} == {"spm"}
    assert {r[0] for r in fill_in_middle.fill_in_middle(docs, plain_share=100).select("form").collect()} == {"plain"}
