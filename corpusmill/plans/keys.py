"""Queries on keys: hashes, splits, samples, duplicates, work lists and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import hashing as H
from corpusmill.functions import kernels
from corpusmill.functions import text as X
from corpusmill.operators import dedup, joins, windows
from corpusmill.plans.catalog import Tables, query

_H8 = "CAST('0x' || substr(sha1({}), 1, 8) AS BIGINT)"
_NORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ')"


@query("AGG-03 MTH-02", f"""
    WITH d AS (SELECT doc_id, sha256({_NORM}) AS h FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keeper, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY h) THEN 'ok' ELSE 'duplicate' END AS status FROM d""")
def exact_dup_verdict(t: Tables) -> DataFrame:
    digests = t.documents.select("doc_id", F.sha2(X.normalised(F.col("text")).cast("binary"), 256).alias("digest"))
    return dedup.exact_duplicates(digests, F.col("digest"), "doc_id").select("doc_id", "keeper", "status")


@query("AGG-11", f"""
    SELECT md5({_NORM}) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, key DESC LIMIT 3""")
def dup_collapse_top(t: Tables) -> DataFrame:
    return dedup.collapse(t.documents, F.md5(X.normalised(F.col("text")).cast("binary")))[1]


@query("AGG-11 AGG-12", f"""
    WITH g AS (SELECT {_NORM} AS k, count(*) AS n FROM documents GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS n_in_groups,
           CASE WHEN coalesce(sum(n) FILTER (n > 1), 0) > 0.2 * sum(n) THEN 'poor' WHEN coalesce(sum(n) FILTER (n > 1), 0) > 0.05 * sum(n) THEN 'fair' ELSE 'good' END AS health FROM g""")
def dup_collapse_totals(t: Tables) -> DataFrame:
    totals = dedup.collapse(t.documents, F.md5(X.normalised(F.col("text")).cast("binary")))[0]
    return totals.withColumn("health", F.when(F.col("n_in_groups") > 0.2 * F.col("n_rows"), "poor").when(F.col("n_in_groups") > 0.05 * F.col("n_rows"), "fair").otherwise("good"))


@query("FLT-12 MTH-01", f"""
    SELECT doc_id, {_H8.format("'42:' || doc_id")} % 10000 AS bucket, {_H8.format("'42:' || doc_id")} % 10000 < 9500 AS train FROM documents""")
def hash_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", H.sha1_bucket(F.col("doc_id"), 10_000, "42:").alias("bucket"), H.in_train(F.col("doc_id"), 0.95).alias("train"))


@query("FLT-12", f"""
    WITH d AS (SELECT doc_id, lang, {_H8.format("'42:' || doc_id")} % 10000 >= 9999 AS val FROM documents),
    f AS (SELECT lang, CASE WHEN count(*) FILTER (val) = 0 THEN min(doc_id) END AS first_id FROM d GROUP BY lang)
    SELECT d.doc_id, d.lang FROM d JOIN f USING (lang) WHERE d.val OR d.doc_id = f.first_id""")
def validation_never_empty(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang", (~H.in_train(F.col("doc_id"), 0.9999)).alias("val"))
    spare = d.groupBy("lang").agg(F.when(F.count(F.when(F.col("val"), 1)) == 0, F.min("doc_id")).alias("_first"))
    return d.join(spare, "lang").where(F.col("val") | (F.col("doc_id") == F.col("_first"))).select("doc_id", "lang")


@query("FLT-10 FLT-11", f"""
    SELECT {_H8.format("'sample:' || doc_id")} % 100 < 30 AS in_a, {_H8.format("'stem-sample:' || doc_id")} % 100 < 30 AS in_b, count(*) AS n FROM documents GROUP BY ALL""")
def hash_sample_two_salts(t: Tables) -> DataFrame:
    return t.documents.groupBy(H.sampled(F.col("doc_id"), 30).alias("in_a"), H.sampled(F.col("doc_id"), 30, "stem-sample:").alias("in_b")).agg(F.count(F.lit(1)).alias("n"))


@query("MTH-01", f"SELECT {_H8.format('CAST(doc_id AS VARCHAR)')} % 256 AS shard, count(*) AS n FROM documents GROUP BY 1")
def shard_histogram(t: Tables) -> DataFrame:
    return t.documents.groupBy(H.shard_of(F.col("doc_id")).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


_SPLIT = """
    m(k, c) AS (VALUES (0, 11400714819323198485::UHUGEINT)),
    z0 AS (SELECT doc_id, (doc_id::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM documents),
    z1 AS (SELECT doc_id, (xor(z::UBIGINT, (z::UBIGINT >> 30))::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM z0),
    z2 AS (SELECT doc_id, (xor(z::UBIGINT, (z::UBIGINT >> 27))::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM z1),
    s AS (SELECT doc_id, xor(z::UBIGINT, (z::UBIGINT >> 31)) AS h FROM z2)"""


@query("MTH-03", f"WITH {_SPLIT} SELECT doc_id, lpad(lower(hex(h)), 16, '0') AS h FROM s")
def splitmix(t: Tables) -> DataFrame:
    return H.with_splitmix64(t.documents.select("doc_id"), "doc_id", "h").select("doc_id", H.unsigned_text(F.col("h")).alias("h"))


def _signatures(t: Tables) -> DataFrame:
    """SimHashes of the distinct words of each document, lower-cased."""
    return kernels.word_simhashes(t.documents.select("doc_id", _distinct_words().alias("w")), "doc_id", "w")


def _distinct_words() -> Column:
    return F.array_distinct(X.words(F.lower("text")))


_SIM = r"""
    w AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM documents),
    f AS (SELECT doc_id, CAST('0x' || substr(sha1(w), 1, 8) AS UBIGINT) AS f FROM w),
    a0 AS (SELECT doc_id, (f::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM f),
    a1 AS (SELECT doc_id, (xor(z::UBIGINT, z::UBIGINT >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM a0),
    a2 AS (SELECT doc_id, (xor(z::UBIGINT, z::UBIGINT >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM a1),
    a3 AS (SELECT doc_id, xor(z::UBIGINT, z::UBIGINT >> 31) AS h FROM a2),
    b AS (SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM a3, range(64) r(i) GROUP BY doc_id, i),
    sig AS (SELECT doc_id, bit_or(CASE WHEN v > 0 THEN 1::UBIGINT << i::UBIGINT ELSE 0::UBIGINT END) AS sig FROM b GROUP BY doc_id)"""


@query("MTH-04", f"WITH {_SIM} SELECT doc_id, lpad(lower(hex(sig)), 16, '0') AS sig FROM sig")
def simhash_signatures(t: Tables) -> DataFrame:
    return _signatures(t).select("doc_id", H.unsigned_text(F.col("sig")).alias("sig"))


_BAND = _SIM + """,
    k AS (SELECT doc_id, sig, i AS band, (sig >> (16 * i)::UBIGINT) & 65535 AS value FROM sig, range(4) r(i)),
    p AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM k x JOIN k y ON x.band = y.band AND x.value = y.value AND x.doc_id < y.doc_id WHERE bit_count(xor(x.sig, y.sig)) <= 3)"""


@query("JOIN-10 MTH-05 MTH-06", f"""WITH {_BAND}, rep AS (SELECT doc_id, sig, min(doc_id) OVER (PARTITION BY text) AS rep FROM sig JOIN documents USING (doc_id))
    SELECT rep AS a, doc_id AS b, 0 AS bits, true AS copy FROM rep WHERE doc_id <> rep
    UNION ALL SELECT a, b, CAST(bit_count(xor(x.sig, y.sig)) AS INT), false FROM p JOIN rep x ON x.doc_id = a JOIN rep y ON y.doc_id = b WHERE x.rep = a AND y.rep = b""")
def band_candidates(t: Tables) -> DataFrame:
    """Every pair of different texts with close signatures, between their representatives, and the copies of each text: no pair for
    each two copies."""
    key = F.struct("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest")).alias("k")
    signed = kernels.word_simhashes(t.documents.select(key, _distinct_words().alias("w")), "k", "w")
    return dedup.text_links(signed.select("k.doc_id", "k.digest", "sig"), "doc_id", "digest", "sig")


@query("AGG-05", f"WITH {_BAND} SELECT band, CAST(value AS BIGINT) AS value, count(*) AS members FROM k GROUP BY ALL HAVING count(*) > 4")
def oversized_buckets(t: Tables) -> DataFrame:
    return dedup.oversized_buckets(_signatures(t), "doc_id", "sig", cap=4).select(F.col("band").cast("long").alias("band"), "value", "members")


_COMP = "WITH RECURSIVE " + _BAND.strip() + """,
    e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
    r(v, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v),
    comp AS (SELECT v AS vertex, min(c) AS component FROM r GROUP BY v)"""


@query("JOIN-11", _COMP + " SELECT vertex, component FROM comp")
def near_dup_components(t: Tables) -> DataFrame:
    return dedup.components(dedup.near_links(_signatures(t), "doc_id", "sig"))


@query("AGG-04", _COMP + """ SELECT d.doc_id, first_value(d.doc_id) OVER (PARTITION BY component ORDER BY n_chars DESC, d.doc_id) AS keeper,
    first_value(d.doc_id) OVER (PARTITION BY component ORDER BY n_chars DESC, d.doc_id) <> d.doc_id AS "drop" FROM comp JOIN documents d ON d.doc_id = vertex""")
def near_dup_keeper(t: Tables) -> DataFrame:
    groups = dedup.components(dedup.near_links(_signatures(t), "doc_id", "sig"))
    return dedup.near_duplicate_verdict(t.documents.select("doc_id", "n_chars"), groups, "doc_id", [F.col("n_chars").desc(), F.col("doc_id")]).select("doc_id", "keeper", "drop")


@query("JOIN-04", """
    SELECT d.lang, count(*) AS n, count(l.doc_id) AS n_labelled, round(count(l.doc_id) / count(*), 9) AS share FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang""")
def label_coverage(t: Tables) -> DataFrame:
    marked = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", F.lit(1).alias("_m")), "doc_id", "left")
    return marked.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("_m").alias("n_labelled"), F.round(F.count("_m") / F.count(F.lit(1)), 9).alias("share"))


@query("JOIN-01 JOIN-22", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def pending_unlabelled(t: Tables) -> DataFrame:
    return joins.pending(t.documents.select("doc_id"), t.labels, "doc_id")


@query("JOIN-03 FLT-13", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE NOT coalesce(toxic = 1, false))")
def pending_or_redo(t: Tables) -> DataFrame:
    return joins.pending(t.documents.select("doc_id"), t.labels, "doc_id", redo=F.col("toxic") == 1)


@query("JOIN-02", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) OR (SELECT count(*) = 0 FROM labels WHERE quality = 1)")
def conditional_gate(t: Tables) -> DataFrame:
    return joins.gated(t.documents.select("doc_id"), t.labels.where("quality = 1"), "doc_id")


@query("JOIN-02", "SELECT doc_id FROM documents")
def conditional_gate_open(t: Tables) -> DataFrame:
    return joins.gated(t.documents.select("doc_id"), t.labels.where("quality = 7"), "doc_id")


@query("JOIN-05", """
    SELECT o_orderkey, c_name, c_mktsegment, n_name, r_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey
    LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def star_enrich(t: Tables) -> DataFrame:
    base = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customers = t.customer.select("c_custkey", "c_name", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    nations = t.nation.select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    return joins.enrich(base, [(customers, "c_custkey"), (nations, "n_nationkey"), (t.region, "r_regionkey")]).select("o_orderkey", "c_name", "c_mktsegment", "n_name", "r_name")


@query("JOIN-06 SET-03 SNK-04", """
    SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'q' || quality ELSE source END AS mark FROM documents d LEFT JOIN labels l USING (doc_id)""")
def priority_merge(t: Tables) -> DataFrame:
    return joins.overlay([t.labels.select("doc_id", F.concat(F.lit("q"), F.col("quality")).alias("mark")), t.documents.select("doc_id", F.col("source").alias("mark"))], "doc_id", "mark")


@query("JOIN-13 SET-06", """
    SELECT coalesce(l.doc_id, c.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left' WHEN c.doc_id IS NULL THEN 'right' ELSE 'both' END AS side
    FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations) c FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = c.doc_id""")
def orphans_full_outer(t: Tables) -> DataFrame:
    """Ids of conversations against those of labels: each side has orphans."""
    return joins.sides(t.conversations.select(F.col("conv_id").alias("doc_id")), t.labels, "doc_id")


@query("SET-06", """
    SELECT coalesce(a.source, b.source) AS source, a.n AS expected, b.n AS actual FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) a
    FULL JOIN (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1) b USING (source) WHERE a.n IS DISTINCT FROM b.n""")
def expected_vs_actual(t: Tables) -> DataFrame:
    count = lambda d: d.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return joins.differences(count(t.documents), count(t.documents.where("lang = 'en'")), "source", "n")


@query("SET-01 SET-02 SET-05", """
    SELECT 'both' AS part, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
    UNION ALL SELECT 'minus', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
    UNION ALL SELECT 'union', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)""")
def setdiff_union(t: Tables) -> DataFrame:
    a, b = t.documents.select("doc_id"), t.labels.select("doc_id")
    count = lambda d, part: d.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"))
    return count(a.intersect(b), "both").union(count(a.exceptAll(b).distinct(), "minus")).union(count(a.union(b).distinct(), "union"))


@query("JOIN-23", """
    WITH w AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_orderpriority) AS id FROM (SELECT DISTINCT o_orderpriority FROM orders))
    SELECT o_orderkey, id FROM orders JOIN w ON v = o_orderpriority""")
def dictionary_encoding(t: Tables) -> DataFrame:
    return joins.encode_distinct(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "id")[1]


@query("JOIN-24", """
    WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
    SELECT doc_id, i % 7 AS worker, i // 7 AS step FROM r WHERE i < n // 7 * 7""")
def rank_partition(t: Tables) -> DataFrame:
    return windows.rank_partition(t.documents.select("doc_id"), ["doc_id"], 7)


@query("SNK-10", """
    SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS request FROM documents ANTI JOIN labels USING (doc_id)""")
def delete_plan(t: Tables) -> DataFrame:
    from corpusmill.sources.stores import delete_plan as plan

    return plan(joins.pending(t.documents.select("doc_id"), t.labels, "doc_id"), "doc_id", 100)


@query("SNK-20", """
    SELECT doc_id, n_chars, CASE WHEN l.quality = 1 THEN n_chars END AS copy_size FROM documents LEFT JOIN labels l USING (doc_id)
    WHERE (CASE WHEN l.quality = 1 THEN n_chars END) IS DISTINCT FROM n_chars""")
def copy_differences(t: Tables) -> DataFrame:
    from corpusmill.sources.stores import copy_differences as compare

    copied = t.documents.join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return compare(t.documents, copied, "doc_id", "n_chars")


@query("MTH-20", """
    SELECT lang, substr(sha256(array_to_string(list_sort(list(DISTINCT source)), chr(0))), 1, 16) AS key FROM documents GROUP BY lang""")
def cache_key(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(H.content_key(F.collect_set("source")).alias("key"))


@query("WIN-04 AGG-18", """
    SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_suppkey, l_orderkey, l_linenumber) = 1""")
def keeper_size_wave(t: Tables) -> DataFrame:
    order = [F.col("l_quantity").desc(), F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber")]
    return windows.keeper(t.lineitem, ["l_partkey"], order).where("rank = 1").select("l_partkey", "l_orderkey", "l_linenumber")


@query("AGG-18", """
    SELECT l_partkey, count(*) AS n, count(DISTINCT l_quantity) AS sizes, count(*) > 1 AND count(DISTINCT l_quantity) = 1 AS identical, count(DISTINCT l_quantity) > 1 AS clash
    FROM lineitem GROUP BY l_partkey""")
def dedup_group_stats(t: Tables) -> DataFrame:
    n, sizes = F.count(F.lit(1)), F.count_distinct("l_quantity")
    return t.lineitem.groupBy("l_partkey").agg(n.alias("n"), sizes.alias("sizes"), ((n > 1) & (sizes == 1)).alias("identical"), (sizes > 1).alias("clash"))


@query("WIN-03", """
    WITH r AS (SELECT doc_id, source, (dense_rank() OVER (ORDER BY doc_id) - 1) // 100 AS wave FROM documents)
    SELECT wave, count(*) AS placed, count(*) FILTER (source <> 'src' || (wave % 20)) AS moves FROM r GROUP BY wave""")
def wave_plan(t: Tables) -> DataFrame:
    placed = windows.global_row_number(t.documents.select("doc_id", "source"), ["doc_id"], "rn").withColumn("wave", F.floor((F.col("rn") - 1) / 100))
    moves = F.count(F.when(F.col("source") != F.concat(F.lit("src"), F.pmod("wave", F.lit(20))), 1))
    return placed.groupBy("wave").agg(F.count(F.lit(1)).alias("placed"), moves.alias("moves"))
