"""Queries on ordered data: windows, intervals, packing, rankings, arrays and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import arrays as A
from corpusmill.functions import text as X
from corpusmill.operators import joins, ranking, similarity, windows
from corpusmill.plans.catalog import Tables, query
from corpusmill.sources import tables as S

_HOUR = 3_600_000_000
_US = "CAST(epoch_us(ts) AS BIGINT)"


def _timed(t: Tables) -> DataFrame:
    """events with us, their time in microseconds."""
    return t.events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


_SPANS = f"""
    WITH e AS (SELECT user_id, event_id, {_US} AS us FROM events),
    s AS (SELECT user_id, event_id, us AS a, coalesce(lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id), us + 1) AS b FROM e)"""


@query("JOIN-07", f"""{_SPANS}, w AS (SELECT DISTINCT user_id, us // 3600000000 AS hour FROM e)
    SELECT w.user_id, hour, count(*) AS n, min(s.event_id) AS first_event FROM w JOIN s ON s.user_id = w.user_id AND s.b > hour * 3600000000 AND s.a < (hour + 1) * 3600000000 GROUP BY ALL""")
def interval_overlap(t: Tables) -> DataFrame:
    """Each user's spans between events against the clock hours in which the user has any."""
    e = _timed(t).select("user_id", "event_id", "us")
    hours = e.select("user_id", F.floor(F.col("us") / _HOUR).alias("hour")).distinct()
    wins = hours.withColumn("lo", F.col("hour") * _HOUR).withColumn("hi", (F.col("hour") + 1) * _HOUR)
    hit = joins.overlapping(_spans(e), wins, ["user_id"], "a", "b", "lo", "hi", 24 * _HOUR)
    return hit.groupBy("user_id", "hour").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("JOIN-07", f"""{_SPANS}, w AS (SELECT user_id, event_id AS w_id, us - 3600000000 AS lo, us + 3600000000 AS hi FROM e)
    SELECT w_id, count(*) AS n, min(s.event_id) AS first_event FROM w JOIN s ON s.user_id = w.user_id AND s.b > w.lo AND s.a < w.hi GROUP BY w_id""")
def interval_overlap_full(t: Tables) -> DataFrame:
    """Each user's spans against the hours around each event."""
    e = _timed(t).select("user_id", "event_id", "us")
    wins = e.select("user_id", F.col("event_id").alias("w_id"), (F.col("us") - _HOUR).alias("lo"), (F.col("us") + _HOUR).alias("hi"))
    hit = joins.overlapping(_spans(e), wins, ["user_id"], "a", "b", "lo", "hi", 24 * _HOUR)
    return hit.groupBy("w_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


def _spans(e: DataFrame) -> DataFrame:
    nxt = F.lead("us").over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    return e.select("user_id", "event_id", F.col("us").alias("a"), F.coalesce(nxt, F.col("us") + 1).alias("b"))


@query("JOIN-08", f"""
    WITH e AS (SELECT user_id, event_id, event_type, {_US} AS us FROM events),
    p AS (SELECT user_id, event_id AS point, us FROM e WHERE event_type = 'error'), s AS (SELECT * FROM e WHERE event_type IN ('signup', 'purchase'))
    SELECT point, coalesce((SELECT max_by(event_type, us) FROM s WHERE s.user_id = p.user_id AND s.us <= p.us AND p.us < s.us + 86400000000), 'no_section') AS label FROM p""")
def active_at(t: Tables) -> DataFrame:
    """The last signup or purchase of the day before each error, no_section without one."""
    e = _timed(t)
    points = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("point"), "us")
    segments = e.where("event_type in ('signup', 'purchase')").select("user_id", F.col("us").alias("start"), (F.col("us") + 86_400_000_000).alias("end"), F.col("event_type").alias("label"))
    return joins.active_segment(points, segments, ["user_id"], "us", "start", "end", "label", "no_section").select("point", "label")


@query("JOIN-09", f"""
    WITH e AS (SELECT user_id, event_id, event_type, {_US} AS us FROM events)
    SELECT p.event_id AS error_id, (SELECT min(us) FROM e c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND c.us >= p.us) AS next_click FROM e p WHERE p.event_type = 'error'""")
def forward_asof(t: Tables) -> DataFrame:
    e = _timed(t)
    points = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), "us")
    clicks = e.where("event_type = 'click'").select("user_id", F.col("us").alias("next_click"))
    return joins.as_of(points, clicks, ["user_id"], "us", "next_click", [], forward=True).select("error_id", "next_click")


_MOVES = """
    WITH n AS (SELECT {g} AS g, count(*) AS n, TRY_CAST(nullif(regexp_extract({g}, '([0-9]+)$', 1), '') AS BIGINT) AS w FROM documents GROUP BY 1), c AS (SELECT *, CAST(floor(avg(n) OVER ()) AS BIGINT) AS t FROM n),
    o AS (SELECT g, sum(greatest(n - t, 0)) OVER (ORDER BY w NULLS LAST, g) AS hi, greatest(n - t, 0) AS k FROM c), u AS (SELECT g, sum(greatest(t - n, 0)) OVER (ORDER BY w NULLS LAST, g) AS hi, greatest(t - n, 0) AS k FROM c)
    SELECT o.g AS from_{g}, u.g AS to_{g}, CAST(least(o.hi, u.hi) - greatest(o.hi - o.k, u.hi - u.k) AS BIGINT) AS moved
    FROM o JOIN u ON o.hi - o.k < u.hi AND u.hi - u.k < o.hi WHERE o.k > 0 AND u.k > 0"""


@query("JOIN-15", _MOVES.format(g="lang"))
def spill_allocation(t: Tables) -> DataFrame:
    """Rows of languages above their mean (whole rows) move to languages below it; tables of one row a language."""
    return _moves(t, "lang")


@query("JOIN-15", _MOVES.format(g="source"))
def spill_allocation_full(t: Tables) -> DataFrame:
    """The same for sources."""
    return _moves(t, "source")


def _moves(t: Tables, group: str) -> DataFrame:
    sizes = t.documents.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    mean = sizes.agg(F.floor(F.avg("n")).cast("long").alias("mean"))
    over, under = joins.allocate_spill(sizes.crossJoin(F.broadcast(mean)), group, "n", F.col("mean"))
    met = joins.range_overlaps(over, under)
    return met.select(F.col(f"a_{group}").alias(f"from_{group}"), F.col(f"b_{group}").alias(f"to_{group}"), F.col("n").alias("moved"))


@query("WIN-01 WIN-02", """
    WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
    SELECT o_orderkey, i // 500 AS shard, i % 500 AS local_idx, CAST(coalesce(sum(o_custkey) OVER (PARTITION BY i // 500 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r""")
def contiguous_shards(t: Tables) -> DataFrame:
    return windows.contiguous_shards(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], "o_custkey", 500).drop("o_custkey")


@query("WIN-01", """
    WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
    SELECT o_orderkey, 3 + i // 500 AS shard_id, i % 500 AS local_idx FROM r""")
def appended_shards(t: Tables) -> DataFrame:
    from corpusmill.sources.stores import append_shards

    return append_shards(t.orders.select("o_orderkey", F.lit(1).alias("frames")), "o_orderkey", "frames", 500, 3).select("o_orderkey", "shard_id", "local_idx")


@query("WIN-07", r"""
    WITH c AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) + 1 AS cost FROM conversations),
    r AS (SELECT conv_id, turn, 7 + sum(cost) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM c)
    SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM r WHERE used <= 256""")
def capped_prefix(t: Tables) -> DataFrame:
    c = t.conversations.select("conv_id", "turn", X.word_count(F.col("text")).alias("n"))
    return windows.capped_prefix(c, ["conv_id"], "turn", F.col("n") + 1, 256, header=7).select("conv_id", "turn", "used")


@query("WIN-11 AGG-24", f"""
    WITH l AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
    SELECT user_id, count(*) AS n, count(*) FILTER (p = event_type) AS repeats FROM l WHERE p IS NOT NULL GROUP BY user_id""")
def adjacent_repeat(t: Tables) -> DataFrame:
    return windows.repeat_rate(t.events, ["user_id"], ["ts", "event_id"], "event_type")


@query("AGG-24", """
    WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), p AS (SELECT user_id, c / sum(c) OVER (PARTITION BY user_id) AS p FROM c)
    SELECT user_id, round(-sum(p * ln(p)) / ln(5.0), 9) + 0.0 AS entropy, round(max(p), 9) AS top_share FROM p GROUP BY user_id""")
def token_entropy(t: Tables) -> DataFrame:
    return ranking.entropy_stats(t.events, ["user_id"], "event_type", 5).select("user_id", (F.round("entropy", 9) + F.lit(0.0)).alias("entropy"), F.round("top_share", 9).alias("top_share"))


@query("AGG-20 AGG-21", """
    WITH c AS (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY ALL)
    SELECT event_type, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(avg(v) - 0.5 * stddev_pop(v), 6) AS robust FROM c GROUP BY event_type""")
def robust_rank(t: Tables) -> DataFrame:
    r = ranking.two_level(t.events, "event_type", "user_id", "value")
    return r.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "robust")])


@query("AGG-20", """
    SELECT event_type, count(value) AS n, round(avg(value) - 0.5 * stddev_pop(value), 6) AS robust, count(value) = max(count(value)) OVER () AS eligible FROM events GROUP BY event_type""")
def max_n_tier(t: Tables) -> DataFrame:
    return ranking.ranked_settings(t.events, "event_type", "value").select("event_type", "n", F.round("robust", 6).alias("robust"), "eligible")


@query("AGG-21 SRT-04", """
    WITH c AS (SELECT event_type, user_id, avg(value) AS ls, max(value) AS clap FROM events GROUP BY ALL),
    b AS (SELECT *, ls * (0.5 + 0.5 * (clap - min(clap) OVER ()) / greatest(max(clap) OVER () - min(clap) OVER (), 1e-9)) AS score FROM c)
    SELECT event_type, user_id, round(score, 6) AS score FROM b QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY score DESC, user_id) <= 3""")
def blended_finalists(t: Tables) -> DataFrame:
    cells = t.events.groupBy("event_type", "user_id").agg(F.avg("value").alias("ls"), F.max("value").alias("clap"))
    span = cells.agg(F.min("clap").alias("low"), F.max("clap").alias("high"))
    scored = cells.crossJoin(F.broadcast(span)).withColumn("score", ranking.blended(F.col("ls"), F.col("clap"), F.col("low"), F.col("high")))
    return ranking.top_per_group(scored, "event_type", [F.col("score").desc(), F.col("user_id")], 3).select("event_type", "user_id", F.round("score", 6).alias("score"))


@query("AGG-28", f"""
    WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    s AS (SELECT user_id, count(*) AS n, regr_slope(value, i) AS slope FROM e GROUP BY user_id)
    SELECT user_id, n, CASE WHEN n < 3 THEN '' WHEN slope < -0.01 THEN 'falling' WHEN slope > 0.01 THEN 'rising' ELSE 'flat' END AS label FROM s""")
def slope_label(t: Tables) -> DataFrame:
    e = t.events.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    s = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("value", F.col("i").cast("double")).alias("slope"))
    return s.select("user_id", "n", ranking.trend(F.col("n"), F.col("slope")).alias("label"))


@query("WIN-12", """
    WITH c AS (SELECT source, lang, count(*) AS c FROM documents GROUP BY ALL), p AS (SELECT source, lang, c / sum(c) OVER (PARTITION BY source) AS share, sum(c) OVER (PARTITION BY source ORDER BY c DESC, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / sum(c) OVER (PARTITION BY source) AS before FROM c)
    SELECT source, lang, round(share, 9) AS share FROM p WHERE coalesce(before, 0) <= 0.7""")
def nucleus_share(t: Tables) -> DataFrame:
    c = t.documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("c"))
    return windows.nucleus(c, ["source"], "c", "lang", 0.7).select("source", "lang", F.round("share", 9).alias("share"))


@query("WIN-13", "SELECT source, lang, c FROM (SELECT source, lang, count(*) AS c FROM documents GROUP BY ALL) QUALIFY rank() OVER (PARTITION BY source ORDER BY c DESC) <= 2")
def topk_with_ties(t: Tables) -> DataFrame:
    c = t.documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("c"))
    return windows.top_k_with_ties(c, ["source"], "c", 2).select("source", "lang", "c")


@query("WIN-15", """
    WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER () // 30 AS step FROM documents) SELECT doc_id FROM r WHERE i % step = 0 AND i < step * 30""")
def strided_sample(t: Tables) -> DataFrame:
    return windows.strided(t.documents.select("doc_id", "n_chars"), ["n_chars", "doc_id"], 30).select("doc_id")


@query("WIN-16", """
    WITH p AS (SELECT conv_id, list(turn ORDER BY turn) AS r FROM conversations GROUP BY conv_id)
    SELECT conv_id, k.k AS k, array_to_string(list_concat(list_concat(list_transform(range(k.k), lambda x: -1), r), list_transform(range(3 - k.k), lambda x: -1)), ',') AS cells FROM p, (SELECT unnest([0, 1, 2, 3]) AS k) k""")
def delay_shift(t: Tables) -> DataFrame:
    r = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("r"))
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.array_join(A.delay_row(F.col("r"), k, 4, -1), ",").alias("cells")) for k in range(4)])
    return r.select("conv_id", F.explode(rows).alias("x")).select("conv_id", "x.*")


@query("WIN-02", """
    WITH c AS (SELECT conv_id, list(turn ORDER BY turn) AS g FROM conversations GROUP BY conv_id)
    SELECT conv_id, len(g) AS n, CAST(coalesce(sum(len(g)) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM c""")
def csr_offsets(t: Tables) -> DataFrame:
    c = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return windows.running_sum(c, ["conv_id"], "n", "offset").select("conv_id", "n", "offset")


@query("ARR-02 ARR-03 ARR-09", """
    WITH c AS (SELECT conv_id, list(turn ORDER BY turn) AS g FROM conversations GROUP BY conv_id)
    SELECT conv_id, array_to_string(list_concat(g, [-1, -1, -1, -1, -1, -1])[1:6], ',') AS padded, CAST(least(len(g), 6) AS BIGINT) AS used FROM c""")
def padded_rows(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last()))
    head = t.conversations.select("conv_id", "turn").withColumn("_place", place).where("_place <= 6")
    g = head.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("g"))
    used = F.size(F.filter(A.mask(F.col("g"), 6), lambda m: m)).cast("long")
    return g.select("conv_id", F.array_join(A.force_length(F.col("g"), 6, -1), ",").alias("padded"), used.alias("used"))


@query("ARR-05", """
    WITH c AS (SELECT conv_id, list(turn ORDER BY turn) AS g FROM conversations GROUP BY conv_id HAVING count(*) >= 3)
    SELECT conv_id, array_to_string(list_concat(list_concat(list_concat([-1], g[1:1]), list_concat([-2], g[3:])), list_concat([-3], g[2:2])), ',') AS ordered FROM c""")
def infill_order(t: Tables) -> DataFrame:
    g = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("g")).where(F.size("g") >= 3)
    return g.select("conv_id", F.array_join(A.infill_order(F.col("g"), F.lit(1), F.lit(2), -1, -2, -3), ",").alias("ordered"))


@query("STR-05", """
    SELECT event_id, CASE WHEN value > 0 THEN len(list_filter([60, 70, 80, 90, 100, 110, 120, 130, 140, 150, 160, 170, 180], lambda e: value >= e)) ELSE -1 END AS bucket FROM events""")
def tempo_bucket(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.tempo_bucket(F.col("value")).cast("long").alias("bucket"))


@query("MTH-08", """
    WITH RECURSIVE r AS (SELECT event_id, value AS v FROM events WHERE value > 0 UNION ALL SELECT event_id, CASE WHEN v < 60 THEN v * 2 ELSE v / 2 END FROM r WHERE v < 60 OR v >= 180)
    SELECT event_id, round(v, 9) AS folded FROM r WHERE v >= 60 AND v < 180""")
def octave_fold(t: Tables) -> DataFrame:
    return t.events.where("value > 0").select("event_id", F.round(X.octave_fold(F.col("value")), 9).alias("folded"))


def _centroids(t: Tables) -> DataFrame:
    """One mean vector per label (ten in all)."""
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("center"))


@query("JOIN-17 MTH-14 WIN-14", """
    WITH e AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    c AS (SELECT label AS owner, i, avg(x) AS c FROM e GROUP BY ALL),
    s AS (SELECT vec_id, owner, sum(x * c) / greatest(sqrt(sum(x * x)) * sqrt(sum(c * c)), 1e-9) AS sim FROM e JOIN c USING (i) GROUP BY ALL),
    r AS (SELECT vec_id, owner, sim, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, owner) AS rn, lead(sim) OVER (PARTITION BY vec_id ORDER BY sim DESC, owner) AS second FROM s)
    SELECT vec_id, owner, round(sim, 6) AS sim, round(sim - second, 6) AS margin, sim - second >= 0.05 AS clear FROM r WHERE rn = 1""")
def cosine_argmax_margin(t: Tables) -> DataFrame:
    """Vectors against the label centroids, of which there may be any number: the nearest one and by how much."""
    found = similarity.nearest(t.embeddings, "vec_id", "embedding", _centroids(t), "label", "center", 2)
    sim, margin = F.col("nearest")[0]["sim"], F.col("nearest")[0]["sim"] - F.try_element_at("nearest", F.lit(2))["sim"]
    return found.select("vec_id", F.col("nearest")[0]["id"].alias("owner"), F.round(sim, 6).alias("sim"), F.round(margin, 6).alias("margin"), (margin >= 0.05).alias("clear"))


@query("MTH-12", "SELECT event_id, round(CASE WHEN event_id < 100 THEN 0.001 * (event_id + 1) / 100 ELSE 0.0001 + 0.0009 * 0.5 * (1 + cos(pi() * least(1.0, (event_id - 100) / 4900.0))) END, 9) AS rate FROM events")
def learning_rate(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(A.cosine_rate(F.col("event_id"), 100, 5000, 0.001, 0.0001), 9).alias("rate"))


@query("MTH-07", "SELECT event_id, round(20 * log10(greatest(value / 1000, 1e-10)), 9) AS dbfs FROM events WHERE value IS NOT NULL")
def loudness(t: Tables) -> DataFrame:
    return t.events.where("value is not null").select("event_id", F.round(A.dbfs(F.col("value") / 1000), 9).alias("dbfs"))


@query("AGG-38", """
    WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    r AS (SELECT user_id, i, value AS ema FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, 0.9 * r.ema + 0.1 * e.value FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
    SELECT user_id, round(max_by(ema, i), 6) AS ema FROM r GROUP BY user_id""")
def moving_average(t: Tables) -> DataFrame:
    """Exponential moving average of each user's values in order of time."""
    return windows.decayed_mean(t.events, "user_id", ["ts", "event_id"], "value", 0.9, "ema").select("user_id", F.round("ema", 6).alias("ema"))


@query("AGG-25", """
    SELECT event_type, round(sum(value * (1 + (event_id % 3 = 0)::INT)) / sum(1 + (event_id % 3 = 0)::INT), 6) AS weighted FROM events GROUP BY event_type""")
def weighted_means(t: Tables) -> DataFrame:
    w = 1 + (F.col("event_id") % 3 == 0).cast("int")
    return t.events.groupBy("event_type").agg(F.round(F.sum(F.col("value") * w) / F.sum(w), 6).alias("weighted"))


@query("AGG-39", "SELECT lang, CASE WHEN v - t > 0.15 THEN 'overfit' WHEN v - t < 0.05 THEN 'healthy' ELSE 'watch' END AS verdict FROM (SELECT lang, avg(n_chars) FILTER (doc_id % 10 = 0) / 1000 AS v, avg(n_chars) FILTER (doc_id % 10 <> 0) / 1000 AS t FROM documents GROUP BY lang)")
def gap_verdict(t: Tables) -> DataFrame:
    m = lambda c: F.avg(F.when(c, F.col("n_chars"))) / 1000
    g = t.documents.groupBy("lang").agg(m(F.col("doc_id") % 10 == 0).alias("v"), m(F.col("doc_id") % 10 != 0).alias("t"))
    return g.select("lang", ranking.gap_verdict(F.col("t"), F.col("v")).alias("verdict"))


@query("AGG-40", """
    WITH g AS (SELECT event_type, user_id, sqrt(sum(value)) AS v, row_number() OVER (PARTITION BY event_type ORDER BY sqrt(sum(value)) DESC, user_id) AS rn FROM events GROUP BY event_type, user_id),
    t AS (SELECT * FROM g WHERE rn <= 14) SELECT a.user_id, round(b.v / a.v, 6) AS ratio FROM t a JOIN t b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' ORDER BY b.v / a.v DESC, a.user_id LIMIT 12""")
def growth_ranking(t: Tables) -> DataFrame:
    g = t.events.groupBy("event_type", "user_id").agg(F.sqrt(F.sum("value")).alias("v"))
    top = ranking.top_per_group(g, "event_type", [F.col("v").desc(), F.col("user_id")], 14)
    a, b = top.where("event_type = 'view'").select("user_id", F.col("v").alias("a")), top.where("event_type = 'click'").select("user_id", F.col("v").alias("b"))
    return a.join(b, "user_id").orderBy((F.col("b") / F.col("a")).desc(), "user_id").limit(12).select("user_id", F.round(F.col("b") / F.col("a"), 6).alias("ratio"))


@query("JOIN-19", "SELECT a, b, c FROM (SELECT unnest([1, 3, 5]) AS a), (SELECT unnest(['x', 'y']) AS b), (SELECT unnest([10, 20]) AS c)")
def parameter_grid(t: Tables) -> DataFrame:
    """A grid of three short lists."""
    one = t.spark.range(1)
    return one.select(F.explode(F.array(*map(F.lit, (1, 3, 5)))).alias("a")).select("a", F.explode(F.array(*map(F.lit, ("x", "y")))).alias("b")).select("a", "b", F.explode(F.array(*map(F.lit, (10, 20)))).alias("c"))


@query("SRT-05 SRC-24", "SELECT event_id FROM events WHERE value > 10 ORDER BY md5('7:' || event_id), event_id LIMIT 25")
def seeded_sample(t: Tables) -> DataFrame:
    return t.events.where("value > 10").select("event_id").orderBy(F.md5(F.concat(F.lit("7:"), F.col("event_id")).cast("binary")), "event_id").limit(25)


@query("SRC-02", "SELECT 'wave_' || (p_partkey % 7) AS folder, count(*) AS n FROM part GROUP BY 1")
def split_listing(t: Tables) -> DataFrame:
    """Each part has a key of three pieces, which is accepted, and one of two, which isn't."""
    good = F.concat(F.lit("waves/wave_"), F.col("p_partkey") % 7, F.lit("/"), F.col("p_partkey"), F.lit(".mp3"))
    keys = t.part.select(F.explode(F.array(good, F.concat(F.lit("waves/"), F.col("p_partkey"), F.lit(".mp3")))).alias("key"))
    return S.split_keys(keys).groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
