"""Queries on running streams: events arrive in batches, some late, and are joined and de-duplicated with state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.catalog import Tables, query
from corpusmill.sources.scratch import shared_path
from corpusmill.streaming import matching

#: Batches in which events arrive, hours by which every 50th event is late, and hours that the watermark waits.
BATCHES, LATE_HOURS, WAIT_HOURS = 4, 36, 12

_ARRIVALS = f"""
    e AS (SELECT *, CAST(epoch_us(ts) AS BIGINT) AS us FROM events), r AS (SELECT min(us) AS lo, max(us) - min(us) + 1 AS span FROM e),
    a AS (SELECT e.*, least({BATCHES - 1}, (us + CASE WHEN event_id % 50 = 0 THEN {LATE_HOURS} * 3600000000 ELSE 0 END - lo) * {BATCHES} // span) AS batch FROM e, r),
    w AS (SELECT b AS batch, coalesce((SELECT max(us) FROM a WHERE a.batch < b) // 1000 * 1000 - {WAIT_HOURS} * 3600000000, 0) AS mark FROM range({BATCHES}) t(b))"""


def _arrivals(t: Tables) -> DataFrame:
    """events with the number of the batch they arrive in: by time, every 50th one later than it happened."""
    e = t.events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    bounds = e.agg(F.min("us").alias("lo"), (F.max("us") - F.min("us") + 1).alias("span"))  # one row
    late = F.when(F.col("event_id") % 50 == 0, F.lit(LATE_HOURS * 3_600_000_000)).otherwise(F.lit(0))
    batch = F.least(F.lit(BATCHES - 1), F.floor(F.try_divide((F.col("us") + late - F.col("lo")) * BATCHES, F.col("span"))))
    return e.crossJoin(F.broadcast(bounds)).withColumn("batch", batch.cast("int")).drop("us", "lo", "span")


@query("STM-13", f"""
    WITH {_ARRIVALS} SELECT event_id, a.batch > 0 AND mark > 0 AS waited FROM a JOIN w USING (batch) WHERE us > mark""")
def rows_in_time(t: Tables) -> DataFrame:
    """Each event comes twice on a stream; one of each is kept, and none that comes when the watermark has passed it."""
    arrivals = _arrivals(t).select("event_id", "ts", "batch")
    kept, _ = matching.replay(t.spark, arrivals.unionAll(arrivals), "batch", shared_path(t.spark, "stream"), lambda s: matching.distinct_within(s, "ts", ["event_id"], f"{WAIT_HOURS} hours"))
    first = arrivals.select("event_id", (F.col("batch") > 0).alias("waited"))
    return kept.select("event_id").join(first, "event_id")


@query("STM-13", """
    SELECT v.event_id AS view_id, c.event_id AS click_id FROM events v JOIN events c ON c.user_id = v.user_id AND c.event_type = 'click' AND c.ts >= v.ts AND c.ts <= v.ts + INTERVAL 6 HOUR WHERE v.event_type = 'view'""")
def views_with_clicks(t: Tables) -> DataFrame:
    """Two streams joined: each view with the same user's clicks in the six hours after it. Rows come up to 36 hours late and the
    watermark waits for them, so the stream finds what a join of the whole table finds."""

    def joined(views, clicks):
        v = views.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("viewed"))
        c = clicks.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("clicked"))
        return matching.interval_join(v, c, "user_id", "viewed", "clicked", after="6 hours", late=f"{LATE_HOURS + 1} hours").select("view_id", "click_id")

    out, _ = matching.replay(t.spark, _arrivals(t).select("user_id", "event_id", "event_type", "ts", "batch"), "batch", shared_path(t.spark, "stream"), joined, sources=2)
    return out
