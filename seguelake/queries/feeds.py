"""Streaming queries on replayed tables."""

from pyspark.sql import functions as F

from seguelake.functions.numeric import rounded
from seguelake.queries import query
from seguelake.streaming import feeds as op
from seguelake.streaming import state

c = F.col


def events(t):
    return op.replay(t.spark, t.folder, "events", "ts")


def to_the_end(t, job, mode, keys=None, keyed=False):
    """Drain ``job`` over all events and close it at the end of the feed."""
    stream = events(t)
    feed = op.with_end(stream, "ts")
    return op.drain(job(feed.stream), mode, keys, lambda: op.write_end(t.spark, stream.schema, feed.marks, "ts"), keyed=keyed)


def secs(name):
    return F.unix_timestamp(c(name)).alias(name)


@query(
    "latest_feedback",
    "SELECT user_id, event_type, arg_max(value, ts) AS value, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1, 2",
)
def _(t):
    d = op.latest_feedback(events(t), ["user_id", "event_type"], "ts", ["value", "event_id"])
    return op.drain(d, "update", ["user_id", "event_type"]).select("user_id", "event_type", "value", "event_id")


BURST = f"""g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS n FROM events), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g),
 b AS (SELECT user_id, run, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS votes, arg_min(event_type, ts) AS label, max(ts) AS last FROM r GROUP BY 1, 2)"""


@query("comment_bursts", f'WITH {BURST} SELECT user_id, "start", votes, label FROM b')
def _(t):
    d = to_the_end(t, lambda e: op.comment_sessions(e, "user_id", "ts", "2 hours", "1 hour", "event_id", "event_type"), "append")
    return d.select("user_id", secs("start"), "votes", "label")


@query(
    "merged_bursts",
    """WITH RECURSIVE g AS (SELECT *, epoch_us(ts) AS us, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS n FROM events), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY us) AS run FROM g),
 o AS (SELECT *, list(us) OVER (PARTITION BY user_id, run ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM r),
 b AS (SELECT user_id, run, min(us) AS start, any_value((l[(len(l) + 1) // 2] + l[len(l) // 2 + 1]) // 2) AS middle, count(*) AS votes, count(DISTINCT event_id % 7) AS people, arg_min(event_type, (us, event_type)) FILTER (event_type <> 'click') AS label, row_number() OVER (PARTITION BY user_id ORDER BY run) AS k FROM o GROUP BY user_id, run),
 m AS (SELECT user_id, k, start, middle, votes, people, label, 1 AS grp FROM b WHERE k = 1
  UNION ALL SELECT b.user_id, b.k, CASE WHEN j THEN m.start ELSE b.start END, CASE WHEN j THEN m.middle ELSE b.middle END, CASE WHEN j THEN m.votes + b.votes ELSE b.votes END, CASE WHEN j THEN m.people + b.people ELSE b.people END, CASE WHEN j THEN coalesce(m.label, b.label) ELSE b.label END, CASE WHEN j THEN m.grp ELSE m.grp + 1 END
  FROM m JOIN b ON b.user_id = m.user_id AND b.k = m.k + 1, LATERAL (SELECT b.middle - m.middle < 14400000000 AS j) x)
 SELECT user_id, start, middle, votes, people, label FROM m QUALIFY row_number() OVER (PARTITION BY user_id, grp ORDER BY k DESC) = 1""",
)
def _(t):
    def job(e):
        named = e.withColumn("name", F.when(c("event_type") == "click", "ID").otherwise(c("event_type"))).withColumn("person", c("event_id") % 7)
        return state.merged_bursts(named, "user_id", "ts", "person", "name", "event_id", 7200.0, 14400.0, "1 hour")

    return to_the_end(t, job, "append", keyed=True).select(c("key").cast("long").alias("user_id"), "start", "middle", "votes", "people", "label")


@query(
    "per_second_features",
    """SELECT user_id, CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS "start", count(*) AS n, round(avg(value), 6) AS mean, max(value) AS top FROM events GROUP BY 1, 2""",
)
def _(t):
    d = to_the_end(t, lambda e: op.window_features(e, "user_id", "ts", "value", "1 hour", "1 hour"), "append")
    return d.select("user_id", secs("start"), "n", rounded(c("mean")).alias("mean"), "top")


@query(
    "sliding_density",
    """WITH w AS (SELECT user_id, value, time_bucket(INTERVAL 30 MINUTE, ts) - i * INTERVAL 30 MINUTE AS s FROM events, range(0, 2) r(i)) SELECT user_id, CAST(epoch(s) AS BIGINT) AS "start", count(*) AS n FROM w GROUP BY 1, 2""",
)
def _(t):
    d = to_the_end(t, lambda e: op.window_features(e, "user_id", "ts", "value", "1 hour", "1 hour", "30 minutes"), "append")
    return d.select("user_id", secs("start"), "n")


@query("stream_dedup", "SELECT DISTINCT sha256(user_id || '|' || event_type || '|' || props) AS hash FROM events")
def _(t):
    content = F.sha2(F.concat_ws("|", "user_id", "event_type", "props"), 256)
    return op.drain(op.first_copies(events(t), content, "ts", "3650 days"), "append").select("hash")


@query(
    "late_and_invalid",
    "WITH l AS (SELECT user_id, min(ts) AS o, epoch(max(ts) - min(ts)) * 0.8 AS d FROM events GROUP BY 1) SELECT event_id FROM events JOIN l USING (user_id) WHERE epoch(ts) - epoch(o) <= d * 1.02::DOUBLE",
)
def _(t):
    base = t.raw("events").withColumn("s", c("ts").cast("timestamp").cast("double"))
    limits = base.groupBy("user_id").agg(F.min("s").alias("origin"), ((F.max("s") - F.min("s")) * 0.8).alias("duration"))
    return op.drain(op.valid_events(events(t), limits, "user_id", "ts", "1 hour"), "append").select("event_id")


@query("progress_counters", "SELECT event_type AS stage, CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'done' END AS status, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    d = events(t).select(c("event_type").alias("stage"), F.when(c("event_id") % 5 == 0, "failed").otherwise("done").alias("status"))
    return op.drain(op.progress_counters(d, "stage", "status"), "complete")


def history(t):
    d = to_the_end(t, lambda e: state.recent_edges(e, "user_id", "ts", "event_type", "event_id", 20, "1 hour"), "update", ["key"], keyed=True)
    return d.withColumn("user_id", c("key").cast("long"))


@query("play_history_state", "SELECT user_id, event_type AS item, count(*) AS plays, CAST(floor(epoch(max(ts))) AS BIGINT) AS last FROM events GROUP BY 1, 2")
def _(t):
    played = history(t).select("user_id", F.explode(F.arrays_zip("plays", "lasts")).alias("p"))
    return played.select("user_id", "p.plays.item", c("p.plays.n").alias("plays"), F.floor(c("p.lasts.us") / 1_000_000).alias("last"))


@query(
    "recent_edges",
    """WITH s AS (SELECT user_id, ts, event_id, lag(event_type) OVER w AS a, event_type AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recency FROM s WHERE a <> b) SELECT user_id, CAST(recency AS INTEGER) AS recency, a, b FROM r WHERE recency <= 20""",
)
def _(t):
    d = history(t).select("user_id", F.posexplode("edges").alias("at", "e"))
    return d.select("user_id", (c("at") + 1).alias("recency"), "e.a", "e.b")


@query(
    "incremental_ingest",
    "SELECT doc_id, CASE WHEN n_chars < 200 THEN 'failed' ELSE 'done' END AS status FROM documents WHERE doc_id % 3 <> 0",
)
def _(t):
    stream = op.replay(t.spark, t.folder, "documents").withColumn("checksum", F.sha2("text", 256))
    ledger = t.documents.filter(c("doc_id") % 3 == 0).select("doc_id", F.sha2("text", 256).alias("checksum"), F.lit("done").alias("status"))
    return op.ingest(stream, ledger, "doc_id", "checksum", lambda d: d, c("n_chars") < 200).select("doc_id", "status")
