"""Streaming queries: each drains a table's files as a stream and returns what the stream wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.plans.base import query, table
from marlstone.streaming import events as E
from marlstone.streaming.expiry import expired
from marlstone.streaming.ledger import event_key, materialise
from marlstone.streaming.tables import new_folder, read_stream


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS lines, strlen(coalesce(text, ''))::BIGINT AS bytes FROM documents")
def stream_watch(spark, sf_dir):
    """Arriving files are indexed batch by batch."""
    return E.indexed(read_stream(spark, sf_dir, "documents"), new_folder(spark, "watch"))


@query("SELECT conv_id AS doc_id, sha256(coalesce(text, '')) AS content_hash, len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS lines, strlen(coalesce(text, ''))::BIGINT AS bytes FROM conversations")
def stream_notes_watch(spark, sf_dir):
    """The same over notes."""
    notes = read_stream(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "text")
    return E.indexed(notes, new_folder(spark, "notes"))


@query("SELECT event_id AS seq, substr(sha256(event_id || '|' || event_type || '|' || user_id), 1, 24) AS id, event_type, user_id FROM events")
def stream_ledger(spark, sf_dir):
    """The events as a ledger, applied in gapless runs."""
    first = table(spark, sf_dir, "events").agg(F.min("event_id")).first()[0]
    rows = read_stream(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), event_key("event_id", "event_type", "user_id").alias("id"), "event_type", "user_id")
    return materialise(rows, new_folder(spark, "ledger"), 1 if first is None else first)


@query("SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def stream_pending(spark, sf_dir):
    """Purchases wait for their user's signup."""
    e = read_stream(spark, sf_dir, "events")
    buys = e.where("event_type = 'purchase'").select("user_id", "event_id", "value")
    return E.pending_edges(buys, e.where("event_type = 'signup'").select("user_id"), "user_id", new_folder(spark, "pending"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Hourly counts of each type over event time."""
    e = read_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    hours = E.tumbling(e, "1 hour", "1 day", new_folder(spark, "windows"), "event_type")
    return hours.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT event_id, user_id FROM events")
def stream_dedup(spark, sf_dir):
    """Each event id once within the watermark."""
    e = read_stream(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return E.first_seen(e, "event_id", "1 day", new_folder(spark, "dedup")).select("event_id", "user_id")


@query("""
WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 4 HOUR THEN 0 ELSE 1 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n, max(ts) + INTERVAL 4 HOUR AS ended_at FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 4 HOUR < (SELECT max(ts) FROM events)""")
def stream_ttl(spark, sf_dir):
    """Sessions of users that expired: each event renews its user's for four hours; what is alive stays in the state."""
    e = read_stream(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.lit("renew").alias("action"))
    ended = expired(e, 4 * 3600, "0 seconds", new_folder(spark, "ttl"))
    at = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return ended.select(F.col("key").alias("user_id"), at("first_at"), at("last_at"), "n", at("ended_at"))
