"""Journal and window streams over the event files, caller-supplied scorers and rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tierlens.functions.labels import ratio
from tierlens.operators.policy import apply_predicate
from tierlens.plans import bindings as B
from tierlens.plans.registry import query
from tierlens.session import scratch
from tierlens.sources.journal import seal_records
from tierlens.streaming import journal as J, state as S

PLAN = "events-v1"
FIELDS = ["user_id", "event_type", "props"]


def event_stream(spark, sf) -> DataFrame:
    """The event files as a stream; ts becomes an instant for watermarks."""
    schema = B.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.withColumn("ts", F.timestamp_micros(B.wall_micros(F.col("ts"))))


def _journal(spark, sf) -> tuple[str, DataFrame]:
    records = seal_records(event_stream(spark, sf), "event_id", FIELDS, PLAN)
    target = scratch(spark, "journal")
    J.run_journal(records, target, scratch(spark, "journal-checkpoint"), "event_id", PLAN)
    return target, records


@query("t01_idempotent_append", f"""
SELECT event_id, sha256(event_id || chr(10) || sha256('{PLAN}') || chr(10) || to_json({{'user_id': user_id, 'event_type': event_type, 'props': props}})) AS payload_sha256, sha256('{PLAN}') AS plan_sha256 FROM events""")
def t01(spark, sf):
    """The stream is journaled, then offered again under a new checkpoint; nothing is added twice."""
    target, records = _journal(spark, sf)
    J.run_journal(records, target, scratch(spark, "journal-again"), "event_id", PLAN)
    return J.read_target(spark, target, records.schema).select("event_id", "payload_sha256", "plan_sha256")


@query("t02_seal", f"""
WITH r AS (SELECT event_id, to_json({{'user_id': user_id, 'event_type': event_type, 'props': props}})::VARCHAR AS payload, sha256('{PLAN}') AS plan_sha256 FROM events),
p AS (SELECT *, sha256(event_id || chr(10) || plan_sha256 || chr(10) || payload) AS payload_sha256 FROM r),
h AS (SELECT sha256('{{"event_id":' || event_id || ',"payload":' || to_json(payload) || ',"payload_sha256":' || to_json(payload_sha256) || ',"plan_sha256":' || to_json(plan_sha256) || '}}') AS h FROM p)
SELECT count(*) AS rows, sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR AS part0, sum(('0x' || substr(h, 16, 15))::BIGINT)::VARCHAR AS part1,
       sum(('0x' || substr(h, 31, 15))::BIGINT)::VARCHAR AS part2, sum(('0x' || substr(h, 46, 15))::BIGINT)::VARCHAR AS part3, sha256('{PLAN}') AS plan_sha256 FROM h""")
def t02(spark, sf):
    """Completion record after full coverage was checked, with the journal's fingerprint."""
    target, records = _journal(spark, sf)
    return J.seal(spark, target, records.schema, B.table(spark, sf, "events"), "event_id", PLAN)


@query("t03_resume", "SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase' OR value < 5)")
def t03(spark, sf):
    e = B.table(spark, sf, "events")
    return J.pending(e, e.where("event_type = 'purchase' or value < 5"), "event_id").select("event_id", "user_id")


@query("t04_failure_counts", """
SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start, event_type, count(*) AS events FROM events
GROUP BY ALL""")
def t04(spark, sf):
    """Events per hour and kind: hours the watermark has passed from the stream's output, the others from its state."""
    table = S.window_counts(event_stream(spark, sf), "ts", "event_type", "event_id", "1 hour", "10 minutes", scratch(spark, "failures"))
    return table.select(F.unix_micros("window_start").alias("window_start"), "event_type", "events")


@query("t04_first_details", """
SELECT event_type, failures, event_id, detail_rank FROM (SELECT event_type, event_id, count(*) OVER (PARTITION BY event_type) AS failures, row_number() OVER (PARTITION BY event_type ORDER BY event_id)::INT AS detail_rank FROM events) WHERE detail_rank <= 5""")
def t04b(spark, sf):
    """The first five events of each kind and how many there are, kept by the same stream as state."""
    table = S.window_counts(event_stream(spark, sf), "ts", "event_type", "event_id", "1 day", "10 minutes", scratch(spark, "details"))
    return S.first_details(table, "event_type", "event_id")


@query("t05_session_runs", """
WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m)
SELECT user_id, epoch_us(min(ts)) AS run_start, epoch_us(max(ts)) AS run_end, count(*) AS parts FROM s GROUP BY user_id, run""")
def t05(spark, sf):
    """Runs of a user's events with gaps of at most two hours, as state per user."""
    table = S.gap_runs(event_stream(spark, sf), "ts", "user_id", "2 hours", "1 hour", scratch(spark, "sessions"))
    return table.select("user_id", F.unix_micros("run_start").alias("run_start"), F.unix_micros("run_end").alias("run_end"), "parts")


def word_count(batch: pd.DataFrame) -> pd.Series:
    """Example scorer; it refuses records whose text is shorter than 40 characters."""
    if (batch["text"].str.len() < 40).any():
        raise ValueError("text too short")
    return batch["text"].str.split().str.len()


@query("u01_pending_scorer", r"""
SELECT doc_id, CASE WHEN length(text) >= 40 THEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::BIGINT END AS result, CASE WHEN length(text) < 40 THEN 'ValueError: text too short' END AS error
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def u01(spark, sf):
    """A scorer over the unlabelled documents only; failures become data."""
    work = J.pending(B.table(spark, sf, "documents").select("doc_id", "text"), B.table(spark, sf, "labels"), "doc_id")
    return J.apply_scorer(work, word_count, "doc_id", "long")


def share_at_least(part: str, whole: str, limit: float) -> Column:
    """Example rule: is part/whole at least the limit? Unknown without a whole."""
    return ratio(F.col(part), F.col(whole)) >= limit


@query("u02_predicate", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / nullif(l_quantity, 0) >= 1500 AS expensive FROM lineitem")
def u02(spark, sf):
    li = B.table(spark, sf, "lineitem")
    ruled = apply_predicate(li, share_at_least, "expensive", part="l_extendedprice", whole="l_quantity", limit=1500.0)
    return ruled.select("l_orderkey", "l_linenumber", "l_partkey", "expensive")
