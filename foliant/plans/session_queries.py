"""Queries on sessions: users' events as uploads and requests, answered and shown with pages of the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.plans import page_queries as P
from foliant.session import settled, table
from foliant.streaming import sessions as S

#: Seconds that an upload is kept; short enough that some sessions end between two uploads.
KEEP = 86_400


def _events(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "upload").when(F.col("event_type") != "error", "render").otherwise("other")
    user = F.when(F.col("user_id") % 10 != 9, F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select(user.alias("session_id"), "event_id", F.col("ts").alias("at"), kind.alias("kind"))


def session_answers(spark, sf_dir):
    """Sign-ups are uploads, errors neither; every tenth user has no session."""
    return S.answers(_events(spark, sf_dir), KEEP)


def session_replies(spark, sf_dir):
    """Digests of the pages that requests get; an upload hands in one of thirteen suppliers' documents, of which the smallest tables lack some."""
    bodies = settled(P._bodies(spark, sf_dir), "bodies")
    css = F.concat(F.lit(".s"), F.col("session_id"), F.lit(" { margin: 0; }"))
    found = S.replies(session_answers(spark, sf_dir).withColumn("upload_id", F.col("upload_id") % 13), bodies, css)
    return found.select("session_id", "request_id", "status", F.md5("html").alias("digest"))


QUERIES = {f.__name__: f for f in (session_answers, session_replies)}

_ANSWERS = f"""ev AS (SELECT CASE WHEN user_id % 10 <> 9 THEN user_id::VARCHAR END AS session_id, event_id, ts, event_type FROM events),
up AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS u, last_value(CASE WHEN event_type = 'signup' THEN ts END IGNORE NULLS) OVER w AS t FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
ans AS (SELECT session_id, event_id AS request_id, CASE WHEN session_id IS NOT NULL AND epoch_us(ts) - epoch_us(t) <= {KEEP * 1_000_000} THEN u END AS upload_id FROM up WHERE event_type NOT IN ('signup', 'error'))"""
_BODIES = P.SQL["html_document"]
SQL = {
    "session_answers": f"WITH {_ANSWERS} SELECT *, CASE WHEN upload_id IS NULL THEN 'unknown' ELSE 'ok' END AS status FROM ans",
    "session_replies": f"""WITH {_ANSWERS}, bd AS (SELECT * FROM ({_BODIES}))
    SELECT session_id, request_id, CASE WHEN upload_id IS NULL THEN 'unknown' WHEN body IS NULL THEN 'missing' ELSE 'ok' END AS status, md5('<!DOCTYPE html>' || chr(10) || '<html lang="en">' || chr(10) || '<head>' || chr(10) || '<meta charset="UTF-8">' || chr(10)
    || '<meta name="viewport" content="width=device-width, initial-scale=1.0">' || chr(10) || '<title>' || title || '</title>' || chr(10) || '<style>' || chr(10) || '.s' || session_id || ' {{ margin: 0; }}' || chr(10) || '</style>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || body || chr(10) || '</body>' || chr(10) || '</html>') AS digest
    FROM ans LEFT JOIN bd ON bd.doc_id = upload_id % 13""",
}
