"""Sessions: a document that was handed in once is shown again on request, until the session expires.

Events are (session_id, event_id, at, kind): an ``upload`` opens or replaces what the session holds, a ``render`` asks for it.
What is held is the upload's id alone; the rendered bodies are a table by that id, made once for each upload, and
a reply joins the two. So a request costs no parsing, and the state stays a few bytes for each session.
A request is answered if the session's last upload is not after it and at most ``keep`` seconds before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.operators import pages as G

ANSWERS = "session_id string, request_id long, upload_id long, status string"
HELD = "upload_id long, us long"


def answers(events: DataFrame, keep: int) -> DataFrame:
    """(session_id, request_id, upload_id, status) of every render, "ok" or "unknown"; of equal times the lower id is first.

    An event without session opens none and gets none.
    """
    events = events.withColumn("at", F.col("at").cast("timestamp"))
    order = Window.partitionBy("session_id").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("kind") == "upload", F.struct("event_id", "at")), ignorenulls=True).over(order)
    own = events.where("session_id IS NOT NULL").withColumn("held", held)
    lone = events.where("session_id IS NULL").withColumn("held", F.lit(None).cast(own.schema["held"].dataType))
    fresh = F.unix_micros("at") - F.unix_micros("held.at") <= keep * 1_000_000
    asked = own.unionByName(lone).where("kind = 'render'").withColumn("upload_id", F.when(fresh, F.col("held.event_id")))
    return asked.select("session_id", F.col("event_id").alias("request_id"), "upload_id", F.when(F.col("upload_id").isNotNull(), "ok").otherwise("unknown").alias("status"))


def answer_stream(events: DataFrame, keep: int, delay: str = "1 hour") -> DataFrame:
    """The same as a stream; state is dropped once the watermark has passed a session's end.

    A session's events of one batch are taken in order of time. A request that comes in a later batch than a newer upload
    finds that one and is unknown; what is later than ``delay`` is dropped by the engine.
    """

    def step(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["us", "event_id"])
        held = state.get if state.exists and key[0] is not None else None
        out = []
        for event, us, kind in zip(rows["event_id"].tolist(), rows["us"].tolist(), rows["kind"], strict=True):
            if kind == "upload" and key[0] is not None and (held is None or us >= held[1]):
                held = (event, us)
            elif kind == "render":
                found = held is not None and 0 <= us - held[1] <= keep * 1_000_000
                out.append((key[0], event, held[0] if found else None, "ok" if found else "unknown"))
        if held is not None:
            end = held[1] // 1000 + keep * 1000 + 1
            if end > state.getCurrentWatermarkMs():
                state.update(held)
                state.setTimeoutTimestamp(end)
            elif state.exists:
                state.remove()
        if out:
            frame = pd.DataFrame(out, columns=["session_id", "request_id", "upload_id", "status"])
            yield frame.astype({"upload_id": "Int64"})

    own = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay).select("session_id", "event_id", "at", "kind", F.unix_micros("at").alias("us"))
    return own.groupBy("session_id").applyInPandasWithState(step, ANSWERS, HELD, "append", GroupStateTimeout.EventTimeTimeout)


def replies(answered: DataFrame, bodies: DataFrame, css: Column) -> DataFrame:
    """(session_id, request_id, status, html): the page of each request, with the style that it asks for.

    bodies are (doc_id, title, body) by the upload's id; a request without session, or whose body is not stored, gets no page. css may
    use all columns of ``answered``.
    """
    own = answered.join(bodies.select(F.col("doc_id").alias("upload_id"), "title", "body"), "upload_id", "left")
    status = F.when((F.col("status") == "ok") & F.col("body").isNull(), "missing").otherwise(F.col("status"))
    return own.select("session_id", "request_id", status.alias("status"), F.when(F.col("body").isNotNull(), G.page(F.col("title"), F.col("body"), css)).alias("html"))
