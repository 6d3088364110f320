"""Sessions as a stream against the batch form, and cases worked out by hand."""

import datetime as dt

from pyspark.sql import functions as F

from foliant.streaming import sessions as S

DAY = dt.datetime(2024, 5, 1, tzinfo=dt.UTC)
SCHEMA = "session_id string, event_id long, at timestamp, kind string"


def at(minute):
    return DAY + dt.timedelta(minutes=minute)


FIRST = [("a", 1, at(0), "render"), ("a", 2, at(1), "upload"), ("a", 4, at(2), "render"), ("a", 3, at(2), "upload"), ("b", 5, at(3), "upload"), ("b", 6, at(4), "other"), (None, 7, at(4), "upload"), (None, 8, at(5), "render")]
SECOND = [("a", 9, at(12), "render"), ("a", 10, at(13), "render"), ("b", 11, at(12), "render"), ("c", 12, at(12), "render")]
THIRD = [("b", 13, at(200), "render"), ("b", 14, at(201), "upload"), ("b", 15, at(202), "render")]
WANT = {1: None, 4: 3, 8: None, 9: 3, 10: None, 11: 5, 12: None, 13: None, 15: 14}


def test_batch(spark):
    got = S.answers(spark.createDataFrame(FIRST + SECOND + THIRD, SCHEMA), 600).collect()
    assert {r["request_id"]: r["upload_id"] for r in got} == WANT
    assert all((r["status"] == "ok") == (r["upload_id"] is not None) for r in got)
    assert S.answers(spark.createDataFrame([], SCHEMA), 600).count() == 0


def test_stream(spark, tmp_path):
    for k, rows in enumerate((FIRST, SECOND, THIRD)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        run = S.answer_stream(events, 600, "1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        run.awaitTermination(120)
        assert run.exception() is None, k
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r["request_id"]: r["upload_id"] for r in got} == WANT and len(got) == len(WANT)


def test_replies(spark):
    asked = spark.createDataFrame([("a", 1, 7, "ok"), ("a", 2, 8, "ok"), (None, 3, None, "unknown")], S.ANSWERS)
    bodies = spark.createDataFrame([(7, "T & t", "<p>x</p>")], "doc_id long, title string, body string")
    got = {r["request_id"]: (r["status"], r["html"]) for r in S.replies(asked, bodies, F.lit("p {}")).collect()}
    assert got[1][0] == "ok" and "<title>T &amp; t</title>" in got[1][1] and "<body>\n<p>x</p>\n</body>" in got[1][1]
    assert got[2] == ("missing", None) and got[3] == ("unknown", None)
