"""The stream of messages against its batch form on a long session and null keys."""

import random

from pagewright.operators.messages import watermark_sessions
from pagewright.streaming.stateful import stream_watermarks

MSG = "run_id string, session long, turn long, msg_id long, text string"


def test_session_longer_than_an_arrow_batch(spark, tmp_path):
    rows = [("a", 1, i, i, "x" * (i % 97)) for i in range(1, 401)] + [(None, 1, 1, 901, "x" * 3000), (None, 1, 2, 902, "y"), ("a", None, None, 903, "z"), ("a", None, 1, 904, None)]
    random.Random(6).shuffle(rows)
    df = spark.createDataFrame(rows, MSG)
    df.coalesce(1).write.parquet(str(tmp_path / "m"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = stream_watermarks(spark, spark.readStream.schema(MSG).parquet(str(tmp_path / "m")), force=200)
        got = sorted(map(tuple, got.select("msg_id", "run_id", "session", "part").collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == sorted(map(tuple, watermark_sessions(df, 200).select("msg_id", "run_id", "session", "part").collect()))
