"""The conversation as a stream: messages arrive in files, each run keeps its state between micro-batches."""

from __future__ import annotations

import heapq
import json
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ORDER = ["has_turn", "turn", "has_id", "msg_id"]  # nulls first
OUT = "run_id string, session long, msg_id long, part long, used long"


def in_order(chunks: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Rows (ORDER, n) of all chunks of a group in order; more than one are sorted in a file each and merged, so memory is bounded."""
    with tempfile.TemporaryDirectory(prefix="spark-") as folder:
        runs: list[np.ndarray] = []
        for k, b in enumerate(chunks):
            rows = np.ascontiguousarray(b.sort_values(ORDER)[[*ORDER, "n"]].to_numpy(dtype="int64"))
            if len(rows):
                np.save(f"{folder}/{k}.npy", rows)
                runs.append(np.load(f"{folder}/{k}.npy", mmap_mode="r"))
        yield from heapq.merge(*[(tuple(map(int, r)) for r in run) for run in runs])


class Watermark(StatefulProcessor):
    """Keeps the characters used and the part number of each session; rolls on once the estimate reaches ``force``."""

    def __init__(self, force: int):
        self.force = force

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("used", "chars long, part long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chars, part = self.state.get() if self.state.exists() else (0, 1)
        of, out = json.loads(key[0]), []
        for _, _, known, msg, n in in_order(rows):
            if chars // 4 >= self.force:
                chars, part = 0, part + 1
            chars += n
            out.append((of.get("run_id"), of.get("session"), msg if known else None, part, chars))
            if len(out) == 10_000:
                yield self._frame(out)
                out = []
        if out:
            yield self._frame(out)
        self.state.update((chars, part))

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["run_id", "session", "msg_id", "part", "used"]).astype({"run_id": object, "session": "Int64", "msg_id": "Int64"})

    def close(self) -> None:
        pass


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    return f"{base}/stream-{uuid.uuid4().hex}" if base else "file://" + tempfile.mkdtemp(prefix="spark-")


def stream_watermarks(spark: SparkSession, source: DataFrame, force: int = 500) -> DataFrame:
    """Writes the watermark sessions of a message stream to a table in the shared folder and returns it.

    The store for the state is RocksDB; the sink commits each micro-batch once.  Arrival order within a session is the
    order of its turns in each batch, however long the session is there; a batch that comes late continues the session
    where it stands.  Null runs and sessions are keys of their own, as in the batch form.
    """
    whole = lambda c: [F.col(c).isNotNull().cast("bigint").alias("has_" + c.removeprefix("msg_")), F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)]
    rows = source.select(F.to_json(F.struct("run_id", "session")).alias("key"), *whole("turn"), *whole("msg_id"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = _folder(spark)
    try:
        out = rows.groupBy("key").transformWithStateInPandas(Watermark(force), OUT, "Append", "None")
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start(f"{folder}/table")
        q.awaitTermination()
    finally:
        if old:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return spark.read.schema(OUT).parquet(f"{folder}/table")


def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the message table, read as a stream of files."""
    path = f"{sf_dir}/messages.parquet"
    schema = spark.read.parquet(path).schema
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(folder).isFile()
    reader = spark.readStream.schema(schema)
    source = reader.option("pathGlobFilter", "messages.parquet").parquet(sf_dir) if single else reader.parquet(path)
    unique = source.dropDuplicates(["msg_id"])
    return stream_watermarks(spark, unique)
