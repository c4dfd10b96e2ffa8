"""What several operators of this package share: reading, first arrivals, sizes in tokens, cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# fixed values: the size rule of the public BERT basic tokenizer; ideographs, punctuation and runs of anything else
IDEOGRAPH = r"\x{4E00}-\x{9FFF}"
MARKS = r"\p{P}$+<=>^`|~"
SPACES = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
TOKEN = rf"[{IDEOGRAPH}]|[{MARKS}]|[^{SPACES}{IDEOGRAPH}{MARKS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_count(text: Column) -> Column:
    """Size in tokens, counted in the JVM; 0 for nulls."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


#: Keys that arrive more than once are broadcast up to this number (some 16 MB); beyond it whole rows are shuffled by key.
FEW_KEYS = 1_000_000


def first_arrival(df: DataFrame, key: str, time: str) -> DataFrame:
    """One row per ``key``: the earliest by ``time`` (nulls last); rows without a key all stay.

    A grouped minimum with partial aggregation, so a key repeated very often costs no more than its partial results.
    """
    cols = [c for c in df.columns]
    packed = F.struct(*[F.col(f"`{c}`") for c in cols])
    own = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    return (
        df.withColumn("__own", own)
        .groupBy(F.col(key).alias("__k"), "__own")
        .agg(F.min_by(packed, F.struct(F.col(time).isNull(), F.col(time))).alias("__row"))
        .select(*[F.col(f"__row.`{c}`").alias(c) for c in cols])
    )


def first_rows(df: DataFrame, key: str, time: str) -> DataFrame:
    """:func:`first_arrival` for wide rows: keys that arrive once, nearly all, stay where they are.

    Only the keys are counted over all rows.  Those that arrive more than once are broadcast if they are few, so that
    no other row moves; else every row goes through the shuffle, once, into a table.
    """
    again = cut(df.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("n")).filter("n > 1 and __k is not null").select("__k"))
    if again.count() > FEW_KEYS:
        return cut(first_arrival(df, key, time))
    same = F.col(key) == F.col("__k")
    once = df.join(F.broadcast(again), same, "left_anti")
    return once.unionByName(first_arrival(df.join(F.broadcast(again), same, "left_semi"), key, time))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a temporary one only where none is named, as in tests."""
    return spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or "file://" + tempfile.mkdtemp(prefix="spark-")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read again: its lineage ends there, so lost executors
    cost no recomputation and several uses compute it once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as there are cores; leaves tables alone that have them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def unique_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of ``context``, each once, spread over the cores."""
    return first_rows(spread(table(spark, sf_dir, "context")), "page_id", "packed_at")
