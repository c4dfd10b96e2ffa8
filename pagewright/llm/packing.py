"""Problem 7: fill containers of a fixed capacity with documents.

Only the histogram of lengths is planned: at most ``capacity`` distinct lengths
reach the driver, however many documents there are.  Best-fit works on counts
(all containers with the same free space and filling history form one group),
which gives ranges of slots per length.  Documents take those slots by their
rank within their length; the rank is counted in salted parts, so a length that
a third of all documents share is no hot group.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import cut, token_count

#: Rows of one length that are ranked together; a more frequent length is ranked in as many parts as it needs.
PART_ROWS = 500_000


def plan_slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first container, items of this length per container) by best fit on counts.

    Lengths go from long to short.  A length fills the groups with the least free space that still takes it, several
    copies per container where they fit, and opens new containers for the rest.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # free space -> ranges of containers (first, number)
    spaces: list[int] = []
    plan, opened = [], 0

    def put(space: int, first: int, number: int) -> None:
        if number and space:
            if space not in free:
                free[space] = []
                bisect.insort(spaces, space)
            free[space].append((first, number))

    for length in sorted((x for x in counts if x > 0), reverse=True):
        left, rank = counts[length], 0
        at = bisect.bisect_left(spaces, length)
        while left and at < len(spaces):
            space = spaces[at]
            each = space // length
            ranges = free[space]
            while left and ranges:
                first, number = ranges.pop()
                use = min(number, left // each)
                if use:
                    plan.append((length, rank, rank + use * each, first, each))
                    rank, left = rank + use * each, left - use * each
                    put(space - use_space(each, length), first, use)
                if use < number and left < each and left:
                    plan.append((length, rank, rank + left, first + use, left))
                    put(space - use_space(left, length), first + use, 1)
                    rank, left, use = rank + left, 0, use + 1
                if use < number:
                    ranges.append((first + use, number - use))
            if not ranges:
                del free[space]
                spaces.remove(space)
                at = bisect.bisect_left(spaces, length if space - each * length < length else space)
            else:
                at += 1
        each = capacity // length
        use = left // each
        if use:
            plan.append((length, rank, rank + use * each, opened, each))
            put(capacity - each * length, opened, use)
            opened, rank, left = opened + use, rank + use * each, left - use * each
        if left:
            plan.append((length, rank, rank + left, opened, left))
            put(capacity - left * length, opened, 1)
            opened += 1
    return plan


def use_space(copies: int, length: int) -> int:
    return copies * length


def _pieces(docs: DataFrame, capacity: int, key: str, text: str) -> DataFrame:
    """(key, piece, pieces, size): whole documents, or the full and last parts of those above the capacity."""
    sized = docs.select(F.col(key).alias(key), token_count(F.col(text)).alias("doc_size"))
    count = F.greatest(F.lit(1), F.ceil(F.col("doc_size") / F.lit(capacity))).cast("bigint")
    size = F.least(F.lit(capacity), F.col("doc_size") - F.col("piece") * F.lit(capacity)).cast("bigint")
    return sized.withColumn("pieces", count).withColumn("piece", F.explode(F.sequence(F.lit(0), (F.col("pieces") - 1).cast("int")))).withColumn("size", size)


def pack(docs: DataFrame, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, doc_size, pieces, piece, size, container_id): every document, each in one container unless it is larger.

    A document above the capacity is split into full pieces and one rest.  Texts without tokens (null, empty, blank)
    need no space: their ``container_id`` is null.  Repeated rows are documents of their own; only ``key`` and
    ``text`` are read, so other columns may have any name.
    """
    spark = docs.sparkSession
    items = cut(_pieces(docs, capacity, key, text))
    parts = items.filter("size > 0").groupBy("size").agg(F.ceil(F.count("*") / F.lit(PART_ROWS)).alias("parts"))  # at most a row per length
    salt = F.pmod(F.xxhash64(F.col(key), F.col("piece")), F.col("parts")).cast("int")
    items = items.join(F.broadcast(parts), "size", "left").withColumn("salt", F.coalesce(salt, F.lit(0))).drop("parts")
    per_part = items.filter("size > 0").groupBy("size", "salt").agg(F.count("*").alias("n")).toPandas()  # a row per length and PART_ROWS documents
    per_part = per_part.sort_values(["size", "salt"])
    per_part["before"] = per_part.groupby("size")["n"].cumsum() - per_part["n"]
    counts = per_part.groupby("size")["n"].sum()
    plan = plan_slots({int(k): int(v) for k, v in counts.items()}, capacity)
    if not plan:
        return items.select(key, "doc_size", "pieces", "piece", "size", F.lit(None).cast("bigint").alias("container_id"))
    slots = spark.createDataFrame(pd.DataFrame(plan, columns=["size", "from_rank", "to_rank", "base", "each"])).selectExpr(*[f"cast({c} as bigint) {c}" for c in ("size", "from_rank", "to_rank", "base", "each")])
    offsets = spark.createDataFrame(per_part[["size", "salt", "before"]]).selectExpr("cast(size as bigint) size", "cast(salt as int) salt", "cast(before as bigint) before")
    local = F.row_number().over(W.partitionBy("size", "salt").orderBy(key, "piece")) - 1
    ranked = items.withColumn("local", local).join(F.broadcast(offsets), ["size", "salt"], "left").withColumn("rank", F.col("local") + F.col("before"))
    inside = (F.col("i.size") == F.col("s.size")) & (F.col("i.rank") >= F.col("s.from_rank")) & (F.col("i.rank") < F.col("s.to_rank"))
    placed = ranked.alias("i").join(F.broadcast(slots.alias("s")), inside, "left")
    container = F.col("s.base") + F.floor((F.col("i.rank") - F.col("s.from_rank")) / F.col("s.each"))
    return placed.select(F.col(f"i.{key}").alias(key), "i.doc_size", "i.pieces", "i.piece", "i.size", container.cast("bigint").alias("container_id"))


def split_documents(placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key) of the documents whose pieces lie in more than one container."""
    return placed.groupBy(key).agg((F.min("container_id") < F.max("container_id")).alias("split")).filter("split").select(key)


def invariants(placed: DataFrame, capacity: int) -> DataFrame:
    """One row of what must hold of any packing: (tokens, pieces, unplaced, repeated, overfull, well_filled).

    ``tokens`` and ``pieces`` placed, pieces with tokens but no container, pieces that stand in two, containers above the
    capacity, and whether there are no more containers than the tokens need, but for one in a hundred and two more.
    """
    full = placed.filter("container_id is not null").groupBy("container_id").agg(F.sum("size").alias("used"), F.count("*").alias("pieces"))
    fill = full.agg(F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"), F.count(F.when(F.col("used") > capacity, 1)).alias("overfull"), (F.count("*") <= F.ceil(F.sum("used") / F.lit(capacity)) * F.lit(1.01) + F.lit(2)).alias("well_filled"))
    once = placed.groupBy("doc_id", "piece").agg(F.count("*").alias("n"), F.count(F.when((F.col("size") > 0) & F.col("container_id").isNull(), 1)).alias("none"))
    loose = once.agg(F.coalesce(F.sum("none"), F.lit(0)).alias("unplaced"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated"))
    both = fill.withColumn("one", F.lit(1)).join(loose.withColumn("one", F.lit(1)), "one")  # one row each
    return both.select("tokens", "pieces", "unplaced", "repeated", "overfull", "well_filled")
