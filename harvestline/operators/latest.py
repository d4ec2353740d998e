"""Newest row per key, top-n per group, exact ranks.

`row_number` under a `<= n` filter plans as a group limit before the shuffle, so a key
that holds a third of the table still sends at most n rows per task. Ties are always
broken by explicit columns: results do not depend on file or task order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harvestline.session import cut_lineage

_RN = "_row_in_group"


def _descending(names: Sequence[str]) -> list[Column]:
    return [F.col(n).desc() for n in names]


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                    n: int) -> DataFrame:
    """First `n` rows of each group in the given total order."""
    numbered = df.withColumn(_RN, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return numbered.where(F.col(_RN) <= n).drop(_RN)


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str = "event_ts",
                   ties: Sequence[str] = ("event_id",)) -> DataFrame:
    """Newest row per key."""
    return top_n_per_group(df, keys, _descending([ts, *ties]), 1)


def last_n_samples(df: DataFrame, keys: Sequence[str], n: int, ts: str = "event_ts",
                   ties: Sequence[str] = ("event_id",)) -> DataFrame:
    """Newest `n` rows per key."""
    return top_n_per_group(df, keys, _descending([ts, *ties]), n)


def top_ranked(df: DataFrame, key: str, score: str, tie: str, n: int) -> DataFrame:
    """Rows ranked 1..n by score within `key`, with their `rank`."""
    order = W.partitionBy(key).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


# Rows of one group that a single task sorts at most.
GROUP_ROWS = 1_000_000


def chunks_for(df: DataFrame, key: str, rows: int = GROUP_ROWS) -> int:
    """Ranges of about `rows` rows to rank side by side; 1 if every group fits one task.

    A counting pass over the key column; two numbers reach the driver.
    """
    sizes = df.groupBy(key).count().agg(F.max("count"), F.sum("count")).first()
    return 1 if (sizes[0] or 0) <= rows else -(-2 * sizes[1] // rows)


def score_rank(df: DataFrame, key: str, score: str, tie: str,
               chunks: int | None = None) -> DataFrame:
    """Rank of every row by score within `key`, largest first.

    A full rank has no group limit, so a hot key would be sorted in one task. Where the
    largest group is too big for that, rows are put into ranges of (key, score, tie), which
    come out even for any distribution of scores; rows are ranked inside their range and
    shifted by the rows of the key in earlier ranges. The result does not depend on `chunks`.
    """
    chunks = chunks or chunks_for(df, key)
    order = [F.col(score).desc(), F.col(tie)]
    if chunks == 1:
        whole = F.row_number().over(W.partitionBy(key).orderBy(*order))
        return df.withColumn("rank", whole.cast("int"))
    placed = cut_lineage(
        df.repartitionByRange(chunks, F.col(key), *order).withColumn("_chunk", F.spark_partition_id()),
        "rank-order")
    earlier = W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    shifts = (
        placed.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
        .select(F.col(key).alias("_key"), F.col("_chunk").alias("_of"),
                F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    )
    return (
        placed.withColumn(_RN, F.row_number().over(W.partitionBy(key, "_chunk").orderBy(*order)))
        .join(shifts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_of")), "left")
        .withColumn("rank", (F.col(_RN) + F.col("_shift")).cast("int"))
        .drop("_chunk", "_key", "_of", "_shift", _RN)
    )


def newest_first(df: DataFrame, ts: str, ties: Sequence[str], limit: int | None) -> DataFrame:
    """The `limit` newest rows, newest first: plans as a distributed top-k.

    Without a limit all rows stay, in no order: a step that writes them keeps none.
    """
    if limit is None:
        return df
    return df.orderBy(F.col(ts).desc(), *[F.col(t) for t in ties]).limit(limit)


def oldest_batch(df: DataFrame, ts: str, ties: Sequence[str], limit: int | None) -> DataFrame:
    """The `limit` oldest rows, oldest first; without a limit all rows, in no order."""
    if limit is None:
        return df
    return df.orderBy(F.col(ts).asc(), *[F.col(t) for t in ties]).limit(limit)
