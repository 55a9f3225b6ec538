"""Reduction of a large table to the ids that matter, before it is aggregated or shuffled.

The ids become a hashed bitmap of 2**bits bits, as words of 64 that have any bit set. It is built by an
aggregate and broadcast; ``bits`` bounds its size (2**19 words of 16 bytes for 25), whatever the
number of ids. A row whose bit isn't set can't have one of the ids and is dropped where it is scanned.
Rows that pass by chance (as many in a hundred as the ids fill of the bits) are dropped by the exact
join that follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 25


def _place(col: Column, bits: int) -> Column:
    return F.xxhash64(col).bitwiseAND(F.lit((1 << bits) - 1))


def id_bitmap(ids: DataFrame, bits: int = BITS) -> DataFrame:
    """word (number) and set (its 64 bits) of the bitmap of ``ids`` (id)."""
    place = ids.where("id is not null").select(_place(F.col("id"), bits).alias("p"))
    return place.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("set"))


def may_have(rows: DataFrame, bitmap: DataFrame, bits: int = BITS) -> DataFrame:
    """``rows`` (id, ...) without those whose id isn't in the bitmap."""
    words = bitmap.select(F.col("word").alias("_word"), F.col("set").alias("_set"))
    hit = rows.withColumn("_p", _place(F.col("id"), bits)).join(F.broadcast(words), F.shiftright("_p", 6) == F.col("_word"))
    return hit.where(F.expr("getbit(_set, cast(_p & 63 as int)) = 1")).select(*rows.columns)


def reduced(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without most that have none of the ``ids``, for a join that follows. The bitmap is a
    broadcast, so a session that has switched broadcasts off keeps all rows; the join drops them then."""
    if rows.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-"):
        return rows
    return may_have(rows, id_bitmap(ids))
