"""Joining documents with one row per group, whatever the groups' sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast; it is counted first.
BROADCAST_ROWS = 100_000
#: Parts into which each group's rows are split where the other side is too large for that.
SALTS = 32


def attach(rows: DataFrame, groups: DataFrame, key: str, spread: Column) -> DataFrame:
    """rows with the columns of groups (one row for each key, a checkpointed or stored table), left outer.

    groups goes to all executors if it has been counted to be small; otherwise each group's rows are salted by spread, so a
    key with a third of all rows is shared by SALTS tasks, and groups is repeated as often.
    """
    if groups.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), key, "left")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    copies = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [key, "__salt"], "left").drop("__salt")


def small(df: DataFrame) -> DataFrame:
    """df (a stored table, or nearly), to be broadcast if it has been counted to have few rows; they must be narrow."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def group_key(*columns: str) -> Column:
    """One string for a group of nullable columns: nulls and values, and the places of values, can't be mixed up."""
    parts = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in columns]
    return F.concat(*parts) if len(parts) > 1 else parts[0]
