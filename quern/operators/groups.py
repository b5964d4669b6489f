"""Node groups as a metadata table (gid, sid, ip, port), and values by member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def members(groups: DataFrame, gid: str) -> DataFrame:
    return groups.where(F.col("gid") == gid)


def add(groups: DataFrame, gid: str, nodes: DataFrame) -> DataFrame:
    """The groups with more members in one of them and in ``all``; who is there already stays once."""
    rows = nodes.withColumn("gid", F.explode(F.array_distinct(F.array(F.lit(gid), F.lit("all")))))
    return groups.unionByName(rows.select(*groups.columns)).dropDuplicates(["gid", "sid"])


def remove(groups: DataFrame, gid: str, sid: str) -> DataFrame:
    """A member or group that isn't there is no error."""
    return groups.where(~((F.col("gid") == gid) & (F.col("sid") == sid)))


def drop(groups: DataFrame, gid: str) -> DataFrame:
    return groups.where(F.col("gid") != gid)


def sum_metric(values: DataFrame, metric: str) -> DataFrame:
    """(gid, total) of any numeric column over the members of each group."""
    return values.groupBy("gid").agg(F.sum(metric).alias("total"))


def gather(values: DataFrame) -> DataFrame:
    """(gid, oks, errors): what a group call returns, as maps by member."""
    return values.groupBy("gid").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("error").isNull(), F.struct("sid", "value")))).alias("oks"),
        F.map_from_entries(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("sid", "error")))).alias("errors"),
    )
