"""Identifiers and placement of keys on nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_id(key: Column) -> Column:
    """SHA-256 of the key as a JSON string; keys have no characters that JSON escapes."""
    return F.sha2(F.concat(F.lit('"'), key, F.lit('"')).cast("binary"), 256)


def node_id(ip: Column, port: Column) -> Column:
    return F.sha2(F.concat(F.lit('{"ip":"'), ip, F.lit('","port":'), port.cast("string"), F.lit("}")).cast("binary"), 256)


def short_id(nid: Column) -> Column:
    return F.substr(nid, F.lit(1), F.lit(5))


def rendezvous_owner(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """``keys`` (key) with nid: the node for which the hash of key and node is largest.

    Nodes are a cluster's members; they travel as one array in each row, so no pairs are shuffled.
    """
    members = nodes.agg(F.sort_array(F.collect_set("nid")).alias("nids"))
    score = F.transform("nids", lambda n: F.struct(F.sha2(F.concat(F.lit('"'), key_id(F.col("key")), n, F.lit('"')).cast("binary"), 256).alias("score"), n.alias("nid")))
    return keys.join(F.broadcast(members)).select("key", F.array_max(score)["nid"].alias("nid"))  # one row


def hex_number(digits: Column) -> Column:
    """The number that hexadecimal digits stand for, as a double."""
    return F.aggregate(F.split(F.lower(digits), ""), F.lit(0.0), lambda n, d: n * 16 + F.instr(F.lit("0123456789abcdef"), d) - 1)


def naive_owner(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """``keys`` (key) with nid: the node whose place in sorted order is the key's number modulo the number of nodes, exactly."""
    members = nodes.agg(F.sort_array(F.collect_set("nid")).alias("nids"))
    digits = F.transform(F.split(key_id(F.col("key")), ""), lambda d: (F.instr(F.lit("0123456789abcdef"), d) - 1).cast("long"))
    place = F.aggregate(digits, F.lit(0).cast("long"), lambda n, d: (n * 16 + d) % F.size("nids"))
    return keys.join(F.broadcast(members)).select("key", F.get("nids", place.cast("int")).alias("nid"))  # one row


def consistent_owner(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """``keys`` (key) with nid: the first node at or after the key's place on the ring."""
    members = nodes.agg(F.sort_array(F.collect_set("nid")).alias("nids"))
    after = F.filter("nids", lambda n: n >= F.col("kid"))
    placed = keys.withColumn("kid", key_id(F.col("key"))).join(F.broadcast(members))  # one row
    return placed.select("key", F.when(F.size(after) > 0, F.element_at(after, 1)).otherwise(F.element_at("nids", 1)).alias("nid"))
