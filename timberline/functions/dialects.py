"""Dialect of a single line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions import patterns as P


def dialect_of(line: Column) -> Column:
    """First dialect whose rule holds for a stripped line; null if none does."""

    def like(pattern: str) -> Column:
        return line.rlike(P.uni(pattern))

    is_json = (
        line.startswith("{") & line.endswith("}") & F.try_parse_json(line).isNotNull()
    )
    return (
        F.when(is_json, "json")
        .when(like(P.DIALECT_HDFS) | line.contains("dfs.DataNode") | line.contains("dfs.FSNamesystem"), "hdfs")
        .when(
            like(P.DIALECT_BGL)
            | (line.contains("NULL") & (line.contains("BGL") | line.contains("RAS"))),
            "bgl",
        )
        .when(
            like(P.DIALECT_ZOOKEEPER)
            | line.contains("QuorumPeer")
            | F.lower(line).contains("zookeeper"),
            "zookeeper",
        )
        .when(like(P.DIALECT_HADOOP), "hadoop")
        .when(like(P.DIALECT_SPARK), "spark")
        .when(like(P.DIALECT_OPENSTACK) | line.contains("req-"), "openstack")
        .when(like(P.DIALECT_SYSLOG) | line.contains("sshd"), "syslog")
    )
