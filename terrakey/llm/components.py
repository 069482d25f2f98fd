"""Connected components of a link table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakey.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for each node of ``links`` (a, b); comp is the smallest node that can be reached.

    In each round a node takes the smallest label among its neighbours, then the label of its label. Every round is a
    written table. A hub meets its links in joins whose other side has one row per key, which Spark can split; minima
    are combined before they are shuffled. Only a count comes to the driver. Nulls in a link make it void.
    """
    links = links.where("a is not null and b is not null and a <> b")
    edges = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = cut(edges.groupBy("a").agg(F.min("b").alias("x")).select(F.col("a").alias("node"), F.least("a", "x").alias("comp")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("seen"))
        low = labels.join(near, labels["node"] == near["a"]).select("node", F.least("comp", "seen").alias("low"), (F.col("seen") < F.col("comp")).alias("moved"))
        low = cut(low, "low")
        if not low.where("moved").limit(1).count():
            return low.select("node", F.col("low").alias("comp"))
        up = low.select(F.col("node").alias("_n"), F.col("low").alias("_up"))
        labels = cut(low.join(up, low["low"] == up["_n"], "left").select("node", F.least("low", "_up").alias("comp")), "labels")
