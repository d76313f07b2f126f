"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v). large: every node links its larger neighbours to its smallest; small: its smaller ones."""
    if large:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    both = around.join(low, "u")
    if large:
        out = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    out = out.where("u != v")
    return out if large else out.distinct()  # a large step makes a row of each row at most


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v: long, a written table): component is the smallest node reachable."""
    edges, before = edges.where("u != v"), None
    while True:
        edges = ws.table(_star(_star(edges, True), False), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged(labels: DataFrame | None, links: DataFrame, ws: Workspace) -> DataFrame:
    """(node, component), after ``links`` (u, v), of the nodes that any link so far has.

    The links are contracted to pairs of components first: only these, which shrink from call to call, go through the steps.
    """
    if labels is None:
        labels = links.sparkSession.range(0).select(F.col("id").alias("node"), F.col("id").alias("component"))
    for end in ("u", "v"):
        links = links.join(labels.withColumnsRenamed({"node": end, "component": "c"}), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    links = ws.table(links.where("u != v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct(), "links")
    if links.isEmpty():
        return labels
    found = ws.table(components(links, ws), "found")
    moved = labels.join(found.select(F.col("node").alias("component"), F.col("component").alias("c")), "component", "left").select("node", F.coalesce("c", "component").alias("component"))
    return ws.table(moved.unionByName(found.join(labels.select("node"), "node", "left_anti")), "labels")
