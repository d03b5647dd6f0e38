"""Graphs of edge lists: nodes, degrees, components, statistics, writers."""

from __future__ import annotations

import json
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import durable, few


def edge_list(df: DataFrame, source: str, target: str, undirected: bool = False, weight: str | None = None) -> DataFrame:
    """(source, target, weight), one row a pair, repeated pairs counted or their weights summed."""
    a, b = F.col(f"`{source}`").cast("string"), F.col(f"`{target}`").cast("string")
    ends = (F.least(a, b), F.greatest(a, b)) if undirected else (a, b)
    w = F.sum(F.col(f"`{weight}`")) if weight else F.count(F.lit(1))
    return df.groupBy(ends[0].alias("source"), ends[1].alias("target")).agg(w.alias("weight"))


def bipartite(df: DataFrame, source: str, target: str) -> DataFrame:
    """An edge list between two disjoint sets of nodes: keys get the name of their column."""
    a, b = (F.concat(F.lit(f"{n}:"), F.col(f"`{n}`").cast("string")).alias(n) for n in (source, target))
    return edge_list(df.select(a, b), source, target)


def nodes(edges: DataFrame, undirected: bool = False, degrees: bool = False, component: bool = False) -> DataFrame:
    """node, with its degrees and its component's smallest node."""
    ends = edges.select(F.col("source").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("target", F.lit(0), F.lit(1)))
    made = ends.groupBy("node").agg(F.sum("in").alias("in_degree"), F.sum("out").alias("out_degree"))
    made = made.withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    out = made.select("node", *([] if not degrees else ["degree"] if undirected else ["degree", "in_degree", "out_degree"]))
    if component:
        roots = components(edges)
        out = out.join(roots, "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root")
    return out


def connected(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root) for every node with an edge to another; root: the smallest node reachable.

    Alternating large and small stars: every node hangs its larger neighbours on the smallest node it knows, then itself
    and its smaller neighbours, until all edges lead to roots. Edges never grow in number, and rounds grow with the
    logarithm of the nodes (a path of 1024 takes about ten, whatever the order of its ids). Both steps are an
    aggregate with partial results, joined back: where its nodes are few they are sent to all tasks, so that the edges of a hub
    stay where they are; else Spark splits skewed partitions.
    """
    edges = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(edges):
        ends = edges.union(edges.select("b", "a"))
        low = durable(ends.groupBy(F.col("a").alias("b")).agg(F.least(F.min("b"), F.col("a")).alias("low")))
        large = durable(edges.join(few(low), "b").select("a", F.col("low").alias("b")).distinct())
        low = durable(large.groupBy("a").agg(F.min("b").alias("low")))
        lower = large.join(few(low), "a").filter("b <> low").select("b", "low")
        edges = durable(low.union(lower).distinct().toDF("a", "b"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one node at most, and none on a node that hangs itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of nodes with an edge to another: root is the smallest node of the component."""
    return connected(edges.select(F.col("source").alias("a"), F.col("target").alias("b")))


def component_sizes(edges: DataFrame) -> DataFrame:
    """component_size, arbitrary_node of each component, largest first."""
    labelled = nodes(edges, component=True)
    return labelled.groupBy("component").agg(F.count(F.lit(1)).alias("component_size")).select("component_size", F.col("component").alias("arbitrary_node")).orderBy(F.desc("component_size"), "arbitrary_node")


def largest(edges: DataFrame) -> DataFrame:
    """The edges of the largest component, of several as large that of the smallest node."""
    labelled = durable(nodes(edges, component=True))
    best = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    inside = labelled.join(F.broadcast(best), "component", "left_semi").select(F.col("node").alias("source"))
    return edges.join(inside, "source", "left_semi")


def described(edges: DataFrame, table: DataFrame, node: str) -> DataFrame:
    """The nodes of an edge list and of a table of them, with the table's columns; nodes without a row have none."""
    found = edges.select(F.col("source").alias(node)).union(edges.select("target")).distinct()
    return found.join(table.withColumn(node, F.col(f"`{node}`").cast("string")), node, "full")


def statistics(edges: DataFrame, undirected: bool = False, components: bool = True) -> DataFrame:
    """One row: type, nodes, edges, is_multi, has_self_loops, density, connected_components, largest_component; without `components`
    all but the last two, by one pass over the edges instead of rounds."""
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.bool_or(F.col("weight") > 1), F.lit(False)).alias("is_multi"), F.coalesce(F.bool_or(F.col("source") == F.col("target")), F.lit(False)).alias("has_self_loops"))
    if components:
        sizes = component_sizes(edges).agg(F.sum("component_size").alias("nodes"), F.count(F.lit(1)).alias("connected_components"), F.max("component_size").alias("largest_component"))
    else:
        sizes = nodes(edges).agg(F.count(F.lit(1)).alias("nodes"))
    n = F.col("nodes")
    pairs = n * (n - 1)
    density = F.col("edges") / F.nullif(F.floor(pairs / 2) if undirected else pairs, F.lit(0))
    return e.crossJoin(sizes).select(F.lit("undirected" if undirected else "directed").alias("type"), "nodes", "edges", "is_multi", "has_self_loops", density.alias("density"), *sizes.columns[1:])


def to_json(edges: DataFrame, undirected: bool = False) -> str:
    """Nodes and edges for a viewer. Rows pass the driver one by one: for graphs that a viewer can show."""
    listed = [{"key": r.node} for r in nodes(edges).orderBy("node").toLocalIterator()]
    drawn = [{"source": r.source, "target": r.target, "attributes": {"weight": r.weight}, "undirected": undirected} for r in edges.orderBy("source", "target").toLocalIterator()]
    return json.dumps({"options": {"type": "undirected" if undirected else "directed", "multi": False}, "nodes": listed, "edges": drawn})


def to_gexf(edges: DataFrame, undirected: bool = False) -> str:
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://gexf.net/1.3" version="1.3">', f'<graph defaultedgetype="{"undirected" if undirected else "directed"}">', "<nodes>"]
    out += [f'<node id="{escape(r.node)}" label="{escape(r.node)}"/>' for r in nodes(edges).orderBy("node").toLocalIterator()]
    out += ["</nodes>", "<edges>"]
    out += [f'<edge id="{i}" source="{escape(r.source)}" target="{escape(r.target)}" weight="{r.weight}"/>' for i, r in enumerate(edges.orderBy("source", "target").toLocalIterator())]
    return "\n".join([*out, "</edges>", "</graph>", "</gexf>"])
