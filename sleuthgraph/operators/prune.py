"""Cutting a built graph down: types, roles, neighbourhood, top risk, isolated nodes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .graph import Graph, ordered_nodes

ISOLATED_RISK = 60


def _lowered(names: Sequence[str]) -> list[str]:
    return [n.lower() for n in names]


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("source", "target")).alias("node_id"))


def links_within(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links whose two ends are both present."""
    ids = nodes.select("node_id")
    return (links.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi")
            .join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi").select(links.columns))


def keep_types(graph: Graph, entity_types: Sequence[str] | None = None,
               relation_types: Sequence[str] | None = None) -> Graph:
    nodes, links = graph.nodes, graph.links
    if relation_types:
        links = links.where(F.lower("rel").isin(_lowered(relation_types)))
    if entity_types:
        # The type is the prefix of a node id, so both ends are tested without a join.
        kept = _lowered(entity_types)
        nodes = nodes.where(F.lower("type").isin(kept))
        for side in ("source", "target"):
            links = links.where(F.lower(F.substring_index(side, ":", 1)).isin(kept))
    return replace(graph, nodes=nodes, links=links)


def neighborhood(links: DataFrame, start: str, hops: int) -> DataFrame:
    """Node ids within ``hops`` undirected steps of ``start`` (with their distance).

    Each hop joins only the nodes that the last one reached first.
    """
    if hops < 1:
        raise ValueError("hops must be at least 1")
    edges = links.select(F.inline(F.array(
        F.struct(F.col("source").alias("a"), F.col("target").alias("b")),
        F.struct(F.col("target").alias("a"), F.col("source").alias("b"))))).distinct()
    reached = frontier = links.sparkSession.createDataFrame([(start, 0)], "node_id string, distance int")
    for hop in range(1, hops + 1):
        step = edges.join(frontier.select(F.col("node_id").alias("a")), "a").select(F.col("b").alias("node_id")).distinct()
        frontier = cut(step.join(reached, "node_id", "left_anti").withColumn("distance", F.lit(hop)))
        reached = reached.unionByName(frontier)
    return reached


def keep_focus(graph: Graph, focus: str, hops: int = 1) -> Graph:
    """The focus node and its neighbourhood; an unknown focus gives an empty graph."""
    known = graph.nodes.where(F.col("node_id") == focus).select("node_id").limit(1)
    near = neighborhood(graph.links, focus, hops)
    if known.isEmpty():
        near = near.where(F.lit(False))
    nodes = graph.nodes.join(near, "node_id", "left_semi")
    return replace(graph, nodes=nodes, links=links_within(graph.links, nodes))


def top_risk(graph: Graph, max_nodes: int) -> Graph:
    """The ``max_nodes`` riskiest nodes (a top-k report) and the links among them."""
    if not max_nodes or graph.nodes.count() <= max_nodes:
        return graph
    nodes = ordered_nodes(graph.nodes).limit(max_nodes)
    return replace(graph, nodes=nodes, links=links_within(graph.links, nodes), truncated=True,
                   notes=(*graph.notes, f"Graph cut to the {max_nodes} riskiest nodes."))


def drop_isolated(graph: Graph) -> Graph:
    """Nodes without a link go, unless they are risky; nothing goes when no link is left."""
    if graph.links.isEmpty():
        return graph
    linked = _ends(graph.links).distinct().withColumn("linked", F.lit(True))
    nodes = graph.nodes.join(linked, "node_id", "left").where(
        F.col("linked").isNotNull() | (F.col("risk") >= ISOLATED_RISK)).drop("linked")
    return replace(graph, nodes=nodes)


def keep_roles(graph: Graph, roles: Sequence[str]) -> Graph:
    nodes = graph.nodes.where(F.col("role").isin(list(roles)))
    return replace(graph, nodes=nodes, links=links_within(graph.links, nodes))


def prune(graph: Graph, entity_types: Sequence[str] | None = None, relation_types: Sequence[str] | None = None,
          focus: str | None = None, hops: int = 1, max_nodes: int = 0, isolated: bool = False) -> Graph:
    """All cuts in order; aggregates are not recomputed."""
    out = keep_types(graph, entity_types, relation_types)
    if focus:
        out = keep_focus(out, focus, hops)
    out = top_risk(out, max_nodes)
    return out if isolated else drop_isolated(out)
