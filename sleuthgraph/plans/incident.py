"""Composite jobs: filtered graph, threat assessment, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame

from ..operators import attribution, report, threat
from ..operators.events import filter_events
from ..operators.graph import Graph, build_graph
from ..operators.iterate import assign_clusters, assign_levels
from ..operators.prune import prune
from ..operators.roles import annotate_tools, assign_roles
from .lineage import cut


def with_roles(graph: Graph, catalog: threat.Catalog | None = None) -> Graph:
    """Roles (and known tools) of a graph whose links are written: of the result only the nodes are."""
    graph = assign_roles(graph)
    if catalog is not None:
        graph = annotate_tools(graph, threat.binary_index(catalog.tools), catalog.tools)
    return replace(graph, nodes=cut(graph.nodes))


def filtered_graph(events: DataFrame, *, entity_types: Sequence[str] | None = None,
                   relation_types: Sequence[str] | None = None, focus: str | None = None, hops: int = 1,
                   max_nodes: int = 0, weights: dict | None = None, catalog: threat.Catalog | None = None,
                   clusters: bool = True, levels: bool = True, built: Graph | None = None, **event_filters) -> Graph:
    """Filter, build, prune, enrich, level.

    Roles are decided on the pruned graph on purpose: they depend on the
    neighbours that are still visible.  ``built`` is the graph of the filtered
    events, if it is at hand; the events are then not read again.
    """
    whole = build_graph(filter_events(events, **event_filters), weights).cut() if built is None else built
    graph = prune(whole, entity_types, relation_types, focus, hops, max_nodes)
    if built is not None or graph.links is not whole.links:
        graph = replace(graph, links=cut(graph.links))
    graph = with_roles(graph, catalog)
    if clusters:
        graph = replace(graph, nodes=cut(assign_clusters(graph)))
    if levels:
        graph = replace(graph, nodes=cut(assign_levels(graph)))
    return graph


def neighbours_of(events: DataFrame, node_id: str, hops: int = 1, min_severity: int = 0,
                  max_nodes: int = 0, built: Graph | None = None) -> Graph:
    """Expansion of one node: its neighbourhood, enriched; ``built`` is the graph of the events from ``min_severity`` on, if at hand."""
    return filtered_graph(events, focus=node_id, hops=hops, min_severity=min_severity, max_nodes=max_nodes, built=built)


def threat_assessment(events: DataFrame, catalog: threat.Catalog, limit: int | None = threat.STAGE_EVIDENCE,
                      **event_filters) -> dict[str, DataFrame]:
    """Detection and attribution tables over the filtered events, findings written once; ``limit`` pieces of evidence a stage."""
    found = threat.scan(filter_events(events, **event_filters), catalog)
    found = threat.Findings(cut(found.tools), cut(found.notes), cut(found.behaviours))
    ladder = threat.stage_ladder(found, events.sparkSession, limit)
    return {
        "tools": found.tools, "notes": found.notes, "behaviours": threat.distinct_behaviours(found.behaviours),
        "counts": threat.threat_counts(found), "by_category": threat.tools_by_category(found.tools),
        "stages": ladder, "next_stage": threat.next_stage(ladder), "severity_floor": threat.severity_floor(found),
        "candidates": attribution.attribute(found, catalog),
        "unhelpful_tools": attribution.unhelpful_tools(found, catalog),
    }


def incident_report(events: DataFrame, graph: Graph, catalog: threat.Catalog | None = None) -> dict[str, DataFrame]:
    """All report sections over one enriched graph."""
    entries = cut(report.narrative(events))
    stages = cut(report.kill_chain(graph.nodes, entries))
    out = {
        "title": report.title(graph.nodes), "summary": report.summary(events, graph), "narrative": entries,
        "kill_chain": stages, "entities": report.entity_table(graph.nodes),
        "indicators": report.ordered_indicators(graph.nodes),
    }
    ladder = None
    if catalog is not None:
        assessed = threat_assessment(events, catalog)
        ladder = assessed["stages"]
        out.update({f"threat_{k}": v for k, v in assessed.items()})
    out["recommendations"] = report.recommendations(stages, ladder)
    return out
