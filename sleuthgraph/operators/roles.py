"""Incident roles: who is hostile, who is a victim, what is context."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon, fixed, values
from ..plans.lineage import cut
from .graph import Graph

HOSTILE_MASK = values.mask_of(fixed.HOSTILE_TACTICS, fixed.TACTICS)
VICTIM_MASK = values.mask_of(fixed.VICTIM_TACTICS, fixed.TACTICS)


def is_external(nodes_type: Column, label: Column, ip: Column) -> Column:
    """Outside the perimeter: domains, URLs, public addresses, hosts with a public address."""
    return (F.when(nodes_type.isin("domain", "url"), F.lit(True))
            .when(nodes_type == "ip", ~canon.is_private_ip(label))
            .when((nodes_type == "host") & ip.isNotNull(), ~canon.is_private_ip(ip))
            .otherwise(F.lit(False)))


def neighbours(links: DataFrame) -> DataFrame:
    """Two-way link ends (node_id, other)."""
    return links.select(F.inline(F.array(
        F.struct(F.col("source").alias("node_id"), F.col("target").alias("other")),
        F.struct(F.col("target").alias("node_id"), F.col("source").alias("other")))))


def alert_evidence(graph: Graph) -> DataFrame:
    """Tactics and severity that alerts bring to each neighbour."""
    alerts = graph.nodes.where("type = 'alert'").select(
        F.col("node_id").alias("other"), F.col("tactic_mask").alias("alert_mask"),
        F.col("max_severity").alias("alert_severity"))
    # Only links with an alert end can match, and the end's type is its id prefix.
    pairs = neighbours(graph.links).where(F.col("other").startswith("alert:"))
    return pairs.join(alerts, "other").groupBy("node_id").agg(
        F.bit_or("alert_mask").alias("alert_mask"), F.max("alert_severity").alias("alert_severity"))


def decide_role(kind: Column, external: Column, tactics: Column, severity: Column, touched: Column) -> Column:
    hits = lambda mask: tactics.bitwiseAND(F.lit(mask)) != 0
    some = tactics != 0
    return (F.when(kind == "alert", "hostile")
            .when(external & kind.isin(fixed.NETWORK_TYPES),
                  F.when(hits(HOSTILE_MASK) | touched | (severity >= 4), "hostile").otherwise("neutral"))
            .when(kind.isin(fixed.CONTEXT_TYPES), F.when((severity >= 4) | some, "suspicious").otherwise("neutral"))
            .when((severity >= 4) | hits(VICTIM_MASK), "victim")
            .when((severity >= 3) | some | touched, "suspicious")
            .otherwise("asset"))


def first_roles(graph: Graph) -> DataFrame:
    """External flag, alert contact and role from the node's own and its alerts' evidence."""
    joined = graph.nodes.join(alert_evidence(graph), "node_id", "left").withColumns({
        "touched_by_alert": F.col("alert_mask").isNotNull(),
        "_tactics": F.col("tactic_mask").bitwiseOR(F.coalesce("alert_mask", F.lit(0))),
        "_severity": F.greatest("max_severity", F.coalesce("alert_severity", F.lit(0))),
        "external": is_external(F.col("type"), F.col("label"), F.col("ip")),
    })
    role = decide_role(F.col("type"), F.col("external"), F.col("_tactics"), F.col("_severity"), F.col("touched_by_alert"))
    return joined.withColumns({
        "role": role, "device_class": F.when(F.col("type") == "host", canon.device_class(F.col("label"))),
    }).drop("alert_mask", "alert_severity", "_tactics", "_severity")


def hostile_addresses(nodes: DataFrame) -> DataFrame:
    """Mailboxes, users and accounts under a hostile domain become hostile and external.

    The suffix test is an equality join: each address offers all its parent
    domains, and only those that are hostile match.
    """
    text = F.lower(canon.strip(F.col("label")))
    domain = F.when(F.col("type").isin("mailbox", "user", "account") & text.contains("@"),
                    F.substring_index(text, "@", -1))
    labels = F.split(domain, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hostile = nodes.where("type IN ('domain', 'url') AND role = 'hostile'").select(
        F.lower("label").alias("suffix")).distinct()
    owned = (nodes.where(domain.isNotNull()).select("node_id", F.explode_outer(suffixes).alias("suffix"))
             .join(hostile, "suffix", "left_semi").select("node_id").distinct().withColumn("_owned", F.lit(True)))
    return nodes.join(owned, "node_id", "left").withColumns({
        "role": F.when(F.col("_owned"), "hostile").otherwise(F.col("role")),
        "external": F.coalesce("_owned", "external"),
    }).drop("_owned")


def promote_context(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Neutral context becomes suspicious by severity, tactics or a victim next to it."""
    victims = nodes.where("role = 'victim'").select(F.col("node_id").alias("other"))
    waiting = F.col("type").isin(fixed.CONTEXT_TYPES) & (F.col("role") == "neutral")
    beside = (neighbours(links).where(F.substring_index("node_id", ":", 1).isin(fixed.CONTEXT_TYPES)).distinct()
              .join(victims, "other", "left_semi").select("node_id").distinct().withColumn("_beside", F.lit(True)))
    raised = waiting & ((F.col("max_severity") >= 3) | (F.col("tactic_mask") != 0) | F.coalesce("_beside", F.lit(False)))
    return nodes.join(beside, "node_id", "left").withColumn(
        "role", F.when(raised, "suspicious").otherwise(F.col("role"))).drop("_beside")


def assign_roles(graph: Graph) -> Graph:
    # written: the two steps after it read it four times
    nodes = hostile_addresses(cut(first_roles(graph)))
    return replace(graph, nodes=promote_context(nodes, graph.links))


def annotate_tools(graph: Graph, binaries: DataFrame, tools: DataFrame) -> Graph:
    """Known tools on process and file nodes, by label first, then by path, with category, its label and groups.

    ``binaries`` is the pattern dimension (pattern, tool), ``tools`` the tool dimension of the catalog.
    """
    path = F.coalesce("path", F.regexp_replace("node_id", r"^[^|]*\|", ""))
    named = graph.nodes.withColumns({
        "_label": F.when(F.col("type").isin("process", "file"), canon.lower_basename(F.col("label"))),
        "_path": F.when(F.col("type").isin("process", "file"), canon.lower_basename(path)),
    })
    for column in ("_label", "_path"):
        dim = binaries.select(F.col("pattern").alias(column), F.col("tool").alias(f"{column}_tool"))
        named = named.join(dim, column, "left")
    tool = F.coalesce("_label_tool", "_path_tool")
    raised = tool.isNotNull() & F.coalesce(F.col("role").isin("neutral", "asset"), F.lit(True))
    nodes = named.withColumns({
        "tool": tool, "role": F.when(raised, "suspicious").otherwise(F.col("role")),
    }).select(*graph.nodes.columns, "tool")
    about = tools.select(F.col("name").alias("tool"), F.col("category").alias("tool_category"),
                         F.col("category_label").alias("tool_label"), F.col("groups").alias("tool_groups"))
    return replace(graph, nodes=nodes.join(about, "tool", "left").select(
        *graph.nodes.columns, "tool", "tool_category", "tool_label", "tool_groups"))


def known_tools(nodes: DataFrame) -> DataFrame:
    """One row: how many nodes are known tools, and how many tools that are."""
    return nodes.agg(F.count("tool").alias("nodes_with_tool"), F.count_distinct("tool").alias("tools"))


def nodes_by_role(nodes: DataFrame, role: str) -> DataFrame:
    return nodes.where(F.coalesce("role", F.lit("neutral")) == role)
