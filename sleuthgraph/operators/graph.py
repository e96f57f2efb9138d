"""Typed property graph: node and link aggregates, duplicate resolution, risk.

Aggregation order matters for scale.  Mentions are first collapsed per
(node, label, address, path) and links per (source, target, relation), with only
fixed-width buffers (counts, times, bit masks), so the map side combines hub
entities before anything is shuffled.  Aliases are then found and applied on
those aggregates, never on the mentions.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, values
from ..plans.lineage import cut
from .mentions import graph_mentions


@dataclass
class Graph:
    """``nodes`` keyed by node_id, ``links`` keyed by (source, target, rel)."""

    nodes: DataFrame
    links: DataFrame
    truncated: bool = False
    notes: tuple[str, ...] = ()
    aliases: DataFrame | None = None

    def cut(self) -> "Graph":
        return replace(self, nodes=cut(self.nodes), links=cut(self.links))


# --- aggregates -----------------------------------------------------------------


def _shared(count: str = "event_count") -> list[Column]:
    return [F.sum(count).alias(count), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
            F.max("max_severity").alias("max_severity"), F.bit_or("source_mask").alias("source_mask")]


def node_variants(mentions: DataFrame) -> DataFrame:
    """One row per (node, label, address, path), with counters, span and masks."""
    return mentions.groupBy("node_id", "type", "label", "ip", "path").agg(
        F.count(F.lit(1)).alias("event_count"), F.min("time").alias("first_seen"), F.max("time").alias("last_seen"),
        F.max("severity").alias("max_severity"), F.bit_or("source_mask").alias("source_mask"),
        F.bit_or("tactic_mask").alias("tactic_mask"))


def nodes_of_variants(variants: DataFrame) -> DataFrame:
    """One row per node: counters, span, masks, longest label (earliest on a tie), first known ip/path."""
    def first_known(col: str) -> Column:
        return F.expr(f"min_by({col}, struct(first_seen, {col})) FILTER (WHERE {col} IS NOT NULL)").alias(col)

    return variants.groupBy("node_id", "type").agg(
        *_shared(), F.bit_or("tactic_mask").alias("tactic_mask"),
        F.min_by("label", F.struct(-F.length("label"), "first_seen", "label")).alias("label"),
        first_known("ip"), first_known("path"))


def aggregate_nodes(mentions: DataFrame) -> DataFrame:
    """One row per node of entity mentions."""
    return nodes_of_variants(node_variants(mentions))


def aggregate_links(relations: DataFrame) -> DataFrame:
    """One row per (source, target, rel): occurrences, span, highest severity, sources."""
    return relations.groupBy("source", "target", "rel").agg(
        F.count(F.lit(1)).alias("count"), F.min("time").alias("first_seen"), F.max("time").alias("last_seen"),
        F.max("severity").alias("max_severity"), F.bit_or("source_mask").alias("source_mask"))


def node_props(mentions_with_props: DataFrame) -> DataFrame:
    """First-seen value per (node, property) in long form."""
    pairs = mentions_with_props.select("node_id", "time", "uid", F.inline("props"))
    return pairs.groupBy("node_id", F.col("key").alias("prop")).agg(
        F.min_by("value", F.struct("time", "uid")).alias("value"))


def link_details(relations: DataFrame) -> DataFrame:
    """First-seen property (port, logon type or subject, by relation) of each link."""
    return relations.where("detail IS NOT NULL").groupBy("source", "target", "rel").agg(
        F.min_by("detail", F.struct("time", "uid")).alias("detail"))


# --- duplicate entities -----------------------------------------------------------

def ip_aliases(nodes: DataFrame) -> DataFrame:
    """``ip`` -> ``host`` when exactly one host first declared that address."""
    claims = nodes.where("type = 'host' AND ip IS NOT NULL").groupBy(F.concat(F.lit("ip:"), "ip").alias("old_id")).agg(
        F.count(F.lit(1)).alias("owners"), F.min("node_id").alias("new_id"))
    return claims.where("owners = 1").select("old_id", "new_id")


def file_aliases(links: DataFrame) -> DataFrame:
    """File without a path -> the only file with a path that shares its hash."""
    hashed = links.where("rel = 'has_hash'").where(
        F.col("source").startswith("file:") & F.col("target").startswith("hash:")).select("source", "target")
    pathed = F.col("source").contains("\\")
    winners = hashed.groupBy("target").agg(
        F.count_if(pathed).alias("pathed"), F.count_if(~pathed).alias("bare"),
        F.min(F.when(pathed, F.col("source"))).alias("new_id"))
    winners = winners.where("pathed = 1 AND bare > 0").select("target", "new_id")
    return (hashed.where(~pathed).join(winners, "target").groupBy(F.col("source").alias("old_id"))
            .agg(F.min("new_id").alias("new_id")))


def process_aliases(nodes: DataFrame) -> DataFrame:
    """Process known by name -> the only process with a path of that name on the same host."""
    host = F.substring_index("node_id", "|", 1)
    path = F.expr("substring(node_id, locate('|', node_id) + 1)")
    procs = nodes.where("type = 'process' AND node_id LIKE '%|%'").select(
        "node_id", host.alias("host"), F.substring_index(path, "\\", -1).alias("name"))
    pathed = F.substring_index("node_id", "|", -1) != F.col("name")
    found = procs.groupBy("host", "name").agg(
        F.count_if(pathed).alias("pathed"), F.count(F.lit(1)).alias("n"),
        F.min(F.when(pathed, F.col("node_id"))).alias("new_id"))
    return found.where("pathed = 1 AND n > 1").select(
        F.concat_ws("|", "host", "name").alias("old_id"), "new_id")


def find_aliases(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """All three maps at once: they concern disjoint entity types."""
    return ip_aliases(nodes).unionByName(file_aliases(links)).unionByName(process_aliases(nodes))


def merge_nodes(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Fold aliased nodes into their winner, which keeps its label and fills missing properties."""
    named = nodes.join(aliases, nodes["node_id"] == aliases["old_id"], "left").withColumns({
        "won": F.col("new_id").isNull(), "new_id": F.coalesce("new_id", "node_id")})

    def own(col: str) -> Column:
        return F.max(F.when(F.col("won"), F.col(col)))

    def filled(col: str) -> Column:
        given = F.expr(f"min_by({col}, struct(first_seen, node_id)) FILTER (WHERE NOT won AND {col} IS NOT NULL)")
        return F.coalesce(own(col), given).alias(col)

    return named.groupBy(F.col("new_id").alias("node_id")).agg(
        own("type").alias("type"), own("label").alias("label"), *_shared(),
        F.bit_or("tactic_mask").alias("tactic_mask"), filled("ip"), filled("path")).where("type IS NOT NULL")


def rewire_links(links: DataFrame, aliases: DataFrame) -> DataFrame:
    """Links between resolved ends, self-loops still included."""
    ends = links
    for side in ("source", "target"):
        alias = aliases.select(F.col("old_id").alias(f"_{side}"), F.col("new_id").alias("_new"))
        ends = (ends.join(alias, F.col(side) == F.col(f"_{side}"), "left")
                .withColumn(side, F.coalesce("_new", side)).drop("_new", f"_{side}"))
    return ends.groupBy("source", "target", "rel").agg(*_shared("count"))


# --- scores -------------------------------------------------------------------------

def relation_weight(rel: Column) -> Column:
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(fixed.RELATION_WEIGHT.items())])
    return F.coalesce(F.try_element_at(known, rel), F.lit(fixed.UNKNOWN_RELATION_WEIGHT))


def end_totals(rewired: DataFrame) -> DataFrame:
    """Degree and summed relation weight per node; self-loops weigh but do not count as degree."""
    weight = relation_weight(F.col("rel")) * F.col("count")
    degree = F.when(F.col("source") != F.col("target"), 1).otherwise(0)
    ends = F.array(*[F.struct(F.col(side).alias("node_id"), weight.alias("weight"), degree.alias("degree"))
                     for side in ("source", "target")])
    return rewired.select(F.inline(ends)).groupBy("node_id").agg(
        F.sum("weight").alias("rel_weight"), F.sum("degree").alias("degree"))


def risk_weights(overrides: dict | None = None) -> dict[str, int]:
    """Default weights with known, whole-number overrides applied (never below 0)."""
    out = dict(fixed.RISK_WEIGHTS)
    for key, value in (overrides or {}).items():
        if key in out:
            try:
                out[key] = max(0, int(value))
            except (TypeError, ValueError):
                continue
    return out


def risk_score(weights: dict | None = None) -> Column:
    """0..100 from severity, tactics, degree, volume, relation weight and type."""
    w = risk_weights(weights)
    capped = lambda value, cap: F.least(value, F.lit(w[cap]).cast("bigint"))
    whole = lambda col, by: F.floor(F.col(col) / F.lit(max(w[by], 1)))
    total = (F.col("max_severity") * w["severity"]
             + capped(F.bit_count("tactic_mask").cast("bigint") * w["tactic"], "tacticCap")
             + capped(F.col("degree") * w["degree"], "degreeCap")
             + capped(whole("event_count", "volumeDivisor"), "volumeCap")
             + capped(whole("rel_weight", "weightDivisor"), "weightCap")
             + F.when(F.col("type") == "alert", w["alertBonus"]).otherwise(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")


def with_scores(nodes: DataFrame, rewired: DataFrame, weights: dict | None = None) -> DataFrame:
    scored = nodes.join(end_totals(rewired), "node_id", "left").fillna(0, ["rel_weight", "degree"])
    return scored.withColumn("risk", risk_score(weights))


def with_link_id(links: DataFrame) -> DataFrame:
    key = F.concat_ws("\u0001", "source", "target", "rel")
    return links.select(F.substring(F.sha2(key, 256), 1, 16).alias("link_id"), "*")


# --- the whole graph -----------------------------------------------------------------

PART_KEY = ["kind", "a", "b", "c", "ip", "path"]


def graph_parts(events: DataFrame) -> DataFrame:
    """Aggregates of node variants (kind 0) and links (kind 1) from one scan of the events and one shuffle.

    Counts add up, spans and masks unite: parts of several batches merge into those of all their events.
    """
    return graph_mentions(events).groupBy(*PART_KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min("time").alias("first_seen"), F.max("time").alias("last_seen"),
        F.max("severity").alias("max_severity"), F.bit_or("source_mask").alias("source_mask"), F.bit_or("tactic_mask").alias("tactic_mask"))


def merge_parts(*parts: DataFrame) -> DataFrame:
    """The parts of the events of all batches together; an event must be in one batch only."""
    return reduce(DataFrame.unionByName, parts).groupBy(*PART_KEY).agg(
        *_shared("n"), F.bit_or("tactic_mask").alias("tactic_mask"))


def graph_of_parts(parts: DataFrame, weights: dict | None = None, checkpoint: bool = True) -> Graph:
    """Resolved, scored graph of written parts; aliases are found on aggregates, never on events."""
    hold = cut if checkpoint else (lambda df: df)
    key = lambda *names: [F.col(c).alias(name) for c, name in zip("abc", names, strict=True)]
    span = ["first_seen", "last_seen", "max_severity", "source_mask"]
    nodes = hold(nodes_of_variants(parts.where("kind = 0").select(
        *key("node_id", "type", "label"), "ip", "path", F.col("n").alias("event_count"), *span, "tactic_mask")))
    links = parts.where("kind = 1").select(*key("source", "target", "rel"), F.col("n").alias("count"), *span)
    aliases = hold(find_aliases(nodes, links))
    rewired = rewire_links(links, aliases)
    return Graph(with_scores(merge_nodes(nodes, aliases), rewired, weights),
                 with_link_id(rewired.where("source <> target")), aliases=aliases)


def build_graph(events: DataFrame, weights: dict | None = None, checkpoint: bool = True) -> Graph:
    """Events -> resolved, scored graph.

    With ``checkpoint`` the parts, the nodes before resolution and the alias map are written
    once to the checkpoint folder, so that the events are scanned exactly once however
    often the result is used.
    """
    parts = graph_parts(events)
    return graph_of_parts(cut(parts) if checkpoint else parts, weights, checkpoint)


# --- reading a graph ------------------------------------------------------------------

def ordered_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("risk", "type", "label", "node_id", ascending=[False, True, True, True])


def with_names(df: DataFrame) -> DataFrame:
    """Masks as arrays: ``sources`` in name order, ``tactics`` in kill-chain order."""
    out = df.withColumn("sources", values.mask_names(F.col("source_mask"), fixed.SOURCES))
    if "tactic_mask" in df.columns:
        out = out.withColumn("tactics", values.mask_names(F.col("tactic_mask"), fixed.TACTICS))
    return out


def graph_summary(events: DataFrame, graph: Graph) -> DataFrame:
    """One row: counts, sources and window."""
    base = events.agg(F.count(F.lit(1)).alias("events"), F.min("time").alias("window_from"),
                      F.max("time").alias("window_to"),
                      F.bit_or(values.source_mask(F.col("source"))).alias("source_mask"))
    return base.select(
        "events", graph.nodes.agg(F.count(F.lit(1))).scalar().alias("nodes"),
        graph.links.agg(F.count(F.lit(1))).scalar().alias("links"), "window_from", "window_to",
        values.mask_names(F.col("source_mask"), fixed.SOURCES).alias("sources"))


def union_graphs(kept: Graph, added: Graph) -> Graph:
    """Union by id; rows already present stay as they are (node expansion)."""
    nodes = kept.nodes.unionByName(added.nodes.join(kept.nodes, "node_id", "left_anti"), allowMissingColumns=True)
    links = kept.links.unionByName(added.links.join(kept.links, ["source", "target", "rel"], "left_anti"),
                                   allowMissingColumns=True)
    return Graph(nodes, links)


def as_of(graph: Graph, moment) -> Graph:
    """Replay frame: whatever had been seen by ``moment``."""
    seen = F.col("first_seen").isNull() | (F.col("first_seen") <= F.lit(moment))
    return Graph(graph.nodes.where(seen), graph.links.where(seen))


def facet_counts(graph: Graph) -> DataFrame:
    """Counts by type, role (when assigned), source, tactic and relation: (facet, value, n)."""
    named = with_names(graph.nodes)
    facets = [named.select(F.lit("type").alias("facet"), F.col("type").alias("value")),
              named.select(F.lit("source").alias("facet"), F.explode("sources").alias("value")),
              named.select(F.lit("tactic").alias("facet"), F.explode("tactics").alias("value")),
              graph.links.select(F.lit("relation").alias("facet"), F.col("rel").alias("value"))]
    if "role" in named.columns:
        facets.append(named.select(F.lit("role").alias("facet"), F.col("role").alias("value")))
    rows = facets[0]
    for extra in facets[1:]:
        rows = rows.unionByName(extra)
    return rows.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


# --- traceability -----------------------------------------------------------------------

def node_events(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Full bridge (node_id, uid, time) with aliases resolved."""
    return (mentions.select("node_id", "uid", "time").join(aliases, F.col("node_id") == F.col("old_id"), "left")
            .select(F.coalesce("new_id", "node_id").alias("node_id"), "uid", "time").distinct())


def link_events(relations: DataFrame, aliases: DataFrame) -> DataFrame:
    """Full bridge (source, target, rel, uid, time) with aliases resolved."""
    ends = relations.select("source", "target", "rel", "uid", "time")
    for side in ("source", "target"):
        alias = aliases.select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new"))
        ends = ends.join(alias, F.col(side) == F.col("_old"), "left").withColumn(
            side, F.coalesce("_new", side)).drop("_old", "_new")
    return ends.where("source <> target").distinct()


def former_ids(aliases: DataFrame, nodes: DataFrame) -> DataFrame:
    """(old_id, node_id): every id under which the given nodes (frame with node_id) are mentioned."""
    wanted = nodes.select("node_id").distinct()
    merged = aliases.join(wanted, F.col("new_id") == F.col("node_id"), "left_semi").select("old_id", F.col("new_id").alias("node_id"))
    own = wanted.join(aliases, F.col("node_id") == F.col("old_id"), "left_anti").select(F.col("node_id").alias("old_id"), "node_id")
    return own.unionByName(merged)


def events_of_nodes(mentions: DataFrame, aliases: DataFrame, nodes: DataFrame) -> DataFrame:
    """The bridge (node_id, uid, time) of some nodes only: mentions meet their few former ids, and nothing else is kept."""
    ids = cut(former_ids(aliases, nodes))
    return (mentions.select(F.col("node_id").alias("old_id"), "uid", "time").join(ids, "old_id")
            .select("node_id", "uid", "time").distinct())


def links_of_nodes(relations: DataFrame, aliases: DataFrame, nodes: DataFrame) -> DataFrame:
    """The bridge (source, target, rel, uid, time) of the links that touch some nodes only."""
    ids = cut(former_ids(aliases, nodes)).select("old_id")
    touching = relations
    for side in ("source", "target"):
        touching = touching.join(ids.withColumnRenamed("old_id", f"_{side}"), F.col(side) == F.col(f"_{side}"), "left")
    return link_events(touching.where("_source IS NOT NULL OR _target IS NOT NULL"), aliases)


def sample_uids(bridge: DataFrame, keys: list[str], cap: int = 200, salts: int = 64) -> DataFrame:
    """First ``cap`` uids per key in time order.

    Two ranking steps: a hub key is first ranked in salted parts, so no task
    sorts all of it; the parts' survivors are ranked again.
    """
    from pyspark.sql import Window

    salt = F.pmod(F.xxhash64("uid"), F.lit(salts))
    part = bridge.withColumn("_salt", salt)
    for by in (["_salt"], []):
        rank = F.row_number().over(Window.partitionBy(*keys, *by).orderBy("time", "uid"))
        part = part.withColumn("_n", rank).where(F.col("_n") <= cap)
    return part.drop("_salt").withColumnRenamed("_n", "position")
