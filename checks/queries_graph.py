"""Extraction, graph, pruning and role queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sleuthgraph.functions import fixed
from sleuthgraph.operators import events as e
from sleuthgraph.operators import graph as g
from sleuthgraph.operators import iterate
from sleuthgraph.operators import mentions as m
from sleuthgraph.operators import prune as p
from sleuthgraph.operators import roles as r
from sleuthgraph.operators import threat
from sleuthgraph.plans import incident
from sleuthgraph.plans.lineage import cut

from . import oracle_text  # noqa: F401  (adds SQL steps)
from . import workload as w
from .catalog import catalog
from .oracle import STEPS, basename, sql
from .registry import micros, query


def built(spark, sf):
    return g.build_graph(w.events(spark, sf))


NODE_COLUMNS = ("node_id, type, label, ip, path, CAST(event_count AS BIGINT) AS event_count, "
                "epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen, "
                "CAST(max_severity AS BIGINT) AS max_severity, CAST(source_mask AS BIGINT) AS source_mask, "
                "CAST(tactic_mask AS BIGINT) AS tactic_mask")
LINK_COLUMNS = ("source, target, rel, CAST(count AS BIGINT) AS count, epoch_us(first_seen) AS first_seen, "
                "epoch_us(last_seen) AS last_seen, CAST(max_severity AS BIGINT) AS max_severity, "
                "CAST(source_mask AS BIGINT) AS source_mask")


def node_rows(df, *extra):
    return df.select("node_id", "type", "label", "ip", "path", "event_count", micros("first_seen").alias("first_seen"),
                     micros("last_seen").alias("last_seen"), F.col("max_severity").cast("bigint").alias("max_severity"),
                     F.col("source_mask").cast("bigint").alias("source_mask"),
                     F.col("tactic_mask").cast("bigint").alias("tactic_mask"), *extra)


def link_rows(df):
    return df.select("source", "target", "rel", "count", micros("first_seen").alias("first_seen"),
                     micros("last_seen").alias("last_seen"), F.col("max_severity").cast("bigint").alias("max_severity"),
                     F.col("source_mask").cast("bigint").alias("source_mask"))


@query(sql("SELECT uid, node_id, type, label, ip, path FROM mentions", "mentions"))
def entity_mentions(spark, sf):
    return m.entity_mentions(w.events(spark, sf)).select("uid", "node_id", "type", "label", "ip", "path")


@query(sql("SELECT uid, source, target, rel, detail FROM relations", "relations"))
def relation_mentions(spark, sf):
    return m.relation_mentions(w.events(spark, sf)).select("uid", "source", "target", "rel", "detail")


@query(sql(f"SELECT {NODE_COLUMNS} FROM nodes0", "nodes0"))
def node_aggregate(spark, sf):
    return node_rows(g.aggregate_nodes(m.entity_mentions(w.events(spark, sf))))


@query(sql(f"SELECT {LINK_COLUMNS} FROM links0", "links0"))
def link_aggregate(spark, sf):
    return link_rows(g.aggregate_links(m.relation_mentions(w.events(spark, sf))))


@query(sql("SELECT old_id, new_id FROM alias", "alias"))
def entity_aliases(spark, sf):
    events = w.events(spark, sf)
    return g.find_aliases(g.aggregate_nodes(m.entity_mentions(events)), g.aggregate_links(m.relation_mentions(events)))


@query(sql(f"SELECT {NODE_COLUMNS}, CAST(rel_weight AS BIGINT) AS rel_weight, CAST(degree AS BIGINT) AS degree, risk "
           "FROM nodes", "nodes"))
def node_risk(spark, sf):
    return g.ordered_nodes(node_rows(built(spark, sf).nodes, "rel_weight", "degree", "risk"))


@query(sql(f"SELECT {LINK_COLUMNS} FROM links", "links"))
def merged_links(spark, sf):
    return link_rows(built(spark, sf).links)


@query(sql("SELECT node_id, risk, role, outside AS external, touched_by_alert FROM roles", "roles"))
def node_roles(spark, sf):
    return r.assign_roles(built(spark, sf)).nodes.select("node_id", "risk", "role", "external", "touched_by_alert")


# --- reading and pruning ---------------------------------------------------------------------

@query(sql("""SELECT count(*) AS events, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM links) AS links,
  epoch_us(min(time)) AS window_from, epoch_us(max(time)) AS window_to, string_agg(DISTINCT source, ',' ORDER BY source) AS sources
  FROM ev""", "nodes", "ev"))
def graph_summary(spark, sf):
    events = w.events(spark, sf)
    return g.graph_summary(events, g.build_graph(events)).select(
        "events", "nodes", "links", micros("window_from").alias("window_from"), micros("window_to").alias("window_to"),
        F.array_join("sources", ",").alias("sources"))


@query(sql("""SELECT node_id, prop, value FROM (
  SELECT node_id, 'cmdline' AS prop, first(cmd ORDER BY time, uid) AS value FROM (
    SELECT k.uid, ev.time, k.proc_key AS node_id, CASE WHEN k.class_name = 'Process Activity' THEN k.proc_cmdline END AS cmd
    FROM keyed k JOIN ev USING (uid)) WHERE node_id IS NOT NULL AND cmd IS NOT NULL GROUP BY node_id
  UNION ALL SELECT node_id, 'domain', first(actor_domain ORDER BY time, uid) FROM (
    SELECT uid, time, user_key AS node_id, actor_domain FROM keyed WHERE class_name NOT IN ('Email Activity', 'DNS Activity'))
    WHERE node_id IS NOT NULL AND actor_domain IS NOT NULL GROUP BY node_id)""", "keyed", "ev"))
def node_properties(spark, sf):
    return g.node_props(m.entity_mentions(w.events(spark, sf), with_props=True)).where("prop IN ('cmdline', 'domain')")


@query(sql("""SELECT source, target, rel, first(detail ORDER BY time, uid) AS detail FROM relations JOIN facts USING (uid)
  WHERE detail IS NOT NULL GROUP BY source, target, rel""", "relations", "facts"))
def link_properties(spark, sf):
    return g.link_details(m.relation_mentions(w.events(spark, sf)))


@query(sql("""SELECT node_id, uid, n AS position FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY time, uid) AS n
  FROM (SELECT DISTINCT coalesce(new_id, node_id) AS node_id, uid, time FROM mentions JOIN facts USING (uid)
        LEFT JOIN alias ON node_id = old_id)) WHERE n <= 200""", "mentions", "facts", "alias"))
def node_event_sample(spark, sf):
    events = w.events(spark, sf)
    bridge = g.node_events(m.entity_mentions(events), g.build_graph(events).aliases)
    return g.sample_uids(bridge, ["node_id"]).select("node_id", "uid", F.col("position").cast("bigint").alias("position"))


TOP_USER = "(SELECT node_id FROM nodes WHERE type = 'user' ORDER BY risk DESC, label, node_id LIMIT 1)"


def top_user(graph):
    return g.ordered_nodes(graph.nodes.where("type = 'user'")).first().node_id


@query(sql(f"""SELECT DISTINCT uid FROM mentions LEFT JOIN alias ON node_id = old_id
  WHERE coalesce(new_id, node_id) = {TOP_USER}""", "mentions", "alias", "nodes"))
def events_behind_node(spark, sf):
    events = w.events(spark, sf)
    graph = g.build_graph(events)
    chosen = spark.createDataFrame([(top_user(graph),)], "node_id string")
    return e.events_of_node(events, chosen, g.events_of_nodes(m.entity_mentions(events), graph.aliases, chosen), limit=None).select("uid")


TOP_LINK = "(SELECT (source, target, rel) FROM links ORDER BY count DESC, source, target, rel LIMIT 1)"


@query(sql(f"""SELECT DISTINCT uid FROM relations LEFT JOIN alias a ON source = a.old_id LEFT JOIN alias b ON target = b.old_id
  WHERE (coalesce(a.new_id, source), coalesce(b.new_id, target), rel) = {TOP_LINK}""", "relations", "alias", "links"))
def events_of_link(spark, sf):
    """Events behind the most frequent link."""
    events = w.events(spark, sf)
    graph = g.build_graph(events)
    link = cut(graph.links.orderBy(F.desc("count"), "source", "target", "rel").limit(1).select("source", "target", "rel"))
    ends = link.select(F.explode(F.array("source", "target")).alias("node_id"))
    return e.events_of_link(events, link, g.links_of_nodes(m.relation_mentions(events), graph.aliases, ends)).select("uid")


@query(sql(f"SELECT {NODE_COLUMNS}, risk FROM nodes", "nodes"))
def graph_of_two_batches(spark, sf):
    """The graph of half of the events, brought up to date with the other half."""
    events = w.events(spark, sf)
    half = F.pmod(F.xxhash64("uid"), F.lit(2)) == 0
    kept, added = cut(g.graph_parts(events.where(half))), g.graph_parts(events.where(~half))
    return node_rows(g.graph_of_parts(cut(g.merge_parts(kept, added))).nodes, "risk")


@query(sql("""SELECT 'node' AS kind, node_id AS id FROM nodes WHERE type IN ('user', 'host', 'ip')
  UNION ALL SELECT 'link', source || '>' || rel || '>' || target FROM links WHERE
  (split_part(source, ':', 1) IN ('user', 'host') AND split_part(target, ':', 1) IN ('user', 'host')) OR
  (split_part(source, ':', 1) IN ('ip', 'host') AND split_part(target, ':', 1) IN ('ip', 'host'))""", "nodes", "links"))
def united_graphs(spark, sf):
    graph = built(spark, sf)
    both = g.union_graphs(p.keep_types(graph, ["user", "host"]), p.keep_types(graph, ["ip", "host"]))
    return both.nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("id")).unionByName(
        both.links.select(F.lit("link").alias("kind"), F.concat_ws(">", "source", "rel", "target").alias("id")))


@query(sql("""SELECT 'node' AS kind, type AS value, count(*) AS n FROM nodes WHERE first_seen <= TIMESTAMP '2024-01-05 06:00:00' GROUP BY type
  UNION ALL SELECT 'link', rel, count(*) FROM links WHERE first_seen <= TIMESTAMP '2024-01-05 06:00:00' GROUP BY rel""", "nodes", "links"))
def replay_frame(spark, sf):
    frame = g.as_of(built(spark, sf), dt.datetime(2024, 1, 5, 6, tzinfo=dt.timezone.utc))
    n = F.count(F.lit(1)).alias("n")
    return frame.nodes.groupBy(F.lit("node").alias("kind"), F.col("type").alias("value")).agg(n).unionByName(
        frame.links.groupBy(F.lit("link").alias("kind"), F.col("rel").alias("value")).agg(n))


@query(sql("""SELECT 'type' AS facet, type AS value, count(*) AS n FROM roles GROUP BY type
  UNION ALL SELECT 'role', role, count(*) FROM roles GROUP BY role UNION ALL SELECT 'relation', rel, count(*) FROM links GROUP BY rel
  """ + "".join(f" UNION ALL SELECT 'source', '{s}', count(*) FROM roles WHERE (source_mask & {1 << i}) <> 0 HAVING count(*) > 0"
                for i, s in enumerate(fixed.SOURCES))
    + "".join(f" UNION ALL SELECT 'tactic', '{t}', count(*) FROM roles WHERE (tactic_mask & {1 << i}) <> 0 HAVING count(*) > 0"
              for i, t in enumerate(fixed.TACTICS)), "roles", "links"))
def graph_facets(spark, sf):
    return g.facet_counts(r.assign_roles(built(spark, sf)))


KEPT = "split_part(source, ':', 1) IN ('user', 'host', 'process') AND split_part(target, ':', 1) IN ('user', 'host', 'process')"


@query(sql(f"""SELECT source, target, rel, CAST(count AS BIGINT) AS count FROM links
  WHERE {KEPT} AND rel IN ('executed', 'authenticated', 'lateral')""", "links"))
def links_of_kept_types(spark, sf):
    return p.keep_types(built(spark, sf), ["User", "host", "process"], ["executed", "authenticated", "lateral"]).links.select(
        "source", "target", "rel", "count")


def _hops(n: int) -> dict[str, str]:
    steps = {"h0": f"SELECT {TOP_USER} AS node_id, 0 AS distance"}
    for i in range(1, n + 1):
        steps[f"h{i}"] = (f"SELECT node_id, min(distance) AS distance FROM (SELECT * FROM h{i - 1} UNION ALL "
                          f"SELECT p.other, {i} FROM pairs p JOIN h{i - 1} h ON h.node_id = p.node_id) GROUP BY node_id")
    return steps


STEPS.update({name: (text, ["nodes", "pairs"] + ([f"h{int(name[1:]) - 1}"] if name != "h0" else []))
              for name, text in _hops(3).items()})


@query(sql("SELECT node_id, CAST(distance AS INTEGER) AS distance FROM h3", "h3"))
def node_neighborhood(spark, sf):
    graph = built(spark, sf).cut()
    return p.neighborhood(graph.links, top_user(graph), 3)


@query(sql("SELECT node_id, risk FROM nodes JOIN h1 USING (node_id)", "nodes", "h1"))
def neighbours_of(spark, sf):
    """Expansion of the riskiest user by one step."""
    events = w.events(spark, sf)
    graph = g.build_graph(events).cut()
    return incident.neighbours_of(events, top_user(graph), built=graph).nodes.select("node_id", "risk")


@query(sql("SELECT node_id, risk FROM nodes ORDER BY risk DESC, type, label, node_id LIMIT 50", "nodes"))
def riskiest_nodes(spark, sf):
    return p.top_risk(built(spark, sf).cut(), 50).nodes.select("node_id", "risk")


@query(sql(f"""SELECT node_id FROM nodes WHERE type IN ('user', 'host', 'process') AND (risk >= 60 OR node_id IN (
  SELECT source FROM links WHERE {KEPT} AND rel = 'lateral' UNION SELECT target FROM links WHERE {KEPT} AND rel = 'lateral'))""",
           "nodes", "links"))
def connected_nodes(spark, sf):
    return p.prune(built(spark, sf), ["user", "host", "process"], ["lateral"]).nodes.select("node_id")


@query(sql("""SELECT source, target, rel FROM links JOIN roles a ON a.node_id = source AND a.role IN ('hostile', 'victim')
  JOIN roles b ON b.node_id = target AND b.role IN ('hostile', 'victim')""", "links", "roles"))
def links_between_roles(spark, sf):
    return p.keep_roles(r.assign_roles(built(spark, sf)), ["hostile", "victim"]).links.select("source", "target", "rel")


KNOWN_TOOLS = ("""SELECT node_id, t.tool, d.category, d.category_label, CAST(d.n_groups AS INTEGER) AS n_groups,
    CASE WHEN t.tool IS NOT NULL AND role IN ('neutral', 'asset') THEN 'suspicious' ELSE role END AS role
  FROM (SELECT r.*, coalesce(a.tool, b.tool) AS tool FROM roles r
    LEFT JOIN bin_d a ON type IN ('process', 'file') AND lower(""" + basename("label") + """) = a.pattern
    LEFT JOIN bin_d b ON type IN ('process', 'file') AND lower(""" + basename("coalesce(path, regexp_replace(node_id, '^[^|]*[|]', ''))")
    + """) = b.pattern) t LEFT JOIN tool_d d USING (tool)""")


def with_tools(spark, sf):
    tools = catalog(spark).tools
    return r.annotate_tools(r.assign_roles(built(spark, sf)), threat.binary_index(tools), tools).nodes


@query(sql(KNOWN_TOOLS, "roles", "bin_d", "tool_d"))
def nodes_with_known_tools(spark, sf):
    return with_tools(spark, sf).select("node_id", "tool", F.col("tool_category").alias("category"), F.col("tool_label").alias("category_label"),
                                        F.when(F.col("tool").isNotNull(), F.size("tool_groups")).alias("n_groups"), "role")


@query(sql(f"SELECT count(tool) AS nodes_with_tool, count(DISTINCT tool) AS tools FROM ({KNOWN_TOOLS})", "roles", "bin_d", "tool_d"))
def known_tool_counts(spark, sf):
    return r.known_tools(with_tools(spark, sf))


@query(sql("SELECT node_id, risk FROM roles WHERE role = 'hostile'", "roles"))
def hostile_nodes(spark, sf):
    return r.nodes_by_role(r.assign_roles(built(spark, sf)).nodes, "hostile").select("node_id", "risk")


# --- iterative -----------------------------------------------------------------------------------

LEVEL_ROUNDS = 8
STEPS["v0"] = ("SELECT node_id, CASE " + " ".join(f"WHEN (tactic_mask & {1 << i}) <> 0 THEN {i}" for i in range(14))
               + " END AS level FROM nodes WHERE tactic_mask <> 0", ["nodes"])
for _i in range(1, LEVEL_ROUNDS + 1):
    STEPS[f"v{_i}"] = (f"""SELECT * FROM v{_i - 1} UNION ALL SELECT p.node_id, min(v.level) FROM pairs p JOIN v{_i - 1} v
      ON v.node_id = p.other WHERE p.node_id NOT IN (SELECT node_id FROM v{_i - 1}) GROUP BY p.node_id""", [f"v{_i - 1}", "pairs"])
RANKS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.ENTITY_RANK.items())


@query(sql(f"""SELECT node_id, CAST(dense_rank() OVER (ORDER BY level) - 1 AS INTEGER) AS level FROM (
  SELECT n.node_id, coalesce(v.level, CASE n.type {RANKS} ELSE 9 END) AS level FROM nodes n LEFT JOIN v{LEVEL_ROUNDS} v USING (node_id))""",
           f"v{LEVEL_ROUNDS}", "nodes"))
def kill_chain_levels(spark, sf):
    return iterate.assign_levels(built(spark, sf).cut()).select("node_id", "level")


LABEL_ROUNDS = 12


def communities_sql(nodes: str, links: str) -> str:
    """Label rounds unrolled: most frequent label among oneself and the neighbours, the smallest on a tie."""
    steps = [f"edges AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT source AS a, target AS b FROM ({links}) UNION ALL "
             f"SELECT target, source FROM ({links})))", f"lab0 AS MATERIALIZED (SELECT node_id, node_id AS label FROM ({nodes}))"]
    for k in range(1, LABEL_ROUNDS + 1):
        steps.append(f"""lab{k} AS MATERIALIZED (SELECT node_id, label FROM (SELECT node_id, label, row_number() OVER (
          PARTITION BY node_id ORDER BY count(*) DESC, label) AS place FROM (SELECT e.b AS node_id, l.label FROM edges e
          JOIN lab{k - 1} l ON l.node_id = e.a UNION ALL SELECT node_id, label FROM lab{k - 1}) GROUP BY node_id, label) WHERE place = 1)""")
    return ", ".join(steps)


CLUSTERS = f"""SELECT l.node_id, r.cluster FROM lab{LABEL_ROUNDS} l JOIN (SELECT label,
  row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS cluster FROM lab{LABEL_ROUNDS} GROUP BY label) r USING (label)"""


@query(sql(f", {communities_sql('SELECT node_id FROM nodes', 'SELECT source, target FROM links')} {CLUSTERS}", "nodes", "links"))
def node_communities(spark, sf):
    return iterate.assign_clusters(built(spark, sf).cut()).select("node_id", "cluster")


@query(sql(f""", kept AS (SELECT * FROM roles WHERE risk >= 60 OR node_id IN (SELECT node_id FROM pairs)),
  {communities_sql('SELECT node_id FROM kept', 'SELECT source, target FROM links')}
  SELECT k.node_id, k.risk, k.role, c.cluster, l.level FROM kept k JOIN ({CLUSTERS}) c USING (node_id) JOIN (
    SELECT node_id, CAST(dense_rank() OVER (ORDER BY level) - 1 AS INTEGER) AS level FROM (
      SELECT n.node_id, coalesce(v.level, CASE n.type {RANKS} ELSE 9 END) AS level FROM kept n LEFT JOIN v{LEVEL_ROUNDS} v USING (node_id))) l
    USING (node_id)""", "roles", "pairs", "links", f"v{LEVEL_ROUNDS}", ev_filter="severity >= 3"))
def filtered_incident_graph(spark, sf):
    graph = incident.filtered_graph(w.events(spark, sf), min_severity=3)
    return graph.nodes.select("node_id", "risk", "role", "cluster", "level")


# --- a larger graph from the order tables ------------------------------------------------------------

def trade_relations(spark, sf):
    """Customers reach suppliers through order lines: one relation mention per line."""
    w.tune(spark)
    lines = w.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_discount")
    orders = w.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("uid"), F.col("l_shipdate").cast("timestamp").alias("time"),
        F.when(F.col("l_discount") >= 0.08, 4).otherwise(2).alias("severity"), F.lit(2).alias("source_mask"),
        F.concat(F.lit("user:c"), "o_custkey").alias("source"), F.concat(F.lit("host:s"), "l_suppkey").alias("target"),
        F.when(F.col("l_linenumber") == 1, "authenticated").otherwise("connected").alias("rel"))


@query("""SELECT 'user:c' || o_custkey AS source, 'host:s' || l_suppkey AS target,
  CASE WHEN l_linenumber = 1 THEN 'authenticated' ELSE 'connected' END AS rel, count(*) AS count,
  epoch_us(min(l_shipdate)) AS first_seen, epoch_us(max(l_shipdate)) AS last_seen,
  CAST(max(CASE WHEN l_discount >= 0.08 THEN 4 ELSE 2 END) AS BIGINT) AS max_severity, CAST(2 AS BIGINT) AS source_mask
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""")
def trade_links(spark, sf):
    return link_rows(g.aggregate_links(trade_relations(spark, sf)))


@query("""WITH l AS (SELECT 'user:c' || o_custkey AS s, 'host:s' || l_suppkey AS t, l_linenumber = 1 AS a
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  e AS (SELECT s AS node_id, a, s, t FROM l UNION ALL SELECT t, a, s, t FROM l)
  SELECT node_id, CAST(count(*) * 3 AS BIGINT) AS rel_weight, count(DISTINCT (s, t, a)) AS degree FROM e GROUP BY node_id""")
def trade_degrees(spark, sf):
    return g.end_totals(g.aggregate_links(trade_relations(spark, sf))).select("node_id", "rel_weight", F.col("degree").cast("bigint").alias("degree"))


TRADES = "SELECT DISTINCT 'user:c' || o_custkey AS source, 'host:s' || l_suppkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query(f"""WITH trades AS MATERIALIZED ({TRADES}), {communities_sql("SELECT source AS node_id FROM trades UNION SELECT target FROM trades",
       "SELECT source, target FROM trades")} SELECT node_id, label FROM lab{LABEL_ROUNDS}""")
def trade_communities(spark, sf):
    links = cut(g.aggregate_links(trade_relations(spark, sf)))
    nodes = links.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    return iterate.label_propagation(nodes, links)
