"""Threat, attribution, story and report queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sleuthgraph.functions import fixed
from sleuthgraph.operators import attribution as a
from sleuthgraph.operators import graph as g
from sleuthgraph.operators import mentions as m
from sleuthgraph.operators import report as rp
from sleuthgraph.operators import roles as r
from sleuthgraph.operators import threat as t
from sleuthgraph.plans import incident
from sleuthgraph.plans.lineage import cut

from . import catalog as cat
from . import oracle_text  # noqa: F401  (adds SQL steps)
from . import workload as w
from .oracle import STEPS, lst, q, source_bit, sql, is_private, tactic_of
from .queries_graph import TOP_USER, built, top_user
from .registry import micros, query

joined = lambda col: F.array_join(col, ",")


# --- catalog ---------------------------------------------------------------------------------

@query(sql("""SELECT p.pattern, p.tool, p.kind, count(e.uid) AS events FROM (
    SELECT pattern, tool, 'binary' AS kind FROM bin_d UNION ALL SELECT pattern, tool, 'fragment' FROM frag_d) p
  LEFT JOIN ev e ON lower(e.proc_name) = p.pattern GROUP BY ALL""", "bin_d", "frag_d", "ev"))
def pattern_indexes(spark, sf):
    """Indexed patterns with the number of events whose process bears that name."""
    tools = cat.catalog(spark).tools
    names = w.events(spark, sf).groupBy(F.lower("process.name").alias("pattern")).agg(F.count(F.lit(1)).alias("events"))
    index = t.binary_index(tools).withColumn("kind", F.lit("binary")).unionByName(
        t.fragment_index(tools).withColumn("kind", F.lit("fragment")))
    return index.join(names, "pattern", "left").fillna(0, ["events"])


# --- sightings ---------------------------------------------------------------------------------

@query(sql("SELECT uid, epoch_us(time) AS time, tool, category_label, stage, host, place, evidence FROM tool_seen", "tool_seen"))
def tool_sightings(spark, sf):
    return t.tool_sightings(w.events(spark, sf), cat.catalog(spark)).select(
        "uid", micros("time").alias("time"), "tool", "category_label", "stage", "host", "place", "evidence")


@query(sql("SELECT uid, host, filename, path, known FROM note_seen", "note_seen"))
def note_sightings(spark, sf):
    return t.note_sightings(w.events(spark, sf), cat.catalog(spark)).select("uid", "host", "filename", "path", "known")


@query(sql("SELECT uid, host, signature, stage, severity, technique, evidence FROM behaviour", "behaviour"))
def behaviour_hits(spark, sf):
    return t.behaviour_hits(w.events(spark, sf)).select("uid", "host", "signature", "stage", "severity", "technique", "evidence")


@query(sql("""SELECT signature, host, first(uid ORDER BY time, uid) AS uid FROM behaviour GROUP BY signature, host""", "behaviour"))
def behaviours_per_host(spark, sf):
    return t.distinct_behaviours(t.behaviour_hits(w.events(spark, sf))).select("signature", "host", "uid")


@query(sql(f"""SELECT uid, {oracle_text.SEEN_ON} AS host FROM ev""", "ev"))
def sighting_hosts(spark, sf):
    return w.events(spark, sf).select("uid", t.sighting_host().alias("host"))


def found(spark, sf):
    f = t.scan(w.events(spark, sf), cat.catalog(spark))
    return t.Findings(cut(f.tools), cut(f.notes), cut(f.behaviours))


@query(sql("""SELECT stage_order, stage, reached, count, coalesce((SELECT string_agg(kind || ':' || label, ',' ORDER BY n) FROM (
    SELECT kind, label, row_number() OVER (ORDER BY kind_order, t, u, label) AS n FROM (
      SELECT kind_order, kind, label, min(time) AS t, first(uid ORDER BY time, uid) AS u FROM stage_rows s
      WHERE s.stage = ladder.stage GROUP BY kind_order, kind, label)) WHERE n <= 8), '') AS evidence, greatest(0, (SELECT count(*) FROM (SELECT DISTINCT kind, label FROM stage_rows s
      WHERE s.stage = ladder.stage)) - 8) AS hidden FROM ladder""",
           "ladder", "stage_rows"))
def stage_ladder(spark, sf):
    ladder = t.stage_ladder(found(spark, sf), spark)
    return ladder.select("stage_order", "stage", "reached", "count", F.coalesce(joined(F.transform(
        "evidence", lambda x: F.concat_ws(":", x["kind"], x["label"]))), F.lit("")).alias("evidence"), "hidden")


@query(sql("""SELECT stage_order, stage FROM stage_d WHERE stage_order > (SELECT coalesce(max(stage_order), -1) FROM ladder
  WHERE reached AND stage <> 'impact' AND stage <> 'inhibit') ORDER BY stage_order LIMIT 1""", "ladder", "stage_d"))
def next_stage(spark, sf):
    f = found(spark, sf)
    early = t.Findings(f.tools.where("stage <> 'inhibit'"), f.notes.where("false"), f.behaviours.where("stage <> 'inhibit'"))
    return t.next_stage(t.stage_ladder(early, spark)).select("stage_order", "stage")


@query(sql("""SELECT CASE WHEN (SELECT count(*) FROM note_seen) > 0 THEN 5 WHEN max(severity) >= 5 THEN 5 WHEN max(severity) IS NOT NULL
  THEN max(severity) WHEN (SELECT count(*) FROM tool_seen) > 0 THEN 3 ELSE 0 END AS severity_floor FROM behaviour""",
           "note_seen", "tool_seen", "behaviour"))
def severity_floor(spark, sf):
    return t.severity_floor(found(spark, sf))


@query(sql("""SELECT category_label, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools, count(DISTINCT tool) AS n_tools
  FROM tool_seen GROUP BY category_label""", "tool_seen"))
def tools_by_category(spark, sf):
    return t.tools_by_category(found(spark, sf).tools).select("category_label", joined("tools").alias("tools"), "n_tools")


@query(sql("""SELECT count(DISTINCT tool) AS tool_count, (SELECT count(DISTINCT signature) FROM behaviour) AS behaviour_count,
  (SELECT count(*) FROM note_seen) AS note_count FROM tool_seen""", "tool_seen", "behaviour", "note_seen"))
def threat_counts(spark, sf):
    return t.threat_counts(found(spark, sf))


@query(sql("""SELECT filename, string_agg(DISTINCT host, ',' ORDER BY host) AS hosts, count(DISTINCT host) AS n_hosts, count(*) AS sightings
  FROM note_seen GROUP BY filename""", "note_seen"))
def notes_by_name(spark, sf):
    return t.notes_by_name(t.note_sightings(w.events(spark, sf), cat.catalog(spark))).withColumn("hosts", joined("hosts"))


@query(sql("SELECT filename, host, count(*) AS sightings FROM note_seen GROUP BY ALL", "note_seen"))
def note_hosts(spark, sf):
    return t.note_hosts(t.note_sightings(w.events(spark, sf), cat.catalog(spark)))


# --- attribution ----------------------------------------------------------------------------------

FIRST = "array_to_string(string_split({}, ',')[1:{}], ', ')".format
EXPLAINED = f"""CASE WHEN note_match <> '' AND note_strength < 3 THEN 'Note ' || {FIRST('note_match', 3)}
    || ' was found, but many families use that name; it confirms ransomware, not ' || "group" || '.'
  WHEN note_match <> '' THEN 'Note ' || {FIRST('note_match', 3)} || ' is tied to ' || "group" || ' and '
    || CASE WHEN matched = '' THEN 0 ELSE len(string_split(matched, ',')) END
    || ' tool(s) of its profile were seen; confirm with the binary and the payment trail.'
  WHEN confidence = 'medium' THEN 'The tools fit ' || "group" || ', mostly ' || {FIRST('discriminating', 4)} || '; a hypothesis to guide the search.'
  WHEN confidence = 'low' THEN 'Partial overlap with ' || "group" || ' (' || len(string_split(matched, ',')) || ' tools); too little to attribute.'
  ELSE 'The overlap with ' || "group" || ' comes from tools everybody uses.' END"""


@query(sql(f"""SELECT "group", score, confidence, matched, discriminating, note_match, CAST(note_strength AS DOUBLE) AS note_strength,
  CAST(coverage AS DOUBLE) AS coverage, {EXPLAINED} AS explanation FROM attribution ORDER BY score DESC, n_rare DESC, "group" LIMIT 6""", "attribution"))
def group_attribution(spark, sf):
    best = a.attribute(found(spark, sf), cat.catalog(spark))
    return best.select("group", "score", "confidence", joined("matched").alias("matched"), joined("discriminating").alias("discriminating"),
                       joined("note_match").alias("note_match"), "note_strength", "coverage", "explanation")


@query(sql(f"""SELECT "group", CAST(row_number() OVER (ORDER BY score DESC, n_rare DESC, "group") AS INTEGER) AS place, {EXPLAINED} AS explanation
  FROM attribution""", "attribution"))
def all_group_candidates(spark, sf):
    """Every group with a match, in order, with its explanation."""
    from pyspark.sql import Window
    order = Window.orderBy(F.desc("score"), F.desc(F.size("discriminating")), F.asc("group"))  # one row a group of the catalog
    return a.attribute(found(spark, sf), cat.catalog(spark), limit=None).select("group", F.row_number().over(order).alias("place"), "explanation")


@query(sql(f"""SELECT DISTINCT tool, CASE WHEN n_groups > {len(cat.GROUPS) * fixed.UBIQUITY_CUTOFF} THEN 'ubiquitous' ELSE 'undocumented' END AS kind
  FROM tool_seen JOIN weight_d USING (tool) WHERE n_groups = 0 OR n_groups > {len(cat.GROUPS) * fixed.UBIQUITY_CUTOFF}""", "tool_seen", "weight_d"))
def unhelpful_tools(spark, sf):
    return a.unhelpful_tools(found(spark, sf), cat.catalog(spark))


@query(sql("""SELECT g.grp AS "group", g.tool, CAST(w.n_groups AS INTEGER) AS used_by_groups, round(weight, 2) AS weight, d.category_label,
  count(s.uid) AS sightings FROM group_d g JOIN weight_d w ON w.tool = g.tool JOIN tool_d d ON d.tool = g.tool
  LEFT JOIN tool_seen s ON s.tool = g.tool GROUP BY ALL""", "group_d", "weight_d", "tool_d", "tool_seen"))
def group_profiles_with_sightings(spark, sf):
    catalog = cat.catalog(spark)
    seen = t.tool_sightings(w.events(spark, sf), catalog).groupBy("tool").agg(F.count(F.lit(1)).alias("sightings"))
    return a.group_profile(catalog).join(seen, "tool", "left").fillna(0, ["sightings"])


# --- narrative and story ----------------------------------------------------------------------------

ENTRY = "epoch_us(time) AS time, epoch_us(coalesce(until, time)) AS until, count, severity, first_uid, text, source"


def entry_rows(df, *extra):
    return df.select(micros("time").alias("time"), F.coalesce(micros("until"), micros("time")).alias("until"), "count", "severity", "first_uid", "text", *extra)


@query(sql(f"SELECT {ENTRY} FROM entries", "entries"))
def full_narrative(spark, sf):
    return entry_rows(rp.narrative(w.events(spark, sf), limit=None), "source")


@query(sql(f"SELECT {ENTRY} FROM entries ORDER BY severity DESC, time, first_uid LIMIT 60", "entries"))
def report_narrative(spark, sf):
    return entry_rows(rp.narrative(w.events(spark, sf), limit=60), "source")


STEPS.update({
    "bridge": ("""SELECT DISTINCT coalesce(x.new_id, source) AS source, coalesce(y.new_id, target) AS target, rel, uid FROM relations
      LEFT JOIN alias x ON source = x.old_id LEFT JOIN alias y ON target = y.old_id""", ["relations", "alias"]),
    "told": (f"""SELECT s.*, l.source AS s, l.target AS o, l.rel FROM said s JOIN (
      SELECT uid, first({{'a': source, 'b': target, 'c': rel}} ORDER BY source, target, rel) AS k,
        first(source ORDER BY source, target, rel) AS source, first(target ORDER BY source, target, rel) AS target,
        first(rel ORDER BY source, target, rel) AS rel
      FROM bridge WHERE source <> target AND {TOP_USER} IN (source, target) GROUP BY uid) l USING (uid)""", ["said", "bridge", "nodes"]),
    "steps": ("""SELECT *, sum(start) OVER (ORDER BY time, uid) AS run FROM (SELECT *, CASE WHEN lag({'t': text, 's': s, 'o': o, 'r': rel})
      OVER (ORDER BY time, uid) IS NOT DISTINCT FROM {'t': text, 's': s, 'o': o, 'r': rel} THEN 0 ELSE 1 END AS start FROM told)""", ["told"]),
})


@query(sql(f"""SELECT epoch_us(min(time)) AS time, epoch_us(max(time)) AS until, count(*) AS count,
  max(severity) AS severity, first(uid ORDER BY time, uid) AS first_uid, any_value(text) AS text, any_value(rel) AS rel,
  any_value(CASE WHEN s = {TOP_USER} THEN o ELSE s END) AS other, any_value(s = {TOP_USER}) AS outbound FROM steps GROUP BY run
  ORDER BY severity DESC, min(time), first_uid LIMIT 120""", "steps", "nodes"))
def entity_story(spark, sf):
    events = w.events(spark, sf)
    graph = g.build_graph(events)
    who = top_user(graph)
    bridge = g.links_of_nodes(m.relation_mentions(events), graph.aliases, spark.createDataFrame([(who,)], "node_id string"))
    return entry_rows(rp.story(events, bridge, who, limit=120), "rel", "other", "outbound")


# --- report sections -----------------------------------------------------------------------------------

STEPS["iocs"] = (f"""SELECT type AS kind, CASE WHEN type = 'hash' THEN split_part(node_id, ':', 2)
    WHEN type = 'file' THEN coalesce(path, substr(node_id, 6)) ELSE label END AS value,
  CASE WHEN type = 'hash' THEN CASE WHEN length(node_id) = 69 THEN 'sha256' ELSE 'md5' END END AS algo, role, risk, source_mask
  FROM roles WHERE (type = 'ip' AND NOT {is_private('label')}) OR type IN ('domain', 'url', 'hash')
    OR (type = 'file' AND role IN ('hostile', 'suspicious')) OR (type = 'mailbox' AND role = 'hostile')""", ["roles"])


def enriched(spark, sf):
    return incident.with_roles(built(spark, sf).cut())


@query(sql("SELECT kind, value, algo, role, risk FROM iocs", "iocs"))
def indicators(spark, sf):
    return rp.ordered_indicators(enriched(spark, sf).nodes).select("kind", "value", "algo", "role", "risk")


CREATED = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)
DIGEST = "sha256('indicator:' || kind || ':' || value)"


@query(sql(f"""SELECT 'indicator--' || left({DIGEST}, 8) || '-' || substr({DIGEST}, 9, 4) || '-' || substr({DIGEST}, 13, 4) || '-' ||
    substr({DIGEST}, 17, 4) || '-' || substr({DIGEST}, 21, 12) AS id, kind || ': ' || value AS name, least(100, risk) AS confidence,
  CASE WHEN algo = 'md5' THEN '[file:hashes.''MD5'' = ''' || value || ''']' ELSE CASE kind {' '.join(f"WHEN {q(k)} THEN replace({q(v)}, '%s', replace(value, '''', chr(92) || ''''))" for k, v in fixed.IOC_PATTERN.items())}
  END END AS pattern FROM iocs""", "iocs"))
def stix_indicators(spark, sf):
    objects = rp.stix_objects(rp.indicators(enriched(spark, sf).nodes), "Incident", CREATED).where("type = 'indicator'")
    body = F.from_json("object", "id string, name string, confidence int, pattern string").alias("o")
    return objects.select(body).select("o.*")


@query(sql("""SELECT tactic, rank, epoch_us(first_seen) AS first_seen, n_entities, (SELECT string_agg(node_id, ',' ORDER BY n) FROM (
    SELECT node_id, row_number() OVER (ORDER BY risk DESC, type, label, node_id) AS n FROM roles WHERE (tactic_mask & (1 << rank)) <> 0)
    WHERE n <= 12) AS entities FROM (""" + " UNION ALL ".join(
        f"SELECT {q(name)} AS tactic, {i} AS rank, min(first_seen) AS first_seen, count(*) AS n_entities FROM roles "
        f"WHERE (tactic_mask & {1 << i}) <> 0 HAVING count(*) > 0" for i, name in enumerate(fixed.TACTICS)) + ")", "roles"))
def kill_chain(spark, sf):
    events = w.events(spark, sf)
    stages = rp.kill_chain(enriched(spark, sf).nodes, cut(rp.narrative(events)))
    return stages.select("tactic", "rank", micros("first_seen").alias("first_seen"), "n_entities",
                         joined(F.col("entities.node_id")).alias("entities"))


@query(sql(f"""SELECT tactic, count(*) FILTER (WHERE n <= 6) AS lines, min(epoch_us(time)) AS first_line, count(*) AS n_lines,
    string_agg(text, ' / ' ORDER BY n) FILTER (WHERE n <= 6) AS texts FROM (
    SELECT *, row_number() OVER (PARTITION BY tactic ORDER BY time, first_uid) AS n FROM (
      SELECT DISTINCT time, first_uid, text, unnest([{tactic_of('tech1')}, {tactic_of('tech2')}]) AS tactic FROM (
        SELECT * FROM entries)) WHERE tactic IS NOT NULL)
  GROUP BY tactic""", "entries"))
def kill_chain_evidence(spark, sf):
    stages = rp.kill_chain(enriched(spark, sf).nodes, cut(rp.narrative(w.events(spark, sf))))
    return stages.where("evidence IS NOT NULL").select(
        "tactic", F.size("evidence").cast("bigint").alias("lines"), F.unix_micros(F.col("evidence")[0]["time"]).alias("first_line"),
        "n_lines", F.array_join(F.col("evidence.text"), " / ").alias("texts"))


@query(sql("SELECT tactic, label, priority, text FROM (" + " UNION ALL ".join(
    [f"SELECT {q(name)} AS tactic, {q(fixed.TACTIC_LABEL[name])} AS label, {fixed.TACTIC_ACTIONS[name][0]} AS priority, "
     f"{q(fixed.TACTIC_ACTIONS[name][1])} AS text FROM roles WHERE (tactic_mask & {1 << i}) <> 0 HAVING count(*) > 0"
     for i, name in enumerate(fixed.TACTICS)]
    + [f"SELECT {q(s)}, {q('URGENT - ' + {x[0]: x[1] for x in fixed.STAGES}[s])}, {p}, {q(act)} FROM ladder WHERE stage = {q(s)} AND reached"
       for s, (p, act) in fixed.STAGE_ACTIONS.items()]) + ")",
           "roles", "ladder"))
def recommendations(spark, sf):
    events = w.events(spark, sf)
    sections = incident.incident_report(events, enriched(spark, sf), cat.catalog(spark))
    return sections["recommendations"].select("tactic", "label", "priority", "text")


@query(sql("SELECT node_id, type, role, risk, CAST(event_count AS BIGINT) AS events FROM roles", "roles"))
def report_entities(spark, sf):
    return rp.entity_table(enriched(spark, sf).nodes).select("node_id", "type", "role", "risk", "events")


ROLE_COUNTS = ", ".join(f"count(*) FILTER (WHERE role = '{x}') AS {x}_nodes" for x in fixed.ROLE_LABEL)


@query(sql(f"""SELECT (SELECT count(*) FROM ev) AS events, count(*) AS nodes, (SELECT count(*) FROM links) AS links,
  (SELECT CASE WHEN s < 60 THEN s || ' seconds' WHEN s < 3600 THEN (s // 60) || ' minutes'
     WHEN s < 86400 THEN format('{{:.1f}} hours', s / 3600.0) ELSE format('{{:.1f}} days', s / 86400.0) END
   FROM (SELECT (epoch_us(max(time)) - epoch_us(min(time))) // 1000000 AS s FROM ev)) AS duration,
  (SELECT epoch_us(min(time)) FROM ev) AS window_from, (SELECT epoch_us(max(time)) FROM ev) AS window_to,
  max(max_severity) AS max_severity, CASE max(max_severity) WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Informational' WHEN 2 THEN 'Low'
    WHEN 3 THEN 'Medium' WHEN 4 THEN 'High' WHEN 5 THEN 'Critical' END AS max_severity_label,
  concat_ws(',', {', '.join(f"CASE WHEN (bit_or(tactic_mask) & {1 << i}) <> 0 THEN {q(name)} END" for i, name in enumerate(fixed.TACTICS))}) AS tactics,
  {ROLE_COUNTS}, (SELECT count(*) FROM iocs) AS ioc_count FROM roles""", "ev", "roles", "links", "iocs"))
def report_summary(spark, sf):
    return rp.summary(w.events(spark, sf), enriched(spark, sf)).withColumns(
        {"window_from": micros("window_from"), "window_to": micros("window_to"), "tactics": joined("tactics")})


@query(sql("""SELECT CASE WHEN count(*) = 0 THEN 'Incident report' ELSE 'Incident on ' || string_agg(label, ' and ' ORDER BY n) END AS title
  FROM (SELECT label, row_number() OVER (ORDER BY risk DESC, type, label, node_id) AS n FROM roles WHERE role = 'victim' AND type IN ('host', 'user'))
  WHERE n <= 2""", "roles"))
def report_title(spark, sf):
    return rp.title(enriched(spark, sf).nodes)
