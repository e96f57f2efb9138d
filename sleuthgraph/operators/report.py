"""Report sections and entity stories as tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canon, fixed, values
from .events import is_key_event
from .graph import Graph, with_names
from .narrate import sentence
from .runs import most_severe, number_runs, summarize_runs



def _spoken(events: DataFrame) -> DataFrame:
    return events.select("time", "uid", "severity", "source", sentence().alias("text"),
                         F.transform("mitre", lambda t: t["id"]).alias("techniques"),
                         values.tactics_of(F.col("mitre")).alias("tactics"))


# --- narrative and story ---------------------------------------------------------------

def numbered_narrative(events: DataFrame) -> DataFrame:
    """Key events in order with the entry they belong to (entry = run_id): the full uid bridge."""
    return number_runs(_spoken(events.where(is_key_event())), ["time", "uid"], ["text"])


def narrative(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Key events told in order, consecutive equal sentences collapsed."""
    entries = summarize_runs(numbered_narrative(events), ["text", "source", "techniques", "tactics"])
    return entries.orderBy("run_id") if limit is None else most_severe(entries, limit)


def story(events: DataFrame, bridge: DataFrame, node_id: str, limit: int | None = None) -> DataFrame:
    """What one entity did, in order.

    ``bridge`` is the resolved (source, target, rel, uid) table; an event is told
    through one link of the node, the first by (source, target, rel).
    """
    touching = bridge.where((F.col("source") == node_id) | (F.col("target") == node_id))
    links = touching.groupBy("uid").agg(F.min(F.struct("source", "target", "rel")).alias("link"))
    steps = _spoken(events).withColumnRenamed("source", "event_source").join(links, "uid").select(
        "time", "uid", "severity", "event_source", "text", "techniques", "tactics", "link.*")
    told = summarize_runs(number_runs(steps, ["time", "uid"], ["text", "source", "target", "rel"]),
                          ["text", "event_source", "techniques", "tactics", "source", "target", "rel"])
    told = told.withColumns({
        "outbound": F.col("source") == node_id,
        "other": F.when(F.col("source") == node_id, F.col("target")).otherwise(F.col("source"))})
    return told.orderBy("run_id") if limit is None else most_severe(told, limit)


# --- indicators ---------------------------------------------------------------------------

def indicators(nodes: DataFrame) -> DataFrame:
    """External indicators with role: (kind, value, algo, role, risk, severity, span, sources)."""
    c = F.col
    digest = F.substring_index("node_id", ":", -1)
    wanted = (F.when(c("type") == "ip", ~canon.is_private_ip(c("label")))
              .when(c("type").isin("domain", "url", "hash"), F.lit(True))
              .when(c("type") == "file", c("role").isin("hostile", "suspicious"))
              .when(c("type") == "mailbox", c("role") == "hostile").otherwise(F.lit(False)))
    value = (F.when(c("type") == "hash", digest)
             .when(c("type") == "file", F.coalesce(canon.not_in(c("path"), [""]), F.regexp_replace("node_id", "^file:", "")))
             .otherwise(c("label")))
    algo = F.when(c("type") == "hash", F.when(F.length(digest) == 64, "sha256").otherwise("md5"))
    return nodes.where(wanted).select(
        c("type").alias("kind"), value.alias("value"), algo.alias("algo"), "role", "risk",
        c("max_severity").alias("severity"), "first_seen", "last_seen",
        values.mask_names(c("source_mask"), fixed.SOURCES).alias("sources"))


def kind_rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in fixed.IOC_ORDER]), kind)


def ordered_indicators(nodes: DataFrame) -> DataFrame:
    return indicators(nodes).orderBy(kind_rank(F.col("kind")), F.desc("risk"), "value")


def stix_objects(iocs: DataFrame, title: str, created: dt.datetime) -> DataFrame:
    """Indicator objects as JSON text with ids derived from the value (plus one report object)."""
    stamp = created.isoformat()

    def stable_id(prefix: str, text: Column) -> Column:
        digest = F.sha2(F.concat(F.lit(f"{prefix}:"), text), 256)
        parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return F.concat(F.lit(f"{prefix}--"), F.concat_ws("-", *parts))

    escaped = F.replace(F.col("value"), F.lit("'"), F.lit("\\'"))
    pattern = F.lit(None).cast("string")
    kinds = {k: F.col("kind") == k for k in fixed.IOC_PATTERN}
    kinds |= {"md5": (F.col("kind") == "hash") & (F.col("algo") == "md5")}
    for kind, shape in (fixed.IOC_PATTERN | {"md5": fixed.MD5_PATTERN}).items():
        head, tail = shape.split("%s")
        pattern = F.when(kinds[kind], F.concat(F.lit(head), escaped, F.lit(tail))).otherwise(pattern)
    label = F.try_element_at(values.literal_map(fixed.IOC_STIX_LABEL), F.col("kind"))
    name = F.concat_ws(": ", "kind", "value")
    body = F.struct(
        F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"),
        stable_id("indicator", F.concat_ws(":", "kind", "value")).alias("id"),
        F.lit(stamp).alias("created"), F.lit(stamp).alias("modified"), name.alias("name"), pattern.alias("pattern"),
        F.lit("stix").alias("pattern_type"),
        F.coalesce(F.date_format("first_seen", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit(stamp)).alias("valid_from"),
        F.array(label).alias("labels"), F.least(F.lit(100), F.col("risk")).alias("confidence"),
        F.col("role").alias("x_role"), F.col("sources").alias("x_sources"))
    rows = iocs.select(body["id"].alias("id"), F.lit("indicator").alias("type"), F.to_json(body).alias("object"))
    report = iocs.sparkSession.range(1).select(F.struct(
        F.lit("report").alias("type"), F.lit("2.1").alias("spec_version"),
        stable_id("report", F.lit(title + stamp)).alias("id"), F.lit(stamp).alias("created"),
        F.lit(stamp).alias("modified"), F.lit(title).alias("name"), F.lit(stamp).alias("published"),
        F.array(F.lit("threat-report")).alias("labels")).alias("b"))
    return report.select(F.col("b.id").alias("id"), F.lit("report").alias("type"), F.to_json("b").alias("object")).unionByName(rows)


# --- kill chain and actions -----------------------------------------------------------------

def _tactic_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, fixed.TACTIC_LABEL[t], i) for i, t in enumerate(fixed.TACTICS)],
                                 "tactic string, label string, rank int")


def kill_chain(nodes: DataFrame, entries: DataFrame, n_entities: int | None = 12, n_lines: int | None = 6) -> DataFrame:
    """Tactics seen, in chain order: the riskiest entities, the first lines of evidence (None: all), and how many there are in all.

    ``entries`` is the whole narrative; the cut is made here, for each tactic.
    """
    seen = with_names(nodes).select("node_id", "type", F.col("label").alias("name"), "risk", "first_seen",
                                    F.explode("tactics").alias("tactic"))
    order = Window.partitionBy("tactic").orderBy(F.desc("risk"), "type", "name", "node_id")
    within = lambda df, limit: df if limit is None else df.where(F.col("_n") <= limit)
    top = within(seen.withColumn("_n", F.row_number().over(order)), n_entities)
    entities = top.groupBy("tactic").agg(F.array_sort(F.collect_list(F.struct("_n", "node_id", "name", "type"))).alias("entities"))
    spans = seen.groupBy("tactic").agg(F.min("first_seen").alias("first_seen"), F.count(F.lit(1)).alias("n_entities"))
    lines = entries.select("run_id", "time", "text", F.explode(F.array_distinct("tactics")).alias("tactic"))
    by_time = Window.partitionBy("tactic").orderBy("run_id")
    shown = within(lines.withColumn("_n", F.row_number().over(by_time)), n_lines)
    counts = lines.groupBy("tactic").agg(F.count(F.lit(1)).alias("_lines"))
    evidence = shown.groupBy("tactic").agg(F.array_sort(F.collect_list(F.struct("_n", "time", "text"))).alias("evidence"))
    return (spans.join(entities, "tactic").join(evidence, "tactic", "left").join(counts, "tactic", "left")
            .join(_tactic_dimension(nodes.sparkSession), "tactic")
            .select("tactic", "label", "rank", "first_seen", "n_entities", "entities", "evidence",
                    F.coalesce("_lines", F.lit(0)).alias("n_lines")).orderBy("rank"))


def recommendations(stages: DataFrame, ladder: DataFrame | None = None) -> DataFrame:
    """Containment actions by priority, from tactics seen and ransomware stages reached."""
    spark = stages.sparkSession
    actions = spark.createDataFrame([(t, p, a) for t, (p, a) in fixed.TACTIC_ACTIONS.items()],
                                    "tactic string, priority int, text string")
    out = stages.join(actions, "tactic").select("tactic", "label", "priority", "text")
    if ladder is not None:
        urgent = spark.createDataFrame([(s, p, a) for s, (p, a) in fixed.STAGE_ACTIONS.items()],
                                       "stage string, priority int, text string")
        out = out.unionByName(ladder.where("reached").join(urgent, "stage").select(
            F.col("stage").alias("tactic"), F.concat(F.lit("URGENT - "), "label").alias("label"), "priority", "text"))
    return out.orderBy("priority", "label")


# --- entities and summary --------------------------------------------------------------------

def entity_table(nodes: DataFrame) -> DataFrame:
    """Entities by risk with readable type and role."""
    kinds, roles = values.literal_map(fixed.ENTITY_LABEL), values.literal_map(fixed.ROLE_LABEL)
    role = F.coalesce("role", F.lit("neutral"))
    return with_names(nodes).select(
        "node_id", "label", "type",
        F.coalesce(F.try_element_at(kinds, F.col("type")), F.lit(fixed.UNKNOWN_ENTITY_LABEL)).alias("type_label"),
        role.alias("role"), F.coalesce(F.try_element_at(roles, role), F.lit(fixed.ROLE_LABEL["neutral"])).alias("role_label"),
        "risk", F.col("max_severity").alias("severity"), F.col("event_count").alias("events"),
        "first_seen", "last_seen", "sources", "tactics").orderBy(F.desc("risk"), "type", "label", "node_id")


def duration_text(start: Column, end: Column) -> Column:
    """Seconds, minutes, hours or days between two times; null unless the end is later."""
    seconds = F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000000)
    text = (F.when(seconds < 60, F.format_string("%d seconds", seconds))
            .when(seconds < 3600, F.format_string("%d minutes", F.floor(seconds / 60)))
            .when(seconds < 86400, F.format_string("%.1f hours", seconds / 3600))
            .otherwise(F.format_string("%.1f days", seconds / 86400)))
    return F.when(end > start, text)


def summary(events: DataFrame, graph: Graph) -> DataFrame:
    """One row: counts, window, highest severity, roles, tactics and indicator count."""
    count = F.count(F.lit(1))
    roles = [F.count_if(F.coalesce("role", F.lit("neutral")) == r).alias(f"{r}_nodes") for r in fixed.ROLE_LABEL]
    base = graph.nodes.agg(count.alias("nodes"), F.coalesce(F.max("max_severity"), F.lit(0)).alias("max_severity"),
                           F.coalesce(F.bit_or("tactic_mask"), F.lit(0)).alias("tactic_mask"), *roles)
    start, end = events.agg(F.min("time")).scalar(), events.agg(F.max("time")).scalar()
    labels = F.array(*[F.lit(x) for x in fixed.SEVERITY_LABEL])
    return base.select(
        events.agg(count).scalar().alias("events"), "nodes", graph.links.agg(count).scalar().alias("links"),
        start.alias("window_from"), end.alias("window_to"), duration_text(start, end).alias("duration"),
        "max_severity", F.get(labels, F.col("max_severity")).alias("max_severity_label"),
        values.mask_names(F.col("tactic_mask"), fixed.TACTICS).alias("tactics"),
        *[f"{r}_nodes" for r in fixed.ROLE_LABEL],
        indicators(graph.nodes).agg(count).scalar().alias("ioc_count"))


def title(nodes: DataFrame) -> DataFrame:
    """One row: a title naming the two riskiest victims among hosts and users."""
    victims = nodes.where("role = 'victim' AND type IN ('host', 'user')").orderBy(
        F.desc("risk"), "type", "label", "node_id").limit(2)
    order = F.struct(-F.col("risk"), "type", "label", "node_id")
    names = victims.agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "label"))).alias("v")).select(
        F.transform("v", lambda x: x["label"]).alias("v"))
    return names.select(F.when(F.size("v") == 0, "Incident report").otherwise(
        F.concat(F.lit("Incident on "), F.array_join("v", " and "))).alias("title"))
