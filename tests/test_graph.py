import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import INGEST
from sleuthgraph.operators import graph as g
from sleuthgraph.operators import iterate, prune, roles
from sleuthgraph.operators import mentions as m
from sleuthgraph.operators.narrate import sentence
from sleuthgraph.operators.report import narrative, story
from sleuthgraph.operators.runs import number_runs, summarize_runs
from sleuthgraph.plans import incident
from sleuthgraph.sources import sinks

TECH = {"id": "T1071.001", "name": "Web", "tactic": "command-and-control"}


@pytest.fixture(scope="module")
def sample(make_events):
    at = lambda s: INGEST + dt.timedelta(seconds=s)
    return make_events([
        {"time": at(0), "class_name": "Authentication", "actor": {"user": "ann"}, "device": {"hostname": "w1", "ip": "10.0.0.1"}},
        {"time": at(1), "class_name": "Authentication", "actor": {"user": "CORP\\ANN"}, "device": {"hostname": "w1"}, "src": {"ip": "10.0.0.1"}},
        {"time": at(2), "class_name": "Network Activity", "activity": "connect", "src": {"ip": "10.0.0.1"}, "dst": {"ip": "9.9.9.9"}, "mitre": [TECH]},
        {"time": at(3), "class_name": "Process Activity", "activity": "launch", "device": {"hostname": "w1"}, "actor": {"user": "ann"},
         "process": {"name": "x.exe", "path": "C:\\T\\x.exe", "cmdline": "x  y"}},
        {"time": at(4), "class_name": "File System Activity", "activity": "create", "device": {"hostname": "w1"}, "process": {"name": "x.exe"},
         "file": {"name": "m.exe", "path": "C:\\T\\m.exe", "sha256": "AB"}},
        {"time": at(5), "class_name": "Detection Finding", "severity": 5, "status": "unknown", "activity": "alert", "message": "Bad " * 40,
         "device": {"hostname": "w1"}, "file": {"name": "m.exe", "sha256": "ab"}, "mitre": [TECH]},
        {"time": at(6), "class_name": "Email Activity", "activity": "deliver", "email": {"sender": "x@mail.evil.example.org", "recipient": "ann@corp.com",
                                                                                      "url": "https://evil.example.org/a"}, "severity": 4},
        {"time": at(7), "class_name": "Account Change", "device": {"hostname": "lonely"}, "actor": {"user": "SYSTEM"}},
    ])


@pytest.fixture(scope="module")
def built(sample):
    return g.build_graph(sample).cut()


def by_id(df):
    return {r.node_id: r for r in df.collect()}


def test_duplicates_resolved(built):
    nodes = by_id(built.nodes)
    assert "ip:10.0.0.1" not in nodes and "file:m.exe" not in nodes and "process:w1|x.exe" not in nodes
    assert nodes["user:ann"].label == "ann@corp.com"
    assert nodes["file:c:\\t\\m.exe"].event_count == 2
    assert nodes["host:w1"].event_count == 7 and nodes["host:w1"].ip == "10.0.0.1"
    assert len([n for n in nodes if n.startswith("alert:")]) == 1
    assert all(0 <= r.risk <= 100 for r in nodes.values())


def test_no_dangling_or_self_links(built):
    ids = set(by_id(built.nodes))
    for link in built.links.collect():
        assert link.source in ids and link.target in ids and link.source != link.target


def test_process_keeps_host_anchor_and_alert_label(built):
    nodes = by_id(built.nodes)
    assert "process:w1|c:\\t\\x.exe" in nodes
    assert max(len(r.label) for r in nodes.values() if r.type == "alert") <= 70


def test_roles(built):
    role = {k: r.role for k, r in by_id(roles.assign_roles(built).nodes).items()}
    assert role["ip:9.9.9.9"] == "hostile" and role["host:w1"] == "victim" and role["domain:evil.example.org"] == "hostile"
    assert role["mailbox:x@mail.evil.example.org"] == "hostile" and role["mailbox:ann@corp.com"] == "victim"
    assert role["host:lonely"] == "asset" and role["process:w1|c:\\t\\x.exe"] == "suspicious"


def test_pruning(built):
    assert prune.keep_focus(built, "user:nobody").nodes.count() == 0
    near = by_id(prune.keep_focus(built, "ip:9.9.9.9").nodes)
    assert set(near) == {"ip:9.9.9.9", "host:w1"}
    cut = prune.top_risk(built, 3)
    assert cut.truncated and cut.nodes.count() == 3
    assert "host:lonely" not in by_id(prune.drop_isolated(built).nodes)


def test_levels_consecutive_and_whole(built):
    levels = sorted({r.level for r in iterate.assign_levels(built).collect()})
    assert levels == list(range(len(levels)))
    assert iterate.assign_levels(built).count() == built.nodes.count()


def test_clusters(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("a", "d"), ("x", "y")]
    links = spark.createDataFrame(edges, "source string, target string")
    nodes = spark.createDataFrame([(n,) for n in "abcdxyz"], "node_id string")
    once = {r.node_id: r.cluster for r in iterate.assign_clusters(g.Graph(nodes, links)).collect()}
    shuffled = edges[::-1]
    again = {r.node_id: r.cluster for r in iterate.assign_clusters(g.Graph(nodes, spark.createDataFrame(shuffled, links.schema))).collect()}
    assert once == again and len(once) == 7
    assert {once[n] for n in "abcd"} == {0} and once["x"] == once["y"] != 0 and once["z"] not in (0, once["x"])


def test_levels_against_brute_force(spark):
    rng = random.Random(3)
    names = [f"ip:{i}" for i in range(60)]
    edges = list({tuple(sorted(rng.sample(names, 2))) for _ in range(70)})
    own = {n: rng.randrange(14) for n in rng.sample(names, 6)}
    nodes = spark.createDataFrame([(n, "ip", 1 << own[n] if n in own else 0) for n in names], "node_id string, type string, tactic_mask int")
    got = {r.node_id: r.level for r in iterate.raw_levels(g.Graph(nodes, spark.createDataFrame(edges, "source string, target string"))).collect()}
    near = {n: set() for n in names}
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    want, frontier = dict(own), dict(own)
    while frontier:
        step = {}
        for n, level in frontier.items():
            for o in near[n] - want.keys():
                step[o] = min(step.get(o, 99), level)
        want.update(step)
        frontier = step
    assert got == {n: want.get(n, 5) for n in names}


def test_runs_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(INGEST + dt.timedelta(seconds=rng.randrange(400)), f"{i:05d}", rng.randrange(6), "hot" if rng.random() < 0.7 else rng.choice("abc"))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "time timestamp, uid string, severity int, text string").repartition(7)
    got = [(r.text, r["count"], r.severity, r.first_uid) for r in summarize_runs(number_runs(df, ["time", "uid"], ["text"]), ["text"]).orderBy("run_id").collect()]
    want = []
    for _, uid, severity, text in sorted(rows, key=lambda r: (r[0], r[1])):
        if want and want[-1][0] == text:
            want[-1] = (text, want[-1][1] + 1, max(want[-1][2], severity), want[-1][3])
        else:
            want.append((text, 1, severity, uid))
    assert got == want


def test_positions(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "a int, b int").repartition(5)
    ranked = iterate.dense_positions(df, [F.desc("a"), F.asc("b")]).collect()
    want = sorted(((i % 7, i) for i in range(500)), key=lambda x: (-x[0], x[1]))
    assert [(r.a, r.b) for r in sorted(ranked, key=lambda r: r.position)] == want
    assert sorted(r.position for r in ranked) == list(range(500))


def test_uid_sample_of_a_hub(spark):
    bridge = spark.range(20000).selectExpr("'host:hub' AS node_id", "lpad(id, 6, '0') AS uid", "timestamp_seconds(id DIV 10) AS time")
    got = g.sample_uids(bridge, ["node_id"], cap=50).orderBy("position").collect()
    assert [r.uid for r in got] == [f"{i:06d}" for i in range(50)]


def test_narrative_and_story(sample, built):
    told = narrative(sample, limit=None).collect()
    assert [r.time for r in told] == sorted(r.time for r in told) and sum(r["count"] for r in told) == 4
    bridge = g.link_events(m.relation_mentions(sample), built.aliases)
    steps = story(sample, bridge, "user:ann").collect()
    assert [s.time for s in steps] == sorted(s.time for s in steps)
    assert all("user:ann" in (s.source, s.target) for s in steps)
    text = {r.uid: r.text for r in sample.select("uid", sentence().alias("text")).collect()}
    assert text["0003"] == "ann ran x.exe on w1 as `x y`."


def test_whole_pipeline_and_export(spark, sample, tmp_path):
    graph = incident.filtered_graph(sample, max_nodes=50)
    assert {"role", "cluster", "level", "risk"} <= set(graph.nodes.columns)
    sinks.write_graph(graph, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g" / "nodes")).count() == graph.nodes.count()
    sections = incident.incident_report(sample, graph)
    sinks.write_sections({k: v for k, v in sections.items()}, str(tmp_path / "r"))
    sinks.write_indicator_list(sections["indicators"], str(tmp_path / "iocs"))
    values = [r.value for r in spark.read.text(str(tmp_path / "iocs")).collect()]
    assert "9.9.9.9" in values and "10.0.0.1" not in values
    assert sections["title"].first().title.startswith("Incident on ")


def test_risk_weights_ignore_junk():
    w = g.risk_weights({"severity": "20", "tactic": "x", "unknown": 5, "degree": -3})
    assert (w["severity"], w["tactic"], w["degree"]) == (20, 6, 0) and "unknown" not in w


def test_fewer_nodes_vote_each_round(spark):
    """A long chain beside settled stars: after the first rounds only the nodes near a moved one vote, with the same result."""
    from sleuthgraph.operators import iterate
    stars = [(f"h{k:02d}", f"h{k:02d}-{j}") for k in range(40) for j in range(6)]
    chain = [(f"z{k:03d}", f"z{k + 1:03d}") for k in range(25)]
    links = spark.createDataFrame(stars + chain, "source string, target string")
    nodes = links.selectExpr("explode(array(source, target)) AS node_id").distinct()
    voters = []
    got = {r.node_id: r.label for r in iterate.label_propagation(nodes, links, 12, voters).collect()}
    near = {}
    for a, b in stars + chain:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    labels = {v: v for v in near}
    for _ in range(12):
        heard = {v: [labels[u] for u in near[v]] + [labels[v]] for v in near}
        labels = {v: min(set(x), key=lambda c: (-x.count(c), c)) for v, x in heard.items()}
    assert got == labels and voters[0] == len(near) and voters[-1] < len(near) // 4


def test_fragments_by_automaton_and_by_windows(spark, make_events):
    from checks.catalog import catalog
    from sleuthgraph.operators import threat
    lines = ["Run sekurGRAB and pswalk", "wormscan wormscan tunnelrat", "nothing", None, "gitx", "psexecpsexec"]
    events = make_events([{"process": {"cmdline": line}} for line in lines])
    tools = catalog(spark).tools
    hits = lambda most: {tuple(r) for r in threat._fragment_hits(events, tools, most).select("uid", "tool", "evidence").distinct().collect()}
    assert hits(1000) == hits(1) and {t for _, t, _ in hits(1000)} >= {"GrabKeys", "WormScan", "TunnelRat", "PsWalk"}
    plan = threat._fragment_hits(events, tools)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and threat._fragment_hits(events.limit(0), tools.limit(0)).count() == 0
