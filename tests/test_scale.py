"""Work is dealt out by rows and done once: plans and frames of the steps that wide queries share."""

import itertools
import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from checks import queries_report
from sleuthgraph.operators import graph as g
from sleuthgraph.operators import iterate, runs
from sleuthgraph.operators import mentions as m
from sleuthgraph.operators import normalize as n
from sleuthgraph.plans import incident
from sleuthgraph.plans.session import spread
from sleuthgraph.sources import records, textlogs


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    pq.write_table(pa.table({"id": list(range(40_000)), "text": [str(random.random()) for _ in range(40_000)]}), tmp_path / "one.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        scan = spark.read.parquet(str(tmp_path / "one.parquet"))
        assert scan.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = [r["count"] for r in spread(scan).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(sizes) == 40_000 and max(sizes) <= 10_000


def filters(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]


def test_lines_are_parsed_once(spark):
    lines = ['{"a": 1}', '{"a": 2} {"a": 3},', "[]", "[1, {\"a\": 4}]", "text", "", None, "[", '{"a":']
    rows = spark.createDataFrame([(x, "f") for x in lines], "line string, origin_file string")
    parsed = records.parse_ndjson(rows)
    assert not any("from_json" in x for x in filters(parsed)) and not any("from_json" in x for x in filters(textlogs.parse_lines(rows)))
    assert sorted(r.record["a"] for r in parsed.collect()) == ["1", "2", "3", "4"]
    assert sorted(r.line for r in records.ndjson_rejects(rows).collect()) == ["1", "text", '{"a":']


def test_slots_are_compiled(spark):
    rows = spark.createDataFrame([({"sourcetype": "x", "_time": "1", "user": "-", "Account_Name": "ann", "EventCode": "4624"},)], "record map<string,string>")
    slots = n.with_slots(n.with_route(rows))
    assert slots.select("s_user", "s_device").collect() == [("ann", None)]
    plan = slots.select("s_user")._jdf.queryExecution().analyzed().toString()
    assert "filter(transform(" not in plan


def test_a_built_graph_is_not_built_again(make_events):
    events = make_events([{"class_name": "Authentication", "actor": {"user": u}, "device": {"hostname": h}}
                          for u, h in (("ann", "w1"), ("bob", "w1"), ("cat", "w2"), ("bob", "w2"))])
    graph = g.build_graph(events).cut()
    unread = events.where(F.raise_error(F.lit("read again")).isNull())
    got = incident.neighbours_of(unread, "user:ann", built=graph).nodes.select("node_id", "risk").collect()
    assert sorted(got) == sorted(incident.neighbours_of(events, "user:ann").nodes.select("node_id", "risk").collect())
    assert {r.node_id for r in got} == {"user:ann", "host:w1"}


def test_runs_take_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(value):
        seen.add(1)
        return str(value // 10)

    rows = spark.range(100).select("id", told("id").alias("text"))
    assert runs.number_runs(rows, ["id"], ["text"]).where("run_id = id div 10").count() == 100
    assert seen.value == 100


def test_labels_travel_as_numbers(spark, monkeypatch):
    ids = [f"n{k}" for k in range(30)]
    chosen = random.Random(7).sample(list(itertools.combinations(ids, 2)), 45)
    kept = []
    monkeypatch.setattr(iterate, "cut", lambda df, real=iterate.cut: kept.append(dict(df.dtypes)) or real(df))
    links = spark.createDataFrame([*chosen, (None, "n1")], "source string, target string")
    got = {r.node_id: r.label for r in iterate.label_propagation(
        spark.createDataFrame([(x,) for x in [*ids, None]], "node_id string"), links).collect()}
    labels = {x: x for x in ids}
    for _ in range(12):
        heard = {x: [labels[x]] for x in ids}
        for a, b in chosen:
            heard[a].append(labels[b])
            heard[b].append(labels[a])
        labels = {x: min(set(v), key=lambda c: (-v.count(c), c)) for x, v in heard.items()}
    assert got == labels | {None: None}
    assert {d["label"] for d in kept if "label" in d} == {"bigint"}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_masks_and_mentions_are_columns_before_the_generator(make_events):
    """What stands beside a generator is computed for each row it returns, and its own expression is interpreted."""
    events = make_events([{"class_name": "Authentication", "actor": {"user": "ann"}, "device": {"hostname": "w1"}}])
    for df in (m.graph_mentions(events), m.entity_mentions(events), m.relation_mentions(events)):
        above, below = plan_of(df.drop("uid")).split("Generate ", 1)
        assert "element_at" not in above and "aggregate(" not in above
        assert below.startswith("inline(_mentions#")


def test_relations_build_ids_only(make_events):
    events = make_events([{"class_name": "Authentication", "actor": {"user": "ann"}, "device": {"hostname": "w1"}}])
    assert "label," not in plan_of(m.relation_mentions(events))
    assert m.relation_mentions(events).select("source", "target", "rel", "detail").collect() == [("user:ann", "host:w1", "authenticated", None)]


def test_mentions_of_one_array_are_those_of_two(make_events):
    """Events that name a node twice, once or not at all, of every class and with extra entities."""
    chosen = random.Random(3)
    pick = lambda *xs: chosen.choice([None, *xs])
    end = lambda: pick({"hostname": "w1"}, {"hostname": "W1.corp", "ip": "10.0.0.1"}, {"ip": "10.0.0.1"}, {"hostname": "10.0.0.1"}, {"ip": "8.8.8.8"})
    image = lambda: pick({"name": "a.exe", "path": "C:\\a.exe", "parent_name": "C:\\A.exe"}, {"name": "a.exe"},
                         {"name": "b.exe", "parent_name": "a.exe"})
    rows = [{"class_name": kind, "actor": pick({"user": "ann"}, {"user": "CORP\\Ann"}), "device": end(), "src": end(), "dst": end(),
             "process": image(), "file": pick({"name": "f.txt"}, {"name": "F.txt", "path": "C:\\f.txt", "md5": "d" * 32}),
             "email": pick({"sender": "a@x.org", "recipient": "A@x.org"}, {"sender": "b@x.org", "recipient": "a@x.org", "url": "http://x.org/a"}),
             "domain": pick("x.org", "10.0.0.1"), "app": pick("Portal"), "source": pick("splunk", "other"),
             "extra_entities": pick([{"type": "host", "value": "w1"}], [{"type": "host", "value": "w1"}, {"type": "user", "value": ""}], []),
             "mitre": pick([], [{"id": "T1486", "name": "x", "tactic": "impact"}])}
            for kind in ("Authentication", "Process Activity", "Network Activity", "File System Activity", "DNS Activity", "Email Activity",
                         "Account Change", "Detection Finding", None) for _ in range(60)]
    events = make_events(rows)
    ents = m.entity_mentions(events).select("uid", "source_mask", "tactic_mask", F.lit(0).alias("kind"), "node_id", "type", "label", "ip", "path")
    rels = m.relation_mentions(events).select("uid", "source_mask", F.lit(1).alias("kind"), "source", "target", "rel")
    got = m.graph_mentions(events)
    assert sorted(map(str, got.where("kind = 0").select("uid", "source_mask", "tactic_mask", "kind", "a", "b", "c", "ip", "path").collect())) == sorted(
        str(r).replace("node_id=", "a=").replace("type=", "b=").replace("label=", "c=") for r in ents.collect())
    assert sorted(map(tuple, got.where("kind = 1").select("uid", "source_mask", "kind", "a", "b", "c").collect())) == sorted(map(tuple, rels.collect()))
    assert got.where("kind = 0").groupBy("uid", "a").count().where("count > 1").isEmpty()


def test_roles_read_a_written_graph(spark, make_events, monkeypatch):
    events = make_events([{"class_name": "Authentication", "actor": {"user": u}, "device": {"hostname": h}}
                          for u, h in (("ann", "w1"), ("bob", "w1"), ("cat", "w2"))])
    given, written = [], []
    monkeypatch.setattr(queries_report, "built", lambda spark, sf: g.build_graph(events))
    monkeypatch.setattr(incident, "assign_roles", lambda graph, real=incident.assign_roles: given.append(graph) or real(graph))
    for module in (incident, g):
        monkeypatch.setattr(module, "cut", lambda df, real=g.cut: written.append(df.columns) or real(df))
    roles = queries_report.enriched(spark, "")
    assert {r.node_id: r.role for r in roles.nodes.collect()} == {f"{k}": "asset" for k in ("user:ann", "user:bob", "user:cat", "host:w1", "host:w2")}
    assert "Join" not in plan_of(given[0].nodes) and "Join" not in plan_of(given[0].links)
    assert sum("link_id" in x for x in written) == 1
    written.clear()
    incident.filtered_graph(events, clusters=False, levels=False)
    assert sum("link_id" in x for x in written) == 1
    written.clear()
    pruned = incident.filtered_graph(events, entity_types=["user"], clusters=False, levels=False)
    assert sum("link_id" in x for x in written) == 2 and pruned.links.count() == 0


def voted(nodes, pairs, rounds=12):
    """Label rounds by hand: a node given several times votes as often, pairs count once in each direction."""
    times = {x: nodes.count(x) for x in nodes if x is not None}
    ends = {(a, b) for a, b in pairs if a in times and b in times}
    near = {x: {b for a, b in ends | {(b, a) for a, b in ends} if a == x} for x in times}
    labels = {x: x for x in times}
    for _ in range(rounds):
        heard = {x: [labels[x]] * times[x] + [labels[y] for y in near[x] for _ in range(times[y])] for x in times}
        labels = {x: min(set(v), key=lambda c: (-v.count(c), c)) for x, v in heard.items()}
    return labels | {None: None}


def odd_graph():
    """Repeated nodes and links, links both ways, to oneself, to nowhere and to a node that is not given; a node without links; a hub."""
    ids = [f"n{k:02d}" for k in range(70)]
    chosen = random.Random(11).sample(list(itertools.combinations(ids[:-1], 2)), 90)
    pairs = [*chosen, *chosen[:20], *[(b, a) for a, b in chosen[10:30]], *[("n50", x) for x in ids[:40]], ("n05", "n05"), ("n60", "n60"),
             (None, "n01"), ("n02", None), (None, None), ("n03", "gone"), ("gone", "away")]
    return [*ids, None, *ids[20:30], *ids[25:30], None], pairs


def test_labels_of_many_slices(spark, monkeypatch):
    from sleuthgraph.operators import slices
    monkeypatch.setattr(slices, "LEAST", 8)
    monkeypatch.setattr(slices, "PER_SLICE", 16)
    monkeypatch.setattr(slices, "CHUNK", 8)
    monkeypatch.setattr(iterate, "FEW", 0)
    nodes, pairs = odd_graph()
    assert slices.slice_bits(70, len(pairs), 4) >= 4
    links = spark.createDataFrame(pairs, "source string, target string")
    for rounds in (0, 1, 2, 12):
        got = iterate.label_propagation(spark.createDataFrame([(x,) for x in nodes], "node_id string"), links, rounds).collect()
        assert sorted(str(r.node_id) for r in got) == sorted(map(str, nodes))
        assert {r.node_id: r.label for r in got} == voted(nodes, pairs, rounds)
    none = spark.createDataFrame([], "node_id string")
    assert iterate.label_propagation(none, links).collect() == []
    assert iterate.label_propagation(none.unionByName(spark.createDataFrame([("a",)], "node_id string")), links.limit(0)).collect() == [("a", "a")]


def test_edges_are_no_rows_and_nodes_are_read_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(value):
        seen.add(1)
        return value

    written = []
    monkeypatch.setattr(iterate, "cut", lambda df, real=iterate.cut: written.append(real(df)) or written[-1])
    pairs = random.Random(5).sample(list(itertools.combinations([f"n{k:02d}" for k in range(40)], 2)), 200)
    nodes = spark.createDataFrame([(f"n{k:02d}",) for k in range(40)], "node_id string").select(told("node_id").alias("node_id"))
    iterate.label_propagation(nodes, spark.createDataFrame(pairs, "source string, target string")).collect()
    assert seen.value == 40
    assert max(df.count() for df in written) == len(pairs)
