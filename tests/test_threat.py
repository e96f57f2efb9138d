import pytest
from pyspark.sql import functions as F

from checks import catalog as cat
from sleuthgraph.functions import fixed
from sleuthgraph.operators import attribution as a
from sleuthgraph.operators import threat as t


def proc(cmdline, name="p.exe", **more):
    return {"class_name": "Process Activity", "process": {"name": name, "path": name, "cmdline": cmdline}, "device": {"hostname": "w1"}, **more}


def file(name):
    return {"class_name": "File System Activity", "file": {"name": name}, "device": {"hostname": "w1"}}


def seen(spark, events):
    return {(r.uid, r.tool, r.place) for r in t.tool_sightings(events, cat.catalog(spark)).collect()}


def test_tools(spark, make_events):
    events = make_events([proc("tuna-sync.exe copy a b"), proc("type c:\\tuna-sync-backup\\x.docx"), proc("net.exe view"), proc("x", name="NET.EXE"),
                          proc("run SEKURGRAB::all"), proc("farhand.exe:ads run")])
    assert seen(spark, events) == {("0000", "TunaSync", "cmdline"), ("0003", "Net", "process"), ("0004", "GrabKeys", "cmdline"), ("0005", "FarHand", "cmdline")}


def test_notes(spark, make_events):
    events = make_events([file(n) for n in ("whale_readme.txt", "How_to_decrypt_abc.hta", "readme.log", "report.txt", "!!!_READ_ME.txt")])
    got = {(r.filename, r.known) for r in t.note_sightings(events, cat.catalog(spark)).collect()}
    assert got == {("WHALE_README.txt", True), ("How_to_decrypt_abc.hta", False), ("!!!_READ_ME.txt", False)}


def test_notes_by_name_lists_their_hosts(spark, make_events):
    on = lambda host, name: file(name) | {"device": {"hostname": host}}
    events = make_events([on("w2", "whale_readme.txt"), on("w1", "whale_readme.txt"), on("w2", "WHALE_README.txt"), on("w3", "!!!_READ_ME.txt")])
    got = {r.filename: (r.hosts, r.n_hosts, r.sightings) for r in t.notes_by_name(t.note_sightings(events, cat.catalog(spark))).collect()}
    assert got == {"WHALE_README.txt": (["w1", "w2"], 2, 3), "!!!_READ_ME.txt": (["w3"], 1, 1)}


@pytest.mark.parametrize("command, signature", [
    ("vssadmin delete shadows /all", "shadow_copy_delete"), ("bcdedit /set x safeboot minimal", "safe_mode_boot"),
    ("sc stop sophos", "defender_disable"), ("wevtutil.exe cl System", "event_log_clear"), ("rclone copy a b", "exfil_tooling"),
    ("reg save hklm\\sam c:\\s", "credential_dump"), ("net group \"domain admins\"", "domain_recon"), ("7z a -pX o.7z d", "archive_staging"),
    ("wbadmin delete catalog", "backup_catalog_delete"), ("net stop veeam", "backup_service_stop"), ("net view", "share_enum"),
    ("psexec \\\\h cmd", "mass_deploy"), ("bcdedit /set x recoveryenabled no", "recovery_disable")])
def test_signatures(make_events, command, signature):
    assert signature in {r.signature for r in t.behaviour_hits(make_events([proc(command)])).collect()}


def test_benign_work_and_long_text(make_events):
    assert t.behaviour_hits(make_events([proc("ipconfig /all"), proc("git push"), proc("notepad a.txt")])).count() == 0
    assert t.behaviour_hits(make_events([proc("x" * 6000 + " vssadmin delete shadows")])).count() == 1


def findings(spark, events):
    return t.scan(events, cat.catalog(spark))


def test_unique_note_is_high_and_shared_is_not(spark, make_events):
    best = a.attribute(findings(spark, make_events([file("WHALE_README.txt")])), cat.catalog(spark)).first()
    assert (best.group, best.confidence) == ("Blue Whale", "high")
    shared = a.attribute(findings(spark, make_events([file("README.txt")])), cat.catalog(spark)).collect()
    assert shared and all(r.confidence == "inconclusive" for r in shared)
    assert a.attribute(findings(spark, make_events([proc("git status")])), cat.catalog(spark)).count() == 0


def test_ladder_and_floor(spark, make_events):
    f = findings(spark, make_events([proc("rclone copy a b"), proc("rclone copy a b"), proc("nltest /dclist:x")]))
    ladder = {r.stage: r for r in t.stage_ladder(f, spark).collect()}
    assert len(ladder) == len(fixed.STAGES) and ladder["exfiltration"]["count"] == 2 and len(ladder["exfiltration"].evidence) == 1
    assert t.next_stage(t.stage_ladder(f, spark)).first().stage == "inhibit"
    assert t.severity_floor(f).first().severity_floor == 4
    assert t.severity_floor(findings(spark, make_events([proc("git status")]))).first().severity_floor == 0


def test_limits_of_evidence(spark, make_events):
    long = "vssadmin delete shadows " + "x" * 400
    events = make_events([proc(long)] + [proc(f"{tool} -a") for tool in ("nltest /dclist:x", "rclone copy a b")] + [file("WHALE_README.txt")])
    f = t.scan(events, cat.catalog(spark), tool_chars=None, behaviour_chars=None)
    assert max(len(r.evidence) for r in f.behaviours.collect()) > 400
    whole = {r.stage: r for r in t.stage_ladder(f, spark, limit=None).collect()}
    assert all(r.hidden == 0 for r in whole.values())
    for r in t.stage_ladder(f, spark, limit=1).collect():
        pieces = len(whole[r.stage].evidence or [])
        assert r.hidden == max(0, pieces - 1) and len(r.evidence or []) == min(1, pieces)
    assert {(r.filename, r.host, r.sightings) for r in t.note_hosts(f.notes).collect()} == {
        (r.filename, r.host, 1) for r in f.notes.collect()}


def test_building_the_catalog(spark):
    matrix = spark.createDataFrame([("Grab Keys*", "Net"), ("Temp[.]sh ", None)], "`Credential Theft` string, LOLBAS string")
    curated = spark.createDataFrame([("Net", ["net.exe", "net1.exe"])], "name string, patterns array<string>")
    tools = t.tool_dimension(matrix, curated)
    rows = {r.name: r for r in tools.collect()}
    assert set(rows) == {"Grab Keys", "Temp.sh", "Net"}
    assert rows["Grab Keys"].patterns == ["grab-keys.exe", "grab_keys.exe", "grabkeys.exe"] and rows["Net"].exact_only and rows["Net"].curated
    profiles = spark.createDataFrame([("Blue Whale", {"LOLBAS": ["Net"], "OffSec": ["NewTool"]})], "name string, tools_by_category map<string,array<string>>")
    full = {r.name: r.groups for r in t.complete_tools(tools, profiles, curated).collect()}
    assert full == {"Grab Keys": [], "Temp.sh": [], "Net": ["Blue Whale"], "NewTool": ["Blue Whale"]}
    notes = t.note_dimension(spark.createDataFrame([("bluewhale", "Read.txt"), ("Other", "read.TXT")], "`group` string, filename string"),
                             t.group_dimension(profiles))
    assert [(r.key, r.groups) for r in notes.collect()] == [("read.txt", ["Blue Whale", "Other"])]
    groups = {r.name: (r.tools, r.notes) for r in t.group_dimension(profiles, notes).collect()}
    assert groups["Blue Whale"] == (["Net", "NewTool"], ["Read.txt"])
    stats = t.catalog_statistics(cat.catalog(spark)).first()
    assert (stats.tools, stats.groups, stats.ransom_notes) == (len(cat.TOOLS), len(cat.GROUPS), len(cat.NOTES))
