"""An invented threat catalog for the registered queries and tests."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sleuthgraph.functions import fixed
from sleuthgraph.operators.threat import Catalog

# name, category, patterns, exact only
TOOLS = [
    ("GrabKeys", "Credential Theft", ["grab-keys.exe", "sekurgrab"], False),
    ("TunaSync", "Exfiltration", ["tuna-sync.exe"], False),
    ("FarHand", "RMM Tools", ["farhand.exe"], False),
    ("WormScan", "Discovery", ["wormscan"], False),
    ("Net", "LOLBAS", ["net.exe", "net1.exe"], True),
    ("NetLike", "LOLBAS", ["net.exe", "netlike.exe"], False),
    ("Schtasks", "LOLBAS", ["schtasks.exe", "schtasks"], False),
    ("ShadowCut", "Defense Evasion", ["vssadmin.exe"], False),
    ("TunnelRat", "Networking", ["tunnelrat.exe", "tunnelrat"], False),
    ("DumpTruck", "Credential Theft", ["procdump.exe"], False),
    ("PortHopper", "Networking", ["porthopper.exe"], False),
    ("PsWalk", "OffSec", ["psexec", "pswalk.exe"], False),
    ("GitLeech", "Exfiltration", ["gitx", "gitleech.exe"], False),
    ("Shelly", "OffSec", ["powershell.exe"], True),
    ("CoolBackup", "Exfiltration", ["coolbackup.exe"], False),
]

GROUPS = {
    "Blue Whale": ["GrabKeys", "TunaSync", "FarHand", "WormScan", "Net", "ShadowCut"],
    "Red Squid": ["Net", "NetLike", "Schtasks", "TunnelRat", "PortHopper"],
    "Grey Seal": ["Net", "FarHand", "DumpTruck", "PsWalk"],
    "White Gull": ["Net", "CoolBackup"],
    "Black Crab": ["PortHopper", "CoolBackup"],
    "Green Eel": ["Net", "TunaSync", "GitLeech", "PortHopper", "TunnelRat", "CoolBackup", "WormScan"],
}

NOTES = {
    "WHALE_README.txt": ["Blue Whale"],
    "RECOVER-FILES.txt": ["redsquid", "Grey Seal", "Blue Whale"],
    "README.txt": ["Blue Whale", "Red Squid", "Grey Seal", "White Gull", "Black Crab", "Green Eel", "Pink Ray", "Old Cod"],
    "lonely.hta": ["Nobody Known"],
}


def tool_groups(tool: str) -> list[str]:
    return sorted(g for g, tools in GROUPS.items() if tool in tools)


def catalog(spark: SparkSession) -> Catalog:
    tools = spark.createDataFrame(
        [(n, c, fixed.CATEGORY_LABEL[c], fixed.CATEGORY_TACTIC[c], p, x, tool_groups(n)) for n, c, p, x in TOOLS],
        "name string, category string, category_label string, tactic string, patterns array<string>, "
        "exact_only boolean, groups array<string>")
    groups = spark.createDataFrame(list(GROUPS.items()), "name string, tools array<string>")
    notes = spark.createDataFrame(list(NOTES.items()), "filename string, groups array<string>")
    return Catalog(tools, groups, notes)
