"""Record maps of any vendor -> the event table, in one pass over the records.

Three stages of columns, no shuffle and no second scan: a *route* per record
(vendor and kind), *slots* filled from the route's field names, and the event
columns derived from the slots.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon, fixed, values
from ..sources.records import last_wins_map
from . import field_names as names

ENTITY_TYPE = "array<struct<type:string,value:string>>"


def _has(key: str) -> Column:
    return F.map_contains_key("record", F.lit(key))


def _get(key: str, source: str = "record") -> Column:
    return F.try_element_at(F.col(source), F.lit(key))


def _first(keys: list[str], source: str = "record") -> Column:
    return canon.first_of(*[_get(k, source) for k in keys])


def _filled(value: Column) -> Column:
    return canon.not_in(value, [""])


def _count(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [t.cast("int") for t in tests])


def _any_word(text: Column, words: list[str]) -> Column:
    return F.coalesce(canon.contains_any(text, words), F.lit(False))


# --- routing ----------------------------------------------------------------------------

def _splunk_route() -> Column:
    sourcetype = F.lower(F.coalesce(_filled(_get("sourcetype")), _filled(_get("source")), F.lit("")))
    code = F.coalesce(canon.strip(_first(["EventCode", "EventID", "signature_id"])), F.lit(""))
    code = F.when(code.isin(names.SYSMON_ONLY) & ~sourcetype.contains("sysmon"), "").otherwise(code)
    kind = F.coalesce(
        F.try_element_at(values.literal_map(names.EVENT_CODES), code),
        F.when(canon.contains_any(sourcetype, names.NETWORK_SOURCETYPES), "network").when(sourcetype.contains("dns"), "dns"),
        F.when(_first(["dest_ip", "dest", "DestinationIp"]).isNotNull(), "network"),
        F.when(_first(["process", "process_name", "Image"]).isNotNull(), "process"),
        F.when(_first(["user", "Account_Name"]).isNotNull(), "logon"))
    stamped = _has("_time") | _has("_raw")
    mine = _filled(_get("__format__")).isNull() & stamped & (
        (sourcetype != "") | _first(["EventCode", "EventID"]).isNotNull())
    return F.when(mine, F.concat(F.lit("splunk."), kind))


def _sentinel_route() -> Column:
    named = F.coalesce(_filled(_get("Type")), _filled(_get("TableName")))
    guess = (F.when(_has("AlertName") | _has("AlertSeverity"), "SecurityAlert")
             .when(_has("ProcessCommandLine") | _has("FolderPath"), "DeviceProcessEvents")
             .when(_has("RemoteUrl") | _has("RemoteIP"), "DeviceNetworkEvents")
             .when(_has("UserPrincipalName") & _has("ResultType"), "SigninLogs")
             .when(_has("SenderFromAddress") | _has("RecipientEmailAddress"), "EmailEvents")
             .when(_has("SHA256") & _has("FileName"), "DeviceFileEvents")
             .when(_has("LogonType"), "DeviceLogonEvents"))
    tables = values.literal_map(names.HUNTING_TABLES)
    mine = F.try_element_at(tables, named).isNotNull() | (_count([_has(m) for m in names.HUNTING_MARKERS]) >= 2)
    return F.when(F.coalesce(mine, F.lit(False)), F.concat(F.lit("sentinel."), F.try_element_at(tables, F.coalesce(named, guess))))


def _qradar_route() -> Column:
    keys = F.transform(F.map_keys("record"), F.lower)
    markers = F.size(F.array_intersect(keys, F.array(*[F.lit(m) for m in names.ARIEL_MARKERS])))
    has = lambda k: F.array_contains(keys, k)
    offense = has("offense_type") | has("offense_source")
    mine = (markers >= 2) | has("offense_type") | (has("offense_source") & has("magnitude"))
    return F.when(mine, F.when(offense, "qradar.offense").otherwise("qradar.event"))


def with_route(records: DataFrame) -> DataFrame:
    """``route`` per record: first vendor that claims it and knows its kind, else generic."""
    return records.withColumn("route", F.coalesce(_splunk_route(), _sentinel_route(), _qradar_route(), F.lit("generic")))


# --- slots ----------------------------------------------------------------------------------

def _slot(by_route: dict[str, list[str]]) -> Column:
    """First filled field among the route's candidates.

    The first, second, ... candidates are each chosen by route (whole-vendor entries
    come after the specific ones), so a slot costs comparisons with the route and
    at most as many map lookups as it has candidates, all of them compiled.
    """
    ordered = sorted(by_route, key=lambda k: ("." not in k, k))

    def candidate(place: int) -> Column:
        key = None
        for name in ordered:
            exact = "." in name or name == "generic"
            test = F.col("route") == name if exact else F.col("route").startswith(name + ".")
            field = F.lit(by_route[name][place] if place < len(by_route[name]) else None).cast("string")
            key = F.when(test, field) if key is None else key.when(test, field)
        return F.try_element_at("_filled", key)

    return F.coalesce(*[candidate(k) for k in range(max(map(len, by_route.values())))])


def with_slots(routed: DataFrame) -> DataFrame:
    ariel = F.col("route").startswith("qradar")
    staged = routed.withColumns({"_keys": F.when(ariel, F.transform(F.map_keys("record"), F.lower)),
                                 "_vals": F.when(ariel, F.map_values("record"))})
    staged = staged.withColumn("_lowered", F.when(ariel, last_wins_map(F.col("_keys"), F.col("_vals"))))
    filled = F.map_filter(F.coalesce("_lowered", "record"), lambda k, v: v.isNotNull() & ~v.isin(canon.EMPTY_MARKS))
    fields = staged.withColumn("_filled", filled).drop("_keys", "_vals")
    return fields.withColumns({f"s_{name}": _slot(by_route) for name, by_route in names.SLOTS.items()})


# --- events ----------------------------------------------------------------------------------------

def _route(*kinds: str) -> Column:
    return F.col("route").isin(*kinds)


def _hints() -> Column:
    parts = ["name", "message", "action", "category", "signature", "event_type", "_raw"]
    return F.when(_route("generic"), F.lower(F.concat_ws(" ", *[F.coalesce(_get(p), F.lit("")) for p in parts])))


def _classes() -> dict[str, Column]:
    """Class and failure flag of the routes that have to be classified by words."""
    c = F.col
    ariel, hints = c("_ariel"), c("_hints")
    ariel_class = (F.when(_any_word(ariel, names.ARIEL_AUTH), fixed.AUTHENTICATION)
                   .when(_any_word(ariel, names.ARIEL_FILE), fixed.FILE_ACTIVITY)
                   .when(_any_word(ariel, names.ARIEL_PROCESS), fixed.PROCESS_ACTIVITY)
                   .when(_any_word(ariel, names.ARIEL_NETWORK) | _first(["sourceip", "destinationip"], "_lowered").isNotNull(),
                         fixed.NETWORK_ACTIVITY).otherwise(fixed.DETECTION_FINDING))
    present = lambda keys: _first(keys).isNotNull()
    hint_class = (F.when(_any_word(hints, names.HINT_AUTH), fixed.AUTHENTICATION)
                  .when(_any_word(hints, names.HINT_PROCESS) | present(["process_name", "cmdline", "command_line"]), fixed.PROCESS_ACTIVITY)
                  .when(_any_word(hints, names.HINT_FILE) | present(["file_name", "file_path", "file_hash"]), fixed.FILE_ACTIVITY)
                  .when(_any_word(hints, names.HINT_NETWORK) | present(["src_ip", "dest_ip", "url"]), fixed.NETWORK_ACTIVITY)
                  .otherwise(fixed.DETECTION_FINDING))
    by_route = {
        fixed.AUTHENTICATION: ["splunk.logon", "splunk.logon_failed", "sentinel.DeviceLogonEvents", "sentinel.SigninLogs"],
        fixed.PROCESS_ACTIVITY: ["splunk.process", "sentinel.DeviceProcessEvents"],
        fixed.NETWORK_ACTIVITY: ["splunk.network", "sentinel.DeviceNetworkEvents"],
        fixed.FILE_ACTIVITY: ["splunk.file", "sentinel.DeviceFileEvents"],
        fixed.DNS_ACTIVITY: ["splunk.dns", "sentinel.DeviceEvents"],
        fixed.ACCOUNT_CHANGE: ["splunk.account"],
        fixed.EMAIL_ACTIVITY: ["sentinel.EmailEvents"],
        fixed.DETECTION_FINDING: ["sentinel.alert", "qradar.offense"],
    }
    cls = F.when(_route("qradar.event"), ariel_class).when(_route("generic"), hint_class)
    for name, routes in by_route.items():
        cls = cls.when(_route(*routes), name)
    action = F.lower(F.coalesce(c("s_action"), F.lit("")))
    verdict = F.lower(F.concat_ws(" ", _get("DeliveryAction"), _get("ThreatTypes")))
    ariel_text = F.lower(F.concat_ws(" ", *[_first([k], "_lowered") for k in ("categoryname", "qidname", "eventname")]))
    failed = (F.when(_route("splunk.logon_failed"), True)
              .when(_route("splunk.network"), action.isin(names.BLOCK_ACTIONS))
              .when(_route("sentinel.DeviceNetworkEvents"), action.contains("fail") | action.contains("block"))
              .when(_route("sentinel.DeviceLogonEvents"), ~action.contains("success"))
              .when(_route("sentinel.SigninLogs"), ~F.coalesce(values.to_int(c("s_result")) == 0, F.lit(False)))
              .when(_route("sentinel.EmailEvents"), verdict.contains("block"))
              .when(_route("qradar.event"), _any_word(ariel_text, names.ARIEL_FAILURE))
              .when(_route("generic"), _any_word(hints, names.HINT_FAILURE) & ~action.isin(names.HINT_SUCCESS))
              .otherwise(False))
    return {"class_name": cls, "_failed": failed, "_action": action, "_verdict": verdict}


def _alert_entities() -> dict[str, Column]:
    """Entities listed by an alert, sorted by kind into arrays of values."""
    items = F.when(_route("sentinel.alert"), F.from_json(_get("Entities"), "array<map<string,string>>"))
    pick = lambda item, *keys: F.coalesce(*[_filled(F.try_element_at(item, F.lit(k))) for k in keys])
    kind = lambda item: F.lower(F.coalesce(pick(item, "Type", "$id"), F.lit("")))
    clean = lambda col: F.filter(col, lambda v: v.isNotNull())
    of = lambda kinds, value: clean(F.transform(F.filter(items, lambda i: kind(i).isin(*kinds)), value))
    files = F.filter(items, lambda i: kind(i).isin("file", "filehash") & pick(i, "Name", "Value").isNotNull())
    return {
        "_hosts": of(["host"], lambda i: canon.canon_host(pick(i, "HostName", "NetBiosName"))),
        "_users": of(["account"], lambda i: pick(i, "Name", "AadUserId")),
        "_user_suffix": F.try_element_at(of(["account"], lambda i: F.when(
            pick(i, "Name", "AadUserId").isNotNull(), F.coalesce(pick(i, "UPNSuffix"), F.lit("")))), F.lit(1)),
        "_ips": of(["ip"], lambda i: pick(i, "Address")),
        "_named_file": F.try_element_at(files, F.lit(1)),
        "_alert_url": F.try_element_at(of(["url", "dnsresolution"], lambda i: pick(i, "Url", "DomainName")), F.lit(-1)),
    }


def _rest(kind: str, values_: Column, skip_first: Column) -> Column:
    rest = F.when(skip_first, F.slice(values_, F.lit(2), F.greatest(F.size(values_) - 1, F.lit(0)))).otherwise(values_)
    made = F.transform(rest, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))
    return F.coalesce(made, F.array().cast(ENTITY_TYPE))


def _endpoint(host: Column, ip: Column, port: Column) -> Column:
    return F.when(host.isNotNull() | ip.isNotNull() | port.isNotNull(), F.struct(
        host.alias("hostname"), ip.alias("ip"), port.alias("port"), F.lit(None).cast("string").alias("mac"),
        F.lit(None).cast("string").alias("os")))


def _derived(slots: DataFrame) -> DataFrame:
    c = F.col
    out = slots.withColumns({
        "_ariel": F.lower(F.concat_ws(" ", F.coalesce("s_category", F.lit("")), F.coalesce("s_event_name", F.lit("")))),
        "_hints": _hints(), **_alert_entities(),
        "_payload": values.decode_payload(c("s_payload")), "_time_text": values.clean_time(c("s_time")),
    })
    out = out.withColumns(_classes())
    keep_raw = _route("sentinel.DeviceNetworkEvents", "sentinel.SigninLogs")
    checked = lambda slot: F.when(canon.is_ip(c(slot)), c(slot))
    device = F.coalesce(
        canon.canon_host(c("s_device")),
        F.when(_route("qradar.event") & ~canon.looks_like_product(c("s_log_source")), canon.canon_host(c("s_log_source"))),
        F.when(_route("qradar.offense") & ~canon.is_ip(c("s_src_ip")), canon.canon_host(c("s_src_ip"))))
    own = device.isNotNull()
    answers = F.transform(F.split("s_answers", ";"), lambda a: canon.strip(F.ltrim(canon.strip(a), F.lit("type:"))))
    app_class = c("class_name") == fixed.PROCESS_ACTIVITY
    file_class = c("class_name") == fixed.FILE_ACTIVITY
    net_class = c("class_name") == fixed.NETWORK_ACTIVITY
    ariel = _route("qradar.event")
    image_ok = ~ariel | app_class
    name = F.when(image_ok, canon.basename(c("s_image")))
    cmdline = F.when(ariel & app_class, F.coalesce("s_cmdline", _filled(c("_payload")))).when(~ariel, c("s_cmdline"))
    found_hash = lambda algo: values.listed_hash(c("s_hashes"), algo)
    generic_hash = lambda n: F.when(F.length("s_any_hash") == n, c("s_any_hash"))
    alert_file = lambda *keys: F.coalesce(*[_filled(F.try_element_at(c("_named_file"), F.lit(k))) for k in keys])
    out = out.withColumns({
        "_device": F.coalesce(device, F.try_element_at(c("_hosts"), F.lit(1)),
                              F.when(_route("sentinel.alert"), canon.canon_host(c("s_compromised")))),
        "_host_from_list": ~own,
        "_src_ip": F.when(keep_raw, c("s_src_ip")).otherwise(checked("s_src_ip")),
        "_src_host": canon.canon_host(c("s_src_host")),
        "_dst_ip": F.coalesce(checked("s_dst_ip"), F.try_element_at(c("_ips"), F.lit(1)),
                              F.try_element_at(F.filter(answers, canon.is_ip), F.lit(1))),
        "_dst_host": F.when(~canon.is_ip(c("s_dst_host")), canon.canon_host(c("s_dst_host"))),
        "_user": F.coalesce("s_user", F.try_element_at(c("_users"), F.lit(1))),
        "_user_domain": F.coalesce("s_user_domain", _filled(c("_user_suffix"))),
        "_name": name,
        "_path": F.when(image_ok, F.coalesce("s_image_folder", "s_image")),
        "_cmdline": cmdline,
        "_parent": canon.basename(c("s_parent")),
        "_parent_path": F.when(_route("splunk.process"), c("s_parent")).otherwise(c("s_parent_folder")),
        "_sha256": F.lower(F.coalesce(found_hash("sha256"), F.when(~ariel | file_class, c("s_sha256")), generic_hash(64),
                                      F.when(_route("sentinel.alert"), alert_file("Value")))),
        "_md5": F.lower(F.coalesce(found_hash("md5"), F.when(~ariel | file_class, c("s_md5")), generic_hash(32))),
        "_url": F.coalesce("s_url", "_alert_url"),
    })
    of_process = _route("splunk.process", "sentinel.DeviceProcessEvents")
    hashed = F.coalesce("_sha256", "_md5").isNotNull() | F.coalesce(c("s_hashes").contains("="), F.lit(False))
    named_file = F.when(ariel, F.when(file_class, c("s_file"))).otherwise(c("s_file"))
    out = out.withColumns({
        "_file_name": F.when(of_process & hashed, c("_name")).when(_route("sentinel.alert"), canon.basename(alert_file("Name", "Value")))
        .otherwise(canon.basename(named_file)),
        "_file_path": F.when(of_process & hashed, F.when(_route("splunk.process"), c("s_image")).otherwise(c("s_image_folder")))
        .when(~_route("sentinel.alert"), F.coalesce("s_file_folder", named_file)),
        "_domain": F.when(_route("sentinel.DeviceNetworkEvents") | (_route("generic") & c("s_url").isNotNull()),
                          canon.canon_domain(canon.url_host(c("s_url"))))
        .when(_route("sentinel.alert"), canon.canon_domain(F.substring_index(F.substring_index("_alert_url", "//", -1), "/", 1)))
        .when(~ariel | net_class, canon.canon_domain(c("s_domain_text"))),
        "_reach": F.coalesce(c("_dst_ip").isNotNull() & ~canon.is_private_ip(c("_dst_ip")), F.lit(False)),
        "_remote": F.when(_route("splunk.logon"), values.to_int(c("s_logon_type")).cast("string").isin(fixed.REMOTE_LOGON_TYPES))
        .when(_route("sentinel.DeviceLogonEvents") & ~c("_failed"), F.lower("s_logon_type").isin("network", "remoteinteractive"))
        .otherwise(F.lit(False)),
    })
    rdp = F.lower("s_logon_type").isin("10", "remoteinteractive")
    one = values.fixed_technique
    outbound = ariel & net_class & c("_reach") & canon.is_private_ip(c("_src_ip"))
    none = F.array().cast(values.MITRE_TYPE)
    inferred = F.coalesce(values.infer_techniques(c("_cmdline")), none)
    return out.withColumns({
        "mitre": F.when(_route("splunk.process", "sentinel.DeviceProcessEvents", "generic") | (ariel & app_class), inferred)
        .when(F.coalesce("_remote", F.lit(False)), F.array(F.when(rdp, one("T1021.001")).otherwise(one("T1021.002"))))
        .when(_route("splunk.logon_failed"), F.array(one("T1110.001")))
        .when((_route("sentinel.SigninLogs") | (ariel & (c("class_name") == fixed.AUTHENTICATION))) & c("_failed"), F.array(one("T1110")))
        .when(_route("splunk.account"), F.array(one("T1136")))
        .when(_route("sentinel.EmailEvents") & c("_verdict").rlike("phish|malware"), F.array(one("T1566.002")))
        .when(outbound & ~c("_failed"), F.array(one("T1071.001")))
        .when(_route("sentinel.alert", "qradar.offense"), values.techniques(c("s_techniques"))).otherwise(none),
        "_outbound": outbound,
    })


def _severity() -> Column:
    c = F.col
    level = F.when(c("_failed"), 3).otherwise(2)
    lift = lambda base, test: F.when(F.coalesce(test, F.lit(False)), F.greatest(base, F.lit(3))).otherwise(base)
    two = F.lit(2)
    syslog = F.greatest(F.lit(0), F.least(F.lit(5), F.lit(5) - F.floor(_get("syslog_severity").try_cast("int") / 2))).cast("int")
    plain = F.when(c("s_severity").isNotNull(), values.parse_severity(c("s_severity"))).when(
        _has("syslog_severity"), syslog).otherwise(level)
    generic = lift(plain, (c("class_name") == fixed.NETWORK_ACTIVITY) & c("_reach"))
    magnitude = F.when(c("s_severity").isNotNull(), values.parse_severity(c("s_severity"))).otherwise(2)
    return (F.when(_route("splunk.logon", "splunk.logon_failed", "sentinel.DeviceLogonEvents", "sentinel.SigninLogs"), level)
            .when(_route("splunk.process", "sentinel.DeviceProcessEvents"), lift(two, F.size("mitre") > 0))
            .when(_route("splunk.network", "sentinel.DeviceNetworkEvents"), lift(two, c("_reach")))
            .when(_route("splunk.file", "sentinel.DeviceFileEvents"), 2)
            .when(_route("splunk.dns", "sentinel.DeviceEvents"), 1).when(_route("splunk.account"), 4)
            .when(_route("sentinel.EmailEvents"), F.when(c("_verdict").rlike("phish|malware"), 4).otherwise(3))
            .when(_route("sentinel.alert"), values.parse_severity(c("s_severity"), 5))
            .when(_route("qradar.offense"), values.parse_severity(c("s_severity")))
            .when(_route("qradar.event"), lift(magnitude, c("_outbound"))).otherwise(generic)).cast("int")


def _activity() -> Column:
    c = F.col
    cls, failed = c("class_name"), c("_failed")
    logon = F.when(failed, "logon_failed").when(F.coalesce("_remote", F.lit(False)), "logon_remote").otherwise("logon")
    blocked = F.when(_route("sentinel.DeviceNetworkEvents"), c("_action").contains("block")).otherwise(failed)
    changed = (F.when(_route("sentinel.DeviceFileEvents") & c("_action").contains("delete"), "delete")
               .when(_route("sentinel.DeviceFileEvents") & c("_action").contains("modif"), "modify")
               .when(_route("generic") & c("_hints").contains("delet"), "delete").otherwise("create"))
    return (F.when(cls == fixed.AUTHENTICATION, logon).when(cls == fixed.PROCESS_ACTIVITY, "launch")
            .when(cls == fixed.NETWORK_ACTIVITY, F.when(blocked, "blocked").otherwise("connect"))
            .when(cls == fixed.FILE_ACTIVITY, changed).when(cls == fixed.DNS_ACTIVITY, "query")
            .when(cls == fixed.EMAIL_ACTIVITY, "deliver").when(cls == fixed.ACCOUNT_CHANGE, "create_account")
            .when(_route("qradar.event"), "unknown").otherwise("alert"))


def _events(derived: DataFrame, ingest_time: dt.datetime) -> DataFrame:
    c = F.col
    vendor = F.substring_index("route", ".", 1)
    fmt = F.coalesce(_filled(_get("__format__")), F.lit("generic"))
    moment = values.parse_clean_time(c("_time_text"), ingest_time.year)
    table = F.coalesce(_filled(_get("sourcetype")), _filled(_get("source")), F.lit("splunk"))
    origin = (F.when(vendor == "splunk", table)
              .when(vendor == "sentinel", F.when(_route("sentinel.alert"), "SecurityAlert").otherwise(F.substring_index("route", ".", -1)))
              .when(_route("qradar.event"), F.coalesce("s_origin", F.lit("qradar"))).when(_route("qradar.offense"), "offense")
              .otherwise(F.coalesce("s_origin", fmt)))
    default_message = F.when(_route("sentinel.alert"), "Alert").when(_route("qradar.offense"), "Offense").otherwise("")
    silent = _route("sentinel.alert", "qradar.offense", "sentinel.DeviceEvents")
    label = F.when(_route("splunk.logon", "splunk.logon_failed") & values.to_int(c("s_logon_type")).isNotNull(), F.coalesce(
        F.try_element_at(values.literal_map(fixed.LOGON_TYPE_LABEL), values.to_int(c("s_logon_type")).cast("string")),
        values.to_int(c("s_logon_type")).cast("string")))
    learns = (_route("splunk.network") & canon.is_ip(c("s_src_ip"))) | (_route("sentinel.DeviceNetworkEvents") & canon.is_ip(c("s_src_ip")))
    device_ip = F.when(c("_device").isNotNull() & learns, c("s_src_ip"))
    no_port = F.lit(None).cast("int")
    known = lambda *cols: F.coalesce(*[c(x).cast("string") for x in cols]).isNotNull()
    extras = F.concat(_rest("host", c("_hosts"), c("_host_from_list")), _rest("user", c("_users"), F.lit(True)),
                      _rest("ip", c("_ips"), F.lit(True)))
    staged = derived.withColumns({"_time": moment, "severity": _severity(), "activity": _activity()})
    return staged.select(
        values.make_uid(F.when(vendor == "generic", fmt).otherwise(vendor), c("record")).alias("uid"),
        F.coalesce("_time", F.lit(ingest_time)).alias("time"), c("_time").isNull().alias("time_is_fallback"),
        F.to_date("_time").alias("event_date"), vendor.alias("source"), origin.alias("origin"), "class_name",
        values.class_uid(c("class_name")).alias("class_uid"), "activity", "severity",
        F.when(silent, "unknown").when(c("_failed"), "failure").otherwise("success").alias("status"),
        F.coalesce("s_message", default_message).alias("message"),
        F.when(known("_user"), F.struct(c("_user").alias("user"), c("_user_domain").alias("domain"), c("s_sid").alias("sid"),
                                        c("s_session").alias("session_id"))).alias("actor"),
        _endpoint(c("_src_host"), c("_src_ip"), F.when(known("s_src_ip", "s_src_host"), values.to_int(c("s_src_port")))).alias("src"),
        _endpoint(c("_dst_host"), c("_dst_ip"), values.to_int(c("s_dst_port"))).alias("dst"),
        _endpoint(c("_device"), device_ip, no_port).alias("device"),
        F.when(known("_name", "_path", "_cmdline", "_parent"), F.struct(
            c("_name").alias("name"), c("_path").alias("path"), c("_cmdline").alias("cmdline"), values.to_int(c("s_pid")).alias("pid"),
            c("_parent").alias("parent_name"), c("_parent_path").alias("parent_path"),
            values.to_int(c("s_parent_pid")).alias("parent_pid"), c("s_integrity").alias("integrity"))).alias("process"),
        F.when(known("_file_name", "_file_path", "_sha256", "_md5"), F.struct(
            c("_file_name").alias("name"), c("_file_path").alias("path"), c("_sha256").alias("sha256"), c("_md5").alias("md5"),
            values.to_int(c("s_file_size"), "bigint").alias("size"))).alias("file"),
        F.when(_route("sentinel.EmailEvents"), F.struct(
            c("s_sender").alias("sender"), c("s_recipient").alias("recipient"), c("s_subject").alias("subject"),
            c("s_mail_url").alias("url"))).alias("email"),
        c("_domain").alias("domain"), c("_url").alias("url"), c("s_app").alias("app"), "mitre", label.alias("logon_type_label"),
        F.when(F.size(extras) > 0, extras).alias("extra_entities"), _filled(c("_payload")).alias("payload_decoded"), "raw")


Custom = tuple[Column, Callable[[DataFrame], DataFrame]]


def normalize(records: DataFrame, ingest_time: dt.datetime | None = None, custom: Sequence[Custom] = ()) -> DataFrame:
    """Record table -> event table.

    ``ingest_time`` stands in for times that cannot be read (such events are
    flagged and have no event_date) and gives the year of year-less times.
    ``custom`` adds own formats: (test on ``record``, frame of records -> events).
    """
    moment = ingest_time or dt.datetime.now(dt.timezone.utc)
    taken = F.lit(False)
    parts = []
    for test, project in custom:
        mine = F.coalesce(test, F.lit(False))
        parts.append(project(records.where(~taken & mine)))
        taken = taken | mine
    rest = records.where(~taken) if custom else records
    parts.append(_events(_derived(with_slots(with_route(rest))), moment))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def ingest_accounting(records: DataFrame, events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Per source and origin: events normalised, added and duplicate, and how many no vendor format matched; read and total in all.

    ``total`` is what the table holds after the batch is added.
    """
    known = events.select("uid", "source", F.coalesce("origin", F.lit("")).alias("origin"))
    if stored is not None:
        known = known.join(stored.select("uid").distinct().withColumn("_old", F.lit(1)), "uid", "left")
    else:
        known = known.withColumn("_old", F.lit(None).cast("int"))
    per_uid = known.groupBy("source", "origin", "uid").agg(F.count(F.lit(1)).alias("n"), F.max("_old").alias("old"))
    total = records.agg(F.count(F.lit(1))).scalar()
    stored_rows = stored.select("uid").distinct().agg(F.count(F.lit(1))).scalar() if stored is not None else F.lit(0)
    fresh = per_uid.where("old IS NULL").select("uid").distinct().agg(F.count(F.lit(1))).scalar()
    return per_uid.groupBy("source", "origin").agg(
        F.sum("n").alias("normalized"), F.count_if(F.col("old").isNull()).alias("added"),
        (F.sum("n") - F.count_if(F.col("old").isNull())).alias("duplicates"),
        F.sum(F.when(F.col("source") == "generic", F.col("n")).otherwise(0)).alias("unmatched")).withColumns(
            {"read": total, "total": stored_rows + fresh})
