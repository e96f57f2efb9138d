"""Events -> entity mentions and relation mentions.

The rules run inside one projection per event: canonical pieces become columns,
entities and relations become arrays chosen by event class, and ``inline``
turns them into rows.  No shuffle happens here.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon, fixed, values

ALERT_LABEL_CHARS = 70

def _text(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _some(value: Column) -> Column:
    """Null for an empty string."""
    return canon.not_in(value, [""])


class _Rules:
    """Column builders that share the staged columns of one event row."""

    def __init__(self, with_props: bool, with_kind: bool = False, ids_only: bool = False):
        self.with_props = with_props
        self.with_kind = with_kind
        self.ids_only = ids_only

    def entity(self, kind: str | Column, value: Column, label: Column | None = None,
               ip: Column | None = None, path: Column | None = None, **props: Column) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        if self.ids_only:
            return F.when(_some(value).isNotNull(), F.struct(F.concat(kind, F.lit(":"), value).alias("node_id")))
        fields = [
            *([F.lit(0).alias("kind")] if self.with_kind else []),
            F.concat(kind, F.lit(":"), value).alias("node_id"), kind.alias("type"),
            F.coalesce(_some(label), value).alias("label") if label is not None else value.alias("label"),
            (_some(ip) if ip is not None else _text("string")).alias("ip"),
            (_some(path) if path is not None else _text("string")).alias("path"),
        ]
        if self.with_props:
            pairs = [F.struct(F.lit(k).alias("key"), _some(v.cast("string")).alias("value"))
                     for k, v in {**props, **({"ip": ip} if ip is not None else {}),
                                  **({"path": path} if path is not None else {})}.items()]
            empty = F.array().cast("array<struct<key:string,value:string>>")
            known = F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()) if pairs else empty
            fields.append(known.alias("props"))
        return F.when(_some(value).isNotNull(), F.struct(*fields))

    def endpoint(self, ref: str) -> Column:
        """``host`` when it has a name, else ``ip``; a name that is an address stays a host."""
        host, ip = F.col(f"_{ref}_host"), F.col(f"{ref}.ip")
        named = host.isNotNull() & ~canon.is_ip(host)
        return (F.when(named, self.entity("host", host, ip=ip, os=F.col(f"{ref}.os")))
                .when(canon.is_ip(ip), self.entity("ip", ip, private=canon.is_private_ip(ip)))
                .when(host.isNotNull(), self.entity("host", host)))


def _id(name: str) -> Column:
    return F.col(name)["node_id"]


def relation(source: Column, target: Column, rel: str | Column, detail: Column | None = None) -> Column:
    rel = F.lit(rel) if isinstance(rel, str) else rel
    return F.when(source.isNotNull() & target.isNotNull() & (source != target),
                  F.struct(source.alias("source"), target.alias("target"), rel.alias("rel"),
                           (detail if detail is not None else _text("string")).cast("string").alias("detail")))


def _as_entity(source: Column, target: Column, rel: str | Column, detail: Column | None = None) -> Column:
    """A relation in the fields of an entity, so that one array holds both kinds."""
    rel = F.lit(rel) if isinstance(rel, str) else rel
    return F.when(source.isNotNull() & target.isNotNull() & (source != target),
                  F.struct(F.lit(1).alias("kind"), source.alias("node_id"), target.alias("type"), rel.alias("label"),
                           _text("string").alias("ip"), _text("string").alias("path")))


def _staged(events: DataFrame, r: _Rules) -> DataFrame:
    c = F.col
    cls = c("class_name")
    staged = events.withColumns({
        "_user_name": canon.canon_user(c("actor.user")),
        "_device_host": canon.canon_host(c("device.hostname")),
        "_src_host": canon.canon_host(c("src.hostname")),
        "_dst_host": canon.canon_host(c("dst.hostname")),
        "_domain": canon.canon_domain(c("domain")),
        "_proc_path": canon.canon_path(F.coalesce(_some(c("process.path")), c("process.name"))),
        "_parent_path": canon.canon_path(F.coalesce(_some(c("process.parent_path")), c("process.parent_name"))),
        "_file_path": canon.canon_path(F.coalesce(_some(c("file.path")), c("file.name"))),
        "_digest": F.coalesce(_some(c("file.sha256")), _some(c("file.md5"))),
        "_mail_user": F.when(c("email.recipient").contains("@"), canon.canon_user(c("email.recipient"))),
        "_mail_url": F.coalesce(_some(c("email.url")), _some(c("url"))),
    })
    staged = staged.withColumns({
        "_user": r.entity("user", c("_user_name"), c("actor.user"), domain=c("actor.domain"), sid=c("actor.sid")),
        "_device": r.endpoint("device"), "_src": r.endpoint("src"), "_dst": r.endpoint("dst"),
        "_mail_domain": F.when(
            c("_mail_url").isNotNull(),
            canon.canon_domain(F.substring_index(F.substring_index(c("_mail_url"), "//", -1), "/", 1)),
        ).otherwise(c("_domain")),
        "_file": r.entity("file", c("_file_path"), c("file.name"), path=c("file.path"), size=c("file.size")),
        "_hash": r.entity("hash", F.lower("_digest"), F.concat(F.substring("_digest", 1, 12), F.lit("...")),
                          algo=F.when(_some(c("file.sha256")).isNotNull(), "sha256").otherwise("md5"),
                          full=F.lower("_digest")),
    })
    anchor = F.when(cls == fixed.NETWORK_ACTIVITY, F.coalesce("_device", "_src")).otherwise(c("_device"))
    staged = staged.withColumn("_anchor", F.coalesce(F.regexp_replace(anchor["node_id"], "^[a-z]+:", ""), F.lit("?")))
    anchored = lambda path: F.concat(c("_anchor"), F.lit("|"), path)
    return staged.withColumns({
        "_process": r.entity("process", anchored(c("_proc_path")), F.coalesce(_some(c("process.name")), c("_proc_path")),
                             path=c("process.path"), cmdline=c("process.cmdline"), pid=c("process.pid"),
                             integrity=c("process.integrity")),
        "_parent": r.entity("process", anchored(c("_parent_path")),
                            F.coalesce(_some(c("process.parent_name")), c("_parent_path")),
                            path=c("process.parent_path"), pid=c("process.parent_pid")),
        "_service": r.entity("service", F.lower(canon.strip(c("app"))), c("app"), cloud=F.lit(True)),
        "_target": F.coalesce(r.entity("domain", c("_domain"), url=c("url")), c("_dst")),
        "_asked": r.entity("domain", c("_domain"), c("domain")),
        "_origin": F.coalesce("_src", "_device"),
        "_resolved": F.when(F.when(cls == fixed.DNS_ACTIVITY, c("_domain").isNotNull())
                            .otherwise(_some(c("domain")).isNotNull() & canon.is_ip(c("dst.ip"))),
                            r.entity("ip", c("dst.ip"), private=canon.is_private_ip(c("dst.ip")))),
        "_sender": r.entity("mailbox", F.lower("email.sender"), c("email.sender")),
        "_recipient": r.entity("mailbox", F.lower("email.recipient"), c("email.recipient")),
        "_owner": r.entity("user", c("_mail_user"), c("email.recipient")),
        "_linked": r.entity("domain", c("_mail_domain"), url=c("_mail_url")),
        "_alert": r.entity("alert", F.concat_ws("|", "source", "uid"),
                           F.substring(F.coalesce(_some(c("message")), F.lit("Alert")), 1, ALERT_LABEL_CHARS),
                           severity=c("severity"), origin=c("origin"),
                           techniques=_some(F.array_join(c("mitre.id"), ","))),
        "_extras": F.transform("extra_entities", lambda x: r.entity(x["type"], x["value"])),
    })


def _entity_names() -> tuple[dict[str, list[str]], list[str]]:
    """Staged columns of the entities of each class, and of a finding and any other class."""
    return {
        fixed.AUTHENTICATION: ["_user", "_device", "_src", "_goal"],
        fixed.PROCESS_ACTIVITY: ["_device", "_user", "_process", "_parent", "_file", "_hash"],
        fixed.NETWORK_ACTIVITY: ["_device", "_src", "_target", "_user", "_process", "_resolved"],
        fixed.FILE_ACTIVITY: ["_device", "_user", "_process", "_file", "_hash"],
        fixed.DNS_ACTIVITY: ["_device", "_process", "_asked", "_resolved"],
        fixed.EMAIL_ACTIVITY: ["_sender", "_recipient", "_owner", "_linked"],
        fixed.ACCOUNT_CHANGE: ["_device", "_user"],
    }, ["_alert", "_device", "_user", "_src", "_target", "_file", "_hash"]


# Types a staged entity can have, where two of one event can be the same node.
_MAY_BE = {
    "_device": {"host", "ip"}, "_src": {"host", "ip"}, "_goal": {"service", "host", "ip"}, "_target": {"domain", "host", "ip"},
    "_resolved": {"ip"}, "_process": {"process"}, "_parent": {"process"}, "_sender": {"mailbox"}, "_recipient": {"mailbox"},
}


def _entity(name: str) -> Column:
    return F.coalesce("_service", "_dst") if name == "_goal" else F.col(name)


def _by_class(by_class: dict[str, Column], other: Column) -> Column:
    cls = F.col("class_name")
    return reduce(lambda acc, kv: acc.when(cls == kv[0], kv[1]), by_class.items(), F.when(F.lit(False), other)).otherwise(other)


def _entities(staged: DataFrame) -> DataFrame:
    by_class, finding = _entity_names()
    listed = lambda names: F.array(*[_entity(n) for n in names])
    other = F.when(F.col("_extras").isNull(), listed(finding)).otherwise(F.concat(listed(finding), "_extras"))
    return staged.withColumn("_all", F.array_compact(_by_class({c: listed(names) for c, names in by_class.items()}, other)))


def _repeated() -> Column:
    """Whether an event may name a node twice: equal ids of entities whose types meet, or extra entities."""
    def twice(names: list[str]) -> Column:
        pairs = [_entity(a)["node_id"] == _entity(b)["node_id"] for a, b in combinations(names, 2)
                 if _MAY_BE.get(a, set()) & _MAY_BE.get(b, set())]
        return F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in pairs], F.lit(False)), F.lit(False))

    by_class, finding = _entity_names()
    return _by_class({c: twice(names) for c, names in by_class.items()}, F.col("_extras").isNotNull() | twice(finding))


def _merged(es: Column, with_props: bool, with_kind: bool = False) -> Column:
    """One struct per node id: first properties win, the longest label wins."""
    def first_known(same: Column, field: str) -> Column:
        return F.element_at(F.concat(F.filter(F.transform(same, lambda e: e[field]), lambda v: v.isNotNull()),
                                     F.array(_text("string"))), 1)

    def longest(same: Column) -> Column:
        return F.aggregate(same, F.lit(""), lambda best, e: F.when(F.length(e["label"]) > F.length(best), e["label"])
                           .otherwise(best))

    def one(node_id: Column) -> Column:
        same = F.filter(es, lambda e: e["node_id"] == node_id)
        fields = [*([F.lit(0).alias("kind")] if with_kind else []), node_id.alias("node_id"), F.element_at(same, 1)["type"].alias("type"), longest(same).alias("label"),
                  first_known(same, "ip").alias("ip"), first_known(same, "path").alias("path")]
        if with_props:
            fields.append(F.flatten(F.transform(same, lambda e: e["props"])).alias("props"))
        return F.struct(*fields)

    ids = F.array_distinct(F.transform(es, lambda e: e["node_id"]))
    return F.when(F.size(ids) == F.size(es), es).otherwise(F.transform(ids, one))


def _facts() -> list[Column]:
    return [F.col("uid"), F.col("time"), F.col("severity"), values.source_mask(F.col("source")).alias("source_mask")]


def _tactic_mask() -> Column:
    mask = values.tactic_mask(values.tactics_of(F.col("mitre")))
    return F.when(F.size("mitre") == 0, 0).otherwise(mask).alias("tactic_mask")


def _rows(staged: DataFrame, facts: list[Column], structs: Column, key: str) -> DataFrame:
    """``facts`` and one row per struct that is not null.

    Both are columns before the generator: what stands beside it is computed again for
    each row it returns, and a generator interprets the expression it is given.
    """
    rows = staged.select(*facts, structs.alias("_mentions"))
    return rows.select("*", F.inline_outer("_mentions")).drop("_mentions").where(F.col(key).isNotNull())


def entity_mentions(events: DataFrame, with_props: bool = False) -> DataFrame:
    """One row per (event, entity): uid, time, severity, source_mask, tactic_mask, entity fields."""
    staged = _entities(_staged(events, _Rules(with_props)))
    return _rows(staged, [*_facts(), _tactic_mask()], _merged(F.col("_all"), with_props), "node_id")


def _relations(relation=relation) -> tuple[dict[str, list[Column]], list[Column], Column]:
    """Relations of each class, of a finding (and any other class), and the array of those to extra entities; null where none applies."""
    status, activity = F.col("status"), F.col("activity")
    user, device, proc, parent = _id("_user"), _id("_device"), _id("_process"), _id("_parent")
    src, origin, target = _id("_src"), _id("_origin"), _id("_target")
    file, digest, alert = _id("_file"), _id("_hash"), _id("_alert")
    failed = F.coalesce((status == "failure") | (activity == "logon_failed"), F.lit(False))
    logon = F.col("logon_type_label")
    goal = F.coalesce(_id("_service"), _id("_dst"), device)
    remote = (activity == "logon_remote") & ~failed
    blocked = F.coalesce((activity == "blocked") | (status == "failure"), F.lit(False))
    resolved = F.when(F.col("_domain").isNotNull(),
                      relation(F.concat(F.lit("domain:"), "_domain"), _id("_resolved"), "resolved"))
    on_device = relation(proc, device, "ran_on")
    by_class = {
        fixed.AUTHENTICATION: [
            relation(user, goal, F.when(failed, "failed_auth").otherwise("authenticated"), logon),
            relation(src, goal, F.when(remote, "lateral").otherwise("connected"), F.when(remote, logon))],
        fixed.PROCESS_ACTIVITY: [
            relation(parent, proc, "spawned"), relation(user, proc, "executed"), on_device,
            F.when(parent.isNull(), relation(user, device, "authenticated")), relation(proc, digest, "has_hash")],
        fixed.NETWORK_ACTIVITY: [
            relation(F.coalesce(proc, origin), target, F.when(blocked, "blocked").otherwise("connected"), F.col("dst.port")),
            on_device, relation(user, proc, "executed"),
            F.when(proc.isNull(), relation(user, origin, "authenticated")), resolved],
        fixed.FILE_ACTIVITY: [
            relation(F.coalesce(proc, user, device), file,
                     F.when(activity == "delete", "deleted").when(activity == "read", "read").otherwise("wrote")),
            relation(file, digest, "has_hash"), on_device],
        fixed.DNS_ACTIVITY: [relation(F.coalesce(proc, device), _id("_asked"), "connected"), resolved],
        fixed.EMAIL_ACTIVITY: [
            relation(_id("_sender"), _id("_recipient"), "sent_to", F.col("email.subject")),
            relation(_id("_owner"), _id("_recipient"), "owns"),
            relation(_id("_recipient"), _id("_linked"), "contains_url")],
        fixed.ACCOUNT_CHANGE: [relation(user, device, "persisted")],
    }
    finding = [relation(file, digest, "has_hash"),
               *[relation(alert, x, "affects") for x in (device, user, src, target, file, digest)]]
    return by_class, finding, F.transform("_extras", lambda x: relation(alert, x["node_id"], "affects"))


def relation_mentions(events: DataFrame) -> DataFrame:
    """One row per relation occurrence: uid, time, severity, source_mask, source, target, rel, detail."""
    by_class, finding, to_extras = _relations()
    plain = F.array(*finding)
    other = F.when(F.col("_extras").isNull(), plain).otherwise(F.concat(plain, to_extras))
    relations = _by_class({c: F.array(*found) for c, found in by_class.items()}, other)
    return _rows(_staged(events, _Rules(False, ids_only=True)), _facts(), relations, "source")


def graph_mentions(events: DataFrame) -> DataFrame:
    """Entities and relations of each event from one projection, as rows of one shape.

    ``kind`` 0 is an entity (a: node_id, b: type, c: label, ip, path), 1 a relation (a: source, b: target, c: rel).
    Only events that may name a node twice go through the merge.
    """
    entities, other_entities = _entity_names()
    relations, other_relations, to_extras = _relations(_as_entity)
    plain = F.array(*[_entity(n) for n in other_entities], *other_relations)
    other = F.when(F.col("_extras").isNull(), plain).otherwise(F.concat(plain, "_extras", to_extras))
    staged = _staged(events, _Rules(False, with_kind=True)).withColumns({
        "_all": _by_class({c: F.array(*[_entity(n) for n in names], *relations[c]) for c, names in entities.items()}, other),
        "_repeated": _repeated()})
    of_kind = lambda kind: F.filter("_all", lambda x: x["kind"] == kind)
    staged = staged.withColumn("_named", F.when(F.col("_repeated"), of_kind(0)))
    mentioned = F.when(F.col("_repeated"), F.concat(_merged(F.col("_named"), False, True), of_kind(1))).otherwise(F.col("_all"))
    rows = _rows(staged, [*_facts(), _tactic_mask()], mentioned, "node_id")
    return rows.withColumnsRenamed({"node_id": "a", "type": "b", "label": "c"})
