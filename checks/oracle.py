"""DuckDB SQL that recomputes the registered queries from the same parquet tables.

The SQL is written independently of the operators: plain relational steps over
flat columns.  ``sql(final, *names)`` prefixes the named steps and whatever they
depend on.
"""

from __future__ import annotations

from sleuthgraph.functions import fixed, values
from sleuthgraph.functions.canon import HOSTNAME_PATTERN, IP_PATTERN, PRIVATE_PATTERN, QUAD_PATTERN

from .workload import duck_quote as q
from .workload import flat_events_sql

AUTH, ACCT, PROC, FILE, NET, DNS, MAIL, FIND = (q(c) for c in (
    fixed.AUTHENTICATION, fixed.ACCOUNT_CHANGE, fixed.PROCESS_ACTIVITY, fixed.FILE_ACTIVITY,
    fixed.NETWORK_ACTIVITY, fixed.DNS_ACTIVITY, fixed.EMAIL_ACTIVITY, fixed.DETECTION_FINDING))


def lst(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def unless(x: str, marks) -> str:
    return f"CASE WHEN {x} NOT IN {lst(marks)} THEN {x} END"


def is_ip(x: str) -> str:
    return f"coalesce(regexp_matches(trim({x}), {q(IP_PATTERN)}), false)"


def is_private(x: str) -> str:
    return (f"coalesce(regexp_matches(trim({x}), {q(QUAD_PATTERN)}) AND "
            f"regexp_matches(trim({x}), {q(PRIVATE_PATTERN)}), false)")


def after_last(x: str, sep: str) -> str:
    import re
    return f"regexp_replace({x}, {q('^.*' + re.escape(sep))}, '')"


def canon_user(x: str) -> str:
    name = f"lower(trim(split_part({after_last(f'trim({x})', chr(92))}, '@', 1)))"
    return (f"CASE WHEN trim({x}) IN ('', '-', 'N/A', 'null', 'NULL') THEN NULL WHEN {name} IN "
            f"{lst(['', *fixed.NOISE_ACCOUNTS])} THEN NULL WHEN regexp_matches({name}, {q(fixed.MACHINE_ACCOUNT)}) "
            f"THEN NULL ELSE {name} END")


def canon_host(x: str) -> str:
    text = f"trim(trim({x}), '.')"
    return (f"CASE WHEN {text} IN ('', '-', 'N/A', 'null', 'NULL') THEN NULL WHEN {is_ip(text)} THEN {text} "
            f"WHEN split_part({text}, '.', 1) <> '' THEN lower(split_part({text}, '.', 1)) END")


def canon_path(x: str) -> str:
    text = f"trim(trim({x}), '\"')"
    return f"CASE WHEN {text} NOT IN ('', '-') THEN lower(replace({text}, '/', chr(92))) END"


def canon_domain(x: str) -> str:
    text = f"lower(trim({x}))"
    text = f"CASE WHEN {text} NOT IN ('', '-', 'n/a', 'null', 'none') THEN regexp_replace({text}, '^.*?//', '') END"
    text = f"split_part(split_part(({text}), '/', 1), '?', 1)"
    text = f"trim(trim(split_part({after_last(text, '@')}, ':', 1)), '.')"
    return (f"CASE WHEN length({text}) <= 253 AND regexp_matches({text}, {q(HOSTNAME_PATTERN)}) "
            f"AND NOT regexp_matches({text}, {q(IP_PATTERN)}) THEN {text} END")


def basename(x: str) -> str:
    cut = f"rtrim(replace({x}, '/', chr(92)), chr(92))"
    return f"nullif({after_last(cut, chr(92))}, '')"


def tactic_of(x: str) -> str:
    arms = " ".join(f"WHEN {q(t)} THEN {q(v[1])}" for t, v in fixed.TECHNIQUES.items())
    return f"coalesce(CASE {x} {arms} END, CASE split_part({x}, '.', 1) {arms} END)"


def name_of(x: str) -> str:
    arms = " ".join(f"WHEN {q(t)} THEN {q(v[0])}" for t, v in fixed.TECHNIQUES.items())
    return f"coalesce(CASE {x} {arms} END, CASE split_part({x}, '.', 1) {arms} END, '')"


def tactic_bit(x: str) -> str:
    arms = " ".join(f"WHEN {q(t)} THEN {1 << i}" for i, t in enumerate(fixed.TACTICS))
    return f"CASE {x} {arms} ELSE 0 END"


def source_bit(x: str) -> str:
    arms = " ".join(f"WHEN {q(s)} THEN {1 << i}" for i, s in enumerate(fixed.SOURCES))
    return f"CASE {x} {arms} ELSE 2 END"


def contains_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def device_class(x: str) -> str:
    arms = " ".join(f"WHEN {contains_any(f'lower(trim({x}))', w)} THEN {q(c)}" for c, w in fixed.DEVICE_CLASSES)
    return f"CASE {arms} ELSE 'workstation' END"


def looks_like_product(x: str) -> str:
    return contains_any(f"lower(trim({x}))", fixed.PRODUCT_MARKERS)


def key_event(p: str = "") -> str:
    return (f"({p}tech1 IS NOT NULL OR {p}tech2 IS NOT NULL OR {p}severity >= 4 OR {p}class_name IN "
            f"({FIND}, {MAIL}, {ACCT}) OR {p}status = 'failure' OR ({p}class_name = {AUTH} AND "
            f"{p}activity = 'logon_remote'))")


def _endpoint(ref: str) -> str:
    named = f"{ref}_h IS NOT NULL AND NOT {is_ip(ref + '_h')}"
    return (f"CASE WHEN {named} THEN 'host:' || {ref}_h WHEN {is_ip(ref + '_ip')} THEN 'ip:' || {ref}_ip "
            f"WHEN {ref}_h IS NOT NULL THEN 'host:' || {ref}_h END AS {ref}_key, "
            f"CASE WHEN {named} THEN {ref}_ip END AS {ref}_prop")


_MENTION_BRANCHES: list[tuple[str, str, str, str, str, str]] = [
    # (classes, order, key column, label, ip, path)
    (f"({AUTH}, {MAIL})", "1", "user_key", "actor_user", "NULL", "NULL"),
    (f"({PROC}, {FILE}, {ACCT}, {FIND})", "2", "user_key", "actor_user", "NULL", "NULL"),
    (f"({NET})", "4", "user_key", "actor_user", "NULL", "NULL"),
    (f"({PROC}, {NET}, {FILE}, {DNS}, {ACCT}, {FIND})", "1", "device_key", "NULL", "device_prop", "NULL"),
    (f"({AUTH})", "2", "device_key", "NULL", "device_prop", "NULL"),
    (f"({AUTH}, {FIND})", "3", "src_key", "NULL", "src_prop", "NULL"),
    (f"({NET})", "2", "src_key", "NULL", "src_prop", "NULL"),
    (f"({AUTH})", "4", "service_key", "app", "NULL", "NULL"),
    (f"({AUTH})", "5", "CASE WHEN service_key IS NULL THEN dst_key END", "NULL", "dst_prop", "NULL"),
    (f"({NET})", "3", "target_key", "NULL", "CASE WHEN dom IS NULL THEN dst_prop END", "NULL"),
    (f"({FIND})", "4", "target_key", "NULL", "CASE WHEN dom IS NULL THEN dst_prop END", "NULL"),
    (f"({DNS})", "4", "CASE WHEN dom IS NOT NULL THEN 'domain:' || dom END", "domain", "NULL", "NULL"),
    (f"({PROC}, {NET}, {FILE}, {DNS})", "5", "proc_key", "coalesce(proc_name, proc_p)", "NULL", "proc_path"),
    (f"({PROC})", "6", "parent_key", "coalesce(parent_name, parent_p)", "NULL", "parent_path"),
    (f"({PROC}, {FILE}, {FIND})", "7", "file_key", "file_name", "NULL", "file_path"),
    (f"({PROC}, {FILE}, {FIND})", "8", "hash_key", "left(coalesce(file_sha256, file_md5), 12) || '...'", "NULL", "NULL"),
    (f"({NET}, {DNS})", "9", "resolved_key", "NULL", "NULL", "NULL"),
    (f"({MAIL})", "1", "sender_key", "email_sender", "NULL", "NULL"),
    (f"({MAIL})", "2", "recipient_key", "email_recipient", "NULL", "NULL"),
    (f"({MAIL})", "3", "owner_key", "email_recipient", "NULL", "NULL"),
    (f"({MAIL})", "4", "linked_key", "NULL", "NULL", "NULL"),
    (f"({FIND})", "0", "alert_key", "left(message, 70)", "NULL", "NULL"),
    (f"({FIND})", "9", "extra_key", "NULL", "NULL", "NULL"),
]
_MENTION_BRANCHES[0] = (f"({AUTH})", *_MENTION_BRANCHES[0][1:])


def _mentions() -> str:
    parts = [f"SELECT uid, {o} AS ord, {key} AS node_id, {label} AS label, {ip} AS ip, {path} AS path "
             f"FROM keyed WHERE class_name IN {classes}" for classes, o, key, label, ip, path in _MENTION_BRANCHES]
    rows = "\nUNION ALL ".join(parts)
    return f"""SELECT m.uid, m.node_id, split_part(m.node_id, ':', 1) AS type,
      first(lab ORDER BY -length(lab), ord) AS label,
      first(ip ORDER BY ord) FILTER (WHERE ip IS NOT NULL) AS ip,
      first(path ORDER BY ord) FILTER (WHERE path IS NOT NULL) AS path
    FROM (SELECT *, coalesce(label, substr(node_id, position(':' IN node_id) + 1)) AS lab FROM ({rows})) m
    WHERE m.node_id IS NOT NULL GROUP BY m.uid, m.node_id"""


def _relations() -> str:
    failed = "(status = 'failure' OR activity = 'logon_failed')"
    goal = "coalesce(service_key, dst_key, device_key)"
    rows = [
        (AUTH, "user_key", goal, f"CASE WHEN {failed} THEN 'failed_auth' ELSE 'authenticated' END", "logon_type_label"),
        (AUTH, "src_key", goal,
         f"CASE WHEN activity = 'logon_remote' AND NOT {failed} THEN 'lateral' ELSE 'connected' END",
         f"CASE WHEN activity = 'logon_remote' AND NOT {failed} THEN logon_type_label END"),
        (PROC, "parent_key", "proc_key", "'spawned'", "NULL"), (PROC, "user_key", "proc_key", "'executed'", "NULL"),
        (PROC, "proc_key", "device_key", "'ran_on'", "NULL"),
        (PROC, "CASE WHEN parent_key IS NULL THEN user_key END", "device_key", "'authenticated'", "NULL"),
        (PROC, "proc_key", "hash_key", "'has_hash'", "NULL"),
        (NET, "coalesce(proc_key, src_key, device_key)", "target_key",
         "CASE WHEN activity = 'blocked' OR status = 'failure' THEN 'blocked' ELSE 'connected' END",
         "CASE WHEN dst_hostname IS NOT NULL OR dst_ip IS NOT NULL THEN CAST(dst_port AS VARCHAR) END"),
        (NET, "proc_key", "device_key", "'ran_on'", "NULL"), (NET, "user_key", "proc_key", "'executed'", "NULL"),
        (NET, "CASE WHEN proc_key IS NULL THEN user_key END", "coalesce(src_key, device_key)", "'authenticated'", "NULL"),
        (NET, "'domain:' || dom", "resolved_key", "'resolved'", "NULL"),
        (FILE, "coalesce(proc_key, user_key, device_key)", "file_key",
         "CASE activity WHEN 'delete' THEN 'deleted' WHEN 'read' THEN 'read' ELSE 'wrote' END", "NULL"),
        (FILE, "file_key", "hash_key", "'has_hash'", "NULL"), (FILE, "proc_key", "device_key", "'ran_on'", "NULL"),
        (DNS, "coalesce(proc_key, device_key)", "'domain:' || dom", "'connected'", "NULL"),
        (DNS, "'domain:' || dom", "resolved_key", "'resolved'", "NULL"),
        (MAIL, "sender_key", "recipient_key", "'sent_to'", "email_subject"),
        (MAIL, "owner_key", "recipient_key", "'owns'", "NULL"),
        (MAIL, "recipient_key", "linked_key", "'contains_url'", "NULL"),
        (ACCT, "user_key", "device_key", "'persisted'", "NULL"),
        (FIND, "file_key", "hash_key", "'has_hash'", "NULL"),
        *[(FIND, "alert_key", k, "'affects'", "NULL") for k in (
            "device_key", "user_key", "src_key", "target_key", "file_key", "hash_key", "extra_key")],
    ]
    union = "\nUNION ALL ".join(
        f"SELECT uid, {s} AS source, {t} AS target, {r} AS rel, {d} AS detail FROM keyed WHERE class_name = {c}"
        for c, s, t, r, d in rows)
    return f"SELECT * FROM ({union}) r WHERE source IS NOT NULL AND target IS NOT NULL AND source <> target"


def _weight(x: str) -> str:
    arms = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in fixed.RELATION_WEIGHT.items())
    return f"CASE {x} {arms} ELSE 1 END"


def risk(table: str = "") -> str:
    p = f"{table}." if table else ""
    return (f"CAST(greatest(0, least(100, {p}max_severity * 12 + least(6 * bit_count({p}tactic_mask), 18) "
            f"+ least(2 * {p}degree, 12) + least({p}event_count // 25, 5) + least({p}rel_weight // 10, 5) "
            f"+ CASE WHEN {p}type = 'alert' THEN 15 ELSE 0 END)) AS INTEGER)")


_HOSTILE = values.mask_of(fixed.HOSTILE_TACTICS, fixed.TACTICS)
_VICTIM = values.mask_of(fixed.VICTIM_TACTICS, fixed.TACTICS)

# step name -> (SQL, steps it reads)
STEPS: dict[str, tuple[str, list[str]]] = {
    "ev": (f"SELECT * FROM ({flat_events_sql('events', q)})", []),
    "canon": (f"""SELECT *, {canon_user('actor_user')} AS user_v, {canon_host('device_hostname')} AS device_h,
      {canon_host('src_hostname')} AS src_h, {canon_host('dst_hostname')} AS dst_h, {canon_domain('domain')} AS dom,
      {canon_path('coalesce(proc_path, proc_name)')} AS proc_p,
      {canon_path('coalesce(parent_path, parent_name)')} AS parent_p,
      {canon_path('coalesce(file_path, file_name)')} AS file_p,
      coalesce(email_url, url) AS mail_url,
      CASE WHEN contains(email_recipient, '@') THEN {canon_user('email_recipient')} END AS owner_v
      FROM ev""", ["ev"]),
    "ends": (f"""SELECT *, {_endpoint('device')}, {_endpoint('src')}, {_endpoint('dst')} FROM canon""", ["canon"]),
    "anchored": (f"""SELECT *, substr(k, position(':' IN k) + 1) AS anchor FROM (SELECT *, coalesce(
      CASE WHEN class_name = {NET} THEN coalesce(device_key, src_key) ELSE device_key END, 'x:?') AS k FROM ends)""",
                 ["ends"]),
    "keyed": (f"""SELECT *, 'user:' || user_v AS user_key, 'process:' || anchor || '|' || proc_p AS proc_key,
      'process:' || anchor || '|' || parent_p AS parent_key, 'file:' || file_p AS file_key,
      'hash:' || lower(coalesce(file_sha256, file_md5)) AS hash_key,
      coalesce('domain:' || dom, dst_key) AS target_key, 'service:' || lower(trim(app)) AS service_key,
      'mailbox:' || lower(email_sender) AS sender_key, 'mailbox:' || lower(email_recipient) AS recipient_key,
      'user:' || owner_v AS owner_key, 'alert:' || source || '|' || uid AS alert_key,
      extra_type || ':' || extra_value AS extra_key,
      'domain:' || CASE WHEN mail_url IS NOT NULL THEN {canon_domain("split_part(regexp_replace(mail_url, '^.*//', ''), '/', 1)")}
                        ELSE dom END AS linked_key,
      CASE WHEN class_name = {DNS} AND dom IS NOT NULL THEN 'ip:' || dst_ip
           WHEN class_name <> {DNS} AND domain IS NOT NULL AND {is_ip('dst_ip')} THEN 'ip:' || dst_ip END AS resolved_key
      FROM anchored""", ["anchored"]),
    "facts": (f"""SELECT uid, time, severity, {source_bit('source')} AS source_bit,
      ({tactic_bit(tactic_of('tech1'))}) | ({tactic_bit(tactic_of('tech2'))}) AS tactic_bits FROM ev""", ["ev"]),
    "mentions": (_mentions(), ["keyed"]),
    "relations": (_relations(), ["keyed"]),
    "nodes0": ("""SELECT node_id, type, count(*) AS event_count, min(time) AS first_seen, max(time) AS last_seen,
      max(severity) AS max_severity, bit_or(source_bit) AS source_mask, bit_or(tactic_bits) AS tactic_mask,
      first(label ORDER BY -length(label), time, label) AS label,
      first(ip ORDER BY time, ip) FILTER (WHERE ip IS NOT NULL) AS ip,
      first(path ORDER BY time, path) FILTER (WHERE path IS NOT NULL) AS path
      FROM mentions JOIN facts USING (uid) GROUP BY node_id, type""", ["mentions", "facts"]),
    "links0": ("""SELECT source, target, rel, count(*) AS count, min(time) AS first_seen, max(time) AS last_seen,
      max(severity) AS max_severity, bit_or(source_bit) AS source_mask
      FROM relations JOIN facts USING (uid) GROUP BY source, target, rel""", ["relations", "facts"]),
    "ip_alias": ("""SELECT 'ip:' || ip AS old_id, min(node_id) AS new_id FROM nodes0
      WHERE type = 'host' AND ip IS NOT NULL GROUP BY ip HAVING count(*) = 1""", ["nodes0"]),
    "file_alias": (r"""SELECT b.source AS old_id, min(p.source) AS new_id
      FROM links0 b JOIN links0 p ON b.target = p.target AND b.rel = 'has_hash' AND p.rel = 'has_hash'
      WHERE b.source LIKE 'file:%' AND p.source LIKE 'file:%' AND NOT contains(b.source, chr(92))
        AND contains(p.source, chr(92))
        AND (SELECT count(*) FROM links0 x WHERE x.rel = 'has_hash' AND x.target = b.target
             AND x.source LIKE 'file:%' AND contains(x.source, chr(92))) = 1
      GROUP BY b.source""", ["links0"]),
    "procs": (f"""SELECT node_id, split_part(node_id, '|', 1) AS host, substr(node_id, position('|' IN node_id) + 1) AS p,
      {after_last("substr(node_id, position('|' IN node_id) + 1)", chr(92))} AS name
      FROM nodes0 WHERE type = 'process'""", ["nodes0"]),
    "proc_alias": ("""SELECT b.node_id AS old_id, min(w.node_id) AS new_id FROM procs b JOIN procs w
      ON b.host = w.host AND b.name = w.name AND b.p = b.name AND w.p <> w.name
      GROUP BY b.node_id HAVING count(*) = 1""", ["procs"]),
    "alias": ("SELECT * FROM ip_alias UNION ALL SELECT * FROM file_alias UNION ALL SELECT * FROM proc_alias",
              ["ip_alias", "file_alias", "proc_alias"]),
    "merged": ("""SELECT coalesce(new_id, node_id) AS node_id, split_part(coalesce(new_id, node_id), ':', 1) AS type,
      sum(event_count) AS event_count, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
      max(max_severity) AS max_severity, bit_or(source_mask) AS source_mask, bit_or(tactic_mask) AS tactic_mask,
      max(label) FILTER (WHERE new_id IS NULL) AS label,
      coalesce(max(ip) FILTER (WHERE new_id IS NULL), first(ip ORDER BY first_seen, node_id)
        FILTER (WHERE ip IS NOT NULL)) AS ip,
      coalesce(max(path) FILTER (WHERE new_id IS NULL), first(path ORDER BY first_seen, node_id)
        FILTER (WHERE path IS NOT NULL)) AS path
      FROM nodes0 LEFT JOIN alias ON node_id = old_id GROUP BY 1, 2""", ["nodes0", "alias"]),
    "rewired": ("""SELECT coalesce(a.new_id, source) AS source, coalesce(b.new_id, target) AS target, rel,
      sum(count) AS count, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
      max(max_severity) AS max_severity, bit_or(source_mask) AS source_mask
      FROM links0 LEFT JOIN alias a ON source = a.old_id LEFT JOIN alias b ON target = b.old_id
      GROUP BY 1, 2, 3""", ["links0", "alias"]),
    "links": ("SELECT * FROM rewired WHERE source <> target", ["rewired"]),
    "weights": (f"""SELECT node_id, sum(w) AS rel_weight FROM (
      SELECT source AS node_id, count * {_weight('rel')} AS w FROM rewired
      UNION ALL SELECT target, count * {_weight('rel')} FROM rewired) GROUP BY node_id""", ["rewired"]),
    "degrees": ("""SELECT node_id, count(*) AS degree FROM (
      SELECT source AS node_id FROM links UNION ALL SELECT target FROM links) GROUP BY node_id""", ["links"]),
    "nodes": (f"""SELECT *, {risk()} AS risk FROM (SELECT m.*, coalesce(rel_weight, 0) AS rel_weight,
      coalesce(degree, 0) AS degree FROM merged m LEFT JOIN weights USING (node_id) LEFT JOIN degrees USING (node_id))""",
              ["merged", "weights", "degrees"]),
    "pairs": ("""SELECT source AS node_id, target AS other FROM links UNION
      SELECT target, source FROM links""", ["links"]),
    "evidence": ("""SELECT p.node_id, bit_or(a.tactic_mask) AS alert_mask, max(a.max_severity) AS alert_severity
      FROM pairs p JOIN nodes a ON a.node_id = p.other AND a.type = 'alert' GROUP BY p.node_id""", ["pairs", "nodes"]),
    "roles1": (f"""SELECT *, CASE WHEN type = 'alert' THEN 'hostile'
        WHEN external AND type IN ('ip', 'domain', 'url') THEN
          CASE WHEN (t & {_HOSTILE}) <> 0 OR touched_by_alert OR s >= 4 THEN 'hostile' ELSE 'neutral' END
        WHEN type IN {lst(fixed.CONTEXT_TYPES)} THEN CASE WHEN s >= 4 OR t <> 0 THEN 'suspicious' ELSE 'neutral' END
        WHEN s >= 4 OR (t & {_VICTIM}) <> 0 THEN 'victim'
        WHEN s >= 3 OR t <> 0 OR touched_by_alert THEN 'suspicious' ELSE 'asset' END AS role1
      FROM (SELECT n.*, e.node_id IS NOT NULL AS touched_by_alert, n.tactic_mask | coalesce(alert_mask, 0) AS t,
        greatest(n.max_severity, coalesce(alert_severity, 0)) AS s,
        CASE WHEN type IN ('domain', 'url') THEN true WHEN type = 'ip' THEN NOT {is_private('label')}
             WHEN type = 'host' AND ip IS NOT NULL THEN NOT {is_private('ip')} ELSE false END AS external
        FROM nodes n LEFT JOIN evidence e USING (node_id))""", ["nodes", "evidence"]),
    "hostile": ("SELECT DISTINCT lower(label) AS d FROM roles1 WHERE type IN ('domain', 'url') AND role1 = 'hostile'",
                ["roles1"]),
    "owned": (f"""SELECT DISTINCT n.node_id FROM roles1 n JOIN hostile h ON
      {after_last('lower(trim(n.label))', '@')} = h.d OR {after_last('lower(trim(n.label))', '@')} LIKE '%.' || h.d
      WHERE n.type IN ('mailbox', 'user', 'account') AND contains(n.label, '@')""", ["roles1", "hostile"]),
    "roles2": ("""SELECT r.*, CASE WHEN o.node_id IS NOT NULL THEN 'hostile' ELSE role1 END AS role2,
      external OR o.node_id IS NOT NULL AS outside FROM roles1 r LEFT JOIN owned o USING (node_id)""",
               ["roles1", "owned"]),
    "roles": (f"""SELECT *, CASE WHEN type IN {lst(fixed.CONTEXT_TYPES)} AND role2 = 'neutral' AND
        (max_severity >= 3 OR tactic_mask <> 0 OR node_id IN (SELECT p.node_id FROM pairs p JOIN roles2 v
           ON v.node_id = p.other AND v.role2 = 'victim')) THEN 'suspicious' ELSE role2 END AS role
      FROM roles2""", ["roles2", "pairs"]),
}


def sql(final: str, *names: str, ev_filter: str | None = None) -> str:
    """``WITH`` clause of the named steps (and their inputs) followed by the final SELECT.

    ``ev_filter`` restricts the events every step starts from.
    """
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in STEPS[name][1]:
                visit(dep)
            order.append(name)

    for name in names:
        visit(name)
    if not order:
        return final
    texts = {n: STEPS[n][0] for n in order}
    if ev_filter:
        texts["ev"] += f" WHERE {ev_filter}"
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in texts.items()) + "\n" + final
