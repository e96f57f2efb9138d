"""SQL steps for sentences, threat findings and attribution."""

from __future__ import annotations

from sleuthgraph.functions import fixed

from . import catalog as cat
from .oracle import ACCT, AUTH, DNS, FILE, FIND, MAIL, NET, PROC, STEPS, basename, canon_user, key_event, q


def rows(columns: str, data: list[tuple]) -> str:
    def cell(v):
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, list):
            return "[" + ", ".join(q(x) for x in v) + "]::VARCHAR[]"
        return q(v)
    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in data)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


USER = f"coalesce({canon_user('actor_user')}, nullif(actor_user, ''), 'an unknown user')"
HOST = "coalesce(device_hostname, device_ip, dst_hostname, dst_ip, src_hostname, src_ip, 'an unidentified machine')"
OPENER = "coalesce(src_hostname, src_ip, device_hostname, device_ip)"
ORIGIN = "coalesce(src_hostname, src_ip)"
TARGET = ("coalesce(domain, app, dst_hostname, dst_ip || CASE WHEN dst_port > 0 THEN ':' || dst_port ELSE '' END, "
          "'an unknown destination')")
FROM = f"CASE WHEN {ORIGIN} <> {HOST} THEN ' from ' || {ORIGIN} ELSE '' END"
LOGIN = f"CASE WHEN app IS NOT NULL THEN {TARGET} ELSE {HOST} END"
WITNESS = f"CASE WHEN device_hostname <> {OPENER} THEN ', reported by ' || device_hostname ELSE '' END"
LINE = r"trim(regexp_replace(proc_cmdline, '\s+', ' ', 'g'))"
SHOWN = f"CASE WHEN length({LINE}) > 160 THEN trim(left({LINE}, 160)) || '…' ELSE {LINE} END"
BLOCKED = "(activity = 'blocked' OR status = 'failure')"
SENTENCE = f"""CASE
  WHEN class_name = {FIND} THEN 'Alert ''' || message || ''' fired on ' || {HOST} || '.'
  WHEN class_name = {AUTH} AND status = 'failure' THEN {USER} || ' failed to sign in to ' || {LOGIN} || {FROM} || '.'
  WHEN class_name = {AUTH} AND activity = 'logon_remote' THEN {USER} || ' opened a remote session on ' || {LOGIN} || {FROM} || '.'
  WHEN class_name = {AUTH} THEN {USER} || ' signed in to ' || {LOGIN} || {FROM} || '.'
  WHEN class_name = {PROC} THEN {USER} || ' ran ' || coalesce(proc_name, 'a process') || ' on ' || {HOST}
    || coalesce(', started by ' || parent_name, '') || coalesce(' as `' || {SHOWN} || '`', '') || '.'
  WHEN class_name = {NET} AND ({OPENER} IS NULL OR {OPENER} = {TARGET}) THEN 'A connection to ' || {TARGET}
    || CASE WHEN {BLOCKED} THEN ' was blocked' ELSE ' was seen' END || {WITNESS} || '.'
  WHEN class_name = {NET} AND {BLOCKED} THEN 'A connection from ' || {OPENER} || ' to ' || {TARGET} || ' was blocked' || {WITNESS} || '.'
  WHEN class_name = {NET} THEN {OPENER} || ' connected to ' || {TARGET} || coalesce(' through ' || proc_name, '') || {WITNESS} || '.'
  WHEN class_name = {FILE} THEN coalesce(proc_name, {USER}) || CASE activity WHEN 'delete' THEN ' deleted ' WHEN 'modify' THEN ' modified '
    WHEN 'read' THEN ' read ' ELSE ' created ' END || coalesce(file_name, 'a file') || coalesce(' at ' || file_path, '') || ' on ' || {HOST} || '.'
  WHEN class_name = {DNS} THEN coalesce({OPENER}, {HOST}) || ' resolved ' || coalesce(domain, 'an unknown domain') || '.'
  WHEN class_name = {MAIL} THEN coalesce(email_sender, 'An unknown sender') || ' mailed ' || coalesce(email_recipient, 'an internal mailbox')
    || coalesce(' about ''' || email_subject || '''', '') || '.'
  WHEN class_name = {ACCT} THEN 'Account ' || {USER} || ' was created or changed on ' || {HOST} || '.' END"""

SEEN_ON = "coalesce(device_hostname, device_ip, src_hostname, src_ip, dst_hostname, dst_ip, 'unknown')"
SUFFIX = q(fixed.BINARY_SUFFIXES)
TEXT = "concat_ws(' ', proc_cmdline, message)"


def _tokens() -> str:
    split = q(r"[\s\"'`|&;,()<>]+")
    base = basename("tok")
    return f"""SELECT uid, tok2 AS name FROM (
      SELECT uid, unnest([b, CASE WHEN contains(b, ':') THEN split_part(b, ':', 1) END]) AS tok2 FROM (
        SELECT uid, {base} AS b FROM (SELECT uid, unnest(regexp_split_to_array(lower(proc_cmdline), {split})) AS tok
          FROM ev WHERE proc_cmdline IS NOT NULL)) WHERE b IS NOT NULL) WHERE tok2 <> ''"""


STEPS.update({
    "said": (f"SELECT *, {SENTENCE} AS text FROM ev", ["ev"]),
    "key_said": (f"SELECT * FROM said WHERE {key_event()}", ["said"]),
    "islands": ("""SELECT *, sum(start) OVER (ORDER BY time, uid) - 1 AS run_id FROM (SELECT *, CASE WHEN lag(text) OVER
      (ORDER BY time, uid) IS NOT DISTINCT FROM text THEN 0 ELSE 1 END AS start FROM key_said)""", ["key_said"]),
    "entries": ("""SELECT run_id, min(time) AS time, CASE WHEN count(*) > 1 THEN max(time) END AS until, count(*) AS count,
      max(severity) AS severity, first(uid ORDER BY time, uid) AS first_uid, first(text ORDER BY time, uid) AS text,
      first(source ORDER BY time, uid) AS source, first(tech1 ORDER BY time, uid) AS tech1,
      first(tech2 ORDER BY time, uid) AS tech2 FROM islands GROUP BY run_id""", ["islands"]),
    "tool_d": (rows("tool, category, category_label, exact_only, n_groups, stage", [
        (n, c, fixed.CATEGORY_LABEL[c], x, len(cat.tool_groups(n)), fixed.CATEGORY_STAGE.get(c, ""))
        for n, c, _, x in cat.TOOLS]), []),
    "pattern_d": (rows("tool, pattern", [(n, p.lower()) for n, _, ps, _ in cat.TOOLS for p in ps]), []),
    "group_d": (rows("grp, tool", [(g, t) for g, ts in cat.GROUPS.items() for t in ts]), []),
    "note_d": (rows("filename, grp, sharing", [(f, g, len(gs)) for f, gs in cat.NOTES.items() for g in gs]), []),
    "weight_d": (f"""SELECT tool, n_groups, CASE WHEN n_groups > 0 THEN 1 + ln({len(cat.GROUPS)} / n_groups) ELSE 1.0 END AS weight
      FROM tool_d""", ["tool_d"]),
    "bin_d": (f"SELECT pattern, min(tool) AS tool FROM pattern_d WHERE regexp_matches(pattern, {SUFFIX}) GROUP BY pattern",
              ["pattern_d"]),
    "frag_d": (f"""SELECT pattern, min(tool) AS tool FROM pattern_d WHERE NOT regexp_matches(pattern, {SUFFIX})
      AND length(pattern) >= 5 GROUP BY pattern""", ["pattern_d"]),
    "tokens": (_tokens(), ["ev"]),
    "places": (f"""SELECT uid, 'process' AS place, 0 AS position, lower({basename('proc_name')}) AS name, proc_name AS evidence FROM ev
      UNION ALL SELECT uid, 'process', 1, lower({basename('proc_path')}), proc_path FROM ev
      UNION ALL SELECT t.uid, 'cmdline', 2, name, proc_cmdline FROM tokens t JOIN ev USING (uid)
      UNION ALL SELECT uid, 'file', 3, lower({basename('file_name')}), file_name FROM ev
      UNION ALL SELECT uid, 'file', 4, lower({basename('file_path')}), file_path FROM ev""", ["ev", "tokens"]),
    "hits": ("""SELECT uid, d.tool, place, position, left(evidence, 200) AS evidence FROM places
      JOIN bin_d b ON name = b.pattern JOIN tool_d d ON d.tool = b.tool WHERE NOT (exact_only AND place = 'cmdline')
      UNION ALL SELECT uid, f.tool, 'cmdline', 9, left(proc_cmdline, 200) FROM ev
      JOIN frag_d f ON contains(lower(proc_cmdline), f.pattern)""", ["places", "bin_d", "tool_d", "frag_d", "ev"]),
    "tool_seen": (f"""SELECT h.uid, ev.time, h.tool, category, category_label, stage, {SEEN_ON} AS host,
      first(place ORDER BY position, evidence) AS place, first(evidence ORDER BY position, evidence) AS evidence
      FROM hits h JOIN ev USING (uid) JOIN tool_d d ON d.tool = h.tool GROUP BY ALL""", ["hits", "ev", "tool_d"]),
    "note_seen": (f"""SELECT uid, time, {SEEN_ON} AS host, coalesce(n.filename, file_name) AS filename,
      coalesce(file_path, file_name) AS path, n.filename IS NOT NULL AS known
      FROM ev LEFT JOIN (SELECT DISTINCT filename FROM note_d) n ON lower(n.filename) = lower({basename('file_name')})
      WHERE class_name = {FILE} AND file_name IS NOT NULL AND (n.filename IS NOT NULL OR
        (regexp_matches(lower({basename('file_name')}), {q(fixed.GENERIC_NOTE)})
         AND NOT regexp_matches(lower({basename('file_name')}), {q(fixed.NOT_A_NOTE)})))""", ["ev", "note_d"]),
    "behaviour": ("\nUNION ALL ".join(
        f"SELECT uid, time, {SEEN_ON} AS host, {q(s)} AS signature, {q(label)} AS label, {q(stage)} AS stage, "
        f"{sev} AS severity, {q(mitre)} AS technique, left({TEXT}, 220) AS evidence FROM ev "
        f"WHERE regexp_matches({TEXT}, {q('(?i)' + p)})" for s, label, stage, sev, mitre, p in fixed.SIGNATURES), ["ev"]),
    "stage_rows": ("""SELECT stage, 0 AS kind_order, 'tool' AS kind, tool AS label, time, uid FROM tool_seen WHERE stage <> ''
      UNION ALL SELECT stage, 1, 'behaviour', label, time, uid FROM behaviour
      UNION ALL SELECT 'impact', 2, 'note', filename, time, uid FROM note_seen""", ["tool_seen", "behaviour", "note_seen"]),
    "stage_d": (rows("stage_order, stage", [(i, s[0]) for i, s in enumerate(fixed.STAGES)]), []),
    "ladder": ("""SELECT d.stage_order, d.stage, count(r.uid) > 0 AS reached, count(r.uid) AS count
      FROM stage_d d LEFT JOIN stage_rows r USING (stage) GROUP BY d.stage_order, d.stage""", ["stage_d", "stage_rows"]),
    "note_groups": ("""SELECT replace(lower(grp), ' ', '') AS grp_key, max(worth) AS note_strength,
      string_agg(DISTINCT filename, ',' ORDER BY filename) AS note_match FROM (
        SELECT d.filename, d.grp, CASE WHEN sharing <= 1 THEN 10.0 WHEN sharing <= 3 THEN 3.0 WHEN sharing <= 8 THEN 0.8
          ELSE 0.1 END AS worth FROM note_d d JOIN note_seen s ON s.filename = d.filename AND s.known) GROUP BY 1""",
                    ["note_d", "note_seen"]),
    "scored": (f"""SELECT g.grp, sum(CASE WHEN seen THEN weight ELSE 0 END) / sqrt(sum(weight)) AS base, count(*) AS size,
      string_agg(CASE WHEN seen THEN g.tool END, ',' ORDER BY g.tool) AS matched, count(*) FILTER (WHERE seen) AS n_matched,
      string_agg(CASE WHEN seen AND n_groups <= {len(cat.GROUPS) * fixed.UBIQUITY_CUTOFF} THEN g.tool END, ',' ORDER BY g.tool)
        AS discriminating,
      count(*) FILTER (WHERE seen AND n_groups <= {len(cat.GROUPS) * fixed.UBIQUITY_CUTOFF}) AS n_rare
      FROM (SELECT grp, g.tool, w.weight, w.n_groups, g.tool IN (SELECT tool FROM tool_seen) AS seen
            FROM group_d g JOIN weight_d w ON w.tool = g.tool) g GROUP BY g.grp""", ["group_d", "weight_d", "tool_seen"]),
    "attribution": ("""SELECT grp AS "group", round(base + coalesce(note_strength, 0), 3) AS score,
      CASE WHEN coalesce(note_strength, 0) >= 10 THEN 'high' WHEN coalesce(note_strength, 0) >= 3 AND n_rare >= 1 THEN 'medium'
        WHEN n_rare >= 4 THEN 'medium' WHEN n_rare >= 2 THEN 'low' ELSE 'inconclusive' END AS confidence,
      coalesce(matched, '') AS matched, coalesce(discriminating, '') AS discriminating, coalesce(note_match, '') AS note_match,
      coalesce(note_strength, 0) AS note_strength, round(n_matched / size, 3) AS coverage, n_rare
      FROM scored LEFT JOIN note_groups ON grp_key = replace(lower(grp), ' ', '')
      WHERE n_matched > 0 OR note_match IS NOT NULL""", ["scored", "note_groups"]),
})
