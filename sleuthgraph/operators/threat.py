"""Intrusion tools, ransom notes and ransomware behaviour in events.

Catalog dimensions come in as tables; their sizes decide the join strategy (the
optimiser broadcasts what is under its size threshold and shuffles the rest).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canon, fixed, values
from ..plans.lineage import cut

# Defaults of what a report shows; callers pass None for all of it.
EVIDENCE_CHARS = 200
BEHAVIOUR_EVIDENCE_CHARS = 220
STAGE_EVIDENCE = 8
#: Fragments that a task's automaton takes; a few megabytes.
MAX_AUTOMATON = 20_000


@dataclass
class Catalog:
    """``tools`` (name, category, category_label, tactic, patterns, exact_only, groups),
    ``groups`` (name, tools), ``notes`` (filename, groups)."""

    tools: DataFrame
    groups: DataFrame
    notes: DataFrame


# --- building the dimensions from landed tables ------------------------------------

def clean_tool(name: Column) -> Column:
    """Tool name without defanging, affiliate marks and odd spacing."""
    text = F.replace(F.replace(canon.strip(name), F.lit("[.]"), F.lit(".")), F.lit("[:]"), F.lit(":"))
    text = F.regexp_replace(F.regexp_replace(text, r"\s*\*+\s*$", ""), r"\s*\+\s*$", "")
    return canon.not_in(canon.strip(F.regexp_replace(text, r"\s+", " ")), [""])


def derived_patterns(tool: Column) -> Column:
    """Executable names guessed from a tool name: squeezed, hyphenated, underscored (4+ characters)."""
    base = F.lower(canon.strip(tool))
    forms = F.array(F.regexp_replace(base, r"[^a-z0-9._-]", ""), F.regexp_replace(base, r"\s+", "-"),
                    F.regexp_replace(base, r"\s+", "_"))
    return F.array_sort(F.array_distinct(F.transform(F.filter(forms, lambda f: F.length(f) >= 4),
                                                     lambda f: F.concat(f, F.lit(".exe")))))


def _tool_rows(named: DataFrame, curated: DataFrame) -> DataFrame:
    """(name, category) -> full tool rows; ``curated`` (name, patterns) overrides derived patterns."""
    lookup = lambda table: F.try_element_at(values.literal_map(table), F.col("category"))
    known = curated.select(F.col("name"), F.col("patterns").alias("_known"))
    return named.join(known, "name", "left").select(
        "name", "category", F.coalesce(lookup(fixed.CATEGORY_LABEL), F.col("category")).alias("category_label"),
        F.coalesce(lookup(fixed.CATEGORY_TACTIC), F.lit("")).alias("tactic"),
        F.coalesce("_known", derived_patterns(F.col("name"))).alias("patterns"),
        F.lower("name").isin(fixed.EXACT_ONLY_TOOLS).alias("exact_only"), F.col("_known").isNotNull().alias("curated"))


def tool_dimension(matrix: DataFrame, curated: DataFrame) -> DataFrame:
    """Column-per-category matrix -> one row per tool (the last category column wins)."""
    order = {c: i for i, c in enumerate(matrix.columns)}
    long = matrix.unpivot([], list(matrix.columns), "category", "cell").select(
        clean_tool(F.col("cell")).alias("name"), F.trim("category").alias("category"),
        values.literal_map(order)[F.col("category")].alias("_rank")).where("name IS NOT NULL")
    named = long.groupBy("name").agg(F.max_by("category", "_rank").alias("category"))
    return _tool_rows(named, curated)


def group_dimension(profiles: DataFrame, note_files: DataFrame | None = None) -> DataFrame:
    """(name, tools_by_category map) -> (name, tools, notes)."""
    tools = profiles.select("name", F.explode_outer(F.map_values("tools_by_category")).alias("_t")).select(
        "name", F.explode_outer("_t").alias("tool"))
    out = tools.groupBy("name").agg(F.array_sort(F.collect_set("tool")).alias("tools"))
    if note_files is None:
        return out
    owned = note_files.select("filename", F.explode("groups").alias("name")).groupBy("name").agg(
        F.array_sort(F.collect_set("filename")).alias("notes"))
    return out.join(owned, "name", "left")


def complete_tools(tools: DataFrame, profiles: DataFrame, curated: DataFrame) -> DataFrame:
    """Tools plus those only profiles name, each with the groups that use it."""
    used = profiles.select("name", F.explode("tools_by_category").alias("category", "list")).select(
        F.col("name").alias("group"), "category", F.explode("list").alias("tool"))
    missing = used.join(tools, used["tool"] == tools["name"], "left_anti").groupBy(F.col("tool").alias("name")).agg(
        F.min("category").alias("category"))
    users = used.groupBy(F.col("tool").alias("name")).agg(F.array_sort(F.collect_set("group")).alias("groups"))
    return (tools.unionByName(_tool_rows(missing, curated)).join(users, "name", "left")
            .withColumn("groups", F.coalesce("groups", F.array().cast("array<string>"))))


def name_key(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit(""))


def note_dimension(links: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, filename) -> (key, filename, groups): names unified with the profiles' spelling."""
    canonical = groups.select(name_key(F.col("name")).alias("_key"), F.col("name").alias("_name"))
    spelled = links.withColumn("_key", name_key(F.col("group"))).join(canonical, "_key", "left").select(
        F.lower("filename").alias("key"), "filename", F.coalesce("_name", "group").alias("group"))
    return spelled.groupBy("key").agg(F.min("filename").alias("filename"),
                                      F.array_sort(F.collect_set("group")).alias("groups"))


# --- indexes ---------------------------------------------------------------------------

def _patterns(tools: DataFrame) -> DataFrame:
    return tools.select(F.col("name").alias("tool"), F.explode("patterns").alias("p")).select(
        "tool", F.lower(canon.strip(F.col("p"))).alias("pattern")).where("pattern <> ''")


def _first_tool(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("pattern").agg(F.min("tool").alias("tool"))


def binary_index(tools: DataFrame) -> DataFrame:
    """Executable name -> tool; the alphabetically first tool owns a shared name."""
    return _first_tool(_patterns(tools).where(F.col("pattern").rlike(fixed.BINARY_SUFFIXES)))


def fragment_index(tools: DataFrame) -> DataFrame:
    """Command-line fragment of five or more characters -> tool."""
    rows = _patterns(tools).where(~F.col("pattern").rlike(fixed.BINARY_SUFFIXES)
                                  & (F.length("pattern") >= fixed.MIN_FRAGMENT))
    return _first_tool(rows)


def tool_weights(catalog: Catalog) -> DataFrame:
    """(tool, n_groups, weight): 1 + ln(groups / users), 1 for a tool nobody is known to use."""
    total = catalog.groups.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    users = F.size("groups")
    return catalog.tools.select(F.col("name").alias("tool"), users.alias("n_groups"),
                                F.when(users > 0, 1.0 + F.ln(total / users)).otherwise(1.0).alias("weight"))


# --- sightings ------------------------------------------------------------------------------

def sighting_host() -> Column:
    refs = [canon.not_in(F.col(f"{e}.{p}"), [""]) for e in ("device", "src", "dst") for p in ("hostname", "ip")]
    return F.coalesce(*refs, F.lit("unknown"))


def _shown(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def _candidates(chars: int | None) -> Column:
    """Ordered (place, position, name, evidence) structs of one event."""
    c = F.col

    def place(kind: str, position: int, value: Column) -> Column:
        name = canon.lower_basename(value)
        return F.when(name.isNotNull(), F.struct(F.lit(kind).alias("place"), F.lit(position).alias("position"),
                                                 name.alias("name"), _shown(value, chars).alias("evidence")))

    line = c("process.cmdline")
    tokens = F.transform(values.command_names(line), lambda n: F.struct(
        F.lit("cmdline").alias("place"), F.lit(2).alias("position"), n.alias("name"),
        _shown(line, chars).alias("evidence")))
    fields = F.array(place("process", 0, c("process.name")), place("process", 1, c("process.path")),
                     place("file", 3, c("file.name")), place("file", 4, c("file.path")))
    kind = "array<struct<place:string,position:int,name:string,evidence:string>>"
    return F.array_compact(F.concat(fields.cast(kind), F.coalesce(tokens.cast(kind), F.array().cast(kind))))


def _binary_hits(events: DataFrame, tools: DataFrame, chars: int | None) -> DataFrame:
    exact = tools.select(F.col("name").alias("tool"), "exact_only")
    index = binary_index(tools).join(exact, "tool").select(F.col("pattern").alias("name"), "tool", "exact_only")
    rows = values.unnest(events, [F.col("uid"), F.col("time"), sighting_host().alias("host")], _candidates(chars), "name")
    return rows.join(index, "name").where("NOT (exact_only AND place = 'cmdline')").select(
        "uid", "time", "host", "tool", "place", "position", "evidence")


def _fragment_hits(events: DataFrame, tools: DataFrame, most: int = MAX_AUTOMATON, chars: int | None = EVIDENCE_CHARS) -> DataFrame:
    """Fragments inside command lines.

    All fragments are looked for in one pass over each line by an automaton, which tasks build from at
    most ``most`` fragments; a larger index meets the lines by an equality join.
    """
    index = cut(fragment_index(tools))
    rows = (events.where(F.length("process.cmdline") >= fixed.MIN_FRAGMENT)
            .select("uid", "time", sighting_host().alias("host"), F.lower(F.col("process.cmdline")).alias("line"),
                    _shown(F.col("process.cmdline"), chars).alias("evidence")))
    first = index.limit(most + 1).collect()
    if not first:
        found = rows.where(F.lit(False)).withColumn("tool", F.lit(""))
    elif len(first) <= most:
        found = _automaton_hits(rows, {r["pattern"]: r["tool"] for r in first})
    else:
        found = _window_hits(rows, index)
    return found.select("uid", "time", "host", "tool", F.lit("cmdline").alias("place"), F.lit(9).alias("position"), "evidence")


def _automaton_hits(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """The lines that hold a fragment, once for each tool."""
    def run(batches):
        import ahocorasick
        import pyarrow as pa
        automaton = ahocorasick.Automaton()
        for pattern, tool in patterns.items():
            automaton.add_word(pattern, tool)
        automaton.make_automaton()
        for batch in batches:
            hits = [(k, tool) for k, line in enumerate(batch.column("line").to_pylist()) for tool in sorted({t for _, t in automaton.iter(line)})]
            if hits:
                rows_hit = batch.take(pa.array([k for k, _ in hits]))
                yield pa.RecordBatch.from_arrays([*[rows_hit.column(c) for c in kept], pa.array([tool for _, tool in hits])], names=[*kept, "tool"])

    kept = ["uid", "time", "host", "evidence"]
    return rows.mapInArrow(run, "uid string, time timestamp, host string, evidence string, tool string")


def _window_hits(rows: DataFrame, index: DataFrame) -> DataFrame:
    """A fragment's first five characters are one of the five-character windows of any line that contains it."""
    n = fixed.MIN_FRAGMENT
    line = F.col("line")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(line) - (n - 1)), lambda i: F.substr(line, i, F.lit(n))))
    keyed = index.select(F.substring("pattern", 1, n).alias("gram"), "pattern", "tool")
    return rows.withColumn("gram", F.explode_outer(grams)).join(keyed, "gram").where(F.col("line").contains(F.col("pattern")))


def tool_sightings(events: DataFrame, catalog: Catalog, evidence_chars: int | None = EVIDENCE_CHARS) -> DataFrame:
    """One row per (event, tool), the first place wins; names before fragments."""
    hits = _binary_hits(events, catalog.tools, evidence_chars).unionByName(
        _fragment_hits(events, catalog.tools, chars=evidence_chars))
    first = hits.groupBy("uid", "tool").agg(F.min_by(
        F.struct("time", "host", "place", "evidence"), F.struct("position", "evidence")).alias("hit"))
    about = catalog.tools.select(F.col("name").alias("tool"), "category", "category_label", "groups")
    stage = F.coalesce(F.try_element_at(values.literal_map(fixed.CATEGORY_STAGE), F.col("category")), F.lit(""))
    return first.select("uid", "tool", "hit.*").join(about, "tool").withColumn("stage", stage)


def note_sightings(events: DataFrame, catalog: Catalog) -> DataFrame:
    """Ransom notes on file events: known names, else names of the generic shape."""
    name = F.coalesce(canon.not_in(F.col("file.name"), [""]), canon.lower_basename(F.col("file.path")))
    base = canon.lower_basename(F.col("_name"))
    rows = (events.where(F.col("class_name") == fixed.FILE_ACTIVITY)
            .select("uid", "time", sighting_host().alias("host"), name.alias("_name"), F.col("file.path").alias("path"))
            .withColumn("_key", canon.strip(base)))
    known = catalog.notes.select(F.lower("filename").alias("_key"), "filename", "groups")
    generic = F.col("_key").rlike(fixed.GENERIC_NOTE) & ~F.col("_key").rlike(fixed.NOT_A_NOTE)
    return rows.join(known, "_key", "left").where(F.col("filename").isNotNull() | generic).select(
        "uid", "time", "host", F.coalesce("filename", "_name").alias("filename"),
        F.coalesce(canon.not_in(F.col("path"), [""]), F.col("_name")).alias("path"),
        F.coalesce("groups", F.array().cast("array<string>")).alias("groups"), F.col("filename").isNotNull().alias("known"))


def behaviour_hits(events: DataFrame, evidence_chars: int | None = BEHAVIOUR_EVIDENCE_CHARS) -> DataFrame:
    """One row per (event, signature) whose pattern occurs in command line or message."""
    text = F.concat_ws(" ", canon.not_in(F.col("process.cmdline"), [""]), canon.not_in(F.col("message"), [""]))
    rows = events.select("uid", "time", sighting_host().alias("host"), text.alias("text"))
    hits = [F.when(F.col("text").rlike("(?i)" + pattern), F.struct(
        F.lit(sig).alias("signature"), F.lit(label).alias("label"), F.lit(stage).alias("stage"),
        F.lit(severity).alias("severity"), F.lit(mitre).alias("technique")))
        for sig, label, stage, severity, mitre, pattern in fixed.SIGNATURES]
    kept = [F.col("uid"), F.col("time"), F.col("host"), _shown(F.col("text"), evidence_chars).alias("evidence")]
    return values.unnest(rows, kept, F.array_compact(F.array(*hits)), "signature")


def distinct_behaviours(hits: DataFrame) -> DataFrame:
    """Earliest hit per (signature, host)."""
    rest = F.struct("time", "uid", "evidence", "label", "stage", "severity", "technique")
    return hits.groupBy("signature", "host").agg(F.min_by(rest, F.struct("time", "uid")).alias("h")).select(
        "signature", "host", "h.*")


# --- synthesis --------------------------------------------------------------------------------

@dataclass
class Findings:
    tools: DataFrame
    notes: DataFrame
    behaviours: DataFrame


def scan(events: DataFrame, catalog: Catalog, tool_chars: int | None = EVIDENCE_CHARS,
         behaviour_chars: int | None = BEHAVIOUR_EVIDENCE_CHARS) -> Findings:
    return Findings(tool_sightings(events, catalog, tool_chars), note_sightings(events, catalog), behaviour_hits(events, behaviour_chars))


def stage_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *s) for i, s in enumerate(fixed.STAGES)],
                                 "stage_order int, stage string, label string, hint string")


def stage_evidence(f: Findings) -> DataFrame:
    """Distinct evidence per stage with its raw count and first place."""
    cols = ["stage", "kind_order", "kind", "label", "detail", "host", "time", "uid"]
    tools = f.tools.where("stage <> ''").selectExpr(
        "stage", "0 AS kind_order", "'tool' AS kind", "tool AS label", "category_label AS detail", "host", "time", "uid")
    behaviours = f.behaviours.selectExpr(
        "stage", "1 AS kind_order", "'behaviour' AS kind", "label", "technique AS detail", "host", "time", "uid")
    notes = f.notes.selectExpr(
        "'impact' AS stage", "2 AS kind_order", "'note' AS kind", "filename AS label", "'ransom note' AS detail", "host", "time", "uid")
    rows = tools.select(cols).unionByName(behaviours.select(cols)).unionByName(notes.select(cols))
    return rows.groupBy("stage", "kind_order", "kind", "label").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("time", "uid", "detail", "host")).alias("first"))


def stage_ladder(f: Findings, spark: SparkSession, limit: int | None = STAGE_EVIDENCE) -> DataFrame:
    """All eight stages in order: reached, raw count, ``limit`` pieces of evidence (None: all) and how many are ``hidden``."""
    from pyspark.sql import Window

    found = stage_evidence(f)
    order = Window.partitionBy("stage").orderBy("kind_order", "first.time", "first.uid", "label")
    placed = found.withColumn("_n", F.row_number().over(order))
    shown = placed if limit is None else placed.where(F.col("_n") <= limit)
    listed = shown.groupBy("stage").agg(F.array_sort(F.collect_list(F.struct(
        "_n", "kind", "label", F.col("first.detail").alias("detail"), F.col("first.host").alias("host")))).alias("evidence"))
    counts = found.groupBy("stage").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("_pieces"))
    hidden = F.coalesce("_pieces", F.lit(0)) - F.coalesce(F.size("evidence"), F.lit(0))
    return (stage_dimension(spark).join(counts, "stage", "left").join(listed, "stage", "left")
            .select("stage_order", "stage", "label", "hint", F.col("count").isNotNull().alias("reached"),
                    F.coalesce("count", F.lit(0)).alias("count"), "evidence", hidden.alias("hidden")).orderBy("stage_order"))


def next_stage(ladder: DataFrame) -> DataFrame:
    """First stage after the last one reached (no row when none is left)."""
    last = ladder.agg(F.coalesce(F.max(F.when(F.col("reached"), F.col("stage_order"))), F.lit(-1))).scalar()
    return ladder.where(F.col("stage_order") > last).select("stage_order", "stage", "label", "hint").orderBy("stage_order").limit(1)


def severity_floor(f: Findings) -> DataFrame:
    """One row: the least severity the findings deserve."""
    notes = f.notes.agg(F.count(F.lit(1))).scalar()
    tools = f.tools.agg(F.count(F.lit(1))).scalar()
    return f.behaviours.agg(F.max("severity").alias("b")).select(
        F.when(notes > 0, 5).when(F.col("b") >= 5, 5).when(F.col("b").isNotNull(), F.col("b"))
        .when(tools > 0, 3).otherwise(0).alias("severity_floor"))


def tools_by_category(tools: DataFrame) -> DataFrame:
    return tools.groupBy("category_label").agg(F.array_sort(F.collect_set("tool")).alias("tools"),
                                               F.count_distinct("tool").alias("n_tools"))


def threat_counts(f: Findings) -> DataFrame:
    """One row: distinct tools, distinct signatures, notes."""
    return f.tools.agg(F.count_distinct("tool").alias("tool_count")).select(
        "tool_count", f.behaviours.agg(F.count_distinct("signature")).scalar().alias("behaviour_count"),
        f.notes.agg(F.count(F.lit(1))).scalar().alias("note_count"))


def notes_by_name(notes: DataFrame) -> DataFrame:
    """One row per note name: its distinct hosts in order, how many they are and how often it was seen."""
    return note_hosts(notes).groupBy("filename").agg(F.array_sort(F.collect_list("host")).alias("hosts"), F.count("host").alias("n_hosts"),
                                                     F.sum("sightings").alias("sightings"))


def note_hosts(notes: DataFrame) -> DataFrame:
    """One row per (note name, host)."""
    return notes.groupBy("filename", "host").agg(F.count(F.lit(1)).alias("sightings"))


def catalog_statistics(catalog: Catalog) -> DataFrame:
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return catalog.tools.agg(F.count(F.lit(1)).alias("tools")).select(
        "tools", count(catalog.groups).alias("groups"), count(catalog.notes).alias("ransom_notes"),
        count(binary_index(catalog.tools)).alias("binary_patterns"))
