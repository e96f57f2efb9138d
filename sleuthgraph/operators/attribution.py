"""Which known groups the observed tools and notes resemble: a hypothesis, never a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .threat import Catalog, Findings, name_key, tool_weights

TOP_GROUPS = 6
EMPTY = "array<string>"


def note_strength(sharing: Column) -> Column:
    """Worth of a note name by how many groups share it."""
    (limit, worth), *rest = fixed.NOTE_STRENGTH
    out = F.when(sharing <= limit, worth)
    for limit, worth in rest:
        out = out.when(sharing <= limit, worth)
    return out.otherwise(fixed.NOTE_STRENGTH_WIDE)


def observed_tools(f: Findings) -> DataFrame:
    return f.tools.select("tool").distinct()


def note_evidence(f: Findings) -> DataFrame:
    """(group_key, note_match, note_strength) from known notes that name groups."""
    known = f.notes.where("known").where(F.size("groups") > 0).select("filename", "groups").distinct()
    return known.select("filename", note_strength(F.size("groups")).alias("worth"), F.explode("groups").alias("group")).groupBy(
        name_key(F.col("group")).alias("group_key")).agg(
        F.array_sort(F.collect_set("filename")).alias("note_match"), F.max("worth").alias("note_strength"))


def confidence(discriminating: Column, strength: Column) -> Column:
    return (F.when(strength >= 10.0, "high")
            .when((strength >= 3.0) & (discriminating >= 1), "medium")
            .when(discriminating >= 4, "medium").when(discriminating >= 2, "low").otherwise("inconclusive"))


def candidates(f: Findings, catalog: Catalog) -> DataFrame:
    """Every group with matched tools or notes, scored; see :func:`attribute` for the ranking."""
    weights = tool_weights(catalog)
    total = catalog.groups.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    profile = (catalog.groups.select(F.col("name").alias("group"), F.explode(F.array_distinct("tools")).alias("tool"))
               .join(weights, "tool", "left").fillna(1.0, ["weight"]).fillna(0, ["n_groups"])
               .join(observed_tools(f).withColumn("seen", F.lit(True)), "tool", "left"))
    seen = F.coalesce("seen", F.lit(False))
    profile = profile.withColumn("rare", seen & (F.col("n_groups") <= total * fixed.UBIQUITY_CUTOFF))
    listed = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("tool"))))
    groups = profile.groupBy("group").agg(
        listed(seen).alias("matched"), listed(F.col("rare")).alias("discriminating"),
        F.coalesce(F.sum(F.when(seen, F.col("weight"))), F.lit(0.0)).alias("_hit"),
        F.sum("weight").alias("_all"), F.count(F.lit(1)).alias("_size"))
    scored = groups.withColumn("group_key", name_key(F.col("group"))).join(note_evidence(f), "group_key", "left")
    strength = F.coalesce("note_strength", F.lit(0.0))
    n_rare = F.size("discriminating")
    return scored.where((F.size("matched") > 0) | F.col("note_match").isNotNull()).select(
        "group", (F.col("_hit") / F.sqrt("_all") + strength).alias("score"),
        confidence(n_rare, strength).alias("confidence"), "matched", "discriminating",
        F.coalesce("note_match", F.array().cast(EMPTY)).alias("note_match"), strength.alias("note_strength"),
        (F.size("matched") / F.col("_size")).alias("coverage"))


def attribute(f: Findings, catalog: Catalog, limit: int | None = TOP_GROUPS) -> DataFrame:
    """The best candidates (None: all), rounded for display and explained."""
    best = candidates(f, catalog).orderBy(F.desc("score"), F.desc(F.size("discriminating")), F.asc("group"))
    best = best if limit is None else best.limit(limit)
    return best.select("group", F.round("score", 3).alias("score"), "confidence", "matched", "discriminating",
                       "note_match", F.round("note_strength", 2).alias("note_strength"),
                       F.round("coverage", 3).alias("coverage"), explanation().alias("explanation"))


def explanation() -> Column:
    """A sentence that does not claim more than the confidence allows."""
    c, text = F.col, F.lit
    some = lambda col, n: F.array_join(F.slice(col, 1, n), ", ")
    noted = F.size("note_match") > 0
    return (
        F.when(noted & (c("note_strength") < 3.0), F.concat(
            text("Note "), some("note_match", 3), text(" was found, but many families use that name; it confirms ransomware, not "), c("group"), text(".")))
        .when(noted, F.concat(
            text("Note "), some("note_match", 3), text(" is tied to "), c("group"), text(" and "),
            F.size("matched").cast("string"), text(" tool(s) of its profile were seen; confirm with the binary and the payment trail.")))
        .when(c("confidence") == "medium", F.concat(
            text("The tools fit "), c("group"), text(", mostly "), some("discriminating", 4), text("; a hypothesis to guide the search.")))
        .when(c("confidence") == "low", F.concat(
            text("Partial overlap with "), c("group"), text(" ("), F.size("matched").cast("string"), text(" tools); too little to attribute.")))
        .otherwise(F.concat(text("The overlap with "), c("group"), text(" comes from tools everybody uses."))))


def unhelpful_tools(f: Findings, catalog: Catalog) -> DataFrame:
    """Observed tools that cannot attribute: ``ubiquitous`` or ``undocumented``."""
    total = catalog.groups.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    users = F.coalesce("n_groups", F.lit(0))
    kind = F.when(users > total * fixed.UBIQUITY_CUTOFF, "ubiquitous").when(users == 0, "undocumented")
    return observed_tools(f).join(tool_weights(catalog), "tool", "left").select("tool", kind.alias("kind")).where("kind IS NOT NULL")


def group_profile(catalog: Catalog, name: str | None = None) -> DataFrame:
    """Tools of one group (or of all) with usage and weight, heaviest first."""
    groups = catalog.groups if name is None else catalog.groups.where(F.lower("name") == name.lower())
    about = catalog.tools.select(F.col("name").alias("tool"), "category_label")
    return (groups.select(F.col("name").alias("group"), F.explode("tools").alias("tool"))
            .join(tool_weights(catalog), "tool", "left").join(about, "tool", "left")
            .select("group", "tool", F.coalesce("n_groups", F.lit(0)).alias("used_by_groups"),
                    F.round(F.coalesce("weight", F.lit(1.0)), 2).alias("weight"), F.coalesce("category_label", F.lit("")).alias("category_label"))
            .orderBy("group", F.desc("weight"), "tool"))
