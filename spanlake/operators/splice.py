"""Templated drafts: placeholders checked and filled, heads, attribution audit, outline checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import classify, cluster_token, split_head, trace

# How drafts write placeholders, dialogue heads and overrides. A digit after another digit counts as a number of its own.
PLACEHOLDER = r"\[\[SUB:(\d+)\]\]"
HEAD = r"^\*\*([^*\n]{1,24})\*\*(?:\s*$|\s*[（(][^）)]*[）)]\s*[：:]|\s*[：:])"
OVERRIDE = r"(?s)<!--\s*attribution-override:\s*(.*?)-->"


def placeholders(drafts: DataFrame) -> DataFrame:
    """ep, scene, ord, sub: the placeholders of (ep, scene, text) in order."""
    return drafts.select("ep", "scene", F.posexplode(F.regexp_extract_all("text", F.lit(PLACEHOLDER), F.lit(1))).alias("ord", "sub")).withColumn("sub", F.col("sub").cast("long"))


def violations(drafts: DataFrame, expected: DataFrame, cues: DataFrame) -> DataFrame:
    """ep, scene, rule, sub: every way in which placeholders miss 'each cue of a scene once, in order'.

    expected: ep, scene, sub; cues: ep, sub. Rules: unknown, foreign, missing, duplicate, disorder, orphan.
    """
    used = placeholders(drafts)
    rule = lambda df, name: df.select("ep", "scene", F.lit(name).alias("rule"), "sub")
    known = cues.select("ep", "sub")
    unknown = used.join(known, ["ep", "sub"], "left_anti")
    foreign = used.join(known, ["ep", "sub"], "left_semi").join(expected, ["ep", "scene", "sub"], "left_anti")
    missing = expected.join(used, ["ep", "scene", "sub"], "left_anti")
    duplicate = used.groupBy("ep", "scene", "sub").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    before = F.lag("sub").over(Window.partitionBy("ep", "scene").orderBy("ord"))
    disorder = used.withColumn("before", before).filter("sub < before")
    orphan = known.join(expected.select("ep", "sub"), ["ep", "sub"], "left_anti").withColumn("scene", F.lit(None).cast("long"))
    return rule(unknown, "unknown").unionByName(rule(foreign.distinct(), "foreign")).unionByName(rule(missing, "missing")).unionByName(rule(duplicate, "duplicate")).unionByName(rule(disorder, "disorder")).unionByName(rule(orphan, "orphan")).distinct()


def spliced(drafts: DataFrame, cues: DataFrame) -> DataFrame:
    """ep, scene, text with every placeholder replaced by its cue's text, verbatim."""
    pieces = drafts.select("ep", "scene", F.split("text", PLACEHOLDER.replace("(", "").replace(")", "")).alias("between"))
    filled = placeholders(drafts).join(cues.select("ep", F.col("cue").alias("sub"), F.col("text").alias("said")), ["ep", "sub"], "left")
    filled = filled.groupBy("ep", "scene").agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("said", F.lit("")).alias("said")))).alias("said"))
    rows = pieces.join(filled, ["ep", "scene"], "left")
    said = F.coalesce(F.transform("said", lambda x: x["said"]), F.array().cast("array<string>"))
    woven = F.transform("between", lambda b, i: F.concat(b, F.coalesce(F.get(said, i), F.lit(""))))
    return rows.select("ep", "scene", F.array_join(woven, "").alias("text"))


def heads_of(drafts: DataFrame) -> DataFrame:
    """ep, scene, sub, head: the dialogue head that each placeholder stands under; the scene's slug is no head."""
    listed = drafts.select("ep", "scene", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    bold = F.col("said").rlike(r"^\*\*([^*\n].*?)\*\*")
    slug = F.min(F.when(bold, F.col("line"))).over(Window.partitionBy("ep", "scene"))
    listed = listed.withColumn("slug", slug)
    head = F.when(F.col("said").rlike(HEAD) & (F.col("line") != F.col("slug")), F.trim(F.regexp_extract("said", HEAD, 1)))
    listed = listed.withColumn("head", F.last(head, ignorenulls=True).over(Window.partitionBy("ep", "scene").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    subs = listed.select("ep", "scene", "line", "head", F.posexplode(F.regexp_extract_all("said", F.lit(PLACEHOLDER), F.lit(1))).alias("o", "sub"))
    last = F.max(F.struct("line", "o", "head"))["head"]
    return subs.filter("head is not null").groupBy("ep", "scene", F.col("sub").cast("long").alias("sub")).agg(last.alias("head"))


def overrides(drafts: DataFrame) -> DataFrame:
    """ep, lines, clusters: what the override comments of an episode's drafts cover."""
    body = drafts.select("ep", F.explode(F.regexp_extract_all("text", F.lit(OVERRIDE), F.lit(1))).alias("body"))
    numbers = F.transform(F.regexp_extract_all("body", F.lit(r"(?<![A-Za-z])(\d+)"), F.lit(1)), lambda x: x.cast("long"))
    tokens = F.transform(F.regexp_extract_all("body", F.lit(r"([A-Za-z_]+\d+)"), F.lit(1)), cluster_token)
    rows = body.select("ep", numbers.alias("lines"), tokens.alias("clusters"))
    return rows.groupBy("ep").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"), F.array_distinct(F.flatten(F.collect_list("clusters"))).alias("clusters"))


def lineage(clusters: DataFrame, slots: DataFrame, entities: DataFrame) -> DataFrame:
    """ep, cluster_id, name, surface: the names and aliases of entities that approved assignments lead to.

    clusters: ep, cluster_id, slot_id, status, entity_id; slots: ep, slot_id, slot_entity; entities: entity_id, canonical_name, aliases.
    """
    own = clusters.filter("status = 'approved'").join(slots, ["ep", "slot_id"], "left").withColumn("entity_id", F.coalesce("entity_id", "slot_entity"))
    named = own.join(entities, "entity_id").filter("trim(canonical_name) <> ''")
    surfaces = F.array_distinct(F.concat(F.array(F.trim("canonical_name")), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.trim(a))))
    return named.select("ep", "cluster_id", F.trim("canonical_name").alias("name"), F.explode(F.filter(surfaces, lambda s: s != "")).alias("surface"))


def audit(drafts: DataFrame, dialogue: DataFrame, clusters: DataFrame, names: DataFrame) -> DataFrame:
    """ep, scene, sub, cluster_id, head, expected: lines whose head names an entity other than that of their own cluster.

    dialogue: ep, scene, sub, speaker; clusters: ep, cluster_id; names: as lineage(). Waived by an override comment.
    """
    said = dialogue.join(clusters.select("ep", F.col("cluster_id").alias("speaker")).distinct(), ["ep", "speaker"]).join(heads_of(drafts), ["ep", "scene", "sub"])
    known = names.groupBy("ep").agg(F.collect_set("surface").alias("known"))
    parts = said.join(known, "ep").withColumn("part", F.explode(split_head(F.col("head")))).filter(classify(F.col("part")) == "name")
    traced = parts.withColumn("surface", trace(F.col("part"), F.col("known"))).filter("surface is not null")
    traced = traced.join(names.select("ep", "surface", "name").distinct(), ["ep", "surface"])
    own = names.select("ep", F.col("cluster_id").alias("speaker"), F.col("name").alias("expected")).distinct()
    lines = traced.join(own, ["ep", "speaker"], "left").groupBy("ep", "scene", "sub", "speaker", "head", "expected").agg(F.max(F.coalesce(F.col("name") == F.col("expected"), F.lit(False))).alias("right"))
    covered = F.coalesce(F.array_contains("lines", F.col("sub")), F.lit(False)) | F.coalesce(F.array_contains("clusters", cluster_token(F.col("speaker"))), F.lit(False))
    return lines.filter("not right").join(overrides(drafts), "ep", "left").filter(~covered).select("ep", "scene", "sub", F.col("speaker").alias("cluster_id"), "head", "expected")


def outline_gaps(sequences: DataFrame, cues: DataFrame) -> DataFrame:
    """ep, seq, problem: sequences that do not follow on from one another, or do not cover the cues from first to last."""
    order = Window.partitionBy("ep").orderBy("seq")
    ends = cues.groupBy("ep").agg(F.min("cue").alias("first"), F.max("cue").alias("last"))
    rows = sequences.withColumn("before", F.lag("end_sub").over(order)).withColumn("next", F.lead("start_sub").over(order)).join(ends, "ep")
    problem = F.array_compact(F.array(
        F.when(F.col("before").isNull() & (F.col("start_sub") != F.col("first")), "start"),
        F.when(F.col("start_sub") > F.col("before") + 1, "gap"),
        F.when(F.col("start_sub") <= F.col("before"), "overlap"),
        F.when(F.col("end_sub") < F.col("start_sub"), "reversed"),
        F.when(F.col("next").isNull() & (F.col("end_sub") != F.col("last")), "end"),
    ))
    return rows.select("ep", "seq", F.explode(problem).alias("problem"))
