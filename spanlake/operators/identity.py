"""Who may be whom: the approved table, sign-offs by workspace, evidence of each cluster, and gates on names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fuse import FIELDS

LEGAL_STATES = ["moving", "still", "not_visible"]


def approved(entities: DataFrame) -> DataFrame:
    return entities.filter(F.lower("status") == "approved")


def approved_slots(entities: DataFrame) -> DataFrame:
    """Slots S1.. of an episode, one an approved entity in the table's order (ep, pos, ...), with its profile."""
    number = F.row_number().over(Window.partitionBy("ep").orderBy("pos"))
    known = lambda f: F.coalesce(F.nullif(F.col(f), F.lit("")), F.lit("unknown")).alias(f)
    return approved(entities).select(
        "ep", F.concat(F.lit("S"), number.cast("string")).alias("slot_id"), *[known(f) for f in FIELDS],
        F.nullif(F.trim("visual_label"), F.lit("")).alias("visual_label"), F.lit("approved").alias("status"), "entity_id", F.col("canonical_name").alias("entity_name"),
    )


def surfaces(entities: DataFrame) -> DataFrame:
    """ep, entity_id, surface: the name and the aliases that an entity goes by."""
    listed = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    each = F.array_distinct(F.transform(F.filter(listed, lambda s: F.length(F.trim(s)) > 0), lambda s: F.trim(s)))
    return entities.select("ep", "entity_id", F.explode(each).alias("surface"))


def scoped_signoffs(entities: DataFrame, workspace: Column) -> DataFrame:
    """ep, cluster_id, entity_id, entity_name: clusters that a person named in this very workspace, the latest record winning.

    A cluster's name belongs to one episode, so a record of another workspace, or of none, says nothing here.
    """
    rows = approved(entities).select("ep", "pos", "entity_id", F.col("canonical_name").alias("entity_name"), workspace.alias("own"), F.posexplode("evidence").alias("n", "r"))
    rows = rows.filter((F.col("r.kind") == "signoff") & (F.col("r.workspace") == F.col("own")) & (F.col("r.cluster_id") != ""))
    last = rows.groupBy("ep", F.col("r.cluster_id").alias("cluster_id")).agg(F.max(F.struct("pos", "n", "entity_id", "entity_name")).alias("last"))
    return last.select("ep", "cluster_id", "last.entity_id", "last.entity_name")


def ruled_out(slots: DataFrame, entities: DataFrame, calls: DataFrame) -> DataFrame:
    """ep, cluster_id, slot_id: slots whose entity goes by a name that the cluster called (ep, cluster_id, term)."""
    named = slots.select("ep", "slot_id", "entity_id").join(surfaces(entities), ["ep", "entity_id"])
    called = calls.select("ep", "cluster_id", F.col("term").alias("surface")).distinct()
    return named.join(called, ["ep", "surface"]).select("ep", "cluster_id", "slot_id").distinct()


def slot_votes(slots: DataFrame, votes: DataFrame) -> DataFrame:
    """ep, cluster_id, slot_id, votes: how often a slot's own face spoke while the cluster did."""
    seen = votes.select("ep", "cluster_id", F.col("label").alias("visual_label"), "votes")
    return slots.select("ep", "slot_id", "visual_label").join(seen, ["ep", "visual_label"]).select("ep", "cluster_id", "slot_id", "votes")


# evidence ---------------------------------------------------------------------------------------------------


def acoustic_evidence(summary: DataFrame, attributes: DataFrame, names: DataFrame) -> DataFrame:
    """A row a cluster: voted attributes (unknown where none won), lines, speech, and whether it has a name."""
    known = attributes.filter("value <> 'unknown'").groupBy("ep", "cluster_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS])
    rows = summary.select("ep", "cluster_id", "line_count", "speech_ms").join(known, ["ep", "cluster_id"], "left").join(names.select("ep", "cluster_id", "name"), ["ep", "cluster_id"], "left")
    return rows.select("ep", "cluster_id", *[F.coalesce(f, F.lit("unknown")).alias(f) for f in FIELDS], "line_count", "speech_ms", F.col("name").isNotNull().alias("named"))


def visual_evidence(actions: DataFrame) -> DataFrame:
    """Per episode: clips (ep, segment) that show an action, those with a readable mouth, those with a moving one; actions by mouth state;
    and how often each face spoke."""
    state = F.col("mouth_state")
    speaking = (state == "moving") & (F.col("mouth_motion") == "speaking") & (F.length(F.trim("who")) > 0)
    clips = actions.groupBy("ep", "segment").agg(F.max(state.isin(LEGAL_STATES).cast("int")).alias("usable"), F.max((state == "moving").cast("int")).alias("positive"))
    clips = clips.groupBy("ep").agg(F.count(F.lit(1)).alias("clips_total"), F.sum("usable").alias("clips_usable"), F.sum("positive").alias("clips_positive"))
    states = actions.groupBy("ep").agg(*[F.count_if(state == s).alias(s) for s in LEGAL_STATES], F.count_if(~state.isin(LEGAL_STATES) | state.isNull()).alias("unknown"))
    faces = actions.filter(speaking).groupBy("ep", F.trim("who").alias("who")).agg(F.count(F.lit(1)).alias("n"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("who", "n"))), lambda x: F.concat(x["who"], F.lit(":"), x["n"].cast("string"))), ",")
    faces = faces.groupBy("ep").agg(told.alias("faces"))
    return clips.join(states, "ep").join(faces, "ep", "left").withColumn("faces", F.coalesce("faces", F.lit("")))


def evidence_bundle(heard: DataFrame, votes: DataFrame, calls: DataFrame) -> DataFrame:
    """All that is known of a cluster in one row: its voice, the faces that spoke with it, the names it called and so is not."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("neg"), "label")))
    faces = votes.groupBy("ep", "cluster_id").agg(F.array_join(F.transform(pairs, lambda x: F.concat(x["label"], F.lit("×"), (-x["neg"]).cast("string"))), "、").alias("faces"))
    called = calls.groupBy("ep", "cluster_id").agg(F.array_join(F.sort_array(F.collect_set("term")), ",").alias("not_speaker"))
    rows = heard.join(faces, ["ep", "cluster_id"], "left").join(called, ["ep", "cluster_id"], "left")
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("faces", "not_speaker")})


# results ----------------------------------------------------------------------------------------------------


def abstention(assignments: DataFrame) -> DataFrame:
    """ep, clusters, abstained, rate of (ep, cluster_id, status): clusters left unknown."""
    rows = assignments.groupBy("ep").agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("status") == "unknown").alias("abstained"))
    return rows.withColumn("rate", F.col("abstained") / F.col("clusters"))


def cast_summary(assignments: DataFrame) -> DataFrame:
    """ep, named, candidate, unknown: clusters by what became of them; no status counts as unknown."""
    status = F.coalesce("status", F.lit("unknown"))
    kinds = {"named": "approved", "candidate": "candidate", "unknown": "unknown"}
    return assignments.groupBy("ep").agg(*[F.count_if(status == s).alias(name) for name, s in kinds.items()])


def forged_names(entities: DataFrame, assignments: DataFrame, slots: DataFrame) -> DataFrame:
    """ep, rule, subject: names that no person stands behind.

    unsigned: an approved entity that no person approved, or at no date; forged: a slot of this episode that has an entity
    though its cluster was not signed off. slots: ep, slot_id, entity_id, origin; assignments: ep, cluster_id, slot_id, matched_via.
    """
    unsigned = approved(entities).filter("approved_by is distinct from 'human' or approved_at is null or approved_at = ''")
    own = slots.filter("entity_id is not null and origin <> 'approved_table'").select("ep", "slot_id")
    forged = assignments.filter("matched_via is distinct from 'human_signoff'").join(own, ["ep", "slot_id"])
    rule = lambda rows, name, subject: rows.select("ep", F.lit(name).alias("rule"), F.col(subject).alias("subject"))
    return rule(unsigned, "unsigned", "entity_id").unionByName(rule(forged, "forged", "slot_id")).distinct()


def allowed_names(generic: list[str], episodes: DataFrame, lineage: DataFrame, resolved: DataFrame, others: list[DataFrame]) -> DataFrame:
    """ep, surface: names that a line may be headed by: generic ones and, where the resolver has run (ep in ``resolved``), those of
    signed-off clusters alone; elsewhere those of all other tables (ep, surface)."""
    base = episodes.select("ep", F.explode(F.array(*map(F.lit, generic))).alias("surface"))
    own = lineage.select("ep", "surface").join(resolved.select("ep").distinct(), "ep", "left_semi")
    rows = base.unionByName(own)
    for other in others:
        rows = rows.unionByName(other.select("ep", "surface").join(resolved.select("ep").distinct(), "ep", "left_anti"))
    return rows.filter("trim(surface) <> ''").distinct()
