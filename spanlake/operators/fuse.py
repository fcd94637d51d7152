"""Evidence fusion: distributions over candidates, their product, margins, and the resolver's fold."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compatible
from .interval import interval_join

FAMILIES, MARGIN = 2, 0.34
FIELDS = ["gender", "age_band", "timbre"]
# What a mouth may be told to do.
STATES, MOTIONS = ["moving", "still", "not_visible"], ["speaking", "chewing", "yawning", "other", "not_applicable"]


def visual_votes(turns: DataFrame, actions: DataFrame) -> DataFrame:
    """ep, cluster_id, label, votes: one vote for each (turn, speaking action) pair that shares time."""
    speaking = actions.filter((F.col("mouth_state") == "moving") & (F.col("mouth_motion") == "speaking") & (F.trim("who") != ""))
    pairs = interval_join(turns.select("ep", "cluster_id", "start_ms", "end_ms", "event_id"), speaking.select("ep", "who", "action", "r_start_ms", "r_end_ms"), ["ep"])
    return pairs.groupBy("ep", "cluster_id", F.trim("who").alias("label")).agg(F.count(F.lit(1)).alias("votes"))


def over_split(votes: DataFrame) -> DataFrame:
    """ep, label, clusters: a face seen talking in the windows of several clusters."""
    return votes.groupBy("ep", "label").agg(F.array_join(F.sort_array(F.collect_set("cluster_id")), ",").alias("clusters"), F.count_distinct("cluster_id").alias("n")).filter("n > 1").drop("n")


def mouth_compliance(actions: DataFrame, least: float = 0.80, longest_ms: int = 3000) -> DataFrame:
    """Per episode: actions by mouth state and motion (any but the legal ones is unknown), the share with a legal state, windows
    over 3 s, the share of the others, and whether the channel is usable: both shares reach ``least``."""
    at = lambda column, values: {v: F.count_if(F.col(column) == v) for v in values}
    states, motions = at("mouth_state", STATES), at("mouth_motion", MOTIONS)
    other = lambda column, values: F.count_if(F.col(column).isNull() | ~F.col(column).isin(values))
    rows = actions.groupBy("ep").agg(
        F.count(F.lit(1)).alias("total"), *[n.alias(f"state_{v}") for v, n in states.items()], other("mouth_state", STATES).alias("state_unknown"),
        *[n.alias(f"motion_{v}") for v, n in motions.items()], other("mouth_motion", MOTIONS).alias("motion_unknown"),
        F.count_if(F.col("r_end_ms") - F.col("r_start_ms") > longest_ms).alias("over"),
    )
    valid, short = F.col("total") - F.col("state_unknown"), F.col("total") - F.col("over")
    rows = rows.withColumn("valid_rate", valid / F.col("total")).withColumn("window_compliance", short / F.col("total"))
    return rows.withColumn("usable", (valid >= least * F.col("total")) & (short >= least * F.col("total")))


def distributions(counts: DataFrame, unobserved: DataFrame, by: list[str]) -> DataFrame:
    """by, family, candidate, p = n / (sum n + u); families without observations drop out.

    counts: by, family, candidate, n; unobserved: by, family, u.
    """
    summed = counts.groupBy(*by, "family").agg(F.sum("n").alias("all")).filter("all > 0")
    rows = counts.filter("n > 0").join(summed, [*by, "family"]).join(unobserved, [*by, "family"], "left")
    return rows.select(*by, "family", "candidate", (F.col("n") / (F.col("all") + F.greatest(F.lit(0.0), F.coalesce("u", F.lit(0.0))))).alias("p"))


def fused(dist: DataFrame, by: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """by, candidate, score: the product over families of p to its weight; a family that does not name one gives 0."""
    weight = F.lit(1.0)
    for family, w in (weights or {}).items():
        weight = F.when(F.col("family") == family, w).otherwise(weight)
    families = dist.groupBy(*by).agg(F.count_distinct("family").alias("families"))
    each = dist.withColumn("x", F.pow("p", weight)).groupBy(*by, "candidate").agg(F.array_sort(F.collect_list(F.struct("family", "x"))).alias("xs"))
    product = F.aggregate("xs", F.lit(1.0), lambda a, x: a * x["x"])
    return each.join(families, by).select(*by, "candidate", F.when(F.size("xs") == F.col("families"), product).otherwise(0.0).alias("score"))


def margins(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, winner, margin = (first - second) / sum; ranked by score, then name."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "candidate")
    ranked = scores.withColumn("rank", F.row_number().over(order))
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    rows = ranked.groupBy(*by).agg(at(1, "candidate").alias("winner"), at(1, "score").alias("first"), F.coalesce(at(2, "score"), F.lit(0.0)).alias("second"), F.sum("score").alias("all"))
    return rows.select(*by, "winner", F.when(F.col("all") > 0, (F.col("first") - F.col("second")) / F.col("all")).otherwise(0.0).alias("margin"))


def compared(clusters: DataFrame, slots: DataFrame) -> DataFrame:
    """ep, cluster_id, slot_id, agree, unknown: fields in which both are known and equal, and in which either is unknown."""
    pairs = clusters.join(slots.select("ep", "slot_id", *[F.col(f).alias(f"slot_{f}") for f in FIELDS]), "ep")
    verdicts = [compatible(F.col(f), F.col(f"slot_{f}")) for f in FIELDS]
    count = lambda conditions: sum((F.when(c, 1).otherwise(0) for c in conditions), F.lit(0)).cast("long")
    return pairs.select("ep", "cluster_id", "slot_id", count(verdicts).alias("agree"), count(v.isNull() for v in verdicts).alias("unknown"))


def resolve(clusters: DataFrame, slots: DataFrame, votes: DataFrame, clips: DataFrame, ruled_out: DataFrame, signoffs: DataFrame) -> DataFrame:
    """ep, cluster_id, slot_id, status, matched_via, margin, entity_id, entity_name: clusters in order of name, each to a known slot
    or a new one.

    A match needs two families and a clear margin. A new slot is a candidate for the clusters after it, so the fold is
    sequential within an episode; episodes, which hold a few dozen rows, are independent groups.
    clusters: ep, cluster_id, FIELDS; slots: ep, slot_id, FIELDS, visual_label, status; votes: ep, cluster_id, label,
    votes; clips: ep, clips, usable; ruled_out: ep, cluster_id, slot_id; signoffs: ep, cluster_id. slots and signoffs may have entity_id and
    entity_name: whom a person signed a slot, or a cluster, off as. They are all the names there are.
    """
    own = lambda df: {k: c for k, c in (("g", "entity_id"), ("h", "entity_name")) if c in df.columns}
    tag = lambda df, kind, **cols: df.select("ep", F.lit(kind).alias("kind"), *[F.coalesce(F.col(cols[c]).cast("string"), F.lit("")).alias(c) if c in cols else F.lit("").alias(c) for c in "abcdefgh"])
    rows = tag(clusters, "cluster", a="cluster_id", b="gender", c="age_band", d="timbre")
    rows = rows.unionByName(tag(slots, "slot", a="slot_id", b="gender", c="age_band", d="timbre", e="visual_label", f="status", **own(slots)))
    rows = rows.unionByName(tag(votes, "vote", a="cluster_id", b="label", c="votes")).unionByName(tag(clips, "clip", a="clips", b="usable"))
    rows = rows.unionByName(tag(ruled_out, "out", a="cluster_id", b="slot_id")).unionByName(tag(signoffs, "sign", a="cluster_id", **own(signoffs)))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        part = {k: g for k, g in own.groupby("kind")}
        each = lambda kind, *cols: part[kind][list(cols)].itertuples(index=False, name=None) if kind in part else iter(())
        known = [list(x) for x in sorted(each("slot", *"abcdefgh"))]
        clip = next(each("clip", "a", "b"), ("0", "false"))
        seen: dict = {}
        for c, label, n in each("vote", "a", "b", "c"):
            seen.setdefault(c, {})[label] = int(n)
        barred, signed = set(each("out", "a", "b")), {c: who for c, *who in each("sign", "a", "g", "h")}
        out = []
        for cluster, *attributes in sorted(each("cluster", *"abcd")):
            fit = [s for s in known if (cluster, s[0]) not in barred]
            agree = {s[0]: sum(x == y != "unknown" for x, y in zip(attributes, s[1:4], strict=True)) for s in fit}
            unsure = sum(x == "unknown" or y == "unknown" for s in fit for x, y in zip(attributes, s[1:4], strict=True))
            face = {s[0]: seen.get(cluster, {}).get(s[4], 0) if s[4] else 0 for s in fit} if clip[1] == "true" else {}
            families = {}
            for family, counts, unobserved in (("acoustic", agree, unsure), ("visual", face, max(0, int(clip[0]) - sum(face.values())))):
                if total := sum(counts.values()):
                    families[family] = {k: v / (total + unobserved) for k, v in counts.items() if v}
            score: dict = {}
            for candidate in set().union(*families.values()):
                p = 1.0
                for family in sorted(families):
                    p *= families[family].get(candidate, 0.0)
                score[candidate] = p
            ranked = sorted(score.items(), key=lambda x: (-x[1], x[0]))
            whole = sum(score.values())
            margin = (ranked[0][1] - (ranked[1][1] if len(ranked) > 1 else 0.0)) / whole if whole > 0 else 0.0
            support = sum(ranked[0][0] in f for f in families.values()) if ranked else 0
            if support >= FAMILIES and margin >= MARGIN:
                slot = next(s for s in known if s[0] == ranked[0][0])
                approved = slot[5] == "approved"
                out.append((cluster, slot[0], "approved" if approved else "candidate", "approved_slot" if approved else "pending_slot", margin, *slot[6:]))
                continue
            slot_id, human = f"S{len(known) + 1}", cluster in signed
            who = signed.get(cluster, ["", ""])
            known.append([slot_id, *attributes, "", "approved" if human else "pending", *who])
            out.append((cluster, slot_id, "approved" if human else "unknown", "human_signoff" if human else "new_slot", margin, *who))
        frame = pd.DataFrame(out, columns=["cluster_id", "slot_id", "status", "matched_via", "margin", "entity_id", "entity_name"])
        frame[["entity_id", "entity_name"]] = frame[["entity_id", "entity_name"]].replace("", None)
        frame.insert(0, "ep", own["ep"].iloc[0])
        return frame

    return rows.groupBy("ep").applyInPandas(run, "ep long, cluster_id string, slot_id string, status string, matched_via string, margin double, entity_id string, entity_name string")
