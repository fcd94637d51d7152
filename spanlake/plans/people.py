"""Queries over identities: the approved table, evidence, the resolver, sign-off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attribute, fuse, identity, signoff, vocative
from ..sources import testdata as td
from .oracles import ACTIONS, ATTRS, BASE, BIND, CALLED, CUES, LINES, NAMED, TURNS, VOTES, w
from .registry import query

ENTITIES = """
eps AS (SELECT DISTINCT ep FROM base),
ents AS (SELECT ep, x.* FROM eps, (VALUES (1, 'E1', 'is', ['it'], 'approved', 'P1', 'male', 'adult', 'soft'), (2, 'E2', 'der', ['la', ' '], 'Approved', ' P2 ', 'female', '', 'deep'),
  (3, 'E3', 'thing', [], 'draft', 'P3', 'male', 'adult', 'deep'), (4, 'E4', 'ghost', [], 'approved', '', 'unknown', 'unknown', 'soft')) x(pos, entity_id, canonical_name, aliases, status, visual_label, gender, age_band, timbre)),
slot AS (SELECT ep, 'S' || row_number() OVER (PARTITION BY ep ORDER BY pos) AS slot_id, entity_id, canonical_name, nullif(trim(visual_label), '') AS visual_label, coalesce(nullif(gender, ''), 'unknown') AS gender, coalesce(nullif(age_band, ''), 'unknown') AS age_band, coalesce(nullif(timbre, ''), 'unknown') AS timbre
  FROM ents WHERE lower(status) = 'approved'),
calls AS (SELECT ep, cluster_id, ['is', 'la', 'x', 'it'][event_id % 4 + 1] AS term FROM voices WHERE event_id % 3 = 0)"""


def entities(spark, d) -> DataFrame:
    """ep, pos, entity_id, canonical_name, aliases, status, approved_by, approved_at, visual_label, attributes, evidence."""
    ep = F.col("ep")
    record = lambda kind, slot, cluster, work: F.struct(F.lit(kind).alias("kind"), F.lit(slot).alias("slot_id"), F.lit(cluster).alias("cluster_id"), work.alias("workspace"))
    here, next_ = F.format_string("w%d", ep), F.format_string("w%d", ep + 1)
    own = record("signoff", "S9", "SPEAKER_A3", here)
    evidence = {
        1: F.array(own, record("note", "S9", "SPEAKER_A1", here)), 3: F.array(record("signoff", "S5", "SPEAKER_A5", here)), 4: F.array(record("signoff", "S6", "SPEAKER_A2", F.lit(""))),
        2: F.when(ep % 2 == 0, F.array(record("signoff", "S8", "SPEAKER_A4", next_), record("signoff", "S7", "SPEAKER_A3", here))).otherwise(F.array(record("signoff", "S8", "SPEAKER_A4", next_))),
    }
    table = [(1, "E1", "is", ["it"], "approved", "P1", "male", "adult", "soft"), (2, "E2", "der", ["la", " "], "Approved", " P2 ", "female", "", "deep"), (3, "E3", "thing", [], "draft", "P3", "male", "adult", "deep"), (4, "E4", "ghost", [], "approved", "", "unknown", "unknown", "soft")]
    names = ["entity_id", "canonical_name", "status", "visual_label", "gender", "age_band", "timbre"]

    def row(pos, entity, name, aliases, status, label, *attributes):
        by = F.when((ep % 7 == 0) & (F.lit(pos) == 4), None).otherwise("human")
        values = dict(zip(names, [entity, name, status, label, *attributes], strict=True))
        listed = F.array(*map(F.lit, aliases)) if aliases else F.array().cast("array<string>")
        return F.struct(F.lit(pos).alias("pos"), *[F.lit(v).alias(k) for k, v in values.items()], listed.alias("aliases"), by.alias("approved_by"), F.lit("2024-01-01").alias("approved_at"), evidence[pos].alias("evidence"))

    eps = td.table(spark, d, "events").select(F.col("user_id").alias("ep")).distinct()
    return eps.select("ep", F.explode(F.array(*[row(*x) for x in table])).alias("x")).select("ep", "x.*")


def calls(spark, d) -> DataFrame:
    from .catalogue import clustered

    term = F.element_at(F.array(*map(F.lit, ["is", "la", "x", "it"])), (F.col("event_id") % 4 + 1).cast("int"))
    return clustered(spark, d).filter("event_id % 3 = 0").select("ep", "cluster_id", term.alias("term"))


def voiced(spark, d) -> DataFrame:
    """ep, cluster_id and voted attributes."""
    from .catalogue import attributed

    votes = attribute.attribute_votes(attributed(spark, d), fuse.FIELDS, ["ep", "cluster_id"])
    return votes.groupBy("ep", "cluster_id").pivot("field", fuse.FIELDS).agg(F.first("value"))


VOICED = """
cnt2 AS (SELECT ep, cluster_id, field, v, count(*) AS n FROM (SELECT ep, cluster_id, 'gender' AS field, gender AS v FROM attrs UNION ALL SELECT ep, cluster_id, 'age_band', age_band FROM attrs UNION ALL SELECT ep, cluster_id, 'timbre', timbre FROM attrs) WHERE v <> 'unknown' GROUP BY ALL),
won AS (SELECT ep, cluster_id, field, arg_max(v, (n, v)) AS v, max(n) / sum(n) AS share FROM cnt2 GROUP BY ALL),
voiced AS (SELECT v.ep, v.cluster_id, coalesce(max(w.v) FILTER (field = 'gender' AND share >= 0.6), 'unknown') AS gender, coalesce(max(w.v) FILTER (field = 'age_band' AND share >= 0.6), 'unknown') AS age_band, coalesce(max(w.v) FILTER (field = 'timbre' AND share >= 0.6), 'unknown') AS timbre
  FROM (SELECT DISTINCT ep, cluster_id FROM voices) v LEFT JOIN won w USING (ep, cluster_id) GROUP BY v.ep, v.cluster_id)"""


@query(w(BASE, TURNS, ENTITIES) + "SELECT ep, slot_id, gender, age_band, timbre, visual_label, 'approved' AS status, entity_id, canonical_name AS entity_name FROM slot")
def approved_slots(spark, d):
    return identity.approved_slots(entities(spark, d))


@query(
    w(BASE, TURNS, ENTITIES)
    + """, rec AS (SELECT ep, 1 AS pos, 0 AS n, 'SPEAKER_A3' AS cluster_id, 'w' || ep AS workspace FROM eps UNION ALL SELECT ep, 2, 0, 'SPEAKER_A4', 'w' || (ep + 1) FROM eps UNION ALL SELECT ep, 2, 1, 'SPEAKER_A3', 'w' || ep FROM eps WHERE ep % 2 = 0
  UNION ALL SELECT ep, 3, 0, 'SPEAKER_A5', 'w' || ep FROM eps UNION ALL SELECT ep, 4, 0, 'SPEAKER_A2', '' FROM eps)
SELECT r.ep, r.cluster_id, arg_max(e.entity_id, (r.pos, r.n)) AS entity_id, arg_max(e.canonical_name, (r.pos, r.n)) AS entity_name FROM rec r JOIN ents e USING (ep, pos) WHERE lower(e.status) = 'approved' AND r.workspace = 'w' || r.ep GROUP BY ALL"""
)
def signoff_scope(spark, d):
    """Sign-offs of this workspace, another one and none; of approved entities and a draft."""
    return identity.scoped_signoffs(entities(spark, d), F.format_string("w%d", "ep"))


@query(
    w(BASE, TURNS, ENTITIES)
    + """, surf AS (SELECT ep, entity_id, trim(unnest(list_concat([canonical_name], aliases))) AS surface FROM ents)
SELECT DISTINCT s.ep, c.cluster_id, s.slot_id FROM slot s JOIN surf f USING (ep, entity_id) JOIN calls c ON c.ep = s.ep AND c.term = f.surface WHERE f.surface <> ''"""
)
def ruled_out_slots(spark, d):
    table = entities(spark, d)
    return identity.ruled_out(identity.approved_slots(table), table, calls(spark, d))


@query(
    w(BASE, TURNS, ATTRS, ENTITIES, VOICED)
    + """SELECT v.ep, v.cluster_id, s.slot_id, CAST((v.gender <> 'unknown' AND v.gender = s.gender)::INT + (v.age_band <> 'unknown' AND v.age_band = s.age_band)::INT + (v.timbre <> 'unknown' AND v.timbre = s.timbre)::INT AS BIGINT) AS agree,
  CAST((v.gender = 'unknown' OR s.gender = 'unknown')::INT + (v.age_band = 'unknown' OR s.age_band = 'unknown')::INT + (v.timbre = 'unknown' OR s.timbre = 'unknown')::INT AS BIGINT) AS unknown FROM voiced v JOIN slot s USING (ep)"""
)
def attribute_agreement(spark, d):
    return fuse.compared(voiced(spark, d), identity.approved_slots(entities(spark, d)))


@query(w(BASE, TURNS, ACTIONS, VOTES, ENTITIES) + "SELECT s.ep, v.cluster_id, s.slot_id, v.votes FROM slot s JOIN vv v ON v.ep = s.ep AND v.label = s.visual_label")
def slot_votes(spark, d):
    from .catalogue import visual_votes

    return identity.slot_votes(identity.approved_slots(entities(spark, d)), visual_votes(spark, d))


@query(
    w(BASE, CUES, TURNS, ATTRS, ENTITIES, VOICED, BIND, NAMED)
    + """, sp AS (SELECT ep, cluster_id, CAST(sum(e - s) AS BIGINT) AS speech_ms FROM voices GROUP BY ALL), ln AS (SELECT ep, cluster_id, count(*) AS n FROM bound WHERE cluster_id IS NOT NULL GROUP BY ALL)
SELECT v.*, coalesce(n, 0) AS line_count, speech_ms, d.name IS NOT NULL AS named FROM voiced v JOIN sp USING (ep, cluster_id) LEFT JOIN ln USING (ep, cluster_id) LEFT JOIN named d USING (ep, cluster_id)"""
)
def acoustic_evidence(spark, d):
    return heard(spark, d)


def heard(spark, d) -> DataFrame:
    from .catalogue import attributed, bound, clustered

    lines, turns = bound(spark, d), clustered(spark, d)
    votes = attribute.attribute_votes(attributed(spark, d), fuse.FIELDS, ["ep", "cluster_id"])
    return identity.acoustic_evidence(attribute.cluster_summary(lines, turns), votes, attribute.name_votes(lines))


@query(
    w(BASE, ACTIONS)
    + """, clip AS (SELECT ep, segment, bool_or(mouth_state IN ('moving', 'still', 'not_visible'))::INT AS u, bool_or(mouth_state = 'moving')::INT AS p FROM actions GROUP BY ALL),
c AS (SELECT ep, count(*) AS clips_total, CAST(sum(u) AS BIGINT) AS clips_usable, CAST(sum(p) AS BIGINT) AS clips_positive FROM clip GROUP BY ep),
s AS (SELECT ep, count(*) FILTER (mouth_state = 'moving') AS moving, count(*) FILTER (mouth_state = 'still') AS still, count(*) FILTER (mouth_state = 'not_visible') AS not_visible, count(*) FILTER (mouth_state = 'open') AS unknown FROM actions GROUP BY ep),
f AS (SELECT ep, string_agg(who || ':' || n, ',' ORDER BY who) AS faces FROM (SELECT ep, who, count(*) AS n FROM actions WHERE mouth_state = 'moving' AND mouth_motion = 'speaking' GROUP BY ALL) GROUP BY ep)
SELECT c.*, moving, still, not_visible, unknown, coalesce(faces, '') AS faces FROM c JOIN s USING (ep) LEFT JOIN f USING (ep)"""
)
def visual_evidence(spark, d):
    return identity.visual_evidence(td.actions(spark, d))


@query(
    w(BASE, CUES, TURNS, ACTIONS, ATTRS, ENTITIES, VOICED, VOTES)
    + """, f AS (SELECT ep, cluster_id, string_agg(label || '×' || votes, '、' ORDER BY votes DESC, label) AS faces FROM vv GROUP BY ALL), n AS (SELECT ep, cluster_id, string_agg(DISTINCT term, ',' ORDER BY term) AS not_speaker FROM calls GROUP BY ALL)
SELECT v.*, coalesce(faces, '') AS faces, coalesce(not_speaker, '') AS not_speaker FROM voiced v LEFT JOIN f USING (ep, cluster_id) LEFT JOIN n USING (ep, cluster_id)"""
)
def evidence_bundle(spark, d):
    from .catalogue import visual_votes

    return identity.evidence_bundle(voiced(spark, d), visual_votes(spark, d), calls(spark, d))


def resolved(spark, d) -> DataFrame:
    from .catalogue import visual_votes

    table = entities(spark, d)
    slots = identity.approved_slots(table)
    clips = identity.visual_evidence(td.actions(spark, d)).select("ep", F.col("clips_total").alias("clips"))
    clips = clips.join(fuse.mouth_compliance(td.actions(spark, d), least=0.5).select("ep", "usable"), "ep")
    barred = identity.ruled_out(slots, table, calls(spark, d))
    return fuse.resolve(voiced(spark, d), slots, visual_votes(spark, d), clips, barred, identity.scoped_signoffs(table, F.format_string("w%d", "ep")))


@query()
def resolver_fold(spark, d):
    """Clusters to approved or new slots, in order; sign-offs of this workspace name theirs."""
    return resolved(spark, d)


@query(w(BASE, TURNS) + "SELECT ep, count(DISTINCT cluster_id) AS clusters, true AS settled FROM voices GROUP BY ep")
def resolver_check(spark, d):
    """Each cluster is settled once: at a known slot with two families and a margin, or at a slot of its own."""
    rows = resolved(spark, d)
    inherits = F.col("matched_via").isin("approved_slot", "pending_slot")
    good = F.when(inherits, F.col("margin") >= fuse.MARGIN).otherwise(F.col("matched_via").isin("new_slot", "human_signoff") & (F.col("entity_id").isNotNull() == (F.col("matched_via") == "human_signoff")))
    fresh = F.count_distinct(F.when(~inherits, F.col("slot_id"))) == F.count_if(~inherits)
    return rows.groupBy("ep").agg(F.count(F.lit(1)).alias("clusters"), (F.every(good) & fresh).alias("settled"))


ASSIGNED = """
assigned AS (SELECT DISTINCT ep, cluster_id, ['approved', 'candidate', 'unknown', NULL][(ep + CAST(right(cluster_id, 1) AS BIGINT)) % 4 + 1] AS status FROM voices)"""


def assignments(spark, d) -> DataFrame:
    from .catalogue import clustered

    status = F.element_at(F.array(F.lit("approved"), F.lit("candidate"), F.lit("unknown"), F.lit(None).cast("string")), ((F.col("ep") + F.substring("cluster_id", -1, 1).cast("long")) % 4 + 1).cast("int"))
    return clustered(spark, d).select("ep", "cluster_id").distinct().withColumn("status", status)


@query(w(BASE, TURNS, ASSIGNED) + "SELECT ep, count(*) AS clusters, count(*) FILTER (status = 'unknown') AS abstained, count(*) FILTER (status = 'unknown') / count(*) AS rate FROM assigned GROUP BY ep")
def abstention(spark, d):
    return identity.abstention(assignments(spark, d))


@query(w(BASE, TURNS, ASSIGNED) + "SELECT ep, count(*) FILTER (status = 'approved') AS named, count(*) FILTER (status = 'candidate') AS candidate, count(*) FILTER (coalesce(status, 'unknown') = 'unknown') AS unknown FROM assigned GROUP BY ep")
def cast_summary(spark, d):
    return identity.cast_summary(assignments(spark, d))


@query(
    w(BASE, TURNS, ENTITIES, ASSIGNED)
    + """, own AS (SELECT ep, cluster_id, 'N' || right(cluster_id, 1) AS slot_id, CASE WHEN status = 'approved' THEN 'E1' END AS entity_id, CASE WHEN right(cluster_id, 1) IN ('1', '2') THEN 'approved_table' ELSE 'this_episode' END AS origin, CASE WHEN ep % 2 = 0 THEN 'human_signoff' ELSE 'new_slot' END AS via FROM assigned)
SELECT ep, 'unsigned' AS rule, entity_id AS subject FROM ents WHERE lower(status) = 'approved' AND pos = 4 AND ep % 7 = 0 UNION SELECT ep, 'forged', slot_id FROM own WHERE entity_id IS NOT NULL AND origin <> 'approved_table' AND via <> 'human_signoff'"""
)
def forged_names(spark, d):
    rows = assignments(spark, d).withColumn("slot_id", F.concat(F.lit("N"), F.substring("cluster_id", -1, 1)))
    rows = rows.withColumn("matched_via", F.when(F.col("ep") % 2 == 0, "human_signoff").otherwise("new_slot"))
    origin = F.when(F.substring("cluster_id", -1, 1).isin("1", "2"), "approved_table").otherwise("this_episode")
    slots = rows.select("ep", "slot_id", F.when(F.col("status") == "approved", "E1").alias("entity_id"), origin.alias("origin"))
    return identity.forged_names(entities(spark, d), rows, slots)


# sign-off ---------------------------------------------------------------------------------------------------

PENDING = """
listed AS (SELECT ep, 'S' || right(cluster_id, 1) AS slot_id, cluster_id, event_id AS ord, CASE WHEN right(cluster_id, 1) = '3' THEN 'approved' ELSE 'pending' END AS status FROM voices),
pend AS (SELECT * FROM listed QUALIFY row_number() OVER (PARTITION BY ep, slot_id ORDER BY ord) = 1),
waiting AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY ord) AS place FROM pend WHERE status <> 'approved')"""


def pending(spark, d) -> DataFrame:
    from .catalogue import clustered

    number = F.substring("cluster_id", -1, 1)
    rows = clustered(spark, d).select("ep", F.concat(F.lit("S"), number).alias("slot_id"), "cluster_id", F.col("event_id").alias("ord"), F.when(number == "3", "approved").otherwise("pending").alias("status"))
    return signoff.pending(rows)


@query(w(BASE, TURNS, PENDING) + "SELECT ep, slot_id, cluster_id, ord FROM waiting WHERE place BETWEEN 5 AND 8")
def pending_round(spark, d):
    """The second round of four slots that wait for a name."""
    return signoff.page(pending(spark, d), 1).select("ep", "slot_id", "cluster_id", "ord")


NAMES_TOLD = """
faces AS (SELECT v.ep, v.cluster_id, e.pos, e.canonical_name AS name FROM vv v JOIN ents e ON e.ep = v.ep AND e.visual_label = v.label),
heardn AS (SELECT ep, term AS name, count(*) AS n FROM calls GROUP BY ALL),
ranked AS (SELECT p.ep, p.slot_id, p.cluster_id, x.name, min((x.k, x.o, x.name)) AS key FROM waiting p JOIN (SELECT ep, cluster_id, name, 0 AS k, pos::BIGINT AS o FROM faces UNION ALL SELECT w.ep, w.cluster_id, h.name, 1, -h.n FROM waiting w JOIN heardn h USING (ep)) x ON x.ep = p.ep AND x.cluster_id = p.cluster_id GROUP BY ALL),
offered AS (SELECT *, row_number() OVER (PARTITION BY ep, slot_id ORDER BY key) AS r FROM ranked),
told AS (SELECT p.ep, p.slot_id, p.cluster_id, p.ord, coalesce(list(o.name ORDER BY r) FILTER (o.name IS NOT NULL), []) AS names FROM waiting p LEFT JOIN (SELECT * FROM offered o WHERE r <= 3 AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.ep = o.ep AND c.cluster_id = o.cluster_id AND c.term = o.name)) o USING (ep, slot_id, cluster_id) GROUP BY p.ep, p.slot_id, p.cluster_id, p.ord)"""


def offers(spark, d) -> DataFrame:
    from .catalogue import visual_votes

    return signoff.candidate_names(pending(spark, d), entities(spark, d), visual_votes(spark, d), calls(spark, d))


@query(w(BASE, TURNS, ACTIONS, VOTES, ENTITIES, PENDING, NAMES_TOLD) + "SELECT ep, slot_id, cluster_id, array_to_string(names, ',') AS names FROM told")
def naming_candidates(spark, d):
    return offers(spark, d).withColumn("names", F.array_join("names", ","))


@query(
    w(BASE, TURNS, ACTIONS, ATTRS, VOTES, ENTITIES, VOICED, PENDING, NAMES_TOLD)
    + """, f AS (SELECT ep, cluster_id, list(label || '×' || votes ORDER BY votes DESC, label) AS faces FROM vv GROUP BY ALL), n AS (SELECT ep, cluster_id, string_agg(DISTINCT term, '、' ORDER BY term) AS b FROM calls GROUP BY ALL),
l AS (SELECT t.ep, t.ord, '| ' || t.slot_id || ' | ' || coalesce(nullif(array_to_string(list_filter([v.gender, v.age_band, v.timbre], lambda x: x <> 'unknown'), '；'), ''), '（无可用画像）')
  || CASE WHEN f.faces IS NOT NULL THEN '｜说话期间动嘴的画像：' || array_to_string(f.faces[1:3], '、') || CASE WHEN t.ep % 2 = 0 THEN '' ELSE '（该信道未过 P3 遵从门，仅供你目视核对）' END ELSE '' END
  || ' | ' || CASE WHEN len(names) > 0 THEN array_to_string(names, '／') ELSE '（无候选，建议保留描述性标签）' END || CASE WHEN b IS NOT NULL THEN '（不是 ' || b || '——这簇台词里在叫他们）' ELSE '' END || ' | 新出现 |' AS line
  FROM told t JOIN voiced v USING (ep, cluster_id) LEFT JOIN f USING (ep, cluster_id) LEFT JOIN n USING (ep, cluster_id))
SELECT ep, md5('| 槽位 | 画像（机器给的证据） | 候选（最多 3 个） | 为什么需要你 |' || chr(10) || '| :--- | :--- | :--- | :--- |' || chr(10) || string_agg(line, chr(10) ORDER BY ord, line)) AS digest FROM l GROUP BY ep"""
)
def signoff_sheet(spark, d):
    """The sheet of all pending slots of an episode."""
    from .catalogue import visual_votes

    bundle = identity.evidence_bundle(voiced(spark, d), visual_votes(spark, d), calls(spark, d))
    listed = lambda c, by: F.filter(F.split(c, by), lambda x: x != "")
    rows = pending(spark, d).select("ep", "slot_id", "cluster_id", "ord").join(offers(spark, d), ["ep", "slot_id", "cluster_id"]).join(bundle, ["ep", "cluster_id"])
    rows = rows.withColumns({"faces": listed("faces", "、"), "not_speaker": listed("not_speaker", ","), "trusted": F.col("ep") % 2 == 0, "reason": F.lit("")})
    return signoff.sheet(rows).select("ep", F.md5("sheet").alias("digest"))


@query()
def reply_outcomes(spark, d):
    """Replies in plain words read as decisions; SQL has no form of it, unit tests pin the outcomes."""
    offered = F.array(F.struct(F.lit("S1").alias("slot_id"), F.array(F.lit("is"), F.lit("der")).alias("names")), F.struct(F.lit("S2").alias("slot_id"), F.array(F.lit("la")).alias("names")))
    reply = F.element_at(F.array(*map(F.lit, ["S1=is S2=跳过", "S1 那个叫der", "第二个叫la", "S1 嗯", "剩下的跳过", "S9=x", "hello", "S2: ghost"])), (F.col("turn") % 8 + 1).cast("int"))
    rows = td.table(spark, d, "conversations").select(F.col("conv_id").alias("ep"), reply.alias("reply"), offered.alias("slots"), F.array(F.lit("ghost")).alias("known"))
    return signoff.reply_decisions(rows).groupBy("ep", "slot_id", "outcome", "name").agg(F.count(F.lit(1)).alias("n"))


ROUND = """
decided AS (SELECT user_id AS series, event_id AS ord, 'S' || event_id % 5 AS slot_id, 'A' || event_id % 4 AS cluster_id, 'w' || event_id % 2 AS workspace, ['is', 'neu', ' ', 'der', ' neu', NULL, 'alt'][event_id % 7 + 1] AS name FROM events),
picked AS (SELECT series, ord, slot_id, cluster_id, workspace, trim(name) AS name FROM decided WHERE trim(name) <> ''),
known AS (SELECT DISTINCT user_id AS series, unnest(['E1', 'E2']) AS entity_id, unnest(['is', 'der']) AS name FROM events),
told AS (SELECT series, name, min(ord) AS ord, count(DISTINCT (workspace, slot_id, cluster_id)) AS records, count(DISTINCT (workspace, slot_id, cluster_id)) FILTER ((workspace, slot_id, cluster_id) <> ('w0', 'S0', 'A0')) AS fresh FROM picked GROUP BY ALL)"""


def round_of(spark, d) -> tuple[DataFrame, DataFrame]:
    e = F.col("event_id")
    name = F.element_at(F.array(*[F.lit(x) for x in ["is", "neu", " ", "der", " neu", None, "alt"]]), (e % 7 + 1).cast("int"))
    rows = td.table(spark, d, "events").select(F.col("user_id").alias("series"), e.alias("ord"), F.format_string("S%d", e % 5).alias("slot_id"), F.format_string("A%d", e % 4).alias("cluster_id"), F.format_string("w%d", e % 2).alias("workspace"), name.alias("name"))
    old = F.array(F.struct(F.lit("S0").alias("slot_id"), F.lit("A0").alias("cluster_id"), F.lit("w0").alias("workspace"), F.lit("2020-01-01").alias("date")))
    known = F.explode(F.array(F.struct(F.lit("E1").alias("entity_id"), F.lit("is").alias("canonical_name")), F.struct(F.lit("E2").alias("entity_id"), F.lit("der").alias("canonical_name"))))
    return rows.select("series").distinct().select("series", known.alias("x")).select("series", "x.*", old.alias("evidence")), rows


@query(w(ROUND) + """SELECT coalesce(k.series, t.series) AS series, coalesce(k.entity_id, 'C' || 2 + row_number() OVER (PARTITION BY coalesce(k.series, t.series), k.entity_id IS NULL ORDER BY t.ord)) AS entity_id, coalesce(k.name, t.name) AS canonical_name,
  CASE WHEN k.name IS NULL THEN records ELSE 1 + coalesce(fresh, 0) END AS records FROM known k FULL JOIN told t ON k.series = t.series AND k.name = t.name""")
def signoff_round(spark, d):
    """Each series' entity table after a round of decisions."""
    known, decisions = round_of(spark, d)
    rows = signoff.apply_round(known, decisions, F.lit("2024-02-02"), ("series",))
    return rows.select("series", "entity_id", "canonical_name", F.size("evidence").cast("long").alias("records"))


@query(w(ROUND) + """, c AS (SELECT p.series, p.slot_id, p.name, CASE WHEN k.name IS NULL AND p.ord = min(p.ord) OVER (PARTITION BY p.series, p.name) THEN 'new_entity' ELSE 'linked_existing' END AS change FROM picked p LEFT JOIN known k ON k.series = p.series AND k.name = p.name)
SELECT series, '2' AS version, '2024-02-02' AS date, string_agg(slot_id || ' ' || change || ' ' || name, ';' ORDER BY slot_id, change, name) AS diff FROM c GROUP BY series UNION ALL SELECT DISTINCT user_id, '1', '2024-01-01', '' FROM events""")
def signoff_history(spark, d):
    """The history of each series' table with the round as its second version."""
    known, decisions = round_of(spark, d)
    first = known.select("series", F.lit("1").alias("version"), F.lit("2024-01-01").alias("date"), F.array().cast("array<struct<slot_id:string,change:string,name:string>>").alias("diff")).distinct()
    rows = signoff.append_version(first, signoff.changes(known, decisions, ("series",)), F.lit("2024-02-02"), ("series",))
    return rows.withColumn("diff", F.array_join(F.transform("diff", lambda x: F.concat_ws(" ", x["slot_id"], x["change"], x["name"])), ";"))


vocative_positions = """, m AS (SELECT ep, term, index, cluster_id, CAST(n AS BIGINT) AS n, (at_start AND NOT (n = 1 AND at_end))::INT AS s, (at_end AND NOT (n = 1 AND at_start))::INT AS e FROM heard)
SELECT ep, term, CAST(sum(n) AS BIGINT) AS count, CAST(sum(s) AS BIGINT) AS at_start, CAST(sum(n - s - e) AS BIGINT) AS at_mid, CAST(sum(e) AS BIGINT) AS at_end, CAST(coalesce(sum(n) FILTER (cluster_id IS NOT NULL), 0) AS BIGINT) AS negative FROM m GROUP BY ALL"""


@query(w(LINES, CALLED) + vocative_positions)
def vocative_terms(spark, d):
    from .catalogue import called

    return vocative.term_tally(called(spark, d))
